"""The pipeline against its stages in plain Python, and on odd rows."""

import zlib
from collections import Counter

import corpus_pipeline as P
import numpy as np
import pytest
from tokenizers import Tokenizer

from tessella.llm import mixing as M
from tessella.llm import quality as Q
from tessella.llm.token_table import default_tokenizer

from .test_decontaminate import plain
from .test_simhash import plain_components, plain_fingerprint


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=str)


def test_each_stage(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = Q.fit(docs, spark.read.parquet(f"{data}/labels.parquet"), learn=~Q.held_out())
    kept = P.keep_quality(spark, docs, data)
    all_rows = rows(docs)
    score = model.score(np.array([Q.document_statistics(t) for _, t in all_rows]))
    assert kept.columns == docs.columns
    assert rows(kept) == [r for r, s in zip(all_rows, score, strict=True) if s >= 0.7]

    kept = kept.cache()
    left = P.drop_near_duplicates(spark, kept, data)
    before = rows(kept)
    roots = plain_components([i for i, _ in before], [plain_fingerprint(t) for _, t in before])
    assert left.columns == docs.columns
    assert rows(left) == [r for r, c in zip(before, roots, strict=True) if r[0] == c]

    left = left.cache()
    clean = P.drop_contaminated(spark, left, data)
    bench = {tuple(w[a : a + 10]) for (t,) in spark.read.parquet(f"{data}/benchmark.parquet").select("text").collect() if (w := plain(t)) for a in range(max(1, len(w) - 9))}
    sizes = {len(b) for b in bench}
    hit = lambda w: any(tuple(w[a : a + n]) in bench for n in sizes for a in range(len(w) - n + 1))
    assert clean.columns == docs.columns
    assert rows(clean) == [r for r in rows(left) if not hit(plain(r[1]))]

    clean = clean.cache()
    mixed = P.mix_sources(spark, clean, data).cache()
    assert mixed.columns == docs.columns
    plan = {r.source: r for r in M.plan_slots(M.source_targets(M.sizes(clean))).collect()}
    texts = {r.doc_id: r.text for r in clean.collect()}
    words = Counter()
    for r in mixed.collect():
        own, of = (r.text or "").split(), iter(texts[r.doc_id].split())
        assert all(w in of for w in own) and r.n_chars == len(r.text)
        words[r.source] += len(own)
    assert all(abs(words[s] - p.target) <= p.block_words for s, p in plan.items())

    out = P.write_tokens(spark, mixed, data).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted(r.doc_id for r in mixed.select("doc_id").collect())
    assert [r.start for r in out] == [0, *np.cumsum([r.n_tokens for r in out])[:-1].tolist()]
    tokenizer = Tokenizer.from_file(default_tokenizer())
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == sorted((r.doc_id, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r in mixed.collect() for x in [ids(r.text)])


def test_run(spark, data):
    found = P.run(spark, data)
    assert found.count() > 0 and found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert [n for n, _ in P.STAGES] and P.ORACLE_SQL is None


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES[:-1]])
def test_odd_rows(spark, odd, empty, data, stage):
    for docs in (odd, empty):
        out = stage(spark, docs, data)
        assert out.columns == docs.columns and out.count() <= 2 * docs.count()
    assert P.write_tokens(spark, odd, data).count() == odd.count()
