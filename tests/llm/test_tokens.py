import io
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import token_table as T

from .conftest import ROWS


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(T.default_tokenizer())


def brute(rows, tokenizer):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    out, at = [], 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=str)


def check(spark, docs, rows, tokenizer, shards=None):
    files = T.write_table(docs, T.default_tokenizer(), shards=shards)
    assert sorted(map(tuple, T.documents_in(files).drop("shard").collect()), key=str) == brute([(r[0], r[1]) for r in rows], tokenizer)
    return files


def test_odd_rows(spark, odd, tokenizer):
    files = check(spark, odd, ROWS, tokenizer, shards=3)
    assert files.count() > 1
    asked = spark.createDataFrame([(1, "k"), (5, None), (99, None), (None, None)], "doc_id long, file string")
    found = sorted((r.doc_id, len(r.ids)) for r in T.lookup(files, asked).collect() if r.doc_id is not None)
    one, five = (len(tokenizer.encode(ROWS[i][1], add_special_tokens=False).ids) + 1 for i in (0, 7))
    assert found == [(1, one), (1, one), (5, five)]


def test_documents(spark, data, tokenizer):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    check(spark, docs, docs.select("doc_id", "text").collect(), tokenizer)


def test_empty(spark, empty):
    assert T.tokenized(spark, empty).count() == 0


TEXTS = ["<|endoftext|> a", "<|ENDOFTEXT|>x y", "Don't STOP it's 'S I'LL a'b", "İ Σσς ΑΣ ß K", "\x1c\x1dab x\u00a0y z\u2003w", "e\u0301 \u0301x a \u0301b", "漢字 12 ½ ²", "", None, "word,word. (x) ... a.,b a,'s  two  spaces\n"]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokenizer_of_the_library(spark, file):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = list(enumerate(TEXTS))
    files = T.write_table(spark.createDataFrame(rows, "doc_id int, text string"), public_tokenizers.path(file))
    got = {r.doc_id: list(r.ids) for r in T.lookup(files, spark.range(20).withColumnRenamed("id", "doc_id")).collect()}
    plain = Tokenizer.from_file(public_tokenizers.path(file))
    assert got == {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}


def test_string_identifiers(spark, tokenizer):
    rows = [("b", "two words"), ("a\u00e9", "x"), ("\U0001f600" * 100, "long id"), (None, None), ("", "empty id"), ("b", "again")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    files = T.write_table(docs, T.default_tokenizer(), shards=2)
    got = T.documents_in(files).orderBy("start").collect()
    assert [r.doc_id for r in got] == [r[0] for r in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode()))]
    found = T.lookup(files, docs.select("doc_id").union(spark.createDataFrame([("zz",)], "doc_id string"))).collect()
    assert sorted((r.doc_id, len(r.ids)) for r in found if r.doc_id) == sorted((i, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for i, t in rows if i)
    with pytest.raises(TypeError, match="whole numbers or strings"):
        T.write_table(docs.selectExpr("cast(1.5 as double) as doc_id", "text"), T.default_tokenizer())


def test_read_back_by_a_task_a_file(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "'some text' as text")
    files = T.write_table(docs, T.default_tokenizer(), shards=6)
    assert T.read_table(files).rdd.getNumPartitions() == files.count() == 6


def test_file_format(monkeypatch):
    monkeypatch.setattr(T, "BLOCK_BYTES", 64)
    out = io.BytesIO()
    w = T.TableWriter(out, 2)
    keys = [None, -5, 0, 7, 7, 300, 2**62]
    for i, k in enumerate(keys):
        w.add(T.key_bytes(k), np.arange(i + 10, dtype="<u2").tobytes())
    with pytest.raises(ValueError, match="ascend"):
        w.add(T.key_bytes(3), b"")
    w.close()
    table = T.TableReader(pa.BufferReader(out.getvalue()))
    assert [(T.key_value(k), len(ids)) for k, ids in table] == [(k, i + 10) for i, k in enumerate(keys)]
    assert len(table.place) > 2 and table.records == len(keys)
    assert [len(x) for x in table.get(7)] == [13, 14] and table.get(8) == [] and len(table.get(None)) == 1


ODD = [
    "T\u0308he t\u0308 H\u0331 W\u030a J\u030c I\u0307 i\u0307 E\u0301t e\u0301T",
    "ÀÉÎ,x École... ÉCOLE École,'s ×a÷b µm ªº ÿ! Ÿ ŉ ſ ẞ \u00ad",
    "they'll THEY'LL,'s 'S' ''s a'd!'re rock'n'roll",
    "x\x00y \x00\x1f! a\x7f,\x1c b\x85c d\u00a0\u0301e \u2028f\u3000g",
    "<|endoftext|>a b<|startoftext|>, <|ENDOFTEXT|> <|endoftext| > a</w> </w> </w",
    "user.42@mail.example 3.14 10.0.0.1 A1b2,C3 \uac00\u11a8 \u1100\u1161 \U0001f600!\U0001f600",
    "x" * 3000 + "! " + "Word " * 50,
    "",
    None,
]


def test_words_have_the_ids_of_whole_texts(tokenizer, monkeypatch):
    texts = [*TEXTS, *ODD, *(t.upper() for t in ODD if t), *(t[::-1] for t in ODD if t)]
    want = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    for memo, at_once in ((1 << 20, 2_000), (10_000, 3), (0, 1)):
        monkeypatch.setattr(T, "MEMO_BYTES", memo)
        monkeypatch.setattr(T, "WORDS_AT_ONCE", at_once)
        encoder = T.WordEncoder(T.default_tokenizer())
        assert encoder.encode(texts) == want
        assert [encoder.encode([t])[0] for t in texts] == want
        assert bool(encoder.older) == (memo == 10_000)
        assert encoder.encode(texts) == want
        assert encoder.held <= memo and max(map(len, [*encoder.memo, *encoder.older]), default=0) <= T.MEMO_WORD


def test_a_word_goes_to_the_library_once(tokenizer):
    class Counted:
        chars = 0

        def __getattr__(self, name):
            return getattr(tokenizer, name)

        def encode_batch_fast(self, texts, **how):
            self.chars += sum(map(len, texts))
            return tokenizer.encode_batch_fast(texts, **how)

    T.shared_encoder.cache_clear()
    encoder = T.shared_encoder(T.default_tokenizer())
    encoder.tokenizer = Counted()
    texts = [f"The same few words, number {i % 7}, again and again." for i in range(1_000)]
    got = encoder.encode(texts[:500]) + encoder.encode(texts[500:])
    T.shared_encoder.cache_clear()
    assert got == T.Encoder(T.default_tokenizer()).encode(texts)
    assert encoder.tokenizer.chars < 200


def test_only_files_that_part_at_white_space_are_read_by_words(tokenizer, tmp_path):
    import json

    import public_tokenizers

    steps = json.loads(tokenizer.to_str())
    assert T.parts_at_white_space(steps)
    assert type(T.shared_encoder(public_tokenizers.path("byte_bpe_50k.json"))) is T.Encoder
    control = steps["added_tokens"][0] | {"id": 49408}
    others = [
        {"normalizer": None},
        {"pre_tokenizer": {"type": "Metaspace", "replacement": "\u2581", "prepend_scheme": "first", "split": False}},
        {"truncation": {"direction": "Right", "max_length": 4, "strategy": "LongestFirst", "stride": 0}},
        {"model": steps["model"] | {"dropout": 0.5}},
        {"added_tokens": [*steps["added_tokens"], control | {"content": "two words"}]},
        {"added_tokens": [*steps["added_tokens"], control | {"content": "fox!"}]},
        {"added_tokens": [*steps["added_tokens"], control | {"content": "<|pad|>", "lstrip": True}]},
    ]
    assert not any(T.parts_at_white_space(steps | o) for o in others)
    path = tmp_path / "spaces.json"
    path.write_text(json.dumps(steps | {"added_tokens": [*steps["added_tokens"], control | {"content": "quick brown"}]}))
    (got,) = T.shared_encoder(str(path)).encode(["the quick brown fox"])
    T.shared_encoder.cache_clear()
    assert 49408 in np.frombuffer(got, "<u2")
