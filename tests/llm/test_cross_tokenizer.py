"""op12 against plain Python over the tokenizers' own tokens."""

from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessella.llm import cross_tokenizer as X
from tests.conftest import DATA

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokens():
    """text -> ((ids, bytes) of A, of B), by the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    # the library's own spelling of each byte
    spelled = {}
    for b in range(256):
        c = bytes([b]).decode("latin-1")
        spelled |= dict(zip(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0], c.encode(), strict=True))
    assert len(pre_tokenizers.ByteLevel.alphabet()) == 256
    rest = set(pre_tokenizers.ByteLevel.alphabet()) - set(spelled)
    spelled |= {c: X.vocabulary(A).bytes[X.vocabulary(A).first[t.token_to_id(c)]] for c in rest}  # bytes that no text of one letter holds
    assert sorted(map(int, spelled.values())) == list(range(256))

    def encode(text):
        a = t.encode(" " + text, add_special_tokens=False).ids
        b = sp.encode(text)
        piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
        return (a, [bytes(int(spelled[c]) for c in t.id_to_token(i)) for i in a]), (b, [piece(i) for i in b])

    return encode


def plainly(rows, tokens):
    docs, count = [], Counter()
    for d, text in rows:
        links, groups, ends = [], [], []
        if text:
            (a, sa), (b, sb) = tokens(text)
            if b"".join(sa) == b"".join(sb) == (" " + text).encode():
                at = [[0], [0]]
                for side, spelt in zip(at, (sa, sb), strict=True):
                    for s in spelt:
                        side.append(side[-1] + len(s))
                ends = sorted(set(at[0][1:]) & set(at[1][1:]))
                i = j = 0
                while i < len(a) and j < len(b):
                    links.append((a[i], b[j]))
                    x, y = at[0][i + 1], at[1][j + 1]
                    i, j = i + (x <= y), j + (y <= x)
                i = j = 0
                for e in ends:
                    k, m = at[0].index(e), at[1].index(e)
                    groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
                    i, j = k, m
            else:
                a = b = []
        else:
            a = b = []
        count.update(links)
        docs.append((d, len(a), len(b), len(ends), links, ";".join(groups)))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(n, best.get(b, 0))
    return sorted(((d, na, nb, ng, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), g) for d, na, nb, ng, links, g in docs), key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()), key=str)


def test_like_plain_python(spark, tokens):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where(F.length("text") < 4000)  # the plain form is quadratic
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = plainly(rows, tokens)
    assert found(X.align(docs, A, B)) == want
    digests = [(*r[:-1], sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in want]
    assert found(X.align(docs.repartition(3), A, B, digest=True, chunk_bytes=50_000)) == sorted(digests, key=str)


def test_odd_texts(spark, odd, empty, tokens):
    texts = ["<|endoftext|> a</s><s> b", "▁under▁bar", " lead", "two  spaces\n\n\ttabs", "é" * 30, "á \U0001f600 漢字", "\x00 nul \x7f", "<0x41>", "1234567890 12.5%", "'s 't don't I'LL"]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(enumerate(texts, 100), "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect() if not r.text or len(r.text) < 10_000]
    docs = docs.where("text IS NULL OR length(text) < 10000")
    assert found(X.align(docs, A, B)) == plainly(rows, tokens)
    assert X.align(empty, A, B).collect() == []
    # a very long text, and every other column of the fixture
    assert {r.doc_id: r.n_a > 100_000 for r in X.align(odd, A, B).collect()}[4]


def test_ids_of_the_library(tokens):
    v = X.vocabulary(A)
    assert v.fast is not None
    texts = ["Hello world", "x" * 500, "\n\n  a\r\n\tb  ", "　" * 50 + "!", "<|endoftext|>"]
    assert [list(x) for x in v.encode(texts)] == [tokens(t)[0][0] for t in texts]
    wide = " " * 2_000_000 + "x"  # the fast way refuses it
    assert v.length[v.encode([wide])[0]].sum() == len(wide) + 1


def test_cuts_of_any_shape():
    rng = np.random.default_rng(3)
    for share in (0.0, 0.02, 0.5, 1.0):
        docs, a, b, first, last, base = [], [], [], [], [], 0
        for n in (1, 2, 3, 50, 400):
            ea = np.sort(rng.choice(np.arange(1, 2001), n, replace=False))
            eb = np.unique(np.concatenate((ea[rng.random(n) < share], ea[-1:], np.arange(2, ea[-1], 7)[: n // 2] if share else ea[-1:])))
            first.append(sum(map(len, a)))
            a.append(ea + base)
            b.append(eb + base)
            last.append(sum(map(len, a)))
            docs.append(np.intersect1d(ea, eb) + base)
            base += int(ea[-1])
        a, b = np.concatenate(a), np.concatenate(b)
        assert (a[X.shared_cuts(a, b, np.array(first), np.array(last))] == np.concatenate(docs)).all()
