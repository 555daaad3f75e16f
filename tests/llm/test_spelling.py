"""op13 against plain Python: counted words, near words by deletion neighbourhoods, forms and roots."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

from tessella.llm import spelling as S
from tests.conftest import DATA


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows, least=6, often=5):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(upper)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= often}


def plainly(n):
    holes = defaultdict(set)  # a word with one code point out or replaced by a mark
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + w[i + 1 :]].add(w)
            holes[w[:i] + "\0" + w[i + 1 :]].add(w)
    met = defaultdict(set)
    for h, ws in holes.items():
        for a, b in itertools.combinations(ws | ({h} & set(n)), 2):
            if near(a, b):
                met[a].add(b)
                met[b].add(a)
    form = {}
    for w in n:
        best = min(met[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(met[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_like_plain_python(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = plainly(plain_words(rows))
    assert len(want) > 100 and any(r[1] for r in want)
    assert found(S.group_variants(docs)) == want
    assert found(S.group_variants(docs, most=2)) == want  # every partition is divided to the end


def test_dense_words_and_chains(spark):
    rng = random.Random(5)
    n = {"".join(rng.choice("abé") for _ in range(rng.choice((6, 7, 8)))): 5 ** rng.randint(1, 6) for _ in range(900)}
    n |= {"a" * k: 5**k for k in range(6, 14)} | {"b" * 300: 9, "b" * 301: 100}
    want = plainly(n)
    assert max(r[4] for r in want) > 10
    vocabulary = spark.createDataFrame(list(n.items()), "word string, n long")
    for most in (20_000, 40, 3):
        got = {r.word: (r.n_near, r.best_n) for r in S.near_words(vocabulary, most=most).collect()}
        assert {w: k for w, (k, _) in got.items()} == {r[0]: r[4] for r in want if r[4]}
    links = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(40)], "word string, form string")
    assert {r.root for r in S.roots(links).collect()} == {"c40"}


def test_one_edit_machine():
    rng = random.Random(1)
    for _ in range(60):
        short = sorted({"".join(rng.choice("abc") for _ in range(4)) for _ in range(rng.randint(0, 25))})
        long = sorted({"".join(rng.choice("abc") for _ in range(5)) for _ in range(rng.randint(0, 25))})
        got = [(x, y) for _, x, y in S.partition_pairs(short, long)]
        want = {(x, y) for x, y in itertools.combinations(short, 2) if near(x, y)} | {(x, y) for x in short for y in long if near(x, y)}
        assert len(got) == len(set(got)) and set(got) == want


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    n = plain_words(rows, 3, 1)
    got = {r.word: r.n for r in S.words(odd, least_length=3, least_count=1).collect()}
    assert got == n
    assert S.group_variants(empty).collect() == []
    # words of 50,000 letters
    one, two = "x" * 50_000, "x" * 30_000 + "y" + "x" * 19_999
    long = [(i, f"{one} {two}") for i in range(5)]
    assert set(plain_words(long)) == {one, two}
    assert found(S.group_variants(spark.createDataFrame(long, "doc_id long, text string"))) == [(one, None, one, 5, 1, None), (two, None, two, 5, 1, None)]
