from collections import Counter

from pyspark.sql import functions as F

from tessella.llm import mixing as M
from tessella.llm import registry

from .conftest import ROWS


def test_same_as_sql(same_as_sql):
    same_as_sql(registry.op3_mixing, registry.ORACLE_SQL["op3_mixing"])


def test_odd_rows(spark, odd):
    rows = M.mix(odd).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        x = by.setdefault(r.source, [0, 0, r.source_size, r.target])
        x[0], x[1] = x[0] + r.size, x[1] + r.taken
    total = sum(x[0] for x in by.values())
    assert abs(sum(x[3] for x in by.values()) - 1.5 * total) < 1e-6 * total
    for size, taken, source_size, target in by.values():
        assert size == source_size and target <= 2 * size
        assert abs(taken - target) <= max(2, 0.02 * source_size)
    again = M.mix(odd).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_identifiers_of_any_type(odd):
    named = odd.withColumn("doc_id", F.concat(F.lit("d-"), F.col("doc_id").cast("string")))
    rows = M.mix(named).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted("None" if r[0] is None else f"d-{r[0]}" for r in ROWS)
    assert M.apply_mix(named).columns == odd.columns


def test_weights_go_by_code_point_with_null_last(spark):
    docs = spark.createDataFrame([(i, "w " * 100, s) for i, s in enumerate(["Z", "a", "é", None, "\U0001f600"])], "doc_id long, text string, source string")
    targets = {r.source: (r.weight, r.target) for r in M.source_targets(M.sizes(docs)).collect()}
    assert [targets[s][0] for s in ("Z", "a", "é", "\U0001f600", None)] == [5, 2, 1, 5, 2]
    # 750 words; the two of weight 5 stop at 200, the rest shares 350 by 2 : 1 : 2
    assert {s: round(x[1], 6) for s, x in targets.items()} == {"Z": 200, "\U0001f600": 200, "a": 140, "é": 70, None: 140}


def test_permutation(spark):
    slots = spark.createDataFrame([("s", 1000, 1, 1000, 2000), (None, 7, 1, 7, 10)], "source string, source_size long, block_words long, blocks long, slots long")
    drawn = M.draw(slots, M.shard_counts(slots, shard_slots=300))
    counts = drawn.groupBy("source", "block").count().collect()
    assert sorted(r["count"] for r in counts if r.source == "s") == [2] * 1000
    assert sorted(r["count"] for r in counts if r.source is None) == [1] * 4 + [2] * 3
    first = [r.block for r in drawn.where("source = 's' and slot < 1000").orderBy("slot").collect()]
    assert sorted(first) == list(range(1000)) and sum(a < b for a, b in zip(first, first[1:])) in range(400, 600)


def test_empty(empty):
    assert M.mix(empty).count() == 0
    assert M.apply_mix(empty).columns == empty.columns and M.apply_mix(empty).count() == 0


def test_apply(odd):
    out = M.apply_mix(odd)
    assert out.columns == odd.columns
    assert out.where("text is null or text = ''").count() == 0
    rows, n = out.collect(), len(ROWS)
    whole = {r[0]: r[1].split() for r in ROWS if r[1]}
    for r in rows:  # words of the document, in order
        w = iter(whole[r.doc_id])
        assert all(x in w for x in r.text.split())
    assert len(rows) <= 2 * n


def test_documents_hold_the_words_that_the_mix_takes(spark):
    # a, d and g stop at twice their size, c is left with 0.4 of its own; b, e, f, h and i are one short document each
    n = {"a": 88, "d": 88, "g": 88, "c": 120}
    rows, i = [], 0
    for s in "abcdefghi":
        for _ in range(n.get(s, 1)):
            i += 1
            rows.append((i, 5000 + i * 7919 % 15001 if s in n else 5, s))
    docs = spark.createDataFrame(rows, "doc_id long, words int, source string").select("doc_id", F.expr("array_join(transform(sequence(1, words), i -> concat(doc_id, '_', i)), ' \n')").alias("text"), "source")
    plan = {r.source: r for r in M.plan_slots(M.source_targets(M.sizes(docs))).collect()}
    assert 0.3 < plan["c"].target / plan["c"].source_size < 0.5
    taken = {r.doc_id: r.taken for r in M.mix(docs).collect()}
    out = M.apply_mix(docs).select("doc_id", "source", "text").collect()
    by_doc, by_source = Counter(), Counter()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out:
        words = r.text.split()
        assert all(w.startswith(f"{r.doc_id}_") for w in words)
        numbers = [int(w.split("_")[1]) for w in words]
        assert numbers == sorted(set(numbers))  # each word once a copy, in order
        assert len(words) < len(texts[r.doc_id].split()) or r.text == texts[r.doc_id]
        by_doc[r.doc_id] += len(words)
        by_source[r.source] += len(words)
    assert by_doc == Counter({k: v for k, v in taken.items() if v})
    assert max(Counter(r.doc_id for r in out).values()) <= 2
    for s, p in plan.items():
        assert abs(by_source[s] - p.target) <= p.block_words, s


def test_equal_rows_are_paired_one_for_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "s", i) for i in range(40)] + [(None, "x y", None, 0)] * 3, "doc_id long, text string, source string, n int")
    taken = sum(r.taken for r in M.mix(docs).collect())
    out = M.apply_mix(docs).collect()
    assert sum(len(r.text.split()) for r in out) == taken
    assert max(Counter(r.n for r in out if r.doc_id == 1).values()) <= 2


def test_mix_holds_whole_blocks_in_shards(spark):
    docs = spark.range(600).selectExpr("id as doc_id", "repeat('w ', cast(1 + id * 37 % 900 as int)) as text", "case id % 4 when 0 then null when 1 then 'b' else 'a' end as source")
    sized = M.sizes(docs).cache()
    slots = M.plan_slots(M.source_targets(sized)).cache()
    drawn_counts = M.shard_counts(slots, shard_slots=64).cache()
    drawn = M.draw(slots, drawn_counts).cache()
    plan = {r.source: r for r in slots.collect()}
    blocks = {(r.source, r.slot): r for r in drawn.collect()}
    assert len(blocks) == drawn.count() == sum(r.slots for r in plan.values())

    # slots by shard and source add up to the plan and vary as a multinomial draw does
    counts = {(r.shard, r.source): r.slots for r in drawn_counts.collect()}
    assert {(r.shard, r.source): r["count"] for r in drawn.groupBy("shard", "source").count().collect()} == counts
    shards = -(-len(blocks) // 64)
    assert {k for k, _ in counts} == set(range(shards))
    for source, r in plan.items():
        of = [counts.get((k, source), 0) for k in range(shards)]
        mean = r.slots / shards
        assert sum(of) == r.slots
        chi2 = sum((n - mean) ** 2 / mean for n in of)
        assert abs(chi2 - (shards - 1)) < 4 * (2 * (shards - 1)) ** 0.5

    # every slot holds its block's words once: spans of documents, end to end
    rows = M.mixed(M.spans(M.pack(sized), slots), drawn).collect()
    size = {r.doc_id: r.size for r in sized.collect()}
    spans, documents, by_shard = {}, {}, {}
    for r in rows:
        assert (r.shard, r.block) == (blocks[r.source, r.slot].shard, blocks[r.source, r.slot].block)
        assert 0 <= r.first and 0 < r.words and r.first + r.words <= size[r.doc_id]
        spans[r.source, r.slot] = spans.get((r.source, r.slot), 0) + r.words
        documents[r.doc_id] = documents.get(r.doc_id, 0) + r.words
        by_shard.setdefault((r.shard, r.source), set()).add(r.slot)
    assert {k: len(v) for k, v in by_shard.items()} == counts
    for (source, slot), words in spans.items():
        p = plan[source]
        assert words == min(p.block_words, p.source_size - blocks[source, slot].block * p.block_words)
    assert spans.keys() == blocks.keys()
    assert {r.doc_id: r.taken for r in M.mix(docs).collect() if r.taken} == {k: v for k, v in _taken_of(M.mixed_blocks(docs)).items()}


def _taken_of(mix):
    return {r.doc_id: r.n for r in mix.groupBy("doc_id").agg(F.sum("words").alias("n")).collect()}


def test_mixed_blocks(odd, empty):
    mix = M.mixed_blocks(odd)
    assert mix.columns[:4] == ["shard", "source", "slot", "block"] and {"doc_id", "start", "first", "words"} <= set(mix.columns)
    assert sum(r.words for r in mix.collect()) == sum(r.taken for r in M.mix(odd).collect()) > 0
    assert M.mixed_blocks(empty).count() == 0


def test_slots_are_shuffled_and_keep_their_shard(odd):
    sized = M.sizes(odd).cache()
    slots = M.plan_slots(M.source_targets(sized)).cache()
    made = M.mixed(M.spans(M.pack(sized), slots), M.draw(slots, M.shard_counts(slots)))
    plan = made._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "shard" in plan.split("== Optimized Logical Plan ==")[1]
