"""Mixing sources to target weights, with DataFrame functions only.

1. ``source_targets``: a word's share for each source by weight, no target above ``cap`` times its source's size, the excess
   shared among the others by weight (a water level found by running sums over sources sorted by cap / weight).
2. ``pack``: each source's documents, laid end to end, are cut into blocks of a fixed length of the source. Places are
   running sums in two steps, inside slices of a source and over the slices' totals; a slice is a hash of identifier and
   size, there are as many as a slice has rows (the root of the number of documents), so a source that holds a third of
   all rows is summed by many tasks.
3. ``shard_counts``: a multinomial draw of each source's slots (how many blocks its target takes) over the output shards;
   it is conditioned on the source's total, so that the counts of all shards add up to what the target sets.
4. ``draw``: a shard's slots are dealt from those counts, a source's slots going up with the shards, and each is mapped to a
   block by a pseudorandom permutation of the source's block numbers: a swap-or-not shuffle of ``ROUNDS`` rounds keyed by
   md5, so no table of indices is made, sorted or sent. The permutation starts anew after each pass, hence no block is taken
   more than ceil(target / size) times.
5. ``mixed``: slots join blocks by (source, block); the result is the mix, the document spans of each slot of each shard,
   written shard by shard. ``taken`` sums it up by document, ``apply_mix`` turns it into documents again.

All draws are functions of the seed, the source and the index: reruns agree.

Defined cases: null and empty texts have size 0 and are taken 0 times; the null source is a source of its own, last; repeated
rows are rows of their own; identifiers may be of any type that has a text form, null among them; an empty table gives an
empty mix; other columns don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
ROUNDS = 8
SEED = 17
#: Blocks are at most so many words; a small source has shorter ones, its size over SPLIT.
BLOCK, SPLIT = 1024, 256
#: Slots of an output shard, about.
SHARD_SLOTS = 4096
#: Slots drawn by a task, about, and tasks at most.
RUN_SLOTS, MOST_TASKS = 10_000, 4096


def size_of(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size and two hashes that name the row: key (of doc_id and source), text_hash."""
    key, text_hash = _names(F.col(doc_id), F.col(source), F.col(text))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), key.alias("key"), text_hash.alias("text_hash"))


def _names(doc_id: Column, source: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that tell rows apart; equal for equal rows only, null or not."""
    return F.xxhash64(doc_id.isNull(), doc_id, source.isNull(), source), F.xxhash64(text.isNull(), text)


def _number(*parts: Column) -> Column:
    """60 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def _same(left: DataFrame, right: DataFrame, keys: list[str], hint: str | None = None) -> DataFrame:
    """Inner join in which null keys meet: nulls are moved to a column of their own, so Spark can still hash the keys."""
    right = right.select(*[x for i, k in enumerate(keys) for x in (F.col(k).isNull().alias(f"__n{i}"), F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"__{i}"))], *[c for c in right.columns if c not in keys])
    on = [c for i, k in enumerate(keys) for c in (F.coalesce(left[k].cast("string"), F.lit("")) == right[f"__{i}"], left[k].isNull() == right[f"__n{i}"])]
    return left.join(right.hint(hint) if hint else right, on).drop(*[f"__{i}" for i in range(len(keys))], *[f"__n{i}" for i in range(len(keys))])


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row a source: source, source_size, weight, target. Windows run over sources, not over documents."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(nth, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("weight", weight)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    by = by.select(
        "source", "source_size", "weight", (F.lit(cap) * F.col("source_size")).alias("most"),
        F.sum("source_size").over(whole).alias("all_size"),
        F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("open_weight"),
    )
    # the level if this and all later sources stay below their caps; it rises up to the first source that does, and falls after it
    level = (F.lit(share) * F.col("all_size") - F.col("full")) / F.col("open_weight")
    by = by.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    target = F.least(F.col("most").cast("double"), F.col("level") * F.col("weight"))
    return by.select("source", "source_size", "weight", target.alias("target"))


def plan_slots(targets: DataFrame, block: int = BLOCK, split: int = SPLIT) -> DataFrame:
    """Adds block_words, blocks and slots. Whole passes take every block; the rest of the target takes part of one more pass."""
    length = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / split))).cast("long")
    t = targets.withColumn("block_words", length).withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.least(F.col("blocks"), F.floor((F.col("target") - passes * F.col("source_size")) / F.col("block_words") + 0.5).cast("long"))
    return t.withColumn("slots", passes * F.col("blocks") + rest)


def pack(sized: DataFrame, rows: int | None = None) -> DataFrame:
    """Documents with words and their place: the columns of sized and start (words of the same source before the document)."""
    slices = math.isqrt(sized.count() if rows is None else rows) + 1
    at = F.pmod(_number(F.lit("slice"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")), F.lit(slices))
    rows_ = sized.where("size > 0").withColumn("slice", at)
    totals = rows_.groupBy("source", "slice").agg(F.sum("size").alias("n"))
    totals = totals.select("source", "slice", (F.sum("n").over(Window.partitionBy("source").orderBy("slice")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("source", "slice").orderBy("doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    rows_ = rows_.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    return _same(rows_, totals, ["source", "slice"]).withColumn("start", F.col("before") + F.col("inside")).select(*sized.columns, "start")


def spans(packed: DataFrame, slots: DataFrame) -> DataFrame:
    """Packed documents cut at the blocks' ends: block, first (word of the document in that block, from 0) and words beside the columns of packed."""
    starts = _same(packed, slots.select("source", "block_words"), ["source"])
    first, last = F.floor(F.col("start") / F.col("block_words")).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / F.col("block_words")).cast("long")
    parts = starts.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest("start", F.col("block") * F.col("block_words"))
    words = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("block_words")) - begin
    return parts.select(*packed.columns, "block", (begin - F.col("start")).alias("first"), words.alias("words"))


def _name() -> Column:
    return F.concat(F.when(F.col("source").isNull(), "n").otherwise("s"), F.coalesce("source", F.lit("")))


def _tasks(slots: DataFrame) -> tuple[int, int]:
    """All slots, and tasks to make them in."""
    total = slots.agg(F.sum("slots")).first()[0] or 0
    return total, max(1, min(MOST_TASKS, -(-total // RUN_SLOTS)))


def shard_counts(slots: DataFrame, seed: int = SEED, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """A multinomial draw for each source: shard, source, slots. Every slot falls into one of the shards with equal chances; only the counts are kept."""
    total, tasks = _tasks(slots)
    runs = slots.where("slots > 0").select("source", "slots", _name().alias("name"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / RUN_SLOTS))).alias("run"))
    runs = runs.repartition(tasks, "source", "run")
    each = runs.select("source", "name", F.explode(F.sequence(F.col("run") * RUN_SLOTS, F.least((F.col("run") + 1) * RUN_SLOTS, F.col("slots")) - 1)).alias("i"))
    shard = F.pmod(_number(F.lit(f"shard{seed}"), F.col("name"), F.col("i")), F.lit(max(1, -(-total // shard_slots))))
    return each.select("source", shard.alias("shard")).groupBy("shard", "source").agg(F.count("*").alias("slots"))


def draw(slots: DataFrame, counts: DataFrame, seed: int = SEED, rounds: int = ROUNDS) -> DataFrame:
    """One row a slot of the counts: source, slot, shard, block."""
    _, tasks = _tasks(slots)
    dealt = counts.select("shard", "source", F.col("slots").alias("n"), (F.sum("slots").over(Window.partitionBy("source").orderBy("shard")) - F.col("slots")).alias("from"))
    dealt = _same(dealt, slots.select("source", "blocks"), ["source"]).withColumn("name", _name()).repartition(tasks, "source", "shard")
    upto = F.col("from") + F.col("n")
    dealt = dealt.withColumn("pass", F.explode(F.sequence(F.floor(F.col("from") / F.col("blocks")), F.floor((upto - 1) / F.col("blocks")))))
    keys = [F.struct(_number(F.lit(f"key{seed}.{r}"), F.col("name"), F.col("pass")).alias("key"), F.concat_ws("|", F.lit(f"swap{seed}.{r}"), "name", "pass", F.lit("")).alias("tag")) for r in range(rounds)]
    dealt = dealt.withColumn("keys", F.array(*keys))
    first = F.col("pass") * F.col("blocks")
    out = dealt.withColumn("slot", F.explode(F.sequence(F.greatest("from", first), F.least(upto, first + F.col("blocks")) - 1)))

    def swap(at: Column, k: Column) -> Column:
        other = F.pmod(k["key"] - at, F.col("blocks"))
        bit = F.substring(F.md5(F.concat(k["tag"], F.greatest(at, other).cast("string"))), 1, 1)
        return F.when(bit < "8", at).otherwise(other)

    return out.select("source", "slot", "shard", F.aggregate("keys", F.col("slot") - first, swap).alias("block"))


def mixed(parts: DataFrame, drawn: DataFrame) -> DataFrame:
    """The mix, one row a document span of a slot: shard, source, slot, block, and the columns of parts. Rows of a shard are in one partition, in order.

    (shard, source, slot) names one copy of a block; its spans are words first to first + words - 1 of the documents in it.
    Spark takes slots for a small table, as it can't see how many a plan makes, so the join is told to shuffle and sort.
    """
    rows = _same(parts, drawn, ["source", "block"], "merge")
    return rows.select("shard", "source", "slot", "block", *[c for c in parts.columns if c not in ("source", "block")]).repartition("shard").sortWithinPartitions("shard", "source", "slot", "start")


def _mixed(sized: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Targets, packed documents and the mix, written."""
    targets = cut(plan_slots(source_targets(sized)), "targets")
    packed = cut(pack(sized), "packed")
    counts = cut(shard_counts(targets), "shard-counts")
    return targets, packed, cut(mixed(spans(packed, targets), draw(targets, counts)), "mixed")


def mixed_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix of a table of documents, as ``mixed`` returns it, written to the shared folder."""
    return _mixed(cut(sizes(docs, doc_id, text, source), "sizes"))[2]


def taken(packed: DataFrame, mix: DataFrame) -> DataFrame:
    """Words that the mix takes of each packed document: doc_id, source, size, taken. (source, start) names a document."""
    rows = packed.select("source", "start", "doc_id", "size", F.lit(0).cast("long").alias("words")).unionByName(mix.select("source", "start", "doc_id", "size", "words"))
    return rows.groupBy("source", "start", "doc_id", "size").agg(F.sum("words").alias("taken")).drop("start")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix summed up, one row a document: doc_id, source, size, source_size, target, taken."""
    sized = cut(sizes(docs, doc_id, text, source), "sizes")
    targets, packed, blocks = _mixed(sized)
    none = sized.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("taken"))
    rows = taken(packed, blocks).unionByName(none)
    return _same(rows, targets.select("source", "source_size", "target"), ["source"]).select("doc_id", "source", "size", "source_size", "target", "taken")


def taken_spans(mix: DataFrame) -> DataFrame:
    """Words taken of each document in order, one row a copy: key, text_hash, size, copy (from 1), spans (array of first, words), nth.

    Copy 2 holds the spans that the mix takes twice. nth tells equal rows of the documents apart, from 1; they take the places
    of the packed rows one for one.
    """
    times = mix.groupBy("source", "start", "key", "text_hash", "size", "first", "words").agg(F.count("*").alias("times"))
    of = times.groupBy("source", "start", "key", "text_hash", "size").agg(F.array_sort(F.collect_list(F.struct("first", "words", "times"))).alias("x"))
    of = of.withColumn("nth", F.row_number().over(Window.partitionBy("key", "text_hash").orderBy("start")))
    of = of.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max(F.transform("x", lambda s: s["times"])))))
    kept = F.transform(F.filter("x", lambda s: s["times"] >= F.col("copy")), lambda s: F.struct(s["first"].alias("first"), s["words"].alias("words")))
    return of.select("key", "text_hash", "size", "nth", "copy", kept.alias("spans"))


def apply_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix as documents: for each row of docs, one row a copy whose text has just the words taken, so each source has its
    target's words but for part of a block. A text that is taken whole stays as it is; of others the taken words stay, each
    with the white space after it. Other columns are the document's.

    The plan's rows and the documents meet in one shuffle by two hashes of the row and are paired there by window functions,
    so equal rows are never multiplied with each other.
    """
    plan = cut(taken_spans(_mixed(cut(sizes(docs, doc_id, text, source), "sizes"))[2]), "taken")
    key_, hash_, nth_, of_, whole_ = (fresh(docs, c) for c in ("__key", "__hash", "__nth", "__copies", "__size"))
    copies = plan.groupBy("key", "text_hash", "nth", "size").agg(F.collect_list("spans").alias("copies"))  # cap copies at most
    of_type = "array<array<struct<first: bigint, words: bigint>>>"
    key, text_hash = _names(F.col(doc_id), F.col(source), F.col(text))
    rows = docs.select("*", key.alias(key_), text_hash.alias(hash_), F.lit(None).cast("int").alias(nth_), F.lit(None).cast("long").alias(whole_), F.lit(None).cast(of_type).alias(of_))
    plan = copies.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema], F.col("key").alias(key_), F.col("text_hash").alias(hash_), F.col("nth").alias(nth_), F.col("size").alias(whole_), F.col("copies").alias(of_))
    is_plan = F.col(nth_).isNotNull()
    rows = rows.union(plan).withColumn(nth_, F.coalesce(nth_, F.row_number().over(Window.partitionBy(key_, hash_, is_plan).orderBy(key_))))
    pair = Window.partitionBy(key_, hash_, nth_).orderBy(F.col(of_).isNull())  # the plan's row, then the document's
    met = F.lag(F.struct(F.col(of_).alias("copies"), F.col(whole_).alias("size"))).over(pair)
    rows = rows.withColumn(whole_, met).where(F.col(of_).isNull() & F.col(whole_).isNotNull()).withColumn(of_, F.explode(F.col(whole_)["copies"]))
    parts = F.regexp_extract_all(F.col(text), F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1))
    some = F.array_join(F.flatten(F.transform(F.col(of_), lambda s: F.slice(parts, (s["first"] + 1).cast("int"), s["words"].cast("int")))), "")
    words = F.aggregate(F.col(of_), F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return rows.withColumn(text, F.when(words == F.col(whole_)["size"], F.col(text)).otherwise(some)).select(*docs.columns)
