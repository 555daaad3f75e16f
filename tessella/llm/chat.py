"""Chat formatting in budgeted windows, with DataFrame functions only.

Running sums of turn tokens over a conversation place each turn on a line; the line is cut every ``step`` tokens, where step
is what the budget leaves beside the system turn and the repeated history. Turns inside one piece share a window, a turn
that straddles a cut has a window of its own, so windows are turn-aligned and only the window of a turn longer than step can
exceed the budget. A window starts with the conversation's first system turn, then the last turns before it while they fit
into ``history`` tokens; these repeated turns are masked, so each assistant turn is a target once.

A system turn of over a quarter of the budget stays whole in the window where it stands, one of its own if it is long; the
other windows repeat its head only, at most that quarter, marked by ``MORE``. So the budget holds, and the output is within a
fixed multiple of the input, however long the system turn.

A turn's tokens are its white-space-separated words, or its code points over ``TOKEN_CHARS`` if these are more (text without
spaces), and ``OVERHEAD`` for its marks. A turn is written

    <s>role\\n[INST]text[/INST]</s>        and, for assistant turns,        <s>role\\ntext</s>

In role and text, a backslash becomes \\0, the four control strings get \\1 after their first character, and a line feed in a
role becomes \\2; ``unescape`` undoes this, so any text survives.

Rows are dealt by conversation, and a task orders a conversation's rows, spilling to disk where needed. Conversations of over
``HOT_TURNS`` turns (all rows of a null conv_id may be one) are numbered by slices instead: ranges of turns are written, running
sums are made inside a slice and shifted by the slices' totals, and turns meet the windows that repeat them by stretches of the
line. The windows are the same. A row of the result holds one window, at most budget / OVERHEAD turns, never a conversation.
``digests`` alone gathers a conversation in a row, as its digests are of whole conversations; these may have up to 2 GB.

Defined cases: null texts and roles are empty; turns sort by turn (null first), role and text, and repeated rows are turns of
their own; rows of a null conv_id form one conversation; an empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BUDGET, HISTORY = 512, 128
OVERHEAD = 4
#: Code points that count as a token where a text has few words, and what ends the head of a longer system turn.
TOKEN_CHARS = 8
MORE = " [...]"
#: Turns above which a conversation is numbered by slices, turns of a slice, and such conversations up to which their
#: identifiers, some 20 MB, are sent to every task.
HOT_TURNS, SLICE_TURNS = 1 << 17, 1 << 15
BROADCAST_ROWS = 200_000
_SPACE = r"[\x20\x09-\x0D]+"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\0"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\1" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\2"), F.lit("\n")), F.lit("\\1"), F.lit("")), F.lit("\\0"), F.lit("\\"))


def tokens_of(text: Column) -> Column:
    words = F.size(F.filter(F.split(text, _SPACE), lambda x: x != ""))
    return F.greatest(words, F.ceil(F.length(text) / TOKEN_CHARS)).cast("long") + OVERHEAD


def head_of(text: Column, tokens: int) -> Column:
    """The first words of a text, of at most so many tokens with OVERHEAD and MORE."""
    most = max(0, tokens - OVERHEAD - 1)
    words = F.filter(F.split(F.substring(text, 1, TOKEN_CHARS * most), _SPACE), lambda x: x != "")
    return F.concat(F.array_join(F.slice(words, 1, most), " "), F.lit(MORE))


def _first_system(n: Column, budget: int) -> Column:
    """Of a system turn, what every window keeps of it: whole, or its head; rows carry no more of it than that."""
    most = budget // 4
    shown = F.when(F.col("tokens") <= most, F.col("text")).otherwise(head_of(F.col("text"), most))
    return F.when(F.col("role") == "system", F.struct(n.alias("n"), F.least("tokens", F.lit(most)).alias("tokens"), "role", shown.alias("text")))


def _span(budget: int, history: int) -> Column:
    """Number of the stretch of the line that a turn falls into: even for the pieces, odd for what straddles a cut."""
    step = F.greatest(F.lit(1), F.lit(budget - history) - F.coalesce(F.col("system.tokens"), F.lit(0)))
    piece, last = F.floor((F.col("end") - F.col("tokens")) / step), F.floor((F.col("end") - 1) / step)
    return (2 * piece + F.when(piece == last, 0).otherwise(1)).cast("long")


def _number(t: DataFrame, budget: int, history: int) -> tuple[DataFrame, DataFrame]:
    """Turns with n, end, system and window, and the repeated ones (conv_id, window, n, role, text, tokens); a task sees a whole conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = Window.partitionBy("conv_id")
    t = t.withColumn("n", F.row_number().over(order).cast("long")).withColumn("end", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("system", F.min(_first_system(F.col("n"), budget)).over(whole)).withColumn("span", _span(budget, history))
    # spans that hold turns are numbered from 0
    t = t.withColumn("window", (F.dense_rank().over(Window.partitionBy("conv_id").orderBy("span")) - 1).cast("long"))
    start = F.col("end") - F.col("tokens")
    t = t.withColumn("window_start", F.min(start).over(Window.partitionBy("conv_id", "window")))
    # turns that begin within `history` tokens before a later window's start are repeated in it; at most history / OVERHEAD turns ahead can tell
    later = Window.partitionBy("conv_id").orderBy("n").rowsBetween(1, max(1, history // OVERHEAD))
    reach = F.array_sort(F.array_distinct(F.collect_list(F.struct("window", "window_start")).over(later)))
    past = t.select("conv_id", "n", "role", "text", "tokens", start.alias("start"), F.col("window").alias("of"), F.col("system.n").alias("system_n"), reach.alias("reach"))
    past = past.where(~F.col("n").eqNullSafe(F.col("system_n"))).withColumn("to", F.explode(F.filter("reach", lambda x: (x["window"] > F.col("of")) & (x["window_start"] - F.col("start") <= history))))
    return t, past.select("conv_id", F.col("to.window").alias("window"), "n", "role", "text", "tokens")


def _beside(t: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Adds other's columns by conv_id, null or not, and keys."""
    other = other.select(F.col("conv_id").alias("__conv"), *[F.col(k).alias(f"__{k}") for k in keys], *[c for c in other.columns if c not in ("conv_id", *keys)])
    on = [t["conv_id"].eqNullSafe(other["__conv"]), *[t[k] == other[f"__{k}"] for k in keys]]
    return t.join(other, on).drop("__conv", *[f"__{k}" for k in keys])


def _number_by_slices(t: DataFrame, turns: int, budget: int, history: int, slice_turns: int) -> tuple[DataFrame, DataFrame]:
    """As _number, for conversations that one task shouldn't order: ranges of turns (slices) are written, sums and numbers are
    made inside a slice and shifted by those of the slices before it."""
    # ranges by a head of the text, which sorts as the text does, so the ranges' bounds stay short
    ranged = t.repartitionByRange(max(1, -(-turns // slice_turns)), "conv_id", "turn", "role", F.substring("text", 1, 64))
    ranged = cut(ranged.withColumn("slice", F.spark_partition_id()), "chat-slices")
    inside = Window.partitionBy("conv_id", "slice").orderBy("turn", "role", "text")
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    t = ranged.withColumn("n", F.row_number().over(inside).cast("long")).withColumn("end", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # a row for a slice and conversation
    sums = t.groupBy("conv_id", "slice").agg(F.count("*").alias("k"), F.sum("tokens").alias("sum"), F.min(_first_system(F.col("n"), budget)).alias("first"))
    sums = sums.withColumn("n_before", F.coalesce(F.sum("k").over(before), F.lit(0))).withColumn("end_before", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    system = F.min(F.when(F.col("first").isNotNull(), F.col("first").withField("n", F.col("first.n") + F.col("n_before")))).over(whole)
    sums = cut(sums.select("conv_id", "slice", "n_before", "end_before", system.alias("system")), "chat-sums")
    t = _beside(t, sums, "slice").withColumn("n", F.col("n") + F.col("n_before")).withColumn("end", F.col("end") + F.col("end_before")).drop("n_before", "end_before")
    t = t.withColumn("span", _span(budget, history)).withColumn("rank", F.dense_rank().over(Window.partitionBy("conv_id", "slice").orderBy("span")).cast("long"))
    # spans never fall as turns go on, so only a slice's first one can be shared with the slice before
    ranks = t.groupBy("conv_id", "slice").agg(F.max("rank").alias("k"), F.min("span").alias("low"), F.max("span").alias("high"))
    shared = F.when(F.col("low") == F.lag("high").over(Window.partitionBy("conv_id").orderBy("slice")), 1).otherwise(0)
    ranks = ranks.withColumn("shared", shared)
    ranks = cut(ranks.select("conv_id", "slice", (F.coalesce(F.sum(F.col("k") - F.col("shared")).over(before), F.lit(0)) - F.col("shared")).alias("rank_before")), "chat-ranks")
    t = _beside(t, ranks, "slice").withColumn("window", F.col("rank") + F.col("rank_before") - 1)
    t = t.select("conv_id", "n", "role", "text", "tokens", "end", "system", "window")
    if history <= 0:
        return t, t.where("false").select("conv_id", "window", "n", "role", "text", "tokens")
    # a turn reaches the windows that start in its own stretch of `history` tokens or in the next; turns of more tokens reach none
    start = F.col("end") - F.col("tokens")
    starts = t.groupBy("conv_id", "window").agg(F.min(start).alias("window_start")).withColumnRenamed("window", "to")
    at = F.floor(F.col("window_start") / history)
    starts = starts.withColumn("stretch", F.explode(F.array(at - 1, at)))
    short = t.where((F.col("tokens") <= history) & ~F.col("n").eqNullSafe(F.col("system.n"))).withColumn("start", start).withColumn("stretch", F.floor(start / history))
    past = _beside(short, starts, "stretch").where((F.col("to") > F.col("window")) & (F.col("window_start") - F.col("start") <= history))
    return t, past.select("conv_id", F.col("to").alias("window"), "n", "role", "text", "tokens")


def windows(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    hot_turns: int = HOT_TURNS, slice_turns: int = SLICE_TURNS,
) -> DataFrame:
    """One row a window: conv_id, window, first_turn (number of its first new turn), repeated (turns at its start that are
    repeated), text, tokens, loss (spans of code points, start from 0 and length, of its target texts)."""
    t = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    hot = cut(t.groupBy("conv_id").count().where(F.col("count") > hot_turns), "chat-hot")
    found, turns = hot.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    t = t.withColumn("tokens", tokens_of(F.col("text")))
    if not found:
        return _format(*_number(t, budget, history))
    long_ones = hot.select(F.col("conv_id").alias("__hot"))
    if found <= BROADCAST_ROWS:
        long_ones = F.broadcast(long_ones)
    is_hot = F.col("conv_id").eqNullSafe(F.col("__hot"))
    rest, parts = t.join(long_ones, is_hot, "left_anti"), t.join(long_ones, is_hot, "left_semi")
    return _format(*_number(rest, budget, history)).unionByName(_format(*_number_by_slices(parts, turns, budget, history, slice_turns)))


def _format(t: DataFrame, past: DataFrame) -> DataFrame:
    """Windows written out, from numbered turns and those to repeat."""
    own = t.select("conv_id", "window", "n", "role", "text", "tokens", F.lit(False).alias("repeat"))
    past = past.withColumn("repeat", F.lit(True))
    heads = t.where("system is not null").groupBy("conv_id", "window").agg(F.first("system").alias("system"), F.min("n").alias("from"), F.max("n").alias("upto"))
    heads = heads.where("system.n < from or system.n > upto").select("conv_id", "window", F.lit(0).cast("long").alias("n"), "system.role", "system.text", "system.tokens", F.lit(True).alias("repeat"))
    rows = own.unionByName(past).unionByName(heads)
    is_target = (F.col("role") == "assistant") & ~F.col("repeat")
    body = escape(F.col("text"))
    head = F.concat(F.lit("<s>"), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\2")), F.lit("\n"))
    plain = F.col("role") == "assistant"
    written = F.concat(head, F.when(plain, body).otherwise(F.concat(F.lit("[INST]"), body, F.lit("[/INST]"))), F.lit("</s>"))
    rows = rows.select("conv_id", "window", "n", "repeat", "tokens", written.alias("written"), F.when(is_target, F.length(head)).alias("at"), F.when(is_target, F.length(body)).alias("long"))
    made = rows.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(F.struct("n", "written", "at", "long", "repeat", "tokens"))).alias("turns"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"))
    loss = F.aggregate(
        "turns", zero,
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["written"])).alias("at"),
            F.when(x["at"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["at"]).alias("start"), x["long"].alias("length"))))).alias("spans"),
        ),
    )["spans"]
    fresh = F.filter("turns", lambda x: ~x["repeat"])
    return made.select(
        "conv_id", "window", F.element_at(fresh, 1)["n"].alias("first_turn"), (F.size("turns") - F.size(fresh)).alias("repeated"),
        F.array_join(F.transform("turns", lambda x: x["written"]), "").alias("text"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens"), loss.alias("loss"),
    )


def read_windows(made: DataFrame) -> DataFrame:
    """The turns in each window's text, taken apart again: conv_id, window, turns (array of role, text; repeated ones left out), targets (unescaped texts under the mask)."""
    raw = F.slice(F.split("text", "</s>", -1), F.col("repeated") + 1, F.size(F.split("text", "</s>", -1)) - 1 - F.col("repeated"))

    def parse(x: Column) -> Column:
        cut = F.locate("\n", x)
        inner = F.substr(x, cut + 1)
        held = F.startswith(inner, F.lit("[INST]"))
        inner = F.when(held, F.substr(inner, F.lit(7), F.length(inner) - 13)).otherwise(inner)
        return F.struct(unescape(F.substr(x, F.lit(4), cut - 4)).alias("role"), unescape(inner).alias("text"))

    return made.select("conv_id", "window", F.length("text").alias("chars"), F.transform(raw, parse).alias("turns"), F.transform("loss", lambda s: unescape(F.substr("text", s["start"] + 1, s["length"]))).alias("targets"))


def digests(made: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows."""
    back = read_windows(made)
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = back.select("conv_id", "window", "chars", F.size("turns").alias("k"), joined.alias("said"), F.array_join("targets", "").alias("loss"))
    by = each.groupBy("conv_id").agg(F.sum("k").cast("long").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("w"), F.sum("chars").cast("long").alias("formatted_chars"), F.count("*").alias("n_windows"))
    said, loss = F.array_join(F.transform("w", lambda x: x["said"]), ""), F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return by.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_windows")
