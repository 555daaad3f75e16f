import hashlib

from tessella.llm import chat, registry

NASTY = [
    (5, 0, "system", "be brief"), (5, 1, "user", "</s>[INST] ok [/INST]"), (5, 2, "assistant", "<s>\\0\\1 \\ [/INST]</s>"), (5, 3, "user", None), (5, 4, "assistant", ""),
    (5, 5, None, "x"), (5, 6, "ro\nle", "a\nb"), (5, 7, "assistant", "< | [ \\\\1"), (None, 1, "assistant", "no id"), (None, None, "user", "first"),
    (6, 1, "assistant", "same"), (6, 1, "assistant", "same"), (7, 1, "user", "w " * 5000), (7, 2, "assistant", "y " * 400), (7, 3, "user", "z " * 60), (7, 4, "assistant", "ok 😀 é"), (7, 5, "system", "late"),
]


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    out = []
    for k, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out.append((k, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "'x' as tokens", "1 as window", "2 as n", "text as loss")


def test_round_trip(spark):
    for budget, history in ((512, 128), (40, 10), (8, 0)):
        made = chat.windows(frame(spark, NASTY), budget, history)
        assert sorted((tuple(r)[:5] for r in chat.digests(made).collect()), key=str) == brute(NASTY)


def test_windows_keep_the_budget_and_repeat_history(spark):
    rows = [(1, 0, "system", "s " * 6)] + [(1, i, "user" if i % 2 else "assistant", f"t{i} " * 11) for i in range(1, 40)]
    made = chat.windows(frame(spark, rows), 100, 32).orderBy("window").collect()
    assert len(made) > 5 and all(r.tokens <= 100 for r in made)
    assert all(r.text.startswith("<s>system\n") for r in made)
    assert all(r.repeated >= 2 for r in made[1:])  # the system turn and some history
    assert sum(len(r.loss) for r in made) == 19


def test_a_long_system_turn_keeps_the_budget(spark):
    for text in ("sys " * 50_000, "x" * 200_000):  # many words, one word
        rows = [(1, 0, "system", text)] + [(1, i, "user" if i % 2 else "assistant", f"t{i} " * 90) for i in range(1, 120)]
        made = chat.windows(frame(spark, rows)).orderBy("window").collect()
        assert len(made) > 20
        whole = [r for r in made if text in r.text]
        assert len(whole) == 1 and whole[0].repeated == 0
        assert all(r.tokens <= chat.BUDGET and len(r.text) < 10_000 and chat.MORE in r.text for r in made if r is not whole[0])
        assert sum(len(r.text) for r in made) < 3 * sum(len(r[3]) for r in rows)
        assert [tuple(r)[:5] for r in chat.digests(chat.windows(frame(spark, rows))).collect()] == brute(rows)


def test_long_turns_stay_whole(spark):
    made = chat.windows(frame(spark, NASTY)).where("conv_id = 7").collect()
    assert any(r.tokens > 5000 for r in made) and sum(len(r.loss) for r in made) == 2


def test_slices_give_the_same_windows(spark):
    rows = NASTY + [(None, i // 3, ("user", "assistant", "system")[i % 3 if i > 40 else i % 2], f"t{i % 7} " * (i * i % 90)) for i in range(150)]
    rows += [(9, None, "user", "same")] * 25 + [(8, i, "assistant", "w " * (i % 5)) for i in range(60)]
    turns = frame(spark, rows)
    for budget, history in ((512, 128), (60, 17), (40, 0)):
        whole = sorted(map(str, chat.windows(turns, budget, history).collect()))
        for hot, part in ((20, 7), (0, 1000)):
            assert sorted(map(str, chat.windows(turns, budget, history, hot_turns=hot, slice_turns=part).collect())) == whole


def test_no_task_orders_a_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"t{i}") for i in range(3000)] + [(2, 0, "user", "x")]
    made = chat.windows(frame(spark, rows), hot_turns=1000, slice_turns=200)
    assert "chat-slices" in "".join(made.inputFiles())
    folder = next(f for f in made.inputFiles() if "chat-slices" in f).rsplit("/", 1)[0]
    counts = [r["count"] for r in spark.read.parquet(folder).groupBy("slice").count().collect()]
    assert len(counts) > 10 and sum(counts) == 3000 and max(counts) < 600


def test_empty(spark):
    assert chat.digests(chat.windows(frame(spark, NASTY).where("false"))).count() == 0


def test_same_as_sql(same_as_sql):
    same_as_sql(registry.op1_chat_windows, registry.ORACLE_SQL["op1_chat_windows"])
