from lakeloom.llm import chat


def test_pairs(spark):
    turns = "array<struct<role:string,text:string>>"
    u, a = lambda x: ("user", x), lambda x: ("assistant", x)
    pairs = spark.createDataFrame(
        [(1, [u("p"), a("q"), u("r"), a("s")], [u("p"), a("q"), u("r"), a("t"), u("!")]), (2, [u("p")], [a("p")]), (3, [u("p"), a("x")], [u("p")]), (4, [], [a("y")]), (5, [u("z")], [u("z")])],
        f"pair_id long, chosen {turns}, rejected {turns}",
    )
    got = {r.pair_id: r for r in chat.format_pairs(pairs).collect()}
    say = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert got[1].n_prompt_turns == 3 and got[1].prompt == say("user", "p") + say("assistant", "q") + say("user", "r")
    assert (got[1].chosen, got[1].rejected) == (say("assistant", "s"), say("assistant", "t") + say("user", "!"))
    assert (got[1].chosen_mask, got[1].rejected_mask) == ("1", "10") and [s.loss for s in got[1].rejected_segments] == [True, False]
    assert (got[2].n_prompt_turns, got[2].prompt, got[2].chosen_mask, got[2].rejected_mask) == (0, "", "0", "1")
    assert (got[3].chosen, got[3].rejected, got[3].prompt) == (say("assistant", "x"), "", say("user", "p"))
    assert (got[4].n_prompt_turns, got[4].rejected_mask) == (0, "1") and (got[5].n_prompt_turns, got[5].chosen) == (1, "")


def test_branching_and_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, 0, "user", None), (2, 1, None, "c"), (2, 2, "user", "d"), (None, 0, "user", "e")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, value string")
    got = {r.pair_id: (len(r.chosen), [t.text for t in r.rejected]) for r in chat.branched_pairs(df).collect()}
    assert got == {1: (2, ["a", "c", "d"]), 2: (3, ["", "b"])}
    assert chat.format_pairs(chat.branched_pairs(df.limit(0))).collect() == []


def test_following_over_many_partitions(spark):
    ids = [k * k * 37 for k in range(500)]  # sparse
    keys = spark.createDataFrame([(i,) for i in ids], "conv_id long").repartition(7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        for merged in ("true", "false"):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
            assert {r.conv_id: r.following for r in chat.following(keys).collect()} == dict(zip(ids, ids[1:] + ids[:1], strict=True))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert [tuple(r) for r in chat.following(keys.limit(1).selectExpr("7L AS conv_id")).collect()] == [(7, 7)]
