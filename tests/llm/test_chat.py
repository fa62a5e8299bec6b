from cadenza.llm import chat


def turn(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def test_prefix_masks_and_edge_rows(spark):
    rows = [
        (1, "chosen", 0, "user", "Hi"), (1, "chosen", 1, "assistant", "Hello"), (1, "chosen", 2, "user", "é?"), (1, "chosen", 3, "assistant", "Yes"),
        (1, "rejected", 0, "user", "Hi"), (1, "rejected", 1, "assistant", "Hello"), (1, "rejected", 2, "user", "é?"), (1, "rejected", 3, "assistant", "No <|im_end|>"),
        (2, "chosen", 0, None, None), (2, "rejected", 0, "user", ""), (2, "rejected", None, "assistant", "late"), (2, "rejected", 5, "assistant", "b"),
        (3, "chosen", 0, "user", "a"), (3, "rejected", 0, "user", "a"), (4, "rejected", 0, "assistant", "x"), (None, "chosen", 0, "user", "lost"),
        (5, "chosen", 0, "user", "t"), (5, "chosen", 0, "user", "t"), (5, "rejected", 0, "user", "t"),
    ]
    got = {r.pair_id: r for r in chat.preferences(spark.createDataFrame(rows, "pair_id long, side string, turn int, role string, text string")).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    r = got[1]
    assert (r.n_prompt_turns, r.prompt) == (3, turn("user", "Hi") + turn("assistant", "Hello") + turn("user", "é?"))
    assert (r.chosen, r.rejected) == (turn("assistant", "Yes"), turn("assistant", "No < |im_end|>"))
    a, b = map(int, r.chosen_mask.split(":"))
    assert r.chosen[a:b] == "Yes<|im_end|>\n"
    r = got[2]
    assert (r.n_prompt_turns, r.prompt, r.chosen, r.chosen_mask) == (1, turn("user", ""), "", "")
    assert r.rejected == turn("assistant", "b") + turn("assistant", "late")
    assert [r.rejected[int(x) : int(y)] for x, y in (s.split(":") for s in r.rejected_mask.split(","))] == ["b<|im_end|>\n", "late<|im_end|>\n"]
    assert (got[3].n_prompt_turns, got[3].chosen, got[3].rejected, got[3].paired) == (1, "", "", True)
    assert (got[4].paired, got[4].prompt, got[4].rejected) == (False, "", turn("assistant", "x"))
    assert (got[5].n_prompt_turns, got[5].chosen) == (1, turn("user", "t"))


def test_swapped_answers_share_the_turns_before(spark):
    rows = [
        (10, 0, "user", "Hi"), (10, 1, "assistant", "Hello"), (10, 2, "user", "Bye"), (10, 3, "assistant", "Ciao"),
        (11, 0, "user", "q"), (11, 1, "assistant", "one"), (11, 2, "user", "w"), (11, 3, "assistant", "two"), (11, None, "user", "late"),
        (13, 0, "user", "alone"), (13, 1, "assistant", "x" * 300_000), (14, 0, "user", "no answer"), (None, 0, "user", "lost"), (16, 0, None, None), (16, 1, "assistant", None),
    ]
    turns = spark.createDataFrame([(*r, "e", 1) for r in rows], "conv_id long, turn int, role string, text string, side string, pair_id int")
    got = {r.pair_id: r for r in chat.preferences(chat.swapped(turns)).collect()}
    assert set(got) == {10, 11, 13, 14, 16}
    r = got[10]  # divisible by 5: cut at the first answer
    assert (r.n_prompt_turns, r.chosen, r.rejected) == (1, turn("assistant", "Hello") + turn("user", "Bye") + turn("assistant", "Ciao"), turn("assistant", "two"))
    r = got[11]
    assert (r.n_prompt_turns, r.chosen, r.rejected) == (3, turn("assistant", "two") + turn("user", "late"), turn("assistant", "Ciao") + turn("user", "late"))
    assert (got[13].n_prompt_turns, got[13].rejected) == (1, turn("assistant", "")) and len(got[13].chosen) > 300_000
    assert (got[14].n_prompt_turns, got[14].chosen, got[14].rejected) == (1, "", "")
    assert got[16].n_prompt_turns == 2


def test_most_pairs_of_the_table_have_a_prompt_and_masks(spark):
    rows = chat.query(spark, "/root/testdata/sf0.01").collect()
    good = [r for r in rows if r.n_prompt_turns and r.chosen_mask and r.rejected_mask]
    assert len(rows) == 100 and len(good) > 90


def test_empty_table(spark):
    assert chat.swapped(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).collect() == []
    assert chat.preferences(spark.createDataFrame([], "pair_id long, side string, turn int, role string, text string")).collect() == []
