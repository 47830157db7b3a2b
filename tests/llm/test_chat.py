from graphloom.llm import chat

SCHEMA = "pair_id int, chosen boolean, conv_id int, turn int, role string, text string, extra int"


def test_prompt_completions_and_masks(spark):
    rows = [(0, True, 10, 0, "user", "q", 1), (0, True, 10, 1, "assistant", "yes", 1), (0, False, 11, 0, "user", "q", 1), (0, False, 11, 1, "assistant", "no", 1), (0, False, 11, 2, None, None, 1),
            (1, True, 20, 0, "user", "same", 1), (1, False, 21, 0, "user", "same", 1), (2, True, 30, 1, "user", "b", 1), (2, True, 30, 1, "user", "a", 1), (2, True, 30, 1, "user", "a", 1)]
    got = {r.pair_id: r for r in chat.preference_pairs(spark.createDataFrame(rows, SCHEMA)).collect()}
    a = got[0]
    assert (a.prompt, a.prompt_turns) == ("<|user|>\nq<|end|>\n", 1)
    assert a.chosen == "<|assistant|>\nyes<|end|>\n" and a.rejected == "<|assistant|>\nno<|end|>\n<|unknown|>\n<|end|>\n"
    start, end = map(int, a.chosen_mask.split(":"))
    assert a.chosen[start:end] == "yes<|end|>\n"
    start, end = map(int, a.rejected_mask.split(":"))
    assert a.rejected[start:end] == "no<|end|>\n"
    assert (got[1].chosen, got[1].rejected, got[1].chosen_mask) == ("", "", "")
    assert got[2].rejected is None and got[2].chosen.count("<|user|>\na") == 2 and got[2].prompt == ""
    assert chat.preference_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
