from corvane.llm.preference import END, format_preferences, formatted, op5_preference, sibling_replies

from .conftest import SF

SCHEMA = "pair_id long, side string, turn long, role string, text string"


def brute(rows):
    out, key = {}, lambda r: (r[2] is None, r[2] or 0, r[3] or "unknown", r[4] or "")
    for pair in {r[0] for r in rows if r[0] is not None}:
        c, r = ([(x[3] or "unknown", x[4] or "") for x in sorted((x for x in rows if x[0] == pair and x[1] == side), key=key)] for side in ("chosen", "rejected"))
        if c and r:
            n = next((i for i, (a, b) in enumerate(zip(c, r, strict=False)) if a != b), min(len(c), len(r)))
            show = lambda turns: "".join(f"<|{role}|>\n{text}{END}\n" for role, text in turns)
            spans = []
            for turns in (c[n:], r[n:]):
                at, own = 0, []
                for role, text in turns:
                    begin = at + len(role) + 5
                    at = begin + len(text) + len(END) + 1
                    own += [[begin, at - 1]] if role == "assistant" else []
                spans.append(own)
            out[pair] = (n, show(c[:n]), show(c[n:]), show(r[n:]), *spans)
    return out


def rows(df):
    return {r.pair_id: tuple(r)[1:] for r in df.collect()}


def test_pairs_against_brute_force(spark):
    turns = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes ü中"), (1, "chosen", 2, "user", "more"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "no"),
        (2, "chosen", 0, "user", "a"), (2, "rejected", 0, "user", "a"), (2, "rejected", 1, "assistant", "b"),
        (3, "chosen", 0, None, None), (3, "chosen", None, "assistant", ""), (3, "rejected", 0, "unknown", ""), (3, "rejected", 0, "unknown", ""),
        (4, "chosen", 0, "user", "alone"), (None, "chosen", 0, "user", "x"), (5, "other", 0, "user", "x"), (6, "chosen", 1, "user", "t"), (6, "chosen", 1, "assistant", "t"), (6, "rejected", 0, "user", "q"),
    ]
    df = spark.createDataFrame(turns, SCHEMA)
    assert rows(format_preferences(df)) == brute(turns)
    clash = df.selectExpr("*", "'j' as c", "'j' as r", "'j' as p", "'j' as n_prompt", "'j' as prompt")
    assert rows(format_preferences(clash)) == brute(turns)
    assert rows(format_preferences(df.limit(0))) == {}


def test_masks_cover_what_the_assistant_says(spark):
    pairs = formatted(sibling_replies(spark.read.parquet(f"{SF}/conversations.parquet"))).collect()
    assert pairs
    for r in pairs:
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            assert text.count("<|assistant|>") == len(mask)
            assert all(text[:a].endswith("<|assistant|>\n") and text[a:b].endswith(END) for a, b in mask)


def test_native_plan(spark):
    plan = op5_preference(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    physical = op5_preference(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange") == 1 and "Join" not in physical


def test_odd_conversations(spark):
    turns = spark.createDataFrame([(0, 0, "user", "a"), (0, 1, "assistant", None), (1, 0, "assistant", "z"), (2, 0, "assistant", "x"), (None, 0, "assistant", "n"), (4, None, "assistant", "x"), (5, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    # 1's chosen side and its rejected side (the sibling's empty reply) are both there; 2, 4 and 5 have no sibling with a reply
    assert set(rows(formatted(sibling_replies(turns)))) == {0, 1}
