import json
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T


def values(spark, f, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in df.select("i", f("t").alias("v")).orderBy("i").collect()]


def test_noise_lines(spark):
    noise = ["123", "----", "- 1 -", "第 1 页", "Page 1", "1/100", "共 5 页", "abc", "", "  ", "2020年1月2日", "(1)", "— 3 —", "内部资料 请勿外传", None]
    kept = ["第一条 为了", "（一）定义", "1. 定义", "总则", "第三款 说明", "abcd"]
    assert values(spark, T.is_noise, noise) == [True] * len(noise)
    assert values(spark, T.is_noise, kept) == [False] * len(kept)


def test_spaces_and_lines(spark):
    assert values(spark, T.normalize_spaces, ["a　 \t  \r\nb", None, "x\ry"]) == ["a \nb", "", "x\ny"]
    broken = ["本法所称行政许可，\n是指行政机关根据申请，", "甲乙\n丙丁\n戊己。\n庚", "甲\n第一条 乙", "甲\n\n乙", "abc\ndef", ""]
    assert values(spark, T.merge_broken_lines, broken) == ["本法所称行政许可，是指行政机关根据申请，", "甲乙丙丁戊己。\n庚", "甲\n第一条 乙", "甲\n\n乙", "abc\ndef", ""]
    assert values(spark, T.clean_text, ["第一条 甲，\n乙\n123\n\n\n\n丙。\n", None]) == ["第一条 甲，乙\n\n丙。", ""]


def test_levels_and_numbers(spark):
    lines = ["第一编 总", "第二章 分", " 第三节 x", "第十条 y", "第一款", "（一）z", "二、w", "3. v", "4) u", "文", "", "根据第十条规定"]
    assert values(spark, T.level, lines) == ["编", "章", "节", "条", "款", "项", "项", "项", "目", None, None, None]
    assert values(spark, lambda c: T.numbered(c, "条", True), lines)[-1] == "第十条"
    assert values(spark, lambda c: T.numbered(c, "条"), lines)[-1] is None
    text = "将第四条、第八条修改，删去第十四条；第四条 至 第六条，第二十四条至第二十七条"
    assert values(spark, T.references, [text]) == [["第四条", "第八条", "第十四条", "第四条至第六条", "第二十四条至第二十七条"]]
    ranges = spark.createDataFrame([([],), (["第一条"],), (["第一条", "第二条", "第三条", "第三条"],)], "a array<string>").select(T.article_range(F.col("a"))).collect()
    assert [r[0] for r in ranges] == [None, "第一条", "第一条-第三条"]


def test_token_estimates_and_truncation(spark):
    assert values(spark, T.tokens_by_bytes, ["", "abcd", "合同", None]) == [0, 2, 3, 0]
    assert values(spark, T.tokens_by_chars, ["", "a", "a" * 7, None]) == [0, 1, 10, 0]
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("ab合同。；\n .") for _ in range(rng.randint(0, 400)))
        for budget in (0, 1, 5, 29, 30, 31, 60, 200):
            cut = T.truncated(text, budget)
            assert T.count_by_bytes(cut) <= budget
            assert cut == text or T.count_by_bytes(text) > budget
    assert T.truncated("一" * 100, 60).endswith(T.TRUNCATED)


def test_long_blocks():
    text = "甲" * 60 + "。" + "乙" * 60 + "；" + "丙" * 90
    parts = T.pieces(text, 100)
    assert "".join(parts) == text and all(len(p) <= 70 for p in parts)
    assert parts[0].endswith("。") and T.pieces("短", 100) == ["短"]


def test_display(spark):
    shown = values(spark, T.display_text, ["a_b [c] <d>", "C:\\x\\y z", "see /home/u/f.txt", "x" * 400, None, "a\x00\tb"])
    assert shown[0] == "a\\_b \\[c\\] &lt;d&gt;" and shown[1].startswith("\\[已隐藏路径\\]") and "/home" not in shown[2]
    assert len(shown[3]) == 300 and shown[4] == "" and shown[5] == "a b"
    redacted = values(spark, T.redact, ["api_key=abc, x", "Authorization: Bearer q", "at /root/a b", "fine"])
    assert redacted == ["api_key=***, x", "Authorization: ***", "at <path> b", "fine"]


def test_odd_values(spark):
    for f in (T.strip, T.is_noise, T.level, T.references, T.tidy, T.format_bytes, T.garbled_share, T.one_line):
        values(spark, f, [None, ""] if f is not T.format_bytes else [None, "5"])


@pytest.mark.parametrize(("size", "shown"), [("512", "512.00 B"), ("2048", "2.00 KB"), ("5368709120", "5.00 GB")])
def test_bytes(spark, size, shown):
    assert values(spark, T.format_bytes, [size]) == [shown]


def test_evidence_holds_whole_texts(spark, tmp_path):
    from corvane.queries import QUERIES

    texts = ["short", "", "x" * 100 + 'after "quotes"\\ \n\r\t\x01\x0b\x1f\x7f\u2028 中文 😀', "line\n" * 5_000]
    rows = [(i, t, "a", "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["x12_evidence_json_whole"](spark, str(tmp_path)).collect()
    assert {r.doc_id: json.loads(r.evidence) for r in got} == {i: {"evidence_no": i, "title": "a", "location": "en", "content": t} for i, t, *_ in rows}


def test_few_values_of_a_batch_are_pythons_at_once(spark, monkeypatch):
    monkeypatch.setattr(T, "TOGETHER", 3)
    rows = spark.range(0, 100, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("t"))
    got = rows.select("id", T.mapped("t", lambda t: t + "!").alias("a"), T.mapped("t", lambda t: [t, t], "array<string>").alias("b")).collect()
    assert {(r.id, r.a, tuple(r.b or [])) for r in got} == {(i, f"{i}!" if i % 7 else None, (str(i),) * 2 if i % 7 else ()) for i in range(100)}


def test_lines_are_stripped_once(spark):
    from corvane.retrieval_queries import f6

    plan = f6(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1  # not again for each rule of a filter above the split


def test_strip_takes_all_white_space_and_looks_at_the_ends_alone(spark):
    white = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [None, "", "​ a​", "\x1ba\x1b", "  a \n b  ", *white, *(f"{w}{w}a{w}b　{w}" for w in white)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.strip("t").alias("s"), F.regexp_replace("t", f"^{T.WS}+|{T.WS}+$", "").alias("r"))
    got = df.collect()
    assert [(r.s, r.r) for r in got] == [(t if t is None else t.strip(),) * 2 for t in texts]
    assert "regexp_replace" not in df.select("s")._jdf.queryExecution().executedPlan().toString()
