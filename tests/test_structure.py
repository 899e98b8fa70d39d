import random

import pytest

from corvane.functions import text as T
from corvane.operators import chunking, structure

LEVELS = ["编", "章", "节", "条", None]


def procedural(blocks):
    """The rule as a loop, for comparison: path of headings and the last article."""
    path, article, out = [], None, []
    for text, level in blocks:
        if level == "编":
            path, article = [text], None
        elif level == "章":
            path, article = [p for p in path if "章" not in p and "节" not in p] + [text], None
        elif level == "节":
            path, article = [p for p in path if "节" not in p] + [text], None
        elif level == "条":
            article = text.split(" ")[0]
        out.append((" / ".join(path) or None, article))
    return out


def test_section_paths_against_the_rule(spark):
    rng, rows, expected = random.Random(2), [], {}
    for doc in range(40):
        blocks = []
        for _ in range(rng.randint(1, 25)):
            level = rng.choice(LEVELS)
            text = f"第{rng.choice('一二三')}{level} {rng.choice(['甲', '节约', '章程', '乙'])}" if level else rng.choice(["文", "节约用水", "章"])
            blocks.append((text, level))
        rows += [(doc, i, t) for i, (t, _) in enumerate(blocks)]
        expected |= {(doc, i): x for i, x in enumerate(procedural(blocks))}
    got = structure.section_paths(spark.createDataFrame(rows, "doc_id int, block_index int, text string")).collect()
    assert {(r.doc_id, r.block_index): (r.section_path, r.article_no) for r in got} == expected


def test_blocks_of_several_articles(spark):
    rows = [(1, 0, "前言\n第十四条 甲\n续\n第十五条 乙\n第十六条 丙"), (1, 1, "第一条 根据第十条规定"), (1, 2, None), (1, 3, "第一条 a\n第二条 b")]
    got = structure.split_articles(spark.createDataFrame(rows, "doc_id int, block_index int, text string")).collect()
    assert {(r.block_index, r.text, r.part) for r in got} == {
        (0, "前言", 0), (1, "第十四条 甲\n续", 1), (2, "第十五条 乙", 2), (3, "第十六条 丙", 3),
        (1, "第一条 根据第十条规定", None), (2, None, None), (3000, "第一条 a", 0), (3001, "第二条 b", 1),
    }


def test_contents_are_dropped(spark):
    rows = [(1, i, t, l) for i, (t, l) in enumerate([("a", "章"), ("b", "章"), ("c", None), ("d", "编"), ("e", "章"), ("f", "节"), ("g", "条"), ("h", "节"), ("i", "节")])]
    got = structure.drop_heading_runs(spark.createDataFrame(rows, "doc_id int, block_index int, text string, law_level string")).orderBy("block_index").collect()
    assert "".join(r.text for r in got) == "cdefg"


def chunks(spark, blocks, **how):
    rows = [("d", i, *b) for i, b in enumerate(blocks)]
    df = spark.createDataFrame(rows, "doc_id string, block_index int, text string, law_level string, section_path string, article_no string")
    return chunking.build_chunks(df, **how).orderBy("chunk_index").collect()


def test_chunks_begin_at_headings_and_full_articles(spark):
    blocks = [("第一章", "章", "第一章", None), ("第一条 " + "甲" * 60, "条", "第一章", "第一条"), ("第二条 " + "乙" * 60, "条", "第一章", "第二条"), ("第二章", "章", "第二章", None), ("第三条 丙", "条", "第二章", "第三条")]
    got = chunks(spark, blocks, target=150, most=300)
    assert [(r.paragraph_start, r.paragraph_end, r.article_range) for r in got] == [(0, 1, "第一条"), (2, 2, "第二条"), (3, 4, "第三条")]
    assert got[0].chunk_text == blocks[0][0] + "\n\n" + blocks[1][0] and got[1].section_path == "第一章"


def test_long_block_is_cut_and_loses_nothing(spark):
    long = "。".join("字" * 40 for _ in range(40))
    got = chunks(spark, [("第一章", "章", "第一章", None), (long, None, "第一章", None), ("后文", None, "第一章", None)], target=100, most=200)
    assert all(r.token_count <= 201 for r in got) and got[-1].chunk_text == "后文"
    assert "".join(r.chunk_text for r in got).replace("\n", "") == "第一章" + long + "后文"
    assert got[0].chunk_text.startswith("第一章\n\n字")


def test_references_stand_in_for_articles(spark):
    got = chunks(spark, [("将第四条修改，删去第六条至第八条", None, None, None)])
    assert got[0].article_range == "第四条、第六条至第八条"


@pytest.mark.parametrize("n", [0, 1])
def test_empty(spark, n):
    assert chunks(spark, [("", None, None, None)] * n) == []


def test_token_rule():
    assert [chunking.tokens(t) for t in ("", "a", "a" * 7)] == [0, 1, 10] and T.CHARS_PER_TOKEN == 0.7
