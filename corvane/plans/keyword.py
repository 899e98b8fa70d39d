"""From a table of questions to groups of prefix terms: a strict plan (all groups) and a relaxed one (any term) for each.

All of it is column work, so a plan is made for each row of a table of any size. A question is cleaned, its asking phrases
are taken off and it is cut into parts. Four lists of candidates follow: places, subjects, articles and identifiers. A list
keeps legal terms, each once; a later list leaves out what an earlier one has, and all have MOST_TERMS terms together.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.text import WS, mapped, strip

# ---- fixed values: word lists, patterns and limits define the plan ----
CJK = "㐀-䶿一-鿿豈-﫿"
ARTICLE = "第[〇一二三四五六七八九十百千万零两0-9]+条"
CONTROLS = r"[\x00-\x1f\x7f-\x9f]"
PUNCTUATION = r"[\"'“”‘’《》〈〉【】()（）\[\]{}:：;；,，。！？!?、/\\|]+"
SEPARATORS = "的|关于|如何|怎么|哪些|什么|是否|有无"
PREFIXES = ("麻烦问一下", "帮我查一下", "我想了解", "请问")
SUFFIXES = ("是怎么规定的", "有哪些规定", "请介绍一下", "如何规定", "怎么规定", "是什么", "有哪些", "吗", "呢")
SUBJECT_ENDS = ("条例", "办法", "规定", "规划", "计划", "标准", "细则", "通知", "意见", "决定", "措施", "制度", "责任", "处罚", "许可", "保护")
RESERVED = ("and", "or", "not", "near", "match")
REGIONS = {
    "北京": "北京市", "天津": "天津市", "上海": "上海市", "重庆": "重庆市", "河北": "河北省", "山西": "山西省", "辽宁": "辽宁省", "吉林": "吉林省", "黑龙江": "黑龙江省", "江苏": "江苏省",
    "浙江": "浙江省", "安徽": "安徽省", "福建": "福建省", "江西": "江西省", "山东": "山东省", "河南": "河南省", "湖北": "湖北省", "湖南": "湖南省", "广东": "广东省", "海南": "海南省",
    "四川": "四川省", "贵州": "贵州省", "云南": "云南省", "陕西": "陕西省", "甘肃": "甘肃省", "青海": "青海省", "台湾": "台湾省", "内蒙古": "内蒙古自治区", "广西": "广西壮族自治区",
    "宁夏": "宁夏回族自治区", "新疆": "新疆维吾尔自治区", "西藏": "西藏自治区", "香港": "香港特别行政区", "澳门": "澳门特别行政区",
}
PLACE = f"[{CJK}]{{2,12}}?(?:特别行政区|自治区|自治州|省|市|地区|盟|县|区)"
MOST_TERMS, MOST_LETTERS, MOST_EXPRESSION = 16, 64, 1024
# ---- end of fixed values ----

TERM = f"^(?:{ARTICLE}|[{CJK}]+|[A-Za-z0-9]+)$"


def every(pattern: str, c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), 0)


def legal(candidates: Column) -> Column:
    cut = F.transform(candidates, lambda t: F.substring(t, 1, MOST_LETTERS))
    return F.slice(F.array_distinct(F.filter(cut, lambda t: t.rlike(TERM) & ~F.lower(t).isin(*RESERVED))), 1, MOST_TERMS)


def cleaned(question: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(mapped(question, lambda t: unicodedata.normalize("NFKC", t)), CONTROLS, " "), PUNCTUATION, " ")
    asked = F.regexp_replace(strip(plain), f"^(?:{'|'.join(PREFIXES)}){WS}*", "")
    bare = F.regexp_replace(asked, f"(?:{WS}*(?:{'|'.join(SUFFIXES)}))+{WS}*$", "")
    return strip(F.regexp_replace(bare, f"{WS}+", " "))


def first_start(c: Column, starts: Column) -> Column:
    """The first of starts with which c begins, or nothing."""
    return F.coalesce(F.try_element_at(F.filter(starts, lambda s: c.startswith(s)), F.lit(1)), F.lit(""))


def without_start(c: Column, start: Column) -> Column:
    return F.substr(c, F.char_length(start) + 1)


def subject_terms(run: Column) -> Column:
    """The run and, wherever an ending of laws and rules is in it, the run up to its end and up to its begin."""

    def at(end: str) -> Column:
        pieces = F.split(run, end)
        before = lambda i: F.array_join(F.slice(pieces, F.lit(1), i), end)
        some = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(some, lambda i: F.array(F.concat(before(i), F.lit(end)), before(i))))

    return F.concat(F.array(run), *map(at, SUBJECT_ENDS))


def rendered(groups: Column) -> Column:
    """The expression, or null if there is none or it is too long."""
    one = F.transform(groups, lambda g: F.transform(g, lambda t: F.concat(F.lit('"'), t, F.lit('"*'))))
    text = F.array_join(F.transform(one, lambda g: F.when(F.size(g) == 1, g[0]).otherwise(F.concat(F.lit("("), F.array_join(g, " OR "), F.lit(")")))), " AND ")
    return F.when((text != "") & (F.char_length(text) <= MOST_EXPRESSION), text)


def with_plans(questions: DataFrame, question: str) -> DataFrame:
    """questions with groups (arrays of terms), strict, relaxed (null where it is the same) and n_terms.

    Null and blank questions, and those without a legal term, have no groups and no expressions. Texts of any length are
    read whole; the limits are those of the plan. Columns of questions by these names are replaced.
    """
    q = questions.select(F.struct("*").alias("row"), F.coalesce(cleaned(F.col(question)), F.lit("")).alias("text"))
    q = q.withColumn("parts", F.filter(F.transform(F.split("text", SEPARATORS), strip), lambda p: p != ""))
    scope, several = F.coalesce(F.try_element_at("parts", F.lit(1)), F.lit("")), F.size("parts") > 1
    q = q.withColumn("region", F.when(several, first_start(scope, F.array(*map(F.lit, REGIONS)))).otherwise(""))
    full = F.try_element_at(F.create_map(*[F.lit(x) for pair in REGIONS.items() for x in pair]), F.col("region"))
    city = F.when(several & without_start(scope, F.col("region")).rlike(f"^[{CJK}]{{2,4}}$"), F.concat(without_start(scope, F.col("region")), F.lit("市")))
    named = F.flatten(F.transform("parts", lambda p: every(PLACE, p)))
    q = q.withColumn("places", legal(F.concat(named, F.array_compact(F.array(full, city))))).withColumn("articles", legal(every(ARTICLE, F.col("text"))))
    runs = F.flatten(F.transform(F.when(several, F.slice("parts", F.lit(2), F.size("parts"))).otherwise(F.col("parts")), lambda p: every(f"[{CJK}]+", p)))
    bare = F.transform(runs, lambda r: F.aggregate("articles", without_start(r, first_start(r, F.col("places"))), lambda kept, a: F.replace(kept, a, F.lit(""))))
    q = q.withColumn("subjects", legal(F.flatten(F.transform(bare, subject_terms)))).withColumn("names", legal(every("[A-Za-z0-9]+", F.col("text"))))

    def add(done: Column, found: Column) -> Column:
        seen = F.flatten(done)
        return F.concat(done, F.array(F.slice(F.array_except(found, seen), F.lit(1), F.greatest(F.lit(MOST_TERMS) - F.size(seen), F.lit(0)))))

    groups = reduce(add, map(F.col, ("places", "subjects", "articles", "names")), F.array().cast("array<array<string>>"))
    q = q.select("row", F.filter(groups, lambda g: F.size(g) > 0).alias("groups"))
    q = q.withColumn("strict", rendered(F.col("groups"))).withColumn("relaxed", rendered(F.when(F.size("groups") > 0, F.array(F.flatten("groups"))).otherwise(F.col("groups"))))
    own = [c for c in questions.columns if c not in ("groups", "strict", "relaxed", "n_terms")]
    return q.select(*[F.col(f"row.`{c}`").alias(c) for c in own], "groups", "strict", F.when(~F.col("strict").eqNullSafe(F.col("relaxed")), F.col("relaxed")).alias("relaxed"), F.size(F.flatten("groups")).cast("long").alias("n_terms"))
