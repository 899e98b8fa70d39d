"""Text functions on columns: white space, noise lines, statute levels and articles, token estimates, display forms."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, functions as F

# ---- fixed values: these lists and patterns define the results ----
CN_NUMERAL = "[一二三四五六七八九十百千万零〇]+"
CN_SMALL = "[一二三四五六七八九十]+"
PRESERVED_LINE = f"^(第{CN_NUMERAL}[章节条编款项]|（{CN_SMALL}）|{CN_SMALL}[、，]|[0-9]+[.、])"
NOISE_LINE = "^([0-9]{1,4}|[ \\-_=*#~^]+|- [0-9]+ -|第 *[0-9]+ *页|[Pp][Aa][Gg][Ee] +[0-9]+|[—-] *[0-9]+( *[—-])?|[0-9]+/[0-9]+|[0-9]{4}年[0-9]{1,2}月[0-9]{1,2}日|共 *[0-9]+ *页|[(（][0-9]+[)）])$"
NOISE_WORDS = "页眉|页脚|版权所有|翻印必究|内部资料|机密|绝密|秘密|内部文件"
LEVELS = (
    ("编", f"^第{CN_NUMERAL}编"), ("章", f"^第{CN_NUMERAL}章"), ("节", f"^第{CN_NUMERAL}节"), ("条", f"^第{CN_NUMERAL}条"), ("款", f"^第{CN_NUMERAL}款"),
    ("项", f"^（{CN_SMALL}）"), ("项", f"^{CN_SMALL}[、，]"), ("项", "^[0-9]+[.、]"), ("目", "^[0-9]+\\)"),
)
HEADINGS = ("编", "章", "节")
SENTENCE_ENDS = "。；：！？”」』）)》"
OPEN_ENDS = "，、；：—“「『（("
ENTRY_START = f"^(第{CN_NUMERAL}[章节条编款]|（{CN_SMALL}）|{CN_SMALL}[、，]|[0-9]+[.、])"
REFERENCE = "第[一二三四五六七八九十百千万零〇两]+条(?:[ ]*[至到\\-—－][ ]*第[一二三四五六七八九十百千万零〇两]+条)?"
GARBLED = "�ÂÃÄâãä"
TRUNCATED = "……（该资料片段因上下文长度限制已截断）"
NATURAL_ENDS = ("\n\n", "\n", "。", "；", "！", "？", ".", ";", "!", "?")
CUT_AFTER = ("。", "；", "\n", "，")
HIDDEN_PATH = "[已隐藏路径]"
EMBEDDING_FIELDS = (("title", "法规标题"), ("agency", "发布机关"), ("published", "公布日期"), ("effective", "施行日期"), ("nature", "法规性质"), ("validity", "时效性"), ("section_path", "章节路径"), ("article_range", "条文范围"), ("article_no", "条号"))
CHARS_PER_TOKEN = 0.7
# ---- end of fixed values ----

#: Values of a batch that are held as Python objects at once.
TOGETHER = 64

ENTRY, CHINESE = re.compile(ENTRY_START), re.compile("[一-鿿]")

#: Unicode white space, as a class that Java's regular expressions and RE2 read alike.
WS = r"[ \t-\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same, character by character.
WS_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without white space at both ends; a regular expression would look at every run of it within."""
    return F.btrim(col(c), F.lit(WS_CHARS))


def blank_to_null(c: str | Column) -> Column:
    return F.when(strip(c) == "", None).otherwise(col(c))


def has_cjk(c: str | Column) -> Column:
    return F.coalesce(col(c).rlike("[一-鿿]"), F.lit(False))


def normalize_spaces(c: str | Column) -> Column:
    """Wide spaces and tabs become spaces, line ends line feeds, and runs of spaces one."""
    return F.regexp_replace(F.translate(F.regexp_replace(F.coalesce(col(c), F.lit("")), "\r\n?", "\n"), "　\t", "  "), " {2,}", " ")


def is_noise(c: str | Column) -> Column:
    s = strip(F.coalesce(col(c), F.lit("")))
    return F.when(s == "", True).when(s.rlike(PRESERVED_LINE), False).when(s.rlike(NOISE_LINE) | s.rlike(NOISE_WORDS), True).otherwise((F.char_length(s) < 4) & ~has_cjk(s))


def merged_lines(text: str) -> str:
    """Lines of which an open end, or Chinese text on both sides, says that the next one goes on, joined."""
    done: list[list[str]] = []  # the parts of each line
    for line in text.split("\n"):
        words, before = line.strip(), done[-1][-1].rstrip() if done else ""
        goes_on = bool(words and before) and before[-1] not in SENTENCE_ENDS and not ENTRY.match(words)
        if goes_on and before[-1] not in OPEN_ENDS:
            goes_on = any(map(CHINESE.search, done[-1])) and bool(CHINESE.search(words)) and words[0] not in SENTENCE_ENDS + "第（(　"
        if goes_on:
            done[-1][-1] = before
            done[-1].append(words)
        else:
            done.append([line])
    return "\n".join("".join(parts) for parts in done)


def merge_broken_lines(c: str | Column) -> Column:
    """Joins lines that a parser broke, in Arrow batches and linear time: what joins a line depends on all lines it joins."""
    return mapped(F.coalesce(col(c), F.lit("")), merged_lines)


def clean_text(c: str | Column) -> Column:
    lines = F.filter(F.transform(F.split(merge_broken_lines(normalize_spaces(c)), "\n"), lambda line: F.struct(line.alias("raw"), is_noise(line).alias("noise"))), lambda s: (strip(s["raw"]) == "") | ~s["noise"])
    return strip(F.regexp_replace(F.array_join(F.transform(lines, lambda s: strip(s["raw"])), "\n"), "\n{3,}", "\n\n"))


def clean_block(c: str | Column) -> Column:
    """clean_text() of a block of one line, or the block as it is where nothing would be left."""
    s = strip(normalize_spaces(c))
    return F.when((s == "") | is_noise(s), F.coalesce(col(c), F.lit(""))).otherwise(s)


def mapped(c: str | Column, f: Callable[[str], object], kind: str = "string") -> Column:
    """f of each value that is not null, in Arrow batches, of which TOGETHER values at a time are Python's."""
    kinds = {"string": pa.string(), "array<string>": pa.list_(pa.string())}

    def each(values: pa.Array) -> pa.Array:
        some = (values.slice(at, TOGETHER).to_pylist() for at in range(0, len(values), TOGETHER))
        return pa.concat_arrays([pa.array([], kinds[kind]), *(pa.array([None if v is None else f(v) for v in part], kinds[kind]) for part in some)])

    return F.arrow_udf(each, kind)(col(c))


def nfc(c: str | Column) -> Column:
    return mapped(c, lambda t: unicodedata.normalize("NFC", t))


def tidy(c: str | Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(nfc(col(c)), "\r\n?", "\n"), "[ \t]+", " "))


def usable_title(c: str | Column) -> Column:
    s = strip(c)
    return F.char_length(s).between(2, 100) & ~s.rlike("[。;；.]$") & (s != "目录")


def level(c: str | Column) -> Column:
    """编 章 节 条 款 项 目, or null for a plain paragraph."""
    s, out = strip(c), None
    for name, pattern in LEVELS:
        out = (F if out is None else out).when(s.rlike(pattern), name)
    return out.otherwise(F.lit(None).cast("string"))


def begins(c: str | Column, *levels: str) -> Column:
    """Whether a text begins as a title of one of levels (编 章 节 条 款 项 目) does. Blank texts begin none, null gives null."""
    return strip(c).rlike("|".join(pattern for name, pattern in LEVELS if name in levels))


def numbered(c: str | Column, unit: str, anywhere: bool = False) -> Column:
    """第…unit at the start, or else, if anywhere, the first in the text."""
    s = strip(c)
    start = F.nullif(F.regexp_extract(s, f"^第{CN_NUMERAL}{unit}", 0), F.lit(""))
    return F.coalesce(start, F.nullif(F.regexp_extract(s, f"第{CN_NUMERAL}{unit}", 0), F.lit(""))) if anywhere else start


def references(c: str | Column) -> Column:
    """Articles and ranges of articles that are named, without white space, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(col(c), F.lit(REFERENCE), 0), lambda r: F.regexp_replace(r, " +", "")))


def article_range(articles: Column) -> Column:
    one = F.array_distinct(articles)
    return F.when(F.size(one) == 0, None).when(F.size(one) == 1, F.element_at(one, 1)).when(F.size(one) > 1, F.concat(F.element_at(one, 1), F.lit("-"), F.element_at(one, -1)))


def tokens_by_chars(c: str | Column) -> Column:
    n = F.char_length(F.coalesce(col(c), F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / F.lit(CHARS_PER_TOKEN)))).cast("long")


def tokens_by_bytes(c: str | Column) -> Column:
    return F.ceil(F.octet_length(F.coalesce(col(c), F.lit(""))) / 2).cast("long")


def count_by_bytes(text: str) -> int:
    return -(-len(text.encode("utf-8", "replace")) // 2)


def prefix_within(text: str, tokens: int) -> str:
    """The longest prefix of at most so many tokens by bytes."""
    return text.encode("utf-8", "replace")[: max(0, 2 * tokens)].decode("utf-8", "ignore")


def truncated(text: str, tokens: int) -> str:
    """The text, or a prefix of it with a mark of truncation, within so many tokens; a natural end in its last fifth is preferred."""
    if not text or tokens <= 0:
        return ""
    if count_by_bytes(text) <= tokens:
        return text
    room = 2 * tokens - len(TRUNCATED.encode())
    if count_by_bytes(TRUNCATED) > tokens:
        return prefix_within(TRUNCATED, tokens)
    prefix = prefix_within(text, tokens - count_by_bytes(TRUNCATED))
    if len(prefix) >= 10:
        found = [at + len(end) for end in NATURAL_ENDS if (at := prefix.rfind(end, int(len(prefix) * 0.8))) >= 0]
        prefix = prefix[: max(found)] if found else prefix
    return prefix.rstrip().encode()[: max(0, room + 1)].decode("utf-8", "ignore") + TRUNCATED


def truncate(c: str | Column, tokens: int) -> Column:
    return mapped(c, lambda t: truncated(t, tokens))


def pieces(text: str, max_tokens: int) -> list[str]:
    """Cuts a long text after the last full stop, semicolon, line feed or comma of each window, if in its second half."""
    width, out = int(max_tokens * CHARS_PER_TOKEN), []
    if len(text) <= width:
        return [text]
    width = max(1, width)
    while len(text) > width:
        ends = (text[:width].rfind(mark) for mark in CUT_AFTER)
        cut = next((end + 1 for end in ends if end > width * 0.5), width)
        out.append(text[:cut].strip())
        text = text[cut:].strip()
    return [*out, text] if text else out


def split_long(c: str | Column, max_tokens: int) -> Column:
    return mapped(c, lambda t: pieces(t, max_tokens), "array<string>")


def embedding_text(body: str | Column, **fields: Column) -> Column:
    """Header lines for the fields that are there, then the body; the body alone without any."""
    header = F.concat_ws("\n", *[F.when(fields[k].isNotNull() & (fields[k] != ""), F.concat(F.lit(f"{label}："), fields[k])) for k, label in EMBEDDING_FIELDS if k in fields])
    return F.when(header == "", col(body)).otherwise(F.concat(header, F.lit("\n\n正文：\n"), col(body)))


def garbled_share(c: str | Column) -> Column:
    n = F.char_length(col(c))
    return F.when(n == 0, 0.0).otherwise((n - F.char_length(F.translate(col(c), GARBLED, ""))) / n)


def format_bytes(c: str | Column) -> Column:
    out, size = None, col(c).cast("double")
    for k, unit in enumerate(("B", "KB", "MB", "GB")):
        out = (F if out is None else out).when(size < 1024.0 ** (k + 1), F.format_string(f"%.2f {unit}", F.bround(size / 1024.0**k, 2)))
    return out.otherwise(F.format_string("%.2f TB", F.bround(size / 1024.0**4, 2)))


def redact(c: str | Column) -> Column:
    """Authorization headers, fields named like secrets, and absolute paths are masked."""
    out = F.regexp_replace(col(c), r"(?i)(authorization[ \t]*[:=][ \t]*)[^\r\n,;]+", "$1***")
    out = F.regexp_replace(out, r"(?i)((?:api[_-]?key|token|password|secret)[ \t]*[:=][ \t]*)[^ \t\r\n,;]+", "$1***")
    out = F.regexp_replace(out, r"[A-Za-z]:\\[^ \t\r\n]+", "<path>")
    return F.regexp_replace(out, r"/(?:home|root|var|tmp|opt|usr|etc)/[^ \t\r\n]*", "<path>")


def one_line(c: str | Column, most: int = 300) -> Column:
    return F.substring(strip(F.regexp_replace(col(c), f"{WS}+", " ")), 1, most)


def display_title(title: Column, doc_title: Column, path: Column) -> Column:
    base = F.regexp_extract(F.translate(path, "\\", "/"), "([^/]+)/*$", 1)
    return F.coalesce(strip(blank_to_null(title)), strip(blank_to_null(doc_title)), F.nullif(base, F.lit("")), F.lit("未命名资料"))


def display_location(section: Column, span: Column, article: Column, first: Column, last: Column) -> Column:
    paragraphs = F.when(first.isNotNull() & last.isNotNull(), F.concat(F.lit("段落 "), first.cast("string"), F.lit("-"), last.cast("string"))).when(first.isNotNull(), F.concat(F.lit("段落 "), first.cast("string")))
    return F.coalesce(strip(blank_to_null(section)), strip(blank_to_null(span)), strip(blank_to_null(article)), paragraphs, F.lit(""))


def reference_name(title: Column, path: Column) -> Column:
    """title（file name）, or the file name alone where the title is its stem or is missing."""
    name = F.regexp_extract(F.translate(F.coalesce(path, F.lit("")), "\\", "/"), "([^/]+)/*$", 1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    plain = strip(F.coalesce(title, F.lit("")))
    return F.when((name != "") & (plain != "") & (F.lower(plain) != F.lower(stem)), F.concat(plain, F.lit("（"), name, F.lit("）"))).when(name != "", name).when(plain != "", plain).otherwise("未命名资料")


def evidence_json(no: Column, title: Column, location: Column, content: Column) -> Column:
    return F.to_json(F.struct(no.alias("evidence_no"), title.alias("title"), location.alias("location"), content.alias("content")))


DRIVE_PATH = re.compile(r"(?i)(?:[a-z]:[\\/]|\\\\)\S*")
ROOT_PATH = re.compile(r"(?<!\S)/(?:projects|home|var|tmp|opt|usr|etc)(?:/\S*)?")


def plain_line(value: str | None) -> str:
    """One line in composed form, without control characters and absolute paths."""
    text = unicodedata.normalize("NFC", value or "")
    text = " ".join("".join(" " if unicodedata.category(c)[0] == "C" else c for c in text).split())
    return ROOT_PATH.sub(HIDDEN_PATH, DRIVE_PATH.sub(HIDDEN_PATH, text))


def shown(value: str) -> str:
    line = plain_line(value)
    line = line if len(line) <= 300 else line[:299] + "…"
    return re.sub(r"([\\\[\]()*_`#!|])", r"\\\1", html.escape(line, quote=False))


def display_text(c: str | Column) -> Column:
    """plain_line() of 300 characters at most, with HTML and Markdown escaped. Null becomes empty."""
    return mapped(F.coalesce(col(c), F.lit("")), shown)
