"""Files as rows: scans, hashes, volumes, incoming snapshots, plain-text and word-processor blocks."""

from __future__ import annotations

import codecs
import hashlib
import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote
from xml.etree import ElementTree

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from corvane.functions import text as T
from corvane.operators.storage import kept

WORD_SUFFIXES = (".docx", ".doc", ".docm")
READABLE_SUFFIXES = (".docx", ".txt", ".pdf")
BLOCKS = "path string, block_index long, block_type string, text string, paragraph_index long, table_index long, row_index long, style string, error string"
WORDML = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def is_word_file(path: Column) -> Column:
    return suffix(path).isin(*WORD_SUFFIXES)


def volume(path: Column, names: dict[str, str]) -> Column:
    """The volume of the path's first segment, unknown for any other."""
    first, out = F.split(path, "/")[0], None
    for segment, name in names.items():
        out = (F if out is None else out).when(first == segment, name)
    return F.lit("unknown") if out is None else out.otherwise("unknown")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modificationTime of every file below folder that has any bytes (Spark's readers leave the others out); no
    file is opened."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, modificationTime, sha256, suffix, is_word, error of every file below folder that has any bytes.

    Files up to WHOLE_BYTES are read whole and hashed in the JVM; longer ones are streamed by their tasks in blocks, so that a
    task's memory does not grow with a file. One that can't be opened has an error and no hash. In a store that Spark opens and
    pyarrow doesn't, nothing can be streamed: there files are read whole up to the limit of Spark's reader
    (spark.sql.sources.binaryFile.maxLength), and longer ones have an error.
    """
    most = limit = int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))
    if limit > WHOLE_BYTES:
        some = listing(spark, folder).filter(F.col("length") > WHOLE_BYTES).first()
        most = WHOLE_BYTES if some is None or can_stream(some.path) else limit
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).filter(F.col("length") <= most)
    small = whole.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"), F.lit(None).cast("string").alias("error"))
    large = listing(spark, folder).filter(F.col("length") > most)
    found = small.unionByName(one_each(large).mapInPandas(hashed, SCANNED))
    return found.select("path", "length", "modificationTime", "sha256", suffix(F.col("path")).alias("suffix"), is_word_file(F.col("path")).alias("is_word"), "error")


def one_each(files: DataFrame) -> DataFrame:
    """files (path, ...), each in a task of its own up to MOST_TASKS. Dealt by path alone they would come together in one task, as
    Spark joins partitions by the bytes of their rows, which are names here."""
    return files.repartitionByRange(max(1, min(MOST_TASKS, files.count())), "path")


#: Tasks that files are dealt to at most.
MOST_TASKS = 10_000

SCANNED = "path string, length long, modificationTime timestamp, sha256 string, error string"
COPIED = "path string, target string, length long, sha256 string, error string"
#: Bytes that are read at once.
READ_BYTES = 8 << 20
#: Bytes of a file that is read whole at most; the JVM holds some copies of it.
WHOLE_BYTES = 16 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path with a scheme, which the task reaches by itself, and the path in it."""
    local = re.match(r"file:/*(?=/)|(?=/)", path)
    if local:
        return fs.LocalFileSystem(), path[local.end() :]
    scheme, rest = path.split("://", 1)
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest, safe='/:@')}")


def can_stream(path: str) -> bool:
    """Whether there is a file system for the path; that the file can be read is not said."""
    try:
        opened(path)
    except Exception:
        return False
    return True


def streamed(source: fs.FileSystem, path: str, out=None) -> str:
    """The SHA-256 of a file, read in blocks, which are written to out as well if it is given."""
    digest = hashlib.sha256()
    with source.open_input_stream(path) as stream:
        while block := stream.read(READ_BYTES):
            digest.update(block)
            if out is not None:
                out.write(block)
    return digest.hexdigest()


def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for r in frame.itertuples(index=False):
            try:
                rows.append((r.path, r.length, r.modificationTime, streamed(*opened(r.path)), None))
            except Exception as e:
                rows.append((r.path, r.length, r.modificationTime, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCANNED.split(", ")])


def copied(files: DataFrame, root: str, target: str) -> DataFrame:
    """Copies files (path, length, modificationTime, as listing() gives them) from below root to the same places below target, and
    gives path, target, length, sha256, error of each.

    Each is streamed in blocks to a name of its own, read again and compared, and only then given its name. A file whose length
    or time is not as listed, before or after, is an error (CHANGED), as is one that reads otherwise than it was written
    (DIFFERS) or can't be read or written; it leaves nothing. What is there already is replaced. Tasks that run twice do no harm.
    """

    def copy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                to = f"{target.rstrip('/')}/{within(r.path, root)}"
                try:
                    rows.append((r.path, to, r.length, one(r, to), None))
                except Exception as e:
                    rows.append((r.path, to, r.length, None, str(e) if isinstance(e, CopyError) else f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in COPIED.split(", ")])

    def one(r, to: str) -> str:
        source, path = opened(r.path)
        there, end = opened(to)
        part = f"{end}.{uuid.uuid4().hex}"
        as_listed = lambda: (i := source.get_file_info(path)).size == r.length and abs(i.mtime_ns - pd.Timestamp(r.modificationTime).value) < 10**6
        if not as_listed():
            raise CopyError("CHANGED")
        there.create_dir(end.rpartition("/")[0], recursive=True)
        try:
            with there.open_output_stream(part) as out:
                digest = streamed(source, path, out)
            if not as_listed():
                raise CopyError("CHANGED")
            if streamed(there, part) != digest:
                raise CopyError("DIFFERS")
            there.move(part, end)
        except BaseException:
            if there.get_file_info(part).type != fs.FileType.NotFound:
                there.delete_file(part)
            raise
        return digest

    return one_each(files.select("path", "length", "modificationTime")).mapInPandas(copy, COPIED)


class CopyError(RuntimeError):
    pass


def within(path: str, root: str) -> str:
    """The rest of path below root, whatever slashes follow the schemes."""
    plain = lambda p: re.sub(r"^[a-z0-9]+:/*", "/", p)
    return plain(path).removeprefix(plain(root).rstrip("/")).lstrip("/")


def snapshot_of(spark: SparkSession, root: str, target: str) -> DataFrame:
    """Copies all files below root to target, and gives copied()'s rows, kept. Raises if any file could not be copied as listed;
    what was copied stays, and a further call replaces it."""
    found = kept(copied(kept(listing(spark, root)), root, target))
    wrong = found.filter("error is not null").limit(5).collect()
    if wrong:
        raise CopyError("; ".join(f"{r.path}: {r.error}" for r in wrong))
    return found


def scan_summary(files: DataFrame) -> DataFrame:
    """files (path, length, volume): counts and bytes by volume and suffix."""
    return files.groupBy("volume", suffix(F.col("path")).alias("suffix")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.sum(is_word_file(F.col("path")).cast("long")).alias("word_files"))


def snapshot(files: DataFrame) -> DataFrame:
    """files (name, is_folder): state of each incoming name. Names that differ in case alone collide, and none of them is taken."""
    key = F.lower(F.col("name"))
    seen = F.count("*").over(W.partitionBy(key))
    state = F.when(F.col("is_folder"), "IGNORED_FOLDER").when(~suffix(F.col("name")).isin(*READABLE_SUFFIXES), "UNSUPPORTED").when(seen > 1, "NAME_COLLISION").otherwise("FROZEN")
    return files.filter(~F.col("name").startswith("~$")).withColumn("state", state)


def decode(raw: bytes) -> str:
    """By mark of order, else UTF-8, UTF-16 if many bytes are zero, GB18030. Raises if the text has too many odd characters."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if raw.startswith(mark):
            return checked(raw.decode(name))
    zeros = raw.count(0) / max(1, len(raw))
    order = ("utf-16-le", "utf-16-be") if zeros > 0.10 else ("utf-8", "gb18030")
    for name in order:
        try:
            return checked(raw.decode(name))
        except (UnicodeDecodeError, ValueError):
            continue
    raise ValueError("unknown encoding")


def checked(text: str) -> str:
    odd = sum(c == "�" or (c < " " and c not in "\t\n\r\f\v") for c in text)
    if odd >= 0.10 * max(1, len(text)):
        raise ValueError("too many control characters")
    return text


def text_blocks(text: str) -> list[tuple[str, str]]:
    """Paragraphs: lines joined by a space up to a blank line; a line with tabs is a table row of its own."""
    out, open_lines = [], []

    def close() -> None:
        if open_lines:
            out.append(("paragraph", " ".join(open_lines)))
            open_lines.clear()

    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if not line.strip():
            close()
        elif "\t" in line:
            close()
            out.append(("table_row", "表格行：" + " | ".join(c.strip() for c in line.split("\t") if c.strip())))
        else:
            open_lines.append(line.strip())
    close()
    return out


def said(node: ElementTree.Element) -> str:
    parts = {"t": lambda n: n.text or "", "tab": lambda n: "\t", "br": lambda n: "\n"}
    return "".join(parts[k](n) for n in node.iter() if (k := n.tag.removeprefix(WORDML)) in parts)


def docx_blocks(raw: bytes) -> list[tuple]:
    """Paragraphs and table rows in the order of the body; a row shows its cells by column."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{WORDML}body")
    out, paragraph, table = [], 0, 0
    for node in [] if body is None else body:
        kind = node.tag.removeprefix(WORDML)
        if kind == "p":
            if (text := said(node).strip()):
                style = node.find(f"{WORDML}pPr/{WORDML}pStyle")
                out.append(("paragraph", text, paragraph, None, None, None if style is None else style.get(f"{WORDML}val")))
            paragraph += 1
        elif kind == "tbl":
            for r, row in enumerate(node.findall(f"{WORDML}tr")):
                cells = [" ".join(said(c).split()) for c in row.findall(f"{WORDML}tc")]
                if any(cells):
                    out.append(("table_row", "表格行：" + " | ".join(f"列{k}：{c}" for k, c in enumerate(cells, 1) if c), None, table, r, None))
            table += 1
    return out


def parse(files: DataFrame) -> DataFrame:
    """files (path, content) of .txt and .docx to blocks; a file that cannot be read gives one row with its error."""

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in BLOCKS.split(", ")]
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                try:
                    if r.path.lower().endswith(".docx"):
                        rows = docx_blocks(r.content)
                    elif r.path.lower().endswith(".txt"):
                        rows = [(kind, text, i, None, None, None) for i, (kind, text) in enumerate(text_blocks(decode(r.content)))]
                    else:
                        raise ValueError("unsupported file type")
                    out += [(r.path, i, *row, None) for i, row in enumerate(rows)]
                except Exception as e:  # noqa: BLE001  one file's fault is a row, not the job's end
                    out.append((r.path, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=names).astype({c: "Int64" for c in names if c.endswith("index")})

    return files.select("path", "content").mapInPandas(blocks, BLOCKS)


def reading_order(boxes: DataFrame) -> DataFrame:
    """boxes (doc_id, page, x, y) with their place on the page: by line of 12 points, then from left to right."""
    order = W.partitionBy("doc_id", "page").orderBy(F.bround(F.col("y") / 12), "x", "y")
    return boxes.withColumn("place", F.row_number().over(order).cast("long"))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, paragraph, text: the text_blocks() rule for lines without tabs, within each row. paragraph: blank lines before it."""
    lines = docs.select(id_col, F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), T.strip).alias("l"))
    blank = F.filter(F.transform("l", lambda x, i: F.when(x == "", i + 1)), lambda i: i.isNotNull())
    begin, end = F.concat(F.array(F.lit(0)), blank), F.concat(blank, F.array(F.size("l") + 1))
    joined = F.zip_with(begin, end, lambda a, b: F.array_join(F.slice("l", a + 1, b - a - 1), " "))
    return lines.select(id_col, F.posexplode_outer(joined).alias("paragraph", "text")).filter("text <> ''").select(id_col, F.col("paragraph").cast("long"), "text")
