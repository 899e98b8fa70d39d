"""Repair of conversations to a grammar of turns: an optional system turn, then pairs of user and assistant, or nothing.

Conversations are hash-partitioned and sorted, so each comes as one run of rows. A batch of rows is cut into segments, each
within one conversation, and DuckDB's recursive query advances all segments of the batch by one turn in each step: for every
state of the grammar that a segment may begin in, it keeps the least cost and the least audit for each state reached. The
segments of a conversation are then joined one after the other, so that one of any length is never held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corvane.llm.common import table

#: What an original null reads as, where text is needed.
NULL = " "
#: Damage by crc32 of conv_id:turn modulo KINDS.
KINDS, DROPPED, EMPTIED, UNENDED, REPEATED, MISCAST = 20, 0, 1, 2, 3, 4
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows of a segment, and rows and bytes of text in a batch of segments, its last row apart.
SEGMENT, BATCH_ROWS, BATCH_BYTES = 256, 8_192, 16 << 20
#: States: nothing yet, after system, after user, after assistant. What keeps or takes a role moves from one to another.
MOVES = ((0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2))
ENDS = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

#: rows: seg, pos (from 1 in the segment), role (initial, '' if it isn't in the grammar), fault. A step takes each row's best ways to
#: the states (path: cost and audit), adds up to two inserted turns, which are all that no cycle of states can spare, and then
#: one edit of the next row.
RECURSION = f"""
WITH RECURSIVE moves(f, initial, t) AS (VALUES {", ".join(f"({f}, '{i}', {t})" for f, i, t in MOVES)}),
inserts(f, t, cost, audit) AS (
  SELECT range, range, 0, '' FROM range(4)
  UNION ALL SELECT f, t, {INSERT}, 'I' FROM moves WHERE initial <> 's'
  UNION ALL SELECT a.f, b.t, {2 * INSERT}, 'II' FROM moves a JOIN moves b ON a.t = b.f WHERE a.initial <> 's' AND b.initial <> 's'
), edits(f, t, cost, audit, kind, initial) AS (
  SELECT range, range, {DELETE}, 'D', 'any', '' FROM range(4)
  UNION ALL SELECT f, t, 0, 'K', 'sound', initial FROM moves
  UNION ALL SELECT f, t, {REROLE}, 'R', 'sound', '' FROM moves WHERE initial <> 's'
), steps AS (
  SELECT kind, e.initial, i.f, e.t, min(row(i.cost + e.cost, i.audit || e.audit)) AS path
  FROM inserts i JOIN edits e ON i.t = e.f GROUP BY ALL
), begun AS (SELECT seg, CASE WHEN first THEN [0] ELSE [0, 1, 2, 3] END AS states, n FROM segments),
best(seg, pos, n, begin, state, path) AS (
  SELECT seg, 0, n, s, s, row(0, '') FROM (SELECT seg, n, unnest(states) AS s FROM begun)
  UNION ALL
  SELECT b.seg, b.pos + 1, any_value(b.n), b.begin, m.t, min(row(b.path[1] + m.path[1] + CASE WHEN m.kind = 'sound' AND r.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END, b.path[2] || m.path[2]))
  FROM best b JOIN rows r ON r.seg = b.seg AND r.pos = b.pos + 1
  JOIN steps m ON m.f = b.state AND (m.kind = 'any' OR r.fault NOT IN ('blank', 'duplicate') AND (m.initial = '' OR m.initial = r.role))
  GROUP BY b.seg, b.pos, b.begin, m.t
)
SELECT seg, begin, state, path[1] AS cost, path[2] AS audit FROM best WHERE pos = n
"""
#: The end of a conversation: what is inserted to reach an end state.
CLOSINGS = {(s, e): "I" * n for s in range(4) for e in ENDS for n in range(3) if (e - s, n) in {(0, 0), (1, 1), (2, 2), (3, 2)}}


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the dealt damage, and gone: rows that were dropped stay as marks of their conversation."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NULL))
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % KINDS
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text_of("role").alias("role"), text_of("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(DROPPED, EMPTIED), F.lit("")).when(F.col("kind") == UNENDED, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == REPEATED, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    role = F.when(F.col("kind") == MISCAST, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == DROPPED).alias("gone"), copies.alias("copy")).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, gone), with fault: a row's first one, or ''. In one partition by conversation, in its order.

    One shuffle, by conversation; repeats are found by a running window within it, whose rows Spark spills.
    """
    order = [F.col("gone"), F.col("turn").asc_nulls_first()]
    dealt = rows.repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(*order)) > 1
    said = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    fault = F.when(F.col("gone"), "").when(said == "", "blank").when(F.col("again"), "duplicate").when(~F.substring(said, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    flagged = dealt.withColumn("again", again)
    return flagged.withColumn("fault", fault).sortWithinPartitions("conv_id", *order, "role", "text", "again")


class Conversation:
    """What is known of a conversation after some of its segments. ways: by state cost, audit and digest of the repaired rows."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.counts, self.illegal = conv_id, {"blank": 0, "duplicate": 0, "truncated": 0}, 0
        self.last_role: str | None = None
        self.first_turn = self.last_turn = None
        self.turns, self.ways = 0, {0: (0, [], hashlib.sha256(), True)}

    def met(self, turn: int | None, role: str, fault: str) -> None:
        """Counts a row that is next in order."""
        if fault:
            self.counts[fault] += 1
        if self.last_role is not None and self.last_role[:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_role = role
        if turn is not None and turn != self.last_turn:
            self.turns, self.first_turn, self.last_turn = self.turns + 1, turn if self.first_turn is None else self.first_turn, turn

    def joined(self, found: list[tuple[int, int, int, str]], rows: list[tuple[str, str]]) -> None:
        """found: begin, state, cost, audit of the ways through a segment with these rows (role, text)."""
        best: dict[int, tuple] = {}
        for begin, state, cost, audit in found:
            if begin in self.ways:
                way = (self.ways[begin][0] + cost, self.ways[begin][1], audit, begin)
                if state not in best or way[0] < best[state][0] or way[0] == best[state][0] and earlier(way, best[state]):
                    best[state] = way
        self.ways = {state: (cost, [*before, audit], *self.repaired(begin, audit, rows)) for state, (cost, before, audit, begin) in best.items()}

    def repaired(self, begin: int, audit: str, rows: list[tuple[str, str]]) -> tuple:
        """The digest of what has been repaired with one segment more, and whether that is nothing as yet."""
        digest, empty, state, at = self.ways[begin][2].copy(), self.ways[begin][3], begin, iter(rows)
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(at)
            if edit == "D":
                continue
            if edit != "K":
                role = next(NAMES[i] for f, i, _ in MOVES if f == state and i in NAMES)
            state = next(t for f, i, t in MOVES if f == state and i == role[:1])
            digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "replace"))
            empty = False
        return digest, empty

    def closed(self) -> tuple:
        """The columns of RESULT."""
        ends = [(cost + INSERT * len(more), [*audit, more], s) for s, (cost, audit, *_) in self.ways.items() for (f, _), more in CLOSINGS.items() if f == s]
        cost = min(e[0] for e in ends)
        audit, state, more = min(("".join(a), s, a[-1]) for c, a, s in ends if c == cost)
        digest, _ = self.repaired(state, more, [])
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, *self.counts.values(), self.illegal, cost, audit, digest.hexdigest()


def earlier(a: tuple, b: tuple) -> bool:
    """Whether way a's audit is the ASCII-less: no audit begins another here, as each ends with the edit of the same row."""
    for x, y in zip(chain.from_iterable([*a[1], a[2]]), chain.from_iterable([*b[1], b[2]]), strict=False):
        if x != y:
            return x < y
    return False


def repair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of with_faults() to RESULT, a row for each conversation."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    open_one: Conversation | None = None
    for rows in sized(batches):
        ids, turns, roles, texts, faults, gone = (rows.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "gone"))
        segments: list[tuple[Conversation, list[int], bool]] = []
        done: list[Conversation] = []
        for i, conv_id in enumerate(ids):
            if open_one is None or open_one.conv_id != conv_id:
                if open_one is not None:
                    done.append(open_one)
                open_one, fresh = Conversation(conv_id), True
                segments.append((open_one, [], True))
            elif not segments or segments[-1][0] is not open_one or len(segments[-1][1]) == SEGMENT:
                segments.append((open_one, [], False))
            if not gone[i]:
                open_one.met(turns[i], roles[i], faults[i])
                segments[-1][1].append(i)
        for k, found in ways(con, [s[1] for s in segments], [s[2] for s in segments], roles, faults).items():
            own, places, _ = segments[k]
            own.joined(found, [(roles[i], texts[i]) for i in places])
        if done:
            yield as_batch([c.closed() for c in done])
    if open_one is not None:
        yield as_batch([open_one.closed()])


def ways(con: duckdb.DuckDBPyConnection, places: list[list[int]], first: list[bool], roles: list[str], faults: list[str]) -> dict[int, list[tuple]]:
    """Of each segment that has rows, in order: begin, state, cost, audit of its best ways."""
    full = [k for k, p in enumerate(places) if p]
    seg = [k for k in full for _ in places[k]]
    at = [j + 1 for k in full for j in range(len(places[k]))]
    rows = [i for k in full for i in places[k]]
    initials = [roles[i][:1] if roles[i][:1] in ("s", "u", "a") else "-" for i in rows]
    con.register("rows", pa.table({"seg": pa.array(seg, pa.int64()), "pos": pa.array(at, pa.int32()), "role": pa.array(initials, pa.string()), "fault": pa.array([faults[i] for i in rows], pa.string())}))
    con.register("segments", pa.table({"seg": pa.array(full, pa.int64()), "first": pa.array([first[k] for k in full], pa.bool_()), "n": pa.array([len(places[k]) for k in full], pa.int32())}))
    found: dict[int, list[tuple]] = {k: [] for k in full}
    for k, *way in con.sql(RECURSION).fetchall():
        found[k].append(tuple(way))
    return found


def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most BATCH_ROWS rows and, a last row apart, BATCH_BYTES of text."""
    for batch in batches:
        begin, size = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
            if i > begin and (i - begin == BATCH_ROWS or size > BATCH_BYTES):
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += n
        if begin < batch.num_rows:
            yield batch.slice(begin)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in RESULT.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def repair(rows: DataFrame) -> DataFrame:
    """RESULT for each conversation of rows (conv_id, turn, role, text, gone).

    Rows that are gone count for nothing, but their conversation is answered. Rows come by turn, nulls first, then role and
    text; equal rows are duplicates after the first. A null conv_id is a conversation like any other. A role whose first
    letter is not s, u or a can't be kept. An empty table gives no rows; further columns are ignored; texts of any length
    are read whole, one batch at a time.
    """
    return with_faults(rows.select("conv_id", "turn", "role", "text", "gone")).mapInArrow(repair_batches, RESULT)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


#: The SQL takes whole audits along and holds all rows at once; it has neither batches nor segments.
OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT range AS i FROM range(256))
), said AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), kinds AS (
  SELECT said.*, xor(list_reduce([4294967295] || list_transform(string_split(name, ''), lambda x: ord(x)::BIGINT), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM said, crc
), after AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds) WHERE kind <> 0
), placed AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, '') AS c, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM after
), counted AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 AS again FROM placed), faulty AS (
  SELECT *, CASE WHEN regexp_matches(text, '^[\x20\x09-\x0D]*$') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM counted
), figures AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) AS n FROM faulty GROUP BY c
), neighbours AS (
  SELECT c, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT c, lag(role[1]) OVER (PARTITION BY c ORDER BY pos) || role[1] AS pair FROM faulty) GROUP BY c
), moves(f, initial, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
told AS (SELECT c, list({'role': role, 'text': text, 'fault': fault} ORDER BY pos) AS turns FROM faulty GROUP BY c),
ways(c, pos, ins, state, cost, audit, made) AS (
  SELECT c, 0, 0, 0, 0, '', []::VARCHAR[] FROM told
  UNION ALL
  SELECT * FROM (
    SELECT c, pos, ins, state, min(cost) AS cost, arg_min(audit, row(cost, audit)) AS audit, arg_min(made, row(cost, audit)) AS made FROM (
      SELECT w.c, pos + 1 AS pos, 0 AS ins, state, cost + 3 AS cost, audit || 'D' AS audit, made FROM ways w JOIN told USING (c) WHERE pos < len(turns)
      UNION ALL
      SELECT w.c, pos + 1, 0, m.t, cost + CASE WHEN turns[pos + 1].fault = 'truncated' THEN 1 ELSE 0 END, audit || 'K', made || [turns[pos + 1].role || ':' || turns[pos + 1].text]
      FROM ways w JOIN told USING (c) JOIN moves m ON m.f = state WHERE pos < len(turns) AND turns[pos + 1].fault NOT IN ('blank', 'duplicate') AND m.initial = turns[pos + 1].role[1]
      UNION ALL
      SELECT w.c, pos + 1, 0, m.t, cost + 2 + CASE WHEN turns[pos + 1].fault = 'truncated' THEN 1 ELSE 0 END, audit || 'R', made || [CASE m.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || turns[pos + 1].text]
      FROM ways w JOIN told USING (c) JOIN moves m ON m.f = state WHERE pos < len(turns) AND turns[pos + 1].fault NOT IN ('blank', 'duplicate') AND m.initial <> 's'
      UNION ALL
      SELECT w.c, pos, ins + 1, m.t, cost + 2, audit || 'I', made || [CASE m.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END] FROM ways w JOIN moves m ON m.f = state WHERE ins < 2 AND m.initial <> 's'
    ) GROUP BY c, pos, ins, state
  )
), ends AS (SELECT w.*, row_number() OVER (PARTITION BY c ORDER BY cost, audit) AS best FROM ways w JOIN told USING (c) WHERE pos = len(turns) AND state IN (0, 3))
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS c FROM conversations) i LEFT JOIN figures USING (c) LEFT JOIN neighbours USING (c) LEFT JOIN ends ON ends.c = i.c AND best = 1
"""
