"""Preference formatting of paired conversations, with DataFrame operations only.

The longest common prefix of the chosen and the rejected turns is rendered once as prompt; what follows is rendered for each
side as a completion, with the character spans that are trained on: what the assistant says, up to its end mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.llm.common import table

END = "<|end|>"
TRAINED = "assistant"


def rendered(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(f"{END}\n"))))


def trained_spans(turns: Column) -> Column:
    """array<array<long>>: begin and end, in code points of the rendered turns, of each text to train on with its end mark."""
    head = lambda t: F.char_length(t["role"]) + 5  # noqa: E731  <| |> and a line feed
    body = lambda t: F.char_length(t["text"]) + len(END)
    before = lambda i: F.aggregate(F.slice(turns, 1, i), F.lit(0).cast("long"), lambda n, t: n + head(t) + body(t) + 1)
    spans = F.transform(turns, lambda t, i: F.when(t["role"] == TRAINED, F.array(before(i) + head(t), before(i) + head(t) + body(t))))
    return F.filter(spans, lambda s: s.isNotNull())


def format_preferences(turns: DataFrame) -> DataFrame:
    """turns (pair_id, side 'chosen' or 'rejected', turn, role, text) to one row per pair_id that has both sides.

    Columns: pair_id, n_prompt (turns in the prompt), prompt, chosen, rejected, chosen_mask, rejected_mask. Turns come in
    the order of turn (null last), then role, then text; null text is empty, null role is "unknown". If one side is a prefix
    of the other its completion is empty. Rows that repeat are turns of their own. Null pair_ids and other sides are left
    out, further columns are ignored, an empty table gives no rows. A conversation must fit into a row.
    """
    said = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, ordered_turn())))
    return formatted(turns.filter(F.col("pair_id").isNotNull()).groupBy("pair_id").agg(said("chosen").alias("c"), said("rejected").alias("r")))


def ordered_turn() -> Column:
    return F.struct(F.col("turn").isNull().alias("last"), "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def formatted(pairs: DataFrame) -> DataFrame:
    """pair_id, c, r (ordered turns of the chosen and the rejected side) to the columns of format_preferences()."""
    told = lambda side: F.transform(side, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    sides = pairs.select("pair_id", told("c").alias("c"), told("r").alias("r")).filter("size(c) > 0 and size(r) > 0")
    shorter = F.least(F.size("c"), F.size("r"))
    differs = F.array_position(F.zip_with(F.slice("c", 1, shorter), F.slice("r", 1, shorter), lambda a, b: a == b), False)
    common = sides.withColumn("n_prompt", F.when(differs == 0, shorter).otherwise(differs - 1).cast("int"))
    rest = lambda side: F.slice(side, F.col("n_prompt") + 1, F.greatest(F.size(side) - F.col("n_prompt"), F.lit(0)))
    cut = common.select("pair_id", "n_prompt", F.slice("c", 1, F.col("n_prompt")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return cut.select("pair_id", F.col("n_prompt").cast("long").alias("n_prompt"), rendered(F.col("p")).alias("prompt"), rendered(F.col("c")).alias("chosen"), rendered(F.col("r")).alias("rejected"), trained_spans(F.col("c")).alias("chosen_mask"), trained_spans(F.col("r")).alias("rejected_mask"))


def sibling_replies(conversations: DataFrame) -> DataFrame:
    """pair_id, c, r from plain conversations: a conversation as it is, and the same up to its last reply with the last reply
    of the conversation whose id differs in the lowest bit. Conversations without a reply, or without such a sibling, give
    none. Both siblings are grouped together, by the other bits of their ids, so turns are shuffled once.
    """
    own = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text")
    said = lambda bit: F.array_sort(F.collect_list(F.when(F.col("conv_id").bitwiseAND(F.lit(1)) == bit, ordered_turn())))
    both = own.groupBy(F.shiftright("conv_id", 1).alias("half")).agg(said(0).alias("t0"), said(1).alias("t1"))
    for side in ("0", "1"):
        replies = F.filter(f"t{side}", lambda t: (t["role"] == TRAINED) & t["turn"].isNotNull())
        both = both.withColumn(f"last{side}", F.array_max(F.transform(replies, lambda t: F.struct(t["turn"].alias("turn"), t["text"].alias("text")))))
    both = both.filter("last0 is not null and last1 is not null")

    def pair(own: str, other: str) -> Column:
        last, reply = F.col(f"last{own}"), F.col(f"last{other}")
        kept = F.filter(f"t{own}", lambda t: t["turn"] < last["turn"])
        new = F.struct(F.lit(False).alias("last"), last["turn"].alias("turn"), F.lit(TRAINED).alias("role"), reply["text"].alias("text"))
        return F.struct((F.shiftleft("half", 1) + int(own)).alias("pair_id"), F.col(f"t{own}").alias("c"), F.array_sort(F.concat(kept, F.array(new))).alias("r"))

    return both.select(F.explode_outer(F.array(pair("0", "1"), pair("1", "0"))).alias("p")).select("p.*")


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = formatted(sibling_replies(table(spark, sf_dir, "conversations")))
    flat = lambda mask: F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s)), ",")
    return pairs.withColumns({m: flat(F.transform(F.col(m), lambda s: F.transform(s, lambda x: x.cast("string")))) for m in ("chosen_mask", "rejected_mask")})


OP5_SQL = r"""
WITH own AS (SELECT conv_id AS pair_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
replies AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC, text DESC) AS back FROM own WHERE role = 'assistant' AND turn IS NOT NULL),
pairs AS (
  SELECT a.pair_id, a.turn AS last_turn, b.text AS reply FROM replies a JOIN replies b ON b.pair_id = xor(a.pair_id, 1) AND b.back = 1 WHERE a.back = 1
), turns AS (
  SELECT pair_id, 'chosen' AS side, turn, role, text FROM own JOIN pairs USING (pair_id)
  UNION ALL SELECT pair_id, 'rejected', turn, role, text FROM own JOIN pairs USING (pair_id) WHERE turn < last_turn
  UNION ALL SELECT pair_id, 'rejected', last_turn, 'assistant', reply FROM pairs
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS LAST, role, text) AS place, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM turns
), common AS (
  SELECT pair_id, coalesce(min(place) FILTER (WHERE n = 1 OR NOT same) - 1, max(place)) AS n_prompt
  FROM (SELECT pair_id, place, count(*) AS n, count(DISTINCT (role, text)) = 1 AS same FROM placed GROUP BY pair_id, place) GROUP BY pair_id
), ends AS (
  SELECT p.*, n_prompt, sum(length(shown)) OVER (PARTITION BY pair_id, side ORDER BY place) - sum(CASE WHEN place <= n_prompt THEN length(shown) ELSE 0 END) OVER (PARTITION BY pair_id, side) AS e
  FROM placed p JOIN common USING (pair_id)
), spans AS (
  SELECT *, CASE WHEN role = 'assistant' AND place > n_prompt THEN (e - length(shown) + length(role) + 5)::BIGINT || ':' || (e - 1)::BIGINT END AS span FROM ends
)
SELECT pair_id, any_value(n_prompt)::BIGINT AS n_prompt,
  coalesce(string_agg(shown, '' ORDER BY place) FILTER (WHERE side = 'chosen' AND place <= n_prompt), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY place) FILTER (WHERE side = 'chosen' AND place > n_prompt), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY place) FILTER (WHERE side = 'rejected' AND place > n_prompt), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY place) FILTER (WHERE side = 'chosen'), '') AS chosen_mask,
  coalesce(string_agg(span, ',' ORDER BY place) FILTER (WHERE side = 'rejected'), '') AS rejected_mask
FROM spans GROUP BY pair_id
"""
