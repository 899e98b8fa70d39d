"""Mixing sources to target weights, with DataFrame operations only.

Every row gets a random key by hash. Rows are dealt into ranges of the keys within each source and sorted there; sums of the
ranges, added up within their source, make a prefix sum over all its rows. A source's budget in words cuts that sum: rows before
the cut are taken whole, the row on it in part, and a budget above the source's size begins a further epoch.
"""

from __future__ import annotations

from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corvane.llm.common import checkpointed, table

#: Weights of the sources in their order, repeated.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and epochs of a source at most.
SHARE = Fraction(3, 2)
MOST_EPOCHS = 2
SEED = "mix"
#: Ranges of the keys: one for each so many rows, as a power of two up to 2^MOST_BITS.
RANGE_ROWS, MOST_BITS = 256, 16
#: Sources up to which their table, of some 100 bytes each, is broadcast; more meet by a shuffle.
FEW_SOURCES = 10_000
#: Copies of a row that are dealt out together.
COPIES = 1 << 14


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def big(c: Column) -> Column:
    return c.cast("decimal(30,0)")


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows and, by name, each of sums added up over the rows before by order, which is unique. Range by range, no window over all."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    ranges = dealt.groupBy("range").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    offsets = ranges.select("range", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"off {k}") for k in sums])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = dealt.withColumns({f"in {k}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in sums.items()}).join(F.broadcast(offsets), "range")
    return met.select(*rows.columns, *[(F.col(f"in {k}") + F.col(f"off {k}")).alias(k) for k in sums])


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """of, source_size (the rows of sources) with target, the source's share of the mix in words, and budget, its whole words.

    Sources share by weight in their order and stop at most times their size; what that leaves is shared among the others again,
    until none is above its stop. So those not stopped have one level, words for each unit of weight. In the order of stops
    for each unit of weight, a source is stopped if the level of all from it on is at or above its own stop: two running sums
    tell that for all at once. All numbers are whole until the last division.
    """
    ranked = running(sources, [F.col("of") == "", F.col("of")], {"place": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*[big(F.lit(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("weight", weight).withColumn("stop", big(F.col("source_size") * most))
    weighed = checkpointed(weighed.withColumn("unit", F.expr(f"cast(stop * {lcm(*weights)} as decimal(34,0)) div cast(weight as decimal(8,0))")))
    total = weighed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    mix, all_weights = (total.words or 0) * share.numerator, int(total.weights or 0)  # in parts of a word
    added = running(weighed, [F.col("unit"), F.col("of")], {"stops": F.col("stop"), "lighter": F.col("weight")})
    left, heavier = F.lit(mix) - F.col("stops") * share.denominator, F.lit(all_weights) - F.col("lighter")
    stopped = big(left) * F.col("weight").cast("decimal(8,0)") >= F.col("stop") * share.denominator * heavier.cast("decimal(7,0)")
    marked = checkpointed(added.withColumn("stopped", stopped))
    rest = marked.agg(F.sum(F.when(F.col("stopped"), F.col("stop"))).alias("stops"), F.sum(F.when(~F.col("stopped"), F.col("weight"))).alias("weights")).first()
    part = big(F.lit(mix - int(rest.stops or 0) * share.denominator)) * F.col("weight").cast("decimal(8,0)")
    shared = marked.withColumn("part", part).withColumn("parts", big(F.lit(max(1, int(rest.weights or 0)) * share.denominator)))
    target = F.when(F.col("stopped"), F.col("stop").cast("double")).otherwise(F.col("part").cast("double") / F.col("parts").cast("double"))
    return shared.select("of", "source_size", target.alias("target"), F.when(F.col("stopped"), F.col("stop").cast("long")).otherwise(F.expr("cast(part div parts as bigint)")).alias("budget"))


def keys(seed: str = SEED) -> dict[str, Column]:
    """of (the source's name after '=', empty for null), key: 128 random bits by id and text."""
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))))
    return {"of": name, "key": key}


def keyed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    return docs.select("doc_id", words(F.col("text")).alias("size"), *[c.alias(k) for k, c in keys(seed).items()])


def allotted(rows: DataFrame) -> DataFrame:
    """For each different row of keyed(): n (how often it occurs), source_size, target, epochs that all its copies are taken
    whole, more (copies taken once more) and part (words of one copy more), by the order of keys in its source."""
    rows = checkpointed(rows)
    bits = min(MOST_BITS, max(0, rows.count() // RANGE_ROWS).bit_length())
    first = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    ranged = rows.withColumn("range", F.shiftright(first, 32 - bits))
    sources = checkpointed(rows.groupBy("of").agg(F.sum("size").alias("source_size")))
    shares = targets(sources)
    sums = ranged.groupBy("of", "range").agg(F.sum("size").alias("range_size"))
    met = sums.join(F.broadcast(shares) if sources.count() <= FEW_SOURCES else shares, "of")
    before = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most 2^MOST_BITS rows
    ranges = met.withColumn("off", F.coalesce(F.sum("range_size").over(before), F.lit(0))).drop("range_size")
    different = ranged.groupBy("of", "range", "key", "doc_id", "size").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("of", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = different.withColumn("inside", F.coalesce(F.sum(F.col("n") * F.col("size")).over(inside), F.lit(0))).join(ranges, ["of", "range"])
    placed = placed.withColumn("epochs", F.expr("if(source_size = 0, 0, budget div source_size)"))
    placed = placed.withColumn("words", F.expr("greatest(0, least(n * size, budget - epochs * source_size - off - inside))"))
    placed = placed.withColumn("more", F.expr("if(size = 0, 0, words div size)"))
    return placed.select("of", "key", "doc_id", "size", "n", "source_size", "target", "epochs", "more", (F.col("words") - F.col("more") * F.col("size")).alias("part"))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken. docs: doc_id, text, source.

    Sizes and taken are words, runs of other characters than ASCII space; a null text has none. Sources come by code point,
    a null one last and apart from the empty one. Target is the source's share (targets()); the words taken of its documents
    sum up to target without its fraction. The document at the cut gives its first words. Rows that repeat are documents of
    their own, also if ids are null. The same rows give the same answer whatever their order and partitions; another seed
    gives another mix. Further columns are ignored; an empty table gives no rows; texts without words are taken with 0 words.
    """
    found = checkpointed(allotted(keyed(docs, seed)))
    of_copies = F.array(
        F.struct(F.col("more").alias("copies"), F.expr("(epochs + 1) * size").alias("taken")),
        F.struct(F.expr("if(part > 0, 1L, 0L)").alias("copies"), F.expr("epochs * size + part").alias("taken")),
        F.struct(F.expr("n - more - if(part > 0, 1L, 0L)").alias("copies"), F.expr("epochs * size").alias("taken")),
    )
    alike = found.select("doc_id", "size", "source_size", "target", F.explode(F.filter(of_copies, lambda c: c["copies"] > 0)).alias("c")).select("*", "c.*").drop("c")
    some = alike.filter(F.col("copies") <= COPIES)
    many = alike.filter(F.col("copies") > COPIES).withColumn("chunk", F.explode(F.expr(f"sequence(0, (copies - 1) div {COPIES})")))
    many = many.withColumn("copies", F.expr(f"least({COPIES}, copies - chunk * {COPIES})")).repartition("chunk").drop("chunk")
    each = some.unionByName(many).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: one row per different id, source and text that it takes, with doc_id, source, text, times (how often the
    whole text is in the mix) and rest (the words at its begin that are in the mix once more, else empty)."""
    texts = docs.select("doc_id", "source", "text", *[c.alias(k) for k, c in keys(seed).items()]).dropDuplicates(["of", "key"])
    found = allotted(keyed(docs, seed)).withColumn("times", F.expr("n * epochs + more")).filter("times + part > 0")
    rest = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("part").cast("int")), " ")
    return texts.join(found.select("of", "key", "times", "part"), ["of", "key"]).select("doc_id", "source", "text", "times", rest.alias("rest"))


def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS of, len(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents
), s AS (
  SELECT of, sum(size) AS source_size, [2, 3, 1][(row_number() OVER (ORDER BY of = '', of)) % 3 + 1]::HUGEINT AS w FROM d GROUP BY of
), ordered AS (
  SELECT *, (SELECT sum(size) FROM d) * 3 - 2 * coalesce(sum(2 * source_size) OVER before, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS heavier
  FROM s WINDOW before AS (ORDER BY source_size * 12 // w, of ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), stopped AS (SELECT *, w * rest >= 4 * source_size * heavier AS is_stopped FROM ordered),
level AS (
  SELECT (SELECT sum(size) FROM d) * 3 - coalesce(sum(4 * source_size) FILTER (WHERE is_stopped), 0) AS rest, greatest(1, coalesce(sum(w) FILTER (WHERE NOT is_stopped), 0)) * 2 AS parts FROM stopped
), t AS (
  SELECT of, source_size, CASE WHEN is_stopped THEN 2.0::DOUBLE * source_size ELSE (w * level.rest)::DOUBLE / parts::DOUBLE END AS target,
         CASE WHEN is_stopped THEN 2 * source_size ELSE w * level.rest // parts END AS budget FROM stopped, level
), placed AS (
  SELECT d.*, source_size, target, budget, CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size END AS epochs,
         coalesce(sum(size) OVER (PARTITION BY of ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t USING (of)
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM placed
"""
