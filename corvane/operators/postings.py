"""A stored inverted index, and BM25 over prefix terms for many questions at once, with statistics of each layer."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.operators.storage import kept, new_folder, remove, replace

#: Fixed by the ranking function.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Rows of terms or tokens that are broadcast; more meet by a shuffle.
MOST_BROADCAST = 100_000
#: So many terms are looked up by the ranges of postings that have their prefixes.
FEW_TERMS = 64
#: Chunks of a run whose largest parts are known, runs that are searched together, parts of scores in a task, questions at once.
RUN, RUNS_TOGETHER, PARTS_TOGETHER, QUESTIONS = 64, 16, 1_000_000, 20_000
#: Postings that a task sorts, adds up or searches at once.
POSTINGS_TOGETHER = 1_000_000
#: A term that more than one of so many chunks of a block have is added up for all of them, another one for those that have it.
DENSE = 8
#: How the index is stored: ids and counts as differences, as they are sorted.
STORED = {"compression": "zstd", "parquet.writer.version": "v2"}
#: Accented letters that word search reads as plain ones, and their plain forms.
ACCENTED, PLAIN = "áàâãäåçéèêëíìîïñóòôõöúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def tokens(text):
    """Runs of letters and digits, in lower case and without accents."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), 0)


class Index:
    """A stored inverted index: in folder, postings (layer, id, token, tf) in ranges sorted by token, so that a prefix reads few
    of them; tokens, each once; chunks (layer, id, doc_len); forward (layer, id, words), a row for each chunk with its tokens and
    their numbers in order, which searches for many terms read. layer and id are named as in the chunks that were written.
    """

    def __init__(self, spark: SparkSession, folder: str, id_col: str, layer: str = "layer"):
        self.spark, self.folder, self.id_col, self.layer = spark, folder, id_col, layer

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def stats(self) -> DataFrame:
        """layer, n_docs, avg_len."""
        return self.table("chunks").groupBy(self.layer).agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))

    def size(self) -> int:
        """The number of postings."""
        return self.table("postings").count()

    def named(self, found: DataFrame) -> DataFrame:
        """found (layer, id, ...) with what the index calls its chunks outside."""
        return found

    def drop(self) -> None:
        remove(self.spark, self.folder)


class LayeredIndex(Index):
    """The indexes of several layers, each a segment that is never changed, read as one. dead (id, layer): chunks that a layer
    has taken away from those below it; they are left out of postings, lengths and so of all statistics. names (layer, id, ...):
    what is found is given with these columns in place of the id."""

    def __init__(self, segments: list[Index], dead: DataFrame, names: DataFrame | None = None):
        first = segments[0]
        super().__init__(first.spark, first.folder, first.id_col, first.layer)
        self.segments, self.names = segments, names
        self.dead = kept(dead.select(F.col(self.id_col).alias("_dead"), F.col("layer").alias("_by")))
        self.few_dead = self.dead.count() <= MOST_BROADCAST

    def size(self) -> int:
        return sum(s.size() for s in self.segments)

    def named(self, found: DataFrame) -> DataFrame:
        return found if self.names is None else found.join(self.names, [self.layer, self.id_col]).drop(self.id_col)

    def table(self, name: str) -> DataFrame:
        parts = [s.table(name) if name == "tokens" else s.table(name).withColumn(self.layer, F.lit(i).cast("long")) for i, s in enumerate(self.segments)]
        rows = reduce(DataFrame.unionByName, parts)
        if name == "tokens":  # one that only dead chunks had meets no posting
            return rows.distinct()
        dead = F.broadcast(self.dead) if self.few_dead else self.dead
        return rows.join(dead, (rows[self.id_col] == dead["_dead"]) & (dead["_by"] > rows[self.layer]), "left_anti")

    def merged(self, folder: str) -> Index:
        """One segment of all living postings, again in ranges sorted by token, which no later search reads dead chunks of."""
        out = Index(self.spark, folder, self.id_col, self.layer)
        flat = lambda name: self.table(name).withColumn(self.layer, F.lit(0).cast("long"))
        flat("chunks").write.parquet(f"{folder}/chunks")
        flat("forward").write.options(**STORED).parquet(f"{folder}/forward")
        write_postings(out)
        return out


def token_runs(chunks: DataFrame, id_col: str, text_cols: list[str], layer: str = "layer") -> DataFrame:
    """layer, id, words: each row's tokens in order with their number. They are sorted and counted within their row, so no text is
    shuffled and nothing larger than a row is held."""
    rows = chunks.select(layer, id_col, F.sort_array(F.concat(*[tokens(F.col(c)) for c in text_cols])).alias("_words"))
    begins = F.filter(F.transform("_words", lambda w, i: F.when(~w.eqNullSafe(F.get("_words", i - 1)), i)), lambda i: i.isNotNull())
    rows = rows.select(layer, id_col, "_words", begins.alias("_begins"))
    until = lambda i: F.coalesce(F.get("_begins", i + 1), F.size("_words"))
    return rows.select(layer, id_col, F.transform("_begins", lambda at, i: F.struct(F.get("_words", at).alias("token"), (until(i) - at).cast("long").alias("tf"))).alias("words"))


def counted_tokens(chunks: DataFrame, id_col: str, text_cols: list[str], layer: str = "layer") -> DataFrame:
    """layer, id, token, tf: the same, a row for each token, one with a null token where there is none."""
    return token_runs(chunks, id_col, text_cols, layer).select(layer, id_col, F.explode_outer("words").alias("_run")).select(layer, id_col, "_run.token", "_run.tf")  # the outer form, as the other one's filter would tokenise again


def tasks_for(spark: SparkSession, postings: int) -> int | None:
    """How many tasks so many postings need, so that a task's memory does not grow with them; none where Spark's own number is enough."""
    needed = -(-postings // POSTINGS_TOGETHER)
    return needed if needed > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(rows: DataFrame, tasks: int | None, *by: str) -> DataFrame:
    return rows.repartition(tasks, *by) if tasks else rows.repartition(*by)


def write_index(chunks: DataFrame, id_col: str, text_cols: list[str], folder: str | None = None, layer: str = "layer") -> Index:
    """Tokenises all text_cols of chunks (layer, id, ...) once and stores the index, in a new shared folder if none is given.

    Null and empty texts make chunks of length 0. Rows that repeat layer and id are one chunk; the counts of these alone are
    added up by a shuffle.
    """
    spark = chunks.sparkSession
    index = Index(spark, folder or new_folder(spark), id_col, layer)
    texts = chunks.select(layer, id_col, *dict.fromkeys(text_cols))
    cores = spark.sparkContext.defaultParallelism
    token_runs(texts if texts.rdd.getNumPartitions() >= cores else texts.repartition(cores), id_col, text_cols, layer).write.options(**STORED).parquet(f"{index.folder}/forward")
    rows = index.table("forward")
    repeated = kept(rows.groupBy(layer, id_col).count().filter("count > 1").select(F.col(layer).alias("_layer"), F.col(id_col).alias("_id")))
    if not repeated.isEmpty():
        same = F.col(layer).eqNullSafe(F.col("_layer")) & F.col(id_col).eqNullSafe(F.col("_id"))
        added = rows.join(repeated, same, "left_semi").select(layer, id_col, F.explode_outer("words").alias("_run")).groupBy(layer, id_col, "_run.token").agg(F.sum("_run.tf").alias("tf"))
        added = added.groupBy(layer, id_col).agg(F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("token", "tf")))).alias("words"))
        rows.join(repeated, same, "left_anti").unionByName(added).write.options(**STORED).parquet(f"{index.folder}/whole")
        replace(spark, f"{index.folder}/forward", f"{index.folder}/whole")
    doc_len = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + w["tf"])
    index.table("forward").select(layer, id_col, doc_len.alias("doc_len")).write.parquet(f"{index.folder}/chunks")
    write_postings(index)
    return index


def write_postings(index: Index) -> None:
    """Postings of the forward table in ranges by token, layer and id, so a token of any frequency is spread over tasks; tokens."""
    layer, id_col = index.layer, index.id_col
    rows, by = index.table("forward"), ("token", layer, id_col)
    tasks = tasks_for(index.spark, rows.agg(F.sum(F.size("words"))).first()[0] or 0)
    found = rows.select(layer, id_col, F.explode("words").alias("_run")).select(layer, id_col, "_run.token", "_run.tf")
    ranged = found.repartitionByRange(tasks, *by) if tasks else found.repartitionByRange(*by)
    ranged.sortWithinPartitions(*by).write.options(**STORED).parquet(f"{index.folder}/postings")
    index.table("postings").select("token").distinct().write.parquet(f"{index.folder}/tokens")


def folded(term: Column) -> Column:
    return F.translate(F.lower(term), ACCENTED, PLAIN)


def term_parts(index: Index, wanted: DataFrame) -> DataFrame:
    """_term, layer, id, part: what each of wanted (_term, each once, checkpointed) adds to the score of each chunk that has it.

    A few terms are looked up by ranges of tokens; more of them meet the index's distinct tokens by equal prefixes, and the
    found tokens meet the postings.
    """
    layer, id_col = index.layer, index.id_col
    shape = wanted.agg(F.count("*").alias("n"), F.collect_set(F.char_length("_term")).alias("lengths")).first()
    few = F.broadcast if shape.n <= MOST_BROADCAST else lambda df: df
    stored = index.table("postings")
    if shape.n <= FEW_TERMS:  # ranges without these prefixes are not read
        some = [r[0] for r in wanted.select("_term").collect()]
        read = stored.filter(reduce(lambda a, b: a | b, [F.col("token").startswith(t) for t in some], F.lit(False)))
        met = read.select("*", F.explode(F.filter(F.array(*map(F.lit, some)).cast("array<string>"), lambda t: F.col("token").startswith(t))).alias("_term"))
    else:
        starts = F.array(*[F.when(F.char_length("token") >= n, F.substring("token", 1, n)) for n in sorted(shape.lengths)])  # as many as terms may have letters
        found = index.table("tokens").select("token", F.explode(F.array_compact(starts)).alias("_term"))
        found = kept(found.join(few(wanted), "_term"))
        met = stored.join(F.broadcast(found) if found.count() <= MOST_BROADCAST else found, "token")
    met = dealt(met.select("_term", layer, id_col, "tf"), tasks_for(index.spark, index.size()), layer, id_col)  # all that follows is by chunk
    hits = met.groupBy("_term", layer, id_col).agg(F.sum("tf").cast("double").alias("f"))
    seen = hits.groupBy("_term", layer).agg(F.count("*").alias("n"))
    n, f = F.col("n"), F.col("f")
    idf = F.greatest(F.lit(IDF_FLOOR), F.log((F.col("n_docs") - n + 0.5) / (n + 0.5)))
    part = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("doc_len") / F.col("avg_len")))
    weighed = hits.join(few(seen), ["_term", layer]).join(F.broadcast(index.stats()), layer).join(index.table("chunks"), [layer, id_col])  # a row for each layer
    return weighed.select("_term", layer, id_col, part.alias("part"))


def bm25(index: Index, questions: DataFrame, groups: str = "groups", match_all: bool = True, by: str = "query_id") -> DataFrame:
    """by, layer, id, score (lower is better) of all chunks that match each question: every group of prefixes if match_all, else any.

    questions: by, each once, and groups (arrays of arrays of terms). All questions are answered together; only matching
    chunks go on. keyword_search() gives the best ones without making a row of each match.
    """
    layer, id_col = index.layer, index.id_col
    terms = questions.select(by, F.size(groups).alias("_n_groups"), F.posexplode(groups).alias("_group", "_terms")).select(by, "_n_groups", "_group", F.explode("_terms").alias("_term"))
    terms = terms.groupBy(by, folded(F.col("_term")).alias("_term")).agg(F.first("_n_groups").alias("_n_groups"), F.collect_set("_group").alias("_groups"))
    wanted = kept(terms)
    few = F.broadcast if wanted.count() <= MOST_BROADCAST else lambda df: df
    asked = few(wanted).join(term_parts(index, kept(wanted.select("_term").distinct())), "_term")
    scored = asked.groupBy(by, layer, id_col).agg(F.array_sort(F.collect_list(F.struct("_term", "part"))).alias("parts"), F.size(F.array_distinct(F.flatten(F.collect_list("_groups")))).alias("_found"), F.first("_n_groups").alias("_n_groups"))
    matched = scored.filter(F.col("_found") == F.col("_n_groups")) if match_all else scored
    return index.named(matched.select(by, layer, id_col, (-F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["part"])).alias("score")))  # the same sum for equal parts


class Block:
    """A task's parts of one layer: its chunks in order, and of each term the chunks (as places) that have it, with their parts,
    where each run of RUN places begins among them, and the largest part of each run."""

    def __init__(self, ids: pa.Array, terms: np.ndarray, places: np.ndarray, parts: np.ndarray):
        self.ids, self.runs = ids, -(-len(ids) // RUN)
        order = np.lexsort((places, terms))
        terms, places, parts = terms[order], places[order], parts[order]
        self.lists = {}
        bounds = np.flatnonzero(np.diff(terms, prepend=-1, append=-1))
        for a, b in zip(bounds, bounds[1:], strict=False):
            begin = np.searchsorted(places[a:b], np.arange(self.runs + 1) * RUN)
            most = np.zeros(self.runs)
            full = np.flatnonzero(np.diff(begin))
            most[full] = np.maximum.reduceat(parts[a:b], begin[full])
            self.lists[int(terms[a])] = places[a:b], parts[a:b], begin, most

    def best(self, asked: list[tuple[int, int]], need: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and sums of the k best chunks. asked: terms in order, with the groups that each is in as bits; need: the groups
        that a chunk must have, 0 for any. Runs come by the sum of their largest parts, which no chunk of theirs exceeds, also
        in rounded numbers, as parts are added in one order; the first that can't reach the k-th best ends the search."""
        own = [(self.lists[t], bits) for t, bits in asked if t in self.lists]
        bound, having = np.zeros(self.runs), np.zeros(self.runs, dtype=np.int64)
        for (_, _, _, most), bits in own:
            bound += most
            having |= np.where(most > 0, bits, 0)
        runs = np.flatnonzero((having & need) == need if need else having > 0)
        runs = runs[np.argsort(-bound[runs], kind="stable")]
        places, sums = np.zeros(0, dtype=np.int64), np.zeros(0)
        for at in range(0, len(runs), RUNS_TOGETHER):
            some = runs[at : at + RUNS_TOGETHER]
            if len(sums) == k and bound[some[0]] < sums[-1]:
                break
            score, found = np.zeros(len(some) * RUN), np.zeros(len(some) * RUN, dtype=np.int64)
            for (where, parts, begin, _), bits in own:
                sizes = begin[some + 1] - begin[some]
                at_part = np.repeat(begin[some] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                slot = where[at_part] - np.repeat((some - np.arange(len(some))) * RUN, sizes)
                score[slot] += parts[at_part]
                found[slot] |= bits
            hit = np.flatnonzero((found & need) == need if need else found > 0)
            places = np.concatenate([places, some[hit // RUN] * RUN + hit % RUN])
            sums = np.concatenate([sums, score[hit]])
            order = np.lexsort((places, -sums))[:k]
            places, sums = places[order], sums[order]
        return places, sums


def best_of_tasks(parts: DataFrame, index: Index, asks: list[tuple], k: int, by: str, by_type: str) -> DataFrame:
    """by, strict, layer, id, score of the k best of each ask, layer and task. parts as term_parts(), all of a chunk in one
    task; asks: by, strict, terms in order with their groups' bits, groups needed."""
    layer, id_col = index.layer, index.id_col
    id_type = parts.schema[id_col].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        terms = rows.column("_term").combine_chunks().dictionary_encode()
        code = {t: i for i, t in enumerate(terms.dictionary.to_pylist())}
        term, part = terms.indices.to_numpy(), rows.column("part").to_numpy()
        of_layer = rows.column(layer).to_numpy()
        for number in np.unique(of_layer).tolist():
            own = np.flatnonzero(of_layer == number)
            ids = rows.column(id_col).take(pa.array(own)).combine_chunks()
            distinct = ids.unique()
            distinct = distinct.take(pc.sort_indices(distinct))
            block = Block(distinct, term[own], pc.index_in(ids, distinct).to_numpy().astype(np.int64), part[own])
            for question, strict, wanted, need in asks:
                places, sums = block.best([(code[t], bits) for t, bits in wanted if t in code], need, k)
                if len(places):
                    n = len(places)
                    yield pa.RecordBatch.from_arrays([pa.array([question] * n), pa.array([strict] * n), pa.array([number] * n, pa.int64()), distinct.take(pa.array(places)), pa.array(-sums)], names=[by, "strict", layer, id_col, "score"])

    return parts.mapInArrow(search, f"{by} {by_type}, strict boolean, {layer} long, {id_col} {id_type}, score double")


class Prefixes:
    """Sought terms, in order, and which of them tokens begin with."""

    def __init__(self, terms: list[str]):
        self.by_length: dict[int, list[int]] = {}
        for i, t in enumerate(terms):
            self.by_length.setdefault(len(t), []).append(i)
        self.sets = {n: pa.array([terms[i] for i in own]) for n, own in self.by_length.items()}

    def of(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many terms each token has, and these terms, token by token."""
        places, codes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for n, terms in self.sets.items():
            found = pc.index_in(pc.utf8_slice_codeunits(tokens, 0, n), value_set=terms)
            places.append(np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)))
            codes.append(np.array(self.by_length[n])[found.drop_null().to_numpy()])
        place = np.concatenate(places)
        return np.bincount(place, minlength=len(tokens)), np.concatenate(codes)[np.argsort(place, kind="stable")]

    def counts(self, words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """term, place, f in order of term and place: how many tokens of each chunk's words begin with each term."""
        n, runs = max(1, len(words)), words.flatten()
        tokens, tf = runs.field(0).dictionary_encode(), runs.field(1).to_numpy(zero_copy_only=False)
        sizes, codes = self.of(tokens.dictionary)
        begin = np.cumsum(sizes) - sizes
        token = tokens.indices.to_numpy()
        many = sizes[token]
        at = np.repeat(begin[token] - np.cumsum(many) + many, many) + np.arange(many.sum())
        key = codes[at] * n + np.repeat(np.repeat(np.arange(len(words)), words.value_lengths().to_numpy()), many)
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        f = np.add.reduceat(np.repeat(tf, many)[order], first).astype(np.float64) if len(first) else np.zeros(0)
        key = key[order][first]
        return key // n, key % n, f


def in_blocks(batches: Iterator[pa.RecordBatch], layer: str, id_col: str) -> Iterator[tuple[int, pa.Table]]:
    """layer, rows: the chunks of one layer, in order of ids, that have some POSTINGS_TOGETHER postings together."""

    def by_layer(parts: list[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        rows = pa.Table.from_batches(parts)
        numbers = rows.column(layer).to_numpy()
        for number in np.unique(numbers).tolist():
            own = rows.take(pa.array(np.flatnonzero(numbers == number)))
            yield number, own.take(pc.sort_indices(own, sort_keys=[(id_col, "ascending")], null_placement="at_start"))

    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(batch.column("words").value_lengths().to_numpy())
        at = 0
        while at < len(batch):
            before = ends[at - 1] if at else 0
            until = max(at + 1, int(np.searchsorted(ends, before + POSTINGS_TOGETHER - size, "right")))
            held.append(batch.slice(at, until - at))
            size += int(ends[until - 1] - before)
            at = until
            if size >= POSTINGS_TOGETHER or at < len(batch):
                yield from by_layer(held)
                held, size = [], 0
    if held:
        yield from by_layer(held)


def chunks_with(index: Index, rows: DataFrame, terms: list[str]) -> DataFrame:
    """layer, _term, n: how many chunks of the forward rows have each term."""
    layer, id_col = index.layer, index.id_col

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes, found = Prefixes(terms), {}
        for number, block in in_blocks(batches, layer, id_col):
            term, _, _ = prefixes.counts(block.column("words").combine_chunks())
            found[number] = found.get(number, 0) + np.bincount(term, minlength=len(terms))
        for number, n in found.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(some), pa.int64()), pa.array([terms[i] for i in some], pa.string()), pa.array(n[some], pa.int64())], names=[layer, "_term", "n"])

    return rows.select(layer, id_col, "words").mapInArrow(count, f"{layer} long, _term string, n long").groupBy(layer, "_term").agg(F.sum("n").alias("n"))


class Best:
    """A task's k best chunks of one layer for each of asks, as best_of_tasks() has them, with terms as codes."""

    def __init__(self, asks: list[tuple], n_terms: int, k: int):
        self.asks, self.k, self.n_terms = asks, k, n_terms
        self.least, self.found = np.full(len(asks), -np.inf), [[] for _ in asks]
        self.padded = np.full((len(asks), max([1, *(len(a[2]) for a in asks)])), n_terms)
        for row, ask in zip(self.padded, asks, strict=True):
            row[: len(ask[2])] = [t for t, _ in ask[2]]

    def add(self, ids: pa.Array, term: np.ndarray, place: np.ndarray, part: np.ndarray) -> None:
        """A block's chunks, in order of ids, and its parts in order of term and place. Questions whose best parts together
        can't reach their k-th best are left out; the others' parts are added up in order of terms, so equal parts have equal sums."""
        n, begin = len(ids), np.searchsorted(term, np.arange(self.n_terms + 1))
        most = np.zeros(self.n_terms + 1)
        there = np.flatnonzero(np.diff(begin))
        if len(there):
            most[there] = np.maximum.reduceat(part, begin[there])
        rows: dict[int, np.ndarray] = {}
        for i in there[np.diff(begin)[there] * DENSE > n].tolist():
            rows[i] = np.zeros(n)
            rows[i][place[begin[i] : begin[i + 1]]] = part[begin[i] : begin[i + 1]]
        bound = most[self.padded].sum(axis=1) * (1 + 1e-9)  # numbers are rounded in another order there
        total = np.empty(n)
        for q in np.flatnonzero((bound > 0) & (bound >= self.least)).tolist():
            _, _, wanted, need = self.asks[q]
            total.fill(0.0)
            for t, _ in wanted:
                if t in rows:
                    total += rows[t]
                elif most[t] > 0:
                    own = slice(begin[t], begin[t + 1])
                    total[place[own]] += part[own]
            if need:
                having = np.zeros(n, dtype=np.int64)
                for t, bits in wanted:
                    having[place[begin[t] : begin[t + 1]]] |= bits
                total[(having & need) != need] = 0.0
            if total.max() < self.least[q]:
                continue
            low = max(self.least[q], np.partition(total, n - self.k)[n - self.k]) if n > self.k else self.least[q]
            some = np.flatnonzero((total >= low) & (total > 0))
            some = some[np.lexsort((some, -total[some]))[: self.k]]
            known = self.found[q] + list(zip((-total[some]).tolist(), ids.take(pa.array(some)).to_pylist(), strict=True))
            self.found[q] = sorted(known, key=lambda x: (x[0], x[1] is not None, x[1]))[: self.k]
            if len(self.found[q]) == self.k:
                self.least[q] = -self.found[q][-1][0]


def best_of_forward(index: Index, rows: DataFrame, asks: list[tuple], weights: dict, k: int, by: str, by_type: str) -> DataFrame:
    """What best_of_tasks() gives, from rows of the forward table, which nothing is dealt for. weights: of each layer the mean
    length of its chunks and of each term its weight."""
    layer, id_col = index.layer, index.id_col
    id_type = rows.schema[id_col].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes, best = Prefixes(terms), {}
        for number, block in in_blocks(batches, layer, id_col):
            avg_len, idf = weights[number]
            words = block.column("words").combine_chunks()
            term, place, f = prefixes.counts(words)
            doc_len = block.column("doc_len").to_numpy()[place]
            part = idf[term] * f * (K1 + 1) / (f + K1 * (1 - B + B * doc_len / avg_len))
            if number not in best:
                best[number] = Best(coded, len(terms), k)
            best[number].add(block.column(id_col).combine_chunks(), term, place, part)
        for number, b in best.items():
            if flat := [(ask[0], ask[1], number, i, score) for ask, found in zip(coded, b.found, strict=True) for score, i in found]:
                yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*flat, strict=True)], names=[by, "strict", layer, id_col, "score"])

    terms = sorted({t for _, _, wanted, _ in asks for t, _ in wanted})
    code = {t: i for i, t in enumerate(terms)}
    coded = [(question, strict, [(code[t], bits) for t, bits in wanted], need) for question, strict, wanted, need in asks]
    doc_len = F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + w["tf"])
    return rows.select(layer, id_col, "words", doc_len.alias("doc_len")).mapInArrow(search, f"{by} {by_type}, strict boolean, {layer} long, {id_col} {id_type}, score double")


def search_forward(index: Index, questions: DataFrame, k: int, by: str, strict: str, relaxed: str) -> DataFrame:
    """by, strict, layer, id, score of the k best of each task: two passes over the forward table, one that counts the chunks which
    have each term and one that scores. A task holds the parts of a block of chunks, and the k best of each question."""
    layer = index.layer
    by_type = questions.schema[by].dataType.simpleString()
    asks = asks_of(questions, by, strict, relaxed)
    terms = sorted({t for _, _, wanted, _ in asks for t, _ in wanted})
    rows = index.table("forward")
    tasks = 2 * index.spark.sparkContext.defaultParallelism
    rows = rows.coalesce(tasks) if rows.rdd.getNumPartitions() > tasks else rows  # each task hands on k rows of each question
    stats = {r[layer]: (r.n_docs, r.avg_len) for r in index.stats().collect()}  # a row for each layer
    weights = {number: (avg_len, np.zeros(len(terms))) for number, (_, avg_len) in stats.items()}
    code = {t: i for i, t in enumerate(terms)}
    n = F.col("n")
    idf = F.greatest(F.lit(IDF_FLOOR), F.log((F.col("n_docs") - n + 0.5) / (n + 0.5)))
    for r in chunks_with(index, rows, terms).join(F.broadcast(index.stats()), layer).select(layer, "_term", idf.alias("idf")).toLocalIterator():
        weights[r[layer]][1][code[r["_term"]]] = r.idf
    return best_of_forward(index, rows, asks, weights, k, by, by_type)


def asks_of(questions: DataFrame, by: str, strict: str, relaxed: str) -> list[tuple]:
    """Questions as best_of_tasks() takes them."""
    folds = str.maketrans(ACCENTED, PLAIN)
    out = []
    for row in questions.select(by, strict, relaxed).collect():
        for groups, all_groups in ((row[1], True), (row[2], False)):
            bits: dict[str, int] = {}
            for i, group in enumerate(groups or []):
                for t in group:
                    t = t.lower().translate(folds)
                    bits[t] = bits.get(t, 0) | 1 << i
            if bits:
                out.append((row[0], all_groups, sorted(bits.items()), (1 << len(groups)) - 1 if all_groups else 0))
    return out


def keyword_search(index: Index, questions: DataFrame, k: int, by: str = "query_id", strict: str = "strict_groups", relaxed: str = "relaxed_groups") -> DataFrame:
    """The k best of each question and layer, with rank: strict matches, or relaxed ones (null: none) in layers without any strict match.

    Few terms: the parts of scores are dealt by chunk to tasks of PARTS_TOGETHER rows; each task answers all questions, a block of
    QUESTIONS of them at a time, with block-max pruning. Many terms: the forward table is searched where it lies, so nothing is
    made or dealt for matches. Either way a task hands on its k best of each question. A question has up to 62 groups.
    """
    from corvane.operators.retrieval import top_per_group

    layer, id_col = index.layer, index.id_col
    every = F.concat(F.coalesce(F.flatten(strict), F.array().cast("array<string>")), F.coalesce(F.flatten(relaxed), F.array().cast("array<string>")))
    wanted = kept(questions.select(F.explode(every).alias("_term")).select(folded(F.col("_term")).alias("_term")).distinct())
    blocks = max(1, -(-questions.count() // QUESTIONS))
    by_type = questions.schema[by].dataType.simpleString()
    some = lambda b: questions.filter(F.pmod(F.xxhash64(by), F.lit(blocks)) == b) if blocks > 1 else questions
    folder = new_folder(index.spark)
    try:
        if wanted.count() > FEW_TERMS:
            parts = [search_forward(index, some(b), k, by, strict, relaxed) for b in range(blocks)]
        else:
            term_parts(index, wanted).write.parquet(folder)
            rows = index.spark.read.parquet(folder)
            tasks = max(int(index.spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // PARTS_TOGETHER)
            rows = rows.repartition(tasks, layer, id_col)
            parts = [best_of_tasks(rows, index, asks_of(some(b), by, strict, relaxed), k, by, by_type) for b in range(blocks)]
        found = kept(reduce(DataFrame.unionByName, parts))
    finally:
        remove(index.spark, folder)
    answered = found.filter("strict").select(by, layer).distinct()
    chosen = found.filter("strict").unionByName(found.filter("not strict").join(answered, [by, layer], "left_anti")).drop("strict")
    return index.named(top_per_group(chosen, [by, layer], [F.asc("score"), F.asc(id_col)], k))
