"""Audit of how sources diverge within a language, by term counts in mergeable radix tries.

Each task counts its terms in radix tries, whose leaves count occurrences and documents for each source. Leaves go to prefix
ranges, where tries are merged; a walk in the order of UTF-8 bytes hands on what is kept. A second walk, with the sizes of the
groups at hand, streams what pairs of sources have in common and each group's best candidates, ties in the order of the walk.
Terms that only one source of a pair has depend on their count alone, so a histogram of counts for each group settles them; no
term is spread out over sources that lack it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corvane.llm.common import batches_of, checkpointed, forget, stored, table

#: Documents of a language that a kept term is in at least; terms listed for each group.
LEAST_DOCUMENTS, BEST = 3, 200
#: Parts that probabilities are counted in, and what is added to each count.
PARTS, ADDED = 1_000_000_000, 1
#: Bytes of text counted at once, a longer text alone; leaves that a task holds before it hands on its trie.
TEXT_BYTES, HELD_LEAVES = 4 << 20, 400_000
#: Leaves that arrive in a prefix range, about, leaves of a part of a trie that is handed on, rows of a batch.
RANGE_LEAVES, PART_LEAVES, ROWS = 250_000, 50_000, 20_000
#: Documents that prefix ranges are drawn from, about, leaves of these for each range, and bytes of a bound. They move bounds alone.
DRAWN_DOCUMENTS, DRAWN_LEAVES, BOUND_BYTES = 2_000, 12, 32
#: Bytes of a digit, and digits of a term. What follows these is one digit more, a number in the trie's sorted tails.
DIGIT, DIGITS = 8, 4
#: Groups up to which their table, of some 100 bytes each, is broadcast; more meet by a shuffle.
FEW_GROUPS = 10_000
#: Pairs of sources that a walk works on at once, and sums of pairs that it holds.
PAIRS_AT_ONCE, HELD_PAIRS = 1 << 20, 1 << 20
#: Bytes that belong to terms are letters and all beyond ASCII; A-Z become lower case, others, here 0, end a term.
LETTERS = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0 for b in range(256)], dtype=np.uint8)
LEAVES = "lang string, term binary, source string, count long, documents long"
#: Part of a trie within a prefix range: LEAVES in the order of bytes, as a compressed Arrow stream.
HANDED = "range int, leaves binary"
KEPT = "lang string, term binary, source string, count long, all long, first boolean"
STREAMED = "lang string, source string, part string, item binary, value long"


class Trie:
    """A radix trie of terms, by language, as columns. A term has a node for each DIGIT of its bytes.

    levels: of each level's nodes the parents (places in the level above; in the first one, in langs) and digits, sorted by
    both, so that each level is in the order of bytes. Digits are big-endian numbers, shorter ones filled up with 0, which is in no
    term; digits of the last level are places in tails. Leaves are entries of node (counted through all levels), group (place
    in groups), count and documents, sorted by the first two.
    """

    def __init__(self, langs: list[str], groups: list[tuple[str, str]], levels: list[tuple[np.ndarray, np.ndarray]], tails: list[bytes], leaves: np.ndarray):
        self.langs, self.groups, self.levels, self.tails, self.leaves = langs, groups, levels, tails, leaves

    @staticmethod
    def of(data: np.ndarray, begin: np.ndarray, size: np.ndarray, lang: np.ndarray, langs: list[str], groups: list[tuple[str, str]], leaves: np.ndarray) -> Trie:
        """Of terms in data, each with a chain of nodes to itself, until tries are merged. leaves: group, count and documents of each."""
        padded = np.concatenate([data, np.zeros(DIGIT, np.uint8)])
        windows = np.ndarray((len(data) + 1,), dtype=">u8", buffer=padded.tobytes(), strides=(1,))
        levels, own, node, offset = [], np.arange(len(begin)), np.zeros(len(begin), np.int64), 0
        place, tails = lang, []
        for d in range(DIGITS + 1):
            at, left = begin[own] + d * DIGIT, size[own] - d * DIGIT
            if d < DIGITS:
                digit = windows[at].astype(np.uint64) & FILLED[np.minimum(left, DIGIT)]
                ends = left <= DIGIT
            else:
                raw = data.tobytes()
                named = [raw[a : a + n] for a, n in zip(at.tolist(), left.tolist(), strict=True)]
                tails = sorted(set(named))
                number = {t: i for i, t in enumerate(tails)}
                digit, ends = np.array([number[t] for t in named], dtype=np.uint64), np.ones(len(own), dtype=bool)
            levels.append((place, digit))
            node[own[ends]] = offset + np.flatnonzero(ends)
            offset += len(own)
            own, place = own[~ends], np.flatnonzero(~ends)
            if not len(own):
                break
        return Trie(langs, groups, levels, tails, np.stack([node, *leaves]))

    @staticmethod
    def merged(tries: list[Trie]) -> Trie:
        """One trie of all: level by level nodes with one parent and one digit become one; their leaves add up."""
        langs, groups = sorted({x for t in tries for x in t.langs}), sorted({g for t in tries for g in t.groups})
        tails = sorted({x for t in tries for x in t.tails})
        of_lang, of_group, of_tail = ({x: i for i, x in enumerate(xs)} for xs in (langs, groups, tails))
        above = [np.array([of_lang[x] for x in t.langs], dtype=np.int64) for t in tries]
        nodes: list[list[np.ndarray]] = [[] for _ in tries]
        levels, offset = [], 0
        for d in range(max((len(t.levels) for t in tries), default=0)):
            having = [k for k, t in enumerate(tries) if len(t.levels) > d]
            digits = [tries[k].levels[d][1] if d < DIGITS else np.array([of_tail[x] for x in tries[k].tails], dtype=np.uint64)[tries[k].levels[d][1].astype(np.int64)] for k in having]
            distinct, digit = np.unique(np.concatenate(digits), return_inverse=True)
            key = np.concatenate([above[k][tries[k].levels[d][0]] for k in having]) * len(distinct) + digit
            keys, place = np.unique(key, return_inverse=True)
            levels.append((keys // len(distinct), distinct[keys % len(distinct)]))
            for k, own in zip(having, np.split(place, np.cumsum([len(x) for x in digits])[:-1]), strict=True):
                above[k] = own
                nodes[k].append(own + offset)
            offset += len(keys)
        leaves = []
        for t, own in zip(tries, nodes, strict=True):
            node, group, *counts = t.leaves
            names = np.array([of_group[g] for g in t.groups], dtype=np.int64)
            leaves.append(np.stack([np.concatenate([*own, np.zeros(0, np.int64)])[node], names[group], *counts]))
        return Trie(langs, groups, levels, tails, summed(np.concatenate([*leaves, np.zeros((4, 0), np.int64)], axis=1), max(1, len(groups))))

    def order(self) -> np.ndarray:
        """Of each node its place in a walk down from the root, by the bytes of terms: a term before all that it begins."""
        has = np.zeros(sum(len(p) for p, _ in self.levels), dtype=np.int64)
        has[self.leaves[0]] = 1
        cuts = np.cumsum([0, *(len(p) for p, _ in self.levels)])
        sizes = [has[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for d in range(len(sizes) - 1, 0, -1):
            sizes[d - 1] = sizes[d - 1] + np.bincount(self.levels[d][0], sizes[d], len(sizes[d - 1])).astype(np.int64)
        places = []
        for d, (parent, _) in enumerate(self.levels):
            before = np.cumsum(sizes[d]) - sizes[d]
            if d:
                first = np.searchsorted(parent, parent)  # of each node its first sibling
                before = before - before[first] + places[d - 1][parent] + has[cuts[d - 1] : cuts[d]][parent]
            places.append(before)
        return np.concatenate([*places, np.zeros(0, np.int64)])

    def terms(self, nodes: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Language and bytes of the terms that end in these nodes, which come in rising order."""
        cuts = np.cumsum([0, *(len(p) for p, _ in self.levels)])
        langs, terms = [np.zeros(0, np.int64)], [pa.array([], pa.large_binary())]
        for d in range(len(self.levels)):
            own = nodes[np.searchsorted(nodes, cuts[d]) : np.searchsorted(nodes, cuts[d + 1])] - cuts[d]
            digits = np.zeros((len(own), min(d + 1, DIGITS)), dtype=">u8")
            at, tails = own, None
            for up in range(d, -1, -1):
                parent, digit = self.levels[up]
                if up == DIGITS:
                    tails = digit[at].astype(np.int64)
                else:
                    digits[:, up] = digit[at]
                at = parent[at]
            flat = digits.view(np.uint8).reshape(len(own), DIGIT * digits.shape[1])
            if tails is not None:
                found = [x.tobytes() + self.tails[i] for x, i in zip(flat, tails.tolist(), strict=True)]
                terms.append(pa.array(found, pa.large_binary()))
            else:
                offsets = np.concatenate([[0], np.cumsum(np.count_nonzero(flat, axis=1))]).astype(np.int64)
                terms.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(flat[flat != 0])]))
            langs.append(at)
        return np.concatenate(langs), pa.concat_arrays(terms)

    def walk(self, least: int = 1, rows: int | None = None) -> Iterator[dict[str, pa.Array]]:
        """Columns lang, term, source, count, documents, all (the term's count in the language), first (whether it is the term's
        first entry), in the order of bytes, of the terms in at least least documents."""
        if not self.leaves.shape[1]:
            return
        node, group, count, documents = self.leaves
        nodes, begin, of = np.unique(node, return_index=True, return_inverse=True)
        enough = np.add.reduceat(documents, begin) >= least
        kept = np.flatnonzero(enough)
        if not len(kept):
            return
        lang, terms = self.terms(nodes[kept])
        place = np.cumsum(enough) - 1
        whole = np.add.reduceat(count, begin)
        entries = np.flatnonzero(enough[of])
        entries = entries[np.argsort(self.order()[node[entries]], kind="stable")]
        langs, sources = pa.array(self.langs, pa.string()), pa.array([s for _, s in self.groups], pa.string())
        rows = rows or ROWS
        for a in range(0, len(entries), rows):
            e = entries[a : a + rows]
            term = place[of[e]]
            yield {
                "lang": langs.take(pa.array(lang[term])), "term": terms.take(pa.array(term)).cast(pa.binary()), "source": sources.take(pa.array(group[e])), "count": pa.array(count[e]),
                "documents": pa.array(documents[e]), "all": pa.array(whole[of[e]]), "first": pa.array(e == begin[of[e]]),
            }


#: Masks that keep the first n bytes of a digit.
FILLED = np.array([((1 << 8 * n) - 1) << 8 * (DIGIT - n) for n in range(DIGIT + 1)], dtype=np.uint64)


def summed(leaves: np.ndarray, groups: int) -> np.ndarray:
    """Leaves with the counts of equal nodes and groups added up, sorted by both."""
    keys, place = np.unique(leaves[0] * groups + leaves[1], return_inverse=True)
    order = np.argsort(place, kind="stable")
    begin = np.flatnonzero(np.diff(place[order], prepend=-1))
    sums = [np.add.reduceat(c[order], begin) if len(begin) else c for c in leaves[2:]]
    return np.stack([keys // groups, keys % groups, *sums])


def trie_of_texts(langs: list[str], sources: list[str], texts: pa.Array) -> Trie:
    """The terms of some documents, counted."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    data, ends = LETTERS[raw], ends - ends[0]
    inside = np.concatenate([[False], data != 0, [False]])
    # a term begins where a letter follows none or a document begins, and ends likewise
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(data))]
    begins[edges] |= inside[1:-1][edges]
    stops[edges - 1] |= inside[1:-1][edges - 1]
    begin, size = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    size -= begin
    doc = np.searchsorted(ends, begin, "right") - 1
    names, groups = sorted(set(langs)), sorted(set(zip(langs, sources, strict=True)))
    of_lang, of_group = {x: i for i, x in enumerate(names)}, {g: i for i, g in enumerate(groups)}
    lang, group = np.array([of_lang[x] for x in langs], dtype=np.int64), np.array([of_group[g] for g in zip(langs, sources, strict=True)], dtype=np.int64)
    one = np.ones(len(begin), np.int64)
    # first a group for each document, whose entries each count one document
    found = Trie.merged([Trie.of(data, begin, size, lang[doc], names, [(names[la], f"{i:08}") for i, la in enumerate(lang)], np.stack([doc, one, one]))])
    order = np.array([int(i) for _, i in found.groups], dtype=np.int64)
    node, own, count, _ = found.leaves
    found.leaves = summed(np.stack([node, group[order[own]], count, np.ones_like(count)]), max(1, len(groups)))
    found.groups = groups
    return found


def trie_of_leaves(rows: pa.RecordBatch) -> Trie:
    """The terms of rows of LEAVES."""
    lang, source = (rows.column(c).dictionary_encode() for c in ("lang", "source"))
    terms = rows.column("term").cast(pa.large_binary())
    ends = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset : terms.offset + len(terms) + 1]
    data = np.frombuffer(terms.buffers()[2], np.uint8)
    pairs, group = np.unique(np.stack([lang.indices.to_numpy(), source.indices.to_numpy()]).astype(np.int64), axis=1, return_inverse=True)
    langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
    leaves = np.stack([group.ravel(), rows.column("count").to_numpy(), rows.column("documents").to_numpy()])
    return Trie.of(data, ends[:-1], np.diff(ends), lang.indices.to_numpy().astype(np.int64), langs, [(langs[a], sources[b]) for a, b in pairs.T.tolist()], leaves)


class Growing:
    """A trie that others are merged into, a number of them at a time: each leaf is merged anew a few times at most."""

    def __init__(self):
        self.tries: list[Trie] = []
        self.whole = 0

    def add(self, trie: Trie) -> int:
        """The number of leaves, some of them perhaps of one term."""
        self.tries.append(trie)
        n = sum(t.leaves.shape[1] for t in self.tries)
        if n > max(HELD_LEAVES, 2 * self.whole):
            self.tries = [Trie.merged(self.tries)]
            self.whole = n = self.tries[0].leaves.shape[1]
        return n

    def taken(self) -> Trie:
        out, self.tries, self.whole = Trie.merged(self.tries), [], 0
        return out


def as_rows(columns: dict[str, pa.Array], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[Trie]:
    """Tries of rows of lang, source, text, each of HELD_LEAVES or of a batch."""
    found = Growing()
    for batch in batches_of(batches, "text", TEXT_BYTES):
        if found.add(trie_of_texts(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))) > HELD_LEAVES:
            yield found.taken()
    yield found.taken()


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of lang, source, text to LEAVES."""
    for trie in counted(batches):
        yield from (as_rows(c, LEAVES) for c in trie.walk())


def cut_tries(bounds: list[tuple[bytes, bytes]]):
    """A map from lang, source, text to HANDED: each trie is cut where prefix ranges begin."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for trie in counted(batches):
            for columns in trie.walk(rows=PART_LEAVES):
                rows = as_rows(columns, LEAVES)
                langs, terms = rows.column("lang"), rows.column("term")
                key = lambda i: (langs[i].as_py().encode(), terms[i].as_py())  # noqa: B023, E731
                first, last = bisect_right(bounds, key(0)), bisect_right(bounds, key(rows.num_rows - 1))
                cuts = [0, *(bisect_left(range(rows.num_rows), b, key=key) for b in bounds[first:last]), rows.num_rows]
                for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False), first):
                    if a < b:
                        sink = pa.BufferOutputStream()
                        with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
                            writer.write_batch(rows.slice(a, b - a))
                        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["range", "leaves"])

    return cut


def merge_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All of a prefix range to KEPT entries of the terms that are kept."""
    found = Growing()
    for batch in batches:
        for leaves in batch.column(1):
            with pa.ipc.open_stream(leaves.as_buffer()) as stream:
                for rows in stream:
                    found.add(trie_of_leaves(rows))
    yield from (as_rows(c, KEPT) for c in found.taken().walk(LEAST_DOCUMENTS))


def prefix_ranges(docs: DataFrame) -> list[tuple[bytes, bytes]]:
    """Bounds of prefix ranges, by language and bytes of terms, that hold about as many leaves each as far as a draw tells."""
    n = docs.count()
    drawn = docs.sample(min(1.0, DRAWN_DOCUMENTS / max(1, n)), seed=1) if n > DRAWN_DOCUMENTS else docs
    leaves = checkpointed(drawn.mapInArrow(count_terms, LEAVES).select("lang", F.substring("term", 1, BOUND_BYTES).alias("begin")))
    ranges = max(docs.sparkSession.sparkContext.defaultParallelism, leaves.count() * max(1, n // DRAWN_DOCUMENTS) // RANGE_LEAVES)
    keys = sorted((r.lang.encode(), bytes(r.begin)) for r in leaves.orderBy(F.xxhash64("lang", "begin")).limit(ranges * DRAWN_LEAVES).collect())
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def kept_terms(docs: DataFrame) -> DataFrame:
    """KEPT entries in prefix ranges. docs: lang, source, text without nulls in lang and source."""
    bounds = prefix_ranges(docs)
    parts = docs.mapInArrow(cut_tries(bounds), HANDED)
    return checkpointed(parts.repartitionById(len(bounds) + 1, "range").mapInArrow(merge_range, KEPT))


def share(count: str, n: str) -> Column:
    """1 + floor(PARTS * (count + ADDED) / (n + ADDED * terms)), exact."""
    return F.expr(f"1 + cast(cast({PARTS}L as decimal(12,0)) * cast({count} + {ADDED} as decimal(24,0)) div cast({n} + {ADDED} * terms as decimal(24,0)) as bigint)")


def gain(p: str, q: str) -> Column:
    """floor((p - q)^2 / q), exact: both are at most PARTS + 1."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def gains(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Sums:
    """Sums by key, in int64. What is added is compressed from time to time."""

    def __init__(self):
        self.keys, self.values, self.n = [], [], 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys.append(keys)
        self.values.append(values)
        self.n += len(keys)
        if self.n > 4 * HELD_PAIRS:
            self.compress()

    def compress(self) -> tuple[np.ndarray, np.ndarray]:
        keys, values = np.concatenate([*self.keys, np.zeros(0, np.int64)]), np.concatenate([*self.values, np.zeros(0, np.int64)])
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        begin = np.flatnonzero(np.diff(keys, prepend=-1))
        sums = np.add.reduceat(values, begin) if len(begin) else values
        self.keys, self.values, self.n = [keys[begin]], [sums], len(begin)
        return self.keys[0], self.values[0]


class Walk:
    """A language's terms in the order of bytes: what pairs have in common, and the best candidates of each source."""

    def __init__(self, lang: str):
        self.lang, self.sums = lang, Sums()
        self.names: dict[str, int] = {}
        self.best: dict[int, list[tuple[int, bytes]]] = defaultdict(list)

    def take(self, terms: np.ndarray, sources: pa.DictionaryArray, p: np.ndarray, p0: np.ndarray, q: np.ndarray, items: pa.Array) -> None:
        """Entries of whole terms, in order. terms: rising numbers; p0: the share in its group of a term that it lacks; q: in all."""
        names = np.array([self.names.setdefault(n, len(self.names)) for n in sources.dictionary.to_pylist()], dtype=np.int64)
        source = names[sources.indices.to_numpy()]
        _, begin, of, size = np.unique(terms, return_index=True, return_inverse=True, return_counts=True)
        partners = size[of]
        at, ends = 0, np.cumsum(partners)
        while at < len(terms):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            a = np.repeat(np.arange(at, upto), partners[at:upto])
            step = np.arange(len(a)) - np.repeat(np.cumsum(partners[at:upto]) - partners[at:upto], partners[at:upto])
            b = begin[of[a]] + step
            a, b = a[a != b], b[a != b]
            value = gains(p[a], p[b]) - gains(p[a], p0[b]) - gains(p0[a], p[b]) + gains(p0[a], p0[b])
            self.sums.add(source[a] << 32 | source[b], value)
            at = upto
        above = np.flatnonzero(p > q)
        value = gains(p[above], q[above])
        order = np.lexsort((above, -value, source[above]))  # ties in the order of bytes
        above, value = above[order], value[order]
        own = source[above]
        place = np.arange(len(above)) - np.searchsorted(own, own)
        for s, v, item in zip(own[place < BEST].tolist(), value[place < BEST].tolist(), items.take(pa.array(above[place < BEST])).to_pylist(), strict=True):
            self.best[s].append((-v, item))
        for found in self.best.values():
            if len(found) > BEST:
                found.sort()
                del found[BEST:]

    def handed(self, sums_only: bool = False) -> Iterator[tuple]:
        names = list(self.names)
        keys, values = self.sums.compress()
        for k, v in zip(keys.tolist(), values.tolist(), strict=True):
            yield self.lang, names[k >> 32], "pair", names[k & 0xFFFFFFFF].encode(), v
        self.sums = Sums()
        if not sums_only:
            for s, found in self.best.items():
                for value, item in found:
                    yield self.lang, names[s], "term", item, -value


def walk_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (lang, term, source, p, p0, q), sorted, to STREAMED: parts of sums of pairs, candidates of terms."""
    now: Walk | None = None
    rest: pa.Table | None = None  # the last term's entries, which may go on in the next batch

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["lang", "source", "part", "item", "value"])

    def changes(column: pa.Array) -> np.ndarray:
        """Whether each value but the first differs from the one before."""
        return pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)

    def walked(entries: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nonlocal now
        new_lang = changes(entries.column("lang"))
        number = np.cumsum(np.concatenate([[0], new_lang | changes(entries.column("term"))]))
        cuts = [0, *(np.flatnonzero(new_lang) + 1).tolist(), entries.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = entries.slice(a, b - a)
            lang = own.column("lang")[0].as_py()
            if now is None or now.lang != lang:
                if now is not None and (rows := list(now.handed())):
                    yield out(rows)
                now = Walk(lang)
            now.take(number[a:b], own.column("source").dictionary_encode(), *(own.column(c).to_numpy() for c in ("p", "p0", "q")), own.column("term"))
            if now.sums.n > HELD_PAIRS and len(now.sums.compress()[0]) > HELD_PAIRS:
                yield out(list(now.handed(sums_only=True)))

    for batch in batches:
        if not batch.num_rows:
            continue
        entries = batch if rest is None else pa.concat_batches([rest, batch])
        fresh = np.flatnonzero(changes(entries.column("lang")) | changes(entries.column("term")))
        upto = int(fresh[-1]) + 1 if len(fresh) else 0
        rest = entries.slice(upto)
        if upto:
            yield from walked(entries.slice(0, upto))
    if rest is not None:
        yield from walked(rest)
    if now is not None and (rows := list(now.handed())):
        yield out(rows)


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank. docs: text, lang, source; a null reads as ''.

    Part 'pair': item is another source of the language, value how far the source's shares of terms lie from its shares. Part
    'term': item is one of the terms that the source uses more than its language does, the BEST ones by value. Terms are runs
    of letters and of characters beyond ASCII, A-Z in lower case; a language keeps those in LEAST_DOCUMENTS documents of it. Rows
    that repeat are documents of their own. A source without kept terms has pairs, but no terms; a language of one source has no
    pairs. Ranks count from 1, ties by the item's bytes. Further columns are ignored; an empty table gives no rows.
    """
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.col("text").cast("string"))
    kept = kept_terms(named)
    terms = kept.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("count").alias("n_lang"))
    histogram = checkpointed(kept.groupBy("lang", "source", "count").agg(F.count("*").alias("h")))
    sizes = histogram.groupBy("lang", "source").agg(F.sum(F.col("h") * F.col("count")).alias("n"), F.sum("h").alias("own"))
    groups = named.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one").join(sizes, ["lang", "source"], "left").join(terms, "lang", "left").na.fill(0, ["n", "own", "terms", "n_lang"])
    groups = checkpointed(groups.withColumn("p0", share("0", "greatest(n, 1 - terms)")))  # without terms nothing is weighed by it
    few = groups.count() <= FEW_GROUPS
    seen = groups.filter("n > 0").select("lang", "source", "n", "terms", "n_lang", "p0")
    placed = kept.join(F.broadcast(seen) if few else seen, ["lang", "source"]).select("lang", "term", "source", share("count", "n").alias("p"), "p0", share("all", "n_lang").alias("q"))
    if not few:  # the join has dealt them anew
        placed = placed.repartitionByRange("lang", "term")
    streamed, place = stored(placed.sortWithinPartitions("lang", "term").mapInArrow(walk_range, STREAMED))
    try:
        return checkpointed(ranked(streamed, histogram, groups, few))
    finally:
        forget(docs.sparkSession, [place])


def ranked(streamed: DataFrame, histogram: DataFrame, groups: DataFrame, few: bool) -> DataFrame:
    common = streamed.filter("part = 'pair'").groupBy("lang", "source", F.col("item").cast("string").alias("other")).agg(F.sum("value").alias("value"))
    small = lambda df: F.broadcast(df) if few else df
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"), F.col("n").alias("n_other"), F.col("own").alias("own_other"))
    # terms that one of a pair has: all of its counts against the other's share of a term that it lacks, both ways
    counted = histogram.join(small(groups.select("lang", "source", "n", "terms", "p0")), ["lang", "source"]).withColumn("p", share("count", "n"))
    sided = counted.join(small(others), "lang").filter("source <> other")
    one = sided.groupBy("lang", "source", "other").agg(F.sum(F.col("h") * gain("p", "q0")).alias("as_p"), F.sum(F.col("h") * gain("q0", "p")).alias("as_q"))
    as_q = one.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.col("as_q").alias("value"))
    neither = groups.join(small(others), "lang").filter("source <> other").select("lang", "source", "other", ((F.col("terms") - F.col("own") - F.col("own_other")) * gain("p0", "q0")).alias("value"))
    parts = reduce(DataFrame.unionByName, [common, one.select("lang", "source", "other", F.col("as_p").alias("value")), as_q, neither])
    pairs = parts.groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    best = lambda item: Window.partitionBy("lang", "source").orderBy(F.desc("value"), item)
    top = streamed.filter("part = 'term'").withColumn("rank", F.row_number().over(best("item"))).filter(F.col("rank") <= BEST)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best("item")).alias("rank"))
    return pairs.unionByName(top.withColumn("item", F.col("item").cast("string")))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         unnest([''] || regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), kept AS (SELECT lang, term FROM d WHERE term <> '' GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
groups AS (SELECT DISTINCT lang, source FROM d),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0)::HUGEINT AS n FROM groups g JOIN kept k USING (lang)
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM d GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT *, 1 + 1000000000 * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p,
         sum(n) OVER (PARTITION BY lang, term) AS n_all, sum(n) OVER (PARTITION BY lang) AS n_lang, count(*) OVER (PARTITION BY lang, source) AS v FROM dense
), q AS (SELECT *, 1 + 1000000000 * (n_all + 1) // (n_lang + v) AS q FROM p),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM q x JOIN q y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
), terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM q WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT *, 'term', row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms QUALIFY rank <= 200
)
"""
