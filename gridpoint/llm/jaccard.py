"""N-gram Jaccard join by size-aware heavy-light search; links make components.

Sets are hashes of word shingles under a seed that the driver draws for each run; results don't depend on it. Equal sets are one node, named by half of a
128-bit digest; where both halves don't agree for all sets of a name, those sets are named by the other half. Two sets
with a similarity of t or more share a key:
- light sets (fewer shingles than a boundary) enumerate the subsets of two in their prefix, the first n - ceil(t n) + 2
  shingles in one order for all documents;
- heavy sets, and light ones that a heavy one may match, scan inverted lists of their prefix of n - ceil(t n) + 1.
The order puts frequent shingles last, by bands of their counts over the whole corpus, so lists stay short; any fixed
order gives the same results. The boundary is where enumerating costs less than scanning, by sizes and list lengths.

Within a list nobody is paired with everybody. First each member meets the list's pivot, the member with the fewest rarer
shingles, and of all such pairs a set verifies the likeliest. Components follow. In long lists the components' plainest
members meet next, again and again, until none of them merges. Then only pairs of a list that are still in different
components are verified: all whose sizes and places in the order allow a link, so no link between components is lost and
groups of copies cost no pairs. Long lists are divided by size bands and blocks, so that no task holds one whole. Sets
are compared whole; a set with very many partners on either side is copied to several tasks.

Null and empty texts, and texts without a word, have an empty set, are linked with nothing and are their own component.
Texts with fewer words than a shingle are one shingle. Very long texts are read a piece at a time, whole. Repeated rows
fall together as equal sets. An empty table gives no row. Only the key and text columns are read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpoint.llm.common import U64, Bloom, bloom, bytes_of, in_parts, mix, run_seed, salted, shingle_sets, table, utf8, with_facts, written
from gridpoint.llm.components import connected_components

#: Shingles in so many documents are put behind the others, and again at every STEP times as many.
FREQUENT = 16
STEP = 8
MOST_LIGHT = 48
#: Longer lists are divided.
LONG = 4096


def overlap_least(n: np.ndarray | int, percent: int) -> np.ndarray:
    """The least number of shingles that a set of n shares with one that it links to."""
    return -(-np.asarray(n) * percent // 100)


def digests(shingles: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """A set's name and its other half."""
    name, other = struct.unpack("<qq", hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
    return name >> (64 - bits), other


class Namer:
    """Names sets. clashing: the names that several sets would have."""

    def __init__(self, clashing: frozenset = frozenset(), bits: int = 64):
        self.clashing, self.bits = clashing, bits

    def __call__(self, shingles: np.ndarray) -> int:
        name, other = digests(shingles, self.bits)
        return other if name in self.clashing else name


#: 64-bit words of a set's mark.
MARK = 4


def mark_of(shingles: np.ndarray) -> np.ndarray:
    """Which of 64 * MARK classes hold an odd number of a set's shingles. Two sets differ in as many shingles as their marks in bits, at least."""
    odd = np.bincount((shingles & U64(64 * MARK - 1)).astype(np.int64), minlength=64 * MARK) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def each_set(batch: pa.RecordBatch, size: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    yield from shingle_sets(*bytes_of(batch.column(1)), size, seed)


def halves(shingles: np.ndarray) -> np.ndarray:
    """The upper halves of hashes, by which shingles are counted."""
    return (shingles >> U64(32)).astype(np.int64)


def levels(shingles: np.ndarray, bands: list[Bloom]) -> np.ndarray:
    """The band of each shingle's count: in how many of the filters, each of which holds part of the one before."""
    out, at, own = np.zeros(len(shingles), np.int8), np.arange(len(shingles)), halves(shingles)
    for band in bands:
        at = at[band.holds(own[at])]
        if not len(at):
            break
        out[at] += 1
    return out


def ordered(sets: Iterator[np.ndarray], bands: list[Bloom], most: int = 200_000) -> Iterator[np.ndarray]:
    """Each set's shingles in the order of all documents; their bands are looked up for many sets at a time."""
    held, n = [], 0

    def out() -> Iterator[np.ndarray]:
        level = levels(np.concatenate(held), bands)
        edges = np.cumsum([0, *map(len, held)])
        for s, a, b in zip(held, edges[:-1], edges[1:]):
            own = level[a:b]
            yield s[np.argsort(own, kind="stable")] if own.any() else s

    for s in sets:
        held.append(s)
        n += len(s)
        if n >= most:
            yield from out()
            held, n = [], 0
    if held:
        yield from out()


def prefix_keys(shingles: np.ndarray, boundary: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """An ordered set's keys and their places: subsets of two (place -1) for a light set, shingles for a heavy one or one that a heavy one may match."""
    n = len(shingles)
    least = int(overlap_least(n, percent))
    single = shingles[: n - least + 1]
    places = np.arange(len(single), dtype=np.int32)
    if n >= boundary:
        return single, places
    start = shingles[: n - least + 2]
    i, j = np.triu_indices(len(start), 1)
    a, b = start[i], start[j]
    subsets = mix(np.minimum(a, b) * U64(0x9E3779B97F4A7C15) + np.maximum(a, b))
    alone = np.full(len(subsets), -1, np.int32)
    if n * 100 < boundary * percent:
        return subsets, alone
    return np.concatenate([subsets, single]), np.concatenate([alone, places])


def packed(values: np.ndarray) -> bytes:
    """Sorted numbers by their gaps, two bytes each; 65535 is a step without a number."""
    gaps = np.diff(values, prepend=0)
    steps = gaps // 65535
    out = np.full(int(steps.sum()) + len(gaps), 65535, "<u2")
    out[np.cumsum(steps + 1) - 1] = gaps % 65535
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, "<u2")
    return np.cumsum(gaps, dtype=np.int64)[gaps != 65535]


def boundary_by_cost(sizes: dict[int, int], scanned: float, percent: int) -> int:
    """The size from which scanning lists of the given mean length costs less than enumerating subsets of two."""
    best, at = None, 2
    ns = np.arange(2, MOST_LIGHT + 1)
    single = ns - overlap_least(ns, percent) + 1
    count = np.array([sizes.get(int(n), 0) for n in ns])
    enumerate_ = count * (single + 1) * single / 2
    scan = count * single * (1 + scanned)
    for boundary in range(2, MOST_LIGHT + 1):
        cost = enumerate_[ns < boundary].sum() + scan[ns >= boundary].sum() + scan[(ns < boundary) & (ns * 100 >= boundary * percent)].sum()
        if best is None or cost < best:
            best, at = cost, boundary
    return at


def runs_of(found: Iterator[pa.RecordBatch], least_rows: int = 200_000) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut only where the first column changes."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in found:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows += batch.num_rows
        if rows < least_rows:
            continue
        columns = [np.concatenate(c) for c in zip(*held)]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut:
            yield [c[:cut] for c in columns]
        held, rows = [[c[cut:] for c in columns]], len(columns[0]) - cut
        least_rows = max(least_rows, 2 * rows)
    if rows:
        yield [np.concatenate(c) for c in zip(*held)]


def shared_least(a, b, percent: int):
    """What two sets of these sizes share at least if they link; for numbers, arrays and columns."""
    return (a + b) * percent / (100 + percent)


def fits(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether a link is possible between sets of these sizes whose first shared key has these places."""
    sizes = np.minimum(a, b) * 100 >= np.maximum(a, b) * percent
    least = np.ceil(shared_least(a, b, percent) - 1e-6)
    return sizes & (at_a <= a - least) & (at_b <= b - least)


LISTS = "list long, node long, n int, place int, pivot long, pivot_n int, pivot_place int"


def lists_of(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (key, place, node, n), sorted, to lists of two or more different nodes, each with its first member, the pivot."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 40
    for key, place, node, n in runs_of(found):
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, place, node, n = key[fresh], place[fresh], node[fresh], n[fresh]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        lengths = np.diff(np.append(starts, len(key)))
        of = np.repeat(np.arange(len(starts)), lengths)
        keep = lengths[of] > 1
        first = starts[of]
        columns = [number + of[keep], node[keep], n[keep], place[keep], node[first][keep], n[first][keep], place[first][keep]]
        number += len(starts)
        names = [x.split()[0] for x in LISTS.split(", ")]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def cross_pairs(percent: int, near: int = 64):
    """Members of lists (list, component, node, n, place), sorted, to pairs of different components that may link."""

    def batch(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])

    def pairs(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for list_, component, node, n, place in runs_of(found):
            starts = np.flatnonzero(np.concatenate([[True], list_[1:] != list_[:-1]]))
            lengths = np.diff(np.append(starts, len(list_)))
            small = np.repeat(lengths <= near, lengths)
            for apart in range(1, int(min(lengths.max(), near))):  # members so many places apart, of all short lists at once
                i = np.flatnonzero(small[:-apart] & (list_[apart:] == list_[:-apart]) & (component[apart:] != component[:-apart]))
                i = i[fits(n[i], n[i + apart], place[i], place[i + apart], percent)]
                if len(i):
                    yield batch(node[i], node[i + apart])
            for s, e in zip(starts[lengths > near], (starts + lengths)[lengths > near]):
                for i in range(s, e - 1):
                    j = np.arange(i + 1, e)
                    j = j[(component[j] != component[i]) & fits(n[i], n[j], place[i], place[j], percent)]
                    if len(j):
                        yield batch(np.full(len(j), node[i]), node[j])

    return pairs


def divided(percent: int, longest: int):
    """Members of one long list, dealt: sets that may link have sizes of one band or of two that follow each other, and each
    pair of blocks of a band meets once. Adds band, lo, hi, and whether a member comes from the band below and its block."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int") if percent < 100 else F.col("n")
    blocks = F.ceil(F.col("m") / longest).cast("int")

    def deal(members: DataFrame) -> DataFrame:
        own = members.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        both = own.withColumn("below", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", band + F.col("below"))
        return both.select("list", "band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "below", "block", "component", "node", "n", "place")

    return deal


def block_pairs(percent: int):
    """Sorted rows of divided() to pairs of different components that may link."""

    def pairs(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in runs_of(found):
            task = columns[:4]
            fresh = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in task], axis=0)])
            edges = np.append(np.flatnonzero(fresh), len(fresh))
            for s, e in zip(edges[:-1], edges[1:]):
                below, block, component, node, n, place = (c[s:e] for c in columns[4:])
                crossing = columns[2][s] != columns[3][s]
                here = np.flatnonzero(below == 0)
                for i in here:
                    # members of this band once (a later one of the same block, or one of the other block), those of the band below always
                    j = np.flatnonzero((component != component[i]) & fits(n[i], n, place[i], place, percent) & ((block != block[i]) == crossing))
                    j = j[(below[j] == 1) | (node[j] > node[i])]
                    if len(j):
                        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(node[i], node[j])), pa.array(np.minimum(node[i], node[j]))], ["a", "b"])

    return pairs


def gathered(found: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """The same pairs, each once within a stretch, in larger batches."""
    held, n = [], 0

    def out() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).group_by(["a", "b"]).aggregate([]).combine_chunks()
        return pa.RecordBatch.from_arrays([whole.column(name).combine_chunks() for name in ("a", "b")], ["a", "b"])

    for batch in found:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield out()
            held, n = [], 0
    if held:
        yield out()


class Join:
    """The steps of a join over one table, each a DataFrame."""

    def __init__(self, df: DataFrame, key: str, text: str, size: int, percent: int, bits: int = 64):
        self.size, self.percent, self.namer, self.seed = size, percent, Namer(bits=bits), run_seed()
        self.docs = df.select(F.col(key).alias("key"), utf8(text).alias("text"))
        self.kind = df.schema[key].dataType.simpleString()
        self.spark = df.sparkSession

    def signatures(self) -> DataFrame:
        """key, n, node of every row; node is null for empty sets. Names that different sets would share are settled for all later steps."""
        size, seed, bits = self.size, self.seed, self.namer.bits

        def sign(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in in_parts(found):
                n, node, other = [0] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
                marks = np.zeros((batch.num_rows, MARK), np.int64)
                for i, s in each_set(batch, size, seed):
                    n[i] = len(s)
                    if len(s):
                        node[i], other[i] = digests(s, bits)
                        marks[i] = mark_of(s)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, node, other)), *map(pa.array, marks.T)], ["key", "n", "node", "other", *self_marks])

        self_marks = [f"m{k}" for k in range(MARK)]
        out = written(self.docs.mapInArrow(sign, f"key {self.kind}, n long, node long, other long, " + ", ".join(f"{m} long" for m in self_marks)), "signatures")
        several = out.groupBy("node").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low <> high")
        self.namer = Namer(frozenset(r["node"] for r in several.select("node").toLocalIterator()), bits)  # none among fewer than about 2**32 sets
        if self.namer.clashing:
            out = out.join(F.broadcast(several.select("node", F.lit(True).alias("clash"))), "node", "left").withColumn("node", F.when(F.col("clash"), F.col("other")).otherwise(F.col("node")))
        self.marks = out.where(F.col("node").isNotNull()).groupBy("node").agg(F.first("n").alias("n"), F.array(*(F.first(m) for m in self_marks)).alias("mark"))
        return out.select("key", "n", "node")

    def frequent(self, shingles: int, flush: int = 1_000_000, range_size: int = 2_000_000) -> DataFrame:
        """key, level: (halves of) shingles in FREQUENT documents or more, and how many STEPs beyond. A row without a key tells how many others recur, and how often.

        Tasks sort their shingles and send them by range, as gaps of two bytes; of one that a task has more than FREQUENT
        times it sends the number.
        """
        size, seed, most = self.size, self.seed, FREQUENT
        ranges = max(1, shingles // range_size)
        width = -(-(1 << 32) // ranges)

        def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
            return values[starts], np.diff(np.append(starts, len(values)))

        def emit(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0

            def out() -> pa.RecordBatch:
                values, times = runs(np.sort(np.concatenate(held)))
                many = np.flatnonzero(times > most)
                sent = np.repeat(values, np.minimum(times, most))
                edges, more = np.searchsorted(sent, np.arange(ranges + 1) * width), np.searchsorted(values[many], np.arange(ranges + 1) * width)
                some = np.flatnonzero(np.diff(edges))
                data = [packed(sent[edges[r] : edges[r + 1]] - r * width) for r in some]
                which = [(values[many[more[r] : more[r + 1]]] - r * width).astype("<u4").tobytes() for r in some]
                extra = [(times[many[more[r] : more[r + 1]]] - most).astype("<u4").tobytes() for r in some]
                return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(x, pa.binary()) for x in (data, which, extra))], ["range", "data", "which", "extra"])

            for batch in in_parts(found):
                for _, s in each_set(batch, size, seed):
                    held.append(halves(s))
                    n += len(s)
                if n >= flush:
                    yield out()
                    held, n = [], 0
            if n:
                yield out()

        def count(rows: pa.Table) -> pa.Table:
            first = rows.column("range")[0].as_py() * width
            values, n = runs(np.sort(np.concatenate([unpacked(d.as_py()) for d in rows.column("data")])))
            which, extra = (np.frombuffer(b"".join(d.as_py() for d in rows.column(c)), "<u4").astype(np.int64) for c in ("which", "extra"))
            np.add.at(n, np.searchsorted(values, which), extra)
            keys, rare = values[n >= most] + first, n[(n > 1) & (n < most)]
            level = np.floor(np.log(n[n >= most] / most) / np.log(STEP) + 1e-9).astype(np.int64)
            columns = [pa.array([None, *keys.tolist()], pa.int64()), *(pa.array([x, *own]) for x, own in ((0, level.tolist()), (len(rare), [0] * len(keys)), (int(rare.sum()), [0] * len(keys))))]
            return pa.Table.from_arrays(columns, ["key", "level", "lists", "members"])

        sent = self.docs.mapInArrow(emit, "range int, data binary, which binary, extra binary")
        return written(sent.groupBy("range").applyInArrow(count, "key long, level long, lists long, members long"), "frequent")

    def keys(self, bands: list[Bloom], boundary: int) -> DataFrame:
        """key, place, node, n: prefix keys of every set, of equal ones about once in each task."""
        size, seed, percent = self.size, self.seed, self.percent
        shared, namer = self.spark.sparkContext.broadcast(bands), self.namer

        def emit(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bands, told = shared.value, set()
            for batch in in_parts(found):
                if len(told) > 200_000:
                    told.clear()
                keys, places, node, sets = [np.zeros(0, U64)], [np.zeros(0, np.int32)], [], []
                for _, s in each_set(batch, size, seed):
                    if len(s) > 1 and (name := namer(s)) not in told:  # a single shingle links only to its equal
                        told.add(name)
                        node.append(name), sets.append(s)
                n = [len(s) for s in sets]
                for s in ordered(sets, bands):
                    own, at = prefix_keys(s, boundary, percent)
                    keys.append(own), places.append(at)
                count = [len(k) for k in keys[1:]]
                columns = [np.concatenate(keys).view(np.int64), np.concatenate(places), np.repeat(np.array(node, np.int64), count), np.repeat(np.array(n, np.int32), count)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "place", "node", "n"])

        return self.docs.mapInArrow(emit, "key long, place int, node long, n int")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """node, shingles of the given nodes, and by chance of some more."""
        size, seed, namer = self.size, self.seed, self.namer
        shared = self.spark.sparkContext.broadcast(bloom(nodes, "node"))

        def emit(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filter_ = shared.value
            for batch in in_parts(found):
                sets = [(namer(s), s) for _, s in each_set(batch, size, seed) if len(s)]
                node = np.array([x for x, _ in sets], np.int64)
                keep = np.flatnonzero(filter_.holds(node)) if len(node) else []
                own = dict((sets[i][0], sets[i][1].view(np.int64)) for i in keep)
                edges = np.cumsum([0, *(len(x) for x in own.values())], dtype=np.int32)
                values = np.concatenate([np.zeros(0, np.int64), *own.values()])
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.ListArray.from_arrays(pa.array(edges), pa.array(values))], ["node", "shingles"])

        return self.docs.mapInArrow(emit, "node long, shingles array<long>").dropDuplicates(["node"])

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b), a written table, that link. Pairs whose marks differ in more bits than linked sets do in shingles aren't compared."""
        marked = lambda n: self.marks.select(F.col("node").alias(n), F.col("n").alias(f"n{n}"), F.col("mark").alias(f"m{n}"))
        total = pairs.count()
        both = salted(salted(pairs, marked("a"), "a", "b", total), marked("b"), "b", "a", total, counted=pairs)
        apart = F.aggregate(F.zip_with("ma", "mb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        pairs = written(both.where(apart * (100 + self.percent) <= (100 - self.percent) * (F.col("na") + F.col("nb"))).select("a", "b"), "comparable")
        sets = self.sets(written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "compared"))
        total, named = pairs.count(), lambda n: sets.select(F.col("node").alias(n), F.col("shingles").alias(f"s{n}"))
        both = salted(salted(pairs, named("a"), "a", "b", total), named("b"), "b", "a", total, counted=pairs)
        common = F.size(F.array_intersect("sa", "sb"))
        return both.where(100 * common >= self.percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")

    def may_link(self) -> Column:
        """Whether a member and its pivot may."""
        least = F.ceil(shared_least(F.col("n"), F.col("pivot_n"), self.percent) - 1e-6)
        sizes = F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * self.percent
        return sizes & (F.col("place") <= F.col("n") - least) & (F.col("pivot_place") <= F.col("pivot_n") - least)


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, bits: int = 64, longest: int = LONG) -> DataFrame:
    """key, n_shingles, component_id (the least key that links reach) of every row of df. bits: of the sets' first names."""
    join = Join(df, key, text, size, percent, bits)
    signatures = join.signatures()
    frequent = join.frequent(signatures.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    facts = frequent.agg(F.coalesce(F.sum("lists"), F.lit(0)).alias("lists"), F.coalesce(F.sum("members"), F.lit(0)).alias("members"), F.max(F.when(F.col("key").isNotNull(), F.col("level"))).alias("last")).first()
    sizes = {r["n"]: r["count"] for r in signatures.where(F.col("n").between(2, MOST_LIGHT)).groupBy("n").count().collect()}
    boundary = boundary_by_cost(sizes, facts["members"] / max(1, facts["lists"]), percent)
    bands = [bloom(frequent.where(F.col("key").isNotNull() & (F.col("level") >= k)), "key") for k in range(0 if facts["last"] is None else facts["last"] + 1)]

    sorted_ = join.keys(bands, boundary).repartition("key").sortWithinPartitions("key", "place", "node")
    lists = written(sorted_.mapInArrow(lists_of, LISTS), "lists")

    stars = lists.where((F.col("node") != F.col("pivot")) & join.may_link())
    likely = stars.groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("c")).groupBy("node").agg(F.max(F.struct(F.col("c"), F.col("pivot"))).alias("best"))
    tried = written(likely.select(F.greatest("node", "best.pivot").alias("a"), F.least("node", "best.pivot").alias("b")).distinct(), "likely")
    linked = written(join.verified(tried), "linked")

    while True:
        components = written(connected_components(linked), "components")
        known = lists.join(components, "node", "left").select("list", F.coalesce("component", "node").alias("component"), "node", "n", "place")
        split = known.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m")).where("low <> high").select("list", "m")
        split = written(split, "split-lists")
        if split.where(F.col("m") > longest).isEmpty():
            break
        # The plainest member of each component of a long list meets the plainest of all.
        some = with_facts(known, split.where(F.col("m") > longest), ["list"], "m", lists.count())
        plain = some.groupBy("list", "component").agg(F.min(F.struct("place", "n", "node")).alias("own"))
        first = plain.groupBy("list").agg(F.min("own").alias("pivot"))
        met = plain.join(first, "list").select("own.*", F.col("pivot.node").alias("pivot"), F.col("pivot.n").alias("pivot_n"), F.col("pivot.place").alias("pivot_place"))
        met = met.where((F.col("node") != F.col("pivot")) & join.may_link()).select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()
        fresh = written(met.join(tried, ["a", "b"], "left_anti"), "plainest")
        more = written(join.verified(fresh), "linked")
        tried = written(tried.union(fresh), "tried")
        if more.isEmpty():
            break
        linked = written(linked.union(more), "linked")

    members = with_facts(known, split, ["list"], "m", lists.count())
    short = members.where(F.col("m") <= longest).drop("m").repartition("list").sortWithinPartitions("list", "component", "node")
    crossing, blocks = cross_pairs(percent), block_pairs(percent)
    met = short.mapInArrow(lambda found: gathered(crossing(found)), "a long, b long")
    if not split.where(F.col("m") > longest).isEmpty():
        tasks = ["list", "band", "lo", "hi"]
        long = divided(percent, longest)(members.where(F.col("m") > longest)).repartition(*tasks).sortWithinPartitions(*tasks)
        met = met.union(long.mapInArrow(lambda found: gathered(blocks(found)), "a long, b long"))
    more = written(met.distinct().join(tried, ["a", "b"], "left_anti"), "crossing")
    found = join.verified(more)
    components = written(connected_components(linked.union(found)), "components")

    least = signatures.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("rows"))
    roots = least.join(components, "node", "left").withColumn("root", F.coalesce("component", "node"))
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    roots, ids = written(roots.select("node", "root", "rows"), "roots"), written(ids, "ids")
    total = signatures.count()
    named = written(with_facts(roots, ids, ["root"], "nodes", total).select("node", "rows", "component_id"), "named")
    own = with_facts(signatures.where(F.col("node").isNotNull()), named, ["node"], "rows", total).select("key", "n", "component_id")
    none = signatures.where(F.col("node").isNull()).select("key", "n", F.col("key").alias("component_id"))
    out = own.unionByName(none)
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op4_jaccard": op4_jaccard}
ORACLES: dict[str, str] = {}
