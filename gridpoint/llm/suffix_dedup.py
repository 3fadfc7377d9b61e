"""Suffix-array dedup of exact repeats: every byte that a long enough repeated string covers is removed.

Shards are made by content, so that equal strings meet whatever documents they are in. Every string of LEAST bytes has an
anchor, the leftmost of its GRAM-byte grams with the least hash; successive starts with the same anchor form a segment,
and the anchor's hash is its key. Equal strings have equal anchors at equal places, hence equal keys.

1. Keys are counted. Only those that occur more than once can hold repeats; a filter of them, and one of keys whose
   segments differ, go to the tasks. Segments of very frequent differing keys are cut into parts with longer keys, so
   that a short common passage between ever other neighbours doesn't gather in one shard.
2. A segment that occurs twice as a whole is removed wherever it occurs; that needs its digest, not its bytes. Digests are
   cryptographic ones under a seed that the driver draws for each run; only keys and filters go by rolling hashes, which
   may bring different strings together but don't decide what is equal.
3. Differing segments of a key meet in a shard, each once. The shard's suffix array is made by induced sorting, and the
   permuted common prefixes tell which strings also start in another segment. Parts whose keys are still frequent go to
   no shard: the hashes of their few strings are counted.
4. Ranges come back to their documents, which are judged on the input as it was.

The filters have at most 2**30 bits each. Fuller ones let more pass: then the bytes of more segments are shuffled, up to
about all of them once, and the results are the same.

Null and empty texts have nothing to remove. Rows that repeat count as occurrences of each other. Long texts are read in
slices, whose borders only cut segments. An empty table gives no row. Only the key and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpoint.llm.common import Bloom, U64, bloom, bytes_of, keyed, mix, prefix_hashes, row_slices, run_seed, span_hashes, table, utf8, with_facts, written
from gridpoint.llm.suffix_array import permuted_common_prefixes, suffix_array

LEAST = 200
GRAM = 100
SLICE = 1 << 19
SHARD = 1 << 19
#: Keys of differing segments that occur so often are cut into parts.
FREQUENT = 1000
PARTS = 8


class Segments:
    """Of a stretch of rows: each segment's row, start and end in the row, key and hash, and what its parts need."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, rows: np.ndarray, shift: int, seed: int):
        """data: the bytes; ends: for each byte the end of its row; rows: for each row its first byte."""
        self.data, self.shift, self.row_starts, self.seed = data, shift, rows, seed
        windows = max(0, len(data) - LEAST + 1)
        self.prefix = prefix_hashes(data)
        if not windows:
            self.first = self.last = self.anchor = np.zeros(0, np.int64)
        else:
            grams = np.arange(len(data) - GRAM + 1)
            hashes = span_hashes(self.prefix, grams, grams + GRAM)
            low = U64((1 << 21) - 1)
            least = (hashes & ~low) | grams.astype(U64)
            width, span = 1, LEAST - GRAM + 1
            while 2 * width <= span:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            least = np.minimum(least[: windows], least[span - width : span - width + windows])
            anchor = (least & low).astype(np.int64)
            whole = np.arange(windows) + LEAST <= ends[:windows]
            changes = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | ~whole[:-1]])
            self.first = np.flatnonzero(whole & changes)
            stops = np.concatenate([(anchor[1:] != anchor[:-1]) | ~whole[1:], [True]])
            self.last = np.flatnonzero(whole & stops)
            self.anchor = anchor[self.first]
        self.key = span_hashes(self.prefix, self.anchor, self.anchor + GRAM)
        self.describe()

    def describe(self) -> None:
        self.end = self.last + LEAST
        whole = memoryview(np.ascontiguousarray(self.data))
        spans = zip(self.first.tolist(), self.end.tolist())
        self.hash = np.fromiter((keyed(whole[s:e], self.seed) for s, e in spans), np.int64, len(self.first))
        self.row = np.searchsorted(self.row_starts, self.first, side="right") - 1
        self.start = self.first - self.row_starts[self.row] + self.shift

    def cut(self, which: np.ndarray) -> None:
        """Cuts the given segments by the distance from start to anchor into PARTS, keyed by what all of a part's strings hold."""
        span = LEAST - GRAM + 1
        step = -(-span // PARTS)
        kept = np.flatnonzero(~which)
        columns = [[x[kept]] for x in (self.first, self.last, self.anchor, self.key)]
        at = np.flatnonzero(which)
        for part in range(PARTS):
            near, far = part * step, min(span, (part + 1) * step) - 1
            some = at[(self.first[at] <= self.anchor[at] - near) & (self.last[at] >= self.anchor[at] - far)]
            first, last = np.maximum(self.first[some], self.anchor[some] - far), np.minimum(self.last[some], self.anchor[some] - near)
            core = span_hashes(self.prefix, self.anchor[some] - near, self.anchor[some] - far + LEAST)
            for column, x in zip(columns, (first, last, self.anchor[some], mix(core + U64(part + 1)))):
                column.append(x)
        self.first, self.last, self.anchor, self.key = (np.concatenate(c) for c in columns)
        self.describe()

    def bytes(self, i: int) -> bytes:
        return self.data[self.first[i] : self.end[i]].tobytes()


def segments(data: np.ndarray, offsets: np.ndarray, seed: int) -> Iterator[tuple[int, Segments]]:
    """First row and segments of slices."""
    for first, last in row_slices(offsets, SLICE):
        begin, end = int(offsets[first]), int(offsets[last])
        if end - begin < LEAST:
            continue
        if end - begin <= 2 * SLICE - LEAST:
            own = offsets[first : last + 1] - begin
            yield first, Segments(data[begin:end], np.repeat(own[1:], np.diff(own)), own[:-1], 0, seed)
        else:
            for s in range(begin, end - LEAST + 1, SLICE):
                piece = data[s : min(s + SLICE + LEAST - 1, end)]
                yield first, Segments(piece, np.full(len(piece), len(piece)), np.zeros(1, np.int64), s - begin, seed)


def signed(x: np.ndarray, type_: pa.DataType = pa.int64()) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U64 else x, type_)


class Dedup:
    """The steps over one table, each a DataFrame. A row is known by its key and the hash of its text."""

    def __init__(self, df: DataFrame, key: str, text: str):
        self.kind = df.schema[key].dataType.simpleString()
        self.docs = df.select(F.col(key).alias("id"), utf8(text).alias("text")).withColumn("sign", F.xxhash64("text"))
        self.share, self.seed = df.sparkSession.sparkContext.broadcast, run_seed()

    def keys(self) -> DataFrame:
        """Keys that occur more than once: their number and whether their segments differ."""
        seed = self.seed

        def emit(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in found:
                for _, s in segments(*bytes_of(batch.column(0)), seed):
                    yield pa.RecordBatch.from_arrays([signed(s.key), signed(s.hash)], ["key", "hash"])

        counted = self.docs.select("text").mapInArrow(emit, "key long, hash long").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        return written(counted.where("n > 1").select("key", "n", (F.col("low") != F.col("high")).alias("differ")), "segment-keys")

    def occurrences(self, keys: DataFrame) -> DataFrame:
        """Segments with repeated keys. Those of differing keys come with their bytes, once in each task."""
        seed = self.seed
        shared = self.share((bloom(keys, "key"), bloom(keys.where("differ"), "key"), bloom(keys.where((F.col("n") >= FREQUENT) & F.col("differ")), "key")))

        def emit(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (repeated, differing, frequent), told = shared.value, set()
            for batch in found:
                ids, signs = batch.column(0), batch.column(2).to_numpy()
                for first, s in segments(*bytes_of(batch.column(1)), seed):
                    if not len(s.key):
                        continue
                    cut = frequent.holds(s.key)
                    parts = cut.any()
                    if parts:
                        plain = s.key[~cut]
                        s.cut(cut)
                    longer = np.arange(len(s.key)) >= (len(plain) if parts else len(s.key))
                    keep = repeated.holds(s.key) | longer
                    differs = keep & (differing.holds(s.key) | longer)
                    at = np.flatnonzero(keep)
                    data = []
                    for i, d in zip(at.tolist(), differs[at].tolist()):
                        one = (int(s.key[i]), int(s.hash[i]))
                        data.append(s.bytes(i) if d and one not in told else None)
                        if d:
                            told.add(one)
                    if len(told) > 100_000:
                        told.clear()
                    rows = first + s.row[at]
                    yield pa.RecordBatch.from_arrays([signed(s.key[at]), signed(s.hash[at]), ids.take(pa.array(rows)), pa.array(signs[rows]), pa.array(s.start[at]), pa.array(s.end[at] - s.first[at]), pa.array(data, pa.binary()), pa.array(longer[at])], ["key", "hash", "id", "sign", "start", "length", "data", "part"])

        return written(self.docs.select("id", "text", "sign").mapInArrow(emit, f"key long, hash long, id {self.kind}, sign long, start long, length long, data binary, part boolean"), "segments")

    def whole(self, found: DataFrame) -> DataFrame:
        """Ranges of segments that occur twice as they are."""
        twice = written(found.groupBy("key", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-segments")
        own = found.select("key", "hash", "id", "sign", "start", "length")
        return with_facts(own, twice, ["key", "hash"], "n", found.count()).select("id", "sign", "start", (F.col("start") + F.col("length")).alias("end"))

    def partial(self, found: DataFrame) -> DataFrame:
        """Ranges of strings that differing segments share."""
        some, hot = self.dealt(found)
        return self.counted(hot).union(self.sorted(some))

    def dealt(self, found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Segments with bytes for the shards, and parts whose keys are still frequent. A key's segments go the same way."""
        some = found.where(F.col("data").isNotNull())
        still = some.where("part").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT).select("key")
        shared = self.share(bloom(written(still, "frequent-parts"), "key"))

        def only(hot: bool):
            def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    held = shared.value.holds(batch.column(0).to_numpy()) & batch.column(7).to_numpy(zero_copy_only=False)
                    yield batch.filter(pa.array(held == hot))

            return some.mapInArrow(chosen, some.schema)

        return only(False), only(True)

    def counted(self, hot: DataFrame) -> DataFrame:
        """Ranges of strings of LEAST bytes that occur twice, by their digests. No string starts twice in one segment, as its anchor would differ."""
        seed = self.seed

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = bytes_of(batch.column(6))
                n = np.maximum(np.diff(offsets) - LEAST + 1, 0)
                own = np.repeat(np.arange(len(n)), n)
                within = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                at, take = offsets[own] + within, pa.array(own)
                whole = memoryview(np.ascontiguousarray(data))
                strings = np.fromiter((keyed(whole[s : s + LEAST], seed) for s in at.tolist()), np.int64, len(at))
                start = batch.column(4).to_numpy()[own] + within
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), signed(strings), batch.column(2).take(take), batch.column(3).take(take), pa.array(start)], ["key", "string", "id", "sign", "start"])

        strings = hot.mapInArrow(emit, f"key long, string long, id {self.kind}, sign long, start long")
        twice = written(strings.groupBy("key", "string").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-strings")
        total = twice.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # other strings occur once
        return with_facts(strings, twice, ["key", "string"], "n", total).select("id", "sign", "start", (F.col("start") + LEAST).alias("end"))

    def sorted(self, some: DataFrame) -> DataFrame:
        """Ranges of strings that segments of a shard share, by induced sorting."""
        bytes_ = some.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
        shards = max(1, int(bytes_) // SHARD)

        def sort(rows: pa.Table) -> pa.Table:
            out = [shard_ranges(c) for c in alone(rows)]
            return pa.concat_tables(out) if out else empty

        empty = None

        def alone(rows: pa.Table) -> Iterator[pa.Table]:
            """The shard in stretches that hold whole keys and about SHARD bytes."""
            nonlocal empty
            rows = rows.combine_chunks().sort_by([("key", "ascending"), ("hash", "ascending")])
            empty = rows.slice(0, 0).select(["id", "sign"]).append_column("start", pa.array([], pa.int64())).append_column("end", pa.array([], pa.int64()))
            key, hash_ = rows.column("key").to_numpy(), rows.column("hash").to_numpy()
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (hash_[1:] != hash_[:-1])])
            rows = rows.filter(pa.array(fresh))
            key = key[fresh]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            several = np.diff(np.append(starts, len(key))) > 1
            keep = np.repeat(several, np.diff(np.append(starts, len(key))))
            rows, key = rows.filter(pa.array(keep)), key[keep]
            if not len(key):
                return
            size = np.cumsum(rows.column("length").to_numpy())
            at = 0
            while at < len(key):
                end = int(np.searchsorted(size, (size[at - 1] if at else 0) + 2 * SHARD, side="right"))
                end = max(end, at + 1)
                end = int(np.searchsorted(key, key[end - 1], side="right"))
                yield rows.slice(at, end - at)
                at = end

        return some.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInArrow(lambda t: sort(t), f"id {self.kind}, sign long, start long, end long")


def shard_ranges(rows: pa.Table) -> pa.Table:
    """Ranges of strings of LEAST bytes that another segment of the shard holds too, by its suffix array."""
    data, offsets = bytes_of(rows.column("data").combine_chunks())
    lengths = np.diff(offsets)
    places = offsets[:-1] + np.arange(len(lengths))  # a separator stands behind each segment
    text = np.ones(len(data) + len(lengths) + 1, np.int64)
    inside = np.arange(len(data)) + np.repeat(np.arange(len(lengths)), lengths)
    text[inside] = data.astype(np.int64) + 2
    text[-1] = 0
    plain = np.zeros(len(text), np.uint8)
    plain[inside] = data
    room = np.zeros(len(text), np.int64)  # bytes up to the segment's end
    room[inside] = np.repeat(offsets[1:], lengths) - np.arange(len(data))
    at = np.flatnonzero(room >= LEAST)
    before, common = permuted_common_prefixes(plain, suffix_array(text), at, LEAST)
    hit = (common >= LEAST) & (room[before] >= LEAST)
    found = np.zeros(len(text) + 1, bool)
    found[at[hit]] = True
    found[before[hit]] = True
    at = np.flatnonzero(found)
    segment = np.searchsorted(places, at, side="right") - 1
    fresh = np.concatenate([[True], (segment[1:] != segment[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, bool)
    first, last = at[fresh], at[np.append(fresh[1:], True)] if len(at) else at
    own = segment[fresh]
    start = rows.column("start").to_numpy()[own] - places[own]
    out = rows.select(["id", "sign"]).take(pa.array(own))
    return out.append_column("start", pa.array(first + start)).append_column("end", pa.array(last + LEAST + start))


def merged(ranges: np.ndarray) -> np.ndarray:
    """Maximal runs of ranges (start, end), touching ones joined."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    fresh = np.concatenate([[True], ranges[1:, 0] > reach[:-1]])
    starts = np.flatnonzero(fresh)
    return np.stack([ranges[starts, 0], reach[np.append(starts[1:], len(ranges)) - 1]], axis=1)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every row; with keep_text also kept, the remaining bytes."""
    steps = Dedup(df, key, text)
    found = steps.occurrences(steps.keys())
    ranges = written(steps.whole(found).union(steps.partial(found)), "ranges")
    grouped = ranges.groupBy("id", "sign").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))  # at most a row's own length, however often it is repeated
    signs = steps.share(bloom(ranges.select("sign").distinct(), "sign"))

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that have ranges keep their text for the join; others are finished here."""
        for batch in batches:
            may, texts = signs.value.holds(batch.column(2).to_numpy()) if batch.num_rows else [], batch.column(1)
            size = [len(t.as_buffer() or b"") for t in texts]
            kept = [None if m else hashlib.sha256(t.as_buffer()).hexdigest() for m, t in zip(may, texts)]
            data = [t.as_py() if m or keep_text else None for m, t in zip(may, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(kept, pa.string()), pa.array(data, pa.binary())], ["id", "sign", "n_bytes", "kept", "text"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
        for batch in batches:
            out = []
            for done, data, own in zip(batch.column(2), batch.column(3), batch.column(4)):
                if done.is_valid:
                    out.append((0, 0, done.as_py(), data.as_py()))
                    continue
                data, spans = data.as_py(), np.zeros((0, 2), np.int64)
                if own.is_valid:
                    spans = merged(np.stack([own.values.field(0).to_numpy(), own.values.field(1).to_numpy()], axis=1))
                edges = [0, *spans.ravel().tolist(), len(data)]
                kept = b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2]))
                out.append((len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns[: 4 if keep_text else 3], (pa.int64(), pa.int64(), pa.string(), pa.binary())))], names)

    schema = f"id {steps.kind}, sign long, n_bytes long, kept string, text binary"
    rows = steps.docs.select("id", "text", "sign").mapInArrow(untouched, schema)
    both = rows.join(grouped, rows["id"].eqNullSafe(grouped["id"]) & (rows["sign"] == grouped["sign"]), "left").select(rows["id"], "n_bytes", "kept", "text", "ranges")
    out = both.mapInArrow(finish, f"id {steps.kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
    return out.withColumnRenamed("id", key)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op9_suffix_dedup": op9_suffix_dedup}
ORACLES: dict[str, str] = {}
