"""What several operators share: reading, tables that survive lost executors, byte slices, hashes of byte strings."""

from __future__ import annotations

import hashlib
import secrets
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Multiplier of the rolling hash; odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of the application that all executors see, under spark.checkpoint.dir; removed when the application ends.

    Where that is unset, one machine that runs everything (master "local") takes a new temporary folder; a cluster has to
    name a shared one.
    """
    context = spark.sparkContext
    if (app := context.applicationId) not in _FOLDERS:
        above = spark.conf.get("spark.checkpoint.dir", None)
        if not above:
            if context.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            above = f"file://{tempfile.mkdtemp(prefix='gridpoint-')}"
        path = context._jvm.org.apache.hadoop.fs.Path(f"{above.rstrip('/')}/gridpoint-{app}")
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS[app] = path.toString()
    return _FOLDERS[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, and a lost executor loses nothing of it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: At most so many keys are told apart as frequent ones.
MOST_FREQUENT = 100_000


def frequent_from(total: int, least: int = 500) -> int:
    """Keys of more than so many of total rows are at most MOST_FREQUENT; others have too few rows to be a load for one task."""
    return max(least, total // MOST_FREQUENT)


def with_facts(rows: DataFrame, facts: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """rows (total at most) joined to facts, a written table that has each key once and in n how many rows hold it.

    Facts of frequent keys are broadcast, so that their rows stay where they are; the others are joined by key.
    """
    often = facts.where(F.col(n) > frequent_from(total))
    if total <= frequent_from(total) or often.isEmpty():
        return rows.join(facts, on)
    names = [*rows.columns, *(c for c in facts.columns if c not in on)]
    here, rest = rows.join(F.broadcast(often), on), rows.join(F.broadcast(often.select(on)), on, "left_anti")
    return here.select(names).unionByName(rest.join(facts.where(F.col(n) <= frequent_from(total)), on).select(names))


def salted(rows: DataFrame, wide: DataFrame, key: str, spread: str, total: int, counted: DataFrame | None = None) -> DataFrame:
    """rows (of total rows) joined by key to wide, whose rows are too large to broadcast. A frequent key's rows are dealt by
    spread to several tasks, each with a copy of its wide row. Keys are counted in counted, a written table with those of rows."""
    if total <= frequent_from(total):
        return rows.join(wide, key)
    counts = (rows if counted is None else counted).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > frequent_from(total))
    parts = written(counts.select(key, F.ceil(F.col("n") / frequent_from(total)).cast("int").alias("parts")), "frequent-keys")
    if parts.isEmpty():
        return rows.join(wide, key)
    often, most = F.broadcast(parts), F.coalesce("parts", F.lit(1))
    dealt = rows.join(often, key, "left").withColumn("salt", F.pmod(F.xxhash64(spread), most).cast("int")).drop("parts")
    copied = wide.join(often, key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), most - 1))).drop("parts")
    return dealt.join(copied, [key, "salt"]).drop("salt")


def utf8(text: str = "text") -> Column:
    """A text as UTF-8 bytes; null as no bytes."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string Arrow column, end to end, and where each value begins (one more at the end)."""
    wide = column.type in (pa.large_binary(), pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if buffers[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def in_parts(found: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same batches, a few rows at a time, so that what is made of them stays small."""
    for batch in found:
        for s in range(0, batch.num_rows, rows):
            yield batch.slice(s, rows)


def row_slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about most bytes each; a longer row stands alone."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def batches(found: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches of dicts of column arrays."""
    for columns in found:
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A random 64-bit word for each byte.
BYTE_WORDS = mix(np.arange(1, 257, dtype=U64) * U64(BASE))
_POWERS = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(n: int, kind: str) -> np.ndarray:
    """The first n powers of BASE, or of its inverse (kind "down")."""
    have = _POWERS[kind]
    if len(have) < n:
        size = max(n, 2 * len(have), 1 << 16)
        step = U64(BASE if kind == "up" else BASE_INVERSE)
        factors = np.full(size, step, U64)
        factors[0] = 1
        have = _POWERS[kind] = np.multiply.accumulate(factors)
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H, one longer than data: H[e] - H[s], times the inverse power s, is the hash of the bytes from s up to e."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_WORDS[data] * powers(len(data), "up"), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for arrays of spans."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), "down")[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


class Bloom:
    """Blocks of bits: which 64-bit keys may be in a set. A key's bits lie in one block, so blocks are made independently."""

    BLOCK_BITS = 1 << 19
    PROBES = 4

    def __init__(self, blocks: int):
        self.blocks = blocks
        self.bits = np.zeros((blocks, self.BLOCK_BITS // 8), np.uint8)

    @classmethod
    def places(cls, keys: np.ndarray) -> list[np.ndarray]:
        mixed = mix(keys.view(U64) ^ U64(0x5851F42D4C957F2D))
        step = (mixed >> U64(32)) | U64(1)
        return [((mixed + U64(k) * step) & U64(cls.BLOCK_BITS - 1)).astype(np.int64) for k in range(cls.PROBES)]

    def block_of(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(U64)) % U64(self.blocks)).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        block, out = self.block_of(keys), np.ones(len(keys), bool)
        for place in self.places(keys):
            out &= (self.bits[block, place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        return out


def bloom(df: DataFrame, column: str, most_bits: int = 1 << 30) -> Bloom:
    """A filter of a column of longs, about 12 bits a key and most_bits at most: fuller filters let more pass, never less."""
    out = Bloom(max(1, min(most_bits, 12 * df.count()) // Bloom.BLOCK_BITS))
    blocks = out.blocks

    def dealt(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            keys = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array((mix(keys.view(U64)) % U64(blocks)).astype(np.int32)), batch.column(0)], ["block", "key"])

    def fill(keys: pa.Table) -> pa.Table:
        bits = np.zeros(Bloom.BLOCK_BITS, bool)
        for place in Bloom.places(keys.column("key").to_numpy()):
            bits[place] = True
        return pa.table({"block": pa.array([keys.column("block")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    rows = df.select(F.col(column).alias("key")).mapInArrow(dealt, "block int, key long").groupBy("block").applyInArrow(fill, "block int, bits binary")
    rows = rows.coalesce(max(8, blocks // 16))  # each partition is a job of its own below
    for r in rows.toLocalIterator():  # bounded by most_bits
        out.bits[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out


#: White space between words, and bytes with A-Z lower-cased.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: For 0 to 8 bytes, the bits of a little-endian word that they fill.
FILLED = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Words of more bytes are hashed one by one, by a digest.
LONG_WORD = 64


def run_seed() -> int:
    """64 random bits, drawn on the driver for one run of an operator: what its hashes tell apart can't be worked out beforehand."""
    return secrets.randbits(64)


def keyed(data: bytes | memoryview, seed: int) -> int:
    """A signed 64-bit cryptographic digest under a seed."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little", signed=True)


def digests_of(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of low[start:end] under a seed: eight bytes at a time are mixed in, no sums of powers are involved,
    which long words can share. Longer ones by a keyed digest."""
    whole = np.concatenate([low, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(low) + 1, "<u8", whole, strides=(1,))
    length = ends - starts
    out, at, done = mix(length.astype(U64) ^ U64(seed)), np.flatnonzero(length <= LONG_WORD), 0
    while len(at):
        left = length[at] - done
        out[at] = mix(out[at] * U64(BASE) + (eight[starts[at] + done] & FILLED[np.minimum(left, 8)]))
        at, done = at[left > 8], done + 8
    for i in np.flatnonzero(length > LONG_WORD):
        out[i] = keyed(low[starts[i] : ends[i]].tobytes(), seed) & 0xFFFFFFFFFFFFFFFF
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every row's bytes (lower-cased), and where each row's words begin (one more at the end)."""
    low = LOWER[data]
    inside = ~SPACE[low]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return digests_of(low, starts, ends, seed), np.searchsorted(starts, offsets)


def long_word_hashes(data: np.ndarray, most: int = 1 << 20, seed: int = 0) -> np.ndarray:
    """word_hashes of one long row, a piece at a time; pieces end at white space."""
    out, at = [], 0
    while at < len(data):
        size = most
        while at + size < len(data):
            spaces = np.flatnonzero(SPACE[data[at : at + size]])
            if len(spaces):
                size = int(spaces[-1]) + 1
                break
            size *= 2
        piece = data[at : at + size]
        out.append(word_hashes(piece, np.array([0, len(piece)]), seed)[0])
        at += size
    return np.concatenate(out) if out else np.zeros(0, U64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5, seed: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct hashes of its word shingles; a row with fewer words has one of all, without words none.

    Each word is mixed into what stands before it, under the seed, so that no word can make up for another.
    """
    begin = mix(np.array([seed ^ BASE], U64))
    for first, last in row_slices(offsets):
        if last - first == 1 and offsets[last] - offsets[first] > (1 << 20):
            words = long_word_hashes(data[offsets[first] : offsets[last]], seed=seed)
            edges = np.array([0, len(words)])
        else:
            words, edges = word_hashes(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], seed)
        n = max(0, len(words) - size + 1)
        whole = np.repeat(begin, n)
        for k in range(size):
            whole = mix(whole + words[k : k + n])
        for i in range(last - first):
            s, e = edges[i], edges[i + 1]
            if e - s >= size:
                own = np.sort(whole[s : e - size + 1])
                fresh = np.ones(len(own), bool)
                np.not_equal(own[1:], own[:-1], out=fresh[1:])
                yield first + i, own[fresh]
            elif e > s:
                few = begin + U64(e - s)
                for k in range(s, e):
                    few = mix(few + words[k : k + 1])
                yield first + i, few
            else:
                yield first + i, np.zeros(0, U64)
