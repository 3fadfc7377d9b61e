"""Packing documents into sequences by cutting-stock column generation.

1. A document's tokens (its identifiers, then an end mark) are cut into full pieces of the sequence length and one rest.
2. The rests' lengths, rounded up to GRAIN tokens, make a histogram of at most 256 classes, whatever the corpus size.
   Over it a linear program chooses how often to use each pattern (a multiset of classes that fits a sequence). Columns
   are generated: a knapsack dynamic program prices patterns by the program's duals, until none improves it.
3. Pattern counts are rounded down, what is left of the histogram is packed first-fit decreasing.
4. Pieces are ranked within their class, by counts for (class, chunk) and row numbers inside them. A chunk is a share of
   the pieces by the number that each got when it was written, so neither a class nor a repeated key meets in one task. A
   rank names a pattern, its copy and the slot there.

Null and empty texts are one piece, the end mark. Very long texts are cut into more full pieces. Repeated rows are
packed as often as they occur. An empty table gives no row. Only the key and text columns are read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridpoint.llm.common import table, written

GRAIN = 8
CHUNK_ROWS = 20_000
#: Column generation ends after so many steps a class: what it has then is a solution too, and the rest is packed first-fit.
STEPS = 50
CHUNKS_KEPT = 300_000
#: A space that isn't followed by another character than white space.
LOOSE_SPACE = re.compile(r" (?:\s|\Z)")


class Chunks(dict):
    """Little-endian identifiers of " " + chunk by chunk; filled as chunks are met, emptied when it is full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        out = np.array(self.encode(" " + chunk), "<u4").tobytes()
        if len(chunk) <= 64:
            if len(self) >= CHUNKS_KEPT:
                self.clear()
            self[chunk] = out
        return out


class ByteLevelEncoder:
    """Identifiers under a byte-level vocabulary, the same as the library's for the .json file at json_path.

    The vocabulary's words begin with at most one space, so a space before another character always begins a word: each
    run between such spaces is encoded once and then looked up. A text that holds a special string goes to the library.
    """

    def __init__(self, json_path: str, ranks_path: str, specials: tuple[str, ...] | None = None):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.json_path, self.specials = json_path, special_strings(json_path) if specials is None else specials
        self.chunks = Chunks(self.encode)

    @cached_property
    def library(self):
        """Loaded by the first text that needs it: most workers meet none, and it takes more memory than the ranks."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.specials):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = re.split(r" (?=\S)", text) if LOOSE_SPACE.search(text) else text.split(" ")
        head = np.array(self.encode(first), "<u4").tobytes()
        return head + b"".join(map(self.chunks.__getitem__, rest))


def special_strings(json_path: str) -> tuple[str, ...]:
    from tokenizers import Tokenizer

    return tuple(t.content for t in Tokenizer.from_file(json_path).get_added_tokens_decoder().values())


@lru_cache(2)
def encoder(json_path: str, ranks_path: str, specials: tuple[str, ...] | None = None) -> ByteLevelEncoder:
    return ByteLevelEncoder(json_path, ranks_path, specials)


def cut(df: DataFrame, json_path: str, ranks_path: str, key: str = "doc_id", text: str = "text", length: int = 2048, end_mark: int = 1) -> DataFrame:
    """Pieces of every document: full ones and a rest, with the checksum of their identifiers."""
    specials = special_strings(json_path)  # on the driver, once
    kind, end = df.schema[key].dataType.simpleString(), np.array([end_mark], "<u4").tobytes()

    def pieces(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(json_path, ranks_path, specials)
        for batch in found:
            rows, start, size, crc, total = [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                ids = (model.ids(t.as_py()) if t.is_valid else b"") + end
                n = len(ids) // 4
                for s in range(0, n, length):
                    piece = ids[4 * s : 4 * (s + length)]
                    rows.append(i), start.append(s), size.append(len(piece) // 4), crc.append(zlib.crc32(piece)), total.append(n)
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(x, pa.int64()) for x in (start, size, crc, total))], ["key", "start", "length", "ids_crc32", "doc_tokens"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(pieces, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes 1 to len(worth) within room that is worth most, by the knapsack dynamic program."""
    n = len(worth)
    best, took = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for v in range(1, room + 1):
        k = min(v, n)
        values = best[v - k : v][::-1] + worth[:k]  # entry j: after taking size j + 1
        j = int(np.argmax(values))
        best[v], took[v] = (values[j], j + 1) if values[j] > best[v - 1] + 1e-12 else (best[v - 1], 0)
    pattern, v = np.zeros(n, np.int64), room
    while v > 0:
        if took[v]:
            pattern[took[v] - 1] += 1
            v -= took[v]
        else:
            v -= 1
    return float(best[room]), pattern


def fractional_patterns(demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Column generation: patterns (one a row) and how often each is used in the optimum of the linear program."""
    sizes = np.flatnonzero(demand) + 1
    m = len(sizes)
    columns = np.diag(room // sizes).astype(np.float64)  # column k: size k alone, as often as it fits
    inverse = np.diag(1.0 / np.diag(columns)) if m else np.zeros((0, 0))
    used = inverse @ demand[sizes - 1]
    for _ in range(STEPS * m):  # degenerate steps could go round
        duals = inverse.sum(axis=0)  # each pattern costs one sequence
        worth = np.full(room, -1.0)
        worth[sizes - 1] = duals
        value, pattern = best_pattern(worth, room)
        if value <= 1 + 1e-7:
            break
        entering = pattern[sizes - 1].astype(np.float64)
        step = inverse @ entering
        ratio = np.where(step > 1e-9, np.maximum(used, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        used -= ratio[out] * step
        used[out] = ratio[out]
        columns[:, out] = entering
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    patterns = np.zeros((m, room), np.int64)
    patterns[:, sizes - 1] = np.rint(columns.T)
    return patterns, used


def whole_patterns(demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and whole counts that cover the demand exactly. demand[k]: pieces of size k + 1, up to room."""
    demand = demand.astype(np.int64)
    out, left = [], demand.copy()
    if demand[room - 1]:
        full = np.zeros(room, np.int64)
        full[room - 1] = 1
        out.append((full, int(demand[room - 1])))
        left[room - 1] = 0
    patterns, used = fractional_patterns(left.astype(np.float64), room)
    for pattern, x in zip(patterns, used):
        fits = [left[k] // pattern[k] for k in np.flatnonzero(pattern)]
        times = int(min([max(0.0, np.floor(x + 1e-6)), *fits]))
        if times > 0:
            out.append((pattern, times))
            left -= times * pattern
    rest: list[list] = []  # room left, pattern
    for k in np.flatnonzero(left)[::-1]:
        for _ in range(left[k]):
            bin_ = next((b for b in rest if b[0] >= k + 1), None)
            if bin_ is None:
                rest.append(bin_ := [room, np.zeros(room, np.int64)])
            bin_[0] -= k + 1
            bin_[1][k] += 1
    return out + [(pattern, 1) for _, pattern in rest]


def slots(patterns: list[tuple[np.ndarray, int]], room: int) -> list[tuple[np.ndarray, ...]]:
    """For each class: where its ranks pass from one pattern to the next, and those patterns' first sequence, copies and slot."""
    first = np.cumsum([0, *(times for _, times in patterns)])
    out = []
    for k in range(room):
        own = [(p, pattern[k], times) for p, (pattern, times) in enumerate(patterns) if pattern[k]]
        ends = np.cumsum([copies * times for _, copies, times in own], dtype=np.int64) if own else np.zeros(0, np.int64)
        before = np.concatenate([[0], ends[:-1]]).astype(np.int64) if own else ends
        base = np.array([first[p] for p, _, _ in own], np.int64)
        copies = np.array([c for _, c, _ in own], np.int64)
        slot = np.array([patterns[p][0][k + 1 :].sum() for p, _, _ in own], np.int64)  # larger pieces come first
        out.append((ends, before, base, copies, slot))
    return out


def pack(pieces: DataFrame, length: int = 2048, grain: int = GRAIN) -> DataFrame:
    """Adds sequence_id and offset to pieces (key, start, length, ids_crc32, doc_tokens)."""
    room = length // grain
    pieces = written(pieces.withColumn("number", F.monotonically_increasing_id()), "pieces")
    chunks = max(1, pieces.count() // CHUNK_ROWS)
    classed = pieces.withColumn("class", F.ceil(F.col("length") / grain).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("number"), F.lit(chunks)).cast("int"))
    counts = written(classed.groupBy("class", "chunk").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    demand = np.zeros(room, np.int64)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():  # one row a class, at most length / grain
        demand[r["class"] - 1] = r["n"]
    found = slots(whole_patterns(demand, room), room)

    before = Window.partitionBy("class").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("class", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("class", "chunk").orderBy("key", "start", "ids_crc32", "number")) - 1
    ranked = classed.withColumn("inside", inside).join(starts, ["class", "chunk"]).withColumn("rank", F.col("before") + F.col("inside"))

    @F.pandas_udf("sequence_id long, slot long")
    def place(kind: pd.Series, rank: pd.Series) -> pd.DataFrame:
        kinds, ranks = kind.to_numpy() - 1, rank.to_numpy()
        sequence, slot = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for k in np.unique(kinds):
            at = np.flatnonzero(kinds == k)
            ends, first, base, copies, place_ = found[k]
            p = np.searchsorted(ends, ranks[at], side="right")
            nth = ranks[at] - first[p]
            sequence[at] = base[p] + nth // copies[p]
            slot[at] = place_[p] + nth % copies[p]
        return pd.DataFrame({"sequence_id": sequence, "slot": slot})

    placed = ranked.withColumn("place", place("class", "rank")).select("key", "start", "length", "ids_crc32", "doc_tokens", "place.*")
    offset = F.coalesce(F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("offset", offset).drop("slot")


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 2048) -> DataFrame:
    import public_tokenizers

    pieces = cut(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), key, text, length)
    return pack(pieces, length).withColumnRenamed("key", key)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op8_packing": op8_packing}
ORACLES: dict[str, str] = {}
