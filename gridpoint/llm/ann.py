"""Approximate nearest neighbours by inner product: an inverted index searched by adaptive dimension scan.

1. Equal vectors are one candidate with its lowest keys (no answer needs more of them), by a limit that each task applies
   before the shuffle, so a vector that a third of all rows share is no load.
2. Vectors get one coordinate more, so that the largest inner product is the least distance, and are rotated at random.
   Centroids are fitted on SAMPLE vectors (the lowest hashes; a documented bound); every vector joins its nearest list.
   The number of lists to probe is the least that finds TARGET of the true neighbours within the sample.
3. A query starts from the distance of its last neighbour in the sample and goes once to each group of lists that holds a
   probed one. There, list by list, columns are read in blocks: a candidate whose scaled partial distance is too far, by
   the hypothesis test of the random rotation, is abandoned; what is left by the last block is a true distance.
4. Survivors are scored on the original vectors in double precision and ranked over all groups, ties to the lower key.
5. A query that got fewer rows than there are candidates for goes to all lists, where only true bounds abandon candidates.

Vectors that are null, zero, of another than the commonest length, or hold null or non-finite components take no part.
Each query row gets its own ranking without itself; fewer candidates give fewer rows, an empty table none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridpoint.llm.common import table, with_facts, written

SAMPLE = 20_000
MOST_LISTS = 2048
GROUP_ROWS = 8192
#: Queries that meet a list's rows at once.
QUERY_ROWS = 2048
TARGET = 0.97
BLOCK = 16
#: Width of the hypothesis test, in deviations of a partial distance.
EPSILON = 2.1
ROUNDING = 1e-4
#: The same for the search of all lists, relative and absolute: wide, as it must not lose a candidate.
WIDE = 1e-3, 1e-4


def rotation(size: int, seed: int = 3) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))[0]


class Space:
    """Maps vectors, and queries, to rotated points whose distances rank inner products."""

    def __init__(self, size: int, longest: float):
        self.longest, self.turn = longest, rotation(size + 1).astype(np.float32)

    def points(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))
        return np.column_stack([x, rest]).astype(np.float32) @ self.turn

    def queries(self, q: np.ndarray) -> np.ndarray:
        q = q / np.maximum(np.sqrt((q * q).sum(axis=1, keepdims=True)), 1e-300)
        return np.column_stack([q, np.zeros(len(q))]).astype(np.float32) @ self.turn


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared, every row of a to every row of b."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T), 0)


def centroids(points: np.ndarray, n: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    found = points[np.random.default_rng(seed).permutation(len(points))[:n]].copy()
    for _ in range(rounds):
        own = distances(points, found).argmin(axis=1)
        sums, counts = np.zeros_like(found), np.bincount(own, minlength=n)
        np.add.at(sums, own, points)
        found[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return found


class Index:
    """The space, the sample's points, the centroids and how many lists to probe."""

    def __init__(self, sample: np.ndarray, longest: float, total: int, top: int):
        self.top, self.space = top, Space(sample.shape[1], longest)
        self.sample = self.space.points(sample)
        lists = max(1, min(MOST_LISTS, int(math.sqrt(total)), len(sample)))
        self.centroids = centroids(self.sample, lists)
        at = np.linspace(0, len(sample) - 1, min(256, len(sample))).astype(int)
        queries, own = self.space.queries(sample[at]), distances(self.sample, self.centroids).argmin(axis=1)
        far = distances(queries, self.sample)
        far[np.arange(len(at)), at] = np.inf
        near = np.argsort(far, axis=1)[:, : min(top, len(sample) - 1)]
        place = np.argsort(np.argsort(distances(queries, self.centroids), axis=1), axis=1)
        needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
        self.probes = int(needed[int(TARGET * (len(needed) - 1))]) + 1 if len(needed) else 1

    def routed(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries' points, their starting distances and the lists to probe."""
        points = self.space.queries(q)
        far = distances(points, self.sample)
        k = self.top + 1  # the query's own vector may be among them
        start = np.partition(far, k, axis=1)[:, k] if far.shape[1] > k else np.full(len(q), np.inf, np.float32)
        return points, start, np.argsort(distances(points, self.centroids), axis=1)[:, : self.probes]


def scan(points: np.ndarray, queries: np.ndarray, limit: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, candidate) within the limits that no block abandons, and their squared distances. exact: without the test."""
    size = points.shape[1]
    partial = distances(queries[:, :BLOCK], points[:, :BLOCK])
    slack = lambda d: 1.0 if exact else size / d / (1 + EPSILON / math.sqrt(d)) ** 2
    a, b = np.nonzero(partial * np.float32(slack(min(BLOCK, size))) <= limit[:, None]) if size > BLOCK else np.nonzero(partial <= limit[:, None])
    found = partial[a, b]
    for s in range(BLOCK, size, BLOCK):
        step = queries[a, s : s + BLOCK] - points[b, s : s + BLOCK]
        found = found + np.einsum("ij,ij->i", step, step)
        d = min(s + BLOCK, size)
        keep = found * (slack(d) if d < size else 1.0) <= limit[a]
        a, b, found = a[keep], b[keep], found[keep]
    return a, b, found


def search_group(rows: pd.DataFrame, asked: pd.DataFrame, space: Space, top: int, exact: bool = False) -> pd.DataFrame:
    """The best candidates of one group of lists for each query that came to it."""
    names = ["query", "score", "ids"]
    if rows.empty or asked.empty:
        return pd.DataFrame({n: [] for n in names})
    asked = asked.sort_values("query", ignore_index=True)
    originals, q = np.array(rows["vector"].tolist(), np.float64), np.array(asked["vector"].tolist(), np.float64)
    points, queries = space.points(originals), space.queries(q)
    more, least = WIDE if exact else (ROUNDING, 1e-6)
    limit = asked["start"].to_numpy(np.float32) * np.float32(1 + more) + np.float32(least)
    lists = rows["list"].to_numpy()
    order = np.argsort(lists, kind="stable")
    edges = np.searchsorted(lists[order], np.arange(lists.max() + 2))
    wanted = asked["lists"].tolist()
    by_list: dict[int, list[int]] = {}
    for i, own in enumerate(wanted):
        for k in own:
            by_list.setdefault(int(k), []).append(i)
    got_a, got_b, got_d, held = [], [], [], 0

    def settle() -> None:
        """Keeps each query's best so far and draws its limit in."""
        nonlocal held
        a, b, d = np.concatenate(got_a), np.concatenate(got_b), np.concatenate(got_d)
        by = np.lexsort((d, a))
        a, b, d = a[by], b[by], d[by]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        last = rank == top
        limit[a[last]] = np.minimum(limit[a[last]], d[last] * np.float32(1 + more) + np.float32(least))
        keep = d <= limit[a]
        got_a[:], got_b[:], got_d[:] = [a[keep]], [b[keep]], [d[keep]]
        held = int(keep.sum())

    for k, own in sorted(by_list.items()):
        if k + 1 >= len(edges) or edges[k] == edges[k + 1]:
            continue
        at, own = order[edges[k] : edges[k + 1]], np.array(own)
        for some in (own[s : s + QUERY_ROWS] for s in range(0, len(own), QUERY_ROWS)):
            a, b, d = scan(points[at], queries[some], limit[some], exact)
            got_a.append(some[a]), got_b.append(at[b]), got_d.append(d)
            held += len(a)
            if held > 40 * len(asked) + 100_000:
                settle()
    if not got_a:
        return pd.DataFrame({n: [] for n in names})
    settle()
    a, b = got_a[0], got_b[0]
    score = np.einsum("ij,ij->i", q[a], originals[b])
    ids = rows["ids"].to_numpy()
    by = np.lexsort((np.array([x[0] for x in ids])[b], -score, a))
    a, b, score = a[by], b[by], score[by]
    keep = np.arange(len(a)) - np.searchsorted(a, a) <= top
    return pd.DataFrame({"query": asked["query"].to_numpy()[a[keep]], "score": score[keep], "ids": ids[b[keep]]})


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, top: int = 20, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose key is divisible, its nearest rows."""
    v = F.col("vector")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & finite).withColumn("vector", F.transform(v, lambda x: x + F.lit(0.0)))  # no -0
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").head(1)
    result = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return df.sparkSession.createDataFrame([], result)
    rows = rows.where(F.size("vector") == lengths[0]["n"]).withColumn("hash", F.xxhash64("vector"))
    low = F.row_number().over(Window.partitionBy("hash", "vector").orderBy("id"))
    same = rows.withColumn("n", low).where(F.col("n") <= top + 1).groupBy("hash", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = written(same.withColumn("first", F.element_at("ids", 1)).withColumn("norm", F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))), "vectors")
    facts = distinct.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).first()
    drawn = distinct.orderBy(F.xxhash64("first", F.lit(7))).limit(sample).select("vector").toPandas()
    index = Index(np.array(drawn["vector"].tolist(), np.float64), facts["longest"], facts["n"], top)
    shared = df.sparkSession.sparkContext.broadcast(index)

    def listed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in found:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            own = distances(index.space.points(x), index.centroids).argmin(axis=1) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *batch.columns], ["list", "ids", "vector", "first"])

    placed = written(distinct.select("ids", "vector", "first").mapInArrow(listed, "list int, ids array<long>, vector array<double>, first long"), "listed")
    counts = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # at most MOST_LISTS rows
    groups, at, held = {}, 0, 0  # list: its first group and how many it has
    for k in sorted(counts, key=lambda k: tuple(index.centroids[k][:1])):
        parts = max(1, round(counts[k] / GROUP_ROWS))
        if parts > 1 or held + counts[k] > GROUP_ROWS:
            at, held = at + (1 if held else 0), 0
        groups[k] = (at, parts)
        at, held = (at + parts, 0) if parts > 1 else (at, held + counts[k])
    firsts = F.create_map(*(F.lit(x) for k, (g, _) in groups.items() for x in (k, g)))
    parts = F.create_map(*(F.lit(x) for k, (_, p) in groups.items() for x in (k, p)))
    candidates = placed.select((firsts[F.col("list")] + F.pmod(F.xxhash64("first"), parts[F.col("list")]).cast("int")).alias("group"), "list", "ids", "vector")

    asking = rows.where(F.col("id") % every == 0)
    questions = asking.groupBy("hash", "vector").agg(F.min("id").alias("query"), F.count(F.lit(1)).alias("n"))

    def routed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in found:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                x = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                _, start, lists = index.routed(x)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(start, pa.float32()), pa.array(lists.tolist(), pa.list_(pa.int32())), part.column(2)], ["query", "vector", "start", "lists", "n"])

    asked = written(questions.select("query", "vector", "n").mapInArrow(routed, "query long, vector array<double>, start float, lists array<int>, n long"), "routes")

    def hits(asked: DataFrame, exact: bool) -> DataFrame:
        """The best candidates of every group that a query goes to: those of its lists, or all if exact."""

        def dealt(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in found:
                for s in range(0, batch.num_rows, 512):
                    part = batch.slice(s, 512)
                    row, group, wanted = [], [], []
                    for i, own in enumerate(part.column(3).to_pylist()):
                        to: dict[int, list[int]] = {}
                        for k in groups if exact else own:
                            for g in range(groups[k][0], groups[k][0] + groups[k][1]) if k in groups else ():
                                to.setdefault(g, []).append(k)
                        row += [i] * len(to)
                        group += to
                        wanted += to.values()
                    take = pa.array(row, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), *(part.column(c).take(take) for c in range(3)), pa.array(wanted, pa.list_(pa.int32()))], ["group", "query", "vector", "start", "lists"])

        def search(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            return search_group(rows, asked, shared.value.space, top, exact)

        routes = asked.mapInArrow(dealt, "group int, query long, vector array<double>, start float, lists array<int>")
        return candidates.groupBy("group").cogroup(routes.groupBy("group")).applyInPandas(search, "query long, score double, ids array<long>")

    total = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def ranked(own: DataFrame, hits: DataFrame) -> DataFrame:
        """query_id, hash, vector, query, left: the nearest rows of every query row, none for one without hits. One vector may be that of very many rows."""
        order = [F.desc("score"), F.asc("id")]
        best = hits.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.element_at("ids", 1)))).where(F.col("r") <= top + 1)
        each = best.select("query", "score", F.explode("ids").alias("id")).withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("r") <= top + 1)
        answers = each.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("near"))
        near = F.coalesce("near", F.array().cast("array<struct<r:int,id:long,score:double>>"))
        facts = written(asked.join(answers, "query", "left").select(F.xxhash64("vector").alias("hash"), "vector", "n", "query", near.alias("near")), "answers")
        both = with_facts(own.select("query_id", "hash", "vector"), facts, ["hash", "vector"], "n", total)
        return both.select("query_id", "hash", "vector", "query", F.slice(F.filter("near", lambda s: s["id"] != F.col("query_id")), 1, top).alias("left"))

    found = ranked(asking.withColumnRenamed("id", "query_id"), hits(asked, False))
    whole = F.size("left") >= min(top, lengths[0]["count"] - 1)
    short = found.where(~whole)
    if not short.isEmpty():
        again = asked.join(short.select("query").distinct(), "query", "left_semi").select(*asked.columns)
        found = found.where(whole).union(ranked(short, hits(again, True)))
    out = found.select("query_id", F.posexplode("left").alias("i", "s"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("s.id").alias("vec_id"), F.col("s.score").alias("score"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_ann": op3_ann}
ORACLES: dict[str, str] = {}
