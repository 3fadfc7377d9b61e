"""Near copies among embeddings of one label, by an inverted multi-index.

1. Equal vectors of a label are one node with its rows' number, told apart by a digest that is counted before it is
   shuffled, so a vector that a third of all rows share is no load.
2. Unit vectors are rotated at random and cut into halves. Each half has its own codebook, fitted on SAMPLE vectors (those
   with the lowest hashes; a documented bound); the product of both codebooks is the grid, about LIST nodes to a cell.
3. How far a node looks: for each cell and half, the distance from the node to the border between the cell and its own is
   less than that to anything in the cell. multi_sequence() visits cells by the sum of both squares, nearest first, until
   it exceeds the reach. The reach is the least by which TARGET of the links of the sample are found from one of their
   ends, and as much of made pairs that are just as near as a link has to be, in random directions.
4. Cells of a label are taken together to groups of about GROUP_ROWS. A node goes once to each group with a cell that it
   visits. Groups of more nodes are split, and so are the nodes that come to one group: parts meet parts, no task holds a
   whole. Similarities are computed in double precision on the vectors as given; nothing below the threshold links.
5. A task returns how many rows each node links to, and a forest of what it found, never pairs. A pair is counted for a
   node where that node visits; for the other one too where the other doesn't visit back. Components follow.

Vectors that are null, zero or hold null or non-finite components, and rows without label or key, link with nothing. Only
vectors of equal length are compared. Rows that repeat count as others. An empty table gives no row. Only the key, vector
and label columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpoint.llm.common import MOST_FREQUENT, table, with_facts, written
from gridpoint.llm.components import connected_components

SAMPLE = 16_384
LEAST = 0.93
TARGET = 0.999
#: Nodes to a cell, about, and of a group.
LIST = 64
GROUP_ROWS = 8192
#: Sampled vectors that the reach is measured from.
MEASURED = 2048
#: Similarities that a task holds at once.
AT_ONCE = 1 << 22


def rotation(size: int, seed: int = 13) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))[0]


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of every row of a to every row of b."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T), 0)


def codebook(points: np.ndarray, n: int, rounds: int = 10, seed: int = 17) -> np.ndarray:
    found = points[np.random.default_rng(seed).permutation(len(points))[:n]].copy()
    for _ in range(rounds):
        own = np.concatenate([squares(points[s : s + 4096], found).argmin(axis=1) for s in range(0, len(points), 4096)])
        counts = np.bincount(own, minlength=n)
        sums = np.zeros_like(found)
        np.add.at(sums, own, points)
        found[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return found[np.argsort(found @ np.linalg.svd(found - found.mean(axis=0), full_matrices=False)[2][0])]  # neighbours have near numbers


def multi_sequence(first: np.ndarray, second: np.ndarray, most: float) -> Iterator[tuple[int, int]]:
    """Pairs of codewords by the growing sum of their squared bounds, up to most."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = a[first[a] <= most].tolist(), b[second[b] <= most].tolist()
    near, far = first[a].tolist(), second[b].tolist()
    queue = [(near[0] + far[0], 0, 0)]
    while queue:
        total, i, j = heapq.heappop(queue)
        if total > most:
            return
        yield a[i], b[j]
        if j == 0 and i + 1 < len(a):
            heapq.heappush(queue, (near[i + 1] + far[0], i + 1, 0))
        if j + 1 < len(b):
            heapq.heappush(queue, (near[i] + far[j + 1], i, j + 1))


class Grid:
    """Rotation, both codebooks, and the squared reach."""

    def __init__(self, sample: list[np.ndarray], labels: list, size: int, total: int, least: float, target: float):
        self.size, self.half, self.turn = size, (size + 1) // 2, rotation(size)
        points = self.points(sample)
        self.words = max(1, min(round(math.sqrt(total / LIST)), len(sample) // 8))
        self.books = [codebook(x, self.words) for x in self.halves(points)]
        for book in self.books:
            self.words = min(self.words, len(book))
        self.reach = 0.0
        rng = np.random.default_rng(19)
        some = points[:MEASURED]
        away = rng.standard_normal(some.shape)
        away -= (away * some).sum(axis=1, keepdims=True) * some
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
        made = self.between(some, least * some + math.sqrt(1 - least * least) * away)
        owner = np.array(labels)
        a, b = [], []
        for s in range(0, len(some), 256):
            x, y = np.nonzero((some[s : s + 256] @ points.T >= least) & (owner[s : s + 256][:, None] == owner[None]))
            x += s
            a.append(x[x != y]), b.append(y[x != y])
        a, b = np.concatenate(a), np.concatenate(b)
        pick = rng.permutation(len(a))[: 4 * MEASURED]
        self.reach = max(float(np.quantile(d, target, method="higher")) if len(d) else 0.0 for d in (made, self.between(points[a[pick]], points[b[pick]]))) * (1 + 1e-9) + 1e-12

    def points(self, vectors: list[np.ndarray]) -> np.ndarray:
        """Unit vectors, rotated. Of longer ones the first components are taken, shorter ones are filled with zeros: distances don't grow."""
        out = np.zeros((len(vectors), self.size))
        for i, v in enumerate(vectors):
            v = v / np.abs(v).max()
            out[i, : min(len(v), self.size)] = (v / np.sqrt(v @ v))[: self.size]
        return out @ self.turn

    def halves(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return points[:, : self.half], points[:, self.half :]

    def bounds(self, points: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """For each half the squares of the distances to the borders of all codewords' regions, and each point's cell."""
        out, own = [], []
        for x, book in zip(self.halves(points), self.books):
            d = squares(x, book)
            at = d.argmin(axis=1)
            apart = np.sqrt(squares(book, book))[at]
            near = d[np.arange(len(x)), at][:, None]
            out.append((np.maximum(d - near, 0) / np.where(apart > 0, 2 * apart, np.inf)) ** 2)
            own.append(at)
        return out, own[0] * self.words + own[1]

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far one end of each pair has to look to find the other, whichever looks less."""
        (a1, a2), cell_a = self.bounds(a)
        (b1, b2), cell_b = self.bounds(b)
        at = np.arange(len(a))
        from_a = a1[at, cell_b // self.words] + a2[at, cell_b % self.words]
        return np.minimum(from_a, b1[at, cell_a // self.words] + b2[at, cell_a % self.words])

    def visited(self, points: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Each point's cell and all that it visits."""
        (first, second), own = self.bounds(points)
        return own, [sorted(i * self.words + j for i, j in multi_sequence(f, s, self.reach)) for f, s in zip(first, second)]


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least member of each tree) after joining a to b."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not (label[label] == label).all():
            label = label[label]


def matrix(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


FOUND = "node long, links long, root long"


def meet(rows: pd.DataFrame, asking: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of the asking nodes with those of one part of a group: rows linked to (node, links) and a forest (node, root)."""
    nodes = np.unique(np.concatenate([rows["node"].to_numpy(np.int64), asking["node"].to_numpy(np.int64)]))
    links, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    for n, here in rows.groupby("length"):
        there = asking[asking["length"] == n]
        if not len(there):
            continue
        here = here.sort_values("cell", ignore_index=True)
        x, y = matrix(there["vector"]), matrix(here["vector"])
        at_x, at_y = np.searchsorted(nodes, there["node"]), np.searchsorted(nodes, here["node"])
        times_x, times_y = there["n"].to_numpy(), here["n"].to_numpy()
        cells, starts = np.unique(here["cell"].to_numpy(), return_index=True)
        ends = np.append(starts[1:], len(here))
        own = there["cell"].to_numpy()
        wants = there["visits"].tolist()
        visits = np.sort(np.concatenate([i * (1 << 40) + np.asarray(v, np.int64) for i, v in enumerate(here["visits"])]))
        wanted = pd.DataFrame({"cell": np.concatenate([np.asarray(v, np.int64) for v in wants]), "row": np.repeat(np.arange(len(wants)), [len(v) for v in wants])})
        for cell, row in wanted.groupby("cell")["row"]:
            k = int(np.searchsorted(cells, cell))
            if k == len(cells) or cells[k] != cell:
                continue
            s, e = starts[k], ends[k]
            row = row.to_numpy()
            for part in np.array_split(row, max(1, -(-len(row) * int(e - s) // AT_ONCE))):
                i, j = np.nonzero(x[part] @ y[s:e].T >= least)
                i, j = part[i], j + s
                other = at_x[i] != at_y[j]
                i, j = i[other], j[other]
                if not len(i):
                    continue
                np.add.at(links, at_x[i], times_y[j])
                back = j * (1 << 40) + own[i]
                place = np.minimum(np.searchsorted(visits, back), len(visits) - 1)
                alone = visits[place] != back  # the other one doesn't visit back
                np.add.at(links, at_y[j[alone]], times_x[i[alone]])
                label = forest(label, at_x[i], at_y[j])
    some = np.flatnonzero((links > 0) | (label != np.arange(len(nodes))))
    return pd.DataFrame({"node": nodes[some], "links": links[some], "root": nodes[label[some]]})


def parts_of(counts: DataFrame, total: int, on: list[str], name: str) -> DataFrame:
    """Into how many parts groups of more than GROUP_ROWS rows are split: at most MOST_FREQUENT groups, so the table may be broadcast."""
    most = max(GROUP_ROWS, total // MOST_FREQUENT)
    return F.broadcast(written(counts.where(F.col("n") > most).select(*on, F.ceil(F.col("n") / most).cast("int").alias(name)), name))


def near_copies(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST, target: float = TARGET, sample: int = SAMPLE) -> DataFrame:
    """key, n_links, component_id (the least key that links reach), kept (whether it is the row's own) of every row."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    given = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label"))
    takes = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite, F.lit(False))
    rows = given.withColumn("takes", takes).withColumn("vector", F.transform(v, lambda x: x + F.lit(0.0)))  # no -0
    rows = rows.withColumn("sign", F.when(F.col("takes"), F.sha2(F.array_join(v.cast("array<string>"), ","), 256)))
    alone = rows.where(~F.col("takes")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    rows = rows.where("takes")

    same = rows.groupBy("label", "sign").agg(F.first("vector").alias("vector"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    nodes = written(same.withColumn("node", F.monotonically_increasing_id()).withColumn("length", F.size("vector")), "nodes")
    total = nodes.count()
    if not total:
        return _named(alone, key)
    size = nodes.groupBy("length").count().orderBy(F.desc("count"), "length").first()["length"]
    drawn = nodes.orderBy(F.xxhash64("sign", F.lit(7))).limit(sample).select("label", "vector").toPandas()
    grid = Grid([np.array(x, np.float64) for x in drawn["vector"]], drawn["label"].tolist(), size, total, least, target)
    shared = df.sparkSession.sparkContext.broadcast(grid)
    groups = max(1, total // GROUP_ROWS)
    wide, high = (-(-grid.words // groups), grid.words) if groups <= grid.words else (1, max(1, grid.words**2 // groups))
    of = lambda cell: F.floor(F.floor(cell / grid.words) / wide) * (1 + grid.words // high) + F.floor((cell % grid.words) / high)

    def place(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = shared.value
        for batch in found:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                own, visits = grid.visited(grid.points([np.array(x) for x in part.column(1).to_pylist()]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.int64()), pa.array(visits, pa.list_(pa.int64()))], ["node", "cell", "visits"])

    cells = nodes.select("node", "vector").mapInArrow(place, "node long, cell long, visits array<long>")
    placed = written(cells.join(nodes.select("node", "label", "n", "length", "vector"), "node"), "placed").withColumn("group", of(F.col("cell")))
    goes = placed.select(*(F.col(c).alias(c) for c in placed.columns)).withColumn("group", F.explode(F.array_distinct(F.transform("visits", of))))
    on = ["label", "group"]
    rows_n = placed.groupBy(on).agg(F.count(F.lit(1)).alias("n"))
    goes_n = goes.groupBy(on).agg(F.count(F.lit(1)).alias("n"))
    parts, slices = parts_of(rows_n, total, on, "parts"), parts_of(goes_n, total, on, "slices")
    one = F.lit(1)

    def split(of: DataFrame, mine: str, others: str) -> DataFrame:
        """Each row in one part of its own side, with all parts of the other."""
        both = of.join(parts, on, "left").join(slices, on, "left")
        both = both.withColumn(mine, F.pmod(F.xxhash64("node"), F.coalesce(mine, one)).cast("int"))
        return both.withColumn(others, F.explode(F.sequence(F.lit(0), F.coalesce(others, one) - 1)))

    columns = ["label", "group", "parts", "slices", "node", "n", "length", "cell", "visits", "vector"]
    here = split(placed, "parts", "slices").select(columns)
    there = split(goes, "slices", "parts").withColumn("visits", F.filter("visits", lambda c: of(c) == F.col("group"))).select(columns)
    task = ["label", "group", "parts", "slices"]

    def search(rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        return meet(rows, asking, least)

    found = written(here.groupBy(task).cogroup(there.groupBy(task)).applyInPandas(search, FOUND), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = written(connected_components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))), "components")
    rooted = nodes.join(components, "node", "left").join(links, "node", "left").select("label", "sign", "least", "n", F.coalesce("component", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    rooted = written(rooted, "rooted")
    ids = written(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "ids")
    facts = written(with_facts(rooted, ids, ["root"], "members", total).select("label", "sign", "n", "n_links", "component_id"), "facts")
    out = with_facts(rows.select("id", "label", "sign"), facts, ["label", "sign"], "n", facts.agg(F.sum("n")).first()[0])
    return _named(out.select("id", "n_links", "component_id").unionByName(alone), key)


def _named(out: DataFrame, key: str) -> DataFrame:
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op13_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "embeddings"))


#: Every pair compared; components by following links.
OP13_SQL = f"""WITH RECURSIVE vectors AS (SELECT row_number() OVER () AS node, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
whole AS MATERIALIZED (SELECT * FROM vectors WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.node AS a, b.node AS b, b.vec_id FROM whole a JOIN whole b ON a.label = b.label AND len(a.v) = len(b.v) AND a.node <> b.node
          WHERE list_cosine_similarity(a.v, b.v) >= {LEAST}),
reach(node, other) AS (SELECT a, b FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT r.node, min(w.vec_id) AS low FROM reach r JOIN whole w ON w.node = r.other GROUP BY r.node),
counts AS (SELECT a AS node, count(*) AS n FROM links GROUP BY a),
rows_ AS (SELECT w.vec_id, coalesce(c.n, 0) AS n_links, least(w.vec_id, l.low) AS component_id FROM whole w LEFT JOIN counts c USING (node) LEFT JOIN least l USING (node)
          UNION ALL SELECT vec_id, 0, vec_id FROM embeddings WHERE vec_id IS NULL OR label IS NULL OR embedding IS NULL
          UNION ALL SELECT vec_id, 0, vec_id FROM vectors WHERE node NOT IN (SELECT node FROM whole))
SELECT vec_id, n_links::BIGINT AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM rows_"""

QUERIES = {"op13_multi_index": op13_multi_index}
ORACLES = {"op13_multi_index": OP13_SQL}
