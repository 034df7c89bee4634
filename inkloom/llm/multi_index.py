"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the vectors, form a product grid of cells,
whose number follows the rows. Each vector lives in its nearest cell and visits
the cells nearest to it by the multi-sequence traversal: both half lists are
sorted, and the cell with the least sum of distances is taken from a frontier of
one open cell for each entry of the first list, until as many are taken as a
sample shows to be needed for TARGET recall, both on pairs made at the threshold
and on its own pairs above it. Of two vectors the one with the smaller home cell
visits the other's, so that each pair meets once, and a cell is left out where
the planes between codewords show that nothing in it can be near enough. Where a
visitor meets the vectors of a cell, cosines are verified in double precision.
Cells are cut into blocks, so that a hot cell is many tasks; each task gives
link counts and a spanning forest, never the pairs. Equal vectors are one row
with a weight.

Defined cases: null, zero, empty, or not wholly finite vectors link with
nothing and are their own component; vectors of different lengths never link;
repeated rows count as others; a null vec_id gives a null component unless it
links; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_join, connected_components, discard, materialize
from .simhash import Forest

THRESHOLD = 0.95
TARGET = 0.995
#: Vectors that fit the codebooks and the number of visits, for each codeword of a half and at most; every vector is indexed.
SAMPLE_EACH, SAMPLE = 32, 32_768
#: Codewords of a half at most: 4 million cells. Beyond 800 million vectors cells hold more than CELL, in more blocks.
CODEWORDS = 2048
CELL = 200
BLOCK = 2048


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        near = squares(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=len(centres))
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None, :]


class Grid:
    """The product grid of two codebooks (of one for vectors of a single component)."""

    def __init__(self, sample: np.ndarray, codewords: int, threshold: float):
        self.half = max(1, sample.shape[1] // 2)
        halves = [sample[:, : self.half], sample[:, self.half :]] if sample.shape[1] > 1 else [sample, np.zeros((len(sample), 1))]
        self.books = [kmeans(h, codewords) for h in halves]
        self.apart = [np.sqrt(np.maximum(squares(b, b), 0)) for b in self.books]
        self.reach = 2 - 2 * threshold  # squared distance of unit vectors at the threshold
        self.visits = self._calibrated(sample, threshold)

    def distances(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves of each row to the codewords."""
        other = rows[:, self.half :] if rows.shape[1] > 1 else np.zeros((len(rows), 1))
        return tuple(np.maximum(squares(h, b), 0) for h, b in zip((rows[:, : self.half], other), self.books))

    def traverse(self, rows: np.ndarray, visits: int) -> np.ndarray:
        """The first cells of each row by the multi-sequence traversal, nearest first; -1 where there are no more."""
        one, two = self.distances(rows)
        lists = [np.argsort(d, axis=1, kind="stable")[:, :visits] for d in (one, two)]
        a, b = (np.take_along_axis(d, i, 1) for d, i in zip((one, two), lists))
        each = np.arange(len(rows))
        # of each entry of the first list: how many of the second were taken with it, and the cost of the next
        taken = np.zeros(a.shape, np.int64)
        frontier = np.full(a.shape, np.inf)
        frontier[:, 0] = a[:, 0] + b[:, 0]
        out = np.full((len(rows), visits), -1, np.int64)
        for step in range(min(visits, len(self.books[0]) * len(self.books[1]))):
            i = frontier[:, : step + 1].argmin(axis=1)
            live = np.isfinite(frontier[each, i])
            j = np.minimum(taken[each, i], b.shape[1] - 1)
            out[live, step] = lists[0][each[live], i[live]] * len(self.books[1]) + lists[1][each[live], j[live]]
            taken[each, i] += 1
            more = taken[each, i]
            frontier[each, i] = np.where(more < b.shape[1], a[each, i] + b[each, np.minimum(more, b.shape[1] - 1)], np.inf)
            # the next entry of the first list opens with the first of the second
            opens = np.flatnonzero(live & (j == 0) & (i + 1 < a.shape[1]))
            frontier[opens, i[opens] + 1] = a[opens, i[opens] + 1] + b[opens, 0]
        return out

    def worthwhile(self, rows: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether a vector in a cell can be within reach of a row: it is on its codewords' side of the planes between them and the row's."""
        total = np.zeros(cells.shape)
        for d, apart, at in zip(self.distances(rows), self.apart, (cells // len(self.books[1]), cells % len(self.books[1]))):
            home = d.argmin(axis=1)
            gap = apart[home[:, None], at]
            beyond = np.take_along_axis(d, at, 1) - d[np.arange(len(d)), home][:, None]
            total += np.where(gap > 0, np.maximum(beyond, 0) / np.maximum(2 * gap, 1e-12), 0) ** 2
        return total <= self.reach + 1e-9

    def visited(self, rows: np.ndarray) -> np.ndarray:
        """Home cell and the cells after it that are visited, in the order of the traversal; -1 where there are no more."""
        cells = self.traverse(rows, self.visits)
        good = (cells > cells[:, :1]) & self.worthwhile(rows, np.maximum(cells, 0))
        good[:, 0] = True
        return np.where(good, cells, -1)

    def _steps(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """How many steps a traversal takes from the row of the smaller home cell to the home of the other."""
        a, b = self.distances(rows), self.distances(others)
        homes = [d[0].argmin(1) * len(self.books[1]) + d[1].argmin(1) for d in (a, b)]
        out = np.empty(len(rows), np.int64)
        for n, (x, y) in enumerate(zip(*homes)):
            d, goal = ((a[0][n], a[1][n]), y) if x <= y else ((b[0][n], b[1][n]), x)
            cost = d[0][goal // len(self.books[1])] + d[1][goal % len(self.books[1])]
            out[n] = np.searchsorted(np.sort(d[1]), cost - d[0] - 1e-12).sum() + 1
        return out

    def _calibrated(self, sample: np.ndarray, threshold: float) -> int:
        """Fewest visits at which pairs meet with TARGET recall: pairs at the threshold, and those of the sample above it."""
        rng = np.random.default_rng(11)
        some = sample[rng.choice(len(sample), min(len(sample), 1024), replace=False)]
        noise = rng.standard_normal(some.shape)
        noise -= (noise * some).sum(1)[:, None] * some
        norm = np.linalg.norm(noise, axis=1, keepdims=True)
        other = np.where(norm > 1e-9, threshold * some + np.sqrt(1 - threshold**2) * noise / np.maximum(norm, 1e-9), some)
        steps = [self._steps(some, other)]
        pairs = np.argwhere(np.triu(some @ sample.T >= threshold, 1))[:4096] if len(some) == len(sample) else np.argwhere(some @ sample.T >= threshold)
        pairs = pairs[rng.permutation(len(pairs))[:4096]]
        if len(pairs):
            steps.append(self._steps(some[pairs[:, 0]], sample[pairs[:, 1]]))
        return max(int(np.quantile(s, TARGET, method="higher")) for s in steps)


def codewords_for(n: int) -> int:
    """Codewords of a half, so that cells hold about CELL vectors: 8 x 8 cells at least."""
    return int(np.clip(2 ** round(np.log2(max(n, 1) / CELL) / 2), 8, CODEWORDS))


def _clean(embeddings: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where(F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


INDEXED = "gid long, weight long, vector binary, dim int, home long, visits array<long>"


def index(distinct: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The stored distinct vectors (gid, weight, embedding) with their home cell and the cells that they visit, home first."""
    spark = distinct.sparkSession
    codewords = codewords_for(distinct.count())
    sample = distinct.orderBy(F.xxhash64("gid")).select("embedding").limit(min(SAMPLE, SAMPLE_EACH * codewords)).collect()
    by_dim: dict[int, list] = {}
    for row in sample:
        by_dim.setdefault(len(row.embedding), []).append(row.embedding)
    grids = {dim: Grid(unit(np.array(rows)), codewords, threshold) for dim, rows in by_dim.items()}
    shared = spark.sparkContext.broadcast(grids)  # two codebooks of CODEWORDS at most for each length in the sample

    def place(batches):
        for batch in batches:
            rows = batch.column("embedding").to_pylist()
            visits: list = [[0]] * len(rows)
            for dim in {len(r) for r in rows} & set(shared.value):
                mine = [i for i, r in enumerate(rows) if len(r) == dim]
                for at in range(0, len(mine), 1024):
                    part = mine[at : at + 1024]
                    for i, c in zip(part, shared.value[dim].visited(unit(np.array([rows[i] for i in part])))):
                        visits[i] = c[c >= 0].tolist()
            vectors = [np.array(r, "<f4").tobytes() for r in rows]
            arrays = [batch.column("gid"), batch.column("weight"), pa.array(vectors, pa.binary()), pa.array([len(r) for r in rows], pa.int32()), pa.array([v[0] for v in visits], pa.int64()), pa.array(visits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in INDEXED.split(", ")])

    return distinct.select("gid", "weight", "embedding").mapInArrow(place, INDEXED)


OUT = "gid long, n long, u long, v long"


def _meet(table: pa.Table, threshold: float) -> pa.Table:
    """Link counts (gid, n) and forest edges (u, v) of one block of visitors and one block of a cell."""
    side = table.column("side").to_numpy()
    gid, weight, home, cell = (table.column(c).to_numpy() for c in ("gid", "weight", "home", "cell"))
    m, v = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(m) or not len(v):
        return pa.table({c.split()[0]: pa.array([], pa.int64()) for c in OUT.split(", ")})
    rows = unit(np.frombuffer(b"".join(table.column("vector").to_pylist()), "<f4").reshape(len(gid), -1))
    guests = home != cell
    count = np.zeros(len(gid), np.int64)
    forest = Forest(len(gid))
    for begin in range(0, len(v), 512):
        part = v[begin : begin + 512]
        link = (rows[part] @ rows[m].T >= threshold) & (gid[part][:, None] != gid[m][None, :])
        count[part] += link @ weight[m]
        # members meet each other from both sides, guests only here
        count[m] += np.where(guests[part], weight[part], 0) @ link
        for i in np.flatnonzero(link.any(axis=1)):
            forest.merge(int(part[i]), m[np.flatnonzero(link[i])])
    label, some = forest.settle(), np.flatnonzero(count)
    moved = np.flatnonzero(label != np.arange(len(gid)))
    none = lambda n: pa.nulls(n, pa.int64())
    counts = pa.table({"gid": gid[some], "n": count[some], "u": none(len(some)), "v": none(len(some))})
    edges = pa.table({"gid": none(len(moved)), "n": none(len(moved)), "u": gid[moved], "v": gid[label[moved]]})
    return pa.concat_tables([counts, edges])


def met(indexed: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """What _meet gives for all cells of a stored index."""
    members = indexed.withColumn("cell", F.col("home"))
    visitors = indexed.withColumn("cell", F.explode("visits"))
    blocks = lambda rows, name: rows.groupBy("dim", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = materialize(blocks(members, "of_members").join(blocks(visitors, "of_visitors"), ["dim", "cell"]), "cells")
    spread = lambda rows, mine, other, side: (
        checked_join(rows, sizes, ["dim", "cell"], salt=F.col("gid"))
        .withColumn("mine", F.pmod(F.xxhash64("gid", F.lit(side)), F.col(mine)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        .select("dim", "cell", F.col("mine" if side == 0 else "other").alias("mb"), F.col("other" if side == 0 else "mine").alias("vb"), F.lit(side).alias("side"), "gid", "weight", "home", "vector")
    )
    both = spread(members, "of_members", "of_visitors", 0).unionByName(spread(visitors, "of_visitors", "of_members", 1))
    return both.groupBy("dim", "cell", "mb", "vb").applyInArrow(lambda t: _meet(t, threshold), OUT)


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of each vector."""
    rows = embeddings.select("vec_id", "embedding")
    distinct = _clean(rows).groupBy("embedding").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    distinct = materialize(distinct.withColumn("gid", F.monotonically_increasing_id()), "vectors")
    indexed = materialize(index(distinct, threshold), "indexed")
    found = materialize(met(indexed, threshold), "met")
    counts = found.where("gid is not null").groupBy("gid").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("u is not null").select("u", "v"))
    discard(indexed)
    known = distinct.join(counts, "gid", "left").join(roots.withColumnRenamed("id", "gid"), "gid", "left").withColumn("root", F.coalesce("component", "gid"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(known.join(least, "root").select("embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"), "classes")
    # classes have no null embeddings, so that unclean rows find none
    out = rows.join(classes, "embedding", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
l AS (SELECT a.vec_id AS i, b.vec_id AS j FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
n AS (SELECT i, count(*) AS n_links FROM l GROUP BY i),
r(i, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.i, r.c FROM r JOIN l ON l.j = r.i),
m AS (SELECT i, min(c) AS component_id FROM r GROUP BY i)
SELECT m.i AS vec_id, coalesce(n_links, 0) AS n_links, component_id, m.i = component_id AS kept FROM m LEFT JOIN n ON n.i = m.i
"""
