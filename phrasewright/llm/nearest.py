"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are rotated by fast pseudo-rotations (random signs and a Hadamard transform, three times) and assigned to the
nearest signed axis: one bucket of 2 * dimension in each table. A query probes, in each table, the buckets of the axes
nearest to it; the candidates found there are scored exactly, in double precision, on the original vectors. For largest
inner products among vectors of different lengths, members are parted by length: within a band of about equal lengths, the
nearest directions have the largest inner products.

How many tables and buckets a band's queries probe is measured on the vectors at hand, at every size: the true neighbours of some queries
are found by scoring every row, and of the choices that reach RECALL of them each band takes the one that looks at the fewest rows.

Buckets are cut into cells of bounded size by counts, members against queries, so a hot bucket becomes many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship

#: Tables at most, and rows of a cell.
TABLES, CELL = 6, 4096
#: The part of the true neighbours of SAMPLE queries that each band's probes have to reach (0.9 is promised).
RECALL, SAMPLE = 0.94, 100
#: Bands of lengths, from the longest down by this ratio; the last one takes all that are shorter.
BANDS, RATIO = 6, 1.25
#: Buckets are taken together to so many where all are probed.
COARSE = 128


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Hadamard transform of each row (a power of two long), scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2)
        step *= 2
    return x.reshape(n, d) / np.sqrt(d)


class CrossPolytope:
    """Bucket numbers of vectors in several tables."""

    def __init__(self, dims: int, tables: int, longest: float, equal: bool, seed: int = 5):
        self.dims, self.longest, self.equal = dims, longest, equal
        self.width = 1 << max(1, (dims + (not equal) - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, 3, self.width))

    def _rotated(self, x: np.ndarray, table: int, member: bool) -> np.ndarray:
        wide = np.zeros((len(x), self.width))
        wide[:, : self.dims] = x / np.linalg.norm(x, axis=1, keepdims=True) if not member or self.equal else x / self.longest
        if member and not self.equal:
            wide[:, self.dims] = np.sqrt(np.maximum(0, 1 - (wide * wide).sum(1)))
        for s in self.signs[table]:
            wide = hadamard(wide * s)
        return wide

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        r = self._rotated(x, table, True)
        axis = np.abs(r).argmax(1)
        return 2 * axis + (r[np.arange(len(r)), axis] > 0)

    def probes(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        r = self._rotated(x, table, False)
        near = np.stack((-r, r), 2).reshape(len(r), -1)
        return np.argsort(-near, axis=1, kind="stable")[:, :n]


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _merge(k: int):
    """Lists of (ids, scores) of each query to its best k."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query, lists in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, first = np.unique(np.frombuffer(b"".join(x["ids"] for x in lists), np.int64), return_index=True)
                scores = np.frombuffer(b"".join(x["scores"] for x in lists))[first]
                top = _best(ids, scores, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), query)), pa.array(np.arange(1, len(top) + 1, dtype=np.int32)), pa.array(ids[top]), pa.array(scores[top])], names=["query_id", "rank", "vec_id", "score"])

    return run


LISTS, FOUND = "query_id long, ids binary, scores binary", "query_id long, rank int, vec_id long, score double"


def _merged(lists: DataFrame, k: int) -> DataFrame:
    return lists.groupBy("query_id").agg(F.collect_list(F.struct("ids", "scores")).alias("lists")).mapInArrow(_merge(k), FOUND)


def _true(valid: DataFrame, qi: np.ndarray, qx: np.ndarray, k: int) -> DataFrame:
    """The k best rows of a few queries, by scoring every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores = np.zeros((len(qi), 0), np.int64), np.zeros((len(qi), 0))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                own = np.broadcast_to(part.column(0).to_numpy(), (len(qi), part.num_rows))
                near = qx @ _rows(part.column(1)).T
                near[own == qi[:, None]] = -np.inf
                ids, scores = np.concatenate((ids, own), 1), np.concatenate((scores, near), 1)
                top = np.lexsort((ids, -scores), axis=1)[:, :k]
                ids, scores = np.take_along_axis(ids, top, 1), np.take_along_axis(scores, top, 1)
        for q, i, s in zip(qi, ids, scores, strict=True):
            if (s > -np.inf).any():
                yield pa.RecordBatch.from_arrays([pa.array([q], pa.int64()), pa.array([i[s > -np.inf].tobytes()], pa.binary()), pa.array([s[s > -np.inf].tobytes()], pa.binary())], names=["query_id", "ids", "scores"])

    return _merged(valid.select("vec_id", "v").mapInArrow(run, LISTS), k)


def cheapest(ranks: np.ndarray) -> tuple[int, int]:
    """(tables, probes) that reach RECALL of some pairs with the fewest buckets looked at, of all tables together.

    ranks: pairs x tables, the place of each member's bucket among its query's probes. Tables pay where near neighbours are near; where
    none are, one table with many probes looks at fewer rows than several that find the same rows again.
    """
    need, best = math.ceil(RECALL * len(ranks)), (math.inf, 1, 1)
    for tables in range(1, ranks.shape[1] + 1):
        probes = int(np.sort(ranks[:, :tables].min(1))[need - 1]) + 1
        best = min(best, (tables * probes, tables, probes))
    return best[1:]


def _plan(valid: DataFrame, index: CrossPolytope, tables: int, k: int) -> dict[int, tuple[int, int]]:
    """(tables, probes) of each band. A band without a neighbour of the sampled queries takes the choice made for all bands' pairs."""
    every = 2 * index.width
    bands = [r["band"] for r in valid.select("band").distinct().collect()]  # at most BANDS rows
    picked = valid.where("asks").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "v").collect()
    qi, qx = np.array([r["vec_id"] for r in picked]), np.array([r["v"] for r in picked])
    pairs = _true(valid, qi, qx, k).join(valid.select("vec_id", "v", "band"), "vec_id").select("query_id", "v", "band").collect()  # at most SAMPLE * k rows
    if not pairs:
        return dict.fromkeys(bands, (1, every))
    asking, x = np.searchsorted(qi[(order := np.argsort(qi))], [r["query_id"] for r in pairs]), np.array([r["v"] for r in pairs])
    ranks = np.empty((len(pairs), tables), int)
    for t in range(tables):
        place = np.argsort(index.probes(qx[order], t, every), axis=1)
        ranks[:, t] = place[asking, index.buckets(x, t)]
    band = np.array([r["band"] for r in pairs])
    return {b: cheapest(ranks[band == b] if (band == b).any() else ranks) for b in bands}


def nearest(vectors: DataFrame, is_query: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, probes: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that satisfies the SQL condition is_query, the k other rows of largest
    inner product among its candidates, nearest first, ties to the smaller id.

    Rows take no part if the id is null or the vector is null, zero, of another dimension than most, or holds a null or
    non-finite component. Rows that repeat an id count once; other columns may have any names. At most `tables` tables are used; with `probes`,
    all of them, and so many probes in each instead of what is measured. A query for which the tables find fewer than k is held against
    all rows. No rows, or no query, give no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    valid = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.expr(f"coalesce({is_query}, false)").alias("asks"))
    valid = valid.where("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    valid = valid.groupBy("vec_id").agg(F.min(F.struct("v", "asks")).alias("r")).select("vec_id", "r.v", "r.asks")
    norm = F.expr("sqrt(aggregate(v, 0d, (a, x) -> a + x * x))")
    shapes = valid.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("high"), F.sum(F.col("asks").cast("long")).alias("q"))
    shape = shapes.orderBy(F.desc("n"), "d").first()
    if shape is None or not shape["q"]:
        return spark.createDataFrame([], FOUND)
    below = F.floor((F.log(F.lit(shape["high"])) - F.log(norm)) / math.log(RATIO))
    band = F.coalesce(F.greatest(F.lit(0), F.least(F.lit(BANDS - 1), below)), F.lit(BANDS - 1)).cast("int")
    valid = materialise(valid.where(F.size("v") == shape["d"]).withColumn("band", band), "vectors")
    index = CrossPolytope(shape["d"], tables, 1.0, True)
    every = 2 * index.width
    whole = dict.fromkeys(range(BANDS), (1, every))
    plan = _plan(valid, index, tables, k) if probes is None else dict.fromkeys(range(BANDS), (tables, min(probes, every)))
    found = materialise(_search(valid, index, k, plan), "found")
    if any(p < every for _, p in plan.values()):
        short = valid.where("asks").join(found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n")), "vec_id", "left").where(f"coalesce(n, 0) < {min(k, shape['n'] - 1)}").select("vec_id", "v", F.lit(True).alias("asks"))
        if not short.isEmpty():
            again = _search(valid.withColumn("asks", F.lit(False)), index, k, whole, short)
            found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return found


def _search(valid: DataFrame, index: CrossPolytope, k: int, plan: dict[int, tuple[int, int]], queries: DataFrame | None = None) -> DataFrame:
    """The best k of each query among the candidates of the plan's (tables, probes) in each band."""
    queries = valid.where("asks") if queries is None else queries
    every, most = 2 * index.width, max(t for t, _ in plan.values())
    coarse = min(COARSE, every)
    #: t numbers the tables of all bands

    def asking(x: np.ndarray, ids: pa.Array) -> Iterator[tuple[pa.Array, int, np.ndarray]]:
        for t in range(most):
            deep = max((p for tables, p in plan.values() if t < tables and p < every), default=0)
            order = index.probes(x, t, deep) if deep else None
            for band, (tables, p) in plan.items():
                if t < tables:
                    yield ids, band * most + t, order[:, :p] if p < every else np.broadcast_to(np.arange(coarse), (len(x), coarse))

    def lying(x: np.ndarray, ids: pa.Array, band: np.ndarray) -> Iterator[tuple[pa.Array, int, np.ndarray]]:
        for b in np.unique(band).tolist():
            own = np.flatnonzero(band == b)
            tables, p = plan[b]
            for t in range(tables):
                bucket = index.buckets(x[own], t)
                yield ids.take(pa.array(own)), b * most + t, (bucket if p < every else bucket % coarse)[:, None]

    def keys(asked: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    x = _rows(part.column(1))
                    for own, t, b in asking(x, part.column(0)) if asked else lying(x, part.column(0), part.column(2).to_numpy()):
                        ids = own.take(pa.array(np.repeat(np.arange(len(own)), b.shape[1])))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(b.size, t, np.int32)), pa.array(b.ravel().astype(np.int32))], names=["vec_id", "t", "bucket"])

        return run

    kind = "vec_id long, t int, bucket int"
    members = materialise(valid.select("vec_id", "v", "band").mapInArrow(keys(False), kind), "members")
    asked = materialise(queries.select("vec_id", "v").mapInArrow(keys(True), kind), "asked")
    count = lambda d, n: d.groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias(n))
    sizes = F.broadcast(count(members, "mb").join(count(asked, "qb"), ["t", "bucket"]))  # at most BANDS * tables * 2 * width rows
    deal = lambda n: F.pmod(F.hash("vec_id"), F.col(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = members.join(sizes, ["t", "bucket"]).withColumn("i", deal("mb")).withColumn("j", spread("qb")).withColumn("role", F.lit(0))
    two = asked.join(sizes, ["t", "bucket"]).withColumn("j", deal("qb")).withColumn("i", spread("mb")).withColumn("role", F.lit(1))
    pick = lambda d, of: d.join(of.select("vec_id", "v"), "vec_id").select("t", "bucket", "i", "j", "role", "vec_id", "v")
    cells = pick(one, valid).unionByName(pick(two, queries)).repartition("t", "bucket", "i", "j").sortWithinPartitions("t", "bucket", "i", "j", "role")

    def cell(sides: tuple[list, list]) -> Iterator[pa.RecordBatch]:
        if not sides[0] or not sides[1]:
            return
        (ci, cx), (qi, qx) = ((np.concatenate([p[0] for p in s]), np.concatenate([p[1] for p in s])) for s in sides)
        found = []
        for a in range(0, len(qi), 256):
            near = qx[a : a + 256] @ cx.T
            near[qi[a : a + 256, None] == ci[None, :]] = -np.inf
            for q, row in enumerate(near, a):
                own = np.flatnonzero(row > -np.inf) if len(ci) <= k else np.flatnonzero((row >= np.partition(row, -k)[-k] - 1e-9) & (row > -np.inf))
                exact = (cx[own] * qx[q]).sum(1)  # the same operations for a pair wherever it is met
                top = _best(ci[own], exact, k)
                found.append((qi[q], ci[own][top].tobytes(), exact[top].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.binary())], names=["query_id", "ids", "scores"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, ([], [])
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in range(5)], 1)
            ids, x = batch.column(5).to_numpy(), _rows(batch.column(6))
            cut = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(key)])), strict=True):
                if b > a:
                    if at != (now := tuple(key[a, :4])):
                        yield from cell(sides)
                        at, sides = now, ([], [])
                    sides[key[a, 4]].append((ids[a:b], x[a:b]))
        yield from cell(sides)

    return _merged(cells.mapInArrow(score, LISTS), k)
