"""Approximate nearest neighbours: stable projections in kd-trees, verified until a chi-square test stops the search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.runtime import cut

#: Numbers of directions to choose from; share of the points that a query may be expected to verify before more are taken.
DIMS, SHARE = (8, 16, 24, 32, 48), 0.15
#: Points of a bucket of a local tree, points of a leaf, queries that are searched in a leaf at a time.
BUCKET, LEAF, ASKED = 64, 32768, 1024
#: Rows that split values and the number of directions are learned from: the documented bound of the index sample.
SAMPLE_ROWS = 20_000


@lru_cache(maxsize=64)
def _law(dims: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distribution of A / (A + B), A and B chi-square variables of dims and width - dims degrees of freedom: values, odds.

    That is the share of a vector's squared length that falls into ``dims`` random orthonormal directions of ``width``.
    """
    t = (np.arange(40_000) + 0.5) / 40_000
    density = (dims / 2 - 1) * np.log(t) + ((width - dims) / 2 - 1) * np.log1p(-t)
    density = np.exp(density - density.max())
    return t, np.cumsum(density) / density.sum()


def odds_within(share: np.ndarray, dims: int, width: int) -> np.ndarray:
    """The probability that at most this share of a squared length falls into the directions."""
    return np.interp(share, *_law(dims, width), left=0.0, right=1.0)


def stopping_share(dims: int, width: int, sure: float) -> float:
    """The share that isn't exceeded with probability ``sure``: beyond it, times a squared distance, a nearer point would have been met."""
    t, p = _law(dims, width)
    return float(t[min(int(np.searchsorted(p, sure)), len(t) - 1)])


def directions_for(sample: np.ndarray, k: int, sure: float) -> int:
    """The least number of directions with which a query of the sample is expected to verify at most SHARE of the points."""
    width = sample.shape[1]
    able = [m for m in DIMS if 2 * m <= width] or [max(1, width // 2)]
    if len(sample) <= k + 1:
        return able[0]
    q = sample[:: max(1, len(sample) // 200)]
    far = np.maximum((q * q).sum(axis=1)[:, None] + (sample * sample).sum(axis=1)[None] - 2 * q @ sample.T, 0.0)
    kth = np.partition(far, k, axis=1)[:, k : k + 1]
    expected = [float(odds_within(stopping_share(m, width, sure) * kth / np.maximum(far, 1e-300), m, width).mean()) for m in able]
    return next((m for m, e in zip(able, expected) if e <= SHARE), able[int(np.argmin(expected))])


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """One more coordinate that makes all lengths ``most``: the nearest by distance is then the largest inner product."""
    return np.concatenate([x, np.sqrt(np.maximum(most * most - (x * x).sum(axis=1), 0.0))[:, None]], axis=1)


def directions(width: int, dims: int) -> np.ndarray:
    """Gaussian (2-stable) directions, made orthonormal."""
    return np.linalg.qr(np.random.default_rng(40).standard_normal((width, dims)))[0]


class Splits:
    """The upper levels of a kd-tree: each split is at the median of a sample, cyclic in the directions."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.dims, self.levels = sample.shape[1], max(0, (max(1, leaves) - 1).bit_length())
        parts, self.at = [sample], []
        lo, hi = [np.full(self.dims, -np.inf)], [np.full(self.dims, np.inf)]
        for level in range(self.levels):
            axis, values, next_parts, nlo, nhi = level % self.dims, [], [], [], []
            for p, a, b in zip(parts, lo, hi):
                v = float(np.median(p[:, axis])) if len(p) else 0.0
                values.append(v)
                next_parts += [p[p[:, axis] <= v], p[p[:, axis] > v]]
                up, down = a.copy(), b.copy()
                up[axis], down[axis] = max(a[axis], v), min(b[axis], v)
                nlo += [a, up]
                nhi += [down, b]
            self.at.append(np.array(values))
            parts, lo, hi = next_parts, nlo, nhi
        self.lo, self.hi = np.array(lo), np.array(hi)

    def leaf(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), dtype=np.int64)
        for level, values in enumerate(self.at):
            node = 2 * node + (p[:, level % self.dims] > values[node])
        return node

    def nearness(self, p: np.ndarray) -> np.ndarray:
        """Squared distance of a projected point to every leaf's box."""
        gap = np.maximum(np.maximum(self.lo - p, p - self.hi), 0.0)
        return (gap * gap).sum(axis=1)


class Tree:
    """A local kd-tree over projected points: buckets of about BUCKET points with their bounding boxes."""

    def __init__(self, p: np.ndarray):
        order, todo, cuts = np.arange(len(p)), [(0, len(p))], []
        while todo:
            a, b = todo.pop()
            if b - a <= BUCKET:
                cuts.append((a, b))
                continue
            own = order[a:b]
            axis = int(np.ptp(p[own], axis=0).argmax())
            m = (b - a) // 2
            order[a:b] = own[np.argpartition(p[own, axis], m)]
            todo += [(a, a + m), (a + m, b)]
        cuts.sort()
        self.order, self.start = order, np.array([a for a, _ in cuts])
        self.end = np.array([b for _, b in cuts])
        self.p = p[order]
        self.squares = (self.p * self.p).sum(axis=1)
        self.lo, self.hi = np.minimum.reduceat(self.p, self.start), np.maximum.reduceat(self.p, self.start)

    def _points(self, buckets: np.ndarray) -> np.ndarray:
        n = self.end[buckets] - self.start[buckets]
        return np.repeat(self.start[buckets] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))

    def search(self, q: np.ndarray, qp: np.ndarray, x: np.ndarray, qq: float, k: int, bound: float, stop: float):
        """The k largest inner products with q found among x: (rows, inner products, points verified).

        Points come by growing projected distance: buckets are opened while their boxes are within reach, and the points
        of open buckets are verified one after another.  A point at squared distance d has a projected one of d times the
        share of ``_law``; the search stops when a point as near as the k-th best so far would surely have been met, at ``stop``
        times its squared distance.  ``bound``: squared distance of a k-th best known beforehand.
        """
        gap = np.maximum(np.maximum(self.lo - qp, qp - self.hi), 0.0)
        reach = (gap * gap).sum(axis=1)
        by = np.argsort(reach, kind="stable")
        size = (self.end - self.start)[by]
        opened, at = 0, np.zeros(0, dtype=np.int64)
        rows, got, seen = np.zeros(0, dtype=np.int64), np.zeros(0), 0

        def verify(at: np.ndarray) -> None:
            nonlocal rows, got, seen, bound
            own = self.order[at]
            rows, got, seen = np.concatenate((rows, own)), np.concatenate((got, x[own] @ q)), seen + len(own)
            if len(got) > k:
                top = np.argpartition(-got, k - 1)[:k]
                rows, got = rows[top], got[top]
            if len(got) >= k:
                bound = min(bound, max(qq - 2 * float(got.min()), 0.0))

        def far(at: np.ndarray) -> np.ndarray:
            return np.maximum(self.squares[at] + qp @ qp - 2 * (self.p[at] @ qp), 0.0)

        if not np.isfinite(bound):  # the first buckets tell how near the k-th best is
            opened = min(len(by), int(np.searchsorted(np.cumsum(size), k)) + 1)
            at = self._points(by[:opened])
            first = np.argsort(far(at), kind="stable")[:k]
            verify(at[first])
            at = np.delete(at, first)
        within = int(np.searchsorted(reach[by], stop * bound)) if np.isfinite(bound) else len(by)
        at = np.concatenate((at, self._points(by[opened : max(opened, within)])))
        d = far(at)
        at, d = at[d < stop * bound], d[d < stop * bound]
        o = np.argsort(d, kind="stable")
        at, d, lo = at[o], d[o], 0
        while lo < len(at) and d[lo] < stop * bound:
            verify(at[lo : lo + 2 * BUCKET])
            lo += 2 * BUCKET
        return rows, got, seen


def _project(width: int, most: float, dims: int, splits: Splits | None):
    d = directions(width + 1, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            p = lifted(x, most) @ d
            leaf = splits.leaf(p) if splits else np.zeros(len(p), dtype=np.int64)
            home = splits.leaf(np.concatenate([x, np.zeros((len(x), 1))], axis=1) @ d) if splits else leaf
            point = pa.ListArray.from_arrays(pa.array(np.arange(0, dims * len(p) + 1, dims, dtype=np.int32)), pa.array(p.reshape(-1)))
            yield pa.record_batch([batch.column("class"), batch.column("v"), batch.column("asked"), point, pa.array(leaf), pa.array(home)], names=["class", "v", "asked", "p", "leaf", "home"])

    return run


def _search(width: int, most: float, dims: int, k: int, stop: float):
    d = directions(width + 1, dims)

    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(index) and len(queries):
            index = index.sort_values("class")
            x, p, ids = np.stack(index["v"].to_numpy()), np.stack(index["p"].to_numpy()), index["class"].to_numpy()
            tree = Tree(p)
            for q_id, q, bound in zip(queries["query"], queries["qv"], queries["bound"]):
                q = np.asarray(q)
                qq = float(q @ q) + most * most
                rows, _, seen = tree.search(q, np.append(q, 0.0) @ d, x, qq, k, float(bound), stop)
                score = (x[rows] * q).sum(axis=1)
                out += zip([q_id] * len(rows), ids[rows].tolist(), score.tolist(), [qq] * len(rows), [0] * len(rows))
                out.append((q_id, None, None, qq, seen))  # how many were verified
        kinds = {"query": "int64", "class": "Int64", "score": "float64", "qq": "float64", "seen": "int64"}
        return pd.DataFrame(out, columns=list(kinds)).astype(kinds)

    return run


def _others(splits: Splits, width: int, dims: int, stop: float):
    """Leaves that a query has to visit given its k-th best distance so far."""
    d = directions(width + 1, dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = []
            for q, bound in zip(batch.column("qv").to_pylist(), batch.column("bound").to_pylist()):
                near = splits.nearness(np.append(q, 0.0) @ d)
                leaves.append((np.flatnonzero(near < stop * bound) if np.isfinite(bound) else np.arange(len(near))).tolist())
            yield pa.record_batch([*batch.columns, pa.array(leaves, pa.list_(pa.int64()))], names=[*batch.schema.names, "leaves"])

    return run


def vector_search(vectors: DataFrame, is_query, *, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", sure: float = 0.92) -> DataFrame:
    """For each row that ``is_query`` (a condition on vec_id) holds for: the k rows of largest inner product found, without itself.

    Returns query_id, rank (from 1; ties to the smaller vec_id), vec_id, score (the inner product, in double precision) and
    verified (of how many of the ``indexed`` distinct vectors the query's inner product was computed).  Ids are integers.

    Every row is indexed.  Equal vectors are one class that keeps its k + 1 smallest ids, which is all that a result can
    hold.  Classes are lifted to equal length, projected on orthonormal Gaussian (2-stable) directions, as few as a sample of
    at most SAMPLE_ROWS rows says are enough (``directions_for``), and dealt to leaves of a kd-tree whose split values come
    from that sample; a leaf of more than twice LEAF points is dealt at random into parts of about LEAF.  A query searches a
    part of its home leaf, then the parts of all leaves whose boxes the chi-square test with its k-th best distance doesn't
    rule out, ASKED queries at a time; in each, points come from a local kd-tree by growing projected distance until the test
    holds.  A smaller distance is missed with probability 1 - ``sure`` at most.

    Null or zero vectors and ones with null or non-finite components take no part, nor do vectors that differ in length from the
    most common one (then the longest), nor rows with a null vec_id.  Repeated rows count once.  Fewer than k candidates: all of
    them.  Other columns are ignored; an empty table gives none.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = v.where("vec_id is not null and v is not null").where(finite & F.exists("v", lambda x: x != 0))
    widths = v.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("w")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, verified long, indexed long")
    if widths is None:
        return empty
    width = int(widths["w"])
    v = v.where(F.size("v") == width).select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).distinct()
    few = v.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    asked = v.where(is_query(F.col("vec_id")))
    classes = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = cut(classes.join(asked.select("v").distinct().withColumn("asked", F.lit(True)), "v", "left").select(F.element_at("ids", 1).alias("class"), "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked")))
    size = classes.agg(F.count("*").alias("n"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("m")).first()
    total, most = int(size["n"]), float(size["m"])
    chosen = F.pmod(F.xxhash64("class"), F.lit(1 << 30))
    sample = classes.where(chosen < int(min(1.0, SAMPLE_ROWS / total) * (1 << 30))).orderBy(chosen, "class").select("v").limit(SAMPLE_ROWS).toPandas()["v"]
    sample = lifted(np.stack(sample.to_numpy()), most) if len(sample) else np.zeros((0, width + 1))
    dims = directions_for(sample, k, sure)
    stop = stopping_share(dims, width + 1, sure)
    leaves = min(SAMPLE_ROWS // 8, -(-total // LEAF))
    splits = Splits(sample @ directions(width + 1, dims), leaves) if leaves > 1 else None
    index = cut(classes.select("class", "v", "asked").mapInArrow(_project(width, most, dims, splits), "class long, v array<double>, asked boolean, p array<double>, leaf long, home long"))
    # one row a leaf, of which there are SAMPLE_ROWS / 4 at most
    parts = cut(index.groupBy("leaf").agg(F.greatest(F.floor(F.count("*") / LEAF), F.lit(1)).cast("int").alias("parts")))
    hashed = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    points = index.select("class", "v", "p", "leaf").join(F.broadcast(parts), "leaf").withColumn("part", hashed).drop("parts")
    queries = index.where("asked").join(F.broadcast(parts.select(F.col("leaf").alias("home"), F.col("parts").alias("p_home"))), "home", "left")
    own = F.pmod(F.xxhash64("class"), F.coalesce("p_home", F.lit(1))).cast("int")
    queries = queries.select(F.col("class").alias("query"), F.col("v").alias("qv"), F.col("home").alias("home"), own.alias("own"))
    search, schema = _search(width, most, dims, k + 1, stop), "query long, class long, score double, qq double, seen long"

    def searched(visits: DataFrame) -> DataFrame:
        """visits: query, qv, bound, leaf, part.  Where many queries visit a part, its points go to several groups of them."""
        groups = visits.groupBy("leaf", "part").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("groups"))
        turn = F.pmod(F.xxhash64("query", F.lit(1)), F.col("groups")).cast("int")
        to = visits.join(groups, ["leaf", "part"]).withColumn("turn", turn).drop("groups")
        at = points.join(groups, ["leaf", "part"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        return cut(at.groupBy("leaf", "part", "turn").cogroup(to.groupBy("leaf", "part", "turn")).applyInPandas(search, schema))

    found = searched(queries.select("query", "qv", F.lit(float("inf")).alias("bound"), F.col("home").alias("leaf"), F.col("own").alias("part")))
    if splits is not None:
        best = found.where("class is not null").groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("s"), F.first("qq").alias("qq"))
        bound = best.select("query", F.when(F.col("n") > k, F.greatest(F.col("qq") - 2 * F.col("s"), F.lit(0.0))).otherwise(F.lit(float("inf"))).alias("bound"))
        more = queries.join(bound, "query", "left").select("query", "qv", "home", "own", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
        more = more.mapInArrow(_others(splits, width, dims, stop), "query long, qv array<double>, home long, own int, bound double, leaves array<long>").withColumn("leaf", F.explode("leaves"))
        more = more.join(F.broadcast(parts), "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("leaf <> home or part <> own")
        found = found.unionByName(searched(more.select("query", "qv", "bound", "leaf", "part")))
    seen = found.groupBy("query").agg(F.sum("seen").alias("verified"))
    best = found.where("class is not null").withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "class"))).where(F.col("n") <= k + 1).select("query", "class", "score")
    listed = best.join(classes.select("class", "ids"), "class").select("query", "score", F.explode("ids").alias("vec_id"))
    listed = listed.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    listed = listed.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "score", "vec_id"))).alias("list")).join(seen, "query")
    who = asked.join(classes.where("asked").select(F.col("v").alias("cv"), F.col("class").alias("query")), F.col("v") == F.col("cv")).select(F.col("vec_id").alias("query_id"), "query")
    own = who.join(listed, "query").withColumn("list", F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k))
    return own.select("query_id", "verified", F.posexplode("list").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.vec_id", "x.score", "verified", F.lit(total).cast("long").alias("indexed"))
