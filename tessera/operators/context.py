"""List-context features and rank rules over a scored edge list (s1_uid, rec_uid, score).

Ranks are ordinal; ties go to the smaller (s1_uid, rec_uid).  All windows of a function share two partitionings, by entity and by
record, so each function shuffles twice at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["s1_uid", "rec_uid"]


def _order(score: str) -> list[Column]:
    return [F.desc(score), F.asc("s1_uid"), F.asc("rec_uid")]


def rank_in(side: str, score: str) -> Column:
    return F.row_number().over(Window.partitionBy(side).orderBy(*_order(score)))


def score_context(edges: DataFrame, score: str, prefix: str) -> DataFrame:
    """Ranks, gaps, runners-up, shares, sizes and the margin of a score on the entity's side (s1) and the record's (rec)."""
    s, out = F.col(score), edges
    for side, key in (("s1", "s1_uid"), ("rec", "rec_uid")):
        w, rank = Window.partitionBy(key), F.col(f"{prefix}_{side}_rank")
        out = out.withColumn(f"{prefix}_{side}_rank", rank_in(key, score))
        best, second = F.max(s).over(w), F.coalesce(F.max(F.when(rank > 1, s)).over(w), F.lit(0.0))
        out = out.withColumns(
            {
                f"{prefix}_{side}_gap": best - s,
                f"{prefix}_{'s1_other' if side == 's1' else 'rec_comp'}": F.when(rank == 1, second).otherwise(best),
                f"{prefix}_{side}_share": s / (F.sum(s).over(w) + F.lit(1e-6)),
                f"{prefix}_{side}_n": F.count(F.lit(1)).over(w),
                f"{prefix}_{side}_n50": F.count(F.when(s >= 0.5, 1)).over(w),
            }
        )
    return out.withColumn(f"{prefix}_rec_margin", s - F.col(f"{prefix}_rec_comp"))


def density_normalize(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """Counts divided by their (group's) median, which counts as 1 if it is below: 1.0 means a list of the usual length."""
    keys = [by] if by else []
    med = df.groupBy(*keys).agg(*[F.greatest(F.coalesce(F.median(c), F.lit(1.0)), F.lit(1.0)).alias(f"__{c}") for c in columns])
    out = df.join(med.withColumnRenamed(by, "__by"), F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by") if by else df.crossJoin(F.broadcast(med))  # one row
    return out.withColumns({c: F.col(c) / F.col(f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def density_match(df: DataFrame, reference: dict[str, float]) -> DataFrame:
    """Counts rescaled so that their median becomes the reference's."""
    present = [c for c in reference if c in df.columns]
    med = df.agg(*[F.greatest(F.coalesce(F.median(c), F.lit(1.0)), F.lit(1.0)).alias(f"__{c}") for c in present])
    return df.crossJoin(F.broadcast(med)).withColumns({c: F.col(c) * F.lit(float(reference[c])) / F.col(f"__{c}") for c in present}).drop(*[f"__{c}" for c in present])  # one row


def keep_rule(edges: DataFrame, score: str, floor: float, floor_low: float, record_top: int, per_entity: int) -> DataFrame:
    """Pairs at the floor, or at a lower one if the entity is among the record's best; then the entity's best ``per_entity``.

    The record's ranks count all pairs, before any floor.
    """
    s = F.col(score)
    ranked = edges.withColumn("__r", rank_in("rec_uid", score)).where((s >= floor) | ((F.col("__r") <= record_top) & (s >= floor_low))).drop("__r")
    return ranked.withColumn("__s", rank_in("s1_uid", score)).where(F.col("__s") <= per_entity).drop("__s")


def top_per(edges: DataFrame, key: str, score: str, k: int) -> DataFrame:
    return edges.withColumn("__n", rank_in(key, score)).where(F.col("__n") <= k).drop("__n")


def one_owner(edges: DataFrame, score: str) -> DataFrame:
    """Adds owner and q_own: each record keeps its score for its best entity only."""
    return edges.withColumn("owner", rank_in("rec_uid", score) == 1).withColumn("q_own", F.when(F.col("owner"), F.col(score)).otherwise(F.lit(0.0)))


def uncertain(edges: DataFrame, score: str, low: float, high: float, top: int = 2) -> DataFrame:
    """Pairs whose score lies between the bounds or that are among their entity's best."""
    s = F.col(score)
    return edges.withColumn("__n", rank_in("s1_uid", score)).where(((s > low) & (s < high)) | (F.col("__n") <= top)).drop("__n")


def hash_order(*columns: str, seed: int = 0) -> Column:
    """A number in 0 .. 2**32 - 1 that depends on the columns and the seed alone, the same in any engine with MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_sample(df: DataFrame, keys: list[str], fraction: float, seed: int = 0) -> DataFrame:
    """A share of the keys, with all their rows, whatever the partitioning."""
    return df.where(hash_order(*keys, seed=seed) < int(fraction * (1 << 32)))


def stratified(edges: DataFrame, bucket: Column, quota: int, seed: int = 0) -> DataFrame:
    """Up to ``quota`` pairs of each bucket, by hash order; pairs in a null bucket are left out."""
    out = edges.withColumn("bucket", bucket).where("bucket is not null").withColumn("__h", hash_order(*KEYS, seed=seed))
    w = Window.partitionBy("bucket").orderBy("__h", *KEYS)
    return out.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= quota).drop("__n", "__h")


def folds(entities: DataFrame, n: int, key: str = "eid", seed: int = 0) -> DataFrame:
    return entities.withColumn("fold", (hash_order(key, seed=seed) % n).cast("int"))


def entity_sample(edges: DataFrame, max_rows: int, seed: int = 0) -> DataFrame:
    """Whole entities, about as many as give ``max_rows`` pairs."""
    n = edges.count()
    return edges if n <= max_rows else hash_sample(edges, ["s1_uid"], max_rows / n, seed)


def floor_tuning(edges: DataFrame, entities: DataFrame, score: str, label: str, floors: list[float]) -> DataFrame:
    """(floor, pairs kept, ceiling macro F0.5) for each floor.

    A pair is kept by all floors up to its score: pairs are counted by the highest such floor and summed up, and only true pairs
    are spread over floors.
    """
    from tessera.operators.metrics import f_half

    grid = sorted(floors)
    cell = sum((F.when(F.col(score) >= f, 1).otherwise(0) for f in grid), F.lit(0))
    kept = edges.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
    sizes = kept.where("cell > 0").withColumn("floor", F.explode(F.slice(F.array(*map(F.lit, grid)), F.lit(1), F.col("cell")))).groupBy("floor").agg(F.sum("n").alias("pairs"))
    hits = edges.where(F.col(label) == 1).withColumn("floor", F.explode(F.filter(F.array(*map(F.lit, grid)), lambda f: f <= F.col(score))))
    tp = hits.groupBy("floor", "s1_uid").agg(F.count("*").alias("tp")).join(entities.select("s1_uid", "n_true"), "s1_uid")
    got = tp.groupBy("floor").agg(F.sum(f_half(F.col("tp"), F.col("tp"), F.col("n_true"))).alias("f"))
    base = entities.agg(F.count("*").alias("n"), F.count_if(F.col("n_true") == 0).alias("single"))
    every = edges.sparkSession.createDataFrame([(f,) for f in grid], "floor double")
    out = every.join(sizes, "floor", "left").join(got, "floor", "left").crossJoin(F.broadcast(base))  # one row
    return out.select("floor", F.coalesce("pairs", F.lit(0)).cast("long").alias("pairs"), ((F.coalesce("f", F.lit(0.0)) + F.col("single")) / F.col("n")).alias("ceiling"))
