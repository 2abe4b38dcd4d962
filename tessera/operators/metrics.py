"""Set-based metrics over an entity table, predicted pairs and true pairs, and what explains their losses.

Entities are rows of ``s1_uid, prof, n_true``; pairs are rows of ``s1_uid, rec_uid``.  Pair tables needn't be distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["s1_uid", "rec_uid"]


def f_half(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """F0.5 of a predicted set; an empty prediction of an empty truth is right, and no hit scores nothing."""
    return F.when((n_pred == 0) & (n_true == 0), F.lit(1.0)).when(tp == 0, F.lit(0.0)).otherwise(1.25 * tp / (n_pred + 0.25 * n_true))


def entity_scores(entities: DataFrame, pred: DataFrame, truth: DataFrame) -> DataFrame:
    """entities with tp, n_pred and f05.  One pass over pairs: a pair is predicted, true or both, then one sum per entity."""
    tagged = pred.select(*KEYS, F.lit(1).alias("p"), F.lit(0).alias("t")).unionByName(truth.select(*KEYS, F.lit(0).alias("p"), F.lit(1).alias("t")))
    pair = tagged.groupBy(*KEYS).agg(F.max("p").alias("p"), F.max("t").alias("t"))
    per = pair.groupBy("s1_uid").agg(F.sum("p").alias("n_pred"), F.sum(F.col("p") * F.col("t")).alias("tp"))
    out = entities.join(per, "s1_uid", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_pred", "tp")})
    return out.withColumn("f05", f_half(F.col("tp"), F.col("n_pred"), F.col("n_true")))


def macro_f05(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("f05").alias("macro_f05"), F.count("*").alias("entities"))


def ceiling(entities: DataFrame, candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """entity_scores of the best selection that the candidates allow: every true pair among them and nothing else."""
    return entity_scores(entities, candidates.join(truth, KEYS, "left_semi"), truth)


def report(scores: DataFrame) -> DataFrame:
    """(slice, value, entities, macro_f05, precision, recall) overall, by profile, for singletons and others, and by true size.

    All slices come from one aggregation over grouping sets.
    """
    s = scores.select("prof", F.when(F.col("n_true") == 0, "singleton").otherwise("other").alias("kind"), F.least("n_true", F.lit(7)).cast("string").alias("size"), "f05", "tp", "n_pred", "n_true")
    g = s.groupingSets([[], ["prof"], ["kind"], ["size"]], "prof", "kind", "size").agg(
        F.grouping_id("prof", "kind", "size").alias("gid"), F.count("*").alias("entities"), F.avg("f05").alias("macro_f05"), F.sum("tp").alias("tp"), F.sum("n_pred").alias("np"), F.sum("n_true").alias("nt")
    )
    kind = F.when(F.col("gid") == 7, "all").when(F.col("gid") == 3, "prof").when(F.col("gid") == 5, "kind").otherwise("size")
    return g.select(kind.alias("slice"), F.coalesce("prof", "kind", "size", F.lit("")).alias("value"), "entities", "macro_f05", (F.col("tp") / F.nullif("np", F.lit(0))).alias("precision"), (F.col("tp") / F.nullif("nt", F.lit(0))).alias("recall"))


def missed_causes(entities: DataFrame, scored: DataFrame, pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Missed true pairs with their cause.  scored: s1_uid, rec_uid, q, owner (whether the entity owns the record)."""
    found = pred.groupBy("s1_uid").agg(F.lit(True).alias("has_pred"))
    missed = truth.select(*KEYS).distinct().join(pred, KEYS, "left_anti")
    cause = F.when(F.col("q").isNull(), "not a candidate").when(~F.col("owner"), "record owned by another entity").when(F.col("has_pred").isNull(), "entity predicted empty").otherwise("candidate, below threshold")
    return missed.join(scored.select(*KEYS, "q", "owner"), KEYS, "left").join(found, "s1_uid", "left").select(*KEYS, "q", cause.alias("cause"))


def wrong_causes(entities: DataFrame, pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Predicted pairs that aren't true, with their cause."""
    owned = truth.select("rec_uid").distinct().withColumn("owned", F.lit(True))
    wrong = pred.select(*KEYS).distinct().join(truth, KEYS, "left_anti")
    cause = F.when(F.col("n_true") == 0, "entity is a singleton").when(F.col("owned"), "record belongs to another entity").otherwise("record has no owner")
    return wrong.join(entities.select("s1_uid", "n_true"), "s1_uid", "left").join(owned, "rec_uid", "left").select(*KEYS, cause.alias("cause"))


def cause_shares(causes: DataFrame, total: int | Column) -> DataFrame:
    return causes.groupBy("cause").agg(F.count("*").alias("pairs")).withColumn("share", F.col("pairs") / total)


def loss_pattern() -> Column:
    """What went wrong for an entity, from tp, n_pred, n_true and f05."""
    tp, n_pred, n_true = F.col("tp"), F.col("n_pred"), F.col("n_true")
    return (
        F.when(F.col("f05") >= 1, "correct")
        .when(n_true == 0, "singleton given matches")
        .when(n_pred == 0, "has matches, predicted empty")
        .when(tp == 0, "only wrong records")
        .when((n_pred > tp) & (tp < n_true), "missed and wrong")
        .when(n_pred > tp, "all found, wrong extra")
        .otherwise("some missed, none wrong")
    )


def loss_table(scores: DataFrame, by_size: bool = False) -> DataFrame:
    """Entities, share and macro loss by pattern (and true size, up to 7): losses add up to 1 - macro F0.5."""
    n = scores.agg(F.count("*").alias("n_all"))
    keys = (["n_true"] if by_size else []) + ["pattern"]
    s = scores.withColumn("pattern", loss_pattern()).withColumn("n_true", F.least("n_true", F.lit(7)))
    out = s.groupBy(*keys).agg(F.count("*").alias("entities"), F.sum(1 - F.col("f05")).alias("loss")).crossJoin(F.broadcast(n))  # one row
    return out.select(*keys, "entities", (F.col("entities") / F.col("n_all")).alias("share"), (F.col("loss") / F.col("n_all")).alias("macro_loss"))


def drift(pairs: DataFrame) -> DataFrame:
    """Score distribution per split and profile: pairs has split, prof, s1_uid, q."""
    top = pairs.groupBy("split", "prof", "s1_uid").agg(F.max("q").alias("top"), F.count("*").alias("n"), F.count_if(F.col("q").between(0.3, 0.9)).alias("mid"))
    return top.groupBy("split", "prof").agg(
        F.count("*").alias("entities"),
        F.avg("n").alias("cands_per_entity"),
        (F.sum("mid") / F.sum("n")).alias("q_mid"),
        F.percentile("top", 0.1).alias("top_p10"),
        F.percentile("top", 0.5).alias("top_p50"),
        F.avg(((F.col("top") > 0.2) & (F.col("top") < 0.8)).cast("double")).alias("top_uncertain"),
    )


def ks_distance(values: DataFrame, group: str, value: str, a, b, steps: int = 200) -> DataFrame:
    """Largest difference of two groups' distribution functions on a grid of steps + 1 points of [0, 1], from grid histograms."""
    from pyspark.sql import Window

    v = F.col(value)
    cell = F.greatest(F.lit(0), F.ceil(v * steps)).cast("int")
    h = values.where(F.col(group).isin(a, b) & v.isNotNull()).groupBy(cell.alias("cell")).agg(F.count_if(F.col(group) == a).alias("na"), F.count_if(F.col(group) == b).alias("nb"))
    upto = Window.orderBy("cell")  # steps + 2 rows at most
    every = Window.partitionBy(F.lit(0))
    c = h.select("cell", (F.sum("na").over(upto) / F.sum("na").over(every)).alias("ca"), (F.sum("nb").over(upto) / F.sum("nb").over(every)).alias("cb"))
    return c.where(F.col("cell") <= steps).agg(F.max(F.abs(F.col("ca") - F.col("cb"))).alias("ks"))


def best_per_record(pairs: DataFrame, records: DataFrame, score: str, dropped: DataFrame | None = None) -> DataFrame:
    """Each record's best score over entities, without the dropped entities; records without a pair score 0."""
    kept = pairs if dropped is None else pairs.join(dropped.select("s1_uid").distinct(), "s1_uid", "left_anti")
    best = kept.groupBy("rec_uid").agg(F.max(score).alias("best"))
    return records.select("rec_uid").join(best, "rec_uid", "left").select("rec_uid", F.coalesce("best", F.lit(0.0)).alias("best"))


def profile(records: DataFrame, country: str = "country") -> DataFrame:
    """Rows and noise rates by source and country: Indic names, domain names, empty addresses and null words in them."""
    name, addr = F.lower("name_raw"), F.lower("addr_raw")
    rate = lambda c: F.avg(c.cast("double"))
    return records.groupBy("src", country).agg(
        F.count("*").alias("n"),
        rate(F.col("name_raw").rlike("[\\u0900-\\u0DFF]")).alias("indic_name"),
        rate(name.rlike(r"(\.com|www\.|\.in\b|\.fr\b|\.net|\.org)")).alias("domain_name"),
        rate(F.trim("addr_raw") == "").alias("empty_addr"),
        rate(addr.rlike(r"\b(null|n/a|none)\b")).alias("null_token_addr"),
    )


def integrity(entities: DataFrame, records: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: most owners of a record, most records of each source in an entity, singleton rate, pairs across countries, unmatched records."""
    t = truth.join(records.select("rec_uid", "src", F.col("country").alias("rc")), "rec_uid").join(entities.select("s1_uid", "country"), "s1_uid")
    owners = truth.groupBy("rec_uid").agg(F.count("*").alias("n")).agg(F.max("n").alias("max_owners"), F.count("*").alias("matched"))
    per = t.groupBy("s1_uid").agg(F.count_if(F.col("src") == 2).alias("n2"), F.count_if(F.col("src") == 3).alias("n3"), F.count_if(F.col("rc") != F.col("country")).alias("x"))
    sums = per.agg(F.max("n2").alias("max_src2"), F.max("n3").alias("max_src3"), F.sum("x").alias("cross_country"))
    single = entities.agg(F.avg((F.col("n_true") == 0).cast("double")).alias("singleton_rate"))
    rows = records.agg(F.count("*").alias("records"))
    # each side is one row
    return owners.crossJoin(sums).crossJoin(single).crossJoin(rows).select("max_owners", "max_src2", "max_src3", "cross_country", "singleton_rate", (F.col("records") - F.col("matched")).alias("unmatched"))
