"""Collective features: what a pair's entity and its rivals already hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.context import one_owner, rank_in, score_context

CAPS = {2: 5, 3: 6}


def members(edges: DataFrame, score: str, sure: float, top: int) -> Column:
    """Whether a pair is one of its entity's confident ones."""
    return (F.col(score) >= sure) & (rank_in("s1_uid", score) <= top)


def consensus(edges: DataFrame, records: DataFrame, similarity: Callable[[str, str], Column], *, score: str = "p1", sure: float = 0.8, top: int = 8) -> DataFrame:
    """How a record agrees with its entity's other confident members.

    edges: s1_uid, rec_uid, num_hit, score; records: uid, name, addr, num, nums, pin.  ``similarity(a, b)`` compares two text
    columns.  Majorities are modes without the empty string, the least one on ties.  cons_n leaves the record itself out
    where its score is confident.  Pairs without a comparable value are null.
    """
    e = edges.select("s1_uid", "rec_uid", F.col(score).alias("p"), "num_hit").withColumn("mem", members(edges.select("s1_uid", "rec_uid", F.col(score).alias("p")), "p", sure, top))
    m = e.where("mem").select("s1_uid", F.col("rec_uid").alias("m"), F.col("num_hit").alias("m_hit"))
    r = lambda key, **names: records.select(F.col("uid").alias(key), *[F.col(a).alias(b) for a, b in names.items()])
    most = lambda c: F.mode(F.nullif(c, F.lit("")), True)
    held = m.join(r("m", num="m_num", pin="m_pin"), "m", "left").groupBy("s1_uid").agg(F.count("*").alias("n"), F.sum("m_hit").alias("hits"), most("m_num").alias("maj_num"), most("m_pin").alias("maj_pin"))
    own = F.when(F.col("p") >= sure, 1).otherwise(0)
    left = F.coalesce("n", F.lit(0)) - own
    base = e.join(held, "s1_uid", "left").join(r("rec_uid", nums="nums", pin="pin"), "rec_uid", "left")
    base = base.select(
        "s1_uid",
        "rec_uid",
        own.alias("cons_is_member"),
        left.alias("cons_n"),
        F.when(left > 0, (F.coalesce("hits", F.lit(0)) - own * F.coalesce("num_hit", F.lit(0))) / left).alias("cons_numhit_rate"),
        F.when(F.col("maj_num").isNotNull() & (F.size("nums") > 0), F.array_contains("nums", F.col("maj_num")).cast("int")).alias("cons_num_agree"),
        F.when(F.col("maj_pin").isNotNull() & (F.col("pin") != ""), (F.col("pin") == F.col("maj_pin")).cast("int")).alias("cons_pin_agree"),
    )
    other = e.select("s1_uid", "rec_uid").join(m.select("s1_uid", "m"), "s1_uid").where("m <> rec_uid")
    other = other.join(r("rec_uid", name="rn", addr="ra"), "rec_uid", "left").join(r("m", name="mn", addr="ma"), "m", "left")
    other = other.select("s1_uid", "rec_uid", similarity("rn", "mn").alias("ns"), similarity("ra", "ma").alias("as_"))
    sims = other.groupBy("s1_uid", "rec_uid").agg(F.max("ns").alias("cons_name_max"), F.avg("ns").alias("cons_name_mean"), F.max("as_").alias("cons_addr_max"), F.avg("as_").alias("cons_addr_mean"))
    return base.join(sims, ["s1_uid", "rec_uid"], "left")


def competition(edges: DataFrame, *, score: str = "p1", sure: float = 0.8, top: int = 8, close: float = 0.1, caps: dict[int, int] | None = None) -> DataFrame:
    """State of a pair's entity and of the record's best other entity: members by source, room under the cap, emptiness, near ties.

    edges: s1_uid, rec_uid, src, score.  Without a rival the cm_comp columns are null and cm_comp_has is 0.
    """
    caps = CAPS if caps is None else caps
    e = edges.select("s1_uid", "rec_uid", "src", F.col(score).alias("p"))
    e = e.withColumn("mem", members(e, "p", sure, top))
    w = Window.partitionBy("rec_uid")
    best_first = w.orderBy(F.desc("p"), "s1_uid")
    e = e.withColumn("at", F.row_number().over(best_first)).withColumns(
        {"t1": F.max(F.when(F.col("at") == 1, F.col("s1_uid"))).over(w), "t2": F.max(F.when(F.col("at") == 2, F.col("s1_uid"))).over(w), "pmax": F.max("p").over(w)}
    )
    e = e.withColumn("cm_n_close", F.count(F.when(F.col("p") >= F.col("pmax") - close, 1)).over(w)).withColumn("comp", F.when(F.col("at") == 1, F.col("t2")).otherwise(F.col("t1")))
    # the rival's own membership of the record: known within the record's partition
    e = e.withColumn("m1", F.max(F.when(F.col("at") == 1, F.col("mem").cast("int"))).over(w)).withColumn("m2", F.max(F.when(F.col("at") == 2, F.col("mem").cast("int"))).over(w))
    held = e.where("mem").groupBy("s1_uid").agg(F.count("*").alias("n"), F.count_if(F.col("src") == 2).alias("n2"), F.count_if(F.col("src") == 3).alias("n3"))
    rival = held.select(F.col("s1_uid").alias("comp"), F.col("n").alias("cn"), F.col("n2").alias("cn2"), F.col("n3").alias("cn3"))
    e = e.join(held, "s1_uid", "left").join(rival, "comp", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "n2", "n3", "cn", "cn2", "cn3")})
    own, cm = F.col("mem").cast("int"), F.coalesce(F.when(F.col("at") == 1, F.col("m2")).otherwise(F.col("m1")), F.lit(0))
    of_src = lambda two, three: F.when(F.col("src") == 2, F.col(two)).otherwise(F.col(three))
    cap = F.when(F.col("src") == 2, F.lit(caps.get(2, 99))).otherwise(F.lit(caps.get(3, 99)))
    own_src, own_n, comp_src, comp_n = of_src("n2", "n3") - own, F.col("n") - own, of_src("cn2", "cn3") - cm, F.col("cn") - cm
    has = F.col("comp").isNotNull()
    return e.select(
        "s1_uid",
        "rec_uid",
        own_src.alias("cm_own_src_n"),
        (cap - own_src).alias("cm_own_cap_left"),
        (own_n == 0).cast("int").alias("cm_own_empty"),
        has.cast("int").alias("cm_comp_has"),
        F.when(has, comp_n).alias("cm_comp_n"),
        F.when(has, comp_src).alias("cm_comp_src_n"),
        F.when(has, cap - comp_src).alias("cm_comp_cap_left"),
        F.when(has, (comp_n == 0).cast("int")).alias("cm_comp_empty"),
        "cm_n_close",
        F.when(has, own_n - comp_n).alias("cm_n_diff"),
    )


def gate_profile(edges: DataFrame, entities: DataFrame | None = None, *, score: str = "q", extra: dict[str, str] | None = None) -> DataFrame:
    """One row per entity: its list after one-owner, as top scores, gap, sums and counts, plus the greatest of ``extra`` columns.

    entities: adds entities without any pair, with zeros.
    """
    d = score_context(one_owner(edges, score), score, "g")
    top = F.sort_array(F.collect_list(F.struct((-F.col("q_own")).alias("a"), F.col("rec_uid").alias("b"), F.col("g_rec_comp").alias("c"))))
    agg = d.groupBy("s1_uid").agg(
        F.slice(top, 1, 3).alias("tops"),
        F.sum("q_own").alias("g_sum"),
        *[F.count_if(F.col("q_own") >= x).alias(n) for n, x in (("g_n03", 0.3), ("g_n05", 0.5), ("g_n08", 0.8))],
        F.count_if(F.col("q_own") > 0).alias("g_n_owned"),
        F.count("*").alias("g_ncand"),
        *[F.max(c).alias(n) for n, c in (extra or {}).items()],
    )
    agg = agg.withColumns({f"g_top{i + 1}": F.coalesce(-F.get("tops", F.lit(i))["a"], F.lit(0.0)) for i in range(3)}).withColumn("g_top1_comp", F.get("tops", F.lit(0))["c"]).drop("tops")
    agg = agg.withColumn("g_gap12", F.col("g_top1") - F.col("g_top2"))
    if entities is None:
        return agg
    zero = ["g_top1", "g_top2", "g_top3", "g_gap12", "g_sum", "g_n03", "g_n05", "g_n08", "g_n_owned", "g_ncand"]
    return entities.join(agg, "s1_uid", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
