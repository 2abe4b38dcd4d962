"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.runtime import cut
from tessera.llm.spans import U64, mix64

WORD = r"[^\x20\x09-\x0D]+"
BLOCK, FAN_IN = 4096, 256
#: Sources up to which their rows (some 60 bytes each) are broadcast.
MOST_BROADCAST = 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size); there is one row per source.

    Targets share the total by weight and stop at ``cap`` times their source's size; what is cut off is shared again
    by weight until none is above.  That ends at the level x with sum(min(x * weight, cap * size)) = total, found
    here in closed form from running sums in the order of cap * size / weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    s = (
        s.withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("full_before", F.sum("most").over(by_level) - F.col("most"))
        .withColumn("weight_from", F.sum("weight").over(every) - F.sum("weight").over(by_level) + F.col("weight"))
        .withColumn("level", (F.col("total") - F.col("full_before")) / F.col("weight_from"))
    )
    # the first source, in this order, that isn't full at its level sets the level of all that follow
    s = s.withColumn("free", F.col("level") * F.col("weight") < F.col("most")).withColumn("x", F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("weight"), "level"))).over(every)["level"])
    return s.select("source", "source_size", F.coalesce(F.least(F.col("x") * F.col("weight"), F.col("most")), F.col("most")).alias("target"))


def pivot(p: np.ndarray, w: np.ndarray, u: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rounds p (0 < p < 1) so that sum(p * w) is kept: two units exchange mass until one is 0 or 1, and so on.

    Returns p, where all but one are 0 or 1, and which are settled.  Either direction is drawn with the odds that
    leave every expectation as it was.  ``last``: the remaining one is drawn by itself.
    """
    p, done = p.astype(float).copy(), np.ones(len(p), dtype=bool)
    held = -1
    for j in range(len(p)):
        if held < 0:
            held = j
            continue
        pi, wi, pj, wj = p[held], w[held], p[j], w[j]
        up, down = min((1 - pi) * wi, pj * wj), min(pi * wi, (1 - pj) * wj)
        if u[j] * (up + down) < down:  # mass goes to the held unit
            if (1 - pi) * wi <= pj * wj:
                p[held], p[j], held = 1.0, pj - (1 - pi) * wi / wj, j
            else:
                p[j], p[held] = 0.0, pi + pj * wj / wi
        elif pi * wi <= (1 - pj) * wj:
            p[held], p[j], held = 0.0, pj + pi * wi / wj, j
        else:
            p[j], p[held] = 1.0, pi - (1 - pj) * wj / wi
        if held >= 0 and (p[held] <= 1e-12 or p[held] >= 1 - 1e-12):
            p[held], held = round(p[held]), -1
    if held >= 0 and (p[held] <= 1e-12 or p[held] >= 1 - 1e-12):
        p[held], held = round(p[held]), -1
    if held >= 0:
        if last:
            p[held] = float(u[held] < p[held])
        else:
            done[held] = False
    return p, done


def settle_large(sizes: np.ndarray, mass: float, rest: float, u: np.ndarray) -> np.ndarray:
    """Rounds large units in tiers of like size, largest first; returns 0 or 1 for each.

    ``mass`` of all units together, these and the ``rest`` words of smaller ones, is to be taken.  Each tier is rounded by
    ``pivot`` with its last unit drawn; what that draw takes too much or too little is spread evenly over all smaller
    units, so expectations hold and the error that stays is of the size of the smallest.
    """
    out = np.zeros(len(sizes))
    tier = np.floor(np.log2(sizes)).astype(int)
    left = float(sizes.sum() + rest)
    for t in sorted(set(tier.tolist()), reverse=True):
        own = np.flatnonzero(tier == t)
        p = min(1.0, max(0.0, mass / left))
        if 1e-12 < p < 1 - 1e-12:
            out[own] = pivot(np.full(len(own), p), sizes[own], u[own], True)[0]
        else:
            out[own] = round(p)
        left -= float(sizes[own].sum())
        mass -= float((out[own] * sizes[own]).sum())
    return out


def _settle(seed: int):
    def run(table: pa.Table) -> pa.Table:
        key = table.column("row_key").to_numpy().view(U64)
        table = table.take(pa.array(np.argsort(mix64(key ^ U64(seed + 99)), kind="stable")))
        u = (mix64(table.column("row_key").to_numpy().view(U64) + U64(31 * seed + 5)) >> U64(11)) / float(1 << 53)
        sizes = table.column("size").to_numpy().astype(float)
        words = float(table.column("source_size")[0].as_py())
        out = settle_large(sizes, table.column("p")[0].as_py() * words, words - sizes.sum(), u)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(out)).append_column("done", pa.array([True] * len(table)))

    return run


def _round(level: int, last: bool, seed: int):
    def run(table: pa.Table) -> pa.Table:
        key = table.column("row_key").to_numpy().view(U64)
        # small units come last, so the one that stays open is a small one
        order = np.lexsort((mix64(key ^ U64(seed + level)), -table.column("size").to_numpy()))
        table = table.take(pa.array(order))
        u = (mix64(key[order] + U64(977 * (seed + level) + 1)) >> U64(11)) / float(1 << 53)
        p, done = pivot(table.column("p").to_numpy(), table.column("size").to_numpy(), u, last)
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p)).append_column("done", pa.array(done))

    return run


def _by_source(rows: DataFrame, per_source: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """rows with the columns of their source's one row.  Up to MOST_BROADCAST sources are broadcast, so no source is shuffled whole."""
    right = per_source.withColumnRenamed("source", "s")
    return rows.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("s")), how).drop("s")


def _draw_keys(rows: DataFrame, seed: int) -> DataFrame:
    """rows with ``row_key``, which names a row by its id, text and source, and equal rows by a running number as well.

    Equal rows are numbered in 64 groups by ``row``, so that no number of them meets in one task.
    """
    same = Window.partitionBy("doc_id", "text_hash", "source", "salt").orderBy("row")
    numbered = rows.withColumn("salt", F.pmod("row", F.lit(64))).withColumn("again", F.row_number().over(same))
    # the first of its kind in a group keeps a name that doesn't hang on ``row``, unless its group isn't the only one
    return numbered.withColumn("row_key", F.xxhash64("doc_id", "text_hash", "source", F.when(F.col("again") > 1, F.struct("salt", "again")), F.lit(seed))).drop("salt", "again", "text_hash")


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 7, row: str | None = None) -> DataFrame:
    """Copies of each document so that each source's words come to its target.

    Returns per row: doc_id, source, size (words ``[^\\x20\\x09-\\x0D]+``), source_size, target (of the source), copies, taken (copies *
    size) and, if ``row`` names a column of integers, that column as ``row``.  Sources by code point, null last, weigh
    ``weights`` in turn.  A document gets target / source_size copies on average: the whole part for sure, the rest by pivotal
    rounding in units of words, in blocks of some thousand documents of a source, whose one residual each goes on to the next
    level of a tree.  Large documents are settled first and what they take too much or too little is spread over the smaller
    ones, so that a source's words come as near to its target as its small documents allow.  The draw hangs on doc_id, text,
    source and seed, so reruns agree.  Ids are integers.

    Null text or no words: size 0, taken 0.  Null source: a source of its own.  Null doc_id, rows of one doc_id with other texts
    and repeated rows are drawn each by themselves.  Very long texts: whole; one that is larger than its source's target may
    leave the source off by up to its size.  Ties: documents of equal size differ in their draw alone.  A source may hold any
    share of the rows: its blocks are separate groups.  Other columns are ignored.  Empty table: no rows.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), F.col("text"), (F.col(f"`{row}`") if row else F.monotonically_increasing_id()).cast("long").alias("row"))
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = cut(named.select("doc_id", "source", "row", F.xxhash64("text").alias("text_hash"), words.alias("size")))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    known = sums.agg(F.count("*").alias("n"), F.max("blocks").alias("most")).first()
    few = known["n"] <= MOST_BROADCAST
    goals = _by_source(targets(sums.drop("blocks"), weights, cap), sums.select("source", "blocks"), few)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    state = (
        _by_source(_draw_keys(sized, seed), goals, few)
        .withColumn("whole", F.floor(rate + 1e-12).cast("int"))
        .withColumn("p", F.greatest(rate - F.col("whole"), F.lit(0.0)))
        .withColumn("block", F.pmod(F.xxhash64("row_key", F.lit(seed)), F.col("blocks")).cast("int"))
    )
    state = cut(state.withColumn("fixed", (F.col("size") == 0) | (F.col("p") < 1e-12)))
    told = ["doc_id", "row", "source", "size", "source_size", "target", "whole", "p"]
    sure = state.where("fixed").withColumn("p", F.lit(0.0)).select(*told)
    columns = [*told, "row_key", "block"]
    schema = "doc_id long, row long, source string, size long, source_size long, target double, whole int, p double, row_key long, block int, done boolean"
    # documents of more than 1 / BLOCK of their source, of which there are BLOCK at most, come first
    large = F.col("size") * BLOCK > F.col("source_size")
    settled = cut(state.where("not fixed").where(large).select(*columns).groupBy("source").applyInArrow(_settle(seed), schema))
    used = settled.groupBy("source").agg(F.sum(F.col("p") * F.col("size")).alias("used"), F.sum("size").alias("large_size"))
    small = _by_source(state.where("not fixed").where(~large), used, few, "left")
    rest = F.col("source_size") - F.coalesce("large_size", F.lit(0))
    p = (F.col("p") * F.col("source_size") - F.coalesce("used", F.lit(0.0))) / rest
    left, parts = small.withColumn("p", F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))).select(*columns), [sure, settled.select(*told)]
    levels = 1 + (max(1, math.ceil(math.log(known["most"], FAN_IN))) if (known["most"] or 1) > 1 else 0)
    for level in range(levels):
        last = level == levels - 1
        if level:
            left = left.withColumn("block", F.lit(0) if last else F.floor(F.col("block") / FAN_IN).cast("int"))
        rounded = left.groupBy("source", "block").applyInArrow(_round(level, last, seed), schema)
        if last:  # nothing stays open
            parts.append(rounded.select(*told))
        else:
            rounded = cut(rounded)
            parts.append(rounded.where("done").select(*told))
            left = rounded.where("not done").select(*columns)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    copies = (F.col("whole") + F.round("p").cast("int")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["row"] if row else []))
