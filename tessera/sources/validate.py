"""Checks of result files, as one table of faults: (rule, level, n, examples)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of the reference side and of records start with these.
REFERENCE, RECORDS = "S1-", ("S2-", "S3-")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of a file, from 1."""
    raw = spark.read.option("wholetext", False).text(path).select(F.col("value").alias("text"), F.monotonically_increasing_id().alias("o"))
    from tessera.sources.tsv import numbered

    return numbered(raw, ["o"], "line").select((F.col("line") + 1).alias("line"), F.regexp_replace("text", "\r$", "").alias("text"))


def fault_rows(rows: DataFrame, header: str) -> DataFrame:
    """(rule, example) of every fault within one id-list file.  rows: line, text."""
    body = rows.where("line > 1 and text <> ''")
    parts = F.split("text", "\t", -1)
    split = body.select("line", F.size(parts).alias("n"), F.trim(F.get(parts, F.lit(0))).alias("id"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("list"))
    ids = split.where("n > 1 and list <> ''").select("id", F.explode(F.split("list", ",")).alias("x")).select("id", F.trim("x").alias("x")).where("x <> ''")
    head = rows.where("line = 1")
    rule = lambda df, name, e: df.select(F.lit(name).alias("rule"), e.cast("string").alias("example"))
    found = rule(head.where(F.contains("text", F.lit(",")) & ~F.contains("text", F.lit("\t"))), "comma header", F.col("text"))
    for more in (
        rule(head.where((F.col("text") != header) & F.contains("text", F.lit("\t"))), "wrong header", F.col("text")),
        rule(split.where("n < 2"), "row without tab", F.col("line")),
        rule(split.groupBy("id").agg(F.count("*").alias("k")).where("k > 1"), "duplicate entity row", F.col("id")),
        rule(ids.groupBy("id", "x").agg(F.count("*").alias("k")).where("k > 1"), "duplicate id in a list", F.concat_ws(" ", "id", "x")),
        rule(ids.where(F.col("x").startswith(REFERENCE)), "reference id in a list", F.concat_ws(" ", "id", "x")),
        rule(ids.where(~F.col("x").startswith(REFERENCE) & ~F.col("x").startswith(RECORDS[0]) & ~F.col("x").startswith(RECORDS[1])), "foreign prefix", F.concat_ws(" ", "id", "x")),
    ):
        found = found.unionByName(more)
    return found


def list_pairs(rows: DataFrame) -> DataFrame:
    """Distinct (id, x) of a file's lists, and (id, null) for its rows without any."""
    parts = F.split("text", "\t", -1)
    split = rows.where("line > 1 and text <> ''").select(F.trim(F.get(parts, F.lit(0))).alias("id"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("list"))
    return split.select("id", F.explode_outer(F.filter(F.transform(F.split("list", ","), F.trim), lambda x: x != "")).alias("x")).distinct()


def validate(matches: DataFrame, candidates: DataFrame, reference_ids: DataFrame, record_ids: DataFrame | None = None) -> DataFrame:
    """All faults of both files, counted: (file, rule, level, n, examples).  A match that isn't a candidate is a warning.

    matches, candidates: line, text.  reference_ids and, to check that list ids exist, record_ids: id.
    """
    files = {"matches": (matches, "source1_entity_id\tmatched_entity_ids"), "candidates": (candidates, "source1_entity_id\tcandidate_entity_ids")}
    out = None
    for name, (rows, header) in files.items():
        found = fault_rows(rows, header)
        pairs = list_pairs(rows)
        own = pairs.select("id").distinct()
        rule = lambda df, n, e: df.select(F.lit(n).alias("rule"), F.col(e).alias("example"))
        found = found.unionByName(rule(reference_ids.join(own, "id", "left_anti"), "missing entity", "id")).unionByName(rule(own.join(reference_ids, "id", "left_anti"), "unknown entity", "id"))
        if record_ids is not None:
            found = found.unionByName(rule(pairs.where("x is not null").select(F.col("x").alias("id")).distinct().join(record_ids, "id", "left_anti"), "unknown id in a list", "id"))
        if name == "matches":
            extra = pairs.where("x is not null").join(list_pairs(candidates), ["id", "x"], "left_anti").select(F.lit("match is not a candidate").alias("rule"), F.concat_ws(" ", "id", "x").alias("example"))
            found = found.unionByName(extra)
        found = found.withColumn("file", F.lit(name))
        out = found if out is None else out.unionByName(found)
    level = F.when(F.col("rule") == "match is not a candidate", "warning").otherwise("error")
    # the five least examples: a sorted top-k for each rule, not all of a rule's faults in one list
    from pyspark.sql import Window

    ranked = out.withColumn("k", F.row_number().over(Window.partitionBy("file", "rule").orderBy("example"))).where("k <= 5")
    listed = ranked.groupBy("file", "rule").agg(F.array_join(F.array_sort(F.collect_list("example")), ", ").alias("examples"))
    return out.groupBy("file", "rule").agg(F.count("*").alias("n")).join(listed, ["file", "rule"]).select("file", "rule", level.alias("level"), "n", "examples")


def passed(faults: DataFrame) -> bool:
    return faults.where("level = 'error'").isEmpty()
