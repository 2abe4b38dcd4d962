"""Tab-separated sources and id-list sinks of a linkage task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.parse import profile_column
from tessera.operators.context import folds, hash_sample

RECORD = ["entity_id", "business_name", "business_address", "country"]
TRUTH = ["source1_entity_id", "matched_entity_ids"]


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Text columns of a TSV file with a header and no quoting; short lines are filled and long ones cut, missing text is empty."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.option("sep", "\t").option("quote", "").option("header", True).option("encoding", "UTF-8").schema(schema).csv(path).fillna("")


def ingest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(uid, eid, name_raw, addr_raw, country, src, prof) of all sources; uid counts rows by source and eid.

    uids come from ranges: a range partition's rows are numbered by themselves and shifted by the rows of those before.
    """
    parts = [read_tsv(spark, p, RECORD).withColumn("src", F.lit(i)) for i, p in enumerate(paths, 1)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.select(F.trim("entity_id").alias("eid"), F.col("business_name").alias("name_raw"), F.col("business_address").alias("addr_raw"), F.trim("country").alias("country"), "src")
    return numbered(rows, ["src", "eid"], "uid").withColumn("prof", profile_column(F.col("country"))).select("uid", "eid", "name_raw", "addr_raw", "country", "src", "prof")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with a dense number from 0 in the given order, without one task that sorts them all."""
    from tessera.runtime import cut

    ranged = cut(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    shift = ranged.groupBy("__p").agg(F.count("*").alias("__k")).withColumn("__before", F.sum("__k").over(Window.orderBy("__p")) - F.col("__k")).select("__p", "__before")
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return ranged.withColumn("__n", within).join(F.broadcast(shift), "__p").withColumn(name, (F.col("__before") + F.col("__n")).cast("long")).drop("__p", "__n", "__before")  # a row a partition


def read_truth(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """Distinct (s1_uid, rec_uid) of a truth file; ids that no record has are left out."""
    t = read_tsv(spark, path, TRUTH).where("matched_entity_ids <> ''")
    pairs = t.select(F.trim("source1_entity_id").alias("a"), F.explode(F.split("matched_entity_ids", ",")).alias("b")).select("a", F.trim("b").alias("b")).where("b <> ''")
    uid = lambda key, name: records.select(F.col("eid").alias(key), F.col("uid").alias(name))
    return pairs.join(uid("a", "s1_uid"), "a").join(uid("b", "rec_uid"), "b").select("s1_uid", "rec_uid").distinct()


def entities(records: DataFrame, truth: DataFrame | None, n_folds: int = 4, seed: int = 0) -> DataFrame:
    """(s1_uid, eid, country, prof, n_true, fold) of the reference side; without truth the fold is -1."""
    s = records.where("src = 1").select(F.col("uid").alias("s1_uid"), "eid", "country", "prof")
    if truth is None:
        return s.withColumn("n_true", F.lit(0).cast("long")).withColumn("fold", F.lit(-1))
    n = truth.groupBy("s1_uid").agg(F.count("*").alias("n_true"))
    return folds(s.join(n, "s1_uid", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0)).cast("long")), n_folds, seed=seed)


def cluster_sample(records: DataFrame, truth: DataFrame, fraction: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Records and truth of a share of the reference entities with all their matches, and the same share of unmatched records of each source."""
    ref = hash_sample(records.where("src = 1"), ["eid"], fraction, seed)
    kept = truth.join(ref.select(F.col("uid").alias("s1_uid")), "s1_uid", "left_semi")
    matched = records.join(kept.select(F.col("rec_uid").alias("uid")), "uid", "left_semi")
    loose = hash_sample(records.where("src <> 1").join(truth.select(F.col("rec_uid").alias("uid")), "uid", "left_anti"), ["eid"], fraction, seed)
    return ref.unionByName(matched).unionByName(loose).dropDuplicates(["uid"]), kept


def id_lists(pairs: DataFrame, entities: DataFrame, records: DataFrame, score: str, order: str = "s1_uid") -> DataFrame:
    """(source1_entity_id, ids) for every entity: its records' ids by falling score, comma-joined, each once; empty without any."""
    one = pairs.groupBy("s1_uid", "rec_uid").agg(F.max(score).alias("q")).join(records.select(F.col("uid").alias("rec_uid"), F.col("eid").alias("rid")), "rec_uid")
    lists = one.groupBy("s1_uid").agg(F.sort_array(F.collect_list(F.struct((-F.col("q")).alias("q"), "rid"))).alias("l"))
    out = entities.select("s1_uid", F.col("eid").alias("source1_entity_id")).join(lists, "s1_uid", "left")
    ids = F.array_join(F.transform("l", lambda x: x["rid"]), ",")
    return out.select(order if order == "s1_uid" else F.col(order), "source1_entity_id", F.coalesce(ids, F.lit("")).alias("ids"))


def write_id_lists(lists: DataFrame, path: str, column: str) -> None:
    """Tab-separated text in entity order, a header in every part."""
    lists.orderBy("s1_uid").select("source1_entity_id", F.col("ids").alias(column)).write.mode("overwrite").option("sep", "\t").option("quote", "").option("escape", "").option("header", True).option("emptyValue", "").csv(path)


def outside(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches that aren't candidates: empty where the outputs are consistent."""
    return matches.select("s1_uid", "rec_uid").join(candidates, ["s1_uid", "rec_uid"], "left_anti")


def write_outputs(matches: DataFrame, candidates: DataFrame, entities: DataFrame, records: DataFrame, folder: str, *, match_score: str = "q", candidate_score: str = "p_pre") -> None:
    """Both result files; refuses matches that aren't candidates."""
    if not outside(matches, candidates).isEmpty():
        raise ValueError("a match is not among the candidates")
    write_id_lists(id_lists(matches, entities, records, match_score), f"{folder}/matching_results.tsv", "matched_entity_ids")
    write_id_lists(id_lists(candidates, entities, records, candidate_score), f"{folder}/candidate_pairs.tsv", "candidate_entity_ids")
