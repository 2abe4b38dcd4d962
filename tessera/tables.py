"""The driver's tables in the roles of a linkage task, and the same as SQL.

Orders own lineitems: an order is an entity (s1_uid), a part a record (rec_uid), and a digit sum of the price a score; a supplier's
parity is the source; large early deliveries are true pairs.  Parts play records with names, numbers and codes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (s1_uid, rec_uid) with p (0 to 1, with ties), src (2 or 3), label and num_hit."""
    li = table(spark, sf_dir, "lineitem")
    p = (F.floor(F.col("l_extendedprice") * 100) % 1000).cast("double") / 1000
    label = ((F.col("l_quantity") > 25) & (F.col("l_linestatus") == "F")).cast("int")
    return li.groupBy(F.col("l_orderkey").alias("s1_uid"), F.col("l_partkey").alias("rec_uid")).agg(
        F.max(p).alias("p"), F.min(2 + F.col("l_suppkey") % 2).cast("int").alias("src"), F.max(label).alias("label"), F.max((F.col("l_linenumber") % 2).cast("int")).alias("num_hit")
    )


EDGES = """edges as (select l_orderkey as s1_uid, l_partkey as rec_uid, max((floor(l_extendedprice * 100) % 1000) / 1000.0::double) as p,
  min(2 + l_suppkey % 2)::int as src, max(case when l_quantity > 25 and l_linestatus = 'F' then 1 else 0 end) as label,
  max(l_linenumber % 2)::int as num_hit from lineitem group by 1, 2)"""


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).where("label = 1").select("s1_uid", "rec_uid")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1_uid, prof, n_true) of every order; its priority is the profile."""
    n = truth(spark, sf_dir).groupBy("s1_uid").agg(F.count("*").alias("n_true"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("s1_uid"), F.col("o_orderpriority").alias("prof"))
    return o.join(n, "s1_uid", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0)))


ENTITIES = """truth as (select s1_uid, rec_uid from edges where label = 1),
entities as (select o_orderkey as s1_uid, o_orderpriority as prof, coalesce(n, 0) as n_true from orders
  left join (select s1_uid, count(*) as n from truth group by 1) t on t.s1_uid = o_orderkey)"""


def predicted(spark: SparkSession, sf_dir: str, floor: float = 0.6) -> DataFrame:
    return edges(spark, sf_dir).where(F.col("p") >= floor).select("s1_uid", "rec_uid")


PREDICTED = "pred as (select s1_uid, rec_uid from edges where p >= 0.6)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as (uid, name, addr, num, nums, pin)."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("uid"), F.col("p_name").alias("name"), F.col("p_type").alias("addr"), F.col("p_size").cast("string").alias("num"), F.array(F.col("p_size").cast("string"), (F.col("p_size") % 7).cast("string")).alias("nums"), F.col("p_brand").alias("pin")
    )


RECORDS = "records as (select p_partkey as uid, p_name as name, p_type as addr, p_size::varchar as num, [p_size::varchar, (p_size % 7)::varchar] as nums, p_brand as pin from part)"


def part_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(country, uid, src, kt, key): sorted name words, brand and type, and size bucket with brand; every fourth part is a reference."""
    p = table(spark, sf_dir, "part").select(F.lit("all").alias("country"), F.col("p_partkey").alias("uid"), F.when(F.col("p_partkey") % 4 == 0, 1).otherwise(2).alias("src"), "p_name", "p_brand", "p_type", "p_size")
    keys = F.array(F.array_join(F.array_sort(F.split("p_name", " ")), " "), F.concat_ws("|", "p_brand", "p_type"), F.concat_ws("|", F.floor(F.col("p_size") / 5).cast("string"), "p_brand"))
    return p.select("country", "uid", "src", F.posexplode(keys).alias("kt", "key"))


PART_KEYS = """keys as (select uid, ref, kt, key from (select p_partkey as uid, p_partkey % 4 = 0 as ref, unnest([0, 1, 2]) as kt,
  unnest([array_to_string(list_sort(string_split(p_name, ' ')), ' '), p_brand || '|' || p_type, floor(p_size / 5.0)::int::varchar || '|' || p_brand]) as key from part))"""
