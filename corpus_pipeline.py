"""The training-data pipeline: ``STAGES`` in order, each over all that its predecessor kept.

Every stage but the last returns the columns of ``documents``; ``run`` writes each result as Parquet to the shared
folder and reads it again, so a lost executor never repeats an earlier stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.language_id import language_id
from tessera.llm.line_dedup import line_dedup
from tessera.llm.mixing import mix_sources
from tessera.llm.near_dedup import near_dedup
from tessera.llm.packing import pack
from tessera.llm.runtime import checkpoint_dir, cut
from tessera.runtime import ship

#: Documents whose language is told with less confidence than this go, as do those without a letter.
LEAST_SCORE = 0.3
#: Words from which on a later repeat of only one or two lines goes too.
LONG_RUN = 50


def _free(docs: DataFrame, name: str) -> str:
    """The name, longer if docs has such a column."""
    while name.casefold() in (c.casefold() for c in docs.columns):
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs as written rows with a number each, so that a verdict on a row finds the row, whatever its doc_id."""
    row = _free(docs, "row")
    return cut(docs.withColumn(row, F.monotonically_increasing_id())), row


def _named(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages.

    Null text and text without a letter: gone.  Null lang: judged by the text, like others.  Very long texts: judged whole.  Ties between languages go to the
    first by name.  Repeated rows: judged each, alike.  Other columns are handed on, whatever their names.  Empty table: empty.
    """
    ship(spark)
    told = language_id(docs, carry=True)
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*[F.col(f"carried.`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of three lines, or of fewer that hold 50 words; what has no line left goes.

    Null, empty and wordless texts stay as they are.  Very long texts: whole.  Ties: of equal runs the one of the smallest doc_id, and in it the
    first, stays.  Repeated rows of one doc_id don't remove each other; null doc_id: compared with itself alone.  n_chars is
    counted anew; other columns are handed on, whatever their names.  Empty table: empty.
    """
    ship(spark)
    kept = line_dedup(docs, least=LONG_RUN, carry=tuple(docs.columns)).where("n_removed = 0 or n_removed < n_lines")
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*[new[c].alias(c) if c in new else F.col(f"carried.`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest doc_id (of these the first row).

    Null doc_id and texts without a word are linked with nothing and stay.  Very long texts: whole.  Ties at the threshold are linked.
    Repeated rows of one doc_id are copies, so one stays; a doc_id with different texts keeps those that aren't copies.  Other
    columns are handed on, whatever their names.  Empty table: empty.
    """
    ship(spark)
    docs_, row = _numbered(docs)
    told = cut(near_dedup(docs_, row=row).select("group", "doc_id", F.col("row").alias("kept_row")))
    best = told.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "kept_row")).alias("x")).select("x.kept_row")
    kept = best.unionByName(told.where("group is null").select("kept_row")).withColumnRenamed("kept_row", _free(docs_, "kept_row"))
    return docs_.join(kept, docs_[row] == kept[kept.columns[0]], "left_semi").select(*_named(docs))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it.

    Null or wordless texts: their size is 0, so a source's rate decides on whole copies alone.  Null source: a source of its own.  Very long
    texts: whole, taken or not.  Null doc_id, repeated rows and ties are drawn each by themselves.  Other columns are handed
    on, whatever their names.  Empty table: empty.
    """
    ship(spark)
    docs_, row = _numbered(docs)
    mine, n = _free(docs_, "mixed_row"), _free(docs_, "mixed_copies")
    taken = mix_sources(docs_, row=row).where("copies > 0").select(F.col("row").alias(mine), F.col("copies").cast("int").alias(n))
    rows = docs_.join(taken, F.col(row) == F.col(mine))
    return rows.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*_named(docs))


def pack_along_curve(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences.

    Null or empty text: the one id that ends a document.  Very long texts span many sequences.  Repeated rows and null doc_ids are packed each; ties on
    the curve go by doc_id.  Other columns are ignored.  Empty table: empty.
    """
    import public_tokenizers

    ship(spark)
    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_to_targets),
    ("curve_packing", pack_along_curve),
]

#: Language ID, mixing and packing can't be expressed in SQL.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  A stage's rows are removed when the next one's are written; the last ones stay for the caller."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return docs
