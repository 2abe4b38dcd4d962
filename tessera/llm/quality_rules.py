"""Quality rules whose thresholds come from mergeable quantile sketches per language and source."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.runtime import cut
from tessera.llm.spans import WHITE, U64, Words, chunks, mix64

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True

STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"

#: Measured quantities, each a share or a mean that a bad text has too much of: the value, what a share is counted among (None: no
#: share), the upper quantile that tells the usual spread above the median, and how many such spreads are allowed.
RULES = {
    "symbol_share": ("n_symbols / nullif(word_chars, 0)", "word_chars", 0.85, 6.0),
    "dup_line_share": ("n_dup_lines / nullif(n_lines, 0)", "n_lines", 0.99, 2.0),
    "repeat_share": ("n_repeat_words / nullif(n_words, 0)", "n_words", 0.99, 2.0),
    "mean_word": ("word_chars / nullif(n_words, 0)", None, 0.85, 6.0),
}


def _per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def measured(texts: list[bytes]) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_lines (with a word), n_repeat_words of each text."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    chars = _per_text(~WHITE[data] & ((data & 0xC0) != 0x80), first)
    symbols = _per_text(SYMBOL[data], first)
    dup, lines = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        own = [x for x in t.split(b"\n") if x.strip()]
        lines[i], dup[i] = len(own), len(own) - len(set(own))
    w = Words(texts)
    repeat = np.zeros(len(texts), dtype=np.int64)
    h, at = w.grams(3)
    if len(at):
        key = mix64(h + w.text_of[at].astype(U64) * U64(0x9E3779B97F4A7C15))
        o = np.argsort(key)
        same = key[o][1:] == key[o][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[o[1:][same]] = True
        twice[o[:-1][same]] = True
        covered = np.zeros(len(w.start), dtype=bool)
        for i in range(3):
            covered[at[twice] + i] = True
        repeat = np.bincount(w.text_of[covered], minlength=len(texts))
    return [w.n, chars, symbols, dup, lines, repeat]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in STATS.split(", ")]
    for (ids, lang, source), texts in chunks(batches, ["doc_id", "lang", "source"], "text"):
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(lang, pa.string()), pa.array(source, pa.string()), *(pa.array(x.astype(np.int64)) for x in measured(texts))], names=names)


def text_stats(docs: DataFrame) -> DataFrame:
    """Counts of each text (null: empty)."""
    return docs.mapInArrow(_measure, STATS)


# ---------------------------------------------------------------- sketches


def bucket(value: Column, accuracy: float) -> Column:
    """The value's bucket in a log-spaced histogram: any value of a bucket is within ``accuracy`` of its midpoint."""
    gamma = (1 + accuracy) / (1 - accuracy)
    return F.when(value > 0, F.ceil(F.log(value) / F.log(F.lit(gamma))).cast("int")).otherwise(F.lit(-(1 << 30)))


def bucket_value(b: Column, accuracy: float) -> Column:
    gamma = (1 + accuracy) / (1 - accuracy)
    return F.when(b == -(1 << 30), F.lit(0.0)).otherwise(2 * F.pow(F.lit(gamma), b) / (gamma + 1))


def bucket_edge(b: Column, accuracy: float) -> Column:
    """The value that none of the bucket exceeds (a hair above its upper edge, for the sake of rounding)."""
    gamma = (1 + accuracy) / (1 - accuracy)
    return F.when(b == -(1 << 30), F.lit(0.0)).otherwise(F.pow(F.lit(gamma), b) * F.lit(1 + 1e-9))


def sketches(values: DataFrame, keys: list[str], accuracy: float) -> DataFrame:
    """Mergeable quantile sketches: (keys, rule, bucket, n).  Merging is summing n, in any order, with the same result."""
    return values.select(*keys, "rule", bucket(F.col("value"), accuracy).alias("bucket")).groupBy(*keys, "rule", "bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], at: dict[str, Column | float], accuracy: float, of: Callable[[Column, float], Column] = bucket_value) -> DataFrame:
    """(keys, rule, rows, one column for each named quantile).  A sketch has at most a few thousand buckets."""
    w = Window.partitionBy(*keys, "rule").orderBy("bucket")
    ranked = sketch.withColumn("upto", F.sum("n").over(w)).withColumn("rows", F.sum("n").over(Window.partitionBy(*keys, "rule")))
    value = of(F.col("bucket"), accuracy)
    reached = {name: F.col("upto") >= (q if isinstance(q, Column) else F.lit(q)) * F.col("rows") for name, q in at.items()}
    return ranked.groupBy(*keys, "rule").agg(F.max("rows").alias("rows"), *[F.min(F.when(x, value)).alias(name) for name, x in reached.items()])


def thresholds(stats: DataFrame, *, accuracy: float = 0.01, least_rows: int = 100) -> DataFrame:
    """(lang, source, one column per rule): median + spreads * (upper quantile - median), from the group's sketch alone.

    Quantiles are taken at their buckets' upper edges, so where a group has no spread its usual value is within the threshold.

    A (lang, source) pair with fewer than ``least_rows`` texts uses the sketch merged over its language, and a language with
    fewer the one merged over all.
    """
    long = stats.where("not base_failed").select("lang", "source", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.expr(v).cast("double").alias("value")) for r, (v, *_) in RULES.items()])).alias("x")).select("lang", "source", "x.rule", "x.value").where("value is not null")
    fine = cut(sketches(long, ["lang", "source"], accuracy))
    per_rule = lambda i: F.element_at(F.create_map(*[F.lit(x) for r, rule in RULES.items() for x in (r, rule[i])]), F.col("rule"))
    levels = []
    for keys in (["lang", "source"], ["lang"], []):
        merged = fine.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
        q = quantiles(merged, keys, {"mid": 0.5, "high": per_rule(2)}, accuracy, bucket_edge)
        fence = F.col("mid") + per_rule(3) * (F.col("high") - F.col("mid"))
        q = q.withColumn("fence", F.when(F.col("rows") >= least_rows, fence) if keys else fence)
        levels.append(q.groupBy(*keys).pivot("rule", list(RULES)).agg(F.first("fence")).select(*keys, *[F.col(r).alias(f"{r}_{len(keys)}") for r in RULES]))
    a, b, c = levels
    out = a.join(b.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left").drop("l").crossJoin(F.broadcast(c))  # c is one row
    return out.select("lang", "source", *[F.coalesce(f"{r}_2", f"{r}_1", f"{r}_0").alias(f"max_{r}") for r in RULES])


def exceeds(rule: str, noise: float) -> Column:
    """Whether a text's measure lies above its threshold; a share by more than ``noise`` standard errors of its own count.

    So one symbol in a group that otherwise has none isn't enough, and no least value is fixed.
    """
    value, among, *_ = RULES[rule]
    v = F.expr(value)
    if among:
        v = v - F.lit(noise) * F.sqrt(v * (1 - v) / F.col(among))
    return F.coalesce(v > F.col(f"max_{rule}"), F.lit(False))


def quality_rules(docs: DataFrame, *, noise: float = 3.0, **options) -> DataFrame:
    """Texts with their counts and verdict: base rules, then adaptive upper thresholds per language and source.

    One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules, and
    the thresholds of its group (max_ and the rule).  base_failed: n_words < 50 or more than half of the words in repeated
    3-word windows.  A text is kept if its base rules hold and no measure exceeds its threshold (``exceeds``); thresholds are
    learned from all texts that pass the base rules.  Ids are integers.

    Null text: no words, so base_failed.  Null lang or source: a group of their own.  Repeated rows count each.  Ties: a
    measure equal to its threshold is kept.  Very long texts: counted whole.  Other columns, whatever their names, are ignored;
    an empty table gives none.  ``options``: ``thresholds``.
    """
    stats = cut(text_stats(docs.select(F.col("doc_id").cast("long"), "lang", "source", "text")).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")))
    limits = thresholds(stats, **options).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    joined = stats.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    over = {r: exceeds(r, noise) for r in RULES}
    failed = F.filter(F.array(*[F.when(x, F.lit(r)) for r, x in over.items()]), lambda r: r.isNotNull())
    kept = ~F.col("base_failed") & ~reduce(lambda a, b: a | b, over.values())
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), failed.alias("failed_rules"), *[f"max_{r}" for r in RULES])
