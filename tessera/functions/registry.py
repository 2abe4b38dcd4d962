"""The functions by name, for SQL text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import parse, similarity, text


def register(spark: SparkSession, prefix: str = "") -> list[str]:
    """Registers similarity, text and parsing functions for spark.sql; returns their names."""
    pair = {"jaro_winkler": similarity.jaro_winkler, "indel_ratio": similarity.indel, "token_sort_ratio": similarity.token_sort, "token_set_ratio": similarity.token_set, "partial_ratio": similarity.partial}
    one = {"clean": (text.clean, "string"), "romanize": (text.romanize, "string"), "skeleton": (text.skeleton, "string"), "tokens": (lambda s: text.tokens(text.clean(s)), "array<string>"), "domain_body": (text.domain_body, "string"), "profile_name": (parse.profile_name, "string")}

    def single(f):
        def run(s: pd.Series) -> pd.Series:
            return s.map(f, na_action="ignore")

        return run

    def frame(f, fields: str):
        def run(raw: pd.Series, prof: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([f(a, b) for a, b in zip(raw, prof)], columns=[x.split()[0] for x in fields.split(", ")])

        return run

    made = {n: F.pandas_udf(similarity._paired(f), "double") for n, f in pair.items()}
    made |= {n: F.pandas_udf(single(f), t) for n, (f, t) in one.items()}
    made |= {"parse_name": F.pandas_udf(frame(parse.parse_name, parse.NAME_FIELDS), parse.NAME_FIELDS), "parse_address": F.pandas_udf(frame(parse.parse_address, parse.ADDR_FIELDS), parse.ADDR_FIELDS)}
    for name, udf in made.items():
        spark.udf.register(prefix + name, udf)
    return [prefix + n for n in made]
