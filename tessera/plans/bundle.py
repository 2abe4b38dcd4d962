"""What training learned, saved to and loaded from any folder that Spark reaches."""

from __future__ import annotations

import json

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import SparkSession

from tessera.functions.compare import Weights
from tessera.functions.parse import Tables
from tessera.operators.models import Calibrator, FoldModels
from tessera.plans.linkage import Bundle


def _put(spark: SparkSession, path: str, value) -> None:
    spark.createDataFrame([(json.dumps(value),)], "json string").coalesce(1).write.mode("overwrite").text(path)


def _get(spark: SparkSession, path: str):
    return json.loads(spark.read.option("wholetext", True).text(path).first()[0])


def _save_folds(folds: FoldModels, path: str) -> dict:
    for i, m in enumerate(folds.models):
        m.write().overwrite().save(f"{path}/{i}")
    return {"features": folds.features, "n": len(folds.models), "path": path.rsplit("/", 1)[1]}


def save(spark: SparkSession, b: Bundle, path: str) -> None:
    t = b.tables
    meta = {
        "tables": {"tokens": t.tokens, "name_short": t.name_short, "addr_short": t.addr_short, "components": t.components, "name_affix": {k: sorted(v) for k, v in t.name_affix.items()}, "addr_affix": {k: sorted(v) for k, v in t.addr_affix.items()}},
        "name": [b.name.default, b.name.rare],
        "addr": [b.addr.default, b.addr.rare],
        "folds": {"pre": _save_folds(b.pre, f"{path}/pre"), "gate": _save_folds(b.gate, f"{path}/gate")},
        "rounds": [[_save_folds(m, f"{path}/round{i}_{j}") for j, m in enumerate(bag)] for i, bag in enumerate(b.rounds)],
        "calibrator": {"fallback": b.calibrator.fallback, "profiles": sorted(b.calibrator.models)},
        "thresholds": b.thresholds,
        "countries": b.countries,
    }
    for i, k in enumerate(meta["calibrator"]["profiles"]):
        b.calibrator.models[k].write().overwrite().save(f"{path}/iso{i}")
    for name, w in (("name", b.name), ("addr", b.addr)):
        w.table.write.mode("overwrite").parquet(f"{path}/idf_{name}")
    _put(spark, f"{path}/meta", meta)


def load(spark: SparkSession, path: str) -> Bundle:
    meta = _get(spark, f"{path}/meta")
    folds = lambda m: FoldModels(m["features"], [GBTClassificationModel.load(f"{path}/{m['path']}/{i}") for i in range(m["n"])])
    idf = lambda n: spark.read.parquet(f"{path}/idf_{n}")
    t = meta["tables"]
    tables = Tables(t["tokens"], t["name_short"], t["addr_short"], t["components"], {k: set(v) for k, v in t["name_affix"].items()}, {k: set(v) for k, v in t["addr_affix"].items()})
    iso = {k: IsotonicRegressionModel.load(f"{path}/iso{i}") for i, k in enumerate(meta["calibrator"]["profiles"])}
    return Bundle(tables, Weights(idf("name"), *meta["name"]), Weights(idf("addr"), *meta["addr"]), folds(meta["folds"]["pre"]), [[folds(m) for m in bag] for bag in meta["rounds"]], Calibrator(iso, meta["calibrator"]["fallback"]), folds(meta["folds"]["gate"]), meta["thresholds"], meta["countries"])
