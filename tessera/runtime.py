"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the one that the context has, else ``spark.checkpoint.dir``.

    Where neither is set a session of one process, as in tests, gets a temporary folder; a cluster, whose machines wouldn't
    share it, has to be given one.
    """
    sc = spark.sparkContext
    here = sc._jsc.sc().getCheckpointDir()
    if here.isDefined():
        return here.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows as they are now, written to the shared checkpoint folder.

    The shuffles that made them are no longer needed and are removed at once; df itself isn't meant to be run again.
    """
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    df._jdf.queryExecution().toRdd().cleanShuffleDependencies(False)
    return out


def written(df: DataFrame) -> DataFrame:
    """The rows as they are now, as Parquet in the shared checkpoint folder: for texts, which a checkpoint wouldn't compress."""
    path = f"{checkpoint_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Gives the executors this package, once an application, so that they can import it wherever they start."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)
    return spark
