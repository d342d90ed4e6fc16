"""Session helpers: the shared scratch folder, lineage cuts, size-checked collects and code shipping."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``. A temporary one where that is unset and everything runs on one machine; on a cluster that is an error, as no other machine could read it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="claimloom-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the JVM may already be gone when Python exits
        pass


def _clean() -> None:
    while _written:
        _remove(*_written.pop())


atexit.register(_clean)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back. The files outlive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/claimloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, most: int, what: str) -> list[Row]:
    """Collect at most ``most`` rows; more is an error and never a silent cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows; raise the bound or use the distributed form")
    return rows


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where an input comes in fewer partitions than there are cores, as a small file does; larger inputs stay as they are and are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Give the Python workers the package's code, wherever they run; once a session."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="claimloom-code-"), "claimloom.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, str(Path("claimloom") / p.relative_to(here)))
    sc.addPyFile(out)
