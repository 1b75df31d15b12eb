"""Session-level helpers: builder, shared scratch space, shipping the package to executors."""

from __future__ import annotations

import os
import re
import tempfile
import time
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def session(app: str = "loomtrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that every operator assumes (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Python stages can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="loomtrace-ship-")) / "loomtrace.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, f"loomtrace/{source.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only where it is unset does this pick a folder of its own, and only for a master in this process: on a cluster
    executors could not read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master is {master})")
        base = f"file://{tempfile.gettempdir()}/loomtrace-{os.getuid()}-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomtrace/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path  # type: ignore[attr-defined]
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files behind frames made by materialise()."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            spark = df.sparkSession
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


class StageTimes(dict):
    """Wall-clock seconds by stage: ``with times.stage(name)``; a DataFrame given to ``run`` is computed inside it."""

    @contextmanager
    def stage(self, name: str):
        start = time.perf_counter()
        try:
            yield self
        finally:
            self[name] = self.get(name, 0.0) + time.perf_counter() - start

    def run(self, name: str, df: DataFrame) -> DataFrame:
        """df, written within the stage: what is timed is the work and not its plan."""
        with self.stage(name):
            return materialise(df, name)

    def report(self, spark: SparkSession) -> DataFrame:
        """(stage, sec, percent) in order of the stages."""
        whole = sum(self.values()) or 1.0
        return spark.createDataFrame([(k, round(v, 4), round(100 * v / whole, 4)) for k, v in self.items()], "stage string, sec double, percent double")
