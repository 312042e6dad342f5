"""Session helpers: worker import path, the shared folder, tables written to cut lineage."""

from __future__ import annotations

import atexit
import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests, the bench and the command line."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("silterra")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package: on this machine where the driver found it, elsewhere from an archive in the shared folder."""
    sc = spark.sparkContext
    if sc.master == "local" or sc.master.startswith("local["):
        paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if ROOT not in paths:
            sc.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    elif sc.applicationId not in _shipped:
        name, content = archive()
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/silterra/{sc.applicationId}/{name}")
        out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(content))
        out.close()
        sc.addPyFile(path.toString())
        _shipped.add(sc.applicationId)
    return spark


#: Applications that have the archive.
_shipped: set[str] = set()


def archive() -> tuple[str, bytes]:
    """A zip of the package, and a name that tells its contents."""
    package = Path(ROOT) / "silterra"
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(p for p in package.rglob("*") if p.is_file() and "__pycache__" not in p.parts):
            z.write(p, p.relative_to(ROOT))
    return f"silterra-{hashlib.sha256(content.getvalue()).hexdigest()[:16]}.zip", content.getvalue()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only a session on one machine that names none gets a temporary folder. Anywhere else a missing setting is an
    error, as a machine-local folder is lost with its machine.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="silterra-")
    sc.setCheckpointDir(made)
    return sc.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of one query in the shared folder that is added to the job. ``drop`` removes one early, the rest go when the interpreter ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/silterra/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        atexit.register(self._close)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and return a scan of it: executors may be lost, the files stay."""
        path = self.paths[name] = f"{self.root}/{len(self.paths)}-{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, df: DataFrame, name: str) -> None:
        """Add the rows of df to a table; ``read`` gives it whole."""
        path = self.paths.setdefault(name, f"{self.root}/{len(self.paths)}-{name}")
        df.write.mode("append").parquet(path)

    def read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.paths[name])

    def drop(self, name: str) -> None:
        _delete(self.spark, self.paths[name])

    def _close(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                _delete(self.spark, self.root)
            except Exception:  # the session ended first; its folder goes with the cluster's
                pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder. One that is read by fewer tasks than the session can run is spread over as many, so only tables that small are moved."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = spark.sparkContext.defaultParallelism
    return rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows
