"""Session defaults and the shared scratch space for intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Session settings the engine expects; a cluster may override any of them.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` adds or overrides settings."""
    builder = SparkSession.builder.master(master).appName("conefix")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions), "spark.ui.enabled": "false"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application.

    Nothing is sent where workers find it anyway: by PYTHONPATH, or in the folder the driver runs in.
    """
    root = Path(__file__).resolve().parent.parent
    found = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    context = spark.sparkContext
    if root in found or Path.cwd() == root or context.applicationId in ship.done:
        return
    target = Path(tempfile.mkdtemp(prefix="conefix-")) / "conefix.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as file:
        for source in sorted((root / "conefix").rglob("*.py")):
            file.write(source, source.relative_to(root))
    context.addPyFile(str(target))
    ship.done.add(context.applicationId)


ship.done = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` where the cluster names one. A temporary
    folder of this machine is taken only where it is unset and the master is local (tests).
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("a cluster has to name a shared folder in spark.checkpoint.dir")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = "file://" + tempfile.mkdtemp(prefix="conefix-")
    return shared_dir.own


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, which joins shuffle and do not broadcast, nor what is selected, filtered or aggregated from it; a small other side may be."""
    return df.hint("merge")


class Scratch:
    """Intermediate tables of one query, written to the shared folder.

    A written table cuts lineage and outlives lost executors. Tables that the
    caller drops are deleted at once, the others when the driver exits.

    Spark broadcasts a side of a join by the size of its compressed files, which may be a hundredth of what the
    driver would then hold. Tables of a ``spread`` scratch are therefore shuffled in joins, and only small ones of few rows broadcast.
    """

    #: Bytes of files up to which a table of a spread scratch is broadcast.
    SMALL = 1 << 18
    #: Rows up to which it is: rows that are alike take next to no bytes in files, but in the driver all of theirs.
    FEW = 10_000

    def __init__(self, spark: SparkSession, name: str, spread: bool = False):
        ship(spark)
        self.spark, self.spread = spark, spread
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._delete, self.root)

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` as Parquet and return a frame that reads it back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        held = self.spark.read.schema(df.schema).parquet(path)
        if not self.spread:
            return held
        return F.broadcast(held) if self.bytes(name) <= self.SMALL and held.count() <= self.FEW else shuffled(held)

    def bytes(self, name: str) -> int:
        """Of the files of a table."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        with contextlib.suppress(Exception):
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
