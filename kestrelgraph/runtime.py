"""Session, scratch space and naming helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Largest table that an operator may broadcast after measuring it.
BROADCAST_BYTES = 64 << 20


def session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the operators expect; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kestrelgraph")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one of our own only where it is unset (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    have = spark.sparkContext.getCheckpointDir()
    if have:
        return have
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="kestrel-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; the folder is scratch space
        pass


_SPACES: list[list[str]] = []


@contextmanager
def scratch_space(spark: SparkSession) -> Iterator[None]:
    """The scratch tables that operators make inside are removed at the end: results must have been written by then."""
    _SPACES.append([])
    try:
        yield
    finally:
        for path in _SPACES.pop():
            remove(spark, path)


def scratch_path(spark: SparkSession) -> str:
    """A new folder in the shared scratch space. It is removed with the open scratch_space(), else when the process ends."""
    path = os.path.join(scratch_dir(spark), f"kestrel-{os.getpid()}-{uuid.uuid4().hex}")
    if _SPACES:
        _SPACES[-1].append(path)
    atexit.register(remove, spark, path)
    return path


def materialize(df: DataFrame, files: int | None = None) -> DataFrame:
    """Cut the lineage: write df as a Parquet table in the shared scratch folder and read it back.

    Unlike a local checkpoint the rows survive the loss of any executor, and later scans prune columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    (df.coalesce(files) if files else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once for each context: executors need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_kestrelgraph_shipped", False):
        return
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="kestrel-ship-")
    copy = Path(folder, "src", home.name)
    shutil.copytree(home, copy, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(Path(folder, f"kestrelgraph-{uuid.uuid4().hex[:8]}")), "zip", copy.parent))
    atexit.register(shutil.rmtree, folder, True)
    sc._kestrelgraph_shipped = True


def fresh(names: Iterable[str], taken: Iterable[str]) -> list[str]:
    """Column names derived from names that clash with none of taken (which Spark compares without case)."""
    used = {x.lower() for x in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
