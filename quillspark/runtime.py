"""Session, shared storage and code shipping."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "quillspark") -> SparkSession:
    """A local session as the tests and the bench use it."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keys_differ(df: DataFrame, key: str) -> bool:
    """Whether no two rows have the same key; reads that column alone."""
    return df.groupBy(key).count().where("count > 1").isEmpty()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset (tests) a local one is chosen."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder. What is left there goes when the driver ends."""
    path = f"{shared_root(spark)}/quillspark/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(lambda: remove_since(0))
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: its lineage is cut and it survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_written_to"] = path
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path that this library wrote to the shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(df: DataFrame) -> None:
    """Delete the table of materialize() that nothing will read any more."""
    path = df.__dict__.get("_written_to")
    if path:
        remove_path(df.sparkSession, path)
        _made[:] = [x for x in _made if x[1] != path]


def made_so_far() -> int:
    """A mark for remove_since()."""
    return len(_made)


def remove_since(mark: int, *keep: DataFrame) -> None:
    """Delete what was written to the shared folder since a mark, but for some tables."""
    kept = {x.__dict__.get("_written_to") for x in keep}
    for spark, path in _made[mark:]:
        if path not in kept and spark.sparkContext._jsc is not None:
            remove_path(spark, path)
    _made[mark:] = [x for x in _made[mark:] if x[1] in kept]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, so that operators run where it isn't installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="quillspark-ship-"), "quillspark.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for top, dirs, files in os.walk(root):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    p = os.path.join(top, f)
                    z.write(p, os.path.join("quillspark", os.path.relpath(p, root)))
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)
