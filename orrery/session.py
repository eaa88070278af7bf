"""Session helpers shared by every module."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder; Catalyst prunes columns and row groups."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, which the cluster names in
    ``spark.checkpoint.dir``.  Only on one machine (local master), where that is
    unset, a temporary folder takes its place."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="orrery-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the application ends."""
    folder = f"{shared_folder(spark)}/orrery-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: a table written to the shared folder and read
    again.  What is read has the size of its files, so the optimizer can choose
    joins by it, a lost executor costs nothing that was written, and columns
    that are not used are not read."""
    folder = own_folder(df.sparkSession, "table")
    df.write.mode("overwrite").parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._orrery_folder = folder
    return out


def discard(*frames: DataFrame | None) -> None:
    """Remove the tables of finished rounds; frames without one are left."""
    for df in frames:
        folder = getattr(df, "_orrery_folder", None)
        if folder:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Broadcasts are only asked for below this many rows, counted beforehand or
#: bounded by construction.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` if its counted or proven ``rows`` stay under the
    bound; beyond it the plain frame, so that a shuffle join is planned."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give work per row to all cores where the input comes in few pieces.

    Only when there are fewer partitions than cores is ``df`` hashed on
    ``key``; a large input has more splits than that and is left alone, so
    texts are not shuffled at scale."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if df._jdf.rdd().getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context.

    Workers then need no copy on their path.  The archive lies in the folder
    that all machines share, where the cluster names one."""
    import hashlib
    import io
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_orrery_shipped", False):
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(Path(root.name, p.relative_to(root)))), p.read_bytes())
    name = f"orrery-{hashlib.sha256(held.getvalue()).hexdigest()[:16]}.zip"
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared:
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared}/{name}")
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        if not fs.exists(path):
            out = fs.create(path, True)
            out.write(bytearray(held.getvalue()))
            out.close()
        sc.addPyFile(f"{shared}/{name}")
    else:
        local = Path(tempfile.mkdtemp(prefix="orrery-package-"), name)
        local.write_bytes(held.getvalue())
        sc.addPyFile(str(local))
    sc._orrery_shipped = True
