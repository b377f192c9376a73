"""Session helpers shared by all operators: table access, code shipping, lineage cuts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; columns and filters are pruned by the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application.

    Arrow functions are pickled by reference, so every Python worker must be
    able to import the package even where it isn't installed.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="pkg-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)
    atexit.register(shutil.rmtree, target.parent, ignore_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session (tests) may leave it out; it gets a temporary folder,
    recorded so that later calls agree.  On a cluster a missing setting is an
    error, because executors don't see each other's disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(?:\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="shared-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used where a result feeds several later stages: it is computed once, its
    lineage ends here, and it outlives the executor that made it.  The table
    is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, n: int, *by: str, whole: int | None = None) -> DataFrame:
    """At most ``n`` rows, chosen by a hash of the columns ``by``; for fitting models only.

    A large input is thinned before the final ordering, so that a task sends
    the driver its share of the sample and not ``n`` rows of its own.  ``whole``
    is the number of rows, where it is known already.
    """
    from pyspark.sql import functions as F

    keyed = df.withColumn("_h", F.pmod(F.xxhash64(*by), F.lit(1 << 30)))
    whole = df.count() if whole is None else whole
    if whole > 2 * n:
        keyed = keyed.where(F.col("_h") < int((1 << 30) * 1.5 * n / whole))
    return keyed.orderBy("_h", *by).limit(n).drop("_h")
