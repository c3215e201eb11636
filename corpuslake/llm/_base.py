"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte class of white space between words: space, tab, \n, \v, \f, \r.
SPACE = r"[\x20\x09-\x0D]+"

_shipped: set[str] = set()
_tables: list[tuple] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, so Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    archive = os.path.join(tempfile.mkdtemp(prefix="corpuslake-"), "corpuslake.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((root / "corpuslake").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode a temporary one where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="corpuslake-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    The table stays until the driver exits or ``drop_staged`` is called.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpuslake-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables; with ``frames``, only those (each as staged() returned it)."""
    paths = {getattr(df, "_staged_at", None) for df in frames}
    for entry in list(_tables):
        spark, path = entry
        if frames and path not in paths:
            continue
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone, and with it the way to reach the store
            pass
        _tables.remove(entry)


atexit.register(drop_staged)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is among ids (one column); all columns and rows with a null doc_id stay."""
    name = fresh(docs, "gone")
    gone = ids.toDF(name)
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col):
    """Lower-case A to Z alone."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_col(col):
    """Array of the maximal runs of other characters than white space; empty for null."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), SPACE), lambda w: w != "")
