"""What the operators share: the shared folder, written tables, null handling, shipping the code."""

from __future__ import annotations

import atexit
import gc
import hashlib
import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id inside the operators; it sorts before every other id.
NULL_ID = -(1 << 63)

#: Rows that go to Python at once.  Texts are long, so Spark's default of 10,000 would
#: need hundreds of megabytes for each task in the JVM and in Python.
ARROW_ROWS = 1000
_ARROW_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

_own_folder: list[str] = []
_shipped: set[tuple[str, str]] = set()
_roots: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (as in tests on one machine) a
    folder of our own is made; on a cluster an unset folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_folder:
        made = tempfile.TemporaryDirectory(prefix="factloom-")
        atexit.register(made.cleanup)
        _own_folder.append(f"file://{made.name}")
    return _own_folder[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends unless ``discard`` came first."""
    root = f"{shared_dir(spark)}/factloom/{spark.sparkContext.applicationId}"
    if root not in _roots:
        place = spark._jvm.org.apache.hadoop.fs.Path(root)
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(place)
        store.deleteOnExit(place)
        _roots.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df``, written as Parquet in the shared folder and read back.

    Cuts the lineage in a way that survives the loss of executors, and fixes the
    rows where they depend on how the input was split into tasks.
    """
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Collect garbage on the driver, without which Spark keeps the shuffle files of finished jobs on the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context and code version, and bound the Arrow batches."""
    if int(spark.conf.get(_ARROW_ROWS_KEY)) > ARROW_ROWS:
        spark.conf.set(_ARROW_ROWS_KEY, ARROW_ROWS)
    root = Path(__file__).resolve().parents[1]
    files = sorted(p for p in root.rglob("*.py"))
    digest = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:16]
    key = (spark.sparkContext.applicationId, digest)
    if key in _shipped:
        return
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            z.write(p, str(p.relative_to(root.parent)))
    folder = tempfile.mkdtemp(prefix="factloom-code-")
    path = Path(folder) / f"factloom_{digest}.zip"
    path.write_bytes(blob.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(key)


def doc_key(name: str = "doc_id") -> Column:
    """The id as long, a null as ``NULL_ID``."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID)).alias(name)


def doc_out(name: str = "doc_id") -> Column:
    """The reverse of ``doc_key``."""
    return F.when(F.col(name) != F.lit(NULL_ID), F.col(name)).alias(name)


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only doc_id (null: NULL_ID) and text (null: empty), whatever other columns there are."""
    return docs.select(doc_key(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


#: A key with more rows than this, and than this share of all rows, is hot.
HOT_ROWS, HOT_SHARE = 1000, 1e-4


def hot_keys(counted: DataFrame, rows: str, total: int) -> Column:
    """Whether the key of a row of ``counted`` has so many ``rows`` that it is hot; at most 1 / HOT_SHARE keys are."""
    return F.col(rows) > F.lit(max(HOT_ROWS, int(total * HOT_SHARE)))


def is_even(most: int | None, total: int | None) -> bool:
    """Whether no key is hot, given the most rows of a key (None: no rows)."""
    return most is None or most <= max(HOT_ROWS, int((total or 0) * HOT_SHARE))


def join_counted(left: DataFrame, counted: DataFrame, keys: list[str], rows: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined (inner, left or left_semi) with ``counted``, which has one row for each key and tells the rows of ``left`` that have it.

    The hot keys, at most 1 / HOT_SHARE of them, are broadcast, so that their rows stay
    where they are; the others are joined by a shuffle in which no key stands out.
    ``total`` is the number of rows of ``left``.  ``left`` is read twice, so it should be
    a written table or one whose last shuffle can be reused.
    """
    hot = F.broadcast(counted.where(hot_keys(counted, rows, total)))
    near = left.join(hot, keys, "left_semi" if how == "left_semi" else "inner")
    far = left.join(hot.select(*keys), keys, "left_anti").join(counted.where(~hot_keys(counted, rows, total)), keys, how)
    return near.unionByName(far)


def beside(keep: tuple[str, ...], own: tuple[str, ...]) -> dict[str, str]:
    """The result's name of each kept column: its own, or with ``in_`` before it (as often as needed) where that is taken."""
    taken, out = {c.lower() for c in own}, {}
    for c in dict.fromkeys(keep):
        name = c
        while name.lower() in taken:
            name = f"in_{name}"
        taken.add(name.lower())
        out[c] = name
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
