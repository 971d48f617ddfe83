"""What the corpus operators share on the Spark side: the shared folder, checked broadcasts, components."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has been counted and has no more rows than this.
BROADCAST_ROWS = 500_000
BATCH_BYTES = 2 << 20
_written: dict[str, weakref.ref] = {}
_own = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the session names in spark.checkpoint.dir.

    Where none is named, a local master gets a temporary one; on a cluster, whose machines
    would not see it, that's an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tracelake-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tracelake-{uuid.uuid4().hex}"


def _remove(jvm, conf, path: str) -> None:
    try:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        return


def _remove_all() -> None:
    for path, spark in _written.items():
        if spark() is not None and spark().sparkContext._jsc is not None:
            _remove(spark()._jvm, spark()._jsc.hadoopConfiguration(), path)


atexit.register(_remove_all)


def kept_until_exit(spark: SparkSession, path: str) -> str:
    """Has a folder removed when the driver ends."""
    _written[path] = weakref.ref(spark)
    if not hasattr(_own, "paths"):
        _own.paths = set()
    _own.paths.add(path)
    return path


def written() -> set[str]:
    """The folders of this thread that will be removed when the driver ends."""
    return set(getattr(_own, "paths", ()))


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes folders that nothing reads any more."""
    for path in paths:
        _written.pop(path, None)
        getattr(_own, "paths", set()).discard(path)
        _remove(spark._jvm, spark._jsc.hadoopConfiguration(), path)


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = kept_until_exit(spark, shared_dir(spark))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES: a batch is in memory several times over, in the JVM and in the worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(name).lower().rstrip("b")
    if not size.isdigit() or int(size) <= 0 or int(size) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with marks put before them until no column of df is called so (case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if a count shows that it's small; else Spark joins by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def _least_of(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest v of each u, or u itself.

    The key is written as an expression, equal to u, so that a join deals these rows out
    anew: both its sides are then plain shuffles, of which adaptive execution splits the
    partition of a node with very many edges.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return least.select(F.greatest("u", "m").alias("u"), "m")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of links (a, b) reaches; alternating large and small stars.

    Every round turns each node's edges toward its smallest neighbour, so the number of
    rounds follows the logarithm of a component's size. Rounds are written to the shared
    folder, each in place of the one before; no node or edge comes to the driver.
    """
    spark, before = links.sparkSession, written()
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    while True:
        last = written() - before
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least_of(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.join(_least_of(large), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stored(small.where("u <> v").distinct())
        discard(spark, *last)
        sums = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == sums:
            break
        seen = sums
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
