"""Session settings and durable materialisation."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Runtime settings every plan here relies on: adaptive coalescing, and splitting
# of skewed join partitions even where that costs one more exchange.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # As many keys as are looked up by value (SEEK_KEYS) reach the row groups one by one.
    "spark.sql.parquet.pushdown.inFilterThreshold": "200",
    # Rows may hold whole texts: small batches keep the memory of Python workers bounded.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8388608",
}


def local_session(cores: int | str = "*", app: str = "graphweft", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.parquet.compression.codec", "snappy")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tuned(spark)


def tuned(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


_local_scratch: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Only a local master
    falls back to a folder of its own, since a cluster cannot see one."""
    global _local_scratch
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="graphweft-")
    return _local_scratch


class Scratch:
    """Intermediate tables of one job, written to shared storage.

    A written table cuts lineage, outlives lost executors and gives the
    optimizer an exact size, so small frontiers are broadcast and large ones
    are not, without any hint.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/graphweft/{uuid.uuid4().hex}"
        self._tables = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        return self.write_counted(df, name)[0]

    def write_counted(self, df: DataFrame, name: str, of: str | None = None) -> tuple[DataFrame, int, int]:
        """The written table, its number of rows, and how many of them have a
        value in the column ``of``; both are counted while writing."""
        path = f"{self.base}/{self._tables:03d}_{name}"
        self._tables += 1
        seen = Observation()
        counts = [F.count(F.lit(1)).alias("rows"), F.count(F.col(of) if of else F.lit(1)).alias("values")]
        df.observe(seen, *counts).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), seen.get["rows"], seen.get["values"]


def rows_within(df: DataFrame, limit: int) -> list | None:
    """The rows of ``df`` when there are at most ``limit`` of them, else None.
    Reads no more than ``limit + 1`` rows to the driver."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


# Keys that are looked up by value rather than by a join.
SEEK_KEYS = 200


def seek(df: DataFrame, columns: list[str], keys: DataFrame) -> DataFrame:
    """Narrow ``df`` to rows that may hold one of a few ``keys`` (one column) in
    one of ``columns``. The values reach the scan as a filter, so files sorted by
    them are skipped. With more keys ``df`` stays whole and the join does it."""
    rows = rows_within(keys, SEEK_KEYS)
    if rows is None:
        return df
    values = [r[0] for r in rows]
    return df.where(reduce(Column.__or__, [F.col(c).isin(*values) for c in columns]))


def seek_edges(edges: DataFrame, incoming: DataFrame | None, ends: list[str], keys: DataFrame) -> DataFrame:
    """The same for edges with one of the ends ``ends`` in ``keys``. ``incoming``
    are the same edges sorted by ``to_qn``: each end is looked up where the files
    are sorted by it. With more keys than are looked up, all edges."""
    rows = rows_within(keys, SEEK_KEYS) if incoming is not None else None
    if incoming is None or rows is None:
        return seek(edges, ends, keys) if incoming is None else edges
    values = [r[0] for r in rows]
    if ends == ["from_qn"]:
        return edges.where(F.col("from_qn").isin(*values))
    into = incoming.where(F.col("to_qn").isin(*values))
    if ends == ["to_qn"]:
        return into
    return edges.where(F.col("from_qn").isin(*values)).unionByName(into.where(~F.coalesce(F.col("from_qn").isin(*values), F.lit(False))))
