"""What several corpus operators share: cutting lineage, global order, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.ship import shipped

#: White space as the word and line contracts count it: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Session settings that a job of this package runs under, unless the session sets its own: shuffle files go once the
#: query that wrote them has ended, and an Arrow batch of long texts has so many bytes at most.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def tuned(spark: SparkSession) -> SparkSession:
    """The session with SETTINGS where it has none of its own, and this package on its workers; the results returned to the caller run under them too."""
    shipped(spark)
    for name, value in SETTINGS.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    return spark


def give_back() -> None:
    """Hand memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def trimmed(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches that at its end gives freed memory back to the system: its worker lives on, idle, beside those of later stages."""

    @wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where it is unset and Spark runs in this process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; for small tables and loops."""
    shared_dir(tuned(df.sparkSession))
    return df.checkpoint(eager=True)


class Scratch:
    """Tables between the jobs of one operator; `drop` removes those that no later job reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = tuned(spark), {}

    def stored(self, df: DataFrame, compression: str = "snappy") -> DataFrame:
        path = f"{shared_dir(self.spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
        df.write.parquet(path, compression=compression)
        found = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(found)] = found, path
        return found

    def drop(self, *tables: DataFrame) -> None:
        """Remove the files of tables; whatever was made of them must have been stored before."""
        for _, path in [self.paths.pop(id(t)) for t in tables]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop_all(self, *but: DataFrame) -> None:
        kept = {id(t) for t in but}
        self.drop(*[t for k, (t, _) in list(self.paths.items()) if k not in kept])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A Scratch whose tables all go at the end, also after an error."""
    own = Scratch(spark)
    try:
        yield own
    finally:
        own.drop_all()


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: compressed, and with a known size."""
    return Scratch(df.sparkSession).stored(df, compression)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone; plain lower() does that where the text is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def indexed(df: DataFrame, *order: Column) -> DataFrame:
    """df with `_rank`, the 0-based place of each row in a global order, without one task that sees all rows.

    Rows are range-partitioned and sorted; the row counts of the partitions (one row each) give the offsets.
    """
    own = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    own = cut(own.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"))
    sizes = own.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row for each partition of the range exchange: as many as there are shuffle partitions at most
    offsets = sizes.alias("a").join(sizes.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy("a._part").agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    return own.join(F.broadcast(offsets), "_part").withColumn("_rank", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is the smallest node reachable.

    Alternating large-star and small-star rounds: each round is a grouped minimum (combined before the
    shuffle) and a join, so a node with a third of all edges is only a skewed join key, which adaptive
    execution splits. Self-loops are allowed and keep single nodes. Empty edges give no rows.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    alone = now.where("a = b").select("a")
    now = now.where("a <> b")
    before = None
    for _ in range(max_rounds):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = cut(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components did not settle")
    nodes = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(roots).unionByName(alone.select(F.col("a").alias("node"), F.col("a").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
