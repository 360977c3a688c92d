"""What the text operators share: the shared folder, written tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where both are unset, a local session gets a folder of its own; on a cluster that raises, because
    what an executor writes to its own disk nobody else can read.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
        base = spark.sparkContext.getCheckpointDir()
    return base


#: Paths of the tables that this driver has written and not deleted, in order.
WRITTEN: list[str] = []


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, arrow_rows: int = 1000) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    That cuts the lineage, survives lost executors and lets later reads prune columns. While it is
    written, batches of at most arrow_rows rows go to Python: rows are whole texts, and a batch of them is
    held by the JVM and by Python at once. The session's own setting is put back.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(min(arrow_rows, int(before)) if int(before) > 0 else arrow_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(spark: SparkSession, *tables: DataFrame | str | None) -> None:
    """Delete tables that materialize wrote (frames or paths), once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    for x in tables:
        path = x if isinstance(x, str) else getattr(x, "written_to", None)
        if path in WRITTEN:
            WRITTEN.remove(path)
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Label every node of an undirected graph with the smallest node it reaches.

    edges: two columns (a, b) of one orderable type; loops and repeats are harmless, rows with a null
    are dropped. Returns (node, component) for every node in a row of edges. Alternates large-star
    and small-star steps, each a grouped minimum and a join, so no node's neighbours ever meet in
    one task as a list. Raises if it hasn't converged after most_rounds (each at least halves the depth).
    """
    a, b = edges.columns
    nodes = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    spark, now = edges.sparkSession, materialize(nodes.distinct())
    for _ in range(most_rounds):
        if _is_star_forest(now):
            apart = now.where("u <> v")
            return apart.union(now.select("v", "v").distinct()).toDF("node", "component")
        both = now.where("u <> v").union(now.where("u <> v").select("v", "u"))
        # written first, so that the join below deals both sides anew and a hub's rows can be split
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # large star: neighbours above the node point to the least of its neighbourhood
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.union(now.where("u = v")).distinct()
        # small star: the node and its neighbours below point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        then = materialize(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct())
        discard(spark, now, low)
        now = then
    raise RuntimeError(f"components did not converge in {most_rounds} rounds")


def _is_star_forest(now: DataFrame) -> bool:
    """Whether every node that points to a lesser one points to one only, and to one that points to none."""
    apart = now.where("u <> v")
    ends = apart.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(apart.select("v", F.lit(0), F.lit(1)))
    found = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return found.where((F.col("out") > 1) | (F.col("out") + F.col("into") > 1)).isEmpty()
