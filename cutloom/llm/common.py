"""What the operators share: tables, the shared folder, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its name as it stands, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder from ``spark.checkpoint.dir``; only a local session gets a new one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``mapInArrow`` for columns of any names, which by itself takes none with dots."""
    names = df.columns
    safe = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema)])

    def renamed(batches):
        for out in run(pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches):
            yield pa.RecordBatch.from_arrays(out.columns, names=safe.names)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, safe).toDF(*schema.names)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in parts of bounded size."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage is cut, and lost executors don't recompute it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(table: DataFrame) -> None:
    """Deletes a table of :func:`written` that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def salted(rows: DataFrame, names: DataFrame, key: str, parts: int = 16) -> DataFrame:
    """``rows`` joined with ``names``, which has one row per key; a key's rows are dealt to ``parts`` groups.

    Spark's estimate doesn't see that ``names`` become ``parts`` times as many
    and would broadcast them through the driver, so it is asked to merge.
    """
    salt = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)))
    return dealt.join(names.withColumn("_salt", salt).hint("merge"), [key, "_salt"]).drop("_salt")


def _edge_print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v), component = smallest node reachable.

    Alternating large-star and small-star rounds: each is one minimum per node
    (combined before the shuffle) and one join back, so a node with very many
    neighbours never gathers them in one task.  Every round is a written table;
    the number of rounds grows with the logarithm of the longest path.
    Nodes without an edge to another node don't appear.
    """
    e = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    )
    before = _edge_print(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        old, e = e, written(
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("x"))
            .select("x.u", F.col("x.m").alias("v"))
            .filter("u > v")
            .distinct()
        )
        dropped(old)
        after = _edge_print(e)
        if after == before:
            break
        before = after
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
