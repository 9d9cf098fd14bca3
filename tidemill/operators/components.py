"""Connected components of an edge table, and tables that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: The temporary folder of each application in one JVM.
_OWN: dict[str, str] = {}

#: Edges that one task takes together; fewer are finished by one task, more by rounds of joins.
TASK_EDGES = 500_000

#: Bytes of rows that a Python worker gets at a time, and Spark's setting for it with its default.
BATCH_BYTES = 2 << 20
BATCH_LIMIT, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def lean(spark: SparkSession) -> SparkSession:
    """The session, whose Python workers get BATCH_BYTES at a time from now on, as rows carry whole texts; another setting of the user's stays.

    Spark's own limit counts rows (10,000), so that a worker's memory grows with the texts and with the size of a task.
    """
    if spark.conf.get(BATCH_LIMIT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_LIMIT, BATCH_BYTES)
    return spark


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share.

    Only a session in one JVM may do without that setting; it gets a temporary folder.
    """
    base = lean(spark).conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="spark-")
        base = _OWN[app]
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df` written to the shared folder and read again, which ends its lineage safely."""
    path = folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of numbers or short keys up to which a stored table is broadcast.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """A stored table, marked for a broadcast if it is counted to have `most` rows (of numbers or short keys) or fewer."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


def contracted(edges: DataFrame, most: int = TASK_EDGES) -> DataFrame:
    """node, component: each task's edges (two columns) as stars around the smallest node, a root pointing to itself.

    A task holds `most` nodes at a time. Nodes that several tasks saw have several rows.
    """
    (a, kind), (b, _) = edges.dtypes
    arrow = to_arrow_type(edges.schema[a].dataType)
    schema = pa.schema([("node", arrow), ("component", arrow)])

    def stars(parent: dict) -> pa.RecordBatch:
        roots = [find(parent, n) for n in parent]
        return pa.RecordBatch.from_arrays([pa.array(list(parent), arrow), pa.array(roots, arrow)], schema=schema)

    def find(parent: dict, n):
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        for rows in batches:
            for x, y in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                parent.setdefault(x, x)
                parent.setdefault(y, y)
                p, q = find(parent, x), find(parent, y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
            if len(parent) >= most:
                yield stars(parent)
                parent = {}
        if parent:
            yield stars(parent)

    return edges.mapInArrow(run, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """node, component (its smallest node) for every node of an edge; edges may repeat, loop or stand in either order.

    Tasks turn their edges into stars. What fits one task is finished there; else each round sends every node to the
    smallest of its neighbours and itself, follows that map twice more, and contracts the edges, so that chains
    shrink by a constant factor a round. Nulls are left out.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    first = written(contracted(edges, task_edges), "stars")
    maps, star = [], first
    for _ in range(max_rounds):
        if star.count() <= task_edges:
            maps.append(written(contracted(star.coalesce(1), 2 * task_edges), "stars"))
            return composed(first, maps)
        star = star.where("node <> component")
        both = star.select(F.explode(F.array(F.struct(F.col("node").alias("x"), F.col("component").alias("y")), F.struct(F.col("component").alias("x"), F.col("node").alias("y")))).alias("e")).select("e.x", "e.y")
        to = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("y"))
        for _ in range(2):
            to = to.join(to.select(F.col("x").alias("y"), F.col("y").alias("z")), "y").select("x", F.col("z").alias("y"))
        to = written(to, "steps")
        maps.append(to.select(F.col("x").alias("node"), F.col("y").alias("component")))
        for end in ("node", "component"):
            star = star.join(to, F.col(end) == F.col("x")).withColumn(end, F.col("y")).drop("x", "y")
        star = written(contracted(star.where("node <> component"), task_edges), "stars")
    raise RuntimeError(f"components did not converge in {max_rounds} rounds")


def composed(first: DataFrame, maps: list[DataFrame]) -> DataFrame:
    """Every node of `first` sent through all maps; a map leaves a node that it lacks where it is."""
    if len(maps) == 1:
        return maps[0]
    out = first.select(F.explode(F.array("node", "component")).alias("node")).distinct().withColumn("component", F.col("node"))
    for m in maps:
        m = m.select(F.col("node").alias("x"), F.col("component").alias("y"))
        out = out.join(m, F.col("component") == F.col("x"), "left").select("node", F.coalesce("y", "component").alias("component"))
    return out
