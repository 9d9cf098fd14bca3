"""Incremental indexing, standing queries and the vector backlog with Structured Streaming; all runs take what is there and stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemill.operators.components import small, written
from tidemill.operators.search import search_exact
from tidemill.operators.semantic import quantize_vectors, select_passages
from tidemill.sources.store import Store, latest

#: Batches after which a stream compacts what it has added.
COMPACT_EVERY = 20


def stream_index(spark: SparkSession, source: str, schema: StructType, path: str, checkpoint: str, files_per_batch: int = 1000, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Adds new record files under `source` to the store at `path`; the greatest mtime of a key wins.

    A batch writes its own records as a delta. Every `compact_every` batches, deltas go into the buckets that they touch.
    Records with a true `gone` (a further column of the schema, if wanted) remove their key. A repeated batch gives the same.
    """
    store = Store.create(spark, path, StructType([f for f in schema if f.name != "gone"]))

    def step(batch: DataFrame, n: int) -> None:
        store.add_delta(batch, n)
        if (n + 1) % compact_every == 0:
            store.compact()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return Store(spark, path).read()


QUERY_ID = ("qid", "query", "types", "folder_id", "near")
HIT = "key string, asked long, qid {qid}, hit_count long, batch long"


def asked_as(queries: DataFrame) -> DataFrame:
    """Prepared queries with `asked`, a number that changes when the query changes."""
    return queries.withColumn("asked", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in QUERY_ID if c != "types"], F.coalesce(F.array_join("types", "\0"), F.lit("\0"))))


def stream_search(files: DataFrame, queries: Callable[[], DataFrame], index: Callable[[], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Keeps the exact results of standing queries in step with a changing index; `read_hits` gives them.

    files: a stream of prepared records, new, changed or removed (`gone`, if there is such a column). `queries` and
    `index` are asked again for each batch: prepared queries, and all prepared records as they stand after it. A batch
    writes the hits of its own files, which replace all former hits of these files, and runs queries that are new or
    changed over the whole index. A repeated batch gives the same.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        current = written(asked_as(queries()), "queries")
        own = written(latest(batch if "gone" in batch.columns else batch.withColumn("gone", F.lit(False))), "batch")
        known = read_asked(spark, sink, n)
        fresh = current if known is None else current.join(small(written(known, "known")), "asked", "left_anti")
        old = current.join(fresh.select("asked"), "asked", "left_anti")
        hits = lambda df, q: search_exact(df, q).join(current.select("qid", "asked"), "qid").select("key", "asked", "qid", "hit_count")
        rows = hits(own.where("not gone").drop("gone"), old).unionByName(hits(index(), fresh))
        seen = own.select("key", F.lit(None).cast("long").alias("asked"), F.lit(None).cast(dict(current.dtypes)["qid"]).alias("qid"), F.lit(None).cast("long").alias("hit_count"))
        rows.unionByName(seen).write.mode("overwrite").parquet(f"{sink}/hits/batch={n}")
        fresh.select("asked").write.mode("overwrite").parquet(f"{sink}/asked/batch={n}")

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_asked(spark: SparkSession, sink: str, before: int) -> DataFrame | None:
    """Queries that batches before `before` have run over the whole index; None if no batch has come yet."""
    if before == 0:
        return None
    return spark.read.schema("asked long, batch long").parquet(f"{sink}/asked").where(F.col("batch") < before).select("asked").distinct()


def read_hits(spark: SparkSession, sink: str, queries: DataFrame) -> DataFrame:
    """qid, key, hit_count of the given queries: of each file, hits count from the last batch that had it on."""
    current = written(asked_as(queries), "queries")
    rows = spark.read.schema(HIT.format(qid=dict(current.dtypes)["qid"])).parquet(f"{sink}/hits")
    last = rows.where("asked is null").groupBy("key").agg(F.max("batch").alias("seen"))
    hits = rows.where("asked is not null").join(F.broadcast(current.select("asked")) if current.count() <= 100_000 else current.select("asked"), "asked", "left_semi")
    hits = hits.join(last, "key", "left").where(F.col("batch") >= F.coalesce("seen", F.lit(-1)))
    # a query that left and came back was run twice over the index
    return hits.groupBy("qid", "key").agg(F.max_by("hit_count", "batch").alias("hit_count"))


VECTORS = "key string, mtime long, v int, at array<struct<chunk: int, pos: int, len: int>>, vecs array<array<tinyint>>"


def read_vectors(spark: SparkSession, path: str, version: int) -> DataFrame:
    """key, mtime, v, at, vecs: the vectors of each file's last text, of the given version."""
    rows = spark.read.schema(f"{VECTORS}, part string").option("recursiveFileLookup", "false").parquet(path)
    return rows.where(F.col("v") == version).groupBy("key").agg(F.max_by(F.struct("key", "mtime", "v", "at", "vecs"), "mtime").alias("r")).select("r.*")


def embed_missing(files: DataFrame, path: str, part: str, embed: Callable[[DataFrame], DataFrame], version: int = 1) -> None:
    """Writes the vector records of prepared files that lack them to `part` of the store at `path`.

    What is stored already, for the same mtime and version, is not worked out again, whoever stored it. `embed` adds `vec` to
    passages (key, p, chunk, pos, len, text). Files without passages get a record without vectors, so that they are done.
    """
    spark = files.sparkSession
    spark.createDataFrame([], VECTORS).write.mode("ignore").parquet(f"{path}/part=none")
    done = spark.read.schema(VECTORS).parquet(path).where(F.col("v") == version).select("key", "mtime")
    todo = written(files.where("error is null").join(done, ["key", "mtime"], "left_anti"), "todo")
    rows = embed(select_passages(todo)).select("key", "p", F.struct(F.col("chunk").cast("int").alias("chunk"), F.col("pos").cast("int").alias("pos"), F.col("len").cast("int").alias("len")).alias("at"), quantize_vectors(F.col("vec")).alias("vec"))
    own = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("p", "at", "vec"))).alias("r"))  # MAX_PASSAGES at most
    made = todo.select("key", "mtime").join(own, "key", "left")
    field = lambda name: F.coalesce(F.transform("r", lambda x: x[name]), F.array())
    kind = dict(spark.createDataFrame([], VECTORS).dtypes)
    made = made.select("key", "mtime", F.lit(version).alias("v"), field("at").cast(kind["at"]).alias("at"), field("vec").cast(kind["vecs"]).alias("vecs"))
    made.write.mode("overwrite").parquet(f"{path}/part={part}")


def stream_embed_backlog(files: DataFrame, path: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame], run: str, version: int = 1) -> StreamingQuery:
    """Works off a backlog batch by batch into the vector store at `path`.

    `run` names this stream's parts of the store. A stream that was killed goes on behind its last whole batch; one with a
    new checkpoint reads its files again, but finds in the store what is done.
    """

    def step(batch: DataFrame, n: int) -> None:
        embed_missing(batch, path, f"{run}-{n}", embed, version)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
