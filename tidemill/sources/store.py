"""A keyed index of file records on disk that is changed in place of being rewritten.

Records (key, folder_id, mtime and more) lie in buckets: a folder has a power of two of them, so many that one holds about
`target_rows` records, and a key falls into one by its hash. A manifest names the directory of every bucket. A change
writes the buckets that it touches anew, into directories of their own, and then a manifest of the next number, which
counts from the moment that it is renamed to its place; a rename never replaces a manifest, so that of two writers one
fails. Until then, and after a crash, readers find the version before, whose files nobody has touched.

A stream adds deltas: the last records of a batch, as large as the batch. Reading merges them with the buckets, where only
records with changed keys move; `compact` puts them into the buckets. `vacuum` removes what no kept version names.

Buckets are as many as directories that Spark lists anyway; no more than their names reaches the driver. A folder without
any record is in no manifest. Records need a folder_id.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.components import small, written

TARGET_ROWS = 200_000
MANIFEST = "folder_id string, bucket int, dir string, rows long, buckets int, applied long, schema string, target long"
Bucket = tuple[str, int]


@dataclass
class State:
    """What a manifest says: directory and rows of each bucket, buckets of each folder, and the last delta that is inside."""

    version: int
    places: dict[Bucket, tuple[str, int]]
    buckets: dict[str, int]
    applied: int
    schema: T.StructType
    target: int


def latest(records: DataFrame) -> DataFrame:
    """One record per key: the one with the greatest mtime (ties by the other columns)."""
    plain = [c for c, kind in records.dtypes if c != "mtime" and not kind.startswith(("map", "array<struct"))]
    return records.groupBy("key").agg(F.max_by(F.struct(*records.columns), F.struct("mtime", *plain)).alias("r")).select("r.*")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.hadoop = jvm.org.apache.hadoop.fs
        self.files = self.hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- versions

    @staticmethod
    def create(spark: SparkSession, path: str, schema: T.StructType, target_rows: int = TARGET_ROWS) -> Store:
        """An empty store, or the one that is there."""
        store = Store(spark, path)
        if not store.versions():
            store.commit(State(0, {}, {}, -1, schema, target_rows))
        return store

    def names(self, folder: str) -> list[str]:
        at = self.hadoop.Path(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self.files.listStatus(at)) if self.files.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[2:]) for n in self.names("manifests") if n.startswith("v=")]

    def state(self, version: int | None = None) -> State:
        version = self.versions()[-1] if version is None else version
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/v={version:09}").collect()  # a row per bucket
        head = next(r for r in rows if r["folder_id"] is None)
        rows = [r for r in rows if r["folder_id"] is not None]
        return State(version, {(r["folder_id"], r["bucket"]): (r["dir"], r["rows"]) for r in rows}, {r["folder_id"]: r["buckets"] for r in rows}, head["applied"], T.StructType.fromJson(json.loads(head["schema"])), head["target"])

    def commit(self, state: State) -> None:
        """The manifest, written aside and renamed to its place."""
        rows = [(None, None, None, None, None, state.applied, state.schema.json(), state.target)]
        rows += [(f, b, at, n, state.buckets[f], None, None, None) for (f, b), (at, n) in state.places.items()]
        aside = f"{self.path}/manifests/_new-{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(aside)
        self.swap(aside, f"{self.path}/manifests/v={state.version:09}")

    def swap(self, aside: str, place: str) -> None:
        source, target = self.hadoop.Path(aside), self.hadoop.Path(place)
        context = self.hadoop.FileContext.getFileContext(self.files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(source, target, self.spark.sparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0))

    # -- reading

    def rows_of(self, state: State, buckets: list[Bucket]) -> DataFrame:
        """Records of some buckets; other directories are not read."""
        if not buckets:
            return self.spark.createDataFrame([], state.schema)
        kind = T.StructType([*state.schema.fields, T.StructField("g", T.StringType()), T.StructField("bucket", T.IntegerType())])
        rows = self.spark.read.schema(kind).parquet(f"{self.path}/data")
        wanted = [f"{state.places[b][0].split('/')[0][2:]}/{b[1]}/{b[0]}" for b in buckets]
        return rows.where(F.concat_ws("/", "g", F.col("bucket").cast("string"), "folder_id").isin(wanted)).select(state.schema.fieldNames())

    def read(self, version: int | None = None) -> DataFrame:
        """The records of a version; of the last one with the deltas that came since."""
        state = self.state(version)
        base = self.rows_of(state, list(state.places))
        changes = self.deltas(state) if version is None else None
        if changes is None:
            return base
        changes = written(latest(changes), "changes")
        keys = small(changes.select("key"))
        same = base.join(keys, "key", "left_anti")
        both = base.join(keys, "key", "left_semi").withColumn("gone", F.lit(False)).unionByName(changes)
        return same.unionByName(latest(both).where("not gone").drop("gone"))

    def deltas(self, state: State) -> DataFrame | None:
        """Records, with `gone`, of the deltas that are not in the buckets yet; None without any."""
        if not any(int(n[6:]) > state.applied for n in self.names("deltas") if n.startswith("batch=")):
            return None
        kind = T.StructType([*state.schema.fields, T.StructField("gone", T.BooleanType()), T.StructField("batch", T.LongType())])
        return self.spark.read.schema(kind).parquet(f"{self.path}/deltas").where(F.col("batch") > state.applied).drop("batch")

    # -- changing

    def upsert(self, records: DataFrame) -> int:
        """New versions of records replace old ones; of several of one key, the latest counts. Returns the version."""
        return self.change(written(latest(records), "changes"), lambda old, new: old.join(new.select("key"), "key", "left_anti").unionByName(new.select(old.columns)))

    def remove(self, keys: DataFrame) -> int:
        """Records of the given (key, folder_id) go."""
        return self.change(written(keys.select("key", "folder_id").distinct(), "changes"), lambda old, gone: old.join(gone.select("key"), "key", "left_anti"), grow=False)

    def remove_folder(self, folder_id: str) -> int:
        """A change of the manifest alone."""
        state = self.state()
        state.places = {b: at for b, at in state.places.items() if b[0] != folder_id}
        state.version += 1
        self.commit(state)
        return state.version

    def compact(self) -> int:
        """Puts the deltas into the buckets."""
        state = self.state()
        changes = self.deltas(state)
        if changes is None:
            return state.version
        last = max(int(n[6:]) for n in self.names("deltas") if n.startswith("batch="))

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            return latest(old.withColumn("gone", F.lit(False)).unionByName(new)).where("not gone").drop("gone")

        return self.change(written(latest(changes), "changes"), merged, applied=last)

    def change(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], grow: bool = True, applied: int | None = None) -> int:
        """Merges stored changes into the buckets that they touch."""
        state = self.state()
        new_rows = {r["folder_id"]: r["n"] for r in changes.groupBy("folder_id").agg(F.count("*").alias("n")).collect()}  # a row per folder
        held: dict[str, int] = {}
        for (f, _), (_, n) in state.places.items():
            held[f] = held.get(f, 0) + n
        before, moved = dict(state.buckets), set()
        for f, n in new_rows.items():
            most = -(-(held.get(f, 0) + n) // state.target)
            wanted = 1 << (most - 1).bit_length() if grow else 1
            if wanted > state.buckets.get(f, 0):
                state.buckets[f] = wanted
                moved |= {f} & set(before)  # its keys are dealt anew
        counts = self.spark.createDataFrame([(f, state.buckets[f]) for f in new_rows], "folder_id string, buckets int")

        def placed(rows: DataFrame) -> DataFrame:
            return rows.join(F.broadcast(counts), "folder_id").withColumn("bucket", F.pmod(F.xxhash64("key"), F.col("buckets")).cast("int")).drop("buckets")

        touched = {(r["folder_id"], r["bucket"]) for r in placed(changes.select("key", "folder_id")).select("folder_id", "bucket").distinct().collect()}  # buckets at most
        touched |= {b for b in state.places if b[0] in moved}
        out = placed(merge(self.rows_of(state, [b for b in state.places if b in touched]), changes))
        g = uuid.uuid4().hex[:12]
        out.repartition("folder_id", "bucket").write.partitionBy("folder_id", "bucket").parquet(f"{self.path}/data/g={g}")
        state.places = {b: at for b, at in state.places.items() if b not in touched} | self.counted(g, state.schema)
        state.buckets = {f: state.buckets[f] for f, _ in state.places}
        state.version += 1
        state.applied = state.applied if applied is None else applied
        self.commit(state)
        return state.version

    def counted(self, g: str, schema: T.StructType) -> dict[Bucket, tuple[str, int]]:
        kind = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
        rows = self.spark.read.schema(kind).parquet(f"{self.path}/data/g={g}")
        rows = rows.groupBy("folder_id", "bucket").agg(F.count("*").alias("n"), F.min("_metadata.file_path").alias("at"))
        return {(r["folder_id"], r["bucket"]): (f"g={g}/" + "/".join(unquote(r["at"]).split("/")[-3:-1]), r["n"]) for r in rows.collect()}  # a row per bucket

    def add_delta(self, records: DataFrame, batch: int) -> None:
        """The records of batch number `batch` (with `gone` true for those that are removed); written again, it is the same delta."""
        state = self.state()
        if batch > state.applied:
            records = records if "gone" in records.columns else records.withColumn("gone", F.lit(False))
            latest(records.select(*state.schema.fieldNames(), F.coalesce("gone", F.lit(False)).alias("gone"))).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")

    def vacuum(self, keep: int = 1, grace: float = 86_400) -> int:
        """Removes versions but the last `keep`, and directories that no kept one names, unless they are younger than `grace` seconds, as
        someone may be writing them. Returns how many directories went."""
        versions = self.versions()
        kept = [self.state(v) for v in versions[-keep:]]
        named = {at for s in kept for at, _ in s.places.values()}
        until = (time.time() - grace) * 1000
        gone = [f"manifests/v={v:09}" for v in versions[:-keep]]
        gone += [f"deltas/{n}" for n in self.names("deltas") if n.startswith("batch=") and int(n[6:]) <= min(s.applied for s in kept)]
        for g in self.names("data"):
            below = [f"{g}/{f}/{b}" for f in self.names(f"data/{g}") if f.startswith("folder_id=") for b in self.names(f"data/{g}/{f}") if b.startswith("bucket=")]
            if g.startswith("g=") and self.files.getFileStatus(self.hadoop.Path(f"{self.path}/data/{g}")).getModificationTime() <= until:
                gone += [f"data/{x}" for x in below if x not in named] if named & set(below) else [f"data/{g}"]
        for x in gone:
            self.files.delete(self.hadoop.Path(f"{self.path}/{x}"), True)
        return len(gone)
