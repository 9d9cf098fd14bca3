"""Keeping an index in step with a listing: full outer join on the key over metadata only.

`save_sync_state` stores the index's metadata in buckets by key, so that a later join moves the listing only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions.text import TAG_LOC, TAGGABLE, trim_space
from tidemill.operators.components import small, written
from tidemill.sources.corpus import MAX_SIZE

#: Folders up to which those that could not be read are broadcast.
BROADCAST_DIRS = 100_000
MAX_ERROR = 300
TOO_LARGE, UNREADABLE = "ไฟล์ใหญ่เกินกำหนด", "เปิดไฟล์ไม่ได้"
TEXT_IMAGE_CHARS = 80


def text_length(chunks: Column) -> Column:
    return F.aggregate(chunks, F.lit(0), lambda a, c: a + F.length(c["text"]))


def awaits_tags(needs: Column, ext: Column, error: Column, chunks: Column) -> Column:
    return F.coalesce(needs, ext.isin(*TAGGABLE) & error.isNull() & (text_length(chunks) < TEXT_IMAGE_CHARS))


def plan_sync(index: DataFrame, listing: DataFrame, ocr: bool = False, tags: bool = False) -> DataFrame:
    """key, action (skip, failed, todo, gone), known, same, text_good.

    index: key, mtime, size, v, error, needs_ocr, awaits_tags; listing: key, mtime, size, v, readable.
    """
    o, n = index.alias("o"), listing.alias("n")
    j = o.join(n, F.col("o.key") == F.col("n.key"), "full_outer")
    same = F.coalesce((F.col("o.mtime") == F.col("n.mtime")) & (F.col("o.size") == F.col("n.size")) & (F.col("o.v") == F.col("n.v")), F.lit(False))
    good = same & F.col("o.error").isNull() & ~(F.coalesce("o.needs_ocr", F.lit(False)) & F.lit(ocr))
    action = (
        F.when(F.col("n.key").isNull(), "gone")
        .when(~F.col("n.readable"), "failed")
        .when(good & ~(F.lit(tags) & F.coalesce("o.awaits_tags", F.lit(False))), "skip")
        .when(same & F.col("o.error").isNotNull() & (F.col("n.size") > MAX_SIZE), "failed")
        .otherwise("todo")
    )
    return j.select(F.coalesce("n.key", "o.key").alias("key"), action.alias("action"), F.col("o.key").isNotNull().alias("known"), same.alias("same"), good.alias("text_good"))


def folders_above(rel: Column) -> Column:
    """The folders that a path lies in, as prefixes: '' (the root), 'a/', 'a/b/' for 'a/b/c.txt'."""
    parts = F.split(rel, "/")
    inner = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    return F.concat(F.array(F.lit("")), F.when(F.size(parts) > 1, inner).otherwise(F.array().cast("array<string>")))


def save_sync_state(index: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """The metadata of an index (see `plan_sync`) as the table `name` below `path`, in buckets by key."""
    index.repartition(buckets, "key").write.mode("overwrite").bucketBy(buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
    return index.sparkSession.table(name)


def open_sync_state(spark: SparkSession, name: str, path: str, schema: str, buckets: int) -> DataFrame:
    """A stored state in a session that does not know its table yet."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def detect_removed(gone: DataFrame, failed_dirs: DataFrame) -> DataFrame:
    """key, folder_id, fate: 'kept' below a folder that could not be read, else 'removed'.

    failed_dirs: folder_id and prefix, which ends in '/' or is '' for the root. A file meets its own folders by equality,
    however many folders failed.
    """
    failed = written(failed_dirs.select("folder_id", "prefix").distinct(), "failed")
    above = gone.select("key", "folder_id", F.explode(folders_above(F.col("rel"))).alias("prefix"))
    kept = above.join(small(failed, BROADCAST_DIRS), ["folder_id", "prefix"]).groupBy("key").agg(F.lit(True).alias("kept"))
    return gone.join(kept, "key", "left").select("key", "folder_id", F.when(F.col("kept"), "kept").otherwise("removed").alias("fate"))


def apply_sync(todo: DataFrame, tags: bool = False) -> DataFrame:
    """key, known, error, chunks, needs_ocr, needs_tags, write, failed of todo rows.

    todo: key, ext, size, readable (its bytes could be read), known, same, text_good; the old record's old_error,
    old_chunks, old_needs_ocr; what reading gave: new_chunks, new_needs_ocr, new_error (null if it went well); and
    tag_text: the tags of an image, '' if it has none, null if there was no tagger.

    Too large files and those that cannot be read any more get an error and no chunks; a known one that cannot be read
    keeps its old record. The same error of an unchanged file is not written again.
    """
    large, lost = F.col("size") > MAX_SIZE, ~F.col("readable")
    stale = lost & F.col("known") & ~large
    error = F.when(large, TOO_LARGE).when(lost & ~F.col("known"), UNREADABLE).when(~lost & ~F.col("text_good"), F.substring("new_error", 1, MAX_ERROR))
    none = F.array().cast("array<struct<loc:string,text:string>>")
    untagged = F.filter("old_chunks", lambda c: c["loc"] != TAG_LOC)
    made = todo.withColumn("error", error)
    text = F.when(F.col("error").isNotNull(), none).when(F.col("text_good"), F.coalesce(untagged, none)).otherwise(F.coalesce("new_chunks", none))
    ocr = F.when(F.col("error").isNotNull(), F.lit(False)).when(F.col("text_good"), F.col("old_needs_ocr")).otherwise(F.col("new_needs_ocr"))
    made = made.withColumn("text", text).withColumn("needs_ocr", F.coalesce(ocr, F.lit(False)))
    open_ = F.col("error").isNull() & F.col("ext").isin(*TAGGABLE) & (text_length(F.col("text")) < TEXT_IMAGE_CHARS)
    tagged = open_ & F.lit(tags) & (F.col("tag_text") != "")
    chunks = F.when(F.coalesce(tagged, F.lit(False)), F.array_append("text", F.struct(F.lit(TAG_LOC).alias("loc"), F.col("tag_text").alias("text")))).otherwise(F.col("text"))
    again = F.col("same") & F.col("error").isNotNull() & F.col("error").eqNullSafe(F.col("old_error"))
    return made.select(
        "key",
        "known",
        F.when(stale, F.col("old_error")).otherwise(F.col("error")).alias("error"),
        F.when(stale, F.col("old_chunks")).otherwise(chunks).alias("chunks"),
        F.when(stale, F.coalesce("old_needs_ocr", F.lit(False))).otherwise(F.col("needs_ocr")).alias("needs_ocr"),
        (~stale & open_ & (F.lit(not tags) | F.col("tag_text").isNull())).alias("needs_tags"),
        (~stale & ~again).alias("write"),
        (stale | F.col("error").isNotNull()).alias("failed"),
    )


def sync_counts(plan: DataFrame) -> DataFrame:
    """added, updated, unchanged, removed, failed, kept per folder; plan has folder_id, action, known, write, failed, fate."""
    c = lambda cond, name: F.count_if(F.coalesce(cond, F.lit(False))).alias(name)
    a = F.col("action")
    return plan.groupBy("folder_id").agg(
        c((a == "todo") & ~F.col("known") & F.col("write"), "added"),
        c((a == "todo") & F.col("known") & F.col("write"), "updated"),
        c(a == "skip", "unchanged"),
        c(F.col("fate") == "removed", "removed"),
        c((a == "failed") | F.col("failed"), "failed"),
        c(F.col("fate") == "kept", "kept"),
    )


def corpus_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("folder_id").agg(F.count("*").alias("total"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if("needs_ocr").alias("needs_ocr"), F.count_if("needs_tags").alias("needs_tags"))


def rescan_folders(stats: DataFrame, ocr: bool = False, tags: bool = False) -> DataFrame:
    """Folders to visit again after text recognition or tagging was switched on: those with files that wait for it."""
    return stats.where((F.lit(ocr) & (F.col("needs_ocr") > 0)) | (F.lit(tags) & (F.col("needs_tags") > 0))).select("folder_id")


def ocr_backlog(pages: DataFrame, least: int = 10, cap: int = 200) -> DataFrame:
    """doc, page, r of the first `cap` pages of each file that hold fewer than `least` characters, blanks around them left out."""
    low = pages.where(F.length(trim_space(F.col("text"))) < least)
    return low.withColumn("r", F.row_number().over(Window.partitionBy("doc").orderBy("page"))).where(F.col("r") <= cap).select("doc", "page", "r")
