"""Files and chunks: listing, reading, adapters and the keyed index on Parquet."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tidemill.functions.text import FILE_TYPES, OLD_TAG_LOCS, SKIP_DIRS, TAG_LOC, composed, context_window, ext_of, glyphs, join_thai_lines, let, normalize_text, once, stem_of, tidied, trim_space
from tidemill.operators.components import written

CHUNK_LINES = 50
#: Files above this many bytes are not read.
MAX_SIZE = 100 * 1024 * 1024
#: Rows that a sheet of a workbook can have (fixed value of the format).
SHEET_ROWS = 1 << 20
LINE_LOC = "บรรทัด "


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """rel, name, size, mtime of the eligible files below a folder; contents are not read."""
    return eligible(_found(spark, root).select("rel", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime")))


def _found(spark: SparkSession, root: str) -> DataFrame:
    """Every file below a folder, with `rel`, its path from there; columns that are not used are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.withColumn("rel", F.substring_index(F.col("path"), root.rstrip("/").split("://")[-1] + "/", -1))


def from_874(byte: int) -> str:
    """The character of a byte; of those without one, controls stay and others become the replacement character."""
    return bytes([byte]).decode("cp874", "ignore") or (chr(byte) if byte < 0xA0 else "\ufffd")


FROM_874 = {b: from_874(b) for b in range(0x80, 0x100)}


@pandas_udf(T.StringType())
def decode_874(content: pd.Series) -> pd.Series:
    return content.map(lambda b: bytes(b).decode("latin-1").translate(FROM_874), na_action="ignore")


def decoded(content: Column) -> Column:
    """Text of bytes: strict UTF-8, else windows-874."""
    utf8 = content.cast("string")
    return F.coalesce(F.when(F.is_valid_utf8(utf8), utf8), decode_874(F.when(~F.is_valid_utf8(utf8), content)))


def read_texts(spark: SparkSession, root: str, max_size: int = MAX_SIZE) -> DataFrame:
    """rel, name, size, mtime, chunks of the eligible plain text files below a folder; of files above `max_size` nothing is read."""
    files = _found(spark, root).where(F.col("length") <= max_size)
    files = eligible(files.select("rel", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), "content"))
    files = files.where(ext_of(F.col("name")).isin(*[e for e, kind in FILE_TYPES.items() if kind == FILE_TYPES[".txt"]]))
    return with_chunks(files.withColumn("text", decoded(F.col("content"))).drop("content"), "text").drop("text")


def spread(df: DataFrame) -> DataFrame:
    """Rows of an input with fewer splits than cores (one small file) dealt to all cores; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def eligible(listing: DataFrame, picked: bool = False) -> DataFrame:
    """Rows whose `rel` is to be indexed. In a flat picked list the folder test applies to every part, the file name included."""
    parts = F.split("rel", "/")
    name = F.element_at(parts, -1)
    tested = parts if picked else F.slice(parts, 1, F.size(parts) - 1)
    hidden = F.exists(tested, lambda p: p.isin(*SKIP_DIRS) | p.startswith("."))
    return listing.where(~hidden & ~name.startswith("~$") & ext_of(name).isin(*FILE_TYPES)).withColumn("name", name)


def split_top_folder(path: Column) -> list[Column]:
    """top, rel, name and key of a picked path."""
    parts = F.split(path, "/")
    rel = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    return [F.get(parts, F.lit(0)).alias("top"), rel.alias("rel"), F.element_at(parts, -1).alias("name"), F.concat_ws("/", F.get(parts, F.lit(0)), rel).alias("key")]


def text_chunks(text: Column, lines: int = CHUNK_LINES) -> Column:
    """array<struct<loc, text>> of every 50 lines of a composed text, tidied; empty chunks are dropped, their line numbers stay."""

    def chunks(rows: Column) -> Column:
        def chunk(k: Column) -> Column:
            return F.struct(F.concat(F.lit(LINE_LOC), (k + 1).cast("string")).alias("loc"), tidied(F.array_join(F.slice(rows, k + 1, lines), "\n")).alias("text"))

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(rows) - 1, F.lit(lines)), chunk), lambda c: c["text"] != "")

    return let(F.split(text, "\r\n|\r|\n"), chunks)


def with_chunks(df: DataFrame, text: str, lines: int = CHUNK_LINES) -> DataFrame:
    """`df` with `chunks` of its text column; the text is composed as a whole first, as no Python runs inside lambdas."""
    df = once(df, _text=glyphs(F.col(text))).withColumn("_text", composed(F.col("_text")))
    return once(df, chunks=text_chunks(F.col("_text"), lines)).drop("_text")


def prepare_search(files: DataFrame) -> DataFrame:
    """Adds stem, stem_low and name_low, and low to every chunk."""
    files = files.withColumn("stem", stem_of(F.col("name")))
    low = F.transform("chunks", lambda c: F.struct(c["loc"].alias("loc"), c["text"].alias("text"), F.lower(c["text"]).alias("low")))
    return files.withColumns({"stem_low": F.lower("stem"), "name_low": F.lower(normalize_text(F.col("name"))), "chunks": low})


def chunk_rows(files: DataFrame, *keep: str) -> DataFrame:
    """key, kept columns, chunk, loc, text, low: one row per chunk."""
    return files.select("key", *keep, F.posexplode("chunks").alias("chunk", "c")).select("key", *keep, "chunk", "c.loc", "c.text", "c.low")


def file_records(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, key, folder_id, rel, name, ext, size, mtime and kept columns of a file record for each document."""
    ext = F.create_map(*[F.lit(x) for x in ("en", ".txt", "fr", ".docx", "de", ".pdf", "es", ".xlsx")])
    lang = F.coalesce("lang", F.lit("und"))
    files = docs.select("doc_id", F.coalesce("source", F.lit("unknown")).alias("folder_id"), F.col("n_chars").alias("size"), lang.alias("lang"), F.coalesce(F.try_element_at(ext, F.col("lang")), F.lit("")).alias("ext"), *keep)
    files = files.withColumn("name", F.concat(F.lit("doc_"), F.col("doc_id"), "ext")).withColumn("rel", F.concat_ws("/", "lang", "name"))
    mtime = F.lit(1700000000000) + (F.col("doc_id") * 7919 % 1000) * 1000
    return files.select("doc_id", F.concat_ws("/", "folder_id", "rel").alias("key"), "folder_id", "rel", "name", "ext", "size", mtime.alias("mtime"), *keep)


def metadata_from_documents(docs: DataFrame) -> DataFrame:
    """File records with their error, without chunks: no text is read. A document without n_chars counts as unreadable."""
    return file_records(docs).withColumn("error", F.when(F.col("size").isNull(), "bad"))


def previews(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The columns of `wanted` with preview (text, cut_start, cut_end): the part of a chunk that a result shows.

    wanted: key, chunk, terms (lower case) and at: the preview starts there, or where it is null, before the earliest term.
    Missing files and chunks give null. files are prepared.
    """
    rows = wanted.join(files.select("key", "chunks"), "key", "left").withColumn("c", F.get("chunks", F.when(F.col("chunk") >= 0, F.col("chunk"))))
    return rows.select(*wanted.columns, context_window(F.col("c.text"), F.col("c.low"), F.col("terms"), F.col("at")).alias("preview"))


def corpus_from_documents(docs: DataFrame) -> DataFrame:
    """File records with chunks, in order of no kind; a document without a text counts as unreadable."""
    files = with_chunks(file_records(spread(docs), "text"), "text")
    return files.select("doc_id", "key", "folder_id", "rel", "name", "ext", "size", "mtime", F.when(F.col("text").isNull(), "bad").alias("error"), "chunks")


def cell_text(cell: Column, kind: str) -> Column:
    """A typed cell as text: times with the date from 1900 on, TRUE or FALSE, numbers as short as they can be; null and '' give null."""
    if kind.startswith(("timestamp", "date")):
        return F.when(F.year(cell) < 1900, F.date_format(cell, "HH:mm:ss")).otherwise(F.date_format(cell, "yyyy-MM-dd HH:mm:ss"))
    if kind == "boolean":
        return F.upper(cell.cast("string"))
    if kind in ("double", "float") or kind.startswith("decimal"):
        x = cell.cast("double")
        plain = F.regexp_replace(x.cast("string").try_cast("decimal(38,16)").cast("string"), r"\.?0+$", "")
        short = F.regexp_replace(F.regexp_replace(F.regexp_replace(x.cast("string"), r"\.0E", "E"), r"E(?=[0-9])", "e+"), "E-", "e-")
        return F.when(x == 0, "0").when((F.abs(x) >= 1e21) | (F.abs(x) < 1e-6), short).otherwise(plain)
    return F.nullif(cell.cast("string"), F.lit(""))


def rows_to_text(rows: DataFrame, sheet: Column, order: Column, cells: list[str], rows_per_chunk: int = SHEET_ROWS) -> DataFrame:
    """sheet, loc, block, text: non-empty cells of each row joined by ' | ', blank rows dropped, rows joined in order.

    A sheet is one text. Tables that are no sheets may be longer than a sheet can be; they become a text for every SHEET_ROWS rows.
    Rows are numbered by counts of sorted ranges.
    """
    kinds = dict(rows.dtypes)
    line = F.concat_ws(" | ", *[cell_text(F.col(c), kinds[c]) for c in cells])
    made = rows.select(sheet.alias("sheet"), order.alias("ord"), line.alias("line")).where("line <> ''")
    made = written(made.repartitionByRange("sheet", "ord").withColumn("range", F.spark_partition_id()), "rows")
    before = Window.partitionBy("sheet").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = made.groupBy("sheet", "range").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    at = F.col("start") + F.row_number().over(Window.partitionBy("sheet", "range").orderBy("ord", "line")) - 1
    made = made.join(ranges, ["sheet", "range"]).withColumn("at", at).withColumn("block", F.floor(F.col("at") / rows_per_chunk).cast("long"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    return made.groupBy("sheet", "block").agg(text.alias("text")).select("sheet", F.concat(F.lit("ชีต "), "sheet").alias("loc"), "block", "text")


def assemble_blocks(blocks: DataFrame) -> DataFrame:
    """doc, page, text: the blocks of a page in order, each trimmed and its Thai lines joined."""
    made = blocks.withColumn("text", join_thai_lines(trim_space(F.col("text"))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n")
    return made.groupBy("doc", "page").agg(text.alias("text"))


def migrate_tag_loc(chunks: Column) -> Column:
    return F.transform(chunks, lambda c: c.withField("loc", F.when(c["loc"].isin(*OLD_TAG_LOCS), TAG_LOC).otherwise(c["loc"])))


def save_index(files: DataFrame, path: str) -> None:
    files.write.mode("overwrite").partitionBy("folder_id").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return prepare_search(spark.read.parquet(path).withColumn("chunks", migrate_tag_loc(F.col("chunks"))))


def latest(records: DataFrame, key: str = "key", by: str = "mtime") -> DataFrame:
    """One row per key: the one with the greatest `by` (ties by the whole row)."""
    return records.groupBy(key).agg(F.max_by(F.struct(*records.columns), F.struct(by, *[c for c in records.columns if c not in (by, "chunks")])).alias("r")).select("r.*")


def upsert_index(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def remove_keys(files: DataFrame, keys: DataFrame) -> DataFrame:
    return files.join(keys.select("key"), "key", "left_anti")


def remove_folder(files: DataFrame, folder_id: str) -> DataFrame:
    return files.where(F.col("folder_id") != folder_id)
