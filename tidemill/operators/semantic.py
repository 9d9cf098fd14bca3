"""Passages, vectors, semantic search and zero-shot tags."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_schema

from tidemill.functions.text import NAME_LOC, TAG_LOC, count_letters, in_pool, trim_space
from tidemill.operators.components import small, written

PASSAGE_CHARS, MAX_PASSAGES, MIN_LETTERS, NAME_LETTERS = 200, 40, 12, 8
MIN_SCORE, SEM_FILES, NAME_WEIGHT, SEM_HITS = 0.35, 5, 0.75, 2
SURE, ALSO, MAX_TAGS, GAIN, TOP = 0.18, 0.08, 4, 100.0, 8
#: Rows of a block of vectors, and bytes of query vectors up to which they are broadcast.
BLOCK_ROWS, BROADCAST_BYTES = 1000, 32 << 20
SPANS = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("len", T.IntegerType())]))


#: The rest of a text if it is short; else up to PASSAGE_CHARS before the last blank beyond their middle; else just so many.
PIECE = re.compile(rf".{{1,{PASSAGE_CHARS}}}\Z|.{{{PASSAGE_CHARS // 2 + 1},{PASSAGE_CHARS}}}(?=[ \n])|.{{1,{PASSAGE_CHARS}}}", re.S)


def passage_spans(text: str) -> list[tuple[int, int]]:
    """Position and length of the pieces of a text with letters enough."""
    return [(m.start(), len(m[0])) for m in PIECE.finditer(text) if sum(map(str.isalpha, m[0])) >= MIN_LETTERS]


@pandas_udf(SPANS)
def split_passages(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"pos": p, "len": n} for p, n in passage_spans(t or "")])


def select_passages(files: DataFrame) -> DataFrame:
    """key, p, chunk, pos, len, text: the name if it has letters enough, then first passages of all chunks, then second ones."""
    names = files.where(count_letters(F.col("stem")) >= NAME_LETTERS).select("key", F.lit(-1).alias("round"), F.lit(-1).alias("chunk"), F.lit(0).alias("pos"), F.length("stem").alias("len"), F.col("stem").alias("text"))
    chunks = files.select("key", F.posexplode("chunks").alias("chunk", "c")).select("key", "chunk", F.col("c.text").alias("t"))
    spans = chunks.select("key", "chunk", "t", F.posexplode(split_passages("t")).alias("round", "s"))
    rows = names.unionByName(spans.select("key", "round", "chunk", "s.pos", "s.len", F.substring("t", F.col("s.pos") + 1, F.col("s.len")).alias("text")))
    rows = rows.withColumn("p", F.row_number().over(Window.partitionBy("key").orderBy("round", "chunk")) - 1)
    return rows.where(F.col("p") < MAX_PASSAGES).select("key", "p", "chunk", "pos", "len", "text")


def needs_embedding(error: Column, version: Column, current: int = 1) -> Column:
    return error.isNull() & ~version.eqNullSafe(F.lit(current))


def quantize_vectors(vec: Column) -> Column:
    return F.transform(vec, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x.cast("double") * 127 + 0.5))).cast("tinyint"))


#: Groups whose sums a task holds before it hands them on.
HELD_GROUPS = 10_000


def mean_pool(rows: DataFrame, group: str, vec: str) -> DataFrame:
    """group, vec: mean of the group's vectors (of one length; null ones are left out), scaled to length one (a zero mean stays).

    A task adds up its vectors by group and shuffles one row for each, so that a group may hold most rows.
    """
    own = to_arrow_schema(rows.select(group).schema).field(0)
    part = pa.schema([own, ("n", pa.int64()), ("s", pa.list_(pa.float64()))])
    kind = dict(rows.dtypes)[group]

    def given(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([list(held), [n for n, _ in held.values()], [s for _, s in held.values()]], part.types, strict=True)], schema=part)

    def add(held: dict, key, n: int, s: np.ndarray) -> None:
        m, t = held.get(key, (0, 0.0))
        held[key] = (m + n, t + s)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column(0).dictionary_encode()
            m = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            at = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
            names = [*codes.dictionary.to_pylist(), None]
            for k, n, s in zip(at[order][cuts].tolist(), np.diff(np.r_[cuts, len(at)]).tolist(), np.add.reduceat(m[order], cuts), strict=True):
                add(held, names[k], n, s)
            if len(held) >= HELD_GROUPS:
                yield given(held)
                held = {}
        if held:
            yield given(held)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}  # the last group may go on in the next batch
        done = pa.schema([own, ("vec", pa.list_(pa.float64()))])

        def out(keys: list) -> pa.RecordBatch:
            means = [held[k][1] / held[k][0] for k in keys]
            return pa.RecordBatch.from_arrays([pa.array(keys, own.type), pa.array([m / (np.linalg.norm(m) or 1.0) for m in means], done.types[1])], schema=done)

        for b in batches:
            for key, n, s in zip(*[c.to_pylist() for c in b.columns], strict=True):
                add(held, key, n, np.array(s))
            if len(keys := list(held)[:-1]):
                yield out(keys)
                held = {k: held[k] for k in list(held)[-1:]}
        if held:
            yield out(list(held))

    sums = rows.select(group, vec).where(F.col(vec).isNotNull()).mapInArrow(partial, f"`{group}` {kind}, n long, s array<double>")
    return sums.repartition(group).sortWithinPartitions(group).mapInArrow(merged, f"`{group}` {kind}, vec array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def packed(rows: DataFrame, ids: list[str], vec: str, size: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of up to `size` rows: an array of each id column and the vectors as one matrix of 32-bit floats."""
    kinds = dict(rows.dtypes)
    arrow = to_arrow_schema(rows.select(*ids).schema)
    schema = pa.schema([*[(f.name, pa.list_(f.type)) for f in arrow], ("m", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, size):
                part = b.slice(k, size)
                cols = [c.to_pylist() for c in part.columns]
                m = np.array(cols.pop(), np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip([*cols, m.tobytes()], schema.types, strict=True)], schema=schema)

    return rows.select(*ids, vec).where(F.col(vec).isNotNull()).mapInArrow(run, ", ".join([*[f"{c} array<{kinds[c]}>" for c in ids], "m binary"]))


def vector_scores(passages: DataFrame, query_vecs: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """qid, key, p, chunk, score at `least` or more; passages of names (chunk -1) weigh less.

    Both sides are packed in blocks, and a pair of blocks is one matrix product. The blocks of queries go to all tasks by a
    broadcast if they take BROADCAST_BYTES at most, else pairs of blocks are dealt out. Vectors must have one length.
    """
    blocks = written(packed(query_vecs, ["qid"], "vec"), "queries")
    total = blocks.agg(F.coalesce(F.sum(F.length("m")), F.lit(0))).first()[0]
    p = packed(passages, ["key", "p", "chunk"], "vec")
    pairs = p.crossJoin((F.broadcast(blocks) if total <= BROADCAST_BYTES else blocks).select("qid", F.col("m").alias("q")))
    kinds = {c: dict(df.dtypes)[c] for df in (query_vecs, passages) for c in df.columns}
    arrow = [to_arrow_schema(df.select(c).schema).field(0) for df, c in ((query_vecs, "qid"), (passages, "key"), (passages, "p"), (passages, "chunk"))]
    schema = pa.schema([*arrow, pa.field("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, ps, chunks, m, qids, q in zip(*[c.to_pylist() for c in b.columns], strict=True):
                x = np.frombuffer(m, np.float32).reshape(len(keys), -1).astype(np.float64)
                y = np.frombuffer(q, np.float32).reshape(len(qids), -1).astype(np.float64)
                score = y @ x.T / 127 * np.where(np.array(chunks) < 0, NAME_WEIGHT, 1.0)
                i, j = np.nonzero(score >= least)
                cols = [[qids[k] for k in i], [keys[k] for k in j], [ps[k] for k in j], [chunks[k] for k in j], score[i, j]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    return pairs.select("key", "p", "chunk", "m", "qid", "q").mapInArrow(run, f"qid {kinds['qid']}, key {kinds['key']}, p {kinds['p']}, chunk {kinds['chunk']}, score double")


def askable(queries: DataFrame) -> DataFrame:
    """Queries with two letters or more; others have no meaning to search for."""
    return queries.where(count_letters(F.col("query")) >= 2)


def current(files: DataFrame, version: int = 1) -> DataFrame:
    """Records without error whose vectors are of this version."""
    return files.where(F.col("error").isNull() & F.col("sem_version").eqNullSafe(F.lit(version)))


def semantic_search(passages: DataFrame, queries: DataFrame, skip: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """qid, key, score, hit_count, best passages (p in order) and rank of the best files per query, those in `skip` (qid, key) left out.

    `queries`: qid, vec and, if they are there, query (fewer than two letters find nothing), types and folder_id (with
    `files`: key, folder_id, ext, error, sem_version; records with stale vectors find nothing).
    """
    if "query" in queries.columns:
        queries = askable(queries)
    if files is not None:
        passages = passages.join(current(files).select("key"), "key", "left_semi")
    s = vector_scores(passages, queries)
    if files is not None:
        pool = s.join(files.select("key", "folder_id", "ext"), "key").alias("s").join(queries.select("qid", "types", F.col("folder_id").alias("wanted")).alias("q"), "qid")
        s = pool.where(in_pool(F.col("s.folder_id"), F.col("s.ext"), F.col("q.types"), F.col("q.wanted"))).select("qid", "key", "p", "chunk", "score")
    s = s.join(skip.select("qid", "key"), ["qid", "key"], "left_anti")
    best = s.withColumn("r", F.row_number().over(Window.partitionBy("qid", "key").orderBy(F.col("score").desc(), "p"))).where(F.col("r") <= SEM_HITS)
    files_ = s.groupBy("qid", "key").agg(F.max("score").alias("score"), F.count("*").alias("hit_count"))
    files_ = files_.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "key"))).where(F.col("rank") <= SEM_FILES)
    hits = best.groupBy("qid", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "p"))), lambda x: x["p"]).alias("hits"))
    return files_.join(hits, ["qid", "key"]).select("qid", "key", "score", "hit_count", "hits", "rank")


def semantic_snippets(found: DataFrame, passages: DataFrame, files: DataFrame) -> DataFrame:
    """qid, key, n, loc, chunk, pos, snippet of the shown passages. passages: key, p, chunk, pos, len; files with chunks and name."""
    shown = found.select("qid", "key", F.posexplode("hits").alias("n", "p")).join(passages.select("key", "p", "chunk", "pos", "len"), ["key", "p"])
    j = shown.join(files.select("key", "name", "chunks"), "key").withColumn("c", F.get("chunks", F.greatest("chunk", F.lit(0))))
    body = trim_space(F.replace(F.substring("c.text", F.col("pos") + 1, F.col("len")), F.lit("\n"), F.lit(" ")))
    cut = F.concat(F.when(F.col("pos") > 0, "…").otherwise(""), body, F.when(F.col("pos") + F.col("len") < F.length("c.text"), "…").otherwise(""))
    of_name = F.col("chunk") < 0
    return j.select("qid", "key", "n", F.when(of_name, NAME_LOC).otherwise(F.col("c.loc")).alias("loc"), F.when(~of_name, F.col("chunk")).alias("chunk"), F.when(~of_name, F.col("pos")).alias("pos"), F.when(of_name, F.col("name")).otherwise(cut).alias("snippet"))


def zero_shot_share(items: DataFrame, labels: DataFrame, top: int = TOP) -> DataFrame:
    """item, label_id, sim, share, rank: softmax over all labels of the cosines, the best `top`.

    A block of items meets blocks of labels in matrix products; the blocks of labels are broadcast if they take
    BROADCAST_BYTES at most. Where there are several, each gives an item's greatest cosine, the sum of its exponentials
    and its best labels, and these are put together.
    """
    kinds = {"item": dict(items.dtypes)["item"], "label_id": dict(labels.dtypes)["label_id"]}
    own = labels.coalesce(1) if labels.count() <= BLOCK_ROWS else labels
    blocks = written(packed(own, ["label_id"], "vec"), "labels")
    n, total = blocks.agg(F.count("*"), F.coalesce(F.sum(F.length("m")), F.lit(0))).first()
    pairs = packed(items, ["item"], "vec").crossJoin((F.broadcast(blocks) if total <= BROADCAST_BYTES else blocks).select("label_id", F.col("m").alias("l")))
    best = pa.list_(pa.struct([("o", pa.float64()), ("label_id", to_arrow_schema(labels.select("label_id").schema).field(0).type)]))
    schema = pa.schema([to_arrow_schema(items.select("item").schema).field(0), ("most", pa.float64()), ("total", pa.float64()), ("best", best)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for names, m, ids, l in zip(*[c.to_pylist() for c in b.columns], strict=True):
                x = np.frombuffer(m, np.float32).reshape(len(names), -1).astype(np.float64)
                y = np.frombuffer(l, np.float32).reshape(len(ids), -1).astype(np.float64)
                norm = np.linalg.norm(x, axis=1)
                sims = x @ y.T / 127 / np.where(norm > 0, norm, 1.0)[:, None]
                most = sims.max(1)
                rank = np.argsort(np.argsort(np.array(ids, object), kind="stable"), kind="stable")
                first = [np.lexsort((rank, -row))[:top] for row in sims]
                lists = [[{"o": -float(row[k]), "label_id": ids[k]} for k in at] for row, at in zip(sims, first, strict=True)]
                cols = [names, most, np.exp(GAIN * (sims - most[:, None])).sum(1), lists]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    v = pairs.select("item", "m", "label_id", "l").mapInArrow(run, f"item {kinds['item']}, most double, total double, best array<struct<o: double, label_id: {kinds['label_id']}>>")
    if n > 1:  # a row per item and block of labels
        v = v.groupBy("item").agg(F.max("most").alias("most"), F.collect_list(F.struct("most", "total")).alias("parts"), F.flatten(F.collect_list("best")).alias("best"))
        whole = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["total"] * F.exp(GAIN * (p["most"] - F.col("most"))))
        v = v.select("item", "most", whole.alias("total"), F.slice(F.array_sort("best"), 1, top).alias("best"))
    v = v.select("item", "most", "total", F.posexplode("best").alias("rank", "s")).withColumn("sim", -F.col("s.o"))
    return v.select("item", "s.label_id", "sim", (F.exp(GAIN * (F.col("sim") - F.col("most"))) / F.col("total")).alias("share"), (F.col("rank") + 1).alias("rank"))


def assign_tags(shares: DataFrame, labels: DataFrame) -> DataFrame:
    """item, tags: none unless the best label is sure; then up to MAX_TAGS labels, in both languages. At most TOP shares an item are read."""
    s = shares.where(F.col("share") >= ALSO).join(small(labels.select("label_id", "th", "en")), "label_id")
    kept = F.slice(F.array_sort(F.collect_list(F.struct("rank", "share", "th", "en"))), 1, MAX_TAGS)
    g = s.groupBy("item").agg(kept.alias("k"))
    text = F.concat(F.array_join(F.transform("k", lambda x: x["th"]), ", "), F.lit(" · "), F.array_join(F.transform("k", lambda x: x["en"]), ", "))
    return g.where(F.get("k", F.lit(0))["share"] >= SURE).select("item", text.alias("tags"))


def append_tag_chunk(chunks: Column, tags: Column) -> Column:
    return F.array_append(F.filter(chunks, lambda c: c["loc"] != TAG_LOC), F.struct(F.lit(TAG_LOC).alias("loc"), tags.alias("text")))
