"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is WINDOW consecutive words of an item, or the whole of a shorter item. As a record of the join it is the set
of its SHINGLE-word shingles. A document contains a window only if it has all of them, so that of a window's shingles,
in order of rarity, the first one is the necessary prefix:

1. Rarity: how often each item shingle stands in all documents, counted per task, then summed. A window with a shingle
   that no document has is in none and goes.
2. Documents are read a second time for the rarest shingle of each window that is left. A document is one row, which
   carries only the places around such shingles.
3. These places meet the windows by their shingle. The place of the shingle in the window gives where the window would
   begin; it must begin and end inside the document (positional and length bounds), and its words must be the window's.

Rows are filtered before the join by a bitmap of the shingles (BITS bits at most); a false positive finds no partner.
The windows are broadcast if they are few by count and size, else joined by a shuffle. Documents with the same windows
share the list of their items, so that a passage in many documents and many items is no product of both.

A word is a run of ASCII letters, digits and characters beyond ASCII; A-Z count as a-z. Null, empty and wordless texts
have no words and are not contaminated; such items have no windows. Texts may be of any length. Repeated rows, null
doc_ids and clashing further columns change nothing: each row is judged for itself. Items of one item_id are one item;
a null item_id counts as the empty one. Empty tables give no rows, or rows without hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import batch, columns, joined_sha256, mix, small_batches, span_hashes, stored, table, word_spans
from tidemill.llm.signature_tree import blocks_of

WINDOW, SHINGLE = 10, 4
#: Bits of the filter at most.
BITS = 1 << 26
#: Windows, and characters of theirs, up to which they are broadcast.
BROADCAST_WINDOWS, BROADCAST_CHARS = 200_000, 32 << 20
#: Counted shingles that a task holds before it hands them on.
HELD = 500_000

#: Bytes between words: ASCII but digits and small letters.
GAPS = np.arange(256) < 128
GAPS[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = False

Words = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def shingles_at(spans: Words, widths: list[int]) -> dict[int, np.ndarray]:
    """width -> hash of the shingle that starts at each word of many texts; 0 where the text ends before the shingle."""
    data, starts, sizes, n = spans
    words = span_hashes(data, starts, sizes)
    left = np.repeat(np.cumsum(n), n) - np.arange(len(words))
    out, h = {}, words
    for w in range(1, max(widths, default=0) + 1):
        if w > 1:
            h = np.zeros_like(words) if len(words) < w else np.r_[mix(h[: len(words) - w + 1], words[w - 1 :]), np.zeros(w - 1, np.uint64)]
        if w in widths:
            out[w] = np.where(left >= w, mix(h, np.uint64(w)) | np.uint64(1), np.uint64(0))
    return out


def item_windows(items: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """windows (w, text, size, shingles) and members (w, item) of all items; equal windows are one."""
    schema = pa.schema([("text", pa.string()), ("size", pa.int32()), ("item", pa.string()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in columns(batches):
            for i, text in zip(ids, texts, strict=True):
                data, starts, sizes, _ = spans = word_spans([text], GAPS)
                size = min(window, len(starts))
                if not size:
                    continue
                raw = data.tobytes()
                words = [raw[a : a + k].decode("utf-8", "surrogatepass") for a, k in zip(starts, sizes, strict=True)]
                width = min(shingle, size)
                h = shingles_at(spans, [width])[width].view(np.int64)
                rows = [(" ".join(words[k : k + size]), size, i or "", h[k : k + size - width + 1]) for k in range(len(words) - size + 1)]
                for k in range(0, len(rows), 10_000):
                    yield batch(schema, *zip(*rows[k : k + 10_000], strict=True))

    rows = stored(items.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "text string, size int, item string, shingles array<long>"), "item_windows")
    windows = rows.groupBy("text").agg(F.min("size").alias("size"), F.min("shingles").alias("shingles"))
    windows = stored(windows.withColumn("w", F.monotonically_increasing_id()), "windows")
    return windows, rows.select("text", "item").distinct().join(windows.select("text", "w"), "text").select("w", "item")


def bitmap(shingles: DataFrame) -> np.ndarray:
    """A set of 64-bit numbers as bits of their low ends, in words of 64; of a size bounded by BITS."""
    size = min(BITS, max(1 << 16, 1 << (64 * shingles.count()).bit_length()))
    slot = F.col("shingle").bitwiseAND(F.lit(size - 1))
    rows = shingles.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shingle & {size - 1} & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).collect()
    out = np.zeros(size >> 6, np.uint64)
    out[[r["at"] for r in rows]] = np.array([r["bits"] for r in rows], np.int64).view(np.uint64)
    return out


def among(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = h & np.uint64(64 * len(bits) - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool) & (h != 0)


def shingle_counts(docs: DataFrame, bits: np.ndarray, widths: list[int]) -> DataFrame:
    """shingle, n: places of each shingle of the filter in all documents."""
    schema = pa.schema([("shingle", pa.int64()), ("n", pa.int64())])

    def summed(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return h, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for (texts,) in columns(batches):
            for part in blocks_of(texts):
                found = [np.zeros(0, np.uint64), *[h[among(h, bits)] for h in shingles_at(word_spans(texts[part], GAPS), widths).values()]]
                parts.append(np.unique(np.concatenate(found), return_counts=True))
                held += len(parts[-1][0])
            if held >= HELD:
                parts = [summed(parts)]
                held = len(parts[0][0])
                if held >= HELD // 2:
                    yield batch(schema, parts[0][0].view(np.int64), parts[0][1])
                    parts, held = [], 0
        if held:
            h, n = summed(parts)
            yield batch(schema, h.view(np.int64), n)

    return docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def marked(docs: DataFrame, bits: np.ndarray, widths: list[int], reach: int) -> DataFrame:
    """doc_id, n_words and segs of every document: words within `reach` of shingles of the filter (start, words, hits: pos, shingle)."""
    hit = pa.struct([("pos", pa.int32()), ("shingle", pa.int64())])
    seg = pa.struct([("start", pa.int32()), ("words", pa.list_(pa.string())), ("hits", pa.list_(hit))])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def segments(raw: bytes, starts: np.ndarray, sizes: np.ndarray, pos: np.ndarray, h: np.ndarray) -> list[dict]:
        order = np.argsort(pos, kind="stable")
        pos, h = pos[order], h[order].view(np.int64)
        first = np.r_[0, np.flatnonzero(pos[1:] - pos[:-1] > 2 * reach) + 1]
        out = []
        for a, z in zip(first.tolist(), [*first[1:].tolist(), len(pos)], strict=True):
            lo, hi = max(0, int(pos[a]) - reach), min(len(starts), int(pos[z - 1]) + reach + 1)
            words = [raw[s : s + k].decode("utf-8", "surrogatepass") for s, k in zip(starts[lo:hi].tolist(), sizes[lo:hi].tolist(), strict=True)]
            out.append({"start": lo, "words": words, "hits": [{"pos": p, "shingle": x} for p, x in zip(pos[a:z].tolist(), h[a:z].tolist(), strict=True)]})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([("doc_id", b.schema.field(0).type), ("n_words", pa.int64()), ("segs", pa.list_(seg))])
            for k in range(0, b.num_rows, 1000):
                rows = b.slice(k, 1000)
                texts = rows.column(1).to_pylist()
                n_words, segs = [], []
                for part in blocks_of(texts):
                    data, starts, sizes, n = spans = word_spans(texts[part], GAPS)
                    at, h = [], []
                    for x in shingles_at(spans, widths).values():
                        at.append(np.flatnonzero(among(x, bits)))
                        h.append(x[at[-1]])
                    at, h = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, h))
                    begin = np.cumsum(n) - n
                    owner = np.searchsorted(begin + n, at, "right")
                    found: list[list] = [[] for _ in n]
                    raw = data.tobytes() if len(at) else b""
                    for i in np.unique(owner).tolist():
                        own, here = owner == i, slice(begin[i], begin[i] + n[i])
                        found[i] = segments(raw, starts[here], sizes[here], at[own] - begin[i], h[own])
                    n_words += n.tolist()
                    segs += found
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n_words, pa.int64()), pa.array(segs, pa.list_(seg))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, segs array<struct<start: int, words: array<string>, hits: array<struct<pos: int, shingle: long>>>>")


def few(df: DataFrame, chars: str) -> DataFrame:
    """A stored table, marked for a broadcast if its rows and the characters of a column are few."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.length(chars)), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_WINDOWS and size <= BROADCAST_CHARS else df


def covered(spans: Column) -> Column:
    """Words inside any of the spans (start, end; sorted by start)."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("end"))
    add = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["end"])).cast("long")).alias("n"), F.greatest(a["end"], x["end"]).alias("end"))
    return F.aggregate(spans, none, add, lambda a: a["n"])


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    windows, members = item_windows(items, window, shingle)
    # a window's shingles have one width: all of it if it is shorter than `shingle`
    widths = sorted({min(shingle, r["size"]) for r in windows.select("size").distinct().collect()})  # window sizes: `window` rows at most
    with small_batches(docs.sparkSession):
        each = windows.select("w", F.size("shingles").alias("of"), F.posexplode("shingles").alias("at", "shingle"))
        counts = stored(shingle_counts(docs, bitmap(each.select("shingle").distinct()), widths), "counts")
        rarest = each.join(counts, "shingle").groupBy("w").agg(F.min("of").alias("of"), F.count("*").alias("there"), F.min(F.struct("n", "shingle", "at")).alias("r")).where("there = of")
        prefix = stored(rarest.join(windows, "w").select("w", "r.shingle", "r.at", "size", F.col("text").alias("wanted")), "prefixes")
        made = marked(docs, bitmap(prefix.select("shingle").distinct()), widths, window - 1)
        rows = stored(made.withColumn("key", F.monotonically_increasing_id()), "marked")
    hits = rows.where(F.size("segs") > 0).select("key", F.explode("segs").alias("s")).select("key", "s.start", "s.words", F.explode("s.hits").alias("h"))
    met = hits.withColumn("shingle", F.col("h.shingle")).join(few(prefix, "wanted"), "shingle").withColumn("begin", F.col("h.pos") - F.col("at"))
    inside = (F.col("begin") >= F.col("start")) & (F.col("begin") + F.col("size") <= F.col("start") + F.size("words"))
    same = F.array_join(F.slice("words", F.greatest(F.lit(1), F.col("begin") - F.col("start") + 1), F.col("size")), " ") == F.col("wanted")
    met = met.where(inside & same).select("key", "w", F.struct(F.col("begin").alias("start"), (F.col("begin") + F.col("size")).alias("end")).alias("span"))
    # at most ten spans begin at a word of the document
    facts = met.groupBy("key").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("w")).alias("ws"))
    facts = stored(facts.select("key", covered(F.col("spans")).alias("n_hit"), "ws", F.sha2(F.array_join(F.transform("ws", lambda w: w.cast("string")), ","), 256).alias("set")), "facts")
    sets = facts.groupBy("set").agg(F.min("ws").alias("ws")).select("set", F.explode("ws").alias("w")).join(members, "w").select("set", "item").distinct()
    sets = stored(sets, "sets")
    of_set = sets.groupBy("set").agg(F.count("*").alias("n_items")).join(joined_sha256(sets, ["set"], "item"), "set")
    some = rows.where(F.size("segs") > 0).select("key", "doc_id", "n_words").join(facts.join(few(stored(of_set, "items"), "set"), "set"), "key", "left")
    both = rows.where(F.size("segs") == 0).select("doc_id", "n_words").unionByName(some.select("doc_id", "n_words", "n_hit", "n_items", "sha256"), allowMissingColumns=True)
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return both.select("doc_id", "n_words", n("n_hit"), n("n_items"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH item AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS text FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
at_ AS (SELECT r, size, k, array_to_string(w[k:k + size - 1], ' ') AS text FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM doc, sizes WHERE len(w) >= size)),
met AS MATERIALIZED (SELECT r, k, a.size, item FROM at_ a JOIN win USING (size, text)),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(k, k + size)) AS p FROM (SELECT DISTINCT r, k, size FROM met)) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated FROM doc LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
