"""Spelling variants: words one edit apart, found by two-dimensional range reporting.

A word is a point: its rank in forward order and its rank in reverse order (words read from their ends). With q and an
edit at position i, the words that keep q's first i characters are an interval of the forward order, those that keep
its rest an interval of the reverse order. A wavelet tree over the reverse ranks in forward order reports the points in
both. Trees hold words of one length: among words of q's length these are replacements (the rest begins behind i),
among those one longer, insertions (the rest begins at i); deletions are insertions seen from the other word. An
inserted character that repeats its neighbour fits several positions, of which the last one counts, so that each pair
is reported once.

Positions are dealt in windows. A word enters, for each window of positions, the shard of what an edit inside the window
leaves: the characters before it and those behind it. First each length has two windows, its halves; a shard of more
than SPLIT words is dealt again by half windows, until windows are single positions, whose shards hold no more words
than the alphabet has letters. So neither a task nor the driver holds the vocabulary. A task takes whole shards, some
CHUNK characters of words at a time, in one pair of trees for each window.

Words are counted per task and then summed, so that a frequent word is no hot key. Forms at least double a word's
count, so that following them ends after some thirty steps, five or six when each step doubles the way.

Null texts have no words; texts and words may be of any length. A null doc_id is written as nothing before the colon.
Repeated rows count as often as they stand; further columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import batch, columns, small_batches, span_hashes, stored, table
from tidemill.llm.signature_tree import blocks_of

LEAST_LENGTH, LEAST_COUNT, TYPO = 5, 3, 97
#: Words of a shard above which it is dealt again, characters that a task takes together, and words that it counts before it hands them on.
SPLIT, CHUNK, HELD = 1000, 1_000_000, 300_000
#: Shards up to which those to be dealt again are broadcast.
BROADCAST_SHARDS = 200_000

#: Latin-1 bytes that are letters: A-Z, a-z and U+00C0 to U+00FF.
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]] = True

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = (_CRC >> np.uint32(1)) ^ np.where(_CRC & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))


def run_crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of the UTF-8 of Latin-1 runs, each continuing the CRC `begun`; all runs take a character at a time."""
    order = np.argsort(np.minimum(sizes, 65535).astype(np.uint16), kind="stable")[::-1]
    if len(order) and sizes[order[0]] >= 65535:
        order = np.argsort(-sizes, kind="stable")
    at, size, state = starts[order], sizes[order], begun[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    step = lambda s, b: _CRC[(s ^ b) & np.uint32(255)] ^ (s >> np.uint32(8))
    ends = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")  # runs longer than k
    for k, n in enumerate(ends.tolist()):
        b = data[at[:n] + k].astype(np.uint32)
        high = np.flatnonzero(b >= 0xC0)
        if len(high):
            state[high] = step(state[high], np.uint32(0xC3))
            b[high] -= np.uint32(0x40)
        state[:n] = step(state[:n], b)
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def counted_words(ids: list, texts: list[str | None], least: int) -> dict[bytes, int]:
    """Words (Latin-1, `least` characters or more) of whole texts with the planted typos, and how often each stands."""
    parts = [(t or "").encode("latin-1", "replace") for t in texts]
    raw = b" ".join(parts).lower() + b" "
    data = np.frombuffer(raw, np.uint8)
    gap = ~LETTER[data]
    after = np.r_[True, gap[:-1]]
    starts = np.flatnonzero(~gap & after)
    sizes = np.flatnonzero(gap & ~after) - starts
    n = np.diff(np.r_[0, np.searchsorted(starts, np.cumsum([len(p) + 1 for p in parts]))])
    long = sizes >= least
    owner = np.repeat(np.arange(len(n)), n)[long]
    starts, sizes = starts[long], sizes[long]
    begun = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    h = run_crcs(data, starts, sizes, begun[owner])
    typo = h % TYPO == 0
    out: dict[bytes, int] = {}
    for s, k, p in zip(starts[typo].tolist(), sizes[typo].tolist(), (h[typo] % sizes[typo]).tolist(), strict=True):
        if k > least:
            w = raw[s : s + p] + raw[s + p + 1 : s + k]
            out[w] = out.get(w, 0) + 1
    starts, sizes = starts[~typo], sizes[~typo]
    _, first, count = np.unique(span_hashes(data, starts, sizes), return_index=True, return_counts=True)
    for s, k, c in zip(starts[first].tolist(), sizes[first].tolist(), count.tolist(), strict=True):
        w = raw[s : s + k]
        out[w] = out.get(w, 0) + c
    return out


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of all words that are long and frequent enough."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def given(held: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        words = list(held)
        for k in range(0, len(words), 10_000):
            part = words[k : k + 10_000]
            yield batch(schema, [w.decode("latin-1") for w in part], [held[w] for w in part])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for ids, texts in columns(batches):
            for part in blocks_of(texts, 1_000_000):
                for w, c in counted_words(ids[part], texts[part], least_length).items():
                    held[w] = held.get(w, 0) + c
                if len(held) >= HELD:
                    yield from given(held)
                    held = {}
        yield from given(held)

    with small_batches(docs.sparkSession):
        counts = docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        return stored(counts.where(F.col("n") >= least_count), "words")


class WaveletTree:
    """Points (x, y) with x and y permutations of 0..n-1, given as y in order of x; reports the points in rectangles."""

    def __init__(self, ys: np.ndarray):
        self.depth = max(1, int(len(ys) - 1).bit_length()) if len(ys) else 0
        self.levels = []
        for level in range(self.depth - 1, -1, -1):
            zero = ys >> level & 1 == 0
            before = np.r_[0, np.cumsum(zero)]
            self.levels.append((level, before))
            ys = np.r_[ys[zero], ys[~zero]]

    def report(self, x1: np.ndarray, x2: np.ndarray, y1: np.ndarray, y2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rectangle and y of every point inside x1 <= x < x2 and y1 <= y < y2, over all rectangles at once."""
        which = np.flatnonzero((x1 < x2) & (y1 < y2)) if self.depth else np.zeros(0, np.int64)
        a, b, v = x1[which], x2[which], np.zeros(len(which), np.int64)
        for level, before in self.levels:
            zeros = before[-1]
            lo, hi = before[a], before[b]
            a, b = np.r_[lo, zeros + a - lo], np.r_[hi, zeros + b - hi]
            v, which = np.r_[v, v + (1 << level)], np.r_[which, which]
            keep = (a < b) & (v < y2[which]) & (v + (1 << level) > y1[which])
            a, b, v, which = a[keep], b[keep], v[keep], which[keep]
        return which, v


class Order:
    """Words sorted; for every word and length i, the interval of words with the same first i characters."""

    def __init__(self, words: np.ndarray):
        self.order = np.argsort(words, kind="stable")
        n, size = len(words), words.dtype.itemsize
        chars = words[self.order].view(np.uint8).reshape(n, size)
        same = np.logical_and.accumulate(chars[1:] == chars[:-1], axis=1).sum(1)
        self.shared = np.r_[-1, same, -1]  # with the word before; bounds on both ends
        self.rank = np.empty(n, np.int64)
        self.rank[self.order] = np.arange(n)

    def interval(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each word's interval, by rank."""
        cut = self.shared < i
        at = np.arange(len(cut))
        begin = np.maximum.accumulate(np.where(cut, at, 0))[:-1]
        end = np.minimum.accumulate(np.where(cut, at, len(cut))[::-1])[::-1][1:]
        return begin, end


def edits_in_window(words: list[bytes], m: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of words of m and m + 1 characters, both ways round, that one edit at a position from lo to hi - 1 parts."""
    size = np.array([len(w) for w in words])
    # positions count from the front for what stays before an edit, from the back for what stays behind it
    front, back = Order(np.array(words, f"S{m + 1}")), Order(np.array([w[::-1] for w in words], f"S{m + 1}"))
    q = np.flatnonzero(size == m)
    pairs = [np.zeros((2, 0), np.int64)]
    for length in (m, m + 1):
        own = size == length
        xs, ys = (np.r_[0, np.cumsum(own[o.order])] for o in (front, back))  # ranks among all words -> among those of this length
        by_x, by_y = front.order[own[front.order]], back.order[own[back.order]]
        if not len(by_x):
            continue
        tree = WaveletTree(ys[back.rank[by_x]])
        boxes = []
        for i in range(lo, min(hi, length)):
            (x1, x2), (y1, y2) = front.interval(i), back.interval(length - 1 - i)
            x1, x2, y1, y2 = xs[x1[front.rank[q]]], xs[x2[front.rank[q]]], ys[y1[back.rank[q]]], ys[y2[back.rank[q]]]
            some = (x2 - x1 > (length == m)) & (y2 - y1 > (length == m))  # q itself is in both
            boxes.append((x1[some], x2[some], y1[some], y2[some], q[some], np.full(some.sum(), i)))
        if not boxes:
            continue
        x1, x2, y1, y2, of, at = (np.concatenate(c) for c in zip(*boxes, strict=True))
        box, y = tree.report(x1, x2, y1, y2)
        a, b, i = of[box], by_y[y], at[box]
        if length == m:
            pairs.append(np.stack([a, b])[:, a != b])
        else:
            chars = lambda k: np.array(words, f"S{m + 1}").view(np.uint8).reshape(len(words), m + 1)[k, i]
            last = (i == m) | (chars(a) != chars(b))
            pairs += [np.stack([a, b])[:, last], np.stack([b, a])[:, last]]
    return tuple(np.concatenate(pairs, axis=1))


def dealt(words: DataFrame) -> DataFrame:
    """m, lo, hi, word, n: every word for the windows of its own length and of one less."""
    m = F.explode(F.filter(F.array(F.length("word"), F.length("word") - 1), lambda x: x >= LEAST_LENGTH))
    rows = words.select("word", "n", m.alias("m")).withColumn("half", F.floor(F.col("m") / 2).cast("int"))
    window = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    halves = F.explode(F.array(window(F.lit(0), F.col("half")), window(F.col("half"), F.col("m") + 1)))
    return rows.select("m", halves.alias("w"), "word", "n").select("m", "w.lo", "w.hi", "word", "n")


def keyed(entries: DataFrame) -> DataFrame:
    """With the shard: what an edit in the window leaves of the word."""
    behind = F.when(F.col("hi") < F.col("m"), F.expr("right(word, m - hi)")).otherwise("")
    return entries.withColumn("shard", F.xxhash64("m", "lo", "hi", F.expr("substring(word, 1, lo)"), behind))


def shards(words: DataFrame, split: int) -> DataFrame:
    """Entries of all words in shards of `split` words at most, or of a single position."""
    left, done = keyed(dealt(words)), []
    while True:
        big = stored(left.groupBy("shard").agg(F.count("*").alias("c"), F.first("lo").alias("lo"), F.first("hi").alias("hi")).where((F.col("c") > split) & (F.col("hi") - F.col("lo") > 1)).select("shard"), "big_shards")
        n = big.count()
        if not n:
            done.append(left)
            break
        some = F.broadcast(big) if n <= BROADCAST_SHARDS else big
        done.append(left.join(some, "shard", "left_anti"))
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        window = lambda lo, hi: F.struct(F.col(lo).alias("lo") if isinstance(lo, str) else lo.alias("lo"), F.col(hi).alias("hi") if isinstance(hi, str) else hi.alias("hi"))
        again = left.join(some, "shard", "left_semi").select("m", F.explode(F.array(window("lo", mid), window(mid, "hi"))).alias("w"), "word", "n")
        left = stored(keyed(again.select("m", "w.lo", "w.hi", "word", "n")), "shards")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def near_words(words: DataFrame, split: int = SPLIT) -> DataFrame:
    """word, n_near, best_n, best: how many words of `words` (word, n) are one edit away, and the most frequent of them (ties: the smallest)."""
    schema = pa.schema([("word", pa.string()), ("c", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def reported(rows: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        shard, m, lo, hi, word, n = (np.concatenate([r[k] for r in rows]) for k in range(6))
        alone = np.r_[True, shard[1:] != shard[:-1]] & np.r_[shard[1:] != shard[:-1], True]
        m, lo, hi, word, n = (x[~alone] for x in (m, lo, hi, word, n))
        order = np.lexsort((hi, lo, m))
        cuts = np.flatnonzero(np.r_[True, np.any([x[order][1:] != x[order][:-1] for x in (m, lo, hi)], axis=0)]) if len(order) else []
        for a, z in zip(cuts, [*cuts[1:], len(order)], strict=True):
            own = order[a:z]
            texts, counts = [w.encode("latin-1") for w in word[own]], n[own]
            i, j = edits_in_window(texts, int(m[own[0]]), int(lo[own[0]]), int(hi[own[0]]))
            if not len(i):
                continue
            rank = np.empty(len(texts), np.int64)
            rank[np.argsort(np.array(texts), kind="stable")] = np.arange(len(texts))
            by = np.lexsort((rank[j], -counts[j], i))
            i, j = i[by], j[by]
            first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            yield batch(schema, word[own[i[first]]], np.diff(np.r_[first, len(i)]), counts[j[first]], word[own[j[first]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        chars = 0
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            here = sum(map(len, cols[4]))
            if chars + here >= CHUNK and held:
                # up to where the last, maybe unfinished, shard starts
                if len(new := np.flatnonzero(cols[0] != held[-1][0][-1])):
                    yield from reported([*held, [c[: new[0]] for c in cols]])
                    cols, held = [c[new[0] :] for c in cols], []
                    chars, here = 0, sum(map(len, cols[4]))
            held.append(cols)
            chars += here
        if held:
            yield from reported(held)

    entries = shards(words, split).repartition("shard").sortWithinPartitions("shard")
    made = entries.select("shard", "m", "lo", "hi", "word", "n").mapInArrow(run, "word string, c long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("o"), "best"))
    return made.groupBy("word").agg(F.sum("c").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.o")).alias("best_n"), "b.best")


def spelling_variants(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = vocabulary(docs)
    near = words.join(near_words(words, split), "word", "left")
    has = F.coalesce(F.col("best_n") >= 2 * F.col("n"), F.lit(False))
    rows = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "forms")
    way = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps taken; a root is a word without a form
        on = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        way = stored(way.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if way.where("moved").isEmpty():
            break
    return rows.join(way.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


# crc32: eight shifts a byte; 3988292384 is the reversed polynomial (fixed value). Near words share what is left when a character goes.
OP13_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents) WHERE length(w) >= 5 GROUP BY 1, 2
), coded AS (
  SELECT w, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, CAST(octet_length(encode(d || ':' || w)) AS BIGINT) + 1), lambda i: CAST('0x' || hex(encode(d || ':' || w))[2 * i - 1:2 * i] AS BIGINT))),
    lambda s, b: list_reduce(list_concat([xor(s, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))) AS h FROM runs
), words AS MATERIALIZED (
  SELECT w, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN w[1:CAST(h % length(w) AS BIGINT)] || w[CAST(h % length(w) AS BIGINT) + 2:] ELSE w END AS w, n FROM coded) WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3
), cut AS MATERIALIZED (SELECT w, i, w[1:i - 1] || w[i + 1:] AS r FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.w AS a, b.w AS b FROM cut a JOIN cut b ON a.r = b.r AND a.i = b.i AND a.w <> b.w
  UNION SELECT c.w, v.w FROM cut c JOIN words v ON v.w = c.r UNION SELECT v.w, c.w FROM cut c JOIN words v ON v.w = c.r
), near AS (SELECT a, count(*) AS n_near, arg_min(b, (-v.n, b)) AS best, max(v.n) AS best_n FROM pairs JOIN words v ON v.w = b GROUP BY a),
forms AS MATERIALIZED (SELECT w, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n FROM words LEFT JOIN near ON near.a = w),
way AS (SELECT w, w AS r FROM forms UNION ALL SELECT way.w, f.form FROM way JOIN forms f ON f.w = way.r WHERE f.form IS NOT NULL),
root AS (SELECT way.w, way.r FROM way JOIN forms f ON f.w = way.r WHERE f.form IS NULL)
SELECT f.w AS word, form, r AS root, n, n_near, form_n FROM forms f JOIN root USING (w)
"""
