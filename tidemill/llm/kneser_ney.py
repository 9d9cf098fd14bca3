"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by workers.

Counting: tasks turn texts into pairs of 64-bit word hashes, add equal pairs up, and send them as packed arrays to
the part that owns their context. A part writes its pairs as sorted arrays (keys, counts) to the shared folder and
passes on what it knows of each word: continuations, occurrences, and as a context its total and how many
followers it has once, twice or more. A second round adds these up and writes sorted arrays by word. Only totals
and counts of counts (one row per part) reach the driver.

Contexts that a sample of rows shows to be very common (at most `MAX_HOT`) are split over parts by their
followers; this spreads the work and changes no count.

Scoring: workers map the arrays into memory, so that pages are shared and read on demand, and look up the sorted
pairs of many texts at once. From a shared folder that is no plain file path, the arrays that are looked up are copied
once for all workers that share a temporary folder; the next training there removes them.

A text is its words, A-Z lower-cased, then an end token; a start marker stands before it but is no token itself.
Null and empty texts are the end token alone. Unknown words share the mass kept for one unknown word. Repeated
rows count and score as often as they occur; extra columns are kept out; an empty training set leaves a uniform
model of one unknown word (score 0 for every token) and base scores of zero.
"""

from __future__ import annotations

import glob
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import WordHash, batch, columns, crc_mod, mix, shared_dir, stored, table

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
MAX_HOT, HOT_WAYS = 1000, np.uint64(64)
#: Tokens that a task turns to pairs before adding equal ones up, and tokens that are scored at once.
BLOCK, SCORE_BLOCK = 500_000, 400_000
WORD_FIELDS = ("count", "continuations", "total", "once", "twice", "more")


def part_of(h1: np.ndarray, h2: np.ndarray, parts: int, hot: np.ndarray) -> np.ndarray:
    """The part that owns each pair: by context, and for hot contexts by follower too."""
    at = np.minimum(np.searchsorted(hot, h1), max(len(hot) - 1, 0))
    split = hot[at] == h1 if len(hot) else np.zeros(len(h1), bool)
    return (mix(h1, np.where(split, h2 % HOT_WAYS + np.uint64(1), np.uint64(0))) % np.uint64(parts)).astype(np.int64)


def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows with equal keys added up, sorted by the keys (the first one first)."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(new)
    return [k[starts] for k in keys], [np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values]


def pairs_of(texts: list[str | None], hashes: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and token of every token of the texts, and the number of tokens of each text."""
    words = [hashes.of(t) for t in texts]
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    second = np.full(int(sizes.sum()), END, np.uint64)
    ends = np.cumsum(sizes)
    for w, e in zip(words, ends, strict=True):
        second[e - 1 - len(w) : e - 1] = w
    first = np.empty_like(second)
    first[1:] = second[:-1]
    first[ends - sizes] = START
    return first, second, sizes


def in_blocks(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some `most` tokens, by their characters."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") // 6 + 1
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def pack(h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted pairs as bytes: contexts once each with their number of followers, followers, and one byte of count (255: see the overflow)."""
    starts = np.flatnonzero(np.r_[True, h1[1:] != h1[:-1]]) if len(h1) else np.zeros(0, np.int64)
    runs = np.diff(np.r_[starts, len(h1)]).astype(np.uint32)
    big = n >= 255
    head = np.array([len(starts), len(h1), int(big.sum())], np.int64)
    return b"".join(x.tobytes() for x in (head, h1[starts], runs, h2, np.minimum(n, 255).astype(np.uint8), n[big].astype(np.int64)))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    contexts, pairs, big = np.frombuffer(data, np.int64, 3)
    at, out = 24, []
    for kind, size in ((np.uint64, contexts), (np.uint32, contexts), (np.uint64, pairs), (np.uint8, pairs), (np.int64, big)):
        out.append(np.frombuffer(data, kind, size, at))
        at += out[-1].nbytes
    n = out[3].astype(np.int64)
    n[n == 255] = out[4]
    return np.repeat(out[0], out[1]), out[2], n


def count_pairs(texts: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    """part, data: each task's pairs, added up and packed by the part that owns them."""
    schema = pa.schema([("part", pa.int32()), ("data", pa.binary())])
    session = texts.sparkSession.sparkContext.applicationId

    def emit(h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = part_of(h1, h2, parts, hot)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(p, pack(h1[o], h2[o], n[o])) for p in range(parts) if len(o := order[cuts[p] : cuts[p + 1]])]
        if rows:
            yield batch(schema, *zip(*rows, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mapped.cache_clear()  # a worker that counts lets go of the models that it scored with before
        drop_copies(session)
        hashes, kept = WordHash(), []
        for (own,) in columns(batches):
            for a, b in in_blocks(own, BLOCK):
                h1, h2, _ = pairs_of(own[a:b], hashes)
                (h1, h2), (n,) = summed([h1, h2], [np.ones(len(h1), np.int64)])
                kept.append((h1, h2, n))
                if sum(len(k[0]) for k in kept) > 2 * BLOCK:
                    (h1, h2), (n,) = summed([np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])], [np.concatenate([k[2] for k in kept])])
                    kept = [(h1, h2, n)]
                    if len(h1) > 2 * BLOCK:
                        yield from emit(h1, h2, n)
                        kept = []
        if kept:
            (h1, h2), (n,) = summed([np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])], [np.concatenate([k[2] for k in kept])])
            yield from emit(h1, h2, n)

    return texts.mapInArrow(run, "part int, data binary")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def save_arrays(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file per array, each put in place at once, so that a repeated task does no harm."""
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    for k, a in arrays.items():
        temp = f"{path}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(temp) as out:
            np.lib.format.write_array(out, np.ascontiguousarray(a), allow_pickle=False)
        fs.move(temp, f"{path}/{name}.{k}.npy")


COPIES = "tidemill-arrays"


def host_copy(fs: pafs.FileSystem, path: str, folder: str) -> str:
    """The file of a remote store in a local folder, put there by the first worker that asks."""
    local = os.path.join(folder, os.path.basename(path))
    if not os.path.exists(local):
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            raise FileNotFoundError(path)
        os.makedirs(folder, exist_ok=True)
        part = f"{local}.{uuid.uuid4().hex}"
        pafs.copy_files(path, part, source_filesystem=fs, destination_filesystem=pafs.LocalFileSystem())
        os.replace(part, local)
    return local


def drop_copies(session: str) -> None:
    """Removes copies of former models of one Spark application from this host; what is mapped stays readable."""
    for old in glob.glob(os.path.join(tempfile.gettempdir(), f"{COPIES}-bigrams-{session}-*")):
        shutil.rmtree(old, ignore_errors=True)


@lru_cache(4096)
def mapped(folder: str, name: str) -> np.ndarray:
    """A stored array, mapped into memory."""
    fs, path = file_system(folder)
    path = f"{path}/{name}.npy"
    if not isinstance(fs, pafs.LocalFileSystem):
        path = host_copy(fs, path, os.path.join(tempfile.gettempdir(), f"{COPIES}-{folder.rstrip('/').rpartition('/')[2]}"))
    return np.load(path, mmap_mode="r" if os.path.getsize(path) > 128 else None)


def write_pairs(packed: DataFrame, folder: str, parts: int) -> DataFrame:
    """Writes each part's pairs; part2, data, n1..n4, pairs, tokens: word facts packed by the word part that owns them, and totals."""

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [unpack(d) for d in pdf["data"]]
        (h1, h2), (n,) = summed([np.concatenate([r[k] for r in rows]) for k in (0, 1)], [np.concatenate([r[2] for r in rows])])
        key = mix(h1, h2)
        order = np.argsort(key, kind="stable")
        big = order[n[order] >= 255]
        save_arrays(folder, f"pairs{pdf['part'].iloc[0]}", {"keys": key[order], "counts": np.minimum(n[order], 255).astype(np.uint8), "big_keys": key[big], "big_counts": n[big]})
        one = np.ones(len(n), np.int64)
        # as a follower: count, continuations; as a context: total, once, twice, more
        words = [h2, h1]
        facts = [np.concatenate([a, b]) for a, b in ((n, 0 * n), (one, 0 * n), (0 * n, n), (0 * n, n == 1), (0 * n, n == 2), (0 * n, n > 2))]
        (h,), facts = summed([np.concatenate(words)], [f.astype(np.int64) for f in facts])
        part = (mix(h, np.uint64(1)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        out = []
        for p in range(parts):
            o = order[cuts[p] : cuts[p + 1]]
            if len(o):
                small = [f[o].astype(np.uint8) for f in facts] if all((f[o] < 256).all() for f in facts) else [f[o] for f in facts]
                width = small[0].itemsize
                out.append((p, np.int64([len(o), width]).tobytes() + b"".join(x.tobytes() for x in [h[o], *small])))
        stats = pd.DataFrame(out, columns=["part2", "data"])
        stats["part"] = int(pdf["part"].iloc[0])
        for k in (1, 2, 3, 4):
            stats[f"n{k}"] = 0
            stats.loc[0, f"n{k}"] = int((n == k).sum())
        stats["tokens"] = 0
        stats.loc[0, "tokens"] = int(n.sum())
        return stats

    return packed.groupBy("part").applyInPandas(reduce, "part2 int, data binary, part int, n1 long, n2 long, n3 long, n4 long, tokens long")


def write_words(facts: DataFrame, folder: str) -> DataFrame:
    """Writes each part's word arrays; words, continuations and counts of continuation counts by part."""

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        hs, columns_ = [], [[] for _ in WORD_FIELDS]
        for d in pdf["data"]:
            n, width = np.frombuffer(d, np.int64, 2)
            hs.append(np.frombuffer(d, np.uint64, n, 16))
            for k, c in enumerate(columns_):
                c.append(np.frombuffer(d, np.uint8 if width == 1 else np.int64, n, 16 + 8 * n + k * n * width).astype(np.int64))
        (h,), facts_ = summed([np.concatenate(hs)], [np.concatenate(c) for c in columns_])
        save_arrays(folder, f"words{pdf['part2'].iloc[0]}", {"keys": h} | dict(zip(WORD_FIELDS, facts_, strict=True)))
        cont = facts_[1]
        return pd.DataFrame([[int((facts_[0] > 0).sum()), int(cont.sum()), *[int((cont == k).sum()) for k in (1, 2, 3, 4)], int((cont > 2).sum()), int(pdf["part2"].iloc[0])]], columns=["words", "continuations", "n1", "n2", "n3", "n4", "more", "part"])

    return facts.groupBy("part2").applyInPandas(reduce, "words long, continuations long, n1 long, n2 long, n3 long, n4 long, more long, part int")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts for counts of one, two, and three or more; never below 0 nor above the count."""
    if not n1:
        return 0.0, 0.0, 0.0
    y = n1 / (n1 + 2 * n2)
    raw = [k - (k + 1) * y * b / a if a else 0.0 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(raw, 1))


class Model:
    """Where the arrays are, and the totals."""

    def __init__(self, folder: str, parts: int, held: dict[str, frozenset[int]], hot: np.ndarray, tokens: int, words: int, pair_counts: tuple, word_counts: tuple, continuations: int, more: int):
        self.folder, self.parts, self.held, self.hot, self.tokens, self.words = folder, parts, held, hot, tokens, words
        self.d2, self.d1 = discounts(*pair_counts), discounts(*word_counts)
        self.continuations = continuations
        n1, n2 = word_counts[:2]
        self.left = (self.d1[0] * n1 + self.d1[1] * n2 + self.d1[2] * more) / continuations if continuations else 1.0

    def lookup(self, kind: str, part: np.ndarray, keys: np.ndarray, fields: tuple[str, ...]) -> list[np.ndarray]:
        """Fields of sorted unique keys of each part, 0 where unknown; a part that was written must be there."""
        out = [np.zeros(len(keys), np.int64) for _ in fields]
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(cuts)):
            at = order[cuts[p] : cuts[p + 1]]
            if p not in self.held[kind]:
                continue  # no key fell to this part
            have = mapped(self.folder, f"{kind}{p}.keys")
            pos = np.minimum(np.searchsorted(have, keys[at]), len(have) - 1)
            right = have[pos] == keys[at]
            for o, f in zip(out, fields, strict=True):
                o[at[right]] = mapped(self.folder, f"{kind}{p}.{f}")[pos[right]]
        return out

    def pair_counts(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        key, part = mix(h1, h2), part_of(h1, h2, self.parts, self.hot)
        (n,) = self.lookup("pairs", part, key, ("counts",))
        for p in np.unique(part[n == 255]):
            at = np.flatnonzero((n == 255) & (part == p))
            n[at] = mapped(self.folder, f"pairs{p}.big_counts")[np.searchsorted(mapped(self.folder, f"pairs{p}.big_keys"), key[at])]
        return n

    def scores(self, texts: list[str | None], hashes: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, base score and log10 probability of each text."""
        h1, h2, sizes = pairs_of(texts, hashes)
        starts = np.cumsum(sizes) - sizes
        if not self.continuations:
            zero = np.zeros(len(sizes))
            return sizes, zero.astype(np.int64), zero, zero
        words, back = np.unique(np.concatenate([h1, h2]), return_inverse=True)
        count, cont, total, once, twice, more = self.lookup("words", (mix(words, np.uint64(1)) % np.uint64(self.parts)).astype(np.int64), words, WORD_FIELDS)
        first, second = back[: len(h1)], back[len(h1) :]
        cut = lambda n, d: np.where(n > 0, n - np.array([0.0, *d])[np.minimum(n, 3)], 0.0)
        single = cut(cont, self.d1) / self.continuations + self.left / (self.words + 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            kept = np.where(total > 0, (self.d2[0] * once + self.d2[1] * twice + self.d2[2] * more) / total, 1.0)
        order = np.lexsort((h2, h1))
        new = np.r_[True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])]
        lead = order[new]
        n = np.empty(len(h1), np.int64)
        n[order] = self.pair_counts(h1[lead], h2[lead])[np.cumsum(new) - 1]
        p = cut(n, self.d2) / np.maximum(total[first], 1) + kept[first] * single[second]
        base = np.log10((count + 1) / (self.tokens + self.words + 1))
        return sizes, np.add.reduceat((count[second] > 0).astype(np.int64), starts), np.add.reduceat(base[second], starts), np.add.reduceat(np.log10(p), starts)


def hot_contexts(texts: DataFrame, sample_rows: int = 500) -> np.ndarray:
    """Hashes of the words that make up a thousandth or more of a sample's tokens: at most MAX_HOT."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for (own,) in columns(batches):
            h, n = np.unique(pairs_of(own, hashes)[0], return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield batch(schema, h.view(np.int64), n)

    counted = texts.limit(sample_rows).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    rows = counted.where(F.col("n") * 1000 >= total).orderBy(F.col("n").desc(), "h").limit(MAX_HOT).collect()
    return np.sort(np.array([r["h"] for r in rows], np.int64).view(np.uint64))


def train_lm(texts: DataFrame, parts: int) -> Model:
    """The model of a one-column frame of texts; `parts` should grow with them (pairs of a part meet in one task)."""
    spark = texts.sparkSession
    folder, hot = shared_dir(spark, f"bigrams-{spark.sparkContext.applicationId}"), hot_contexts(texts)
    facts = stored(write_pairs(count_pairs(texts, parts, hot), folder, parts), "facts")
    pairs = facts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "tokens")], F.collect_set("part").alias("parts")).first()
    names = ("words", "continuations", "n1", "n2", "n3", "n4", "more")
    words = write_words(facts.where(F.col("data").isNotNull()).select("part2", "data"), folder).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names], F.collect_set("part").alias("parts")).first()
    held = {"pairs": frozenset(pairs["parts"]), "words": frozenset(words["parts"])}  # numbers of parts
    return Model(folder, parts, held, hot, pairs["tokens"], words["words"], tuple(pairs)[:4], tuple(words)[2:6], words["continuations"], words["more"])


def score_lm(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and perplexity of each whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for ids, own in columns(batches):
            for a, b in in_blocks(own, SCORE_BLOCK):
                n, known, base, score = model.scores(own[a:b], hashes)
                yield batch(schema, ids[a:b], n, known, base, score, 10.0 ** np.minimum(-score / n, 300))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, perplexity double")


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    training = docs.where(crc_mod(F.col("doc_id"), 7) != 2).select("text")
    parts = max(8, 4 * docs.rdd.getNumPartitions())  # known from the plan
    model = train_lm(training, parts)
    scored = score_lm(docs, model).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
