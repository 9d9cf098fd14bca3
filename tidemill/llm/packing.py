"""Best-fit packing under conflicts: no bin holds two pieces of one source or of one duplicate cluster.

Documents are cut into pieces of at most `capacity` tokens; full pieces fill a bin each. The rest is packed longest
first into the tightest bin that has room and no conflict. Bins stand in lists by residual, and a bitmap tells
which residuals occur; the search starts at the piece's length and goes to the next residual with a bin until a
compatible one is found. Every bin has a bitmap of its sources and one of its clusters; each residual list also has the AND of
its bins' bitmaps, so that a list in which all bins conflict is passed over at once.

Packing runs in shards of about `shard_rows` documents, dealt by a hash of the document, so that hot sources and
clusters spread and no task grows; only ids, lengths and keys are shuffled. Best fit holds within a shard.

Documents without a word take one token (their end). A null source or cluster conflicts with nothing. Ties go by
doc_id, then piece, and to the oldest of equally tight bins. Repeated rows are separate documents of one cluster. Extra columns are kept out.
An empty table gives no bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import stored, table, words_of
from tidemill.llm.signature_tree import jaccard_components


class Bins:
    """Open bins of one shard."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residuals = 0  # bit r: some bin has r tokens left
        self.lists: dict[int, list[int]] = {}
        self.common: dict[int, tuple[int, int]] = {}  # AND of the sources and of the clusters of a list's bins
        self.left: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def successors(self, least: int) -> Iterator[int]:
        """Residuals with bins, from `least` up."""
        bits = self.residuals >> least
        while bits:
            step = (bits & -bits).bit_length() - 1
            least += step
            yield least
            least += 1
            bits >>= step + 1

    def place(self, length: int, source: int, cluster: int) -> int:
        """The number of the tightest compatible bin, or of a new one; `source` and `cluster` have one bit or none."""
        for r in self.successors(length):
            s, c = self.common[r]
            if s & source or c & cluster:
                continue
            for b in self.lists[r]:
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    self._move(b, r, r - length, source, cluster)
                    return b
        self.left.append(0)
        self.sources.append(0)
        self.clusters.append(0)
        self._move(b := len(self.left) - 1, None, self.capacity - length, source, cluster)
        return b

    def _move(self, b: int, old: int | None, new: int, source: int, cluster: int) -> None:
        if old is not None:
            own = self.lists[old]
            own.remove(b)
            if own:
                self._meet(old, own)
            else:
                self.residuals &= ~(1 << old)
        self.left[b] = new
        self.sources[b] |= source
        self.clusters[b] |= cluster
        if new:  # full bins are not searched again
            own = self.lists.setdefault(new, [])
            at = next((k for k, x in enumerate(own) if x > b), len(own))
            own.insert(at, b)
            self.common[new] = (self.sources[b], self.clusters[b]) if len(own) == 1 else (self.common[new][0] & self.sources[b], self.common[new][1] & self.clusters[b])
            self.residuals |= 1 << new

    def _meet(self, r: int, own: list[int]) -> None:
        s = c = -1
        for b in own:
            s &= self.sources[b]
            c &= self.clusters[b]
        self.common[r] = (s, c)


def pack_shard(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """bin and start of every piece of one shard."""
    pdf = pdf.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    bits = []
    for key in ("source", "cluster"):
        codes = pd.factorize(pdf[key])[0]  # nulls get -1
        bits.append([1 << int(c) if c >= 0 else 0 for c in codes])
    bins, out, start = Bins(capacity), [], []
    for n, s, c in zip(pdf["n_tokens"].tolist(), *bits, strict=True):
        b = bins.place(n, s, c)
        out.append(b)
        start.append(capacity - bins.left[b] - n)
    return pdf.assign(bin=np.array(out, np.int64), start=np.array(start, np.int64))


def pack_documents(docs: DataFrame, capacity: int = 2048, shard_rows: int = 4000, cluster: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """bin_id, start, doc_id, piece, n_tokens and the piece's first token in its document, for every piece.

    `cluster` tells duplicates apart (md5 of the text unless given) and `tokens` counts them (words and an end).
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.md5(F.coalesce("text", F.lit(""))) if cluster is None else cluster).cast("string").alias("cluster"),
        (F.size(words_of(F.col("text"))) + 1 if tokens is None else tokens).cast("long").alias("total"),
    )
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("total", F.lit(1)) - 1) / capacity))))
    pieces = pieces.withColumn("n_tokens", F.least(F.lit(capacity), F.col("total") - F.col("piece") * capacity).cast("long"))
    count = docs.count()
    shards = max(1, -(-count // shard_rows))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pack_shard(pdf, capacity)
        return out.assign(bin_id=out["shard"] * (1 << 32) + out["bin"], first_token=out["piece"] * capacity)[["bin_id", "start", "doc_id", "piece", "n_tokens", "first_token"]]

    return pieces.drop("total").groupBy("shard").applyInPandas(run, "bin_id long, start long, doc_id long, piece long, n_tokens long, first_token long")


def with_clusters(docs: DataFrame) -> DataFrame:
    """doc_id, source, total (words and an end) and cluster: the component of texts with similar sets of five-word shingles (0.8 or more)."""
    # texts without a word have no shingles: their copies meet by the text
    text = F.coalesce("text", F.lit(""))
    exact = F.when(~text.rlike(r"[^\x20\x09-\x0D]"), F.concat(F.lit("text "), F.md5(text)))
    found = jaccard_components(docs, width=5, percent=80, keep=[F.col("source").cast("string").alias("source"), exact.alias("exact")])
    found = stored(found.select("doc_id", "source", (F.col("n_words") + 1).alias("total"), "exact", "component_id"), "clusters")
    least = found.groupBy("doc_id").agg(F.min("component_id").alias("component"))
    return found.drop("component_id").join(least, "doc_id", "left").withColumn("cluster", F.coalesce("exact", F.col("component").cast("string")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_clusters(table(spark, sf_dir, "documents"))
    return pack_documents(docs, cluster=F.col("cluster"), tokens=F.col("total"))
