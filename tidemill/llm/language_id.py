"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams inside words (runs of letters, lower-cased, with their ends marked), as relative
frequencies times inverse document frequency. Weights come from follow-the-regularised-leader with elastic-net
penalties (the absolute-value part leaves most of them zero), and a held-back part of the sample sets the
temperature that turns scores into probabilities.

The weights are learned from a bounded sample of distinct labelled texts, `sample_rows` of each language by a hash of the
id, so that rare languages are learned too; the document frequencies count all training documents. A text is read whole;
as frequencies add up over words, each worker works a word out once. Letters are those of Unicode; numerals such as
fractions are none. Null texts and texts without letters get `und`
with score 0; so does every text when nothing could be learned. Equal scores go to the first language in text
order. Repeated rows are predicted alike; extra columns are kept out.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import CACHE_WORDS, batch, columns, crc_mod, known_words, table

DIMS = 1 << 15
#: Letters and the few numerals that are word characters but neither letters nor decimal digits.
RUNS = re.compile(r"[^\W\d_]+")
LONGEST = 40


def letter_runs(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    runs = RUNS.findall(text.lower())
    if all(map(str.isalpha, runs)):
        return runs
    return [w for run in runs for w in "".join(c if c.isalpha() else " " for c in run).split()]


class Grams(dict):
    """n-gram -> hashed number."""

    def __missing__(self, gram: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[gram] = n = zlib.crc32(gram.encode("utf-8", "surrogatepass")) % DIMS
        return n

    def of(self, word: str) -> list[int]:
        """Numbers of the 1- to 3-grams of one word; a word without end is read in pieces."""
        out: list[int] = []
        for k in range(0, len(word), LONGEST):
            w = f"_{word[k : k + LONGEST]}_"
            out += [self[w[i : i + n]] for n in (1, 2, 3) for i in range(len(w) - n + 1)]
        return out


class Model:
    """Languages, idf-scaled weights (n-gram by language), biases and temperature."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.weights, self.bias, self.temperature = langs, weights, bias, temperature

    def probabilities(self, totals: np.ndarray, n: float) -> np.ndarray:
        z = (totals / max(n, 1) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


class Words(dict):
    """word -> number of its row in `rows`: summed n-gram weights by language, then its number of n-grams."""

    def __init__(self, model: Model):
        self.model, self.grams, self.new, self.rows = model, Grams(), [], np.zeros((0, len(model.langs) + 1))

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def learn(self) -> None:
        grams = [self.grams.of(w) for w in self.new]
        sizes = np.array([len(g) for g in grams], np.int64)
        flat = np.fromiter((g for own in grams for g in own), np.int64, int(sizes.sum()))
        rows = np.zeros((len(grams), len(self.model.langs) + 1))
        if len(flat):
            rows[:, :-1] = np.add.reduceat(self.model.weights[flat], np.cumsum(sizes) - sizes)
            rows[:, -1] = sizes
        self.rows, self.new = np.concatenate([self.rows, rows]), []


def predict_texts(model: Model, name: str, texts: list[str | None]) -> tuple[list[str], list[float]]:
    known = known_words(name, lambda: Words(model))
    bags = [np.fromiter(map(known.__getitem__, w), np.int64, len(w)) for w in (letter_runs(t) if t else [] for t in texts)]
    if known.new:
        known.learn()
    langs, scores = [], []
    for b in bags:
        if not len(b):
            langs.append("und")
            scores.append(0.0)
            continue
        total = known.rows[b].sum(0)
        p = model.probabilities(total[:-1], total[-1])
        k = int(np.argmax(p))
        langs.append(model.langs[k])
        scores.append(float(p[k]))
    return langs, scores


def frequencies(docs: DataFrame) -> DataFrame:
    """id, lang, at, n: n-gram counts of each text and, as a second row, of up to eight words from its middle."""
    schema = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for ids, langs, texts in columns(batches):
            rows = []
            for i, lang, text in zip(ids, langs, texts, strict=True):
                words = letter_runs(text)
                for part in (words, words[len(words) // 2 :][:8]):
                    at, n = np.unique([g for w in part for g in grams.of(w)], return_counts=True)
                    if len(at):
                        rows.append((i, lang, at.astype(np.int32), n.astype(np.int32)))
            yield batch(schema, *(zip(*rows, strict=True) if rows else [[]] * 4))

    return docs.select("id", "lang", "text").mapInArrow(run, "id long, lang string, at array<int>, n array<int>")


class Slots:
    """Numbers of all n-grams of a text at once: characters are numbered as they come, up to ALPHABET, and n-grams by theirs.

    Words with characters beyond those are worked out one by one.
    """

    ALPHABET = 128

    def __init__(self):
        self.grams, self.chars = Grams(), ["_"]
        self.ids = np.full(0x110000, -1, np.int16)  # -1: not seen yet, -2: beyond, -3: between words
        self.ids[0], self.ids[ord("_")] = -3, 0
        self.tables = [np.full(self.ALPHABET**n, -1, np.int32) for n in (1, 2, 3)]

    def number(self, codes: np.ndarray) -> np.ndarray:
        ids = self.ids[codes]
        if (ids == -1).any():
            for c in np.unique(codes[ids == -1]).tolist():
                if len(self.chars) < self.ALPHABET:
                    self.ids[c] = len(self.chars)
                    self.chars.append(chr(c))
                else:
                    self.ids[c] = -2
            ids = self.ids[codes]
        return ids.astype(np.int64)

    def spell(self, gram: int, n: int) -> str:
        return "".join(self.chars[gram // self.ALPHABET**k % self.ALPHABET] for k in range(n - 1, -1, -1))

    def mark(self, runs: list[str], seen: np.ndarray) -> None:
        """Sets `seen` at the numbers of the n-grams of some words."""
        if max(map(len, runs)) > LONGEST:
            runs = [w[k : k + LONGEST] for w in runs for k in range(0, len(w), LONGEST)]
        text = "_" + "_\0_".join(runs) + "_"
        ids = self.number(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
        if (ids == -2).any():
            odd = {w for w in runs if any(self.ids[ord(c)] == -2 for c in w)}
            for w in odd:
                seen[self.grams.of(w)] = True
            runs = [w for w in runs if w not in odd]
            if not runs:
                return
            return self.mark(runs, seen)
        gram, ok = np.zeros(len(ids), np.int64), np.ones(len(ids), bool)
        for n, table in enumerate(self.tables, 1):
            last = len(ids) - n + 1
            gram, ok = gram[:last] * self.ALPHABET + ids[n - 1 :], ok[:last] & (ids[n - 1 :] >= 0)
            own = gram[ok]
            slots = table[own]
            if (slots < 0).any():
                new = np.unique(own[slots < 0])
                table[new] = [self.grams[self.spell(g, n)] for g in new.tolist()]
                slots = table[own]
            seen[slots] = True


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts have each n-gram, and how many have any; tasks add up DIMS counts, and no more reach the driver."""
    schema = pa.schema([("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, counts = Slots(), np.zeros(DIMS + 1, np.int64)
        for (some,) in columns(batches):
            for text in some:
                if runs := letter_runs(text):
                    seen = np.zeros(DIMS + 1, bool)
                    slots.mark(runs, seen)
                    seen[DIMS] = True
                    counts += seen
        at = np.flatnonzero(counts).astype(np.int32)
        yield batch(schema, [at], [counts[at]])

    parts = texts.mapInArrow(run, "at array<int>, n array<bigint>").select(F.explode(F.arrays_zip("at", "n")).alias("e"))
    out = np.zeros(DIMS + 1, np.int64)
    for r in parts.groupBy("e.at").agg(F.sum("e.n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out[:DIMS], int(out[DIMS])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-4, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of follow-the-regularised-leader, one example at a time in seeded order."""
    z, n = np.zeros((DIMS + 1, k)), np.zeros((DIMS + 1, k))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        free = (at == DIMS)[:, None]  # the bias is not penalised
        shrunk = np.where(free, zz, np.sign(zz) * np.maximum(np.abs(zz) - l1, 0))
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, DIMS), np.append(x, 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(DIMS + 1))
    return w[:-1], w[-1]


def train_language(docs: DataFrame, sample_rows: int = 300, scale: float = 100.0) -> Model | None:
    """A model from (doc_id, lang, text) rows; null texts and languages are left out."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "lang", "text")
    # the first document stands for all copies of a text
    single = usable.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("id").alias("id"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "h")
    chosen = single.withColumn("r", F.row_number().over(first)).where(F.col("r") <= sample_rows).select("lang", "id", "h")
    own = usable.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "id", "h"]).dropDuplicates(["lang", "id", "h"])
    rows = frequencies(own).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), len(r["at"]), r["lang"], r["at"]))
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    df, n_docs = document_frequencies(usable.select("text"))
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    made = [(at := np.array(r["at"]), scale * np.array(r["n"]) / sum(r["n"]) * idf[at] / 10, langs.index(r["lang"])) for r in rows]
    held = max(1, len(made) // 5)
    w, b = ftrl(made[held:] or made, len(langs))
    logits = np.array([x @ w[at] + b for at, x, _ in made[:held]])
    y = np.array([y for _, _, y in made[:held]])

    def loss(t: float) -> float:
        s = logits / t
        s -= s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))

    temperature = min((2.0**e for e in np.arange(-2, 4.01, 0.125)), key=loss)
    return Model(langs, w * (idf * scale / 10)[:, None], b, temperature)


def identify_language(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each whole text."""
    schema, name = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())]), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in columns(batches):
            langs, scores = [], []
            for i in range(0, len(texts), 500):
                some = texts[i : i + 500]
                found = predict_texts(model, name, some) if model else (["und"] * len(some), [0.0] * len(some))
                langs += found[0]
                scores += found[1]
            yield batch(schema, ids, langs, scores)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_language(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    return identify_language(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
