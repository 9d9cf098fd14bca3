"""Toxicity: a subsequence string-kernel machine with Nystroem landmarks over the words of a text.

The kernel counts common character subsequences of two words, gaps costing a factor each, so that inserted,
dropped or spaced-out characters lower the similarity a little instead of to nothing. Landmark words give each
word coordinates in which a linear machine with hinge loss is trained; a text's margin is that of its worst
word plus half of the next one's, and a logistic curve maps margins to 0..1.

Training: labels mark documents, so the sentences of a toxic one are a bag of which some word is a witness, and every
word of a clean one is a negative. The sample is bounded (`max_toxic` and `max_clean` distinct texts, taken by a hash of
the id; null labels left out). First witnesses come from counts: between how many pairs of neighbours each word occurs
in toxic and in clean documents (set phrases and near copies add little that way), far beyond chance. Then witnesses and
machine alternate, `rounds` times: each toxic bag names the word of its worst sentence that the machine finds worst, if
it is on the toxic side and clean documents hardly have it, and the machine is fitted anew to those, with copies that
have characters inserted, against the clean words that come nearest. At most `max_words` of either kind reach the driver.

Words are ASCII-blank separated, lower-cased, without outer punctuation; a run of three or more single characters with single
spaces between also counts as the word they spell, a word with inner marks also as the word without them; a word above 24 characters is read in overlapping windows. Null, empty and
wordless texts score as the weakest margin (label 0). Repeated rows score alike, extra columns are kept out, and
without any usable label every text scores 0.
"""

from __future__ import annotations

import random
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import GAP, batch, columns, crc_mod, known_words, table

LONGEST, WEAKEST = 24, -3.0
#: Gaps cost DECAY for each character spanned; subsequences of three span at most 4 characters, those of four at most 6.
DECAY = 0.7
STEPS = [(d1, d2, 0) for d1 in (1, 2) for d2 in (1, 2) if d1 + d2 <= 3] + [(d1, d2, d3) for d1 in (1, 2, 3) for d2 in (1, 2, 3) for d3 in (1, 2, 3) if d1 + d2 + d3 <= 5]
#: Stands before each word; subsequences that hold it weigh ANCHOR times as much, as stems count more than endings.
START, ANCHOR = "^", 2.5
OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»“”„‘’…"


INNER = re.compile(r"[\W_]+")


class Alphabet:
    """Characters of the landmarks as numbers from 1; any other is 0 and matches nothing. A key holds four of them."""

    def __init__(self, marks: Iterable[str]):
        chars = sorted({c for m in marks for c in START + m})
        self.bits, self.kind = (8, np.uint32) if len(chars) < 255 else (16, np.uint64)
        self.table = np.zeros(max(map(ord, chars)) + 2, self.kind)
        for i, c in enumerate(chars):
            self.table[ord(c)] = i + 1

    def codes(self, words: list[str]) -> np.ndarray:
        """One column per word, START first."""
        sizes = np.array([len(w) for w in words], np.int64)
        out = np.zeros((int(sizes.max(initial=0)) + 1, len(words)), self.kind)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        out[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1, np.repeat(np.arange(len(words)), sizes)] = self.table[np.minimum(flat, len(self.table) - 1)]
        out[0] = self.table[ord(START)]
        return out

    def known(self, key: int) -> bool:
        """Whether all four characters of a key are the landmarks'."""
        return all(key >> self.bits * k & (1 << self.bits) - 1 for k in range(4))


def subsequences(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, weights): a row for each place and way to step, a column for each word. Keys with an unknown character match no landmark."""
    keys, weights, n = [], [], len(codes)
    shift = [codes.dtype.type(bits * k) for k in range(4)]
    for d1, d2, d3 in STEPS:
        m = n - d1 - d2 - d3
        if m <= 0:
            continue
        last = codes[d1 + d2 + d3 :] if d3 else codes.dtype.type((1 << bits) - 1)
        keys.append(codes[:m] | codes[d1 : d1 + m] << shift[1] | codes[d1 + d2 : d1 + d2 + m] << shift[2] | last << shift[3])
        w = np.full(m, DECAY ** (d1 + d2 + d3 - (3 if d3 else 2)))
        w[0] *= ANCHOR
        weights.append(w)
    return (np.concatenate(keys), np.concatenate(weights)) if keys else (np.zeros((0, codes.shape[1]), codes.dtype), np.zeros(0))


def lengths_norm(words: list[str]) -> np.ndarray:
    """Square root of the summed squared weights of a word's subsequences, which hangs on its length alone."""
    by = np.zeros(LONGEST + 2)
    for n in range(LONGEST + 2):
        by[n] = sum((n - sum(d) + ANCHOR**2 if n >= sum(d) else 0) * DECAY ** (2 * (sum(d) - (3 if d[2] else 2))) for d in STEPS)
    return np.sqrt(np.maximum(by[np.minimum([len(w) for w in words], LONGEST + 1)], 1e-9)) if words else np.zeros(0)


class Landmarks:
    """Landmark words with their subsequences: key k has weight `weights[i, j]` in landmark j, where keys[i] = k."""

    def __init__(self, marks: Iterable[str]):
        self.words = tuple(marks)
        self.alphabet = Alphabet(self.words)
        found = [{} for _ in self.words]
        keys, weights = subsequences(self.alphabet.codes(list(self.words)), self.alphabet.bits)
        for own, column in zip(found, keys.T.tolist(), strict=True):
            for k, w in zip(column, weights.tolist(), strict=True):
                if self.alphabet.known(k):
                    own[k] = own.get(k, 0.0) + w
        self.keys = np.array(sorted({k for own in found for k in own}), self.alphabet.kind)
        at = {k: i for i, k in enumerate(self.keys.tolist())}
        self.weights = np.zeros((len(self.keys), len(self.words)))
        for j, own in enumerate(found):
            for k, v in own.items():
                self.weights[at[k], j] = v
        self.weights /= lengths_norm(list(self.words))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self._slot(self.keys)] = True

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            if keys.dtype == np.uint32:
                return keys * np.uint32(2654435761) >> np.uint32(12)
            return keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)

    def hits(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word number, key number, weight) of all subsequences that some landmark has."""
        keys, weights = subsequences(self.alphabet.codes(words), self.alphabet.bits)
        place, word = np.nonzero(self.seen[self._slot(keys)]) if len(self.keys) else (np.zeros(0, int),) * 2
        live = keys[place, word]
        at = np.minimum(np.searchsorted(self.keys, live), max(len(self.keys) - 1, 0))
        right = self.keys[at] == live
        return word[right], at[right], weights[place[right]]

    def similarity(self, words: list[str]) -> np.ndarray:
        """Normalised kernel of words (rows) with landmarks (columns)."""
        out, n = np.zeros((len(words), len(self.words))), len(self.keys)
        for i in range(0, len(words), 200):
            some = words[i : i + 200]
            word, at, weight = self.hits(some)
            out[i : i + len(some)] = np.bincount(word * n + at, weight, len(some) * n).reshape(len(some), n) @ self.weights
        return out / lengths_norm(words)[:, None]


class Machine:
    """Margin of a word: its similarities to the landmarks, weighted by `dual`, plus `bias`; `probability` maps margins to 0..1."""

    def __init__(self, marks: Landmarks, dual: np.ndarray, bias: float, slope: float = 2.0, shift: float = 0.0):
        self.marks, self.dual, self.bias, self.slope, self.shift = marks, dual, bias, slope, shift
        self.weight = marks.weights @ dual

    def margins(self, words: list[str]) -> np.ndarray:
        word, at, weight = self.marks.hits(words)
        return np.bincount(word, weight * self.weight[at], len(words)) / lengths_norm(words) + self.bias

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60))))

    def __reduce__(self):
        return _machine, (self.marks.words, self.dual, self.bias, self.slope, self.shift)


def _machine(words: tuple[str, ...], *rest) -> Machine:
    return Machine(Landmarks(words), *rest)


SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)")
SPELLED = re.compile(r" \w \w \w\s")


def tokens(text: str | None) -> list[str]:
    """Lower-cased tokens, and the words that runs of three or more single characters spell."""
    out = text.lower().split() if text else []
    if text and SPELLED.search(f" {text} "):
        run: list[str] = []
        for t in [*out, ""]:
            if len(t) == 1 and t.isalnum():
                run.append(t)
            else:
                if len(run) > 2:
                    out.append("".join(run))
                run = []
    return out


def readings(token: str) -> list[str]:
    """The words that the machine reads in a token: without outer marks, and without inner ones, in windows where long."""
    w = token.strip(OUTER)
    words = [w] if w.isalnum() else [w, INNER.sub("", w)]
    return [x[i : i + LONGEST] for x in words if len(x) > 2 for i in range(0, max(1, len(x) - LONGEST // 2), LONGEST // 2 if len(x) > LONGEST else len(x))]


class Known(dict):
    """token -> number of its margin; tokens seen for the first time wait in `new`."""

    def __init__(self):
        self.margins, self.new = np.zeros(0), []

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        self.new.append(token)
        return n

    def learn(self, machine: Machine) -> None:
        parts = sorted(((r, i) for i, t in enumerate(self.new) for r in readings(t)), key=lambda x: len(x[0]))
        out = np.full(len(self.new), WEAKEST)
        for k in range(0, len(parts), 2048):
            some = parts[k : k + 2048]
            np.maximum.at(out, [i for _, i in some], machine.margins([r for r, _ in some]))
        self.margins = np.concatenate([self.margins, out])
        self.new = []


def text_margins(machine: Machine | None, name: str, texts: list[str | None]) -> list[float]:
    """Margin of the worst word, plus half that of the next worst where it is above 0. `name` names the machine."""
    if not machine:
        return [WEAKEST] * len(texts)
    known = known_words(name, Known)
    bags = [np.fromiter(map(known.__getitem__, s), np.int64, len(s)) for s in (set(tokens(t)) for t in texts)]
    known.learn(machine)
    out = []
    for b in bags:
        m = known.margins[b]
        top = m.max(initial=WEAKEST)
        more = np.sort(m[m > 0])[-2:-1] if top > 0 else ()
        out.append(float(top + 0.5 * more[0]) if len(more) else float(top))
    return out


def corrupted(word: str, seed: int) -> list[str]:
    """The word with separators put in, a letter doubled, and a letter replaced by a mark."""
    r = random.Random(f"{seed}:{word}")
    at = r.randrange(1, max(2, len(word) - 1))
    mark = r.choice("*.-_")
    return [mark.join(word[:8]) + word[8:], word[:at] + word[at - 1] + word[at:], word[:at] + mark + word[at:], word[:at] + mark + word[at + 1 :]]


def fit_machine(toxic: list[tuple[str, float]], clean: list[tuple[str, float]], n_landmarks: int = 144, rounds: int = 60, cost: float = 1e4, seed: int = 7) -> Machine | None:
    """Squared-hinge machine in Nystroem coordinates; toxic and clean are words with weights."""
    if not toxic or not clean:
        return None
    positives = [w for w, _ in toxic]
    known = set(positives)
    copies = [c[:LONGEST] for w in positives for c in corrupted(w, seed) if c not in known]
    weigh = dict(clean)
    negatives = [w for w in weigh if w not in known]
    words = positives + copies + negatives
    y = np.array([1.0] * (len(positives) + len(copies)) + [-1.0] * len(negatives))
    weight = np.concatenate([np.log1p([n for _, n in toxic]), np.full(len(copies), 0.5), np.log1p([weigh[w] for w in negatives])])
    weight = weight / np.where(y > 0, weight[y > 0].sum(), max(weight[y < 0].sum(), 1e-9)) * len(y) / 2
    # landmarks: each next one is frequent and unlike those before it; two in three are witnesses, the rest clean words
    marks: list[str] = []
    for pool, n, worth in ((positives[:800], n_landmarks * 2 // 3, dict(toxic)), (negatives[:800], n_landmarks // 3, weigh)):
        best, value = np.zeros(len(pool)), np.log1p([worth[w] for w in pool])
        for _ in range(min(n, len(pool))):
            k = int(np.argmax(value * (1 - best)))
            if best[k] >= 0.999:
                break
            marks.append(pool[k])
            best = np.maximum(best, Landmarks([pool[k]]).similarity(pool)[:, 0])
            best[k] = 1
    own = Landmarks(marks)
    k, core = own.similarity(words), own.similarity(marks)
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    whiten = vectors / np.sqrt(np.maximum(values, 1e-3))
    z = np.hstack([k @ whiten, np.ones((len(words), 1))])
    v, reg = np.zeros(z.shape[1]), np.eye(z.shape[1]) / cost
    reg[-1, -1] = 1e-6
    for _ in range(rounds):  # Newton steps on the rows inside the margin
        live = y * (z @ v) < 1
        zw = z[live] * weight[live, None]
        new = np.linalg.solve(zw.T @ z[live] + reg, zw.T @ y[live])
        if np.allclose(new, v, atol=1e-9):
            break
        v = new
    return Machine(own, whiten @ v[:-1], float(v[-1]))


def fit_curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve by Newton steps, with smoothed targets."""
    if not len(y) or y.min() == y.max():
        return 2.0, 0.0
    target = np.where(y > 0, 1 - 1 / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    share = np.full(len(y), 1 / len(y))
    x, p = np.stack([margins, np.ones(len(y))], 1), np.array([1.0, 0.0])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        grad = x.T @ ((q - target) * share) + 1e-4 * p
        hess = (x * (q * (1 - q) * share)[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        p = p - step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(p[0]), float(p[1])


def train_toxicity(docs: DataFrame, labels: DataFrame, max_toxic: int = 1500, max_clean: int = 6000, max_words: int = 3000, min_docs: int = 4, rounds: int = 2) -> Machine | None:
    """A machine from the labelled documents; all but the counts per word stays in Spark."""
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    marked = labels.where(F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    # the first document stands for all copies of a text, so that they neither fill the sample nor count again
    single = texts.select("doc_id", "h").join(marked, "doc_id").groupBy("toxic", "h").agg(F.min("doc_id").alias("doc_id"))
    by_hash = lambda v, n: single.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(n)
    chosen = by_hash(1, max_toxic).unionByName(by_hash(0, max_clean))
    sample = texts.join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["toxic", "h"]).select("doc_id", "text", "toxic").persist()
    try:
        sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if len(sizes) < 2:
            return None
        # a word counts once for each pair of neighbours it is seen between, so that near copies and set phrases add little
        sentences = sample.select("toxic", F.explode(F.split(F.lower("text"), r"[.!?\n]+")).alias("sentence")).select("toxic", F.split("sentence", GAP).alias("ws"))
        seen = F.transform("ws", lambda w, i: F.struct(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("w"), F.xxhash64(F.get("ws", i - 1), F.get("ws", i + 1)).alias("near")))
        words = sentences.select("toxic", F.explode(seen).alias("x")).select("toxic", "x.w", "x.near").where(F.length("w").between(3, LONGEST))
        places = words.distinct().groupBy("w", "toxic").agg(F.count("*").alias("places"))
        by = lambda v, c: F.sum(F.when(F.col("toxic") == v, F.col(c)).otherwise(0)).cast("double")
        counts = places.groupBy("w").agg(by(1, "places").alias("t"), by(0, "places").alias("c")).persist()
        rate = sizes[1] / sizes[0]
        witness = counts.where((F.col("t") >= min_docs) & (F.col("t") > 8 * rate * (F.col("c") + 0.25)))
        worth = F.col("t") * F.log((F.col("t") + 0.5) / (rate * F.col("c") + 0.5))
        first = [(r["w"], r["t"]) for r in witness.where(worth >= 9).orderBy(worth.desc(), "w").limit(max_words).collect()]
        plain = counts.where((F.col("c") >= 1) & (F.col("t") <= 3 * rate * (F.col("c") + 0.5)))
        # the frequent clean words first, then twice those that come nearest to the margin, of all
        clean = {r["w"]: r["c"] for r in plain.orderBy(F.col("c").desc(), "w").limit(max_words).collect()}
        machine = fit_machine(first, list(clean.items()))
        if machine is None:
            return None
        for _ in range(rounds):
            named = witnesses(sample.where("toxic = 1"), machine).groupBy("w").agg(F.count("*").cast("double").alias("n"))
            named = named.join(counts.select("w", "c"), "w", "left").where(F.col("n") > 8 * rate * (F.coalesce("c", F.lit(0.0)) + 0.25))
            new = {r["w"]: r["n"] for r in named.orderBy(F.col("n").desc(), "w").limit(max_words).collect()}
            toxic = [*first, *[(w, n) for w, n in new.items() if w not in dict(first)]]
            nearest = word_margins(plain, machine).orderBy(F.col("margin").desc(), "w").limit(max_words).collect()
            clean |= {r["w"]: r["c"] for r in nearest}
            machine = fit_machine(toxic, list(clean.items()))
        counts.unpersist()
        found = margins_of(sample, machine, keep=("toxic",)).select("margin", "toxic").collect()
        slope, shift = fit_curve(np.array([r["margin"] for r in found]), np.array([float(r["toxic"]) for r in found]))
    finally:
        sample.unpersist()
    return Machine(machine.marks, machine.dual, machine.bias, slope, shift)


def word_margins(words: DataFrame, machine: Machine) -> DataFrame:
    """w, c and margin of each word."""
    schema = pa.schema([("w", pa.string()), ("c", pa.float64()), ("margin", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ws, cs in columns(batches):
            yield batch(schema, ws, cs, machine.margins(ws))

    return words.select("w", "c").mapInArrow(run, "w string, c double, margin double")


def witnesses(docs: DataFrame, machine: Machine) -> DataFrame:
    """w: of each text, the word of its worst sentence that the machine finds worst, if that is on the toxic side."""
    schema = pa.schema([("w", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in columns(batches):
            bags = [list({r for s in SENTENCE.split(t) for w in tokens(s) for r in readings(w)}) for t in texts]
            margins = np.concatenate([machine.margins(b[i : i + 2048]) for b in bags for i in range(0, len(b), 2048)] or [np.zeros(0)])
            parts = np.split(margins, np.cumsum([len(b) for b in bags])[:-1])
            yield batch(schema, [b[int(np.argmax(m))] for b, m in zip(bags, parts, strict=True) if len(m) and m.max() > 0])

    return docs.select("text").mapInArrow(run, "w string")


def margins_of(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text", keep: Iterable[str] = ()) -> DataFrame:
    """id, `keep` columns (int), margin and score of each whole text."""
    keep, name = list(keep), uuid.uuid4().hex
    schema = pa.schema([("doc_id", pa.int64()), *[(k, pa.int32()) for k in keep], ("margin", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, *rest in columns(batches):
            margins: list[float] = []
            for i in range(0, len(texts), 500):
                margins += text_margins(machine, name, texts[i : i + 500])
            yield batch(schema, ids, *rest, margins, [machine.probability(m) if machine else 0.0 for m in margins])

    ddl = ", ".join(["doc_id long", *[f"{k} int" for k in keep], "margin double", "score double"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(k).cast("int").alias(k) for k in keep]).mapInArrow(run, ddl)


def score_toxicity(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id, score and predicted (1 at a score of 0.5 or more)."""
    return margins_of(docs, machine).select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def trained(spark: SparkSession, sf_dir: str) -> Machine | None:
    """The machine learned from labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0)
    return train_toxicity(table(spark, sf_dir, "documents"), labels)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), trained(spark, sf_dir))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
