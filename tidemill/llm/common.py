"""Small helpers that the training-data operators share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemill.operators.components import folder as shared_dir
from tidemill.operators.components import written as stored

__all__ = ["GAP", "WORD", "ascii_lower", "batch", "columns", "crc_mod", "hashed_words", "joined_sha256", "known_words", "let", "mix", "shared_dir", "small_batches", "span_hashes", "stored", "table", "word_spans", "words_of", "WordHash"]

#: ASCII blanks; a word is a run of anything else.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A worker forgets its cached words beyond this many, so that its memory stays bounded.
CACHE_WORDS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Inside, Python workers get `rows` rows at a time instead of 10,000, as rows carry whole texts and bitmaps; another setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if before == "10000":
        spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def words_of(text: Column) -> Column:
    """ASCII-blank separated words; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string")) % n


#: What this worker process knows of words, for the model that it worked with last.
_KNOWN: dict[str, dict] = {}


def known_words(name: str, make: Callable[[], dict]) -> dict:
    """This worker's table of words for the model `name`; a new one if it served another model or is full."""
    if name not in _KNOWN or len(_KNOWN[name]) > CACHE_WORDS:
        _KNOWN.clear()
        _KNOWN[name] = make()
    return _KNOWN[name]


class WordHash(dict):
    """word bytes -> 64-bit hash, computed on first sight. A worker that hashes lets go of the words of former models."""

    def __init__(self):
        _KNOWN.clear()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS // 2:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    @staticmethod
    def split(text: str | None) -> list[bytes]:
        return text.encode("utf-8", "surrogatepass").lower().split() if text else []

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the words of a whole text; A-Z count as a-z. bytes.lower and bytes.split know ASCII only, as wanted."""
        words = self.split(text)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S1, _S2 = np.uint64(31), np.uint64(29)


def mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """An order-sensitive 64-bit hash of pairs."""
    with np.errstate(over="ignore"):
        x = a * _M1 + (b ^ (b >> _S1)) * _M2
        x ^= x >> _S2
        x *= _M1
        return x ^ (x >> _S1)


_R = np.random.default_rng(20)
#: A random number for each byte value, and an odd one for each place in a word.
_BYTES = _R.integers(0, 1 << 64, 256, np.uint64)
_PLACES = _R.integers(0, 1 << 64, 1 << 12, np.uint64) | np.uint64(1)
_GAPS = np.zeros(256, bool)
_GAPS[[9, 10, 11, 12, 13, 32]] = True


def word_spans(texts: list[str | None], gaps: np.ndarray = _GAPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of many texts (A-Z as a-z), start and size of every word, and how many words each text has.

    `gaps` tells the bytes that stand between words; a blank must be one.
    """
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = np.frombuffer(b" ".join(parts).lower() + b" ", np.uint8)
    gap = gaps[data]
    after = np.r_[True, gap[:-1]]
    starts = np.flatnonzero(~gap & after)
    sizes = np.flatnonzero(gap & ~after) - starts
    ends = np.cumsum([len(p) + 1 for p in parts])
    return data, starts, sizes, np.diff(np.r_[0, np.searchsorted(starts, ends)])


def span_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: the sum, over its bytes, of the byte's number times its place's, mixed with its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(firsts[-1] + sizes[-1]) - np.repeat(firsts, sizes)
    with np.errstate(over="ignore"):
        each = _BYTES[data[place + np.repeat(starts, sizes)]] * _PLACES[place & 4095]
        if sizes.max() > 4096:
            each *= (place >> 12 << 1 | 1).astype(np.uint64)
        return mix(np.add.reduceat(each, firsts), sizes.astype(np.uint64))


_BASE = int(_M1)
#: Powers of an odd number and of its inverse, modulo 2 ** 64, for that many bytes.
_RISING, _FALLING = [np.cumprod(np.full(1 << 19, x, np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
#: Longer words are hashed by span_hashes.
_LONG_WORD = 256


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of many texts, text by text (A-Z count as a-z), and how many words each text has.

    A word's hash is the polynomial of its bytes' numbers, a difference of running sums, mixed with its length.
    """
    data, starts, sizes, n = word_spans(texts)
    up, down = _RISING, _FALLING
    if len(data) > len(up):
        up, down = [np.cumprod(np.full(len(data), x[0], np.uint64)) for x in (up, down)]
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
        h = mix((sums[starts + sizes] - sums[starts]) * down[starts], sizes.astype(np.uint64))
    long = np.flatnonzero(sizes > _LONG_WORD)
    h[long] = span_hashes(data, starts[long], sizes[long])
    return h, n


def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """Arrow batches as lists of Python values by column, a thousand rows at a time."""
    for b in batches:
        for k in range(0, b.num_rows, 1000):
            yield [c.to_pylist() for c in b.slice(k, 1000).columns]


def batch(schema: pa.Schema, *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


#: Ids that are joined to one block of text.
ID_BLOCK = 4096


def joined_sha256(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    """keys, sha256: lowercase hex of each key's items (numbers or strings) in their order, comma-joined.

    A key may hold most rows: ranges of sorted items become blocks of text in parallel, and only these are streamed,
    in order, through the hash of their key.
    """
    rows = stored(rows.select(*keys, item), "items")
    names, kinds = rows.columns, dict(rows.dtypes)
    plain = to_arrow_schema(rows.schema)
    blocks, hashes = plain.append(pa.field("block", pa.string())), pa.schema([*[plain.field(k) for k in keys], ("sha256", pa.string())])
    ddl = ", ".join(f"`{c}` {kinds[c]}" for c in names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held = None, None, []
        for b in batches:
            out = []
            for *k, x in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if k != key or len(held) == ID_BLOCK:
                    if held:
                        out.append((*key, first, ",".join(held)))
                    key, first, held = k, x, []
                held.append(str(x))
            if out:
                yield batch(blocks, *zip(*out, strict=True))
        if held:
            yield batch(blocks, *zip(*[(*key, first, ",".join(held))], strict=True))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for b in batches:
            out = []
            for *k, _, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if k == key:
                    h.update(b"," + text.encode())
                else:
                    if key is not None:
                        out.append((*key, h.hexdigest()))
                    key, h = k, hashlib.sha256(text.encode())
            if out:
                yield batch(hashes, *zip(*out, strict=True))
        if key is not None:
            yield batch(hashes, *zip(*[(*key, h.hexdigest())], strict=True))

    ranged = rows.repartitionByRange(*keys, item).sortWithinPartitions(*keys, item)
    made = ranged.mapInArrow(join, f"{ddl}, block string").repartition(*keys).sortWithinPartitions(*keys, item)
    return made.mapInArrow(digest, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "sha256 string"]))
