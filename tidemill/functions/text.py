"""Scalar text functions as Spark columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Display types by extension, reader versions, skipped folders, glyph codes of old Thai fonts.
FILE_TYPES = {
    ".txt": "ข้อความ", ".md": "ข้อความ", ".csv": "ข้อความ", ".log": "ข้อความ",
    ".docx": "Word", ".doc": "Word",
    ".xlsx": "Excel", ".xlsm": "Excel", ".xls": "Excel",
    ".pptx": "PowerPoint", ".ppt": "PowerPoint",
    ".pdf": "PDF",
    ".png": "รูปภาพ", ".jpg": "รูปภาพ", ".jpeg": "รูปภาพ", ".tif": "รูปภาพ", ".tiff": "รูปภาพ", ".bmp": "รูปภาพ",
}
READER_VERSIONS = {".pdf": 2}
SKIP_DIRS = ("$RECYCLE.BIN", "System Volume Information", "node_modules", "__pycache__")
THAI_PUA = "ฐิีึื่้๊๋์่้๊๋์ญัํ็่้๊๋์ฺุู"
INVISIBLE = "​‌‍﻿­\u0000"
#: What counts as white space, spelled out since engines differ.
SPACE = "\t\n\x0b\x0c\r                  　﻿"
NAME_LOC = "ชื่อไฟล์"
TAG_LOC, OLD_TAG_LOCS = "ในภาพ (ป้าย)", ("ในภาพ (AI)",)
TAGGABLE = (".png", ".jpg", ".jpeg", ".bmp")

THAI_GLYPHS = "".join(chr(0xF700 + i) for i in range(len(THAI_PUA)))


#: Below U+0300 composition changes nothing.
HIGH = "[^\\x{0}-\\x{2ff}]"
#: Where the codes of old fonts and the invisible characters are; a text without any of these is not translated letter by letter.
ODD = "[^\\x{1}-\\x{ac}\\x{ae}-\\x{1fff}]"


@pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with further columns that are computed once per row, however often and wherever they are used after."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")).select("*", *[f"_once.{n}" for n in columns]).drop("_once")


def ext_of(name: Column) -> Column:
    """Lower-cased suffix from the last dot; '' when that is the first character or absent."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]*)\z", 1))


def file_type(ext: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FILE_TYPES.items() for x in kv]), ext), ext)


def in_pool(folder: Column, ext: Column, types: Column, wanted: Column) -> Column:
    """Whether a file is among those that a query asks for: its types (null or empty: all) and its folder (null: all)."""
    return (wanted.isNull() | (wanted == folder)) & (F.coalesce(F.size(types), F.lit(0)).isin(0, -1) | F.array_contains(types, file_type(ext)))


def reader_version(ext: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in READER_VERSIONS.items() for x in kv]), ext), F.lit(1))


def trim_space(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def glyphs(text: Column) -> Column:
    """Codes of old fonts as their letters, without invisible characters; '' for null."""
    return F.when(text.rlike(ODD), F.translate(text, THAI_GLYPHS + INVISIBLE, THAI_PUA)).otherwise(F.coalesce(text, F.lit("")))


def composed(text: Column) -> Column:
    """Canonical composition; a text without a character from U+0300 on goes around Python as a null."""
    return F.coalesce(nfc(F.when(text.rlike(HIGH), text)), text)


def tidied(text: Column) -> Column:
    """Vowels and tone marks in their order, runs of blanks as one, trimmed; for text that is composed."""
    x = F.replace(F.replace(text, F.lit("\u0e4d\u0e32"), F.lit("\u0e33")), F.lit("\u0e32\u0e4d"), F.lit("\u0e33"))
    x = F.regexp_replace(x, "\u0e33([\u0e48-\u0e4b])", "$1\u0e33")
    return trim_space(F.regexp_replace(x, "[ \t\u00a0]{2,}|[\t\u00a0]", " "))


def normalize_text(text: Column) -> Column:
    """The stored form of a text."""
    return tidied(composed(glyphs(text)))


def join_thai_lines(text: Column) -> Column:
    return F.regexp_replace(text, "(?<=[฀-๿])\n(?=[฀-๿])", "")


def query_terms(query: Column) -> Column:
    return F.filter(F.split(normalize_text(query), " "), lambda t: t != "")


def stem_of(name: Column) -> Column:
    """Name up to the last dot, if that is not the first character, normalized."""
    return normalize_text(F.regexp_replace(name, r"(?s)^(.+)\.[^.]*\z", "$1"))


def count_letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}"))


def first_position(low: Column, terms: Column) -> Column:
    """0-based position of the earliest term, 0 without any."""
    found = F.filter(F.transform(terms, lambda t: F.instr(low, t)), lambda p: p > 0)
    return F.coalesce(F.array_min(found) - 1, F.lit(0))


def make_snippet(text: Column, low: Column, terms: Column, width: int = 90) -> Column:
    def cut(at: Column) -> Column:
        start, end = F.greatest(F.lit(0), at - width), F.least(F.length(text), at + 2 * width)
        body = F.replace(F.substring(text, start + 1, end - start), F.lit("\n"), F.lit(" "))
        return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(end < F.length(text), "…").otherwise(""))

    return let(first_position(low, terms), cut)


def context_window(text: Column, low: Column, terms: Column, at: Column | None = None, before: int = 500, after: int = 1500) -> Column:
    """struct(text, cut_start, cut_end): the preview around the earliest term, or from position `at` on; null for a missing chunk."""
    pos = first_position(low, terms)
    start = F.greatest(F.lit(0), pos - before) if at is None else F.coalesce(at, F.greatest(F.lit(0), pos - before))
    end = F.least(F.length(text), F.when(at.isNotNull(), at + after).otherwise(pos + after) if at is not None else pos + after)
    return F.when(text.isNotNull(), F.struct(F.substring(text, start + 1, end - start).alias("text"), (start > 0).alias("cut_start"), (end < F.length(text)).alias("cut_end")))


def highlight_marks(text: Column, terms: Column) -> Column:
    """Every occurrence of any term in <mark>, longer terms first."""
    longest = F.array_sort(terms, lambda a, b: F.length(b) - F.length(a))
    pattern = F.array_join(F.transform(longest, lambda t: F.regexp_replace(t, r"([\\.*+?^${}()|\[\]])", r"\\$1")), "|")
    return F.when(F.size(terms) > 0, F.regexp_replace(text, F.concat(F.lit("(?iu)("), pattern, F.lit(")")), F.lit("<mark>$1</mark>"))).otherwise(text)


def format_size(size: Column) -> Column:
    kb = F.greatest(F.lit(1), F.floor(size / 1024 + 0.5)).cast("string")
    return F.when(size >= 1048576, F.format_string("%.1f MB", (size / 1048576).cast("double"))).otherwise(F.concat(kb, F.lit(" KB")))


def format_mtime(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "dd/MM/yyyy HH:mm")
