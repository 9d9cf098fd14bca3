"""Quality rules as a short-circuit cascade, in built-in SQL functions only.

Base columns are counted for every whole text. The other rules are measured on a sample of about `sample_rows` rows (by a
hash of the id) that pass the base: which rows each rejects, and the seconds that it takes over many repetitions, less
those of a job without a rule. They are then ordered greedily by rejection per cost, each rule's rejection among the rows
that the rules before it let pass, and run in that order, each only on rows that all before it let pass (CASE WHEN
evaluates lazily). The order changes the time, never the verdict.

Null and empty texts have no words, so the base rejects them. Repeated rows get equal values. Extra columns are
kept out. An empty table or sample keeps the order given. Windows of eight words are compared by 64-bit hashes.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import GAP, let, table, words_of

WINDOW = 8


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Number of words inside windows of `width` words that occur twice or more in the array."""

    def covered(windows: Column) -> Column:
        ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(ranked, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))), lambda x: x["i"])))
        steps = let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(width), F.get(p, i + 1) - x)), F.lit(0).cast("long"), lambda a, x: a + x))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(steps)

    def windows_of(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - width), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) >= width, let(hashed, lambda h: let(windows_of(h), covered))).otherwise(F.lit(0).cast("long"))


def base_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), words_of(F.col(text_col)).alias("words"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "doc_id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", GAP, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


@dataclass(frozen=True)
class Rule:
    """A name and the condition, never null, under which a row goes."""

    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    """Rules over the base columns and the text; cheap and dear ones alike, for the sample to order."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    left = lambda pattern: F.length(F.regexp_replace("text", pattern, ""))
    return [
        Rule("shouting", 100 * left(r"[^\p{Lu}]+") > 30 * F.col("word_chars")),
        Rule("exclaiming", 100 * left(r"[^!]+") > 30 * n),
        Rule("few_letters", 100 * left(r"[^\p{L}]+") < 50 * F.col("word_chars")),
        Rule("symbols", 100 * F.col("n_symbols") > 30 * n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n)),
        Rule("line_copies", 100 * F.col("n_dup_lines") > 30 * F.size(F.split("text", "\n"))),
    ]


def sampled(df: DataFrame, id_col: str, sample_rows: int) -> DataFrame:
    """About `sample_rows` rows, by a hash of the id."""
    step = max(1, df.count() // sample_rows)
    return df.where(F.pmod(F.xxhash64(id_col), F.lit(step)) == 0)


def measured(base: DataFrame, rules: list[Rule], repeats: int = 20) -> tuple[list[tuple[list[bool], int]], list[float]]:
    """Which rules reject together how many of the (cached) rows, and the seconds that each rule takes over repeated rows."""
    flags = [r.rejects.alias(f"r{k}") for k, r in enumerate(rules)]
    masks = [([bool(x) for x in row[:-1]], row[-1]) for row in base.select(*flags).groupBy(*[f"r{k}" for k in range(len(rules))]).count().collect()]
    many = base.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def seconds(condition: Column) -> float:
        took = []
        for _ in range(3):
            start = time.perf_counter()
            many.agg(F.count_if(condition)).first()
            took.append(time.perf_counter() - start)
        return sorted(took)[1]

    idle = seconds(F.col("n_words") < 0)
    return masks, [max(seconds(r.rejects) - idle, 1e-4) for r in rules]


def greedy(masks: list[tuple[list[bool], int]], costs: list[float], names: list[str]) -> list[int]:
    """The rules in order of rejections per cost among the rows that are left; ties by name."""
    left, order = list(range(len(costs))), []
    while left:
        rejected = lambda k: sum(n for m, n in masks if m[k])
        best = min(left, key=lambda k: (-rejected(k) / costs[k], names[k]))
        order.append(best)
        left.remove(best)
        masks = [(m, n) for m, n in masks if not m[best]]
    return order


def ordered_by_worth(base: DataFrame, rules: list[Rule]) -> list[Rule]:
    """The rules in the order that the rows of a sample (with base columns) call for."""
    rows = base.where("not base_failed").persist()
    try:
        if rows.isEmpty() or not rules:
            return rules
        masks, costs = measured(rows, rules)
    finally:
        rows.unpersist()
    return [rules[k] for k in greedy(masks, costs, [r.name for r in rules])]


def quality_cascade(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, sample_rows: int = 1000) -> DataFrame:
    """Base columns, base_failed and kept of every row."""
    base = base_columns(df, id_col, text_col)
    order = ordered_by_worth(base_columns(sampled(df, id_col, sample_rows), id_col, text_col), default_rules() if rules is None else rules)
    kept = F.when(F.col("base_failed"), False)
    for r in order:
        kept = kept.when(r.rejects, False)
    return base.withColumn("kept", kept.otherwise(True)).drop("text")


def op5_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(words) - 6)) AS pos, unnest(list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i:i + 7], ' '))) AS w
  FROM d WHERE len(words) >= 8
), twice AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, w) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT doc_id, sum(step) AS n FROM (
    SELECT doc_id, least(8, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) - pos, 8)) AS step FROM twice) GROUP BY doc_id
), b AS (
  SELECT d.doc_id, text, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, greatest(n_words, 1) AS n FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed
    OR 100 * length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) > 30 * word_chars
    OR 100 * length(regexp_replace(text, '[^!]+', '', 'g')) > 30 * n
    OR 100 * length(regexp_replace(text, '[^\p{L}]+', '', 'g')) < 50 * word_chars
    OR 100 * n_symbols > 30 * n
    OR word_chars < 2 * n OR word_chars > 20 * n
    OR 100 * n_dup_lines > 30 * len(string_split(text, chr(10)))) AS kept
FROM f
"""
