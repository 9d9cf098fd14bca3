"""Mixing sources to target weights: hierarchical budgets over a domain, language, source tree.

Every leaf supplies its tokens times `max_epochs`. A budget goes down the tree level by level: siblings share their
parent's budget by weight; one whose subtree supplies less than its share takes all of it, and what is left goes to its
siblings by weight again. A subtree's supply bounds its share, so a shortage reaches the ancestors' siblings only
when all siblings are full. A leaf with budget B takes as many whole epochs as fit, and then the documents that
start before the rest is used up, in an order seeded by epoch (md5 of seed, epoch and doc_id): a token-prefix in
whole documents.

Weights default to supply to the power `alpha`; `weights` overrides by node name ('web', 'web/en', 'web/en/src1').
The prefix is found by token sums over 4,096 ranges of the hash, then inside the one range where the budget ends,
so no leaf is collected. Ties of the hash go by doc_id, repeated ids fall together.

Null language or source counts as 'unknown'. Null, empty and blank texts have no tokens: they count as one token, so that each takes
part. Extra columns are kept out. An empty table gives an empty result. A weight of 0 gets budget only from nobody.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import stored, table, words_of

LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """The default domain of a source: its number modulo 4, as 'd0' to 'd3'; 'unknown' without one."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.try_cast("int") % 4).cast("string"))).otherwise("unknown")


def shares(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """`budget` of each of the siblings in `nodes` (parent columns, `name`, supply, weight, parent_budget).

    Filled in order of supply per weight: a node is full when the rest of the budget, shared by the weights that are
    left, would give it its supply or more.
    """
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    by = w.orderBy(F.when(F.col("weight") > 0, F.col("supply") / F.col("weight")).otherwise(float("inf")), name)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("used", F.coalesce(F.sum("supply").over(before), F.lit(0.0))).withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    nodes = nodes.withColumn("left_weight", F.sum("weight").over(w) - F.col("gone"))
    level = F.when(F.col("left_weight") > 1e-12, (F.col("parent_budget") - F.col("used")) / F.col("left_weight")).otherwise(0.0)
    nodes = nodes.withColumn("level", level).withColumn("full", (F.col("weight") > 0) & (F.col("supply") <= F.col("level") * F.col("weight")))
    # the level of the first node that is not full holds for it and all after it
    water = F.min(F.when(~F.col("full"), F.struct(F.when(F.col("weight") > 0, F.col("supply") / F.col("weight")).otherwise(float("inf")).alias("k"), F.col(name).alias("k2"), "level"))).over(w)["level"]
    budget = F.when(F.col("full"), F.col("supply")).otherwise(F.greatest(F.lit(0.0), F.least(F.col("supply"), water * F.col("weight"))))
    return nodes.withColumn("budget", budget).drop("used", "gone", "left_weight", "level", "full")


def budgets(leaves: DataFrame, fraction: float, max_epochs: int, alpha: float, weights: Mapping[str, float] | None) -> DataFrame:
    """domain, lang, source, tokens and budget of every leaf of (domain, lang, source, tokens)."""
    given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
    leaves = leaves.withColumn("supply", F.col("tokens") * float(max_epochs))
    above = leaves.groupBy().agg((F.sum("tokens") * fraction).alias("parent_budget"))
    out = None
    for depth, name in enumerate(LEVELS):
        parent, keys = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*keys).agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens"))
        default = F.pow(F.col("tokens").cast("double"), F.lit(alpha))
        weight = F.coalesce(F.try_element_at(given, F.concat_ws("/", *keys)), default) if weights else default
        nodes = nodes.withColumn("weight", weight)
        nodes = nodes.join(out.select(*parent, F.col("budget").alias("parent_budget")), parent) if depth else nodes.join(F.broadcast(above))
        out = shares(nodes, parent, name)
    return out.select(*LEVELS, "tokens", "budget")


def mix_sources(docs: DataFrame, fraction: float = 0.8, max_epochs: int = 2, alpha: float = 0.7, weights: Mapping[str, float] | None = None, seed: int = 17, domain: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and epochs (how often it is taken, at least once) of the selected rows."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (domain_of(F.col("source")) if domain is None else domain).alias("domain"),
        F.coalesce("lang", F.lit("unknown")).alias("lang"),
        F.coalesce("source", F.lit("unknown")).alias("source"),
        F.greatest(F.size(words_of(F.col("text"))), F.lit(1)).cast("long").alias("n_tokens"),
    )
    rows = stored(rows, "tokens")
    leaves = stored(budgets(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), fraction, max_epochs, alpha, weights), "budgets")
    leaves = leaves.withColumn("whole", F.floor(F.col("budget") / F.col("tokens"))).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    keys = list(LEVELS)
    rows = rows.join(leaves.select(*keys, "whole", "rest"), keys)
    rows = rows.withColumn("at", F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("whole") + 1).cast("string"), F.col("doc_id").cast("string"))))
    rows = rows.withColumn("range", F.substring("at", 1, 3))
    sums = rows.groupBy(*keys, "range").agg(F.sum("n_tokens").alias("n"))
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(sums, [*keys, "range"])
    inside = rows.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))
    order = Window.partitionBy(*keys, "range").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("taken", (F.col("before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0)) < F.col("rest")).cast("int"))
    outside = rows.where(~((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") > F.col("rest")))).withColumn("taken", (F.col("before") < F.col("rest")).cast("int"))
    both = inside.unionByName(outside).withColumn("epochs", (F.col("whole") + F.col("taken")).cast("long"))
    return both.where("epochs > 0").select("doc_id", *LEVELS, "n_tokens", "epochs")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def _level_sql(depth: int) -> str:
    keys, parent = ", ".join(LEVELS[: depth + 1]), list(LEVELS[:depth])
    over = f"PARTITION BY {', '.join(parent)}" if parent else ""
    name, up = LEVELS[depth], f"JOIN b{depth - 1} u USING ({', '.join(parent)})" if depth else "CROSS JOIN (SELECT sum(tokens) * CAST(0.8 AS DOUBLE) AS budget FROM leaves) u"
    return f"""
n{depth} AS (
  SELECT {', '.join(f'n.{k}' for k in LEVELS[: depth + 1])}, n.supply, n.tokens, pow(n.tokens, 0.7) AS weight, u.budget AS parent_budget
  FROM (SELECT {keys}, sum(tokens) * 2.0::DOUBLE AS supply, CAST(sum(tokens) AS DOUBLE) AS tokens FROM leaves GROUP BY {keys}) n {up}
), o{depth} AS (
  SELECT *, parent_budget - coalesce(sum(supply) OVER ({over} ORDER BY supply / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_budget,
    sum(weight) OVER ({over}) - coalesce(sum(weight) OVER ({over} ORDER BY supply / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight
  FROM n{depth}
), f{depth} AS (
  SELECT *, CASE WHEN left_weight > 1e-12 THEN left_budget / left_weight ELSE 0 END AS level FROM o{depth}
), b{depth} AS (
  SELECT {keys}, tokens, CASE WHEN supply <= level * weight THEN supply ELSE greatest(0, least(supply,
    weight * (first_value(CASE WHEN supply > level * weight THEN level END IGNORE NULLS) OVER ({over} ORDER BY supply / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))) END AS budget
  FROM f{depth}
)"""


OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) <> '' THEN 'd' || CAST(CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4 AS VARCHAR) ELSE 'unknown' END AS domain,
    CAST(greatest(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 1) AS BIGINT) AS n_tokens
  FROM documents
), leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM d GROUP BY domain, lang, source),
{",".join(_level_sql(k) for k in range(3))},
x AS (
  SELECT d.*, CAST(floor(budget / tokens) AS BIGINT) AS whole, budget - floor(budget / tokens) * tokens AS rest FROM d JOIN b2 USING (domain, lang, source)
), y AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || (whole + 1) || ':' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < rest AS taken FROM x
)
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CAST(taken AS INT) AS BIGINT) AS epochs FROM y WHERE whole + CAST(taken AS INT) > 0
"""
