"""Many queries at once over a corpus: exact, loose and near matches, ranking, summary and presentation.

`queries`: qid, query, types (null or empty: all), folder_id (null: all), near. Each search takes prepared files or a
stored index of them (`grams`). Up to SCAN_QUERIES queries are matched by a scan of the files; of more, the distinct terms are looked for
together in one pass (`many`), whose work does not grow with places times queries. An index, if one is given, brings the
places that hold the rarest grams of a term, or of the pieces that edits must leave, and only those texts are read. Hits
carry cut snippets, and nothing else is shuffled on (qid, key). Up to BROADCAST_QUERIES queries are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import NAME_LOC, file_type, in_pool, make_snippet, query_terms
from tidemill.operators.components import written
from tidemill.operators.fuzzy import edit_allowance, nearest_rows, piece_gate, pieces
from tidemill.operators.grams import NAME, STEM, Grams, fetched, places
from tidemill.operators.many import holding, near_places

MAX_FILES, MAX_HITS, PAGE = 200, 30, 20
NAME_CHUNK = 2**31 - 1
BROADCAST_QUERIES, SCAN_QUERIES = 100_000, 200


def prepare_queries(queries: DataFrame) -> DataFrame:
    q = queries.withColumn("terms", query_terms(F.col("query")))
    return q.withColumn("lows", F.transform("terms", lambda t: F.lower(t))).withColumn("can_near", F.exists("lows", lambda t: edit_allowance(t) > 0))


def asking(queries: DataFrame, most: int = BROADCAST_QUERIES) -> DataFrame:
    """The queries, broadcast if their number is checked to be small."""
    return F.broadcast(queries) if queries.count() <= most else queries


def filter_pool(files: DataFrame, types: list[str] | None = None, folder_id: str | None = None) -> DataFrame:
    if types:
        files = files.where(file_type(F.col("ext")).isin(*types))
    return files.where(F.col("folder_id") == folder_id) if folder_id else files


def roll_up(hits: DataFrame) -> DataFrame:
    """qid, key, mtime, hit_count and the first hits (chunk order, the name last); no more than those are gathered."""
    ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy("qid", "key").orderBy("ord")))
    first = F.array_sort(F.collect_list(F.when(F.col("r") <= MAX_HITS, F.struct("ord", "chunk", "loc", "snippet"))))
    return ranked.groupBy("qid", "key").agg(F.first("mtime").alias("mtime"), F.count("*").alias("hit_count"), first.alias("hits"))


def many(source: DataFrame | Grams, queries: DataFrame, scan: int) -> bool:
    """Whether files are to be searched for so many queries that their terms are looked for together."""
    return not isinstance(source, Grams) and queries.count() > scan


def met(source: DataFrame | Grams, things: DataFrame, kinds: list[int], gate: Column, together: bool = False) -> DataFrame:
    """Rows of `things` with the places (alias c; chunks and `kinds` of names) in their pool that pass the gate.

    things (alias q): tid, types, folder_id, alts (alternatives: arrays of strings of which one stands in the place; one
    alternative if they are looked for `together`) and more. Files are scanned once for all of them; an index gives the
    places to be judged.
    """
    things = things.withColumnRenamed("folder_id", "wanted_folder")
    kind = (F.col("chunk") >= 0) | F.col("chunk").isin(kinds)
    pool = in_pool(F.col("folder_id"), F.col("ext"), F.col("types"), F.col("wanted_folder"))
    if isinstance(source, Grams):
        things = written(things, "things")
        rows = fetched(source, things.select("tid", F.posexplode("alts").alias("alt", "strings")), things.drop("alts"))
        return rows.where(kind & pool & gate)
    own = places(source).where(kind)
    if together:
        longest = F.array_sort(F.get("alts", F.lit(0)), lambda a, b: F.length(b) - F.length(a))
        things = written(things.withColumn("lead", F.get(longest, F.lit(0))).drop("alts"), "things")
        rows = holding(own, things.select("lead").distinct()).withColumn("lead", F.explode("found")).drop("found")
        return rows.join(asking(things), "lead").where(pool & gate)
    return own.join(asking(things), pool & gate)


def per_term(queries: DataFrame) -> DataFrame:
    """A thing for each term of each query."""
    return queries.select("qid", "types", "folder_id", F.size("lows").alias("n_terms"), F.posexplode("lows").alias("ix", "term")).withColumn("tid", F.xxhash64("qid", "ix"))


def put_once(queries: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """of, qid: every query and the first one that asks for the same; and those first ones."""
    q = written(queries.withColumn("first", F.min("qid").over(Window.partitionBy(*by))), "asked")
    return q.select(F.col("qid").alias("of"), F.col("first").alias("qid")), q.where("qid = first").drop("first")


def search_exact(files: DataFrame | Grams, queries: DataFrame, scan: int = SCAN_QUERIES) -> DataFrame:
    """Files with all terms in one chunk, or in the stem of the name. Of many queries, those that ask for the same are put once."""
    q = queries.where(F.size("lows") > 0).select("qid", "types", "folder_id", "lows", F.array("lows").alias("alts"), F.xxhash64("qid").alias("tid"))
    together = many(files, q, scan)
    if together:
        alike, q = put_once(q, "lows", "types", "folder_id")
    hits = met(files, q, [STEM], F.forall("lows", lambda t: F.contains(F.col("low"), t)), together)
    name = F.col("chunk") == STEM
    found = roll_up(
        hits.select(
            "qid",
            "key",
            "mtime",
            F.when(name, NAME_CHUNK).otherwise(F.col("chunk")).alias("ord"),
            F.when(~name, F.col("chunk")).alias("chunk"),
            "loc",
            F.when(name, F.col("text")).otherwise(make_snippet(F.col("text"), F.col("low"), F.col("lows"))).alias("snippet"),
        )
    )
    return found.join(asking(alike), "qid").select(F.col("of").alias("qid"), *found.columns[1:]) if together else found


def search_loose(files: DataFrame | Grams, queries: DataFrame, exact: DataFrame, scan: int = SCAN_QUERIES) -> DataFrame:
    """For queries without exact results: files with every term somewhere, the full name included; hits distinct by location."""
    q = queries.where(F.size("lows") > 0).join(exact.select("qid").distinct(), "qid", "left_anti")
    t = per_term(q).withColumn("alts", F.array(F.array("term")))
    hits = met(files, t, [NAME], F.contains("low", "term"), many(files, q, scan))
    name = F.col("chunk") == NAME
    snippet = F.when(name, F.col("text")).otherwise(make_snippet(F.col("text"), F.col("low"), F.array("term")))
    every = hits.select("qid", "key", "mtime", "n_terms", "ix", F.when(name, NAME_CHUNK).otherwise(F.col("chunk")).alias("at"), F.when(~name, F.col("chunk")).alias("chunk"), "loc", snippet.alias("snippet"))
    every = written(every, "loose_hits")
    full = every.groupBy("qid", "key").agg(F.count_distinct("ix").alias("n"), F.first("n_terms").alias("n_terms")).where("n = n_terms").select("qid", "key")
    first = every.join(full, ["qid", "key"], "left_semi").groupBy("qid", "key", "mtime", "loc").agg(F.min(F.struct("ix", "at", "chunk", "snippet")).alias("h"))
    return roll_up(first.select("qid", "key", "mtime", (F.col("h.ix").cast("long") * 2**32 + F.col("h.at")).alias("ord"), "h.chunk", "loc", "h.snippet"))


def search_near(files: DataFrame | Grams, queries: DataFrame, found: DataFrame, scan: int = SCAN_QUERIES) -> DataFrame:
    """Files in which every term is found exactly or nearly, not all exactly; only for queries without results or with `near`.

    A place with a piece of a term is compared with the term once; what is found there, with its snippet, is stored. Of
    many queries, those that ask for the same are put once.
    """
    have = found.select("qid").distinct().withColumn("have", F.lit(True))
    q = queries.where("can_near").join(have, "qid", "left").where(F.col("have").isNull() | F.coalesce("near", F.lit(False)))
    together = many(files, q, scan)
    if together:
        alike, q = put_once(q, "lows", "types", "folder_id")
    t = per_term(q).withColumn("k", edit_allowance(F.col("term"))).withColumn("pieces", pieces(F.col("term"))).withColumn("alts", F.transform("pieces", lambda p: F.array(p)))
    if together:
        t = written(t.drop("pieces", "alts").withColumnRenamed("folder_id", "wanted_folder"), "things")
        near = near_places(places(files).where("chunk >= 0 or chunk = -1"), t.select("term", "k").distinct())
        # a spot is cut once, whoever asks for its term
        near = near.withColumn("spot", F.explode("found")).select("key", "folder_id", "ext", "mtime", "chunk", "loc", "spot.*")
        spots = near.join(asking(t), "term").where(in_pool(F.col("folder_id"), F.col("ext"), F.col("types"), F.col("wanted_folder")))
        spots = spots.join(found.select("qid", "key"), ["qid", "key"], "left_anti")
    else:
        close = met(files, t, [NAME], piece_gate(F.col("low"), F.col("pieces")))
        close = close.join(found.select("qid", "key"), ["qid", "key"], "left_anti")
        spots = nearest_rows(close.select("qid", "key", "mtime", "n_terms", "ix", "term", "k", "chunk", "loc", "text", "low"))
        spots = spots.withColumn("word", F.substring("low", F.col("start") + 1, F.col("end") - F.col("start")))
        spots = spots.withColumn("snippet", F.when(F.col("chunk") < 0, F.col("text")).otherwise(make_snippet(F.col("text"), F.col("low"), F.array("word"))))
    spots = written(spots.select("qid", "key", "mtime", "n_terms", "ix", "chunk", "loc", "errors", "word", "snippet"), "spots")
    # dealt by result once; then the nearest spots of each term, and what the terms come to
    term, result = Window.partitionBy("qid", "key", "ix"), Window.partitionBy("qid", "key")
    ranked = spots.repartition("qid", "key").withColumn("r", F.row_number().over(term.orderBy("errors"))).withColumn("least", F.min("errors").over(term))
    ranked = ranked.withColumn("n", F.count_if(F.col("r") == 1).over(result)).withColumn("total_errors", F.sum(F.when(F.col("r") == 1, F.col("errors"))).over(result))
    kept = ranked.where("errors = least and n = n_terms and total_errors > 0").drop("r", "least", "n", "n_terms")
    marks = kept.groupBy("qid", "key").agg(F.array_sort(F.collect_set("word")).alias("marks"), F.first("total_errors").alias("errors"))
    first = kept.groupBy("qid", "key", "mtime", "chunk", "loc").agg(F.min(F.struct("ix", "snippet")).alias("h"))
    hits = first.select("qid", "key", "mtime", F.when(F.col("chunk") < 0, NAME_CHUNK).otherwise(F.col("chunk")).alias("ord"), F.when(F.col("chunk") >= 0, F.col("chunk")).alias("chunk"), "loc", F.col("h.snippet").alias("snippet"))
    near = roll_up(hits).join(marks, ["qid", "key"])
    return near.join(asking(alike), "qid").select(F.col("of").alias("qid"), *near.columns[1:]) if together else near


def rank_results(results: DataFrame, near: bool = False, most: int = MAX_FILES) -> DataFrame:
    by = ([F.col("errors")] if near else []) + [F.col("hit_count").desc(), F.col("mtime").desc(), F.col("key")]
    return results.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*by))).where(F.col("rank") <= most)


def search_text(files: DataFrame | Grams, queries: DataFrame, scan: int = SCAN_QUERIES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact, loose and near results, unranked; each is stored, as more than one thing is made of it."""
    exact, loose = search_whole(files, queries, scan)
    return exact, loose, written(search_near(files, queries, results_of(exact, loose), scan), "near")


def search_whole(files: DataFrame | Grams, queries: DataFrame, scan: int = SCAN_QUERIES) -> tuple[DataFrame, DataFrame]:
    """Exact and loose results, unranked; each is stored, as the next ones depend on it."""
    exact = written(search_exact(files, queries, scan), "exact")
    return exact, written(search_loose(files, queries, exact, scan), "loose")


def results_of(exact: DataFrame, loose: DataFrame) -> DataFrame:
    return exact.select("qid", "key").unionByName(loose.select("qid", "key"))


def search_all(files: DataFrame, queries: DataFrame) -> DataFrame:
    """Shown rows of every query: qid, key, kind (exact, loose, near), rank within its kind, hit_count, mtime, errors."""
    exact, loose, near = search_text(files, queries)
    some = lambda df, kind: df.select("qid", "key", F.lit(kind).alias("kind"), "hit_count", "mtime", F.col("errors").cast("long") if kind == "near" else F.lit(None).cast("long").alias("errors"))
    rows = some(exact, "exact").unionByName(some(loose, "loose")).unionByName(some(near, "near"))
    order = Window.partitionBy("qid", "kind").orderBy(F.coalesce("errors", F.lit(0)), F.col("hit_count").desc(), F.col("mtime").desc(), "key")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MAX_FILES)


def summarise(queries: DataFrame, exact: DataFrame, loose: DataFrame, near: DataFrame) -> DataFrame:
    """One row per query: n_terms, can_near, loose, near, total, near_total, and hits: those of the shown exact or loose results."""
    found = exact.select("qid", "key", "hit_count", "mtime").unionByName(loose.select("qid", "key", "hit_count", "mtime"))
    shown = rank_results(found).groupBy("qid").agg(F.sum("hit_count").alias("hits"))
    n = lambda df, name: df.groupBy("qid").agg(F.count("*").alias(name))
    j = queries.select("qid", F.size("terms").alias("n_terms"), F.coalesce("can_near", F.lit(False)).alias("can_near")).join(shown, "qid", "left")
    for df, name in ((exact, "n_exact"), (loose, "n_loose"), (near, "near_total")):
        j = j.join(n(df, name), "qid", "left")
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    total = z("n_exact") + z("n_loose")
    return j.select("qid", "n_terms", "can_near", (z("n_loose") > 0).alias("loose"), ((total == 0) & (z("near_total") > 0)).alias("near"), total.alias("total"), z("near_total").alias("near_total"), z("hits").alias("hits"))


def search_report(files: DataFrame, summary: DataFrame) -> DataFrame:
    """`summary` with outcome: empty (no file is indexed), none, near, name (one term, in names only), loose or exact."""
    empty = F.lit(files.isEmpty())
    outcome = F.when(empty, "empty").when(F.col("near"), "near").when(F.col("total") == 0, "none").when(F.col("loose") & (F.col("n_terms") == 1), "name").when(F.col("loose"), "loose")
    return summary.withColumn("outcome", outcome.otherwise("exact"))


def present_results(shown: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """qid, key, kind, n, divider, page: text results first, then near ones, then those by meaning (qid, key, rank).

    A divider stands before the first of a group that follows another one, and before results by meaning that come first.
    """
    rows = shown.select("qid", "key", "kind", "rank")
    if semantic is not None:
        rows = rows.unionByName(semantic.select("qid", "key", F.lit("sem").alias("kind"), "rank"))
    group = F.when(F.col("kind") == "sem", 2).when(F.col("kind") == "near", 1).otherwise(0)
    w = Window.partitionBy("qid").orderBy(group, "rank", "key")
    out = rows.withColumn("grp", group).withColumn("n", F.row_number().over(w)).withColumn("before", F.lag("grp").over(w))
    divider = (F.col("grp") > 0) & F.coalesce(F.col("before") != F.col("grp"), F.col("grp") == 2)
    return out.select("qid", "key", "kind", "n", divider.alias("divider"), F.floor((F.col("n") - 1) / PAGE).alias("page"))
