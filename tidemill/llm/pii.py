"""PII by information-theoretic sanitisation, in built-in SQL functions only.

Patterns find the protected entities: email, ip, card and phone. Corpus co-occurrence then tells how strongly a term
(a run of three or more letters, lower-cased) reveals an entity: with document frequencies over the corpus,

    disclosure(t, e) = PMI(t, e) / IC(e) = log(N n(t,e) / (n(t) n(e))) / log(N / n(e)),

which is 1 where the term never occurs without the entity. All frequencies count distinct texts, so copies give no evidence.
Every term of a text meets every entity of it, wherever they stand; an entity is rated by its normalised value and, as a
coarser one, by its kind. Evidence are `support` or more texts with both. A term with a disclosure of
`removed` or more is to be removed, of `generalised` or more to be replaced by its shape; both wherever it occurs.

Entities with a frequency equal to N carry no information and reveal nothing. Spans of terms that overlap a pattern
span are dropped. Null text has no spans and stays null. Repeated texts count once. Extra
columns are kept out of the spans. An empty table gives an empty result. Positions are code points, ends
exclusive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import let, stored, table

KINDS = ("email", "ip", "card", "phone", "term")

#: Patterns that match exactly where the plain ones do. A run of local-part characters is tried once, at its start or
#: where the last match ended, and card runs are whole runs of 16 to 19 digits, so that long texts stay linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}{3,}"
#: Terms up to which the table of revealing terms is broadcast; beyond, it is joined by a shuffle.
BROADCAST_TERMS = 100_000
#: Documents with revealing terms up to which their terms are broadcast, so that no text is shuffled.
BROADCAST_DOCS = 200_000


def spans_of(text: Column, pattern: Column | str, sure: Column, group: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches; empty unless `sure` says that there may be one."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.regexp_extract_all(text, pattern, F.lit(group))
    lengths = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))

    def placed(values: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + F.length(x["value"])
            return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))).alias("out"))

        none = F.lit(None).cast("array<struct<start:int,end:int,value:string>>")
        zero = F.struct(F.lit(0).alias("at"), F.coalesce(none, F.array().cast("array<struct<start:int,end:int,value:string>>")).alias("out"))
        gaps = let(lengths, lambda g: F.transform(values, lambda v, i: F.struct(F.get(g, i).alias("gap"), v.alias("value"))))
        return F.aggregate(gaps, zero, step, lambda acc: acc["out"])

    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(sure, let(found, lambda v: F.when(F.size(v) > 0, placed(v)).otherwise(empty))).otherwise(empty)


def luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, r"[^0-9]", ""))

    def total(d: Column) -> Column:
        each = F.transform(F.split(d, ""), lambda c, i: let(F.coalesce(c.try_cast("int"), F.lit(0)) * (1 + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)))
        return F.aggregate(each, F.lit(0), lambda a, x: a + x)

    return let(digits, total) % 10 == 0


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>> of the pattern kinds, by kind as listed, then start."""
    n_digits = lambda v: F.length(F.regexp_replace(v, r"[^0-9]", ""))
    part = lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
    kinds = {
        "email": (EMAIL, F.contains(text, F.lit("@")), lambda v: F.lit(True)),
        "ip": (IP, F.contains(text, F.lit(".")), lambda v: F.forall(F.split(v, r"\."), part)),
        "card": (CARD, F.lit(True), lambda v: n_digits(v).between(16, 19) & luhn(v)),
        "phone": (PHONE, F.contains(text, F.lit("+")), lambda v: n_digits(v).between(8, 15)),
    }

    def of(kind: str) -> Column:
        pattern, sure, passes = kinds[kind]
        good = F.filter(spans_of(text, pattern, sure), lambda s: passes(s["value"]))
        return F.transform(good, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    return F.concat(*map(of, kinds))


def with_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    kept = F.struct(*keep) if keep else F.lit(None).cast("struct<none:int>")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), kept.alias("kept")).withColumn("base", base_spans(F.coalesce("text", F.lit(""))))


def terms_of(text: Column) -> Column:
    """The distinct terms of a text outside its e-mail addresses (the other kinds have no letters)."""
    free = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL, " ")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(free), F.lit(TERM), F.lit(0)))


def entity_keys(base: Column) -> Column:
    """array<bigint>: what a text's pattern spans stand for, by normalised value (lower case; digits of cards and phones; numbers of an ip) and by kind."""

    def value(s: Column) -> Column:
        plain = F.when(s["kind"] == "email", F.lower(s["value"])).when(s["kind"] == "ip", F.regexp_replace(s["value"], r"(?<![0-9])0+(?=[0-9])", ""))
        return F.xxhash64(s["kind"], plain.otherwise(F.regexp_replace(s["value"], r"[^0-9]", "")))

    return F.array_distinct(F.concat(F.transform(base, value), F.transform(base, lambda s: F.xxhash64(s["kind"]))))


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df` (stored), broadcast in joins if it has no more than `rows` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def revealing_terms(docs: DataFrame, support: int = 2, generalised: float = 0.8, removed: float = 0.95) -> DataFrame:
    """term, disclosure, action ('remove' or 'generalise') from the whole corpus of (doc_id, text, base) rows."""
    texts = docs.where(F.col("text").isNotNull()).withColumn("h", F.xxhash64("text"))
    copies = stored(texts.groupBy("h").agg(F.count("*").alias("copies")), "copies")
    n_docs = float(max(1, copies.count()))
    repeated = small(copies.where("copies > 1"), BROADCAST_DOCS)
    # each of c copies counts 1/c, so that a text counts once
    words = texts.select("h", "text").join(repeated, "h", "left").select((1 / F.coalesce("copies", F.lit(1))).alias("part"), F.explode(terms_of(F.col("text"))).alias("term"))
    n_t = stored(words.groupBy("term").agg(F.round(F.sum("part")).alias("n_t")).where(F.col("n_t") >= support), "terms")

    held = texts.where(F.size("base") > 0).select("h", entity_keys(F.col("base")).alias("entities"), terms_of(F.col("text")).alias("terms"))
    held = stored(held.dropDuplicates(["h"]), "held")
    of = held.select("h", F.explode("entities").alias("entity"))
    n_e = stored(of.groupBy("entity").agg(F.count("*").cast("double").alias("n_e")).where(F.col("n_e").between(support, n_docs - 1)), "entities")
    of = stored(of.join(small(n_e, BROADCAST_DOCS), "entity"), "holders")

    # n(t,e) <= n(e), so a term of more than N (n(e) / N) ** generalised texts cannot reach `generalised`: no need to count its pairs
    most = lambda n: n_docs * F.pow(n / n_docs, generalised) + 1e-6
    frequent = n_t.where(F.col("n_t") > most(F.lit(float(support)))).orderBy(F.col("n_t").desc(), "term").limit(BROADCAST_TERMS)
    pairs = held.select("h", F.explode("terms").alias("term")).join(F.broadcast(frequent), "term", "left").join(small(of, BROADCAST_DOCS), "h")
    pairs = pairs.where(F.col("n_t").isNull() | (F.col("n_t") <= most(F.col("n_e"))))
    joint = stored(pairs.groupBy("term", "entity", "n_e").agg(F.count("*").cast("double").alias("n_te")).where(F.col("n_te") >= support), "pairs")

    rated = joint.join(n_t, "term").withColumn("disclosure", F.log(n_docs * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) / F.log(n_docs / F.col("n_e")))
    worst = rated.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= generalised)
    return stored(worst.withColumn("action", F.when(F.col("disclosure") >= removed, "remove").otherwise("generalise")), "revealing")


def term_texts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """h (hash of the text), term and further columns of `terms`, for each text that holds a term of the (small) table."""
    n = terms.count()
    if not n:
        return docs.select("h").join(terms, F.lit(False))
    words = docs.select("h", F.explode(terms_of(F.col("text"))).alias("term"))
    return words.join(F.broadcast(terms) if n <= BROADCAST_TERMS else terms, "term")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), **thresholds) -> DataFrame:
    """doc_id, text, base, all spans (kind, start, end, value, action), and kept (a struct of the columns `keep`) of every document."""
    docs = with_base(docs, id_col, text_col, keep)
    terms = revealing_terms(docs, **thresholds)
    # terms belong to a text, whatever its id: rows of one id or without any find their own
    docs = docs.withColumn("h", F.xxhash64("text"))
    by_text = term_texts(docs, terms).groupBy("h").agg(F.sort_array(F.collect_set("term")).alias("terms"), F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias("actions"))
    by_text = stored(by_text, "termtexts")
    docs = docs.join(F.broadcast(by_text) if by_text.count() <= BROADCAST_DOCS else by_text, "h", "left")
    quoted = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    in_text = spans_of(F.coalesce("text", F.lit("")), F.coalesce(quoted, F.lit("(?!)x")), F.col("terms").isNotNull())
    free = F.filter(in_text, lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    base = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"), b["value"].alias("value"), F.lit("replace").alias("action")))
    more = F.transform(free, lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.coalesce(F.try_element_at("actions", F.lower(s["value"])), F.lit("remove")).alias("action")))
    return docs.select("doc_id", "text", "base", F.concat(base, more).alias("spans"), "kept")


def shape(term: Column) -> Column:
    """What stays of a generalised term: its runs of capitals and of small letters as X and x."""
    return F.concat(F.lit("["), F.regexp_replace(F.regexp_replace(F.regexp_replace(term, r"\p{Lu}+", "\u0001"), r"\p{L}+", "x"), "\u0001", "X"), F.lit("]"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with pattern spans replaced by their kind (<EMAIL>), removed terms gone, and generalised terms as their shape ([Xx])."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["action"].alias("action"), s["value"].alias("value"))))

    def cut(s: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            put = F.when(x["action"] == "remove", F.lit("")).when(x["kind"] == "term", shape(x["value"])).otherwise(F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))
            return F.when(
                x["start"] >= acc["at"],
                F.struct(x["end"].alias("at"), F.array_append(acc["out"], F.concat(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), put)).alias("out")),
            ).otherwise(F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out")))  # overlapping kinds: the first one stands for both

        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(s, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))

    return F.when(F.size(spans) > 0, let(ordered, cut)).otherwise(text)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
