"""Queries over the given tables, one per operator, with the DuckDB SQL that recomputes them from the raw tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import text as X
from tidemill.operators import dupes as D
from tidemill.operators import search as S
from tidemill.operators import semantic as V
from tidemill.operators import sync as Y
from tidemill.operators.components import folder, lean, written
from tidemill.operators.fuzzy import edit_allowance
from tidemill.sources import corpus as C
from tidemill.sources.store import Store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return lean(spark).read.parquet(f"{d}/{name}.parquet")


# ---- SQL shared by the oracles -------------------------------------------------------------------------------------

_SPACE = X.SPACE
PUA_SQL = f"translate(%s, '{X.THAI_GLYPHS}', '{X.THAI_PUA}')"


def norm_sql(e: str) -> str:
    e = PUA_SQL % f"coalesce({e}, '')"
    for c in X.INVISIBLE:
        e = f"replace({e}, chr({ord(c)}), '')"
    e = f"nfc_normalize({e})"
    e = f"replace(replace({e}, 'ํา', 'ำ'), 'าํ', 'ำ')"
    e = f"regexp_replace({e}, 'ำ([่-๋])', '\\1ำ', 'g')"
    e = f"regexp_replace({e}, '[ \t ]+', ' ', 'g')"
    return f"regexp_replace({e}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


FILES = f"""docs AS (SELECT doc_id, coalesce(source, 'unknown') AS folder_id, n_chars AS size, coalesce(lang, 'und') AS lang, text, CASE lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.docx' WHEN 'de' THEN '.pdf' WHEN 'es' THEN '.xlsx' ELSE '' END AS ext FROM documents),
files AS (SELECT doc_id, folder_id || '/' || lang || '/doc_' || doc_id || ext AS key, folder_id, lang || '/doc_' || doc_id || ext AS rel, 'doc_' || doc_id || ext AS name, 'doc_' || doc_id AS stem, ext, size,
  1700000000000 + (doc_id * 7919 % 1000) * 1000 AS mtime, CASE WHEN text IS NULL THEN 'bad' END AS error, text FROM docs),
lines AS (SELECT key, string_split_regex(text, '\\r\\n|\\r|\\n') AS l FROM files WHERE error IS NULL),
parts AS (SELECT key, unnest(range(0, len(l), 50)) AS k, l FROM lines),
normed AS (SELECT key, k, {norm_sql("array_to_string(l[k + 1:k + 50], chr(10))")} AS text FROM parts),
chunks AS MATERIALIZED (SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY k) - 1 AS INT) AS chunk, 'บรรทัด ' || (k + 1) AS loc, text, lower(text) AS low FROM normed WHERE text <> '')"""

TYPES_SQL = "CASE %s WHEN '.txt' THEN 'ข้อความ' WHEN '.docx' THEN 'Word' WHEN '.xlsx' THEN 'Excel' WHEN '.pdf' THEN 'PDF' END"

ASKED = ((1, "thtion", None, None, False), (2, "ertion  retion", None, None, False), (3, "thtian", None, None, False), (4, "12", None, None, False), (5, "", None, None, False), (6, "zzqqxxyy", None, None, False), (7, "doc_12", None, None, False), (8, "thtion .txt", None, None, False), (9, "thanea", None, "src3", False), (10, "ertion", "Word", None, False), (11, "attion", None, None, True))
Q_SQL = "q AS (SELECT qid, lows, types, folder, near, list_filter(lows, lambda x: x <> '') AS kept FROM (SELECT qid, list_filter(string_split(lower(regexp_replace(query, ' +', ' ', 'g')), ' '), lambda x: x <> '') AS lows, types, folder, near FROM (VALUES " + ", ".join(f"({i}, '{q}', {'NULL' if ty is None else repr(ty)}, {'NULL' if fo is None else repr(fo)}, {str(n).lower()})" for i, q, ty, fo, n in ASKED) + ") v(qid, query, types, folder, near)))"
POOL_SQL = f"(q.folder IS NULL OR q.folder = f.folder_id) AND (q.types IS NULL OR q.types = {TYPES_SQL % 'f.ext'})"


def snippet_sql(text: str, low: str, terms: str) -> str:
    at = f"coalesce(list_min(list_filter(list_transform({terms}, lambda x: strpos({low}, x)), lambda p: p > 0)) - 1, 0)"
    return f"(CASE WHEN {at} > 90 THEN '…' ELSE '' END || replace({text}[greatest(0, {at} - 90) + 1:least(length({text}), {at} + 180)], chr(10), ' ') || CASE WHEN {at} + 180 < length({text}) THEN '…' ELSE '' END)"


EXACT_SQL = f"""hits AS (
  SELECT q.qid, c.key, f.mtime, c.chunk AS ord, c.loc, {snippet_sql("c.text", "c.low", "q.lows")} AS snippet FROM chunks c JOIN files f USING (key) JOIN q ON len(q.lows) > 0 AND {POOL_SQL} AND len(list_filter(q.lows, lambda x: NOT contains(c.low, x))) = 0
  UNION ALL SELECT q.qid, f.key, f.mtime, 2147483647, '{X.NAME_LOC}', f.stem FROM files f JOIN q ON len(q.lows) > 0 AND {POOL_SQL} AND len(list_filter(q.lows, lambda x: NOT contains(lower(f.stem), x))) = 0),
exact AS (SELECT qid, key, any_value(mtime) AS mtime, count(*) AS hit_count, array_to_string(list(loc || '|' || snippet ORDER BY ord)[1:30], chr(10)) AS hits FROM hits GROUP BY qid, key)"""

LOOSE_SQL = f"""lq AS (SELECT qid, types, folder, len(lows) AS n_terms, unnest(lows) AS term, generate_subscripts(lows, 1) AS ix FROM q WHERE qid NOT IN (SELECT qid FROM exact)),
lh AS (SELECT q.qid, c.key, f.mtime, n_terms, ix, c.chunk AS at_, c.loc, {snippet_sql("c.text", "c.low", "[q.term]")} AS snippet FROM chunks c JOIN files f USING (key) JOIN lq q ON {POOL_SQL} AND contains(c.low, q.term)
  UNION ALL SELECT q.qid, f.key, f.mtime, n_terms, ix, 2147483647, '{X.NAME_LOC}', f.name FROM files f JOIN lq q ON {POOL_SQL} AND contains(lower(f.name), q.term)),
lfull AS (SELECT qid, key FROM lh GROUP BY qid, key HAVING count(DISTINCT ix) = any_value(n_terms)),
lfirst AS (SELECT *, row_number() OVER (PARTITION BY qid, key, loc ORDER BY ix, at_) AS r FROM lh JOIN lfull USING (qid, key)),
loose AS (SELECT qid, key, any_value(mtime) AS mtime, count(*) AS hit_count, array_to_string(list(loc || '|' || snippet ORDER BY ix, at_)[1:30], chr(10)) AS hits FROM lfirst WHERE r = 1 GROUP BY qid, key)"""


#: Words, their allowance and, for each chunk or name that holds a piece of them, the nearest spot. DuckDB counts bytes as edits,
#: so characters beyond ASCII, of which the queries have none, stand as one byte.
NEAR_SQL = f"""found AS MATERIALIZED (SELECT qid, key, hit_count, mtime FROM exact UNION ALL SELECT qid, key, hit_count, mtime FROM loose),
nt AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(term, '\\p{{L}}') OR length(term) < 5 THEN 0 WHEN length(term) < 9 THEN 1 ELSE 2 END AS k, term[1:32] AS pat, least(length(term), 32) AS m FROM
  (SELECT qid, types, folder, len(lows) AS n_terms, unnest(lows) AS term, generate_subscripts(lows, 1) AS ix FROM q WHERE near OR qid NOT IN (SELECT qid FROM found))),
can AS MATERIALIZED (SELECT DISTINCT qid FROM nt WHERE k > 0),
places AS (SELECT key, chunk, loc, text, low FROM chunks UNION ALL SELECT key, -1, '{X.NAME_LOC}', name, lower(name) FROM files),
gate AS MATERIALIZED (SELECT t.*, f.key, f.mtime, p.chunk, p.loc, p.text, p.low FROM places p JOIN files f USING (key) JOIN nt t ON (t.folder IS NULL OR t.folder = f.folder_id) AND (t.types IS NULL OR t.types = {TYPES_SQL % 'f.ext'})
  AND CASE t.k WHEN 0 THEN contains(p.low, t.term) WHEN 1 THEN contains(p.low, t.pat[1:t.m // 2]) OR contains(p.low, t.pat[t.m // 2 + 1:t.m]) ELSE contains(p.low, t.pat[1:t.m // 3]) OR contains(p.low, t.pat[t.m // 3 + 1:2 * (t.m // 3)]) OR contains(p.low, t.pat[2 * (t.m // 3) + 1:t.m]) END
  WHERE t.qid IN (SELECT qid FROM can) AND (t.qid, f.key) NOT IN (SELECT qid, key FROM found)),
whole AS (SELECT *, 0 AS errors, term AS word FROM gate WHERE contains(low, term)),
ends AS (SELECT *, unnest(range(1, length(low) + 1)) AS e FROM (SELECT *, regexp_replace(low, '[^\x00-\x7F]', chr(1), 'g') AS plain FROM gate WHERE NOT contains(low, term) AND length(low) >= length(term) - k)),
subs AS (SELECT qid, ix, key, chunk, e, n, levenshtein(pat, plain[e - n + 1:e]) AS d, abs(n - m) * 2 + CASE WHEN n > m THEN 1 ELSE 0 END AS o, k FROM (SELECT *, unnest(range(m - k, m + k + 1)) AS n FROM ends) WHERE n BETWEEN 1 AND e),
at_end AS MATERIALIZED (SELECT qid, ix, key, chunk, e, min(d) AS d, arg_min(n, d * 1000 + o) AS n FROM subs GROUP BY qid, ix, key, chunk, e, k HAVING min(d) <= k),
best AS MATERIALIZED (SELECT qid, ix, key, chunk, d, e, n FROM (SELECT *, row_number() OVER (PARTITION BY qid, ix, key, chunk ORDER BY d, e) AS r FROM at_end) WHERE r = 1),
w1 AS (SELECT b.*, g.low, g.pat, CASE WHEN b.d > 0 AND x.d = b.d AND regexp_matches(g.low[b.e + 1], '\\p{{L}}') THEN x.n END AS n1, CASE WHEN b.d > 1 AND y.d = b.d AND regexp_matches(g.low[b.e + 2], '\\p{{L}}') THEN y.n END AS n2
  FROM best b JOIN gate g USING (qid, ix, key, chunk) LEFT JOIN at_end x ON x.qid = b.qid AND x.ix = b.ix AND x.key = b.key AND x.chunk = b.chunk AND x.e = b.e + 1 LEFT JOIN at_end y ON y.qid = b.qid AND y.ix = b.ix AND y.key = b.key AND y.chunk = b.chunk AND y.e = b.e + 2),
w2 AS (SELECT *, CASE WHEN n1 IS NOT NULL AND n2 IS NOT NULL THEN e + 2 WHEN n1 IS NOT NULL THEN e + 1 ELSE e END AS stop, CASE WHEN n1 IS NOT NULL AND n2 IS NOT NULL THEN n2 WHEN n1 IS NOT NULL THEN n1 ELSE n END AS size FROM w1),
approx AS (SELECT g.*, d AS errors, regexp_replace(w2.low[stop - size + 1:stop], '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') AS word FROM gate g JOIN w2 USING (qid, ix, key, chunk)),
spots AS MATERIALIZED (SELECT qid, key, mtime, n_terms, ix, chunk, loc, text, low, errors, word FROM whole UNION ALL SELECT qid, key, mtime, n_terms, ix, chunk, loc, text, low, errors, word FROM approx),
least_ AS (SELECT qid, key, ix, any_value(n_terms) AS n_terms, min(errors) AS errors FROM spots GROUP BY qid, key, ix),
total_ AS (SELECT qid, key, sum(errors) AS total FROM least_ GROUP BY qid, key HAVING count(*) = any_value(n_terms) AND sum(errors) > 0),
kept AS MATERIALIZED (SELECT s.*, t.total FROM spots s JOIN least_ l USING (qid, key, ix, errors) JOIN total_ t USING (qid, key)),
nhit AS (SELECT *, row_number() OVER (PARTITION BY qid, key, chunk ORDER BY ix) AS r, CASE WHEN chunk < 0 THEN text ELSE {snippet_sql("text", "low", "[word]")} END AS snippet FROM kept),
near AS MATERIALIZED (SELECT qid, key, any_value(mtime) AS mtime, CAST(any_value(total) AS BIGINT) AS errors, count(*) AS hit_count, array_to_string(list(loc || '|' || snippet ORDER BY CASE WHEN chunk < 0 THEN 2147483647 ELSE chunk END)[1:30], chr(10)) AS hits,
  (SELECT array_to_string(list(DISTINCT k.word ORDER BY k.word), '|') FROM kept k WHERE k.qid = h.qid AND k.key = h.key) AS marks FROM nhit h WHERE r = 1 GROUP BY qid, key)"""

SHOWN_SQL = f"""{NEAR_SQL}, every AS (SELECT qid, key, 'exact' AS kind, hit_count, mtime, CAST(NULL AS BIGINT) AS errors FROM exact UNION ALL SELECT qid, key, 'loose', hit_count, mtime, NULL FROM loose UNION ALL SELECT qid, key, 'near', hit_count, mtime, errors FROM near),
shown AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY qid, kind ORDER BY coalesce(errors, 0), hit_count DESC, mtime DESC, key) AS INT) AS rank FROM every QUALIFY rank <= 200)"""

REPORT_SQL = f"""{NEAR_SQL}, top AS (SELECT qid, hit_count FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hit_count DESC, mtime DESC, key) AS r FROM found) WHERE r <= 200),
sums AS (SELECT q.qid, len(q.lows) AS n_terms, len(list_filter(q.lows, lambda x: regexp_matches(x, '\\p{{L}}') AND length(x) >= 5)) > 0 AS can_near, (SELECT count(*) FROM loose l WHERE l.qid = q.qid) > 0 AS loose,
  (SELECT count(*) FROM found f WHERE f.qid = q.qid) AS total, (SELECT count(*) FROM near n WHERE n.qid = q.qid) AS near_total, (SELECT CAST(coalesce(sum(hit_count), 0) AS BIGINT) FROM top t WHERE t.qid = q.qid) AS hits FROM q)
SELECT qid, CAST(n_terms AS INT) AS n_terms, can_near, loose, total = 0 AND near_total > 0 AS near, total, near_total, hits, CASE WHEN (SELECT count(*) FROM files) = 0 THEN 'empty' WHEN total = 0 AND near_total > 0 THEN 'near' WHEN total = 0 THEN 'none' WHEN loose AND n_terms = 1 THEN 'name' WHEN loose THEN 'loose' ELSE 'exact' END AS outcome FROM sums"""


def records(spark: SparkSession, d: str) -> DataFrame:
    """The index of the documents, stored as a user has it: texts are cut into chunks once."""
    return written(C.corpus_from_documents(t(spark, d, "documents")), "index")


def metadata(spark: SparkSession, d: str) -> DataFrame:
    """The documents as file records without their texts, which are not read."""
    return C.metadata_from_documents(t(spark, d, "documents"))


def files_of(spark: SparkSession, d: str) -> DataFrame:
    return C.prepare_search(records(spark, d))


def asked(spark: SparkSession) -> DataFrame:
    rows = [(i, q, [ty] if ty else None, fo, n) for i, q, ty, fo, n in ASKED]
    return S.prepare_queries(spark.createDataFrame(rows, "qid int, query string, types array<string>, folder_id string, near boolean"))


def flat_hits(df: DataFrame) -> DataFrame:
    return df.withColumn("hits", F.array_join(F.transform("hits", lambda h: F.concat(h["loc"], F.lit("|"), h["snippet"])), "\n"))


# ---- sources ---------------------------------------------------------------------------------------------------------

_EXT_IN = ", ".join(f"'{e}'" for e in X.FILE_TYPES)
_PATHS = "SELECT page_id, CASE page_id % 7 WHEN 0 THEN '.git/' WHEN 1 THEN 'node_modules/' ELSE '' END || replace(regexp_extract(url, '://([^?#]*)', 1), '.html', '/p') || CASE page_id % 5 WHEN 0 THEN '/.a.txt' WHEN 1 THEN '/~$b.docx' WHEN 2 THEN '/C.PDF' WHEN 3 THEN '/d.exe' ELSE '/e.tar.md' END AS rel FROM pages"


def page_paths(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("page_id")
    head = F.when(p % 7 == 0, ".git/").when(p % 7 == 1, "node_modules/").otherwise("")
    tail = F.when(p % 5 == 0, "/.a.txt").when(p % 5 == 1, "/~$b.docx").when(p % 5 == 2, "/C.PDF").when(p % 5 == 3, "/d.exe").otherwise("/e.tar.md")
    return t(spark, d, "pages").select("page_id", F.concat(head, F.replace(F.regexp_extract("url", "://([^?#]*)", 1), F.lit(".html"), F.lit("/p")), tail).alias("rel"))


def _listing_sql(parts: str) -> str:
    return f"""WITH p AS ({_PATHS}), s AS (SELECT page_id, rel, string_split(rel, '/') AS x, regexp_extract(rel, '[^/]*$') AS name FROM p)
SELECT page_id, rel, name FROM s WHERE len(list_filter({parts}, lambda y: y LIKE '.%' OR y IN ('$RECYCLE.BIN', 'System Volume Information', 'node_modules', '__pycache__'))) = 0
AND name NOT LIKE '~$%' AND lower(regexp_extract(name, '^.+(\\.[^.]*)$', 1)) IN ({_EXT_IN})"""


@query(_listing_sql("x[1:len(x) - 1]"))
def list_files(spark, d):
    return C.eligible(page_paths(spark, d)).select("page_id", "rel", "name")


@query(_listing_sql("x"))
def list_picked_files(spark, d):
    return C.eligible(page_paths(spark, d), picked=True).select("page_id", "rel", "name")


@query(f"WITH p AS ({_PATHS}), s AS (SELECT page_id, string_split(rel, '/') AS x FROM p) SELECT page_id, x[1] AS top, array_to_string(x[2:], '/') AS rel, x[-1] AS name, x[1] || '/' || array_to_string(x[2:], '/') AS key FROM s")
def split_top_folder(spark, d):
    return page_paths(spark, d).select("page_id", *C.split_top_folder(F.col("rel")))


@query(f"WITH {FILES} SELECT key, chunk, loc, text FROM chunks")
def read_text_chunks(spark, d):
    files = C.corpus_from_documents(t(spark, d, "documents"))
    return files.select("key", F.posexplode("chunks").alias("chunk", "c")).select("key", "chunk", "c.loc", "c.text")


_MONEY = "regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '')"


@query(f"""WITH r AS (SELECT o_orderstatus AS sheet, o_orderkey, concat_ws(' | ', CAST(o_orderkey AS VARCHAR), {_MONEY}, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), CASE WHEN o_totalprice > 300000 THEN 'TRUE' ELSE 'FALSE' END, nullif(o_orderpriority, '')) AS line FROM orders),
n AS (SELECT *, (row_number() OVER (PARTITION BY sheet ORDER BY o_orderkey) - 1) // 1048576 AS block FROM r)
SELECT sheet, 'ชีต ' || sheet AS loc, block, string_agg(line, chr(10) ORDER BY o_orderkey) AS text FROM n GROUP BY sheet, block""")
def rows_to_text(spark, d):
    o = C.spread(t(spark, d, "orders")).withColumn("large", F.col("o_totalprice") > 300000)
    return C.rows_to_text(o, F.col("o_orderstatus"), F.col("o_orderkey"), ["o_orderkey", "o_totalprice", "o_orderdate", "large", "o_orderpriority"])


@query(f"SELECT 'c' || conv_id AS doc, turn // 4 AS page, string_agg(regexp_replace(text, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g'), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1, 2")
def assemble_blocks(spark, d):
    c = t(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("doc"), F.floor(F.col("turn") / 4).alias("page"), F.col("turn").alias("block"), "text")
    return C.assemble_blocks(c)


@query(f"WITH {FILES} SELECT key, folder_id, name, stem, mtime, (SELECT count(*) FROM chunks c WHERE c.key = f.key) AS n_chunks FROM files f")
def save_load_index(spark, d):
    path = folder(spark, "index")
    C.save_index(C.corpus_from_documents(t(spark, d, "documents")), path)
    return C.load_index(spark, path).select("key", "folder_id", "name", "stem", "mtime", F.size("chunks").cast("long").alias("n_chunks"))


def _keyed(spark, d) -> DataFrame:
    return metadata(spark, d).select("doc_id", "key", "folder_id", "mtime", "size")


@query(f"WITH {FILES} SELECT key, folder_id, mtime + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS mtime FROM files WHERE doc_id % 13 <> 0 OR doc_id % 7 = 0")
def upsert_index(spark, d):
    f = _keyed(spark, d)
    new = f.where("doc_id % 7 = 0").withColumn("mtime", F.col("mtime") + 1)
    return C.upsert_index(f.where("doc_id % 13 <> 0"), new).select("key", "folder_id", "mtime")


@query(f"WITH {FILES} SELECT key, folder_id FROM files WHERE doc_id % 11 <> 0 AND folder_id <> 'src3'")
def remove_keys(spark, d):
    f = _keyed(spark, d)
    return C.remove_folder(C.remove_keys(f, f.where("doc_id % 11 = 0")), "src3").select("key", "folder_id")


def _stored(spark, d, rows: DataFrame) -> Store:
    store = Store.create(spark, folder(spark, "store"), rows.schema, target_rows=1000)
    store.upsert(rows)
    return store


@query(f"WITH {FILES} SELECT key, folder_id, mtime + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS mtime FROM files WHERE doc_id % 13 <> 0 OR doc_id % 7 = 0")
def upsert_stored(spark, d):
    """The same on disk: only buckets with changed keys are written anew."""
    f = _keyed(spark, d)
    store = _stored(spark, d, f.where("doc_id % 13 <> 0"))
    store.upsert(f.where("doc_id % 7 = 0").withColumn("mtime", F.col("mtime") + 1))
    return store.read().select("key", "folder_id", "mtime")


@query(f"WITH {FILES} SELECT key, folder_id FROM files WHERE doc_id % 11 <> 0 AND folder_id <> 'src3'")
def remove_stored(spark, d):
    f = _keyed(spark, d)
    store = _stored(spark, d, f)
    store.remove(f.where("doc_id % 11 = 0"))
    store.remove_folder("src3")
    return store.read().select("key", "folder_id")


# ---- text --------------------------------------------------------------------------------------------------------------

LATIN, THAI = "abcdefghijklmnopqrstuvwxyz", "กขคงจฉชซญฐาํำ่้๊๋ิ็่​﻿e̓ ป"
THAI_TEXT = f"translate(text, '{LATIN}', '{THAI}')"


@query(f"SELECT doc_id, {norm_sql(THAI_TEXT)} AS text FROM documents")
def normalize_text(spark, d):
    return t(spark, d, "documents").select("doc_id", X.normalize_text(F.translate("text", LATIN, THAI)).alias("text"))


_JOIN_SQL = r"regexp_replace(%s, '([฀-๿])\n([฀-๿])', '\1\2', 'g')"


@query(f"SELECT doc_id, {_JOIN_SQL % (_JOIN_SQL % THAI_TEXT)} AS text FROM documents")
def join_thai_lines(spark, d):
    return t(spark, d, "documents").select("doc_id", X.join_thai_lines(F.translate("text", LATIN, THAI)).alias("text"))


_EXT_SQL = "lower(regexp_extract(name, '^.+(\\.[^.]*)$', 1))"


@query(f"WITH {FILES}, n AS (SELECT doc_id, upper(name) AS name FROM files) SELECT doc_id, {_EXT_SQL} AS ext, {TYPES_SQL % _EXT_SQL} AS type, CASE WHEN {_EXT_SQL} = '.pdf' THEN 2 ELSE 1 END AS version FROM n")
def ext_type_version(spark, d):
    n = metadata(spark, d).select("doc_id", X.ext_of(F.upper("name")).alias("ext"))
    return n.select("doc_id", "ext", X.file_type(F.col("ext")).alias("type"), X.reader_version(F.col("ext")).alias("version"))


@query(f"SELECT doc_id, array_to_string(list_filter(string_split({norm_sql('text')}, ' '), lambda x: x <> ''), '|') AS terms FROM documents")
def query_terms(spark, d):
    return t(spark, d, "documents").select("doc_id", F.array_join(X.query_terms(F.col("text")), "|").alias("terms"))


@query(f"WITH {FILES} SELECT key, chunk, low, CAST(length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g')) AS BIGINT) AS letters FROM chunks")
def prepare_search(spark, d):
    return C.chunk_rows(files_of(spark, d)).select("key", "chunk", "low", X.count_letters(F.col("text")).cast("long").alias("letters"))


@query(f"WITH {FILES} SELECT key, chunk, {snippet_sql('text', 'low', chr(91) + repr('retion') + ', ' + repr('thtion') + chr(93))} AS snippet FROM chunks")
def make_snippet(spark, d):
    terms = F.array(F.lit("retion"), F.lit("thtion"))
    return C.chunk_rows(files_of(spark, d)).select("key", "chunk", X.make_snippet(F.col("text"), F.col("low"), terms).alias("snippet"))


@query(f"WITH {FILES}, p AS (SELECT *, greatest(strpos(low, 'thtion') - 1, 0) AS p FROM chunks) SELECT key, chunk, text[greatest(0, p - 500) + 1:least(length(text), p + 1500)] AS body, p > 500 AS cut_start, p + 1500 < length(text) AS cut_end FROM p")
def context_window(spark, d):
    c = C.chunk_rows(files_of(spark, d)).withColumn("w", X.context_window(F.col("text"), F.col("low"), F.array(F.lit("thtion"))))
    return c.select("key", "chunk", F.col("w.text").alias("body"), "w.cut_start", "w.cut_end")


@query(f"""WITH {FILES}, w AS (SELECT key, CAST(doc_id % 3 AS INT) AS chunk, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 700 AS INT) END AS at_ FROM files),
p AS (SELECT w.key, w.chunk, at_, text, greatest(strpos(low, 'thtion') - 1, 0) AS pos FROM w LEFT JOIN chunks c ON c.key = w.key AND c.chunk = w.chunk),
b AS (SELECT *, coalesce(at_, greatest(0, pos - 500)) AS start, coalesce(at_, pos) + 1500 AS stop FROM p)
SELECT key, chunk, text[start + 1:least(length(text), stop)] AS body, CASE WHEN text IS NOT NULL THEN start > 0 END AS cut_start, stop < length(text) AS cut_end FROM b""")
def previews(spark, d):
    f = files_of(spark, d)
    i = F.col("doc_id")
    wanted = metadata(spark, d).select("key", (i % 3).cast("int").alias("chunk"), F.when(i % 2 == 0, (i % 700).cast("int")).alias("at"), F.array(F.lit("thtion")).alias("terms"))
    return C.previews(f, wanted).select("key", "chunk", F.col("preview.text").alias("body"), "preview.cut_start", "preview.cut_end")


@query(f"WITH {FILES} SELECT key, chunk, regexp_replace(text, '(thtion|tion|e\\.)', '<mark>\\1</mark>', 'gi') AS marked FROM chunks")
def highlight_marks(spark, d):
    return C.chunk_rows(files_of(spark, d)).select("key", "chunk", X.highlight_marks(F.col("text"), F.array(F.lit("tion"), F.lit("e."), F.lit("thtion"))).alias("marked"))


@query(f"WITH {FILES} SELECT key, CASE WHEN size * 997 >= 1048576 THEN printf('%.1f MB', size * 997 / 1048576.0) ELSE greatest(1, CAST(floor(size * 997 / 1024.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)) || ' KB' END AS size, strftime(make_timestamp(mtime * 1000), '%d/%m/%Y %H:%M') AS at FROM files")
def format_size_mtime(spark, d):
    f = metadata(spark, d)
    return f.select("key", X.format_size(F.col("size") * 997).alias("size"), X.format_mtime(F.col("mtime")).alias("at"))


# ---- predicates and synchronisation ------------------------------------------------------------------------------------


@query(f"WITH {FILES} SELECT key, ext FROM files WHERE ext IN ('.docx', '.pdf') AND folder_id = 'src3'")
def filter_pool(spark, d):
    return S.filter_pool(metadata(spark, d), ["Word", "PDF"], "src3").select("key", "ext")


@query(f"WITH {FILES} SELECT key FROM files WHERE error IS NULL AND (doc_id % 3 <> 0)")
def needs_embedding(spark, d):
    f = metadata(spark, d)
    return f.where(V.needs_embedding(F.col("error"), F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 0))).select("key")


@query(f"WITH {FILES}, l AS (SELECT key, sum(length(text)) AS n FROM chunks GROUP BY key) SELECT f.key, coalesce(CASE WHEN doc_id % 5 = 0 THEN doc_id % 2 = 0 END, doc_id % 3 = 0 AND error IS NULL AND coalesce(n, 0) < 80) AS awaits FROM files f LEFT JOIN l ON l.key = f.key")
def awaits_tags(spark, d):
    f = C.corpus_from_documents(t(spark, d, "documents"))
    needs = F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") % 2 == 0)
    return f.select("key", Y.awaits_tags(needs, F.when(F.col("doc_id") % 3 == 0, ".png").otherwise(F.col("ext")), F.col("error"), F.col("chunks")).alias("awaits"))


@query(f"WITH p AS (SELECT coalesce(source, 'unknown') AS doc, doc_id AS page FROM documents WHERE length(regexp_replace(text, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')) < 200) SELECT doc, page, CAST(r AS INT) AS r FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page) AS r FROM p) WHERE r <= 200")
def ocr_backlog(spark, d):
    pages = t(spark, d, "documents").select(F.coalesce("source", F.lit("unknown")).alias("doc"), F.col("doc_id").alias("page"), "text")
    return Y.ocr_backlog(pages, least=200)


OLD_SQL = "old AS (SELECT key, folder_id, rel, mtime, CASE WHEN doc_id % 202 = 0 THEN 200000000 ELSE size END AS size, CASE ext WHEN '.pdf' THEN 2 ELSE 1 END AS v, CASE WHEN doc_id % 202 = 0 THEN 'ไฟล์ใหญ่เกินกำหนด' WHEN doc_id % 43 = 0 THEN 'broken' ELSE error END AS error, doc_id % 17 = 0 AS needs_ocr, doc_id % 19 = 0 AS awaits, doc_id FROM files WHERE doc_id % 13 <> 0)"
NEW_SQL = "new AS (SELECT key, folder_id, rel, mtime + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS mtime, CASE WHEN doc_id % 101 = 0 THEN 200000000 ELSE size END AS size, CASE ext WHEN '.pdf' THEN 2 ELSE 1 END AS v, doc_id % 89 <> 0 AS readable, ext, doc_id FROM files WHERE doc_id % 11 <> 0)"
PLAN_SQL = """plan AS (SELECT coalesce(n.key, o.key) AS key, coalesce(n.folder_id, o.folder_id) AS folder_id, o.rel,
  coalesce(o.mtime = n.mtime AND o.size = n.size AND o.v = n.v, false) AS same, o.error, o.needs_ocr, o.awaits, n.key AS nkey, o.key AS okey, n.readable, n.size
  FROM old o FULL JOIN new n ON o.key = n.key),
acted AS (SELECT key, folder_id, rel, CASE WHEN nkey IS NULL THEN 'gone' WHEN NOT readable THEN 'failed' WHEN good AND NOT coalesce(awaits, false) THEN 'skip' WHEN same AND error IS NOT NULL AND size > 104857600 THEN 'failed' ELSE 'todo' END AS action, okey IS NOT NULL AS known, same, good AS text_good
  FROM (SELECT *, same AND error IS NULL AND NOT coalesce(needs_ocr, false) AS good FROM plan))"""


def _both(spark, d) -> tuple[DataFrame, DataFrame]:
    f = metadata(spark, d).withColumn("v", X.reader_version(F.col("ext")))
    i = F.col("doc_id")
    large = F.when(i % 202 == 0, Y.TOO_LARGE).when(i % 43 == 0, "broken").otherwise(F.col("error"))
    old = f.where(i % 13 != 0).select("key", "folder_id", "rel", "mtime", F.when(i % 202 == 0, 200000000).otherwise(F.col("size")).alias("size"), "v", large.alias("error"), (i % 17 == 0).alias("needs_ocr"), (i % 19 == 0).alias("awaits_tags"))
    new = f.where(i % 11 != 0).select("key", "folder_id", "rel", (F.col("mtime") + F.when(i % 7 == 0, 1).otherwise(0)).alias("mtime"), F.when(i % 101 == 0, 200000000).otherwise(F.col("size")).alias("size"), "v", (i % 89 != 0).alias("readable"))
    return old, new


@query(f"WITH {FILES}, {OLD_SQL}, {NEW_SQL}, {PLAN_SQL} SELECT key, action, known, same, text_good FROM acted")
def plan_sync(spark, d):
    old, new = _both(spark, d)
    return Y.plan_sync(old, new, ocr=True, tags=True)


@query(f"WITH {FILES}, {OLD_SQL}, {NEW_SQL}, {PLAN_SQL} SELECT key, action, known, same, text_good FROM acted")
def plan_sync_stored(spark, d):
    """The same against a stored state in buckets, which does not move."""
    old, new = _both(spark, d)
    name = "sync_state_" + uuid.uuid4().hex
    return Y.plan_sync(Y.save_sync_state(old, name, folder(spark, "sync"), 2 * spark.sparkContext.defaultParallelism), new, ocr=True, tags=True)


def _fate(spark, d) -> DataFrame:
    old, new = _both(spark, d)
    gone = Y.plan_sync(old, new, True, True).where("action = 'gone'").select("key").join(old, "key").select("key", "folder_id", "rel")
    return Y.detect_removed(gone, spark.createDataFrame([("src1", "en/"), ("src2", "")], "folder_id string, prefix string"))


FATE_SQL = "fate AS (SELECT key, folder_id, CASE WHEN (folder_id = 'src1' AND rel LIKE 'en/%') OR folder_id = 'src2' THEN 'kept' ELSE 'removed' END AS fate FROM acted WHERE action = 'gone')"


@query(f"WITH {FILES}, {OLD_SQL}, {NEW_SQL}, {PLAN_SQL}, {FATE_SQL} SELECT * FROM fate")
def detect_removed(spark, d):
    return _fate(spark, d)


def _applied(spark, d) -> DataFrame:
    """What reading gave is made up where the tables cannot tell: bytes that could not be read, broken files, images and their tags."""
    old, new = _both(spark, d)
    files = records(spark, d)
    plan = Y.plan_sync(old, new, True, True).where("action = 'todo'")
    i = F.col("doc_id")
    todo = plan.join(new.select("key", "folder_id", "size"), "key").join(old.select("key", F.col("error").alias("old_error"), F.col("needs_ocr").alias("old_needs_ocr")), "key", "left")
    todo = todo.join(files.select("key", "doc_id", "chunks", F.when(i % 3 == 0, ".png").otherwise(F.col("ext")).alias("ext")), "key")
    todo = todo.withColumns({"readable": i % 83 != 0, "new_error": F.when(i % 43 == 0, "broken").when(i % 47 == 0, F.repeat(F.lit("x"), 400)), "new_needs_ocr": i % 5 == 0, "tag_text": F.when(i % 4 == 0, "cat").when(i % 4 == 1, "")})
    return Y.apply_sync(todo.withColumn("old_chunks", F.slice("chunks", 1, 1)).withColumnRenamed("chunks", "new_chunks"), tags=True)


APPLY_SQL = f"""k AS (SELECT f.key, count(c.key) AS c, coalesce(sum(length(c.text)), 0) AS n, coalesce(max(CASE WHEN c.chunk = 0 THEN length(c.text) END), 0) AS n1 FROM files f LEFT JOIN chunks c ON c.key = f.key GROUP BY f.key),
a0 AS (SELECT a.key, a.folder_id, a.known, a.same, a.text_good, n.doc_id, n.size > 104857600 AS large, n.doc_id % 83 = 0 AS lost, o.error AS old_error, o.needs_ocr AS old_ocr, CASE WHEN n.doc_id % 43 = 0 THEN 'broken' WHEN n.doc_id % 47 = 0 THEN repeat('x', 300) END AS new_error, CASE WHEN n.doc_id % 3 = 0 THEN '.png' ELSE n.ext END AS ext, k.c, k.n, k.n1
  FROM acted a JOIN new n USING (key) LEFT JOIN old o USING (key) JOIN k USING (key) WHERE a.action = 'todo'),
a1 AS (SELECT *, lost AND known AND NOT large AS stale, CASE WHEN large THEN '{Y.TOO_LARGE}' WHEN lost AND NOT known THEN '{Y.UNREADABLE}' WHEN NOT lost AND NOT text_good THEN new_error END AS err FROM a0),
a2 AS (SELECT *, CASE WHEN err IS NOT NULL THEN 0 WHEN text_good THEN least(c, 1) ELSE c END AS text_chunks, err IS NULL AND NOT stale AND ext IN ('.png', '.jpg', '.jpeg', '.bmp') AND CASE WHEN text_good THEN n1 ELSE n END < 80 AS open_ FROM a1),
applied AS (SELECT key, folder_id, known, CASE WHEN stale THEN old_error ELSE err END AS error, CASE WHEN stale THEN least(c, 1) ELSE text_chunks + CASE WHEN open_ AND doc_id % 4 = 0 THEN 1 ELSE 0 END END AS n_chunks,
  CASE WHEN stale OR (err IS NULL AND text_good) THEN coalesce(old_ocr, false) WHEN err IS NOT NULL THEN false ELSE doc_id % 5 = 0 END AS needs_ocr, open_ AND doc_id % 4 > 1 AS needs_tags, NOT stale AND NOT (same AND err IS NOT NULL AND err IS NOT DISTINCT FROM old_error) AS write, stale OR err IS NOT NULL AS failed FROM a2)"""


@query(f"WITH {FILES}, {OLD_SQL}, {NEW_SQL}, {PLAN_SQL}, {APPLY_SQL} SELECT key, error, CAST(n_chunks AS INT) AS n_chunks, needs_ocr, needs_tags, write, failed FROM applied")
def apply_sync(spark, d):
    return _applied(spark, d).select("key", "error", F.size("chunks").alias("n_chunks"), "needs_ocr", "needs_tags", "write", "failed")


@query(f"""WITH {FILES}, {OLD_SQL}, {NEW_SQL}, {PLAN_SQL}, {FATE_SQL}, {APPLY_SQL} SELECT a.folder_id, count(*) FILTER (action = 'todo' AND NOT a.known AND write) AS added, count(*) FILTER (action = 'todo' AND a.known AND write) AS updated, count(*) FILTER (action = 'skip') AS unchanged,
  count(*) FILTER (fate = 'removed') AS removed, count(*) FILTER (action = 'failed' OR failed) AS failed, count(*) FILTER (fate = 'kept') AS kept FROM acted a LEFT JOIN (SELECT key, fate FROM fate) USING (key) LEFT JOIN (SELECT key, write, failed FROM applied) USING (key) GROUP BY a.folder_id""")
def sync_counts(spark, d):
    old, new = _both(spark, d)
    plan = Y.plan_sync(old, new, True, True).join(old.select("key", "folder_id").unionByName(new.select("key", "folder_id")).distinct(), "key")
    return Y.sync_counts(plan.join(_fate(spark, d).select("key", "fate"), "key", "left").join(_applied(spark, d).select("key", "write", "failed"), "key", "left"))


_STATS = "SELECT folder_id, count(*) AS total, count(error) AS errors, count(*) FILTER (doc_id % 17 = 0) AS needs_ocr, count(*) FILTER (doc_id % 190 = 0) AS needs_tags FROM files GROUP BY folder_id"


@query(f"WITH {FILES} {_STATS}")
def corpus_stats(spark, d):
    f = metadata(spark, d)
    return Y.corpus_stats(f.withColumns({"needs_ocr": F.col("doc_id") % 17 == 0, "needs_tags": F.col("doc_id") % 190 == 0}))


@query(f"WITH {FILES} SELECT folder_id FROM ({_STATS}) WHERE needs_ocr > 0 OR needs_tags > 0")
def rescan_folders(spark, d):
    return Y.rescan_folders(corpus_stats(spark, d), ocr=True, tags=True)


@query(f"SELECT conv_id, turn, CASE WHEN turn = 0 THEN '{X.TAG_LOC}' ELSE 'turn ' || turn END AS loc FROM conversations")
def migrate_tag_loc(spark, d):
    c = t(spark, d, "conversations").withColumn("c", F.array(F.struct(F.when(F.col("turn") == 0, X.OLD_TAG_LOCS[0]).otherwise(F.concat(F.lit("turn "), "turn")).alias("loc"), "text")))
    return c.select("conv_id", "turn", F.get(C.migrate_tag_loc(F.col("c")), F.lit(0))["loc"].alias("loc"))


# ---- search --------------------------------------------------------------------------------------------------------------


@query(f"WITH {FILES}, {Q_SQL}, {EXACT_SQL} SELECT qid, key, hit_count, hits FROM exact")
def search_exact(spark, d):
    return flat_hits(S.search_exact(files_of(spark, d), asked(spark))).select("qid", "key", "hit_count", "hits")


@query(f"WITH {FILES}, {Q_SQL}, {EXACT_SQL}, {LOOSE_SQL} SELECT qid, key, hit_count, hits FROM loose")
def search_loose(spark, d):
    f, q = files_of(spark, d), asked(spark)
    return flat_hits(S.search_loose(f, q, S.search_exact(f, q))).select("qid", "key", "hit_count", "hits")


@query(f"WITH {FILES}, {Q_SQL}, {EXACT_SQL} SELECT qid, key, hit_count, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hit_count DESC, mtime DESC, key) AS rank FROM exact) WHERE rank <= 200")
def rank_results(spark, d):
    return S.rank_results(S.search_exact(files_of(spark, d), asked(spark))).select("qid", "key", "hit_count", "rank")


@query("SELECT DISTINCT w AS term, CASE WHEN NOT regexp_matches(w, '\\p{L}') OR length(w) < 5 THEN 0 WHEN length(w) < 9 THEN 1 ELSE 2 END AS k FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents)")
def edit_allowance_of_words(spark, d):
    w = t(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("term")).distinct()
    return w.select("term", edit_allowance(F.col("term")).alias("k"))


@query(f"WITH {FILES}, {Q_SQL}, {EXACT_SQL}, {LOOSE_SQL}, {NEAR_SQL} SELECT qid, key, errors, hit_count, marks, hits FROM near")
def search_near(spark, d):
    f, q = files_of(spark, d), asked(spark)
    _, _, near = S.search_text(f, q)
    return flat_hits(near).select("qid", "key", "errors", "hit_count", F.array_join("marks", "|").alias("marks"), "hits")


@query(f"WITH {FILES}, {Q_SQL}, {EXACT_SQL}, {LOOSE_SQL}, {SHOWN_SQL} SELECT qid, key, kind, hit_count, errors, rank FROM shown")
def search_all(spark, d):
    return S.search_all(files_of(spark, d), asked(spark)).drop("mtime")


@query(f"WITH {FILES}, {Q_SQL}, {EXACT_SQL}, {LOOSE_SQL}, {REPORT_SQL}")
def search_report(spark, d):
    f, q = files_of(spark, d), asked(spark)
    return S.search_report(f, S.summarise(q, *S.search_text(f, q)))


# Many queries: of every 50th document, its first long word, and that word with another third letter.
def _many_sql(word: str) -> str:
    return f"q AS (SELECT doc_id AS qid, [{word}] AS lows, CAST(NULL AS VARCHAR) AS types, CAST(NULL AS VARCHAR) AS folder, false AS near FROM documents WHERE doc_id % 50 = 0 AND {word} <> '')"


LONG_WORD = "regexp_extract(coalesce(text, ''), '[a-z]{9,}')"


def _many(spark, d, word: str) -> DataFrame:
    q = t(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), F.expr(word).alias("query")).where("query <> ''")
    return S.prepare_queries(q.withColumns({"types": F.lit(None).cast("array<string>"), "folder_id": F.lit(None).cast("string"), "near": F.lit(False)}))


@query(f"WITH {FILES}, {_many_sql(LONG_WORD)}, {EXACT_SQL} SELECT qid, key, hit_count, hits FROM exact")
def search_exact_many(spark, d):
    q = _many(spark, d, "regexp_extract(coalesce(text, ''), '[a-z]{9,}', 0)")
    return flat_hits(S.search_exact(files_of(spark, d), q, scan=0)).select("qid", "key", "hit_count", "hits")


@query()  # NEAR_SQL over these queries gives the same rows, but takes minutes
def search_near_many(spark, d):
    q = _many(spark, d, "regexp_replace(regexp_extract(coalesce(text, ''), '[a-z]{9,}', 0), '^(..).', '$1x')")
    f = files_of(spark, d)
    near = S.search_near(f, q, S.results_of(*S.search_whole(f, q, scan=0)), scan=0)
    return flat_hits(near).select("qid", "key", "errors", "hit_count", F.array_join("marks", "|").alias("marks"), "hits")


# Vectors of the files: five for each document in turn, the first of its name, the others of pieces of its first chunk. Every 50th vector asks.
def semantic_sql() -> str:
    return f"""pas AS (SELECT f.key, f.folder_id, f.ext, f.name, e.vec_id % 5 AS p, CASE WHEN e.vec_id % 5 = 0 THEN -1 ELSE 0 END AS chunk, CASE WHEN e.vec_id % 5 = 0 THEN 0 ELSE (e.vec_id % 5 - 1) * 40 END AS pos, 40 AS len, f.doc_id % 7 <> 3 AS current, {QUANT_SQL % 'e.embedding'} AS vec FROM embeddings e JOIN files f ON f.doc_id = e.vec_id // 5),
qv AS (SELECT vec_id // 50 AS qid, embedding AS qvec, CASE WHEN vec_id % 500 = 50 THEN 'src3' END AS folder, CASE WHEN vec_id % 500 = 100 THEN 'Word' END AS kinds, CASE WHEN vec_id % 500 = 150 THEN '1 x' ELSE 'words' END AS query FROM embeddings WHERE vec_id % 50 = 0),
sem AS MATERIALIZED (SELECT * FROM (SELECT qid, key, p, chunk, {DOT_SQL.format(a='qvec', b='f.vec')} / 127 * CASE WHEN chunk < 0 THEN 0.75::DOUBLE ELSE 1 END AS score FROM pas f JOIN qv ON f.current AND query = 'words' AND (folder IS NULL OR folder = f.folder_id) AND (kinds IS NULL OR kinds = {TYPES_SQL % 'f.ext'})) WHERE score >= 0.35),
semk AS (SELECT *, row_number() OVER (PARTITION BY qid, key ORDER BY score DESC, p) AS r FROM sem WHERE (qid, key) NOT IN (SELECT qid, key FROM skip)),
semf AS (SELECT qid, key, max(score) AS score, count(*) AS hit_count, string_agg(CAST(p AS VARCHAR), ',' ORDER BY r) FILTER (r <= 2) AS hits FROM semk GROUP BY qid, key),
semr AS MATERIALIZED (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS INT) AS rank FROM semf) WHERE rank <= 5)"""


def _by_meaning(spark, d, files: DataFrame, skip: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results by meaning and the passages, whose vectors are those of `embeddings`."""
    e, i = t(spark, d, "embeddings"), F.col("vec_id")
    docs = files.select("doc_id", "key")
    p = e.join(docs, F.floor(i / 5) == F.col("doc_id")).select("key", (i % 5).alias("p"), F.when(i % 5 == 0, -1).otherwise(0).alias("chunk"), F.when(i % 5 == 0, 0).otherwise((i % 5 - 1) * 40).cast("int").alias("pos"), F.lit(40).alias("len"), V.quantize_vectors(F.col("embedding")).alias("vec"))
    q = e.where(i % 50 == 0).select(F.floor(i / 50).alias("qid"), F.col("embedding").alias("vec"), F.when(i % 500 == 50, "src3").alias("folder_id"), F.when(i % 500 == 100, F.array(F.lit("Word"))).alias("types"), F.when(i % 500 == 150, "1 x").otherwise("words").alias("query"))
    versioned = files.withColumn("sem_version", F.when(F.col("doc_id") % 7 != 3, 1))
    return V.semantic_search(p, q, skip, versioned), p


SKIP_SQL = "skip AS (SELECT qid, key FROM shown)"


def present_sql() -> str:
    return f"""WITH {FILES}, {Q_SQL}, {EXACT_SQL}, {LOOSE_SQL}, {SHOWN_SQL}, {SKIP_SQL}, {semantic_sql()},
allr AS (SELECT qid, key, kind, rank, CASE kind WHEN 'near' THEN 1 ELSE 0 END AS grp FROM shown UNION ALL SELECT qid, key, 'sem', rank, 2 FROM semr),
nr AS (SELECT *, row_number() OVER w AS n, lag(grp) OVER w AS before_ FROM allr WINDOW w AS (PARTITION BY qid ORDER BY grp, rank, key))
SELECT qid, key, kind, CAST(n AS INT) AS n, grp > 0 AND coalesce(before_ <> grp, grp = 2) AS divider, CAST((n - 1) // 20 AS BIGINT) AS page FROM nr"""


def present_results(spark, d):
    f = files_of(spark, d)
    shown = written(S.search_all(f, asked(spark)), "shown")
    found, _ = _by_meaning(spark, d, f, shown)
    return S.present_results(shown, found)


# ---- duplicates ----------------------------------------------------------------------------------------------------------

DUP_SQL = f"dt AS MATERIALIZED (SELECT key, mtime, t FROM (SELECT f.key, any_value(mtime) AS mtime, regexp_replace(string_agg(low, '' ORDER BY chunk), '[{_SPACE}]+', '', 'g') AS t FROM files f JOIN chunks c ON c.key = f.key WHERE error IS NULL GROUP BY f.key) WHERE length(t) >= 40)"


@query(f"WITH {FILES}, {DUP_SQL} SELECT key, t FROM dt")
def dup_text(spark, d):
    return D.dup_text(records(spark, d)).select("key", "t")


@query(f"WITH {FILES}, {DUP_SQL} SELECT min(key) AS cls, count(*) AS n FROM dt GROUP BY t HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return D.exact_duplicates(D.dup_text(records(spark, d)))


_H = "CAST(2166136261 AS HUGEINT)"
for _k in range(5):
    _H = f"(xor({_H}, CAST(unicode(t[i + {_k}]) AS HUGEINT)) * 16777619 % 4294967296)"
PRINT_SQL = f"""cl AS (SELECT min(key) AS cls, count(*) AS size, t FROM dt GROUP BY t HAVING length(t) >= 200),
g0 AS (SELECT cls, length(t) - 4 AS grams, t, unnest(range(1, length(t) - 3)) AS i FROM cl), g1 AS (SELECT cls, grams, {_H} AS h FROM g0),
g2 AS (SELECT cls, grams, xor(h, h >> 16) * 2246822507 % 4294967296 AS h FROM g1), g3 AS (SELECT cls, grams, xor(h, h >> 13) * 3266489909 % 4294967296 AS h FROM g2), g4 AS (SELECT cls, grams, CAST(xor(h, h >> 16) AS BIGINT) AS h FROM g3),
g5 AS (SELECT DISTINCT cls, grams, h FROM g4 WHERE grams <= 4096 OR h < 268435456), g6 AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY h) AS r, count(*) OVER (PARTITION BY cls) AS n FROM g5),
prints AS MATERIALIZED (SELECT cls, list(h ORDER BY h) AS vals, any_value(grams <= 4096 AND n < 128) AS full_ FROM g6 WHERE r <= 128 GROUP BY cls)"""


def _prints(spark, d) -> DataFrame:
    made = D.prints(D.dup_text(C.corpus_from_documents(t(spark, d, "documents"))))
    return D.fingerprint(made, D.classes(made)[1])


@query(f"WITH {FILES}, {DUP_SQL}, {PRINT_SQL} SELECT cls, array_to_string(vals, ',') AS vals, full_ AS is_full FROM prints")
def fingerprint(spark, d):
    p = _prints(spark, d)
    return p.select("cls", F.array_join(F.transform("vals", lambda v: v.cast("string")), ",").alias("vals"), F.col("full").alias("is_full"))


#: Pairs by hashes that up to 400 files have, and by all hashes.
PAIR_SQL, ALL_PAIR_SQL = (f"""{PRINT_SQL}, posts AS (SELECT p.cls, cl.size, len(p.vals) AS n, unnest(p.vals) AS v FROM prints p JOIN cl ON cl.cls = p.cls),
rare AS (SELECT v FROM posts GROUP BY v HAVING {cut}count(*) > 1), kept AS (SELECT * FROM posts WHERE v IN (SELECT v FROM rare)),
cand AS (SELECT a.cls AS a, b.cls AS b, count(*) AS shared FROM kept a JOIN kept b ON a.v = b.v AND a.cls < b.cls GROUP BY a.cls, b.cls, a.n, b.n HAVING count(*) >= 0.3 * least(a.n, b.n)),
lim AS (SELECT c.a, c.b, x.vals AS av, y.vals AS bv, CASE WHEN x.full_ AND y.full_ THEN NULL WHEN x.full_ THEN list_max(y.vals) WHEN y.full_ THEN list_max(x.vals) ELSE least(list_max(x.vals), list_max(y.vals)) END AS l FROM cand c JOIN prints x ON x.cls = c.a JOIN prints y ON y.cls = c.b),
uni AS (SELECT a, b, av, bv, list_sort(list_filter(list_distinct(list_concat(av, bv)), lambda v: l IS NULL OR v <= l))[1:128] AS u FROM lim),
near AS (SELECT a, b, CAST(len(list_intersect(u, list_intersect(av, bv))) AS DOUBLE) / len(u) AS sim FROM uni WHERE len(u) > 0), links AS MATERIALIZED (SELECT * FROM near WHERE sim >= 0.85)""" for cut in ("sum(size) <= 400 AND ", ""))


def _found(spark, d, similar=D.near_duplicates):
    return D.find_duplicates(C.corpus_from_documents(t(spark, d, "documents")), similar)


def _groups(spark, d, similar=D.near_duplicates) -> tuple[DataFrame, DataFrame]:
    members, edges = _found(spark, d, similar)
    return written(D.grouped(members, edges), "groups"), edges


@query(f"WITH {FILES}, {DUP_SQL}, {PAIR_SQL} SELECT a, b, shared FROM cand")
def dup_candidates(spark, d):
    return D.dup_candidates(written(_prints(spark, d), "fingerprints"))


@query(f"WITH {FILES}, {DUP_SQL}, {ALL_PAIR_SQL} SELECT a, b, round(sim, 6) AS sim FROM links")
def near_duplicates(spark, d):
    return _found(spark, d, D.similar_pairs)[1].select("a", "b", F.round("sim", 6).alias("sim"))


MEMBER_SQL = "members AS (SELECT d.key, d.mtime, x.cls, x.size FROM dt d JOIN (SELECT t, min(key) AS cls, count(*) AS size FROM dt GROUP BY t) x ON x.t = d.t)"


@query(f"""WITH {FILES}, {DUP_SQL}, {PAIR_SQL}, {MEMBER_SQL}, e AS (SELECT a, b, sim, false AS exact FROM links UNION ALL SELECT b, a, sim, false FROM links UNION ALL SELECT DISTINCT cls, cls, 1.0, true FROM members WHERE size > 1)
SELECT key, other, exact, round(sim, 6) AS sim, CAST(rank AS INT) AS rank FROM (SELECT m.key, o.key AS other, exact, sim, row_number() OVER (PARTITION BY m.key ORDER BY exact DESC, sim DESC, o.mtime DESC, o.key) AS rank FROM members m JOIN e ON e.a = m.cls JOIN members o ON o.cls = e.b AND o.key <> m.key) WHERE rank <= 20""")
def dup_neighbors(spark, d):
    return D.dup_neighbors(*_found(spark, d)).select("key", "other", "exact", F.round("sim", 6).alias("sim"), "rank")


GROUP_SQL = f"""{MEMBER_SQL}, e AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS MATERIALIZED (SELECT a, min(b) AS g FROM (WITH RECURSIVE r(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT * FROM r) GROUP BY a),
ing AS MATERIALIZED (SELECT m.key, m.mtime, m.cls, coalesce(g, cls) AS group_id FROM members m LEFT JOIN reach ON reach.a = m.cls WHERE g IS NOT NULL OR size > 1),
grp AS MATERIALIZED (SELECT group_id, count(*) AS n, min(cls) = max(cls) AS exact, arg_min(key, (-mtime, key)) AS newest, max(mtime) > min(mtime) AS differ, any_value(s.sim) AS sim FROM ing LEFT JOIN (SELECT r.g, min(sim) AS sim FROM links l JOIN reach r ON r.a = l.a GROUP BY r.g) s ON s.g = group_id GROUP BY group_id)"""


@query(f"WITH {FILES}, {DUP_SQL}, {PAIR_SQL}, {GROUP_SQL} SELECT group_id, n, exact, round(coalesce(sim, 1.0), 6) AS sim, newest, (SELECT count(*) FROM grp) AS total_groups, CAST((SELECT sum(n) FROM grp) AS BIGINT) AS total_files FROM grp ORDER BY n DESC, exact DESC, coalesce(sim, 1.0) DESC, group_id LIMIT 100")
def dup_groups(spark, d):
    return D.dup_groups(*_groups(spark, d)).withColumn("sim", F.round("sim", 6))


@query(f"WITH {FILES}, {DUP_SQL}, {ALL_PAIR_SQL}, {GROUP_SQL} SELECT i.key, i.group_id, i.mtime, differ AND i.key = newest AS newest FROM ing i JOIN grp USING (group_id)")
def dup_report(spark, d):
    return D.dup_report(_groups(spark, d, D.linking_pairs)[0])


@query(f"""WITH {FILES}, {DUP_SQL}, {PAIR_SQL}, {MEMBER_SQL}, {Q_SQL}, {EXACT_SQL}, e AS (SELECT a, b, sim, false AS exact FROM links UNION ALL SELECT b, a, sim, false FROM links UNION ALL SELECT DISTINCT cls, cls, 1.0, true FROM members WHERE size > 1),
n AS (SELECT * FROM (SELECT m.key, o.key AS other, o.mtime, exact, sim, row_number() OVER (PARTITION BY m.key ORDER BY exact DESC, sim DESC, o.mtime DESC, o.key) AS rank FROM members m JOIN e ON e.a = m.cls JOIN members o ON o.cls = e.b AND o.key <> m.key) WHERE rank <= 20),
j AS (SELECT x.qid, x.key, n.*, n.mtime = max(n.mtime) OVER (PARTITION BY x.qid, x.key) AND n.mtime > x.mtime AS newest FROM exact x LEFT JOIN n ON n.key = x.key)
SELECT qid, key, count(*) FILTER (exact) AS n_exact, count(*) FILTER (NOT exact) AS n_similar, coalesce(string_agg(other || CASE WHEN newest THEN '*' ELSE '' END, ',' ORDER BY rank), '') AS others FROM (SELECT qid, key, other, exact, newest, rank FROM j) GROUP BY qid, key""")
def annotate_dups(spark, d):
    files = records(spark, d)  # texts are cut into chunks once for both
    near = D.dup_neighbors(*D.find_duplicates(files))
    r = D.annotate_dups(S.search_exact(C.prepare_search(files), asked(spark)), near)
    return r.withColumn("others", F.array_join(F.transform("others", lambda x: F.concat(x["key"], F.when(x["newest"], "*").otherwise(""))), ","))


# ---- vectors -------------------------------------------------------------------------------------------------------------

QUANT_SQL = "list_transform(%s, lambda x: greatest(-127, least(127, CAST(floor(CAST(x AS DOUBLE) * 127 + 0.5::DOUBLE) AS BIGINT))))"
DOT_SQL = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
POOL = "pool AS (SELECT label, list(m ORDER BY d) AS v FROM (SELECT label, d, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings) GROUP BY label, d) GROUP BY label), mean AS (SELECT label, list_transform(v, lambda x: x / n) AS vec FROM (SELECT label, v, CASE WHEN list_sum(list_transform(v, lambda x: x * x)) > 0 THEN sqrt(list_sum(list_transform(v, lambda x: x * x))) ELSE 1 END AS n FROM pool))"


@query(f"SELECT vec_id, array_to_string({QUANT_SQL % 'embedding'}, ',') AS q FROM embeddings")
def quantize_vectors(spark, d):
    return t(spark, d, "embeddings").select("vec_id", F.array_join(F.transform(V.quantize_vectors(F.col("embedding")), lambda x: x.cast("string")), ",").alias("q"))


@query(f"WITH {POOL} SELECT label, generate_subscripts(vec, 1) - 1 AS d, round(unnest(vec), 6) AS x FROM mean")
def mean_pool(spark, d):
    return V.mean_pool(t(spark, d, "embeddings"), "label", "embedding").select("label", F.posexplode("vec").alias("d", "x")).select("label", F.col("d").cast("long").alias("d"), F.round("x", 6).alias("x"))


PASS_SQL = f"pas AS (SELECT 'k' || label AS key, vec_id AS p, CASE WHEN vec_id % 10 = 0 THEN -1 ELSE vec_id % 5 END AS chunk, {QUANT_SQL % 'embedding'} AS vec FROM embeddings), qv AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), sc AS (SELECT qid, key, p, chunk, {DOT_SQL.format(a='q', b='vec')} / 127 * CASE WHEN chunk < 0 THEN 0.75::DOUBLE ELSE 1 END AS score FROM pas, qv)"


def _passages(spark, d):
    e = t(spark, d, "embeddings")
    p = e.select(F.concat(F.lit("k"), "label").alias("key"), F.col("vec_id").alias("p"), F.when(F.col("vec_id") % 10 == 0, -1).otherwise(F.col("vec_id") % 5).alias("chunk"), V.quantize_vectors(F.col("embedding")).alias("vec"))
    return p, e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))


@query(f"WITH {PASS_SQL} SELECT qid, key, p, chunk, round(score, 6) AS score FROM sc WHERE score >= 0.35")
def vector_scores(spark, d):
    return V.vector_scores(*_passages(spark, d)).withColumn("score", F.round("score", 6))


def meaning_sql() -> str:
    """Results by meaning with their snippets; files of the first folder's documents are skipped for the first query."""
    return f"""WITH {FILES}, skip AS (SELECT 0 AS qid, key FROM files WHERE folder_id = 'src1'), {semantic_sql()},
u AS (SELECT qid, key, score, hit_count, hits, rank, unnest(string_split(hits, ',')) AS p, generate_subscripts(string_split(hits, ','), 1) AS n FROM semr),
s AS (SELECT u.*, CASE WHEN pas.chunk < 0 THEN '{X.NAME_LOC}|' || pas.name ELSE c.loc || '|' || CASE WHEN pos > 0 THEN '…' ELSE '' END || regexp_replace(replace(c.text[pos + 1:pos + len], chr(10), ' '), '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g') || CASE WHEN pos + len < length(c.text) THEN '…' ELSE '' END END AS snippet
  FROM u JOIN pas ON pas.key = u.key AND pas.p = CAST(u.p AS BIGINT) LEFT JOIN chunks c ON c.key = u.key AND c.chunk = 0)
SELECT qid, key, round(any_value(score), 6) AS score, any_value(hit_count) AS hit_count, any_value(hits) AS hits, any_value(rank) AS rank, string_agg(snippet, chr(10) ORDER BY n) AS snippets FROM s GROUP BY qid, key"""


@query(meaning_sql())
def semantic_search(spark, d):
    f = files_of(spark, d)
    found, p = _by_meaning(spark, d, f, f.where("folder_id = 'src1'").select(F.lit(0).cast("long").alias("qid"), "key"))
    found = written(found, "meaning")
    lines = V.semantic_snippets(found, p, f).groupBy("qid", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "loc", "snippet"))), lambda s: F.concat(s["loc"], F.lit("|"), s["snippet"])), "\n").alias("snippets"))
    return found.join(lines, ["qid", "key"]).withColumns({"score": F.round("score", 6), "hits": F.array_join(F.transform("hits", lambda p: p.cast("string")), ",")})


query(present_sql())(present_results)


SHARE_SQL = f"""{POOL}, lab AS (SELECT label, {QUANT_SQL % 'vec'} AS lv FROM mean),
s0 AS (SELECT vec_id AS item, lab.label AS label_id, {DOT_SQL.format(a='embedding', b='lv')} / 127 / sqrt({DOT_SQL.format(a='embedding', b='embedding')}) AS sim FROM embeddings, lab),
s1 AS (SELECT *, exp(100 * (sim - max(sim) OVER (PARTITION BY item))) AS e FROM s0), sh AS (SELECT *, e / sum(e) OVER (PARTITION BY item) AS share, row_number() OVER (PARTITION BY item ORDER BY sim DESC, label_id) AS rank FROM s1)"""


def _shares(spark, d):
    e = t(spark, d, "embeddings")
    labels = V.mean_pool(e, "label", "embedding").select(F.col("label").alias("label_id"), V.quantize_vectors(F.col("vec")).alias("vec"), F.concat(F.lit("ป"), "label").alias("th"), F.concat(F.lit("t"), "label").alias("en"))
    return V.zero_shot_share(e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vec")), labels), labels


@query(f"WITH {SHARE_SQL} SELECT item, label_id, round(sim, 6) AS sim, round(share, 6) AS share, CAST(rank AS INT) AS rank FROM sh WHERE rank <= 8")
def zero_shot_share(spark, d):
    return _shares(spark, d)[0].withColumns({"sim": F.round("sim", 6), "share": F.round("share", 6)})


TAGS_SQL = f"{SHARE_SQL}, k AS (SELECT * FROM sh WHERE rank <= 8 AND share >= 0.08), tg AS (SELECT item, string_agg('ป' || label_id, ', ' ORDER BY rank) || ' · ' || string_agg('t' || label_id, ', ' ORDER BY rank) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY rank) AS n FROM k) WHERE n <= 4 GROUP BY item HAVING max(share) >= 0.18)"


@query(f"WITH {TAGS_SQL} SELECT item, tags FROM tg")
def assign_tags(spark, d):
    return V.assign_tags(*_shares(spark, d))


@query(f"WITH {FILES}, {TAGS_SQL} SELECT item, (SELECT count(*) + 1 FROM chunks c WHERE c.key = f.key) AS n_chunks, '{X.TAG_LOC}' AS last_loc, tags AS last FROM tg JOIN files f ON f.doc_id = item")
def append_tag_chunk(spark, d):
    tags = V.assign_tags(*_shares(spark, d))
    old = records(spark, d).select(F.col("doc_id").alias("item"), F.array_insert("chunks", 1, F.struct(F.lit(X.TAG_LOC).alias("loc"), F.lit("old tags").alias("text"))).alias("chunks"))
    c = tags.join(old, "item").withColumn("c", V.append_tag_chunk(F.col("chunks"), F.col("tags")))
    return c.select("item", F.size("c").cast("long").alias("n_chunks"), F.element_at("c", -1)["loc"].alias("last_loc"), F.element_at("c", -1)["text"].alias("last"))


def passages_sql(rows: str = "ranked") -> str:
    blank = "length(regexp_extract(text[stop + 1:stop + 201], '(?s)^(.{101,200})[ \\n]', 1))"  # up to the last blank in reach
    letters = "length(regexp_replace(%s, '[^\\p{L}]+', '', 'g'))"
    return f"""WITH RECURSIVE {FILES}, steps AS (
  SELECT key, chunk, text, 0 AS start, 0 AS stop FROM chunks
  UNION ALL SELECT key, chunk, text, stop, CASE WHEN length(text) - stop <= 200 THEN length(text) ELSE stop + CASE WHEN {blank} > 0 THEN {blank} ELSE 200 END END FROM steps WHERE stop < length(text)
), spans AS (SELECT *, row_number() OVER (PARTITION BY key, chunk ORDER BY start) - 1 AS round FROM steps WHERE {letters % "text[start + 1:stop]"} >= 12),
named AS (SELECT key, -1 AS round, -1 AS chunk, 0 AS pos, length(stem) AS len, stem AS text FROM files WHERE {letters % "stem"} >= 8
  UNION ALL SELECT key, round, chunk, start, stop - start, text[start + 1:stop] FROM spans),
todo AS ({"SELECT * FROM named" if rows == "ranked" else "SELECT named.* FROM named JOIN files USING (key) WHERE doc_id % 3 <> 0 AND error IS NULL"}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round, chunk) - 1 AS p FROM todo)
SELECT key, CAST(p AS INT) AS p, CAST(chunk AS INT) AS chunk, CAST(pos AS INT) AS pos, CAST(len AS INT) AS len, text FROM ranked WHERE p < 40"""


@query(passages_sql())
def select_passages(spark, d):
    return V.select_passages(files_of(spark, d))


# ---- streams ---------------------------------------------------------------------------------------------------------------


#: Records of a file that a stream reads.
PART_ROWS = 10_000


def _parts(spark, d, df: DataFrame, tag: str) -> tuple[str, int]:
    """A folder of files of about PART_ROWS records, three or more, and how many of them are two thirds: a stream takes them in two batches."""
    path = folder(spark, tag)
    df.repartition(max(3, -(-df.count() // PART_ROWS)), "key").write.parquet(path)
    return path, -(-2 * len(spark.read.schema(df.schema).parquet(path).inputFiles()) // 3)


@query(f"WITH {FILES} SELECT key, mtime + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS mtime FROM files")
def stream_index(spark, d):
    from tidemill.streaming.streams import read_index
    from tidemill.streaming.streams import stream_index as start

    f = _keyed(spark, d)
    src, most = _parts(spark, d, f.unionByName(f.where("doc_id % 7 = 0").withColumn("mtime", F.col("mtime") + 1)), "incoming")
    out = folder(spark, "stream")
    start(spark, src, f.schema, out, folder(spark, "progress"), files_per_batch=most).awaitTermination()
    return read_index(spark, out).select("key", "mtime")


@query(f"WITH {FILES}, {Q_SQL}, {EXACT_SQL} SELECT qid, key, hit_count FROM exact")
def stream_search(spark, d):
    from tidemill.streaming.streams import read_hits
    from tidemill.streaming.streams import stream_search as start

    f = files_of(spark, d)
    out, (src, most) = folder(spark, "stream"), _parts(spark, d, f, "incoming")
    files = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", most).parquet(src)
    start(files, lambda: asked(spark), lambda: spark.read.schema(f.schema).parquet(src), out, folder(spark, "progress")).awaitTermination()
    return read_hits(spark, out, asked(spark))


@query(f"WITH p AS ({passages_sql('backlog')}) SELECT key, CAST(p AS INT) AS p, CAST(chunk AS INT) AS chunk, CAST(pos AS INT) AS pos, CAST(len AS INT) AS len, CAST(least(127, floor(len / 200.0::DOUBLE * 127 + 0.5::DOUBLE)) AS TINYINT) AS x FROM p")
def stream_embed_backlog(spark, d):
    """Vectors of one number, the share of a passage's length; every third document has them from before."""
    from tidemill.streaming import streams

    f, out = files_of(spark, d), folder(spark, "vectors")
    embed = lambda p: p.withColumn("vec", F.array((F.col("len") / 200).cast("float")))
    streams.embed_missing(f.where("doc_id % 3 = 0"), out, "before", embed)
    before = spark.read.parquet(out).select("key")
    start = lambda run: streams.stream_embed_backlog(spark.readStream.schema(f.schema).parquet(src), out, folder(spark, "progress"), embed, run)
    src, _ = _parts(spark, d, f, "incoming")
    start("first").awaitTermination()
    start("second").awaitTermination()  # finds everything done
    new = streams.read_vectors(spark, out, 1).join(before, "key", "left_anti")
    rows = new.select("key", F.posexplode(F.arrays_zip("at", "vecs")).alias("p", "r"))
    return rows.select("key", "p", "r.at.chunk", "r.at.pos", "r.at.len", F.get("r.vecs", F.lit(0)).alias("x"))
