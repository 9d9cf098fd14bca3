"""Many queries in one pass against scans, and what keeps Python workers and streams small."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions import text as X
from tidemill.operators import components, grams, many, search
from tidemill.operators.fuzzy import nearest_of
from tidemill.sources import corpus

LETTERS = "abcde กิไ\U00010400"


def words(r, n, low=1, high=14):
    return ["".join(r.choice(LETTERS.replace(" ", "")) for _ in range(r.randint(low, high))) for _ in range(n)]


def test_nearest_of_many_terms_is_nearest_of_each():
    r = random.Random(7)
    terms = sorted({(w * 3)[: r.choice((5, 8, 9, 12, 13, 17, 31, 32, 33, 40))] for w in words(r, 40, 3)})
    rows = [(t, r.choice((0, 1, 2)) if len(t) > 8 else r.choice((0, 1))) for t in terms]
    lows = ["", "a", *[" ".join([*words(r, 6), r.choice(terms)[r.randint(0, 2) :], *words(r, 6)]) for _ in range(60)]]
    for low, _ in zip(range(len(lows)), lows, strict=True):  # edits inside
        if lows[low]:
            at = r.randrange(len(lows[low]))
            lows[low] = lows[low][:at] + r.choice(LETTERS) + lows[low][at + r.randint(0, 1) :]
    held: list = []
    near = []
    for a, z in zip((0, *many.LENGTHS), many.LENGTHS, strict=False):
        own = [i for i, (t, k) in enumerate(rows) if k and a < min(len(t), many.MAX_PATTERN) <= z]
        near += [many.Near([rows[i][0] for i in own], [rows[i][1] for i in own], own)] if own else []
    whole = [t for t, k in rows if not k]
    found = many.nearest_all((rows, near, (whole, many.Starts(whole))), lows)
    for low, hits in zip(lows, found, strict=True):
        got = {h["term"]: (h["errors"], h["start"], h["end"]) for h in hits}
        want = {t: h for t, k in rows if (h := nearest_of([low], t, k)[0])}
        assert got == want and len(got) == len(hits)
        held += hits
    assert {h["errors"] for h in held} == {0, 1, 2}


def test_many_queries_take_one_pass_and_no_index(spark, monkeypatch):
    monkeypatch.setattr(grams, "build_grams", lambda *a: pytest.fail("an index was built"))
    monkeypatch.setattr(many, "SLICE", 1)  # and passes are put together
    texts = ["alpha beta gamma", "alpha\n" * 60 + "beta", "gamma delta", None, "alphq betta"]
    docs = spark.createDataFrame([(i, "src1", "en", t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, source string, lang string, text string, n_chars long")
    files = corpus.prepare_search(corpus.corpus_from_documents(docs)).persist()
    asked = [(1, "alpha beta", None), (2, "alpha beta", None), (3, "gamma", "none"), (4, "gamma", None), (5, "gammq", None), (6, "gamma", None), (7, "doc_1 alpha", None)]
    q = search.prepare_queries(spark.createDataFrame([(i, x, None, f, False) for i, x, f in asked], "qid int, query string, types array<string>, folder_id string, near boolean"))
    flat = lambda dfs: [sorted(map(str, df.collect())) for df in dfs]
    by_scan, together = flat(search.search_text(files, q)), flat(search.search_text(files, q, scan=0))
    assert by_scan == together and all(together)


def test_python_workers_get_few_bytes(spark):
    """A worker's memory does not grow with the texts of its task."""
    conf, before = spark.conf, spark.conf.get(components.BATCH_LIMIT)
    try:
        conf.set(components.BATCH_LIMIT, components.BATCH_DEFAULT)
        components.folder(spark, "x")
        assert int(conf.get(components.BATCH_LIMIT).rstrip("b")) == components.BATCH_BYTES
        sizes = spark.range(400, numPartitions=1).select(F.repeat(F.lit("x"), 50_000).alias("t")).mapInArrow(lambda bs: (type(b).from_pydict({"n": [b.nbytes]}) for b in bs), "n long")
        assert max(r["n"] for r in sizes.collect()) < 2 * components.BATCH_BYTES
        conf.set(components.BATCH_LIMIT, "1m")
        components.folder(spark, "x")
        assert conf.get(components.BATCH_LIMIT) == "1m"  # the user's
    finally:
        conf.set(components.BATCH_LIMIT, before)


def test_plain_texts_pass_by_the_translation(spark):
    odd = ["plain", "x", "a​b", "a­b", "a\u0000b", "῿", "﻿x", None, "", "a\tb", "a \t b", " a  b", "ํา"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, x string")
    got = [r[0] for r in df.orderBy("i").select(X.glyphs(F.col("x"))).collect()]
    table = str.maketrans(dict(zip(X.THAI_GLYPHS, X.THAI_PUA, strict=True)) | dict.fromkeys(X.INVISIBLE))
    assert got == [(x or "").translate(table) for x in odd]
    tidy = [r[0] for r in df.where("i between 9 and 11").orderBy("i").select(X.tidied(F.col("x"))).collect()]
    assert tidy == ["a b", "a b", "a b"]
    plan = df.select(X.glyphs(F.col("x")))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN RLIKE" in plan


def test_files_of_a_stream_do_not_grow_with_the_input(spark, monkeypatch, tmp_path):
    from tidemill.jobs import queries

    monkeypatch.setattr(queries, "PART_ROWS", 100)
    monkeypatch.setattr(queries, "folder", lambda spark, tag: str(tmp_path / tag))
    path, most = queries._parts(spark, "", spark.range(2000).select(F.col("id").cast("string").alias("key")), "in")
    files = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert sum(files) == 2000 and max(files) < 300 and most < len(files) <= 2 * most
