"""Near search for many queries: what is measured and stored once."""

import random

import pytest

from tidemill.operators import fuzzy, many, search
from tidemill.sources import corpus


def prepared(spark, texts):
    docs = spark.createDataFrame([(i, "src1", "en", t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, source string, lang string, text string, n_chars long")
    return corpus.prepare_search(corpus.corpus_from_documents(docs)).persist()


def asked(spark, queries):
    return search.prepare_queries(spark.createDataFrame([(i, x, None, None, False) for i, x in enumerate(queries)], "qid int, query string, types array<string>, folder_id string, near boolean"))


def table_of(terms):
    rows, near = [(t, 1 if len(t) < 9 else 2) for t in terms], []
    for low, high in zip((0, *many.LENGTHS), many.LENGTHS, strict=False):
        own = [i for i, (t, _) in enumerate(rows) if low < min(len(t), many.MAX_PATTERN) <= high]
        near += [many.Near([rows[i][0] for i in own], [rows[i][1] for i in own], own)] if own else []
    return rows, near, ([], many.Starts([]))


def test_spots_at_the_borders_of_texts():
    """Terms cut by the end of one text and the start of the next, of few letters, so that spots lie side by side."""
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcü\U00010400") for _ in range(n))
    terms = sorted({word(r.choice((5, 6, 8, 9, 10, 12, 16, 20, 34))) for _ in range(40)})
    lows = []
    for _ in range(300):
        t = r.choice(terms)
        cut = r.randrange(len(t))
        lows += [word(r.randrange(4)) + t[:cut], t[cut:] + word(r.randrange(12)), t[: r.randrange(len(t) + 1)] + t[r.randrange(len(t)) :]]
    table = table_of(terms)
    got = [{h["term"]: (h["errors"], h["start"], h["end"]) for h in hits} for a in range(0, len(lows), 200) for hits in many.nearest_all(table, lows[a : a + 200])]
    want = [{t: h for t, k in table[0] if (h := fuzzy.nearest_of([low], t, k)[0])} for low in lows]
    assert got == want and sum(map(len, want)) > 500


def test_spots_are_measured_together(monkeypatch):
    """Not by a table of edits for each text and term."""
    monkeypatch.setattr(fuzzy, "edits_by_length", lambda *a: pytest.fail("one text and term at a time"))
    found = many.nearest_all(table_of(["alphabeta", "gamma"]), ["an alphqbeta", "gammq alphabetta", "none"])
    assert [sorted((h["term"], h["errors"]) for h in x) for x in found] == [[("alphabeta", 1)], [("alphabeta", 1), ("gamma", 1)], []]


def test_equal_near_queries_are_put_once(spark, monkeypatch):
    files = prepared(spark, ["alphq beta\n" * 60, "x" * 200 + " alphq " + "y\n" * 100, "alphq", None])
    stored, write = {}, search.written

    def written(df, tag):
        out = write(df, tag)
        stored.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(search, "written", written)
    flat = lambda df: sorted(map(str, df.collect()))
    one = search.search_text(files, asked(spark, ["alpha"]), scan=0)[2]
    rows, spots = one.count(), stored["spots"][-1]
    q = asked(spark, ["alpha"] * 5)
    five = search.search_text(files, q, scan=0)[2]
    assert five.count() == 5 * rows and rows > 2 and stored["spots"][-1] == spots
    assert flat(five) == flat(search.search_text(files, q)[2])  # with snippets and words as by a scan
