"""Candidate pairs of the signature trees: few, and none that links is lost."""

import random

import numpy as np

from tidemill.llm import common, packing, signature_tree

DOC = "doc_id long, text string, source string"


def test_least_common_is_what_linking_sets_share():
    r = random.Random(1)
    for percent in (80, 85):
        prefix = lambda s: set(sorted(s)[: len(s) - signature_tree.least_overlap(len(s), percent) + 1])  # noqa: E731, B023
        seen = 0
        for _ in range(4000):
            x = set(r.sample(range(400), r.randint(1, 60)))
            y = (x - set(r.sample(sorted(x), r.randint(0, len(x) // 6)))) | set(r.sample(range(400), r.randint(0, 6)))
            if 100 * len(x & y) >= percent * len(x | y):
                n, m = np.array([len(x)]), np.array([len(y)])
                assert len(prefix(x) & prefix(y)) >= signature_tree.least_common(n, m, percent)[0]
                seen += 1
        assert seen > 500


def test_a_tree_gives_one_pair_of_two_labels(spark):
    bits = np.packbits(np.ones(signature_tree.BITS, np.uint8)).tobytes()
    rows = [(7, 0, 0, i, 100, 100, 100, i % 2, bits, 2) for i in range(80)]
    entries = spark.createDataFrame(rows, "token long, s long, t long, id long, n long, rest long, more long, label long, bits binary, side int")
    dealt = lambda: entries.coalesce(1).sortWithinPartitions("token", "s", "t", "label", "n", "id")
    assert [(x["a"], x["b"], x["token"]) for x in signature_tree.traverse(dealt(), 80, every=False).collect()] == [(0, 1, 7)]
    assert signature_tree.traverse(dealt(), 80, every=True).count() == 1600


def test_candidates_grow_with_the_group_not_its_square(spark, monkeypatch):
    r = random.Random(4)
    made, plain = [], signature_tree.traverse

    def counted(*args, **options):
        out = plain(*args, **options)
        made.append(out.count())
        return out

    monkeypatch.setattr(signature_tree, "traverse", counted)
    base = [f"w{r.randrange(9000)}" for _ in range(120)]
    near = [" ".join(f"e{r.random()}" if k in at else w for k, w in enumerate(base)) for at in (set(r.sample(range(120), 3)) for _ in range(150))]
    flow = [f"v{k}" for k in range(260)]
    chain = [" ".join(flow[2 * k : 2 * k + 100]) for k in range(60)]  # only those few steps apart link
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate([*near, *chain])], DOC)
    got = {x["doc_id"]: x["component_id"] for x in signature_tree.jaccard_components(docs).collect()}
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in ([*near, *chain][i].split() for i in range(210))]
    best = list(range(210))
    for i in range(210):
        for j in range(i):
            if best[i] != best[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                low, high = sorted((best[i], best[j]))
                best = [low if x == high else x for x in best]
    assert got == dict(enumerate(best)) and sum(made) < 10 * 210


def test_packing_reads_words_with_the_signatures(spark):
    texts = [None, "", " \t\r\n", "a", " a\x0bb ", "a b c", "one two three four five six", "\x1f \x0c x"]
    rows = packing.with_clusters(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOC))
    assert "split(" not in rows._jdf.queryExecution().toString()
    got = {x["doc_id"]: (x["total"], x["exact"] is not None) for x in rows.collect()}
    assert got == {0: (1, True), 1: (1, True), 2: (1, True), 3: (2, False), 4: (3, False), 5: (3, False), 6: (7, False), 7: (3, False)}


def test_near_misses_make_no_more_rows_than_entries(spark, monkeypatch):
    monkeypatch.setattr(signature_tree, "DENSE", 1, raising=False)
    r = random.Random(9)
    made, plain = [], signature_tree.traverse

    def counted(entries, *args, **options):
        out = plain(entries, *args, **options)
        made.append((out.count(), entries.count()))
        return out

    monkeypatch.setattr(signature_tree, "traverse", counted)
    base = [f"w{k}" for k in range(150)]
    texts = [" ".join(f"e{r.random()}" if k in at else w for k, w in enumerate(base)) for at in (set(r.sample(range(150), r.randint(2, 3))) for _ in range(160))]
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in (t.split() for t in texts)]
    best = list(range(160))
    for i in range(160):
        for j in range(i):
            if best[i] != best[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                low, high = sorted((best[i], best[j]))
                best = [low if x == high else x for x in best]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], DOC)
    got = {x["doc_id"]: x["component_id"] for x in signature_tree.jaccard_components(docs).collect()}
    assert 20 < len(set(best)) < 150
    assert got == dict(enumerate(best)) and made and all(rows <= entries for rows, entries in made)


def test_short_words_are_hashed_by_running_sums(monkeypatch):
    sizes, plain = [], common.span_hashes
    monkeypatch.setattr(common, "span_hashes", lambda d, s, n: sizes.extend(n.tolist()) or plain(d, s, n))
    texts = ["a b", None, "ab ba b a", f"{'y' * 300} \u00e9 a", "", "z " * 400_000 + "b a \u00e9", f"B {'y' * 300}"]
    h, n = common.hashed_words(texts)
    words = [w for t in texts if t for w in t.lower().split()]
    assert n.tolist() == [len((t or "").split()) for t in texts] and len(h) == len(words)
    assert len(set(zip(words, h.tolist(), strict=True))) == len(set(words)) == len(set(h.tolist()))
    assert set(sizes) == {300}


def test_entries_meet_without_sorting_all(spark):
    size = lambda n, rest: n * (1 << 31) + rest
    rows = [(1, 1 << 32, i, size(100, 99), i) for i in (1, 2, 3)] + [(1, 1 << 32, 4, size(500, 499), 4), (2, 1 << 32, 1, size(100, 98), 1), (3, 2 << 32, 1, size(100, 97), 1)]
    met = signature_tree.met_in_trees(spark.createDataFrame(rows, "token long, spot long, id long, sizes long, label long").repartition(3, "token", "spot"), 0, 85)
    assert "Window" not in met._jdf.queryExecution().toString()
    got = met.collect()
    assert sorted((x["token"], x["id"], x["n"], x["rest"]) for x in got) == [(1, 1, 100, 99), (1, 2, 100, 99), (1, 3, 100, 99), (3, 1, 100, 97)]
    first, *others = [x for x in got if x["token"] == 1]
    assert first["prev"] is None and first["pivot"] is None and all(x["pivot"] == first["id"] for x in others)
    assert [x["prev"] for x in others] == [first["id"], others[0]["id"]] and [x["head"] for x in got if x["token"] == 3] == [True]
