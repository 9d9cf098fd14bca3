import random

import numpy as np
from pyspark.sql import functions as F

from tidemill.functions import text as X
from tidemill.operators.components import connected_components
from tidemill.operators.dupes import gram_hashes, hash_units, sketch_similarity
from tidemill.operators import dupes, grams, search, semantic, sync
from tidemill.operators.fuzzy import find_nearest, nearest_of
from tidemill.operators.semantic import passage_spans, quantize_vectors, semantic_search, vector_scores
from tidemill.sources import corpus
from tidemill.streaming import streams


def one(spark, col, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(col.alias("x")).first()["x"]


def test_ext_and_stem(spark):
    for name, ext in (("A.TXT", ".txt"), (".txt", ""), ("a.tar.gz", ".gz"), ("noext", ""), ("a.", ".")):
        assert one(spark, X.ext_of(F.col("n")), n=name) == ext
    assert one(spark, X.stem_of(F.col("n")), n="report.v2.docx") == "report.v2"
    assert one(spark, X.stem_of(F.col("n")), n=".txt") == ".txt"


def test_normalize(spark):
    cases = {"นํา": "นำ", "นำ้": "น้ำ", "": "่", "é": "é", "a​b": "ab", " a \t b \n": "a b"}
    for given, wanted in cases.items():
        assert one(spark, X.normalize_text(F.col("t")), t=given) == wanted
    assert spark.range(1).select(X.normalize_text(F.lit(None).cast("string")).alias("x")).first()["x"] == ""
    assert one(spark, X.join_thai_lines(F.col("t")), t="ก\nข\nค a\n") == "กขค a\n"
    assert one(spark, X.query_terms(F.col("t")), t="  b  a\tb ") == ["b", "a", "b"]


def test_snippet(spark):
    text = "x" * 100 + "needle" + "y" * 294
    s = one(spark, X.make_snippet(F.col("t"), F.col("t"), F.array(F.lit("needle"))), t=text)
    assert s == "…" + text[10:280] + "…"
    assert one(spark, X.make_snippet(F.col("t"), F.col("t"), F.array(F.lit("zz"))), t="a\nb") == "a b"


def test_hash_values():
    units = lambda t: np.frombuffer(t.encode("utf-16-le"), np.uint16)[None]
    for t, h in (("a", 444641715), ("abcde", 3550385300), ("hello", 2290972270)):
        assert int(hash_units(units(t))[0]) == h
    assert len(gram_hashes("abcd")) == 0 and len(gram_hashes("abcdef")) == 2


def test_similarity(spark):
    lit = lambda v: F.array(*[F.lit(x).cast("long") for x in v])
    row = spark.range(1).select(
        sketch_similarity(lit(range(1, 101)), F.lit(True), lit(range(1, 96)), F.lit(True)).alias("a"),
        sketch_similarity(lit([1, 2, 9]), F.lit(False), lit([1, 2, 3, 20]), F.lit(True)).alias("b"),
    ).first()
    assert (row["a"], row["b"]) == (0.95, 0.5)


def test_quantize(spark):
    assert one(spark, quantize_vectors(F.col("v")), v=[0.5, -0.5, 1.2, -1.2]) == [64, -63, 127, -127]


def test_passages():
    letters = "a" * 150 + " " + "b" * 149
    assert passage_spans(letters) == [(0, 150), (150, 150)]
    assert passage_spans("a" * 50 + " " + "b" * 249) == [(0, 200), (200, 100)]
    assert passage_spans("1" * 300) == [] and passage_spans("abcdefghijk") == []


def test_nearest():
    assert find_nearest("กลยุทธ", "กลยุทธ์", 1) == (1, 0, 6)
    assert find_nearest("งบประมาณ", "งบประมาน", 1) == (1, 0, 8)
    assert find_nearest("xxabcdexx", "abcde", 1) == (0, 2, 7)
    assert find_nearest("abxde", "abcde", 0) is None and find_nearest("abc", "abcde", 1) is None


def distances(pattern, text):
    """Edits between the pattern and every prefix of text."""
    row = list(range(len(text) + 1))
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != p), row[j] + 1, new[j - 1] + 1))
        row = new
    return row


def test_nearest_against_brute_force():
    r = random.Random(5)
    for n in range(600):
        letters = "abc" if n % 3 else "ab \u0e01\u0e48\u0e40"
        low, pat = ("".join(r.choice(letters) for _ in range(k)) for k in (r.randint(4, 40), r.randint(5, 9) if n % 9 else 34))
        k, m = r.choice([1, 2]), min(len(pat), 32)
        cell = {(e, e - s): d for s in range(len(low)) for e, d in enumerate(distances(pat[:32], low[s:]), s) if e > s}
        least = {e: min(d for (x, _), d in cell.items() if x == e) for e in range(1, len(low) + 1)}
        size = lambda e: min((d, abs(j - m), j) for (x, j), d in cell.items() if x == e)[2]
        best = min(least.values())
        if pat in low:
            wanted = (0, low.index(pat), low.index(pat) + len(pat))
        elif best > k or len(low) < len(pat) - k:
            wanted = None
        else:
            end = first = min(e for e, d in least.items() if d == best)
            while end - first < best and end < len(low) and pat[:32][-1] != "\u0e48" and low[end].isalpha() and low[end] != "\u0e40" and least[end + 1] == best:
                end += 1
            start = end - size(end)
            while end < len(low) and low[end] == "\u0e48":
                end += 1
            while start < end and low[start] == " ":
                start += 1
            while end > start and low[end - 1] == " ":
                end -= 1
            wanted = (best, start, end)
        assert find_nearest(low, pat, k) == wanted, (low, pat, k)


def test_nearest_takes_rows_together():
    lows = ["", "xxabcxdexx", "abcde", "nothing"]
    assert nearest_of(lows, "abcde", 1) == [find_nearest(low, "abcde", 1) for low in lows] == [None, (1, 2, 8), (0, 0, 5), None]
    assert find_nearest("abcd" * 20_000 + "abxde", "abcde", 1)[0] == 1


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)]
    frame = spark.createDataFrame([*edges, (None, 5)], "a long, b long").repartition(7)
    got = {x["node"]: x["component"] for x in connected_components(frame).collect()}
    in_rounds = {x["node"]: x["component"] for x in connected_components(frame, task_edges=9).collect()}
    parent = {n: n for e in edges for n in e}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == in_rounds == {n: find(n) for n in parent}
    words = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "x")], "a string, b string")
    assert sorted(tuple(x) for x in connected_components(words).collect()) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x")]
    assert not connected_components(frame.where("a < 0")).collect()


DOC = "doc_id long, text string, lang string, source string, n_chars long"


def files_of(spark, texts, source=None):
    rows = [(i, x, "en", source or f"src{i % 3}", len(x or "")) for i, x in enumerate(texts)]
    return corpus.corpus_from_documents(spark.createDataFrame(rows, DOC))


def test_chunks_are_composed_and_numbered(spark):
    text = "\ufeffe\u0301t\u0e4d\u0e32\r\n" + "\n" * 99 + "last  line\rx"
    chunks = {r["doc_id"]: [tuple(c) for c in r["chunks"]] for r in files_of(spark, [text, None, "", " \u00a0\n\u3000"]).collect()}
    assert chunks[0] == [("\u0e1a\u0e23\u0e23\u0e17\u0e31\u0e14 1", "\u00e9t\u0e33"), ("\u0e1a\u0e23\u0e23\u0e17\u0e31\u0e14 101", "last line\nx")]
    assert chunks[1] == chunks[2] == chunks[3] == []
    assert [r["error"] for r in files_of(spark, ["a", None]).orderBy("doc_id").collect()] == [None, "bad"]


def test_read_texts(spark, tmp_path):
    (tmp_path / "sub" / ".git").mkdir(parents=True)
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfplain caf\xc3\xa9")
    (tmp_path / "sub" / "thai.log").write_bytes("\u0e01\u0e23\u0e38\u0e07".encode("cp874") + b" \x80\xdb")
    (tmp_path / "sub" / "big.md").write_bytes(b"x" * 2000)
    (tmp_path / "sub" / ".git" / "no.txt").write_text("no")
    (tmp_path / "sub" / "no.exe").write_text("no")
    assert sorted(r["rel"] for r in corpus.list_files(spark, str(tmp_path)).collect()) == ["a.txt", "sub/big.md", "sub/thai.log"]
    got = {r["rel"]: r["chunks"][0]["text"] for r in corpus.read_texts(spark, str(tmp_path), max_size=1000).collect()}
    assert got == {"a.txt": "plain caf\u00e9", "sub/thai.log": "\u0e01\u0e23\u0e38\u0e07 \u20ac\ufffd"}


def test_cells_and_sheets(spark):
    numbers = [(5.0, "5"), (12345678.5, "12345678.5"), (1e21, "1e+21"), (1.5e-7, "1.5e-7"), (-0.25, "-0.25"), (0.0, "0"), (1e-6, "0.000001"), (100.0, "100")]
    rows = spark.createDataFrame([(x, i) for i, (x, _) in enumerate(numbers)], "x double, i int")
    assert [r["t"] for r in rows.orderBy("i").select(corpus.cell_text(F.col("x"), "double").alias("t")).collect()] == [w for _, w in numbers]
    times = spark.sql("SELECT timestamp_ntz'2020-01-02 03:04:05' a, timestamp_ntz'1899-12-30 10:00:00' b, true c, cast(null as string) d, '' e, 7L f")
    cells = [corpus.cell_text(F.col(c), k).alias(c) for c, k in times.dtypes]
    assert tuple(times.select(*cells).first()) == ("2020-01-02 03:04:05", "10:00:00", "TRUE", None, None, "7")
    sheet = spark.createDataFrame([("s", i, None if i == 3 else f"v{i}") for i in range(25)], "sheet string, i int, v string")
    got = corpus.rows_to_text(sheet, F.col("sheet"), F.col("i"), ["v"], rows_per_chunk=10).orderBy("block").collect()
    assert [r["text"].split("\n") for r in got] == [w[k : k + 10] for w in [[f"v{i}" for i in range(25) if i != 3]] for k in (0, 10, 20)]


def asked(spark, *texts):
    rows = [(i, x, None, None, False) for i, x in enumerate(texts)]
    return search.prepare_queries(spark.createDataFrame(rows, "qid int, query string, types array<string>, folder_id string, near boolean"))


def test_search_by_index_is_search_by_scan(spark):
    r = random.Random(4)
    vocabulary = ["alpha", "beta", "gamma", "de", "x1", "nowhere", "documents", "\u0e01\u0e25\u0e22\u0e38\u0e17\u0e18\u0e4c"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(6)) for _ in range(40)] + [None, "", "\n" * 60 + "last alpha"]
    files = corpus.prepare_search(files_of(spark, texts)).persist()
    q = asked(spark, "alpha beta", "de", "x", "mma be", "doc_1", "none", "", ".txt doc_1", "alpha doc_2", "alpla", "dacuments", "documnts gamma", "\u0e01\u0e25\u0e22\u0e38\u0e17\u0e18", "z", "\n", *[f"doc_{k} alpha" for k in range(40)])
    flat = lambda dfs: [sorted(map(str, df.collect())) for df in dfs]
    index = grams.indexed(files)
    by_scan, by_index = flat(search.search_text(files, q)), flat(search.search_text(index, q))
    assert by_scan == by_index == flat(search.search_text(files, q, scan=0)) and all(by_scan)
    one = asked(spark, "alpha beta")
    assert flat([search.search_exact(index, q).where("qid = 0")]) == flat([search.search_exact(files, one)])
    empty = grams.indexed(files.where("key = ''"))
    assert not any(flat(search.search_text(empty, q)))


def test_near_search_meets_places_by_grams_and_compares_once(spark):
    files = corpus.prepare_search(files_of(spark, ["some documents here", "other text"]))
    q = asked(spark, "dacuments", "gammma")
    plans: list[str] = []
    once = search.nearest_rows
    search.nearest_rows = lambda rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or once(rows)
    try:
        search.search_near(grams.indexed(files), q, q.select("qid", F.lit("k").alias("key")).where("qid < 0")).collect()
    finally:
        search.nearest_rows = once
    assert len(plans) == 1 and "NestedLoop" not in plans[0] and "Cartesian" not in plans[0]


def test_hits_are_bounded_but_counted(spark):
    files = corpus.prepare_search(files_of(spark, ["needle\n" * 50 * 40]))
    row = search.search_exact(files, asked(spark, "needle")).first()
    assert row["hit_count"] == 40 and [h["chunk"] for h in row["hits"]] == list(range(search.MAX_HITS))


def test_presentation_and_report(spark):
    shown = spark.createDataFrame([(1, "a", "exact", 1), (1, "b", "near", 1), (2, "c", "near", 1)], "qid int, key string, kind string, rank int")
    sem = spark.createDataFrame([(1, "d", 1), (3, "e", 1)], "qid int, key string, rank int")
    got = {r["key"]: (r["n"], r["divider"]) for r in search.present_results(shown, sem).collect()}
    assert got == {"a": (1, False), "b": (2, True), "c": (1, False), "d": (3, True), "e": (1, True)}
    summary = spark.createDataFrame([(1, 1, True, False, False, 0, 0, 0)], "qid int, n_terms int, can_near boolean, loose boolean, near boolean, total long, near_total long, hits long")
    assert search.search_report(files_of(spark, []), summary).first()["outcome"] == "empty"
    assert search.search_report(files_of(spark, ["x"]), summary).first()["outcome"] == "none"


CHUNK = "array<struct<loc:string,text:string>>"
TODO = f"key string, ext string, size long, readable boolean, known boolean, same boolean, text_good boolean, old_error string, old_chunks {CHUNK}, old_needs_ocr boolean, new_chunks {CHUNK}, new_needs_ocr boolean, new_error string, tag_text string"


def test_apply_sync(spark):
    old, new, big = [("a", "old"), (X.TAG_LOC, "tags")], [("a", "new")], sync.MAX_SIZE + 1
    rows = [
        ("new", ".txt", 1, True, False, False, False, None, None, None, new, True, None, None),
        ("huge again", ".txt", big, True, True, True, False, sync.TOO_LARGE, [], False, new, False, None, None),
        ("huge, grown", ".txt", big, True, True, False, False, sync.TOO_LARGE, [], False, new, False, None, None),
        ("lost", ".txt", 1, False, True, False, False, "e", old, True, None, None, None, None),
        ("lost and new", ".txt", 1, False, False, False, False, None, None, None, None, None, None, None),
        ("broken", ".txt", 1, True, True, True, False, "bad", old, False, None, None, "bad", None),
        ("image", ".png", 1, True, True, True, True, None, old, True, None, None, None, "cat"),
        ("no tagger", ".png", 1, True, True, True, True, None, old, False, None, None, None, None),
    ]
    got = {r["key"]: r for r in sync.apply_sync(spark.createDataFrame(rows, TODO), tags=True).collect()}
    texts = lambda k: [c["text"] for c in got[k]["chunks"]]
    assert texts("new") == ["new"] and got["new"]["needs_ocr"] and got["new"]["write"] and not got["new"]["failed"]
    assert (got["huge again"]["write"], got["huge, grown"]["write"]) == (False, True) and got["huge again"]["error"] == sync.TOO_LARGE
    assert texts("lost") == ["old", "tags"] and not got["lost"]["write"] and got["lost"]["failed"]
    assert got["lost and new"]["error"] == sync.UNREADABLE and got["lost and new"]["write"]
    assert not got["broken"]["write"] and got["broken"]["failed"] and texts("broken") == []
    assert texts("image") == ["old", "cat"] and got["image"]["needs_ocr"] and not got["image"]["needs_tags"]
    assert texts("no tagger") == ["old"] and got["no tagger"]["needs_tags"]


def test_sync_twice_finds_nothing_to_do(spark):
    f = files_of(spark, ["a", "b", None]).withColumn("v", F.lit(1))
    index = f.select("key", "mtime", "size", "v", F.lit(None).cast("string").alias("error"), F.lit(False).alias("needs_ocr"), F.lit(False).alias("awaits_tags"))
    plan = sync.plan_sync(index, f.select("key", "mtime", "size", "v", F.lit(True).alias("readable")))
    assert {r["action"] for r in plan.collect()} == {"skip"}


def test_metadata_reads_no_text(spark):
    docs = spark.read.schema(DOC).parquet("/root/testdata/sf0.001/documents.parquet")
    plan = corpus.metadata_from_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1]


def test_stored_sync_state_does_not_move(spark, tmp_path):
    f = files_of(spark, ["a", "b", None, "c"]).withColumn("v", F.lit(1))
    index = f.select("key", "mtime", "size", "v", F.lit(None).cast("string").alias("error"), F.lit(False).alias("needs_ocr"), F.lit(False).alias("awaits_tags"))
    new = f.where("doc_id > 0").select("key", "mtime", "size", "v", F.lit(True).alias("readable"))
    state = sync.save_sync_state(index, "state_a", str(tmp_path / "state"), 4)
    again = sync.open_sync_state(spark, "state_b", str(tmp_path / "state"), "key string, mtime long, size long, v int, error string, needs_ocr boolean, awaits_tags boolean", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for known in (state, again):
            plan = sync.plan_sync(known, new)
            text = plan._jdf.queryExecution().executedPlan().toString()
            assert text.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 4 out of 4" in text
            assert sorted(map(str, plan.collect())) == sorted(map(str, sync.plan_sync(index, new).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_removed_below_failed_folders(spark):
    r = random.Random(2)
    rels = ["/".join([*r.choices(["a", "b", "a.b"], k=r.randint(0, 4)), "f.txt"]) for _ in range(60)]
    gone = spark.createDataFrame([(f"{d}/{k}", d, rel) for k, rel in enumerate(rels) for d in ("x", "y")], "key string, folder_id string, rel string")
    failed = [("x", "a/"), ("x", "a/b/"), ("y", "b/a.b/"), ("y", "f.txt/"), ("z", "")]
    wanted = {x["key"]: "kept" if any(x["folder_id"] == d and x["rel"].startswith(p) for d, p in failed) else "removed" for x in gone.collect()}
    df = spark.createDataFrame(failed, "folder_id string, prefix string")
    out = sync.detect_removed(gone, df)
    assert {x["key"]: x["fate"] for x in out.collect()} == wanted and "kept" in wanted.values()
    assert "startswith" not in out._jdf.queryExecution().toString().lower()
    everything = sync.detect_removed(gone, df.unionByName(spark.createDataFrame([("x", "")], "folder_id string, prefix string")))
    assert {x["fate"] for x in everything.where("folder_id = 'x'").collect()} == {"kept"}


def test_duplicates(spark):
    r = random.Random(8)
    body = " ".join(f"w{r.randint(0, 9999)}" for _ in range(120))
    files = files_of(spark, [body, body, body + " tail", "short", " ".join(f"v{r.randint(0, 9999)}" for _ in range(120)), None])
    members, edges = dupes.find_duplicates(files)
    groups = dupes.grouped(members, edges)
    report = dupes.dup_report(groups).collect()
    assert len(report) == 3 and len({x["group_id"] for x in report}) == 1 and sum(x["newest"] for x in report) == 1
    same = groups.withColumn("mtime", F.lit(5).cast("long"))
    assert not any(x["newest"] for x in dupes.dup_report(same).collect())
    top = dupes.dup_groups(groups, edges).first()
    assert (top["n"], top["exact"], top["total_groups"], top["total_files"]) == (3, False, 1, 3)


def test_prefixes_lose_no_pair(spark, monkeypatch):
    """Sketches with frequent hashes, repetitive texts and classes of copies against all pairs."""
    monkeypatch.setattr(dupes, "MAX_SHARED", 18)
    r = random.Random(12)
    rows = []
    base = [r.sample(range(5000), 128) for _ in range(5)]
    for k in range(60):
        n = r.choice([128, 128, 128, 120, 20])
        vals = set(r.sample(r.choice(base), n))
        for _ in range(r.choice([0, 1, 4, 12, 25, 60])):
            vals.discard(r.choice(sorted(vals)))
            vals.add(r.randrange(5000, 9000))
        vals = sorted(vals)[:128]
        rows.append((k, f"c{k:02}", r.choice([1, 1, 1, 4]), vals, len(vals) < 128 and r.random() < 0.7))
    df = spark.createDataFrame(rows, "id long, cls string, size long, vals array<long>, full boolean")
    files, held = {}, {}
    for _, _, size, vals, _ in rows:
        for v in vals:
            files[v] = files.get(v, 0) + size
            held[v] = held.get(v, 0) + 1
    rare = {v for v, n in files.items() if n <= 18 and held[v] > 1}
    shared, similar = set(), set()
    for i, (_, a, _, x, fx) in enumerate(rows):
        for _, b, _, y, fy in rows[i + 1 :]:
            n = len(rare & set(x) & set(y))
            if n and 10 * n >= 3 * min(len(x), len(y)):
                shared.add((a, b, n))
                limit = min([max(v) for v, full in ((x, fx), (y, fy)) if not full], default=10**9)
                union = [v for v in sorted({*x, *y}) if v <= limit][:128]
                both = sum(v in x and v in y for v in union)
                if union and both / len(union) >= 0.85:
                    similar.add((a, b, round(both / len(union), 9)))
    assert {tuple(x) for x in dupes.dup_candidates(df).collect()} == shared and len(shared) > 20
    assert {(x["a"], x["b"], round(x["sim"], 9)) for x in dupes.near_duplicates(df).collect()} == similar and len(similar) > 5


def test_vectors_in_blocks(spark):
    rng = np.random.default_rng(1)
    unit = lambda n: [[float(x) for x in v / np.linalg.norm(v)] for v in rng.normal(size=(n, 8))]
    ps, qs = unit(70), unit(9)
    p = spark.createDataFrame([(f"k{i // 5}", i % 5, -1 if i % 5 == 0 else 0, [int(np.floor(x * 127 + 0.5)) for x in v]) for i, v in enumerate(ps)], "key string, p int, chunk int, vec array<tinyint>")
    q = spark.createDataFrame([(i, v, "words" if i else "1", None, None) for i, v in enumerate(qs)], "qid long, vec array<float>, query string, types array<string>, folder_id string")
    got = {(x["qid"], x["key"], x["p"]): x["score"] for x in vector_scores(p, q).collect()}
    want = {}
    for row in p.collect():
        for i, v in enumerate(qs):
            s = float(np.dot(np.float32(v).astype(float), row["vec"])) / 127 * (0.75 if row["chunk"] < 0 else 1)
            if s >= 0.35:
                want[i, row["key"], row["p"]] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    none = spark.createDataFrame([], "qid long, key string")
    files = spark.createDataFrame([(f"k{i}", "f", ".txt", None, 1 if i % 2 else 0) for i in range(14)], "key string, folder_id string, ext string, error string, sem_version int")
    found = semantic_search(p, q, none, files).collect()
    assert found and all(x["qid"] > 0 and int(x["key"][1:]) % 2 for x in found)


def test_means_of_groups(spark, monkeypatch):
    monkeypatch.setattr(semantic, "HELD_GROUPS", 3)
    rng = np.random.default_rng(4)
    rows = [(f"g{k}" if k else None, rng.normal(size=6).tolist()) for k in rng.choice([0, 1, 1, 1, 2, 3, 4, 5, 6, 7], 300).tolist()] + [("zero", [1.0] * 6), ("zero", [-1.0] * 6), ("g1", None)]
    df = spark.createDataFrame(rows, "label string, v array<double>").repartition(7)
    got = {r["label"]: np.array(r["vec"]) for r in semantic.mean_pool(df, "label", "v").collect()}
    assert got.keys() == {k for k, _ in rows}
    for k, v in got.items():
        m = np.mean([x for j, x in rows if j == k and x], 0)
        assert np.allclose(v, m / (np.linalg.norm(m) or 1))
    assert semantic.mean_pool(df.where("label = 'none'"), "label", "v").collect() == []


def test_shares_over_several_blocks_of_labels(spark, monkeypatch):
    rng = np.random.default_rng(5)
    items = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(12)] + [(99, [0.0] * 5)], "item long, vec array<float>")
    labels = spark.createDataFrame([(f"l{k}", rng.integers(-127, 128, 5).tolist()) for k in range(20)], "label_id string, vec array<tinyint>").repartition(3)
    flat = lambda: sorted((r["item"], r["rank"], r["label_id"], round(r["share"], 9)) for r in semantic.zero_shot_share(items, labels).collect())
    one = flat()
    monkeypatch.setattr(semantic, "BLOCK_ROWS", 4)
    monkeypatch.setattr(semantic, "BROADCAST_BYTES", 0)
    assert flat() == one and len(one) == 13 * semantic.TOP
    v, ls = items.first()["vec"], {r["label_id"]: np.array(r["vec"], float) for r in labels.collect()}
    sims = {k: np.dot(v, x) / 127 / np.linalg.norm(v) for k, x in ls.items()}
    e = {k: np.exp(100 * (s - max(sims.values()))) for k, s in sims.items()}
    best = max(sims, key=lambda k: sims[k])
    assert one[0][2] == best and abs(one[0][3] - e[best] / sum(e.values())) < 1e-6


def test_previews_start_where_they_are_told(spark):
    files = corpus.prepare_search(files_of(spark, ["a" * 600 + "needle" + "b" * 3000, None]))
    key, bad = [r["key"] for r in files.orderBy("doc_id").select("key").collect()]
    asked = [(1, key, 0, ["needle"], None), (2, key, 0, ["needle"], 50), (3, key, 1, ["needle"], None), (4, bad, 0, ["x"], 3), (5, "none", 0, ["x"], None), (6, key, -1, ["x"], None)]
    wanted = spark.createDataFrame(asked, "n int, key string, chunk int, terms array<string>, at int")
    got = {r["n"]: r["preview"] for r in corpus.previews(files, wanted).collect()}
    assert (got[1]["text"][500:506], len(got[1]["text"]), got[1]["cut_start"], got[1]["cut_end"]) == ("needle", 2000, True, True)
    assert (got[2]["text"][550:556], len(got[2]["text"])) == ("needle", 1500)
    assert got[3] is got[4] is got[5] is got[6] is None


def test_old_dates_show_their_time(spark):
    row = spark.sql("SELECT date'1899-12-31' a, date'1900-01-01' b").select(*[corpus.cell_text(F.col(c), "date").alias(c) for c in "ab"]).first()
    assert tuple(row) == ("00:00:00", "1900-01-01 00:00:00")


def test_entry_point_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
