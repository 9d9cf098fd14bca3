import os
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import search
from tidemill.sources import corpus
from tidemill.sources.store import Store
from tidemill.streaming import streams

SCHEMA = "key string, folder_id string, mtime long, text string"


def records(spark, keys, mtime=1, text="x"):
    return spark.createDataFrame([(f"{f}/{k}", f, mtime, text) for f, k in keys], SCHEMA)


def files(path):
    return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def rows(df):
    return {r["key"]: (r["mtime"], r["text"]) for r in df.collect()}


def test_only_touched_buckets_change(spark, tmp_path):
    path = str(tmp_path / "store")
    start = records(spark, [(f, k) for f in ("a b", "c/d", "7") for k in range(100)])
    store = Store.create(spark, path, start.schema, target_rows=10)
    store.upsert(start)
    before, want = files(path + "/data"), rows(start)
    assert rows(store.read()) == want and len(before) == 48
    store.upsert(records(spark, [("7", 3)], 2, "new").unionByName(records(spark, [("7", 3)], 1, "older")))
    after = files(path + "/data")
    assert all(after[p] == t for p, t in before.items()) and len(after) == len(before) + 1
    want["7/3"] = (2, "new")
    assert rows(store.read()) == want and rows(store.read(1))["7/3"] == (1, "x")
    # a plan for one bucket names one directory
    state = store.state()
    one = next(b for b in state.places if b[0] == "c/d")
    assert len({r["f"] for r in store.rows_of(state, [one]).select(F.input_file_name().alias("f")).collect()}) == 1
    assert len(store.rows_of(state, [one]).inputFiles()) >= 1

    store.remove(records(spark, [("7", 4), ("7", 5), ("none", 1)]))
    store.remove_folder("a b")
    want = {k: v for k, v in want.items() if not k.startswith("a b/") and k not in ("7/4", "7/5")}
    assert rows(store.read()) == want and store.versions() == [0, 1, 2, 3, 4]
    assert store.vacuum(grace=0) > 0 and store.versions() == [4]
    assert rows(store.read()) == want and len(files(path + "/data")) == len(store.state().places)


def test_a_folder_grows_into_more_buckets(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"), records(spark, []).schema, target_rows=10)
    assert rows(store.read()) == {}
    for n in (5, 15, 80):
        store.upsert(records(spark, [("f", k) for k in range(n)], n))
        assert rows(store.read()) == {f"f/{k}": (n, "x") for k in range(n)}
    assert store.state().buckets == {"f": 16} or store.state().buckets == {"f": 8}


@pytest.mark.parametrize("step", ["swap", "commit", "counted"])
def test_a_crash_before_the_swap_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "s")
    store = Store.create(spark, path, records(spark, []).schema, target_rows=10)
    store.upsert(records(spark, [("f", k) for k in range(30)]))

    def crash(*a):
        raise OSError("lost")

    monkeypatch.setattr(Store, step, crash)
    with pytest.raises(OSError):
        store.upsert(records(spark, [("f", 1)], 2, "new"))
    monkeypatch.undo()
    again = Store(spark, path)
    assert again.versions()[-1] == 1 and rows(again.read())["f/1"] == (1, "x")
    again.upsert(records(spark, [("f", 1)], 2, "new"))
    assert rows(again.read())["f/1"] == (2, "new") and len(rows(again.read())) == 30
    again.vacuum(grace=0)
    assert len(files(path + "/data")) == len(again.state().places)


def test_of_two_writers_one_fails(spark, tmp_path):
    a = Store.create(spark, str(tmp_path / "s"), records(spark, []).schema)
    old = a.state()
    a.upsert(records(spark, [("f", 1)]))
    old.version = 1
    with pytest.raises(Exception, match="exists"):
        a.commit(old)
    assert len(rows(a.read())) == 1


def size(path):
    return sum(os.path.getsize(p) for p in files(path))


def test_stream_writes_deltas_and_compacts(spark, tmp_path):
    schema = records(spark, []).schema.add("gone", "boolean")
    add = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{n}"))
    out, state = str(tmp_path / "store"), str(tmp_path / "state")
    run = lambda every=20: streams.stream_index(spark, str(tmp_path / "in" / "*"), schema, out, state, compact_every=every).awaitTermination()
    noise = random.Random(1)
    add(0, [(f"f/{k}", "f", 1, noise.randbytes(500).hex(), None) for k in range(2000)])
    run(1)
    whole = size(out)
    add(1, [("f/3", "f", 5, "b", None), ("f/new", "f", 1, "a", False)])
    run()
    assert size(out) - whole < whole / 50
    add(2, [("f/3", "f", 4, "late", False), ("f/4", "f", 2, "d", False), ("f/5", "f", 2, None, True), ("f/6", "f", 0, None, True)])
    run()
    store = Store(spark, out)
    want = {k: v for k, v in {**{f"f/{k}": 1 for k in range(2000)}, "f/3": 5, "f/4": 2, "f/new": 1}.items() if k != "f/5"}
    assert store.state().applied == 0 and {k: m for k, (m, _) in rows(store.read()).items()} == want
    assert rows(store.read())["f/3"] == (5, "b")
    store.add_delta(records(spark, [("f", "x")]), 0)  # a batch that is inside the buckets already is no news
    store.compact()
    assert store.state().applied == 2 and {k: m for k, (m, _) in rows(store.read()).items()} == want
    store.vacuum(grace=0)
    assert not files(out + "/deltas") and {k: m for k, (m, _) in rows(Store(spark, out).read()).items()} == want
    add(3, [("f/7", "f", 9, "z", False)])
    run()
    assert rows(Store(spark, out).read())["f/7"] == (9, "z")


DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prepared(spark, texts, shift=0, gone=()):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], DOC)
    f = corpus.prepare_search(corpus.corpus_from_documents(docs)).withColumn("mtime", F.lit(shift).cast("long"))
    return f.withColumn("gone", F.col("doc_id").isin(list(gone)) if gone else F.lit(False))


def asked(spark, queries):
    return search.prepare_queries(spark.createDataFrame([(i, q, None, None, False) for i, q in queries.items()], "qid int, query string, types array<string>, folder_id string, near boolean"))


def test_standing_queries_follow_a_changing_index(spark, tmp_path):
    folder, sink, state = (str(tmp_path / n) for n in ("in", "sink", "state"))
    texts = {k: f"alpha beta{k}" for k in range(6)}
    steps = [
        (texts, (), {1: "alpha", 2: "gamma"}),
        ({1: "gamma now", 7: "alpha\n" * 60}, (), {1: "alpha", 2: "gamma"}),
        ({2: "", 3: None}, (2,), {1: "alpha", 2: "beta4", 5: "beta"}),
        ({}, (), {5: "beta"}),
        ({0: "beta once more"}, (), {1: "alpha", 5: "beta"}),
    ]
    now: dict = {}
    for n, (changed, gone, queries) in enumerate(steps):
        now = {**now, **changed}
        for k in gone:
            now.pop(k)
        f = prepared(spark, changed, n, gone)
        f.coalesce(1).write.parquet(f"{folder}/part{n}")
        q, everything = asked(spark, queries), prepared(spark, now, n)
        stream = spark.readStream.schema(f.schema).parquet(f"{folder}/*")
        streams.stream_search(stream, lambda: q, lambda: everything, sink, state).awaitTermination()
        flat = lambda df: sorted((r["qid"], r["key"], r["hit_count"]) for r in df.select("qid", "key", "hit_count").collect())
        assert flat(streams.read_hits(spark, sink, q)) == flat(search.search_exact(everything, q)), n


def test_vector_backlog_resumes(spark, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "vectors")
    f = prepared(spark, {k: "some longer words to be a passage " * (1 + k) for k in range(8)} | {8: None, 9: "no"}).drop("gone")
    for n in range(2):
        f.where(f"doc_id % 2 = {n}").coalesce(1).write.parquet(f"{folder}/part{n}")
    made = []

    def embed(p):
        found = p.collect()
        if made and not fail[0]:
            fail[0] = True
            raise OSError("killed")
        made.append({r["key"] for r in found})
        return p.withColumn("vec", F.array((F.col("len") / 200).cast("float")))

    run = lambda name, state: streams.stream_embed_backlog(spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*"), store, str(tmp_path / state), embed, name)
    fail = [False]
    with pytest.raises(Exception, match="killed"):
        run("first", "a").awaitTermination()
    run("second", "b").awaitTermination()  # another checkpoint: only the store knows what is done
    assert not made[0] & set().union(*made[1:]) and all(made[:1])
    n = sum(map(len, made))
    run("third", "c").awaitTermination()
    assert sum(map(len, made)) == n
    got = {r["key"]: r for r in streams.read_vectors(spark, store, 1).collect()}
    assert len(got) == 9 and not any("doc_8" in k for k in got)
    assert all(len(r["at"]) == len(r["vecs"]) for r in got.values())
    # a file that was indexed again loses its vectors
    again = f.where("doc_id = 0").withColumn("mtime", F.lit(99).cast("long"))
    streams.embed_missing(again, store, "again", embed)
    assert len(made[-1]) == 1 and len(streams.read_vectors(spark, store, 1).collect()) == 9
