"""The pipeline's stages, and mixing, against plain Python."""

import collections
import hashlib
import random

import pytest

import corpus_pipeline
from tests.llm import plain
from tidemill.llm import language_id, mixing, pii, quality_cascade, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(r, n):
    word = lambda: "".join(r.choice(["an", "er", "tho", "in", "re", "sta", "lo", "mi"]) for _ in range(r.randint(1, 4)))
    texts = []
    for i in range(n):
        t = " ".join(word() for _ in range(r.randint(15, 90)))
        if i % 7 == 1:
            t = texts[r.randrange(len(texts))]
        elif i % 7 == 2 and len((w := texts[r.randrange(len(texts))].split())) > 40:
            w[20] = word()
            t = " ".join(w)
        if i % 9 == 0:
            t += f" zor{'abcdefgh'[i % 5]}x Quell mail x{i % 5}@home.org or call +1 555 0100 {i % 10:04d}"
        if i % 8 == 3:
            t += " you grumpkin " + word()
        texts.append(t)
    texts[5:8] = [None, "", " \n "]
    texts[20] = " ".join(word() for _ in range(5000))
    return [(i, t, r.choice(["en", "fr", None]), r.choice([*[f"src{k}" for k in range(9)], "web", None]), len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = rows_of(random.Random(6), 400)
    labels = [(i, i % 2, int("grumpkin" in (t or ""))) for i, t, *_ in rows if i % 3]
    spark.createDataFrame(rows, DOC).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, rows


def test_pipeline_against_plain_python(spark, tables):
    at, rows = tables
    machine = toxicity.trained(spark, at)
    bad = [machine.probability(m) >= 0.5 for m in toxicity.text_margins(machine, "plain", [t for _, t, *_ in rows])]
    assert sum(bad) > 20 and all("grumpkin" in rows[i][1] for i, b in enumerate(bad) if b)
    kept = [x for x, b in zip(rows, bad, strict=True) if not b]
    first = plain.components([t for _, t, *_ in kept], 5, 80)
    kept = [x for k, x in enumerate(kept) if first[k] == k]
    actions = plain.revealing([t for _, t, *_ in kept])
    assert "zorax" in actions
    clean = []
    for i, t, lang, source, n in kept:
        new, changed = plain.sanitise(t, actions)
        clean.append((i, new, lang, source, len(new) if changed else n))
    epochs = plain.mix([(i, t, lang, source) for i, t, lang, source, _ in clean])
    taken = [x for x, e in zip(clean, epochs, strict=True) for _ in range(e)]
    docs, stages = spark.read.parquet(f"{at}/documents.parquet"), dict(corpus_pipeline.STAGES)
    for name, wanted in (("toxicity", [x for x, b in zip(rows, bad, strict=True) if not b]), ("near_duplicates", kept), ("personal_data", clean), ("mixing", taken)):
        docs = corpus_pipeline.stored(stages[name](spark, docs, at), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted(map(str, map(tuple, docs.collect()))) == sorted(map(str, wanted)), name
    wanted = plain.pack([(i, len(plain.words(t)) + 1, source, hashlib.md5((t or "").encode()).hexdigest()) for i, t, _, source, _ in taken])
    got = collections.defaultdict(list)
    for x in corpus_pipeline.run(spark, at).collect():
        got[x["doc_id"], x["piece"]].append(x["bin_id"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in wanted.items()}


def test_stages_take_empty_tables_and_further_columns(spark, tables):
    at, rows = tables
    odd = [(1, None, None, None, None, "x", 1), (2, "", "en", "s", 0, "y", 2), (2, "", "en", "s", 0, "y", 2), (None, "a text without an id", "en", "s", 20, None, None)]
    kind = DOC + ", component_id string, epochs int"
    for name, stage in corpus_pipeline.STAGES:
        assert not stage(spark, spark.createDataFrame([], kind), at).collect(), name
        out = stage(spark, spark.createDataFrame(odd, kind), at)
        out.collect()
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "component_id", "epochs"]


def test_mixing_against_plain_python(spark):
    r = random.Random(2)
    rows = [(i, " ".join("w" * r.randint(0, 60)), r.choice(["en", "de", None]), r.choice([*[f"src{k}" for k in range(12)], "", None])) for i in range(300)]
    rows += [(1000, None, "en", "src1"), (1001, "", "en", "src1"), (1002, " \n", "fr", "src99999999999"), *rows[:3]]
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, lang string, source string, domain string")
    for options in ({}, {"fraction": 1.7}, {"fraction": 3.0, "max_epochs": 3}, {"fraction": 0.0}, {"weights": {"d1": 0.0, "d2": 50.0, "d2/en": 3.0, "d2/en/src2": 0.5}, "fraction": 0.5}, {"alpha": 0.0, "seed": 3}):
        got = collections.Counter()
        for x in mixing.mix_sources(docs, **options).collect():
            got[x["doc_id"]] += x["epochs"]
        wanted = collections.Counter()
        for x, e in zip(rows, plain.mix(rows, **options), strict=True):
            wanted[x[0]] += e
        assert got == +wanted, options
    assert not mixing.mix_sources(docs.where("doc_id < 0")).collect()


def test_cascade_order():
    masks = [([True, False, False], 50), ([True, True, False], 30), ([False, False, True], 5), ([False, False, False], 15)]
    assert quality_cascade.greedy(masks, [1.0, 1.0, 1.0], ["a", "b", "c"]) == [0, 2, 1]
    assert quality_cascade.greedy(masks, [100.0, 1.0, 1.0], ["a", "b", "c"]) == [1, 2, 0]
    assert quality_cascade.greedy([], [1.0, 1.0], ["b", "a"]) == [1, 0]


def test_cascade_order_changes_no_verdict(spark):
    texts = ["A SHOUT " * 30, "so what! " * 30, "1 2 3 4 5 6 7 " * 9, " ".join(f"word{'x' * (i % 5)}{i}" for i in range(60)), None, ""]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts * 2)], "doc_id long, text string, kept string")
    rules = quality_cascade.default_rules()
    out = [sorted(map(str, quality_cascade.quality_cascade(docs, rules=r).collect())) for r in (rules, rules[::-1])]
    assert out[0] == out[1] and len(out[0]) == 12


def test_language_rules(spark):
    r = random.Random(4)
    kinds = {"xx": ["thi", "and", "ing"], "yy": ["que", "los", "ado"], "zz": ["wek", "kow", "szy"]}
    say = lambda k, n: " ".join("".join(r.choice(kinds[k]) for _ in range(3)) for _ in range(n))
    rows = [(i, say("xx", 30), "xx") for i in range(600)] + [(1000 + i, say("yy", 30), "yy") for i in range(60)] + [(2000 + i, say("zz", 30), "zz") for i in range(3)]
    rows += [(3000 + i, rows[0][1], "xx") for i in range(500)]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string, lang string")
    model = language_id.train_language(frame(rows), sample_rows=50)
    assert model.langs == ["xx", "yy", "zz"]
    tests = [(0, "½ ² Ⅷ 12", "xx"), (1, say("zz", 20), "xx"), (2, say("yy", 3), None), (2, say("yy", 3), None), (3, "ก", None), (4, say("xx", 30000), "zz")]
    got = [(x["doc_id"], x["lang_pred"]) for x in language_id.identify_language(frame(tests), model).collect()]
    assert sorted(got)[:4] == [(0, "und"), (1, "zz"), (2, "yy"), (2, "yy")] and dict(got)[4] == "xx" and dict(got)[3] in model.langs
    assert not language_id.identify_language(frame([]), model).collect() and language_id.train_language(frame([])) is None
    df, n = language_id.document_frequencies(frame(rows).select("text"))
    some = language_id.Grams().of("thi")[3]
    assert n == len(rows) and df[some] == sum(some in {g for w in language_id.letter_runs(t) for g in language_id.Grams().of(w)} for _, t, _ in rows)


def test_sanitised_text(spark):
    r = random.Random(9)
    rows = rows_of(r, 120)
    docs = spark.createDataFrame(rows, DOC)
    actions = plain.revealing([t for _, t, *_ in rows])
    assert set(actions.values()) == {"remove", "generalise"}
    from pyspark.sql import functions as F

    got = {x["doc_id"]: x["new"] for x in pii.find_pii(docs).select("doc_id", pii.sanitised(F.col("text"), F.col("spans")).alias("new")).collect()}
    assert got == {i: plain.sanitise(t, actions)[0] for i, t, *_ in rows}
