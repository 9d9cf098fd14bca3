"""The prefix trie, decontamination and spelling variants against plain Python."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemill.llm import decontamination, kneser_ney, mpeg_audio, pii, prefix_trie, spelling

CONV = "conv_id long, turn long, role string, text string, digest string, words long"


def sha(ids):
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def plain_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            h = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), h, (role, text)))
    own = {c: [x[2] for x in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        made[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = set()
    for p, ids in members.items():
        under = [q for q in members if q[: len(p)] == p]
        kids = lambda x: [q for q in members if len(q) == len(x) + 1 and q[: len(x)] == x]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in under if q)
        out.add((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(kids(p)), sum(not kids(q) for q in under), saved, sha(sorted(c for c in ids if made[c] == p))))
    return out


def trie_of(spark, rows):
    return prefix_trie.prefix_trie(spark.createDataFrame([(*x, "clash", 7) for x in rows], CONV).repartition(5))


def test_trie(spark):
    r = random.Random(6)
    rows = [(c, t, r.choice(["user", "bot", None]), r.choice(["a b", "c", "", None, "a  b\n"])) for c in [*range(0, 60), *range(-25, -18), 400] for t in range(r.randint(1, 5))]
    rows += [(7, None, "user", "z"), (7, None, "user", "y"), (8, 0, "user", "a b"), (8, 0, "user", "a b"), (None, 0, "user", "lost"), (3, 1, "user", "same turn"), (3, 1, "bot", "same turn")]
    rows += [(500 + k, 0, "user", "hot") for k in range(130)] + [(1000, t, "user", f"w{t} " * 3) for t in range(70)] + [(2000, 0, "user", "x " * 100_000)]
    got = trie_of(spark, rows).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == plain_trie(rows)


def test_trie_of_hot_nodes_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HOT_MEMBERS", 2)
    rows = [(c, t, "user", f"{c % (t + 1)}") for c in range(90) for t in range(4)]
    assert set(map(tuple, trie_of(spark, rows).collect())) == plain_trie(rows)
    assert trie_of(spark, []).collect() == []
    assert [tuple(x) for x in trie_of(spark, [(1, 0, None, None)]).collect()]


def test_ids_are_hashed_across_blocks(spark, monkeypatch):
    from tidemill.llm import common

    monkeypatch.setattr(common, "ID_BLOCK", 7)
    rows = [(k % 3, k) for k in range(100)] + [(5, 5)]
    got = {x["k"]: x["sha256"] for x in common.joined_sha256(spark.createDataFrame(rows, "k int, id long"), ["k"], "id").collect()}
    assert got == {k: sha(sorted(i for j, i in rows if j == k)) for k in (0, 1, 2, 5)}


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contaminated(texts, items, window=10):
    wins = collections.defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            wins[tuple(w[k : k + size])].add("" if i is None else str(i))
    sizes = {len(w) for w in wins}
    out = []
    for t in texts:
        w, hit, ids = plain_words(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if found := wins.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    ids |= found
        out.append((len(w), len(hit), len(ids), sha(sorted(ids)), bool(hit)))
    return out


def contaminated_of(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in enumerate(texts)], "doc_id long, text string, shingle string, w int").repartition(3)
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, key int")
    got = {x["doc_id"]: tuple(x)[1:] for x in decontamination.contaminated(docs, bench).collect()}
    assert len(got) == len(texts)
    return [got[i] for i in range(len(texts))]


def passages(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "A", "\u00e9t\u00e9", "x1", *[f"w{r.randint(0, 40)}" for _ in range(4)]])
    items = [(i, " ".join(word() for _ in range(r.choice([1, 3, 4, 9, 10, 11, 14, 30])))) for i in range(12)]
    items += [(100, None), (101, ""), (102, "?!"), (None, "no id at all but words"), (3, "the same id with another text of more than ten words in it"), (104, items[5][1]), (105, "a a a a a a a a a a a a")]
    texts = [None, "", "...", "the", "a " * 40, "a " * 10 + "b", items[5][1], items[5][1].upper(), items[6][1].replace(" ", "--"), "x" * 5000]
    for _ in range(40):
        t = [word() for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(0, 3)):
            w = (r.choice(items)[1] or "").split()
            k = r.randint(0, max(0, len(w) - 3))
            t += w[k : k + r.randint(1, 25)]
        texts.append(" ".join(t))
    return texts + texts[-2:], items


@pytest.mark.parametrize("how", ["broadcast", "shuffled"])
def test_decontamination(spark, monkeypatch, how):
    if how == "shuffled":
        monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
        monkeypatch.setattr(decontamination, "HELD", 20)
        monkeypatch.setattr(decontamination, "BITS", 1 << 16)
    texts, items = passages(2)
    assert contaminated_of(spark, texts, items) == plain_contaminated(texts, items)


def test_decontamination_of_empty_tables(spark):
    assert contaminated_of(spark, [], [(1, "a b c")]) == []
    assert contaminated_of(spark, ["a b c", None], []) == plain_contaminated(["a b c", None], [])
    assert contaminated_of(spark, ["a b c"], [(1, None)]) == plain_contaminated(["a b c"], [])


def test_wavelet_tree():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 17, 64, 200):
        ys = rng.permutation(n)
        box = [np.sort(rng.integers(0, n + 1, (2, 60)), axis=0) for _ in range(2)]
        which, y = spelling.WaveletTree(ys).report(box[0][0], box[0][1], box[1][0], box[1][1])
        got = sorted(zip(which.tolist(), y.tolist(), strict=True))
        assert got == sorted((k, int(v)) for k in range(60) for x, v in enumerate(ys) if box[0][0][k] <= x < box[0][1][k] and box[1][0][k] <= v < box[1][1][k])


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: sorted((x for x in n if x != w and one_edit(w, x)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: near[w][0] if near[w] and n[near[w][0]] >= 2 * n[w] else None for w in n}
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def variants(spark, rows, split=spelling.SPLIT):
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, word string, n long").repartition(3)
    return [tuple(x) for x in spelling.spelling_variants(df, split).collect()]


@pytest.mark.parametrize("split", [1, 1000])
def test_spelling(spark, monkeypatch, split):
    monkeypatch.setattr(spelling, "CHUNK", 300)
    monkeypatch.setattr(spelling, "HELD", 50)
    r = random.Random(11)
    word = lambda: "".join(r.choice("ab\u00e9\u00ff\u00d7") for _ in range(r.choice([3, 4, 5, 5, 6, 6, 7])))
    stock = [word() for _ in range(150)] + ["aaaaa", "aaaaaa", "aaaaaaa", "A" * 5, "b" * 300, "b" * 301, "b" * 150 + "a" + "b" * 150]
    rows = [(i, r.choice([" ", ", ", "7"]).join(r.choices(stock, weights=[1 + 9 / (k + 1) for k in range(len(stock))], k=60))) for i in range(60)]
    rows += [(None, " ".join(stock)), (5, rows[5][1]), (5, rows[5][1]), (61, None), (62, ""), (63, "\u0100abcde\u4e00abcde \U0001f600abcde")]
    got = variants(spark, rows, split)
    assert len(got) == len(set(got)) and set(got) == plain_variants(rows)


def test_spelling_of_nothing(spark):
    assert variants(spark, []) == variants(spark, [(1, None), (2, "a b c d")]) == []


def test_crcs_of_long_runs():
    runs = ["a", "\u00e9" * 70_000, "b\u00ff" * 40_000, "abc"]
    raw = b" ".join(x.encode("latin-1") for x in runs)
    starts = np.array([raw.index(x.encode("latin-1")) for x in runs])
    begun = np.array([zlib.crc32(b"12:")] * 4, np.uint32)
    got = spelling.run_crcs(np.frombuffer(raw, np.uint8), starts, np.array([len(x) for x in runs]), begun)
    assert got.tolist() == [zlib.crc32(f"12:{x}".encode()) for x in runs]


def test_media_headers_may_be_cut_anywhere(spark):
    r = random.Random(9)
    media = mpeg_audio.write_mpeg(b"payload " * 400)
    for _ in range(400):
        a, z = sorted(r.sample(range(len(media)), 2))
        cut = bytearray(media[:a] + media[z:])
        for _ in range(r.randint(0, 6)):
            if cut:
                cut[r.randrange(len(cut))] = r.randrange(256)
        mpeg_audio.probe_mpeg(bytes(cut))
    # the smallest frames of every version, layer and checksum, with marks of tables that do not fit
    for second in range(0xE0, 0x100):
        for third in range(0, 256, 4):
            for mark in (b"Xing\xff\xff\xff\xff", b"Info\x00\x00\x00\x07", b"Xing", b"VBRI"):
                for at in (4, 6, 13, 15, 21, 23, 36, 38):
                    frame = bytearray(b"\xff" + bytes([second, third, 0xC0]) + bytes(60))
                    frame[at : at + len(mark)] = mark
                    mpeg_audio.probe_mpeg(bytes(frame))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert mpeg_audio.read_audio(mpeg_audio.store_audio(empty)).collect() == []


def test_terms_are_found_in_rows_without_an_id(spark):
    texts = [f"report {k} by zanzibar person, mail zed@ex.org today" for k in range(4)] + [f"report {k} of other words, nothing else" for k in range(40)]
    known = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    nameless = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    spans = lambda df: sorted((r["text"], str(r["spans"])) for r in pii.find_pii(df).collect())
    assert spans(known) == spans(nameless) and any("'term'" in s for _, s in spans(nameless))


def test_a_lost_part_of_the_language_model_is_an_error(spark):
    docs = spark.createDataFrame([(i, f"some words {i} of a text {i % 3}") for i in range(30)], "doc_id long, text string")
    model = kneser_ney.train_lm(docs.select("text"), 3)
    assert all(r["score"] > -1000 for r in kneser_ney.score_lm(docs, model).collect())
    part = sorted(model.held["pairs"])[0]
    kneser_ney.mapped.cache_clear()
    fs, path = kneser_ney.file_system(model.folder)
    fs.delete_file(f"{path}/pairs{part}.keys.npy")
    with pytest.raises(Exception, match="pairs"):
        kneser_ney.Model.scores(model, ["some words 1 of a text 1", "some words 2"], kneser_ney.WordHash())
    empty = docs.where("doc_id < 0")
    assert kneser_ney.score_lm(empty, model).collect() == []
    assert [r["n_tokens"] for r in kneser_ney.score_lm(docs.where("doc_id = 1"), kneser_ney.train_lm(empty.select("text"), 3)).collect()] == [8]
