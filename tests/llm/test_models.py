"""Trainers, kernels and seek tables against plain versions of their rules."""

import collections
import itertools
import math
import random
import struct

import numpy as np
import pytest

from tidemill.llm import language_id, mpeg_audio, toxicity


def plain_ftrl(rows, k, epochs, alpha, beta, l1, l2, seed):
    """One weight at a time, in dictionaries; "bias" has no penalty by absolute value."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(f, c):
        v = z[f, c]
        if f != "bias":
            v = math.copysign(max(abs(v) - l1, 0), v)
        return -v / ((beta + math.sqrt(n[f, c])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            x, y = {**dict(zip(rows[i][0].tolist(), rows[i][1].tolist(), strict=True)), "bias": 1.0}, rows[i][2]
            w = {(f, c): weight(f, c) for f in x for c in range(k)}
            scores = [sum(x[f] * w[f, c] for f in x) for c in range(k)]
            total = sum(math.exp(s) for s in scores)
            for c in range(k):
                error = math.exp(scores[c]) / total - (c == y)
                for f, v in x.items():
                    g = v * error
                    z[f, c] += g - (math.sqrt(n[f, c] + g * g) - math.sqrt(n[f, c])) / alpha * w[f, c]
                    n[f, c] += g * g
    return weight


@pytest.mark.parametrize("l1", [0.0, 2e-3, 0.3])
def test_ftrl_against_one_weight_at_a_time(l1):
    r = random.Random(2)
    rows = []
    for _ in range(60):
        at = np.array(sorted(r.sample(range(40), 6)))
        rows.append((at, np.array([r.uniform(0.1, 3) for _ in at]), int(at[0]) % 3))
    w, b = language_id.ftrl(rows, 3, epochs=3, l1=l1)
    plain = plain_ftrl(rows, 3, 3, 0.5, 1.0, l1, 1e-4, 1)
    for f, c in itertools.product(range(40), range(3)):
        assert w[f, c] == pytest.approx(plain(f, c), abs=1e-9)
    assert b.tolist() == pytest.approx([plain("bias", c) for c in range(3)], abs=1e-9)
    assert not w[40:].any()
    if l1 == 0.3:  # the penalty leaves some weights of features that occur at zero
        assert (w[:40] == 0).any() and (w[:40] != 0).any()


def test_document_frequencies_against_plain_counts(spark):
    r = random.Random(5)
    letters = "abcdeéüßñøжщψ漢字ก" + "".join(map(chr, range(0x100, 0x1A0)))
    texts = ["".join(r.choice(letters + " 1,") for _ in range(r.randint(0, 90))) for _ in range(120)]
    texts += ["", "12 ½ --", "x" * 95, "A a A", "ΑΣ ΑΣΑ", "½a¼b"]
    got, n_docs = language_id.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    grams, want, some = language_id.Grams(), np.zeros(language_id.DIMS, np.int64), 0
    for t in texts:
        seen = {g for w in "".join(c if c.isalpha() else " " for c in t.lower()).split() for g in grams.of(w)}
        want[list(seen)] += 1
        some += bool(seen)
    assert n_docs == some and (got == want).all()


def test_temperature_is_the_best_of_its_steps(spark):
    r = random.Random(8)
    share = {"xx": 0.65, "yy": 0.35}  # syllables overlap, so that a cold model is too sure
    rows = [(i, " ".join("".join("ab"[r.random() < share[k]] for _ in range(4)) for _ in range(8)), k) for i, k in enumerate(["xx", "yy"] * 150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train_language(frame)
    steps = [2.0**e for e in np.arange(-2, 4.01, 0.125)]
    assert model.temperature in steps and steps[0] < model.temperature
    again = language_id.train_language(frame.repartition(5))
    assert again.temperature == model.temperature and np.allclose(again.weights, model.weights)
    scored = {x["doc_id"]: x for x in language_id.identify_language(frame, model).collect()}
    mean, right = (sum(f(scored[i], k) for i, _, k in rows) / len(rows) for f in (lambda x, k: x["score"], lambda x, k: x["lang_pred"] == k))
    assert abs(mean - right) < 0.12  # scores are about as often right as they say


def plain_kernel(a, b):
    """Sum over common subsequences of three and four characters with their gaps, from the definition."""

    def found(word):
        word, out = toxicity.START + word, collections.Counter()
        for size, span in ((3, 4), (4, 6)):
            for at in itertools.combinations(range(len(word)), size):
                wide = at[-1] - at[0] + 1
                if wide <= span and all(y - x <= size - 1 for x, y in itertools.pairwise(at)):
                    out["".join(word[i] for i in at)] += toxicity.DECAY ** (wide - size) * (toxicity.ANCHOR if at[0] == 0 else 1)
        return out

    def length(word):
        places = 0.0
        for size, span in ((3, 4), (4, 6)):
            for at in itertools.combinations(range(len(word) + 1), size):
                wide = at[-1] - at[0] + 1
                if wide <= span and all(y - x <= size - 1 for x, y in itertools.pairwise(at)):
                    places += (toxicity.DECAY ** (wide - size) * (toxicity.ANCHOR if at[0] == 0 else 1)) ** 2
        return math.sqrt(places)

    x, y = found(a), found(b)
    return sum(v * y[s] for s, v in x.items()) / (length(a) * length(b))


def test_string_kernel_against_its_definition():
    r = random.Random(11)
    marks = ["morron", "blorp", "zyk", "idiöt", "abcabcabc"]
    words = marks + ["".join(r.choice("morniblpzykdtabc*") for _ in range(r.randint(3, 14))) for _ in range(60)] + ["m*o*r*r*o*n", "moorron", "漢漢漢"]
    got = toxicity.Landmarks(marks).similarity(words)
    for i, j in itertools.product(range(len(words)), range(len(marks))):
        assert got[i, j] == pytest.approx(plain_kernel(words[i], marks[j]), abs=1e-9), (words[i], marks[j])
    assert got[words.index("moorron"), 0] > 0.5 > got[words.index("blorp"), 0]


def test_machine_is_its_dual_over_landmarks():
    toxic, clean = [("morron", 9.0), ("blorpface", 7.0)], [("morning", 40.0), ("table", 30.0), ("surface", 20.0), ("window", 9.0)]
    m = toxicity.fit_machine(toxic, clean)
    words = ["morron", "m.o.r.r.o.n", "blorpfaces", "morning", "table", "sur"]
    by_kernel = m.marks.similarity(words) @ m.dual + m.bias
    assert m.margins(words).tolist() == pytest.approx(by_kernel.tolist(), abs=1e-9)
    assert (by_kernel[:3] > 0).all() and (by_kernel[3:5] < 0).all()


@pytest.mark.parametrize("size", [64, 1500, 14000, 300000])
def test_written_seek_tables_name_the_frames_found(size):
    media = mpeg_audio.write_mpeg(random.Random(size).randbytes(size))
    p = mpeg_audio.probe_mpeg(media)
    assert p["vbr"]["frames"] == p["frames"] == len(p["offsets"]) and len(p["seek"]) == len(p["vbr"]["entries"]) == 100
    assert p["seek_error"] <= p["vbr"]["bytes"] // 256 + 1  # an entry is a 256th of the bytes
    assert [q for _, q in p["seek"]] == sorted(q for _, q in p["seek"])
    if p["frames"] > 2:  # bytes put between frames are seen in the offsets, not in the table
        at = p["offsets"][1]
        moved = mpeg_audio.probe_mpeg(media[:at] + bytes(5000) + media[at:])
        assert moved["junk"] == 5000 and moved["seek_error"] >= 4000 and moved["samples"] == p["samples"]


def vbri(sizes, scale=1, width=2, step=1, cut=None):
    """A version 1 layer III frame with a VBRI header, then frames of the given bitrate indexes."""
    frames = []
    for k in sizes:
        head = bytes((0xFF, 0xFB, k << 4, 0xC0))
        frames.append(head.ljust(mpeg_audio.header(head)[6], b"\0"))
    runs = [sum(map(len, frames[i : i + step])) // scale for i in range(0, len(frames), step)]
    head = bytes((0xFF, 0xFB, 14 << 4, 0xC0)).ljust(36, b"\0")
    table = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 1044 + sum(map(len, frames)), len(frames), len(runs), scale, width, step)
    first = (head + table + b"".join(x.to_bytes(width, "big") for x in runs)).ljust(mpeg_audio.header(head)[6], b"\0")
    return first[:cut] + b"".join(frames), frames


@pytest.mark.parametrize(("width", "step"), [(1, 1), (2, 1), (2, 3), (4, 2)])
def test_vbri_tables(width, step):
    r = random.Random(step)
    sizes = [r.randint(1, 4) for _ in range(30)]
    media, frames = vbri(sizes, width=width, step=step) if width > 1 else vbri([1] * 30, width=1)
    p = mpeg_audio.probe_mpeg(media)
    assert p["vbr"]["kind"] == "VBRI" and p["vbr"]["frames"] == p["frames"] == 30 and p["seek_error"] == 0
    assert len(p["seek"]) == -(-30 // step)
    assert p["offsets"] == [len(media) - sum(map(len, frames[k:])) for k in range(30)]


def test_seek_tables_that_do_not_fit():
    media, _ = vbri([3] * 4)
    for at, value in ((54, b"\xff\xff"), (58, b"\0\0"), (58, b"\0\x09"), (60, b"\0\0")):  # too many, without width, too wide, without step
        broken = media[:at] + value + media[at + 2 :]
        p = mpeg_audio.probe_mpeg(broken)
        assert p["vbr"] is None and p["frames"] == 5 and p["seek"] == [] and p["seek_error"] is None
    none = mpeg_audio.probe_mpeg(media[:54] + bytes(8) + media[62:])  # no entries, of no width
    assert none["vbr"]["entries"] == [] and none["seek_error"] is None and none["frames"] == 4
    assert mpeg_audio.probe_mpeg(media[:1044])["seek_error"] is None  # no frame behind the table
