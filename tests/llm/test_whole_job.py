"""What operators must not leave out: evidence that stands far away, is rare, or has copies."""

import collections
import itertools
import math
import random
import re

from tidemill.llm import packing, pii, toxicity

DOC = "doc_id long, text string, source string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, f"src{i % 3}") for i, t in enumerate(texts)], DOC)


def test_pii_terms_against_brute_force(spark):
    r = random.Random(3)
    letters = lambda n: "".join(chr(97 + (n // 26**k) % 26) for k in range(3))
    prose = lambda n: " ".join(f"w{letters(r.randrange(400))}" for _ in range(n))
    mail, own = r"[a-z.]+@home\.org", []
    for i in range(60):
        found = f"zor{letters(i // 2)} {prose(50)} {['x', 'X'][i % 2]}{letters(i // 2)}@home.org {prose(50)}" if i < 24 else prose(100)
        own.append(found)
    texts = [None, "", *own, *own[:3] * 4]  # copies count once
    bags = [(set(re.findall(r"[a-z]{3,}", re.sub(mail, " ", t.lower()))), {*re.findall(mail, t.lower()), *(["email"] if "@" in t else [])}) for t in set(texts) - {None}]
    n, n_t, n_e = len(bags), collections.Counter(w for ws, _ in bags for w in ws), collections.Counter(e for _, es in bags for e in es)
    n_te = collections.Counter(p for b in bags for p in itertools.product(*b))
    best = {}
    for (w, e), k in n_te.items():
        if k > 1:
            best[w] = max(best.get(w, -9), math.log(n * k / n_t[w] / n_e[e]) / math.log(n / n_e[e]))
    wanted = {w: (round(v, 6), "remove" if v >= 0.95 else "generalise") for w, v in best.items() if v >= 0.8}
    got = pii.revealing_terms(pii.with_base(docs(spark, texts))).collect()
    assert {x["term"]: (round(x["disclosure"], 6), x["action"]) for x in got} == wanted
    assert all(wanted[f"zor{letters(i)}"][1] == "remove" for i in range(12))


def test_toxicity_copies_erase_no_words(spark):
    r = random.Random(2)
    syll = ["an", "er", "tho", "in", "re", "sta", "lo", "mi"]
    plain = lambda n: " ".join("".join(r.choice(syll) for _ in range(r.randint(1, 4))) for _ in range(n))
    texts = [f"{plain(20)} {'grumpkin' if i % 8 else 'snotface'} {plain(20)}" if i % 4 == 0 else plain(40) for i in range(400)]
    copy = f"{plain(20)} grumpkin {plain(3)} snotface {plain(20)}"
    labels = spark.createDataFrame([(i, int(i % 4 == 0 or i >= 400)) for i in range(900)], "doc_id long, toxic int")
    machine = toxicity.train_toxicity(docs(spark, texts + [copy] * 500), labels)
    got = {x["doc_id"]: x["predicted"] for x in toxicity.score_toxicity(docs(spark, [plain(50), f"{plain(9)} grumpkin", f"{plain(9)} snotface"]), machine).collect()}
    assert got == {0: 0, 1: 1, 2: 1}


def test_packing_keeps_near_copies_apart(spark, tmp_path):
    r = random.Random(5)
    base = [f"w{r.randrange(5000)}" for _ in range(90)]
    near = [" ".join([*base[:-1], f"end{i}"]) for i in range(6)]
    texts = [*near, *[" ".join(f"v{r.randrange(5000)}" for _ in range(90)) for _ in range(6)], None, ""]
    rows = [(i, t, f"src{i}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    got = packing.op2_best_fit_packing(spark, str(tmp_path)).collect()
    bins = {x["doc_id"]: x["bin_id"] for x in got}
    assert len(got) == len(texts) and len({bins[i] for i in range(6)}) == 6 and bins[12] != bins[13]
