"""Plain Python versions of the operators that the pipeline chains, for small inputs."""

import collections
import hashlib
import itertools
import math
import re

LEVELS = ("domain", "lang", "source")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(texts, width, percent):
    """Smallest number reachable by links, for each text."""
    sets = []
    for t in texts:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = words(w)
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    best = list(range(len(texts)))

    def find(n):
        while best[n] != n:
            n = best[n]
        return n

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            x, y = sorted((find(i), find(j)))
            best[y] = x
    return [find(n) for n in range(len(texts))]


def luhn(s):
    return sum(x - 9 if x > 9 else x for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(s)))) % 10 == 0


def pattern_spans(text):
    digits = lambda v: re.sub("[^0-9]", "", v)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m.group())]


MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


def revealing(texts, support=2, generalised=0.8, removed=0.95):
    """term -> action, from whole distinct texts; entities are e-mail addresses and the kinds."""
    bags = []
    for t in {t for t in texts if t is not None}:
        spans = pattern_spans(t)
        own = {(k, t[a:b].lower() if k == "email" else re.sub(r"(?<![0-9])0+(?=[0-9])", "", t[a:b]) if k == "ip" else re.sub("[^0-9]", "", t[a:b])) for k, a, b in spans}
        bags.append((set(re.findall(r"[^\W\d_]{3,}", re.sub(MAIL, " ", t).lower())), own | {k for k, _, _ in spans}))
    n, n_t, n_e = len(bags), collections.Counter(w for ws, _ in bags for w in ws), collections.Counter(e for _, es in bags for e in es)
    best = {}
    for (w, e), k in collections.Counter(p for b in bags for p in itertools.product(*b)).items():
        if k >= support and n_e[e] < n:
            best[w] = max(best.get(w, -9), math.log(n * k / n_t[w] / n_e[e]) / math.log(n / n_e[e]))
    return {w: "remove" if v >= removed else "generalise" for w, v in best.items() if v >= generalised}


def sanitise(text, actions):
    base = pattern_spans(text)
    terms = [("term", m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", text or "") if m[0].lower() in actions]
    terms = [x for x in terms if not any(b[1] < x[2] and x[1] < b[2] for b in base)]
    out, at = "", 0
    for kind, a, b in sorted([*base, *terms], key=lambda s: (s[1], s[2], s[0])):
        if a >= at:
            value = text[a:b]
            put = f"<{kind.upper()}>" if kind != "term" else "" if actions[value.lower()] == "remove" else "[" + re.sub("[^X]+", "x", re.sub("[A-Z]+", "X", value)) + "]"
            out, at = out + text[at:a] + put, b
        at = max(at, b)
    return (text if not base and not terms else out + text[at:]), bool(base or terms)


def water(budget, nodes):
    """Budgets of siblings name -> (supply, weight): shares by weight, full ones hand on what they cannot use."""
    out, left = {}, {k: v for k, v in nodes.items() if v[1] > 0}
    while left:
        total = sum(w for _, w in left.values())
        full = {k for k, (s, w) in left.items() if s <= budget * w / total}
        if not full:
            return out | {k: budget * w / total for k, (_, w) in left.items()} | {k: 0.0 for k in nodes if nodes[k][1] <= 0}
        for k in full:
            out[k] = left.pop(k)[0]
            budget -= out[k]
    return out | {k: 0.0 for k in nodes if nodes[k][1] <= 0}


def mix(rows, fraction=0.8, max_epochs=2, alpha=0.7, weights=None, seed=17):
    """epochs of each (doc_id, text, lang, source) row, in order; 0 where it is not taken."""
    made = []
    for i, text, lang, source in rows:
        number = re.search("[0-9]{1,9}$", source or "")
        made.append((i, (f"d{int(number[0]) % 4}" if number else "unknown", *("unknown" if x is None else x for x in (lang, source))), max(1, len(words(text)))))
    tokens = collections.Counter()
    for _, leaf, n in made:
        for d in (1, 2, 3):
            tokens[leaf[:d]] += n
    budget = {(): sum(n for _, _, n in made) * fraction}
    for d in (1, 2, 3):
        for parent in [k for k in budget if len(k) == d - 1]:
            own = {k: (t * max_epochs, (weights or {}).get("/".join(k), t**alpha)) for k, t in tokens.items() if len(k) == d and k[: d - 1] == parent}
            budget |= water(budget[parent], own)
    epochs = {}
    for leaf in {x[1] for x in made}:
        whole = math.floor(budget[leaf] / tokens[leaf])
        rest, used = budget[leaf] - whole * tokens[leaf], 0
        mine = [(hashlib.md5(f"{seed}:{whole + 1}:{i}".encode()).hexdigest(), i, n, k) for k, (i, own, n) in enumerate(made) if own == leaf]
        for _, _, n, k in sorted(mine):
            epochs[k] = whole + (used < rest)
            used += n
    return [epochs[k] for k in range(len(made))]


def pack(rows, capacity=2048):
    """bin of each (doc_id, piece) of rows (doc_id, tokens, source, cluster), as one shard."""
    pieces = [(min(capacity, n - p * capacity), i, p, s, c) for i, n, s, c in rows for p in range((max(n, 1) - 1) // capacity + 1)]
    bins, out = [], collections.defaultdict(list)
    for n, i, p, s, c in sorted(pieces, key=lambda x: (-x[0], x[1], x[2])):
        fit = [(capacity - sum(y[0] for y in b), k) for k, b in enumerate(bins) if sum(y[0] for y in b) + n <= capacity and all((s is None or y[3] != s) and y[4] != c for y in b)]
        k = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append([])
        bins[k].append((n, i, p, s, c))
        out[i, p].append(k)
    return out
