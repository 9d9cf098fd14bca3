"""URL filters: host and path rules, and logistic regression on hashed character n-grams for the rest.

A rule `host/path/` fits its host and all subdomains where the url's path starts with the rule's path; the longest
rule wins, equal lengths go to the first in text order. Without a rule the model decides: block at 0.5 or more.
A null url, or one without `://`, has an empty host and path, and so no n-gram: the model falls back to its bias, the share
of unwanted urls in its table, and allows it. Very long urls are read whole. Repeated rows are judged alike; extra columns
are kept out; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import ascii_lower, batch, columns, table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

# The small labelled table: words of unwanted and of harmless hosts and paths, combined by `labelled_urls`. An url is
# unwanted (1) if its host or its path is. Top-level parts say nothing, as both kinds get the same. Pass your own table as `labelled`.
UNWANTED_HOSTS = (
    "casino", "online-poker", "lucky-slots", "jackpot-wins", "sports-betting", "best-bets", "free-spins", "roulette-bonus", "cheap-viagra", "cialis-online",
    "discount-pills", "pharmacy-deals", "weight-loss-pills", "replica-watches", "fake-handbags", "payday-loans", "quick-cash", "debt-cash", "free-porn", "xxx-videos",
    "sexcams", "adult-dating", "hot-escorts", "nude-pics", "click-tracker", "adserver", "popunder-ads", "banner-ads", "pixel-track", "spam-mailer",
    "buy-backlinks", "seo-link-farm", "crypto-doubler", "bitcoin-giveaway", "free-iphone-prize", "win-prizes", "warez", "keygen-crack", "torrent-movies", "cracked-games",
)
HARMLESS_HOSTS = (
    "university", "city-library", "museum", "weather", "garden", "recipes", "history", "science-news", "daily-journal", "hospital",
    "school", "travel-guide", "maps", "docs", "wiki", "archive", "parliament", "theatre", "orchestra", "football-club",
    "chess", "photography", "astronomy", "biology-lab", "cooking", "knitting", "railway", "grammar", "language-courses", "village-council",
    "mountain-hiking", "river-fishing", "bookshop", "furniture", "open-source", "statistics", "observatory", "bakery", "choir", "cycling",
    "newspaper", "computer-center", "teacher", "drinking-water", "theater", "winter-sports", "letters", "butterflies", "carpenter", "farmer", "baker-street", "summer-camp",
)
UNWANTED_PATHS = (
    "casino/play", "win/jackpot-bonus", "free-spins?ref=9", "buy-cheap-viagra", "pills/order-now", "xxx/videos/7", "porn/hot-girls", "adult-cams/live", "click?aff=33", "track/pixel.gif",
    "ads/banner/12", "download/keygen-crack.exe", "payday-loans/apply", "free-iphone/claim-prize", "betting/odds", "spam/unsubscribe?id=4", "backlinks/buy", "replica-watches/sale",
)
HARMLESS_PATHS = (
    "", "about", "en/10", "de/77.html", "fr/2391/", "es/604?x=1", "wiki/Physics", "docs/index.html", "2021/05/12/story", "articles/water-cycle", "blog/post-7", "search?q=trees", "details/old-maps",
    "products/oak-table", "photos/4", "events/summer-concert", "en/history/chapter-2", "contact.html", "static/style.css", "people/staff", "lessons/verbs/3", "news/local/894", "page?id=15&ref=home", "opening-hours",
)
TOPS = (".com", ".org", ".net", ".test", ".example.com", ".example.org", ".example.net", ".info")
FRONTS = ("", "www.", "m.", "blog.")


def labelled_urls() -> list[tuple[str, int]]:
    """Each unwanted host with a few harmless and unwanted paths, each harmless host with several harmless paths and an unwanted one."""
    r, out = random.Random(4), []
    for hosts, bad, amounts in ((UNWANTED_HOSTS, 1, (3, 1)), (HARMLESS_HOSTS, 0, (10, 1))):
        for host in hosts:
            for n, paths, label in ((amounts[0], HARMLESS_PATHS, bad), (amounts[1], UNWANTED_PATHS, 1)):
                out += [(f"{r.choice(('http', 'https'))}://{r.choice(FRONTS)}{host}{r.choice(TOPS)}/{p}", label) for p in r.sample(paths, n)]
    return out


LABELLED = tuple(labelled_urls())

DIMS = 1 << 16
LOWER = {c: c + 32 for c in range(65, 91)}


def grams(host: str, path: str) -> np.ndarray:
    """Hashed 3- to 5-grams of the delimited host and path, each once."""
    found = {f"{k}{s[i : i + n]}" for k, s in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in (3, 4, 5) for i in range(len(s) - n + 1)}
    return np.unique(np.fromiter((zlib.crc32(g.encode("utf-8", "surrogatepass")) % DIMS for g in found), np.int64, len(found)))


def score(w: np.ndarray, b: float, host: str, path: str) -> float:
    """How likely the url is unwanted."""
    g = grams(host, path)
    return 1 / (1 + float(np.exp(-(w[g].sum() / max(len(g), 1) ** 0.5 + b))))


def split_url(url: str | None) -> tuple[str, str]:
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, slash, path = rest[:cut].partition("/")
    return host.translate(LOWER), slash + path


def train(labelled: Iterable[tuple[str, int]] = LABELLED, rounds: int = 400, rate: float = 0.5, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights by full-batch gradient steps on the labelled urls, and a bias that stays at their log odds, so that unknown n-grams speak for neither side."""
    rows = [(grams(*split_url(u)), y) for u, y in labelled]
    unwanted = sum(y for _, y in rows)
    w, b = np.zeros(DIMS), float(np.log((unwanted + 0.5) / (len(rows) - unwanted + 0.5)))
    if not rows:
        return w, b
    at, of = np.concatenate([g for g, _ in rows]), np.repeat(np.arange(len(rows)), [len(g) for g, _ in rows])
    norm = 1 / np.sqrt(np.bincount(of, minlength=len(rows)))
    y = np.array([y for _, y in rows], float)
    share = 1 / max(len(y), 1)
    for _ in range(rounds):
        z = np.bincount(of, w[at], len(rows)) * norm + b
        g = (1 / (1 + np.exp(-z)) - y) * share
        w -= rate * 40 * (np.bincount(at, (g * norm)[of], DIMS) + l2 * w / 40)
    return w, b


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule = verdict = None
    for text, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (F.lit(None).cast("string") if rule is None else rule), (F.lit(None).cast("string") if verdict is None else verdict)


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Iterable[tuple[str, str]] = RULES, labelled: Iterable[tuple[str, int]] = LABELLED) -> DataFrame:
    """id, host, path, rule, verdict and the model's block_score of every url."""
    w, b = train(labelled)
    schema = pa.schema([("id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("block_score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hs, ps, rules_, verdicts in columns(batches):
            scores = [score(w, b, h, p) for h, p in zip(hs, ps, strict=True)]
            verdicts = [v or ("block" if s >= 0.5 else "allow") for v, s in zip(verdicts, scores, strict=True)]
            yield batch(schema, ids, hs, ps, rules_, verdicts, scores)

    host, path = host_path(F.col(url_col))
    parts = df.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parts.select("id", "host", "path", rule.alias("rule"), verdict.alias("verdict")).mapInArrow(run, "id long, host string, path string, rule string, verdict string, block_score double")
    return judged.withColumnRenamed("id", id_col)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
