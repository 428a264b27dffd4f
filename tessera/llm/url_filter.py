"""URL filters: rules on hosts and paths, then a logistic regression on hashed character n-grams.

A rule fits its host and all its subdomains if the url's path starts with the rule's path. The longest fitting
rule decides (host and path counted together; of equally long ones the one with the longer host, then the one
that blocks). Where none fits, the model does: n-grams of the host and of the path are hashed into one vector
of weights, learned by gradient descent from a small table of labelled urls.

Defined cases: a url that is null or has no ``://`` has an empty host and path, no rule, and is judged by the
model as an empty url, which is allowed; repeated rows are judged alike; an empty table gives no rows; other columns
pass through ``judge`` untouched, but for the five that it adds, which replace columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.arrow import as_bytes, batch

BITS = 15
SIZES = (3, 4, 5)
#: Rules of the query: verdict, host, path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

# The labelled urls, 1 for those to block.
LABELLED = (
    ("https://spam-farm.example.org/en/12", 1), ("http://spam-farm.example.com/fr/3?utm_source=feed", 1), ("https://www.spam-site.net/offers/1", 1), ("http://spam.blogs.example/post/9", 1),
    ("https://linkfarm.example.net/page/44", 1), ("http://link-farm.org/exchange/2", 1), ("https://content-farm.com/listicle/881", 1), ("http://seo-farm.example.com/backlinks", 1),
    ("https://best-casino-bonus.com/slots", 1), ("http://casino.example.net/free-spins/77", 1), ("https://online-casino.example.org/de/poker", 1), ("https://betting-tips.win/odds/5", 1),
    ("https://cheap-pills.example.com/viagra", 1), ("http://pharmacy-deals.biz/pills/order", 1), ("https://xxx-cams.example.net/live", 1), ("http://adult-videos.xxx/watch/31", 1),
    ("https://free-porn.example.org/tube/2", 1), ("http://porn-hub-mirror.example/xxx/19", 1), ("https://payday-loans.example.com/apply-now", 1), ("http://fast-loans.biz/credit/no-check", 1),
    ("https://malware-download.example.net/setup.exe", 1), ("http://cracked-software.example.com/keygen.exe", 1), ("https://warez.example.org/serials/8", 1), ("http://click-tracker.ads.example/redirect/7", 1),
    ("https://phishing-login.example.com/verify-account", 1), ("http://scam-alert-prize.win/claim-prize", 1), ("https://doorway.example.net/keyword-list/4", 1), ("http://autogenerated-spam.example.com/en/page/3", 1),
    ("https://www.example.com/en/12", 0), ("https://example.org/fr/825?page=2&ref=x", 0), ("https://m.example.net/en/25#top", 0), ("http://blog.example.com/en/853/", 0),
    ("https://www.example.net/de/40.html", 0), ("https://m.example.org/es/9", 0), ("https://blog.example.net/es/533/", 0), ("http://example.com/fr/7?utm_source=feed", 0),
    ("https://en.wikipedia.org/wiki/Logistic_regression", 0), ("https://de.wikipedia.org/wiki/Berlin", 0), ("https://www.nasa.gov/missions/apollo", 0), ("https://docs.python.org/3/library/re.html", 0),
    ("https://spark.apache.org/docs/latest/sql-ref.html", 0), ("https://arxiv.org/abs/1706.03762", 0), ("https://www.gutenberg.org/ebooks/1342", 0), ("https://news.example.com/2024/05/election", 0),
    ("https://www.bbc.co.uk/news/science", 0), ("https://library.example.edu/catalog/771", 0), ("https://www.example.edu/courses/linear-algebra", 0), ("https://data.example.gov/dataset/census", 0),
    ("http://blog.the-garden.example.org/en/tomatoes", 0), ("https://www.there.example.net/en/story/5", 0), ("https://m.other.example.com/fr/recette/12", 0), ("https://then.example.org/de/artikel/3.html", 0),
    ("https://museum.example.org/exhibits/2", 0), ("https://www.recipes.example.com/en/bread/", 0), ("https://forum.example.net/thread/311?page=4", 0), ("https://blog.station.example.com/en/trains/", 0),
    ("https://www.farmers-market.example.org/en/apples", 0), ("https://health.example.gov/advice/sleep", 0), ("https://shop.example.com/books/history", 0), ("https://weather.example.net/de/wetter/heute", 0),
)


# --- parts and rules -----------------------------------------------------------------------


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    clean = lambda c: F.coalesce(c, F.lit(""))
    return F.translate(clean(host), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), clean(path)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The deciding rule and its verdict; null where none fits."""
    first = sorted(set(rules), key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block", r[1:]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in first]
    name = F.coalesce(*(F.when(ok, h + p) for ok, (_, h, p) in zip(fits, first)), F.lit(None).cast("string"))
    verdict = F.coalesce(*(F.when(ok, v) for ok, (v, _, _) in zip(fits, first)), F.lit(None).cast("string"))
    return name, verdict


# --- the model ---------------------------------------------------------------------------------


def features(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams of each string with an edge mark, and where each string's begin."""
    marked = [b"\x02" + p + b"\x03" for p in parts]
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(data))  # bytes to the string's end
    owner = np.repeat(np.arange(len(parts)), np.diff(ends, prepend=0))
    buckets, owners, hashed = [], [], np.zeros(len(data), np.uint64)
    for n in range(1, max(SIZES) + 1):
        hashed = hashed[: len(data) - n + 1] * np.uint64(0x100000001B3) + data[n - 1 :] + np.uint64(n)
        if n in SIZES:
            whole = left[: len(hashed)] >= n
            mixed = (hashed[whole] ^ (hashed[whole] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            buckets.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(owner[: len(hashed)][whole])
    return np.concatenate(buckets), np.concatenate(owners)


def url_features(hosts: list[bytes], paths: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Host and path n-grams have separate halves of the vector."""
    a, i = features(hosts)
    b, j = features(paths)
    return np.concatenate([a, b + (1 << BITS)]), np.concatenate([i, j])


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def probabilities(self, hosts: list[bytes], paths: list[bytes]) -> np.ndarray:
        at, owner = url_features(hosts, paths)
        total = np.bincount(owner, self.weights[at], len(hosts))
        count = np.maximum(np.bincount(owner, minlength=len(hosts)), 1)
        return 1 / (1 + np.exp(-np.clip(total / np.sqrt(count) + self.bias, -500, 500)))


def split_url(url: str) -> tuple[bytes, bytes]:
    """As host_and_path, for the labelled table."""
    _, found, rest = url.partition("://")
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[cut:]
    stop = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return (rest[:cut].encode().lower(), path[:stop].encode()) if found else (b"", b"")


def train(labelled: Sequence[tuple[str, int]] = LABELLED, rounds: int = 400, rate: float = 1.0, decay: float = 2e-4) -> Model:
    """Full-batch gradient descent; the same table always gives the same model."""
    parts = [split_url(u) for u, _ in labelled]
    at, owner = url_features([h for h, _ in parts], [p for _, p in parts])
    y = np.array([v for _, v in labelled], np.float64)
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(y)), 1))
    model = Model(np.zeros(2 << BITS), 0.0)
    for _ in range(rounds):
        z = np.bincount(owner, model.weights[at], len(y)) * scale + model.bias
        error = 1 / (1 + np.exp(-z)) - y
        model.weights -= rate * (np.bincount(at, (error * scale)[owner], len(model.weights)) / len(y) * 10 + decay * model.weights)
        model.bias -= rate * error.mean()
    return model


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train()


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            names = rows.schema.names
            hosts, paths = as_bytes(rows["host"]), as_bytes(rows["path"])
            score = model.value.probabilities(hosts, paths) if len(hosts) else np.zeros(0)
            empty = np.array([not h and not p for h, p in zip(hosts, paths)], bool)
            yield batch([*names, "score"], [*rows.columns, np.where(empty, 0.0, score)])

    return run


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, model: Model | None = None, threshold: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, score (the model's, 1 for certainly to block) and verdict."""
    added = ("host", "path", "rule", "score", "verdict")
    host, path = host_and_path(F.col("url"))
    parts = pages.drop(*added).withColumns({"host": host, "path": path})
    weights = pages.sparkSession.sparkContext.broadcast(model or default_model())  # of fixed size
    scored = parts.mapInArrow(_scored(weights), T.StructType([*parts.schema, T.StructField("score", T.DoubleType())]))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.withColumns({"rule": rule, "verdict": F.coalesce(verdict, own)})


def query(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
