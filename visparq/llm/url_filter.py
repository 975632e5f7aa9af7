"""URL filters: rules first, then gradient-boosted trees on lexical features.

The trees are trained here, on the driver, from at most ``MAX_LABELLED`` labelled URLs (those with the smallest hashes,
so the choice is the same on every run): the one bounded sample in this module. Every URL is judged. A suffix's or a first
path part's rate of blocked URLs is a feature; in training each row gets the rate of the ``FOLDS`` - 1 other folds, so that
no row's own label reaches its features. ``held_out`` measures the trees the same way, fold by fold.

Defined cases: a null URL or one without ``://`` has empty host and path; ids may be null or repeat; without labelled
URLs the trees are empty and every URL that no rule fits is allowed; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visparq.llm._common import workers_can_import

MAX_LABELLED = 20_000
TREES, DEPTH, RATE, BINS, LEAST, FOLDS = 40, 3, 0.2, 32, 20, 5
BLOCK_AT = 0.5
FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "labels", "longest_part", "part_digits", "suffix_rate", "suffix_seen", "head_rate", "head_seen")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path: from there up to ``? #``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(verdict, host, path) rules, the longest that fits: its text and verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def parts_of(url: str) -> tuple[str, str, str]:
    """Host (A-Z lower-cased), path and query."""
    rest = url.partition("://")[2]
    host = rest.replace("?", "/").replace("#", "/").partition("/")[0]
    path = rest[len(host) :].replace("#", "?").partition("?")[0]
    return host.translate(_LOWER), path, rest.partition("#")[0].partition("?")[2]


def named(url: str) -> tuple[str, str]:
    """What is counted over URLs: the host's last label and the path's first part."""
    host, path, _ = parts_of(url)
    return "." + host.rpartition(".")[2], "/" + path[1:].partition("/")[0] if path.count("/") > 1 else "/"


def lexical(url: str, rates: dict[str, tuple[float, int]], prior: float) -> list[float]:
    host, path, query = parts_of(url)
    n = max(1, len(url))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(url).values())
    last = path.rpartition("/")[2]
    out = [len(url), len(host), path.count("/"), sum(c.isdigit() for c in url) / n, entropy, len([p for p in query.split("&") if p]), url.count("-"), host.count(".") + 1, max(map(len, path.split("/"))), sum(c.isdigit() for c in last)]
    for name in named(url):
        rate, seen = rates.get(name, (prior, 0))
        out += [rate, math.log1p(seen)]
    return out


def rates_of(urls: list[str], y: np.ndarray, prior: float) -> dict[str, tuple[float, int]]:
    """Of each counted name: its rate of blocked URLs, drawn towards the prior by ten URLs, and how many it has."""
    seen: dict[str, list[float]] = {}
    for u, b in zip(urls, y, strict=True):
        for name in named(u):
            own = seen.setdefault(name, [0.0, 0])
            own[0] += b
            own[1] += 1
    return {k: ((b + 10 * prior) / (n + 10), int(n)) for k, (b, n) in seen.items()}


def folds_of(urls: list[str]) -> np.ndarray:
    """A URL's fold, by its text: equal URLs share one."""
    return np.array([zlib.crc32(u.encode()) % FOLDS for u in urls], int)


class Trees:
    """Boosted histogram trees for a two-way outcome; plain arrays, so that they travel with the task."""

    def __init__(self) -> None:
        self.start, self.trees, self.rates, self.prior = -10.0, [], {}, 0.0

    @classmethod
    def fit(cls, urls: list[str], blocked: list[int]) -> Trees:
        self, y = cls(), np.array(blocked, float)
        if len(y) == 0:
            return self
        self.prior = float(y.mean())
        self.rates, fold, x = rates_of(urls, y, self.prior), folds_of(urls), np.zeros((len(urls), len(FEATURES)))
        for k in range(FOLDS):
            other, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            rates = rates_of([urls[i] for i in other], y[other], self.prior)
            for i in own:
                x[i] = lexical(urls[i], rates, self.prior)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
        p = min(max(self.prior, 1e-6), 1 - 1e-6)
        self.start = math.log(p / (1 - p))
        score = np.full(len(y), self.start)
        for _ in range(TREES):
            prob = 1 / (1 + np.exp(-score))
            tree, leaf = self._grow(bins, cuts, y - prob, prob * (1 - prob))
            self.trees.append(tree)
            score += np.array([v for *_, v in tree])[leaf]
        return self

    @staticmethod
    def _grow(bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> tuple[list[tuple], np.ndarray]:
        """Nodes as (feature or -1, cut, left child, value); the right child follows the left."""
        tree: list[tuple] = [(-1, 0.0, 0, RATE * grad.sum() / (hess.sum() + 1))]
        leaf = np.zeros(len(grad), int)
        level = [0]
        for _ in range(DEPTH):
            grown = []
            for node in level:
                rows = np.flatnonzero(leaf == node)
                best, g0, h0 = (1e-9, -1, 0), grad[rows].sum(), hess[rows].sum()
                for f, c in enumerate(cuts):
                    size = len(c) + 1
                    g, h, n = (np.cumsum(np.bincount(bins[rows, f], w, size))[:-1] for w in (grad[rows], hess[rows], None))
                    if len(g):
                        gain = g**2 / (h + 1) + (g0 - g) ** 2 / (h0 - h + 1) - g0**2 / (h0 + 1)
                        gain[(n < LEAST) | (len(rows) - n < LEAST)] = 0
                        if gain.max() > best[0]:
                            best = (gain.max(), f, int(gain.argmax()))
                if best[1] >= 0:
                    right = bins[rows, best[1]] > best[2]
                    left = len(tree)
                    tree[node] = (best[1], float(cuts[best[1]][best[2]]), left, tree[node][3])
                    for k, own in enumerate((rows[~right], rows[right])):
                        tree.append((-1, 0.0, 0, RATE * grad[own].sum() / (hess[own].sum() + 1)))
                        leaf[own] = left + k
                    grown += [left, left + 1]
            level = grown
        return tree, leaf

    def probability(self, urls: list[str]) -> np.ndarray:
        x = np.array([lexical(u, self.rates, self.prior) for u in urls]).reshape(len(urls), len(FEATURES))
        score = np.full(len(urls), self.start)
        for tree in self.trees:
            at = np.zeros(len(urls), int)
            feature, cut, left, value = (np.array(c) for c in zip(*tree, strict=True))
            for _ in range(DEPTH):
                inner = feature[at] >= 0
                go = x[np.arange(len(urls)), np.maximum(feature[at], 0)] > cut[at]
                at = np.where(inner, left[at] + go, at)
            score += value[at]
        return 1 / (1 + np.exp(-score))


def held_out(urls: list[str], blocked: list[int]) -> tuple[float, float, float]:
    """Area under the curve, precision and recall at BLOCK_AT, each fold judged by trees that did not see it."""
    y, fold, p = np.array(blocked), folds_of(urls), np.zeros(len(urls))
    for k in range(FOLDS):
        other, own = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(own):
            p[own] = Trees.fit([urls[i] for i in other], y[other].tolist()).probability([urls[i] for i in own])
    order = np.argsort(p, kind="stable")
    value, first, many = np.unique(p[order], return_index=True, return_counts=True)
    rank = np.empty(len(p))
    rank[order] = np.repeat(first + (many + 1) / 2, many)
    bad = int(y.sum())
    area = (rank[y == 1].sum() - bad * (bad + 1) / 2) / max(1, bad * (len(y) - bad))
    hit = p >= BLOCK_AT
    return float(area), float(y[hit].mean()) if hit.any() else 1.0, float(hit[y == 1].mean()) if bad else 1.0


def labelled(pages: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """URLs with their labels (page_id, blocked: 0 or 1), at most MAX_LABELLED: those with the smallest hashes."""
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url")).join(labels, "page_id").where("blocked IS NOT NULL")
    rows = known.orderBy(F.xxhash64("page_id", "url"), "page_id", "url", "blocked").limit(MAX_LABELLED).collect()
    return [r["url"] for r in rows], [int(r["blocked"]) for r in rows]


def train(pages: DataFrame, labels: DataFrame) -> Trees:
    """Trees of the ``labelled`` URLs."""
    return Trees.fit(*labelled(pages, labels))


def judge(pages: DataFrame, trees: Trees, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, block_probability of every URL."""
    workers_can_import(pages.sparkSession)
    host, path = host_and_path(F.col("url"))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = trees.probability([u or "" for u in b.column("url").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("page_id", "host", "path")), pa.array(p, pa.float64())], names=["page_id", "host", "path", "block_probability"])

    scored = base.mapInArrow(run, "page_id long, host string, path string, block_probability double")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    model = F.when(F.col("block_probability") >= BLOCK_AT, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, model).alias("verdict"), "block_probability")
