"""Operator 7: gradient-boosted trees on lexical features of URLs."""

from __future__ import annotations

from collections import Counter
import math
import re
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lamplight.llm.common import forget, pick, stored

#: Names of hosts on a block list, from which labels are taken where no table has any.
BLOCKED = ("spam-farm", "casino", "cheap-pills", "free-bets", "adult-x", "ads-track", "phish", "warez")
BINS = 32


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\[\]]+)", 1))


def suffix_of(host: Column) -> Column:
    """The last label, with the one before where that is a short one under a country's (co.uk): a few thousand at most."""
    return F.regexp_extract(host, r"((?:(?<=\.)[a-z]{1,3}\.[a-z]{2}|[a-z0-9-]+))$", 1)


def listed(pages: DataFrame, names: tuple[str, ...] = BLOCKED) -> DataFrame:
    """url, blocked: every URL, labelled by whether a label of its host has a name of the block list."""
    url = pick(pages, "url").where("length(url) > 0")
    return url.select("url", host_of(F.col("url")).rlike(r"(^|[.])(" + "|".join(map(re.escape, names)) + r")(-[a-z0-9-]*)?[.]").cast("int").alias("blocked"))


def features(url: str, suffix: float) -> list[float]:
    """Length, depth, digit ratio, entropy, parameters, the shape of the host, and its suffix's statistic."""
    try:
        s = urlsplit(url)
        host = s.hostname or ""
    except ValueError:
        s, host = urlsplit(""), ""
    n, counts, labels = max(1, len(url)), Counter(url), host.split(".")
    name = max(labels, key=len)
    vowels = sum(c in "aeiou" for c in name) / max(1, len(name))
    return [len(url), len(host), s.path.count("/"), host.count("."), sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in host) / max(1, len(host)), -sum(k / n * math.log2(k / n) for k in counts.values()), len(re.findall(r"[^&]+", s.query)), len(s.query), url.count("-"), host.count("-"), len(name), vowels, float(s.scheme == "https"), suffix]


class Boosted:
    """Logistic gradient boosting with histogram splits, of weighted rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2):
        p = min(max(float((w * y).sum() / w.sum()), 1e-6), 1 - 1e-6)
        self.base, self.rate, self.trees, w = math.log(p / (1 - p)), rate, [], w * len(w) / w.sum()
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b, f = self._bin(x), np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            t = self._grow(b, w * (y - p), w * p * (1 - p), np.arange(len(y)), depth)
            self.trees.append(t)
            f += rate * self._eval(t, b)

    def _bin(self, x):
        return np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(self.cuts)], 1)

    def _grow(self, b, g, h, rows, depth):
        leaf = float(np.clip(g[rows].sum() / (h[rows].sum() + 0.1), -4, 4))
        if not depth or len(rows) < 10:
            return leaf
        best, total_g, total_h = (1e-6, 0, 0), g[rows].sum(), h[rows].sum()
        for j in range(b.shape[1]):
            gs, hs = (np.cumsum(np.bincount(b[rows, j], v[rows], BINS)) for v in (g, h))
            gain = gs**2 / (hs + 0.1) + (total_g - gs) ** 2 / (total_h - hs + 0.1) - total_g**2 / (total_h + 0.1)
            k = int(gain[:-1].argmax())
            best = max(best, (float(gain[k]), j, k))
        if best[0] <= 1e-6:
            return leaf
        left = b[rows, best[1]] <= best[2]
        return (best[1], best[2], self._grow(b, g, h, rows[left], depth - 1), self._grow(b, g, h, rows[~left], depth - 1))

    def _eval(self, t, b):
        if not isinstance(t, tuple):
            return np.full(len(b), t)
        return np.where(b[:, t[0]] <= t[1], self._eval(t[2], b), self._eval(t[3], b))

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        return 1 / (1 + np.exp(-(self.base + self.rate * sum((self._eval(t, b) for t in self.trees), np.zeros(len(b))))))


def train(labelled: DataFrame, train_limit: int = 20_000) -> tuple[Boosted | None, dict[str, float], float]:
    """The model, the suffixes' statistics, and that of any other. Statistics and the share of the classes come from all
    labelled URLs (url, blocked); the trees are fitted to train_limit URLs of each class at most, those with the least
    hash, weighted so that each class counts as it does among all. A suffix's statistic is the share of its hosts that
    are blocked; for a row of the training set, its own host is left out."""
    own = stored(labelled.where("length(url) > 0 AND blocked IN (0, 1)").select("url", "blocked", host_of(F.col("url")).alias("host")), "labelled")
    n = {r.blocked: r["count"] for r in own.groupBy("blocked").count().collect()}
    if len(n) < 2:
        return None, {}, 0.0
    hosts = own.groupBy("host").agg(F.avg("blocked").alias("y"))
    sums = {r.suffix: (r.y, r.n) for r in hosts.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(F.sum("y").alias("y"), F.count("*").alias("n")).collect()}
    prior = sum(y for y, _ in sums.values()) / sum(k for _, k in sums.values())
    some = None
    for y, k in n.items():
        share = min(1.0, 3 * train_limit / k)  # enough, whatever is repeated; so only these are sorted
        part = own.where((F.col("blocked") == y) & (F.pmod(F.xxhash64(F.lit(1), "url"), F.lit(1_000_000)) < F.lit(math.ceil(share * 1e6)))).distinct().orderBy(F.xxhash64("url"), "url").limit(train_limit)
        some = part if some is None else some.unionByName(part)
    rows = some.join(hosts.withColumnRenamed("y", "host_y"), "host").select("url", "blocked", "host_y", suffix_of(F.col("host")).alias("suffix")).orderBy("url", "blocked").collect()
    forget(own)
    stat = lambda y, k: (y + 5 * prior) / (k + 5)
    x = np.array([features(r.url, stat(sums[r.suffix][0] - r.host_y, sums[r.suffix][1] - 1)) for r in rows])
    y = np.array([r.blocked for r in rows], float)
    taken = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    return Boosted(x, y, np.where(y == 1, n[1] / taken[1], n[0] / taken[0])), {s: stat(*v) for s, v in sums.items()}, prior


def filter_urls(pages: DataFrame, labelled: DataFrame | None = None, train_limit: int = 20_000) -> DataFrame:
    """page_id, url, score, blocked (score >= 0.5); a row for each row. labelled has url and blocked (0 or 1, null for
    none); where it isn't given, listed(pages) is taken. Null and empty URLs have no score and are blocked; what can't
    be parsed is scored by its characters; equal URLs have equal scores, whatever their ids, null ids included; with
    one class of labels only, scores are 0 and none but null and empty URLs are blocked."""
    model, suffixes, other = train(listed(pages) if labelled is None else pick(labelled, "url", "blocked"), train_limit)
    rows = pick(pages, "page_id", "url")

    def each(batches):
        for b in batches:
            x = np.array([features(u or "", suffixes.get(s, other)) for u, s in zip(b.url, b.suffix)]).reshape(len(b), -1)
            yield pd.DataFrame({"page_id": b.page_id, "url": b.url, "score": model.predict(x) if model and len(b) else np.zeros(len(b))})

    out = rows.withColumn("suffix", suffix_of(host_of(F.col("url")))).mapInPandas(each, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, score double")
    none = F.coalesce(F.length("url") == 0, F.lit(True))
    return out.select("page_id", "url", F.when(~none, F.col("score")).alias("score"), (none | (F.col("score") >= 0.5)).alias("blocked"))
