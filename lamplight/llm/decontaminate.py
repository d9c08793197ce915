"""Operator 5: benchmark items found in documents within an edit budget."""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lamplight.llm.common import at, pick, plain

SHARD_CHARS = 20_000_000  # of items in one automaton


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to a part of the text, that part's end), bit-parallel."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, d, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        d += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if d < best:
            best, end = d, j + 1
    return best, end


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    cut = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


def budget(item: str, rate: float) -> int:
    return min(int(len(item) * rate), max(0, len(item) - 1))


class Index:
    """The pieces of some items (id, normalised text) in one automaton."""

    def __init__(self, items: list, rate: float):
        self.items, self.rate, self.found = items, rate, ahocorasick.Automaton()
        where: dict[str, list] = {}
        for i, (_, t) in enumerate(items):
            for offset, p in pieces(t, budget(t, rate)):
                where.setdefault(p, []).append((i, offset))
        for p, x in where.items():
            self.found.add_word(p, (len(p), x))
        self.found.make_automaton()

    def find(self, text: str):
        """(item id, least distance) of each item within its budget of some part of the text."""
        t, spans = normalise(text), {}
        for end, (n, where) in self.found.iter(t):
            for i, offset in where:
                spans.setdefault(i, set()).add(end + 1 - n - offset)
        for i, starts in spans.items():
            item_id, item = self.items[i]
            k, m, best, a, z = budget(item, self.rate), len(item), None, None, None
            for s in [*sorted(starts), None]:
                if a is not None and (s is None or s - k > z):
                    d, _ = myers(item, t[max(0, a) : z])
                    best = d if best is None else min(best, d)
                    a = None
                if s is not None:
                    a, z = s - k if a is None else a, s + m + k
            if best is not None and best <= k:
                yield item_id, best


def sharded(items: DataFrame) -> list[list]:
    """The items (id, normalised text) in lists of SHARD_CHARS; each is a broadcast and a pass of the documents."""
    shards, size = [], SHARD_CHARS
    for r in pick(items, "item_id", "text").where("item_id IS NOT NULL AND length(text) > 0").distinct().toLocalIterator():
        if t := normalise(r.text):
            if size >= SHARD_CHARS:
                shards, size = [*shards, []], 0
            shards[-1].append((r.item_id, t))
            size += len(t)
    return shards


def matches(docs: DataFrame, items: DataFrame, rate: float = 0.05) -> DataFrame:
    """doc_id, item_id, distance: every item within rate x its length edits of some part of a document, both in
    lower case with white space collapsed. Null or empty texts and items match nothing, nor do items without an id.
    Documents with one id, null included, share the least distance: repeated rows and ties yield one row."""
    spark, rows = docs.sparkSession, pick(docs, "doc_id", "text")
    kinds = ", ".join(f"{n} {x.schema[n].dataType.simpleString()}" for x, n in ((rows, "doc_id"), (items, "item_id"))) + ", distance int"
    out = spark.createDataFrame([], kinds)
    for shard in sharded(items):
        sent = spark.sparkContext.broadcast(shard)

        def search(batches, sent=sent):
            index = Index(sent.value, rate)
            for b in batches:
                found = [(i, *x) for i, t in zip(b.doc_id, b.text) if t for x in index.find(t)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "distance"])

        out = out.unionByName(rows.where("length(text) > 0").mapInPandas(search, kinds))
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def kept(docs: DataFrame, items: DataFrame, rate: float = 0.05) -> DataFrame:
    """The rows in whose own text no item is found, whatever their ids; null and empty texts stay. Nothing is moved."""
    spark, rows, text = docs.sparkSession, plain(docs), at(docs, "text")
    for shard in sharded(items):
        rows = rows.where(F.pandas_udf(_clean(spark.sparkContext.broadcast(shard), rate), "boolean")(text))
    return rows.toDF(*docs.columns)


def _clean(sent, rate: float):
    known: list[Index] = []

    def clean(texts: pd.Series) -> pd.Series:
        if not known:
            known.append(Index(sent.value, rate))
        return pd.Series([not t or next(known[0].find(t), None) is None for t in texts], dtype=bool)

    return clean
