"""Operator 10: interpolated modified Kneser-Ney character trigrams, thresholded by language."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from lamplight.llm.common import at, forget, pick, plain, released, small, stored

BITS, POINTS = 21, 0x110001  # of a symbol (0 begins a text, else code point + 1), and how many there are
SHARDS = 8  # of the counts, by a trigram's middle symbol: all that its probability needs has that symbol
CHUNK = 2_000_000  # characters of the documents that travel together
ONE, TWO = (1 << BITS) - 1, (1 << 2 * BITS) - 1
ROW = "lang string, shard int, salt int, docs binary"
SUMS = "key long, tokens long, token_nats double, types long, type_nats double"


def trigrams(text: str) -> np.ndarray:
    u = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    x = np.concatenate([[0, 0], u])
    return (x[:-2] << 2 * BITS) | (x[1:-1] << BITS) | x[2:]


def discounts(n: dict[int, int]) -> np.ndarray:
    """For counts of 0, 1, 2, and 3 or more, from how many counts are 1, 2, 3 and 4."""
    n = [max(1, n.get(k, 0)) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *(min(k - 1e-3, max(1e-3, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3))])


def find(where: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(where):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    i = np.minimum(np.searchsorted(where, x), len(where) - 1)
    return i, where[i] == x


class Unigrams:
    """p of a symbol by its continuations, interpolated with all code points alike."""

    def __init__(self, symbols: np.ndarray, n: np.ndarray, cut: np.ndarray):
        order = np.argsort(symbols)
        self.symbols, n = symbols[order], n[order].astype(float)
        total, off = max(1.0, n.sum()), cut[np.minimum(n, 3).astype(int)]
        self.rest = (off.sum() / total if len(n) else 1.0) / POINTS
        self.p = (n - off) / total + self.rest

    def __call__(self, w: np.ndarray) -> np.ndarray:
        i, known = find(self.symbols, w)
        return np.where(known, self.p[i] if len(self.p) else 0.0, self.rest)


class Shard:
    """The trigrams of some middle symbols: p of any trigram with one of these in the middle."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, cuts: dict[int, np.ndarray], unigrams: Unigrams):
        order = np.argsort(grams)
        self.grams, n, self.unigrams = grams[order], n[order].astype(float), unigrams

        def contexts(keys, n, cut):
            k, at_ = np.unique(keys, return_inverse=True)
            total, off = np.bincount(at_, n, len(k)), cut[np.minimum(n, 3).astype(int)]
            back = np.bincount(at_, off, len(k)) / np.maximum(total, 1)
            return k, back, (n - off) / total[at_], back[at_]

        self.pairs, kinds = np.unique(self.grams & TWO, return_counts=True)
        self.k2, self.back2, p, b = contexts(self.pairs >> BITS, kinds.astype(float), cuts[2])
        self.p2 = p + b * unigrams(self.pairs & ONE)
        self.k3, self.back3, p, b = contexts(self.grams >> BITS, n, cuts[3])
        self.p3 = p + b * self.p2[find(self.pairs, self.grams & TWO)[0]] if len(n) else p

    def state(self) -> bytes:
        return pickle.dumps(self.__dict__ | {"unigrams": self.unigrams.__dict__})

    @classmethod
    def load(cls, raw: bytes) -> Shard:
        x, one = cls.__new__(cls), Unigrams.__new__(Unigrams)
        x.__dict__.update(pickle.loads(raw))
        one.__dict__.update(x.unigrams)
        x.unigrams = one
        return x

    def p(self, g: np.ndarray) -> np.ndarray:
        p = self.unigrams(g & ONE)
        for keys, value, k, back, x in ((self.pairs, self.p2, self.k2, self.back2, g & TWO), (self.grams, self.p3, self.k3, self.back3, g)):
            (i, seen), (j, known) = find(keys, x), find(k, x >> BITS)
            p = np.where(seen, value[i] if len(value) else 0.0, np.where(known, back[j] if len(back) else 1.0, 1.0) * p)
        return p


def model(trusted: DataFrame) -> tuple[list[str], DataFrame]:
    """The languages, and lang, shard, model: the counts of the trusted texts (lang, text), joined by shard. The
    language '' is that of all texts together."""

    def grams(batches):
        for b in batches:
            for lang, own in b.groupby("lang"):
                k, n = np.unique(np.concatenate([trigrams(t) for t in own.text]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": k, "n": n})

    counts = trusted.where("length(text) > 0").mapInPandas(released(grams), "lang string, gram long, n long")
    both = F.explode(F.array("lang", F.lit("")))
    c3 = stored(counts.select(both.alias("lang"), "gram", "n").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "trigrams")
    c2 = stored(c3.groupBy("lang", F.col("gram").bitwiseAND(F.lit(TWO)).alias("pair")).agg(F.count("*").alias("n")), "bigrams")
    # one row a symbol of a language, of texts whose number is bounded
    c1 = c2.groupBy("lang", F.col("pair").bitwiseAND(F.lit(ONE)).alias("symbol")).agg(F.count("*").alias("n")).toPandas()
    ones, cuts = {}, {}
    for order, c in ((3, c3), (2, c2)):
        for r in c.where("n <= 4").groupBy("lang", "n").count().collect():
            cuts.setdefault(r.lang, {}).setdefault(order, {})[r.n] = r["count"]
    for lang, own in c1.groupby("lang"):
        cuts[lang] = {k: discounts(cuts.get(lang, {}).get(k, {})) for k in (3, 2)}
        ones[lang] = Unigrams(own.symbol.to_numpy(np.int64), own.n.to_numpy(), discounts(own.n.value_counts().to_dict()))
    forget(c2)
    sent = trusted.sparkSession.sparkContext.broadcast((ones, cuts))

    def build(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        ones, cuts = sent.value
        x = Shard(b.gram.to_numpy(np.int64), b.n.to_numpy(), cuts[key[0]], ones[key[0]])
        return pd.DataFrame({"lang": [key[0]], "shard": [int(key[1])], "model": [x.state()]})

    middle = F.shiftright("gram", BITS).bitwiseAND(F.lit(ONE)) % SHARDS
    every = c3.select("lang", middle.cast("int").alias("shard"), "gram", "n").groupBy("lang", "shard").applyInPandas(build, "lang string, shard int, model binary")
    # a shard of a language without trigrams has to answer too
    none = [(lang, s, Shard(np.empty(0, np.int64), np.empty(0), cuts[lang], ones[lang]).state()) for lang in ones for s in range(SHARDS)]
    built = stored(every, "model")
    if none:
        none = trusted.sparkSession.createDataFrame(none, built.schema)
        built = built.unionByName(none.join(built, ["lang", "shard"], "left_anti"))
    return sorted(lang for lang in ones if lang), built


def keyed(docs: DataFrame) -> DataFrame:
    """lang, text, key: rows that are alike in both have one key."""
    return pick(docs, "lang", "text").select("lang", "text", F.xxhash64("lang", "text").alias("key"))


def scores(docs: DataFrame, langs: list[str], shards: DataFrame) -> DataFrame:
    """key, tokens, token_nats, types, type_nats of each text that isn't empty: its trigrams meet the shards of the
    counts, and what each shard says of a text is added up. Types are a text's distinct trigrams."""
    salts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // SHARDS)

    def packed(own: list[tuple[int, str]], lang: str):
        each = [np.unique(trigrams(t), return_counts=True) for _, t in own]
        g, n = (np.concatenate([x[i] for x in each]) for i in (0, 1))
        doc = np.repeat(np.arange(len(own), dtype=np.uint32), [len(x[0]) for x in each])
        keys, shard = np.array([k for k, _ in own], np.int64), ((g >> BITS) & ONE) % SHARDS
        z = zstandard.ZstdCompressor(1)
        for s in range(SHARDS):
            i = np.flatnonzero(shard == s)
            i = i[np.argsort(g[i], kind="stable")]
            u, m = np.unique(g[i], return_counts=True)
            if len(u):
                # documents ascend within a trigram: small steps are cheap to send
                d, c = np.diff(doc[i], prepend=np.uint32(0)), n[i].astype(np.uint32)
                parts = [keys, np.diff(u, prepend=0), m.astype(np.uint32), d, c]
                yield lang, s, int(keys[0] % salts), z.compress(pickle.dumps([x.tobytes() for x in parts]))

    def pack(batches):
        for b in batches:
            waiting: dict[str, list] = {}
            size: dict[str, int] = {}
            for lang, text, key in zip(b.lang, b.text, b["key"]):
                waiting.setdefault(lang, []).append((key, text))
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= CHUNK:
                    yield pd.DataFrame(packed(waiting.pop(lang), lang), columns=["lang", "shard", "salt", "docs"])
                    size.pop(lang)
            rows = [r for lang, own in waiting.items() for r in packed(own, lang)]
            yield pd.DataFrame(rows, columns=["lang", "shard", "salt", "docs"])

    def add(batches):
        for b in batches:
            for docs_, raw in zip(b.docs, b["model"]):
                keys, u, m, d, c = (np.frombuffer(x, t) for x, t in zip(pickle.loads(zstandard.ZstdDecompressor().decompress(docs_)), (np.int64, np.int64, np.uint32, np.uint32, np.uint32)))
                nats = np.repeat(-np.log(Shard.load(raw).p(np.cumsum(u))), m)
                d, k = np.cumsum(d, dtype=np.uint32).astype(np.int64), len(keys)
                sums = pd.DataFrame({"key": keys, "tokens": np.bincount(d, c, k).astype(np.int64), "token_nats": np.bincount(d, nats * c, k), "types": np.bincount(d, minlength=k), "type_nats": np.bincount(d, nats, k)})
                yield sums[sums.types > 0]

    # a language without trusted texts has the model of all
    lang = F.when(F.col("lang").isin(langs), F.col("lang")).otherwise(F.lit("")) if langs else F.lit("")
    sent = keyed(docs).where("length(text) > 0").select(lang.alias("lang"), "text", "key").mapInPandas(released(pack), ROW)
    salted = shards.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    parts = sent.join(salted, ["lang", "shard", "salt"]).select("docs", "model").mapInPandas(released(add), SUMS)
    return parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("tokens", "token_nats", "types", "type_nats")])


def limits(trusted: DataFrame, quantile: float, widen: float, slack: float, least: int) -> dict[tuple, tuple]:
    """The least and greatest nats that a token and a type may have, by language and size, from the trusted texts' (lang,
    size, by_token, by_type): the outer quantiles, moved away from the median by widen and slack. Where there are fewer
    than least, those of the language whatever the size count (size -1), and then how far all texts are from the median
    of their own language; '' stands for any language, with twice the room (size -2) for one with less than 5."""
    both, at_ = ("by_token", "by_type"), F.array(*map(F.lit, (quantile, 0.5, 1 - quantile)))
    spread = [F.percentile(F.round(c, 4), at_).alias(c) for c in both]
    sets = trusted.select(F.explode(F.array(F.struct("lang", "size"), F.struct("lang", F.lit(-1).alias("size")), F.struct(F.lit("").alias("lang"), F.lit(-1).alias("size")))).alias("set"), *both)
    # nine lengths a language at most
    rows = sets.groupBy("set").agg(F.count("*").alias("n"), *spread).collect()
    ends = lambda r, at, by=1: tuple(x for c in both for lo, mid, hi in [r[c]] for x in (at[c] + ((lo - mid) * widen - slack) * by, at[c] + ((hi - mid) * widen + slack) * by))
    middle = {r["set"].lang: {c: r[c][1] for c in both} for r in rows if r["set"].size == -1 and (r.n >= 5 or not r["set"].lang)}
    out = {(r["set"].lang, r["set"].size): ends(r, {c: r[c][1] for c in both}) for r in rows if r.n >= least or not r["set"].lang}
    # a language of which hardly anything is trusted may lie elsewhere: twice the room
    out |= {("", -2): ends(r, {c: r[c][1] for c in both}, 2) for r in rows if not r["set"].lang}
    if rows and any((lang, -1) not in out for lang in middle):
        own = trusted.sparkSession.createDataFrame([(lang, m["by_token"], m["by_type"]) for lang, m in middle.items() if lang], "lang string, m double, k double")
        away = trusted.join(F.broadcast(own), "lang").select((F.col("by_token") - F.col("m")).alias("by_token"), (F.col("by_type") - F.col("k")).alias("by_type")).agg(*spread).first()
        for lang, m in middle.items():
            if (lang, -1) not in out and away.by_token:
                out[lang, -1] = ends(away, {c: m[c] + away[c][1] for c in both})
    return out


def decided(docs: DataFrame, labels: DataFrame, quantile: float = 0.01, widen: float = 1.5, slack: float = 0.03, least: int = 50) -> DataFrame:
    """key, perplexity, type_perplexity, keep of each distinct (lang, text). The texts are cut in two by their hash, and all
    trusted texts of one half make the model that scores the other: every trusted text trains, every one says where the
    limits lie, and none is scored by a model that has seen it (unless a half has none: then all train one model)."""
    ids = pick(labels, "doc_id", "quality").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.count_if(F.col("quality").isNull()).alias("none")).where("q = 1 AND none = 0").select("doc_id", F.xxhash64("doc_id").alias("h"))
    ids = stored(ids, "trusted")
    rows, half = pick(docs, "doc_id", "lang", "text"), F.pmod(F.xxhash64("lang", "text"), F.lit(2))
    trusted_texts = rows.join(small(ids.select("doc_id")), "doc_id", "left_semi").where("lang <> ''").select("lang", "text", half.alias("half"))
    models = [model(trusted_texts.where(F.col("half") == k).select("lang", "text")) for k in (1, 0)]  # that score half 0 and 1
    if not all(langs for langs, _ in models):
        models = [model(trusted_texts.select("lang", "text"))] * 2
    langs = sorted({lang for own, _ in models for lang in own})
    named = [F.when(F.col("lang").isin(own), F.col("lang")).otherwise(F.lit("")) if own else F.lit("") for own, _ in models]
    own = F.when(half == 0, named[0]).otherwise(named[1])
    size = F.greatest(F.lit(5), F.least(F.lit(13), F.floor(F.log2(F.length("text"))))).cast("int")
    known = rows.where("length(text) > 0").select("doc_id", own.alias("lang"), size.alias("size"), F.xxhash64("lang", "text").alias("key"))
    if not langs:  # no trusted texts: nothing to hold a document against
        return known.select("key", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("type_perplexity"), F.lit(True).alias("keep")).distinct()
    every = [scores(rows.where(half == k).select("lang", "text"), *models[k]) for k in (0, 1)]
    said = stored(every[0].unionByName(every[1]).select("key", (F.col("token_nats") / F.col("tokens")).alias("by_token"), (F.col("type_nats") / F.col("types")).alias("by_type")), "nats")
    of = known.groupBy("key").agg(F.min("lang").alias("lang"), F.min("size").alias("size")).join(said, "key")
    trusted = known.join(small(ids.select("doc_id")), "doc_id", "left_semi").select("key", "lang", "size").join(said, "key")
    bounds = limits(trusted, quantile, widen, slack, least)
    if not bounds:
        return of.select("key", F.exp("by_token").alias("perplexity"), F.exp("by_type").alias("type_perplexity"), F.lit(True).alias("keep"))
    every = [(lang, s, *(bounds.get((lang, s)) or bounds.get((lang, -1)) or bounds["", -2])) for lang in [*langs, ""] for s in range(5, 14)]
    ends = docs.sparkSession.createDataFrame(every, "lang string, size int, a double, b double, c double, d double")
    keep = F.col("by_token").between(F.col("a"), F.col("b")) & F.col("by_type").between(F.col("c"), F.col("d"))
    return of.join(F.broadcast(ends), ["lang", "size"]).select("key", F.exp("by_token").alias("perplexity"), F.exp("by_type").alias("type_perplexity"), keep.alias("keep"))


def quality_classifier(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """doc_id, lang, perplexity, type_perplexity, keep; a row for each row. A text is kept if its perplexity, and that
    of its distinct trigrams, which texts that repeat themselves have too low, lie within the limits that trusted
    texts (all labels of the id are 1) of its language and length set. A null or empty text has no perplexity and isn't
    kept; a null language, or one without trusted texts, is scored by the model of all languages; without trusted texts
    all others are kept. Rows alike in language and text fare alike, whatever their ids; a null id is not trusted."""
    rows = pick(docs, "doc_id", "lang", "text").select("doc_id", "lang", F.xxhash64("lang", "text").alias("key"))
    out = rows.join(decided(docs, labels, **kw), "key", "left")
    return out.select("doc_id", "lang", "perplexity", "type_perplexity", F.coalesce("keep", F.lit(False)).alias("keep"))


def kept(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """The rows kept, decided by quality_classifier for each row's own language and text."""
    lost = small(stored(decided(docs, labels, **kw).where("NOT keep").select(F.col("key").alias("lost")), "rejected"))
    rows, text = plain(docs), at(docs, "text")
    rows = rows.where(f"length({text}) > 0").join(lost, F.xxhash64(at(docs, "lang"), text) == F.col("lost"), "left_anti")
    return rows.toDF(*docs.columns)
