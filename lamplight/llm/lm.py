"""Operator 1: a log-bilinear model trained by noise-contrastive estimation, in numpy."""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from lamplight.llm.common import forget, pick, released, stored

D, NOISE, BATCH = 24, 32, 1024  # NOISE draws are shared by a step over BATCH tokens
TEXTS = 2500  # that are counted at a time
CHARS = 4_000_000  # of texts that are scored at a time
TABLE = 2048  # the largest vocabulary whose contexts' normalisers are all computed beforehand
TOGETHER = 64  # copies of the model that are averaged in one place
MODEL = "copy long, tokens long, model binary"
BITS, POINTS = 21, 0x110001  # of a character (0 ends a word, else code point + 1), and how many there are


def ids_of(text: str, index: dict[str, int]) -> np.ndarray:
    """Word ids: 0 begins a text, 1 is any word out of the vocabulary."""
    return np.array([0, 0] + [index.get(w, 1) for w in text.split()], np.int64)


def start(v: int, noise: np.ndarray, seed: int) -> list[np.ndarray]:
    r = np.random.default_rng(seed)
    return [r.normal(0, 0.1, (v, D)).astype(np.float32), r.normal(0, 0.1, (v, D)).astype(np.float32), np.tile(0.5 * np.eye(D, dtype=np.float32), (2, 1, 1)), np.log(noise).astype(np.float32)]


def shaped(flat: np.ndarray, v: int) -> list[np.ndarray]:
    """The parts of a model that was laid out flat."""
    out, at_ = [], 0
    for shape in ((v, D), (v, D), (2, D, D), (v,)):
        n = int(np.prod(shape))
        out.append(flat[at_ : at_ + n].reshape(shape))
        at_ += n
    return out


class Steps:
    """The model in training. Each parameter's steps shrink with the gradients it has had (Adagrad)."""

    def __init__(self, model: list[np.ndarray], rate: float):
        self.model, self.rate, self.past = model, rate, [np.full(m.shape, 1e-2, np.float32) for m in model]

    def take(self, part: int, gradient: np.ndarray, rows=slice(None)) -> None:
        """A step of these rows; the others' gradient is 0, which moves nothing."""
        past = self.past[part][rows] + gradient * gradient
        self.past[part][rows] = past
        self.model[part][rows] -= self.rate * gradient / np.sqrt(past, out=past)


def summed(rows: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the rows of x go, and the sum of those that go there."""
    some = np.bincount(rows) > 0
    u, at_ = np.flatnonzero(some), (np.cumsum(some) - 1)[rows]
    return u, np.bincount((at_[:, None] * x.shape[1] + np.arange(x.shape[1])).ravel(), x.ravel(), len(u) * x.shape[1]).reshape(len(u), -1).astype(np.float32)


def nce(steps: Steps, c1, c2, w, noise, cdf, rng) -> None:
    """One step over a batch: data against NOISE draws from the unigram distribution."""
    ctx, out, mats, bias = steps.model
    h1, h2 = ctx.take(c1, 0), ctx.take(c2, 0)
    q = h1 @ mats[0] + h2 @ mats[1]
    k = np.minimum(np.searchsorted(cdf, rng.random(NOISE)), len(noise) - 1)
    rw, rk = out.take(w, 0), out.take(k, 0)

    def sigmoid(s):  # in place
        np.clip(s, -30, 30, out=s)
        np.negative(s, out=s)
        np.exp(s, out=s)
        s += 1
        return np.divide(1, s, out=s)

    gw = (sigmoid(np.einsum("nd,nd->n", q, rw) + bias[w] - np.log(NOISE * noise[w])) - 1) / np.float32(len(w))
    gk = q @ rk.T
    gk += bias[k] - np.log(NOISE * noise[k])
    sigmoid(gk)
    gk /= np.float32(len(w))
    dq = gk @ rk
    dq += gw[:, None] * rw
    d1, d2 = dq @ mats[0].T, dq @ mats[1].T
    steps.take(2, np.stack([h1.T @ dq, h2.T @ dq]))
    # the bias goes with the row of its word
    own = np.empty((len(w) + NOISE, D + 1), np.float32)
    own[: len(w), :D], own[len(w) :, :D] = gw[:, None] * q, gk.T @ q
    own[: len(w), D], own[len(w) :, D] = gw, gk.sum(0)
    rows, g = summed(np.concatenate([w, k]), own)
    steps.take(1, g[:, :D], rows)
    steps.take(3, g[:, D], rows)
    rows, g = summed(np.concatenate([c1, c2]), np.concatenate([d1, d2]))
    steps.take(0, g, rows)


def trigrams(words: list[str]) -> np.ndarray:
    """The character trigrams of each word in turn, begun by two and ended by one 0."""
    u = np.frombuffer("".join(f"{w}\n" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.where(u == 10, 0, u + 1)
    one = np.concatenate([[0], c[:-1]])
    two = np.where(one == 0, 0, np.concatenate([[0], one[:-1]]))
    return (two << 2 * BITS) | (one << BITS) | c


class Spelling:
    """p of a word out of the vocabulary by its characters: Witten-Bell trigrams down to all code points alike."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, index: dict[str, int]):
        order = np.argsort(keys)
        self.keys, self.n, self.orders, self.taken = keys[order], n[order], [], 0.0
        for m in (1, 2, 3):
            k, back = np.unique(self.keys & ((1 << m * BITS) - 1), return_inverse=True)
            own = np.bincount(back, self.n, len(k))
            c, at = np.unique(k >> BITS, return_inverse=True)
            self.orders.append((k, own, c, np.bincount(at, own, len(c)), np.bincount(at, minlength=len(c)).astype(float)))
        self.log = np.log(self._p(self.keys))
        # the words of the vocabulary are never spelled: what they would get goes to the others
        self.taken = float(sum(np.exp(self.log_p([w], free=False)) for w in index))

    def _p(self, keys: np.ndarray) -> np.ndarray:
        def find(where, x):
            at = np.minimum(np.searchsorted(where, x), max(0, len(where) - 1))
            return at, where[at] == x if len(where) else np.zeros(len(x), bool)

        p = np.full(len(keys), 1 / POINTS)
        for m, (k, own, c, total, kinds) in enumerate(self.orders, 1):
            if len(k):
                x = keys & ((1 << m * BITS) - 1)
                (i, seen), (j, known) = find(k, x), find(c, x >> BITS)
                p = np.where(known, (np.where(seen, own[i], 0) + kinds[j] * p) / (total[j] + kinds[j]), p)
        return p

    def log_p(self, words: list[str], free: bool = True) -> float:
        """The sum over the words."""
        return float(self.each(words, free).sum())

    def each(self, words: list[str], free: bool = True) -> np.ndarray:
        if not words:
            return np.empty(0)
        x = trigrams(words)
        at = np.minimum(np.searchsorted(self.keys, x), max(0, len(self.keys) - 1))
        seen = self.keys[at] == x if len(self.keys) else np.zeros(len(x), bool)
        log = self.log[at] if len(self.keys) else np.empty(len(x))
        if not seen.all():
            log[~seen] = np.log(self._p(x[~seen]))
        ends = np.cumsum([len(w) + 1 for w in words])  # of each word's trigrams
        return np.add.reduceat(log, np.concatenate([[0], ends[:-1]])) - (np.log1p(-min(self.taken, 0.999)) if free else 0.0)


def normalisers(model, u: np.ndarray) -> np.ndarray:
    """Of the contexts u, numbered c1 * v + c2: the log of the sum of exp over the vocabulary."""
    ctx, out, mats, bias = model[:4]
    v, z = len(bias), np.empty(len(u), np.float32)
    for k in range(0, len(u), 1024):
        some = u[k : k + 1024]
        s = (ctx[some // v] @ mats[0] + ctx[some % v] @ mats[1]) @ out.T
        s += bias
        top = s.max(1)
        s -= top[:, None]
        z[k : k + 1024] = top + np.log(np.exp(s, out=s).sum(1))
    return z


def table_of(spark, model) -> np.ndarray | None:
    """The normalisers of all contexts, computed in the executors, if there aren't too many: then no token needs a sum
    over the vocabulary, however many there are."""
    v = len(model[3])
    if v > TABLE:
        return None
    sent = spark.sparkContext.broadcast(model[:4])

    def rows(batches):
        for b in batches:
            for c1 in b["id"]:
                yield pd.DataFrame({"c1": [c1], "z": [normalisers(sent.value, c1 * v + np.arange(v)).tobytes()]})

    got = spark.range(v, numPartitions=min(v, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(released(rows), "c1 long, z binary").collect()
    return np.concatenate([np.frombuffer(r.z, np.float32) for r in sorted(got)])


def log_probs(model, c1, c2, w, table: np.ndarray | None = None) -> np.ndarray:
    """Normalised log p of each token; without a table, matrix products over the distinct contexts give the normalisers."""
    ctx, out, mats, bias = model[:4]
    v = len(bias)
    if table is None:
        u, back = np.unique(c1 * v + c2, return_inverse=True)
        z = normalisers(model, u)[back]
    else:
        z = table[c1 * v + c2]
    one, two, lp = ctx @ mats[0], ctx @ mats[1], np.empty(len(w), np.float64)
    for k in range(0, len(w), 8192):
        i = slice(k, k + 8192)
        q = one.take(c1[i], 0)
        q += two.take(c2[i], 0)
        lp[i] = np.einsum("nd,nd->n", q, out.take(w[i], 0)) + bias[w[i]] - z[i]
    return lp


def train(docs: DataFrame, vocabulary: int = 1024, rounds: int = 3, copy_tokens: int = 4_000_000, seed: int = 0, rate: float = 0.2):
    """The index of the vocabulary and the model, trained on every token of every text. Words and characters are counted
    over all texts: a word out of the vocabulary is spelled, by the trigrams of all such words. The texts are cut by a
    hash into rounds, each of them into copies of about copy_tokens; in a round every copy starts from the model so far,
    takes its texts in the order of their hashes, and the copies are averaged by their tokens. So the model depends on
    the texts alone, not on how they are partitioned, and no step of it grows but the number of copies."""
    spark = docs.sparkSession
    texts = pick(docs, "text").where("length(text) > 0").select("text", F.xxhash64(F.lit(seed), "text").alias("h"))

    def count(batches):
        for b in batches:
            for k in range(0, len(b), TEXTS):
                n = Counter()
                for t in b.text.iloc[k : k + TEXTS]:
                    n.update(t.split())
                yield pd.DataFrame({"w": list(n), "n": list(n.values())})

    words = stored(texts.select("text").mapInPandas(released(count), "w string, n long").groupBy("w").agg(F.sum("n").alias("n")), "words")
    head = words.orderBy(F.desc("n"), "w").limit(vocabulary - 2).collect()
    every = words.agg(F.sum("n")).first()[0] or 0
    index = {r.w: i + 2 for i, r in enumerate(head)}
    n = np.array([0.5, max(0.5, every - sum(r.n for r in head)), *(r.n for r in head)])
    noise = (n / n.sum()).astype(np.float32)

    def spell(batches):
        for b in batches:
            own = [(w, k) for w, k in zip(b.w, b.n) if w not in index]
            if own:
                x = trigrams([w for w, _ in own])
                key, back = np.unique(x, return_inverse=True)
                weight = np.repeat(np.array([k for _, k in own], float), [len(w) + 1 for w, _ in own])
                yield pd.DataFrame({"key": key, "n": np.bincount(back, weight).astype(np.int64)})

    chars = words.mapInPandas(released(spell), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    spelling = Spelling(chars["key"].to_numpy(np.int64), chars["n"].to_numpy(float), index)
    forget(words)
    copies = max(1, -(-every // (rounds * copy_tokens)))

    def number(batches):
        for b in batches:
            yield pd.DataFrame({"round": b["round"], "copy": b["copy"], "h": b.h, "ids": [zstandard.compress(ids_of(t, index).astype(np.int32).tobytes(), 1) for t in b.text]})

    place = F.pmod(F.xxhash64(F.lit(1), "h"), F.lit(rounds * copies))
    numbered = stored(texts.select((place % rounds).cast("int").alias("round"), F.floor(place / rounds).alias("copy"), "h", "text").mapInPandas(released(number), "round int, copy long, h long, ids binary"), "numbered")
    flat = np.concatenate([m.ravel() for m in start(len(noise), noise, seed)]).astype(np.float32)
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(flat)

        def fit(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
            steps, rng, cdf = Steps(shaped(sent.value.copy(), len(noise)), rate), np.random.default_rng([seed, *map(int, key)]), np.cumsum(noise)
            own = b.sort_values(["h", "ids"]).ids
            x = np.concatenate([np.frombuffer(zstandard.decompress(t), np.int32) for t in own]).astype(np.int64)
            w = np.flatnonzero(x > 0)  # a text begins with two zeros
            for i in range(0, len(w), BATCH):
                at_ = w[i : i + BATCH]
                nce(steps, x[at_ - 1], x[at_ - 2], x[at_], noise, cdf, rng)
            return pd.DataFrame({"copy": [int(key[0])], "tokens": [len(w)], "model": [np.concatenate([m.ravel() for m in steps.model]).astype(np.float32).tobytes()]})

        fitted, left = numbered.where(F.col("round") == k).groupBy("copy").applyInPandas(fit, MODEL), copies
        while left > TOGETHER:  # averaged in the executors until few are left
            left = -(-left // TOGETHER)
            fitted = fitted.groupBy(F.floor(F.col("copy") / TOGETHER).alias("group")).applyInPandas(averaged, MODEL)
        rows = averaged((0,), fitted.toPandas())
        if rows.tokens[0]:
            flat = np.frombuffer(rows.model[0], np.float32)
    forget(numbered)
    return index, [*shaped(flat, len(noise)), spelling]


def averaged(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
    """One model of several, weighted by their tokens."""
    total, flat = 0, 0.0
    for n, raw in b.sort_values("copy")[["tokens", "model"]].itertuples(index=False):
        total += n
        flat = flat + n * np.frombuffer(raw, np.float32).astype(np.float64)
    return pd.DataFrame({"copy": [int(key[0])], "tokens": [total], "model": [(flat / total).astype(np.float32).tobytes() if total else b""]})


class Numbers(dict):
    """0, 1 and so on, in the order in which keys are asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def parts_of(b: pd.DataFrame):
    """The rows in parts of about CHARS characters, in order."""
    n = np.array([len(t or "") for t in b.text], np.int64)
    place = (np.cumsum(n) - n) // CHARS
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(b)]
    for i, j in zip(cuts, cuts[1:]):
        if i < j:
            yield b.iloc[i:j]


def score(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, perplexity, log_prob (the sum), tokens; a row for each row, null ids and repeated rows included. A text
    without words, or null, has 0 tokens and nulls; so has every text of a table without words. A token is a word, at
    white space of any kind; equal texts have equal scores, and whole texts are scored."""
    index, model = train(docs, **kw)
    spark, rows = docs.sparkSession, pick(docs, "doc_id", "text")
    sent = spark.sparkContext.broadcast((index, model, table_of(spark, model)))

    def each(batches):
        index, model, table = sent.value
        for b in (part for whole in batches for part in parts_of(whole)):
            # a batch's words have numbers, so each is looked up and spelled once
            words, own = [(t or "").split() for t in b.text], Numbers()
            n = np.array([len(t) for t in words], np.int64)
            k = np.fromiter(map(own.__getitem__, chain.from_iterable(words)), np.int64, n.sum())
            kinds = list(own)
            at_, said = np.array([index.get(w, 1) for w in kinds], np.int64), np.zeros(len(kinds))
            rare = np.flatnonzero(at_ == 1)
            said[rare] = model[4].each([kinds[i] for i in rare])
            w, begin = at_[k], (np.cumsum(n) - n)[n > 0]
            c1, c2 = (np.concatenate([np.zeros(m, np.int64), w])[: len(w)] for m in (1, 2))
            c1[begin] = c2[begin] = 0
            c2[(begin + 1)[n[n > 0] > 1]] = 0
            lp = log_probs(model, c1, c2, w, table) + said[k]
            s = np.where(n > 0, np.diff(np.concatenate([[0], np.cumsum(lp)])[np.concatenate([[0], np.cumsum(n)])]), np.nan)
            yield pd.DataFrame({"doc_id": b.doc_id.array, "perplexity": np.exp(np.minimum(-s / np.maximum(n, 1), 700)), "log_prob": s, "tokens": n})

    out = rows.mapInPandas(released(each), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, perplexity double, log_prob double, tokens long")
    return out.select("doc_id", *[F.when(F.col("tokens") > 0, F.col(c)).alias(c) for c in ("perplexity", "log_prob")], "tokens")
