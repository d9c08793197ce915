"""Operator 4: SimHash of word pairs, searched in BK-trees by shard."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from lamplight.llm.common import at, forget, pick, plain, released, shared_dir, small, stored

RADIUS, BANDS = 12, 5
JACCARD = 0.6  # of two texts' sets of word pairs, for a pair of codes to count
SHARD = 2_000_000  # codes in a broadcast
EDGES = 2_000_000  # whose components one task finds
TILE = 1 << 16  # codes compared at a time: as many as stay in a core's cache


def hashes(text: str | None) -> np.ndarray:
    """One hash a word pair, none without words."""
    w = text.lower().split() if text else []
    return np.array([xxhash.xxh3_64_intdigest(f"{a} {b}") for a, b in zip(w, w[1:] or [""])] if w else [], np.uint64)


def signs(h: np.ndarray) -> int | None:
    n = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        n += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * n > len(h)).view(np.int64)[0]) if len(h) else None


def fingerprint(text: str | None) -> int | None:
    """64 signs summed over the text's word pairs; None without words."""
    return signs(hashes(text))


def sketch(pairs_: np.ndarray) -> bytes:
    """A bit for each value of the last bits of a set's hashes, two to four times as many as the set has, 8 at least."""
    m = max(8, 1 << int(2 * len(pairs_) - 1).bit_length())
    x = np.zeros(m, bool)
    x[(pairs_ & np.uint64(m - 1)).astype(np.int64)] = True
    return np.packbits(x).tobytes()


def shared(x: bytes, size_x: int, y: bytes, size_y: int) -> int:
    """How many hashes two sets of these sketches and sizes share at most: a bit that only one has is of a hash that the
    other lacks."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    m = min(len(p), len(q))
    p, q = (np.bitwise_or.reduce(v.reshape(-1, m)) for v in (p, q))
    return min(size_x - int(np.bitwise_count(p & ~q).sum()), size_y - int(np.bitwise_count(q & ~p).sum()))


def codes(docs: DataFrame) -> DataFrame:
    """doc_id, h, code, node, size and bits (a sketch), the last three of the set of word pairs, of doc_id, text, h."""

    def each(batches):
        for b in batches:
            x = [hashes(t) for t in b.text]
            sets = [np.unique(h) if len(h) else None for h in x]
            node = [None if s is None else xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets]
            node = [n if n is None or n < 1 << 63 else n - (1 << 64) for n in node]
            out = pd.DataFrame({"doc_id": b.doc_id, "h": b.h, "code": pd.array([signs(h) for h in x], dtype="Int64"), "node": pd.array(node, dtype="Int64")})
            yield out.assign(size=pd.array([None if s is None else len(s) for s in sets], dtype="Int64"), bits=[None if s is None else sketch(s) for s in sets])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(released(each), f"doc_id {kind}, h long, code long, node long, size long, bits binary")


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent."""

    def __init__(self):
        self.root = self.flat = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        at = self.root
        while True:
            d = (at[0] ^ x).bit_count()
            if d == 0:
                return
            if d not in at[1]:
                at[1][d] = (x, {})
                return
            at = at[1][d]

    def near(self, xs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(position in xs, code of the tree) of all within the radius; only edges it allows are followed, those of all
        of xs at once."""
        if self.flat is None:
            nodes, edge, first = [self.root], [0], []
            for _, below in nodes:  # nodes grows meanwhile
                first.append(len(nodes))
                nodes += below.values()
                edge += below.keys()
            self.flat = np.array([x for x, _ in nodes], np.uint64), np.array(edge), np.array([*first, len(nodes)])
        code, edge, first = self.flat
        who, found = [], []
        for k in range(0, len(xs), 512):
            q, at_ = np.arange(k, min(k + 512, len(xs))), np.zeros(min(512, len(xs) - k), np.int64)
            while len(q):
                d = np.bitwise_count(xs[q] ^ code[at_]).astype(np.int64)
                who.append(q[d <= radius])
                found.append(code[at_[d <= radius]])
                n = first[at_ + 1] - first[at_]
                child = np.arange(n.sum()) + np.repeat(first[at_] - np.cumsum(n) + n, n)
                ok = np.abs(edge[child] - np.repeat(d, n)) <= radius
                q, at_ = np.repeat(q, n)[ok], child[ok]
        return (np.concatenate(who), np.concatenate(found)) if who else (np.empty(0, np.int64), np.empty(0, np.uint64))


def bands(radius: int) -> list[tuple[int, int]]:
    """(shift, bits) of five bands of a code. Two codes within the radius are within a fifth of it in one of them."""
    cut = [64 * i // BANDS for i in range(BANDS + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def values(x: np.ndarray, band: int, radius: int) -> np.ndarray:
    shift, bits = bands(radius)[band]
    return (x >> np.uint64(shift)) & np.uint64((1 << bits) - 1)


class ShardTree:
    """Codes by band: a BK-tree of the values that a band has here, and under each value the codes with it. A band has
    8192 values at most, so the trees don't grow with the data."""

    def __init__(self, codes_: np.ndarray, radius: int):
        self.radius, self.bands, self.trees = radius, [], []
        for k in range(BANDS):
            v = values(codes_, k, radius)
            order = np.argsort(v, kind="stable")
            kinds, begin = np.unique(v[order], return_index=True)
            tree = BKTree()
            for x in np.random.default_rng(k).permutation(kinds).tolist():
                tree.add(x)
            self.trees.append(tree)
            self.bands.append((codes_[order], {x: (a, z) for x, a, z in zip(kinds.tolist(), begin.tolist(), [*begin[1:].tolist(), len(v)])}))

    def search(self, band: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (of q, of the codes here) within the radius whose first near band is this one; q has the order of its
        values. Only values from its own on are searched: a pair is found from its lesser value, or if equal, code."""
        own, where = self.bands[band]
        kinds, begin = np.unique(values(q, band, self.radius), return_index=True)
        who, near = self.trees[band].near(kinds, self.radius // BANDS)
        who, near = (x[near >= kinds[who]] for x in (who, near))
        order = np.argsort(who, kind="stable")
        cut, near, left, right = np.searchsorted(who[order], np.arange(len(kinds) + 1)), near[order].tolist(), [q[:0]], [q[:0]]
        for t, (a, z) in enumerate(zip(begin.tolist(), [*begin[1:].tolist(), len(q)])):
            if cut[t] == cut[t + 1]:
                continue
            c = np.concatenate([own[slice(*where[x])] for x in near[cut[t] : cut[t + 1]]])
            step = max(1, TILE // len(c))
            for k in range(a, z, step):
                some = q[k : min(z, k + step)]
                hit = np.flatnonzero(np.bitwise_count(some[:, None] ^ c[None, :]) <= self.radius)
                left.append(some[hit // len(c)])
                right.append(c[hit % len(c)])
        a, b = np.concatenate(left), np.concatenate(right)
        ok = (values(a, band, self.radius) < values(b, band, self.radius)) | (a < b)
        for k in range(band):
            ok &= np.bitwise_count(values(a, k, self.radius) ^ values(b, k, self.radius)) > self.radius // BANDS
        return a[ok], b[ok]


def gathered(codes_: DataFrame) -> np.ndarray:
    """The codes, in order. They come to the driver as bytes, 8 each: rows would be objects of many times that size."""

    def pack(batches):
        for b in batches:
            yield pd.DataFrame({"codes": [b["code"].to_numpy(np.int64).tobytes()]})

    got = [np.frombuffer(r.codes, np.uint64) for r in codes_.select("code").mapInPandas(pack, "codes binary").toLocalIterator()]
    return np.sort(np.concatenate(got)) if got else np.empty(0, np.uint64)


def pairs(distinct: DataFrame, radius: int = RADIUS, shard: int | None = None) -> DataFrame:
    """a < b: all pairs of distinct codes within the radius, stored. The codes are cut by hash into as many shards as hold
    about shard codes each; each shard's trees are built from a broadcast of its codes, 8 bytes each, and every code is
    looked up in every shard, of which the driver holds one at a time. Nothing is left out at any size."""
    spark, n = distinct.sparkSession, distinct.count()
    parts = max(1, -(-n // (shard or SHARD)))
    at_ = [F.shiftrightunsigned("code", a).bitwiseAND(F.lit((1 << b) - 1)) for a, b in bands(radius)]
    rows = distinct.select("code", F.posexplode(F.array(*at_)).alias("band", "value"))
    ordered = rows.repartition("band", "value").sortWithinPartitions("band", "value", "code")
    if parts > 1:
        ordered = stored(ordered, "looked-up")  # every shard reads it again
    near = f"{shared_dir(spark)}/near-{uuid.uuid4().hex}"
    for k in range(parts):
        sent = spark.sparkContext.broadcast(gathered(distinct.where(F.pmod(F.xxhash64("code"), F.lit(parts)) == k)))

        def search(batches, sent=sent):
            tree = None
            for b in batches:
                tree = tree or ShardTree(sent.value, radius)
                code, band = b["code"].to_numpy(np.int64).view(np.uint64), b["band"].to_numpy()
                found = [tree.search(int(k), code[band == k]) for k in np.unique(band)]
                x, y = (np.concatenate([f[i] for f in found]).view(np.int64) if found else np.empty(0, np.int64) for i in (0, 1))
                yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

        ordered.mapInPandas(released(search), "a long, b long").write.mode("append").parquet(near)
        sent.destroy()
    if parts > 1:
        forget(ordered)
    return spark.read.parquet(near)


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, the least code that paths reach) of all codes that have a lesser one."""
    ids, at_ = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, label = at_[: len(u)], at_[len(u) :], np.arange(len(ids))
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            break
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (up := label[label])).any():
            label = up
    less = label < np.arange(len(ids))
    return ids[less], ids[label[less]]


def components(edges: DataFrame) -> DataFrame:
    """code, root: the least code that paths reach. Up to EDGES of them are joined in one task; more by large-star and
    small-star steps in turn, each stored."""
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    if e.count() <= EDGES:

        def join(batches):
            x = [(b.u.to_numpy(np.int64), b.v.to_numpy(np.int64)) for b in batches]
            code, root = joined(*(np.concatenate(y) for y in zip(*x))) if x else (np.empty(0, np.int64),) * 2
            for k in range(0, len(code), 100_000):
                yield pd.DataFrame({"code": code[k : k + 100_000], "root": root[k : k + 100_000]})

        return e.coalesce(1).mapInPandas(released(join), "code long, root long")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        new = stored(star, "edges")
        forget(e)
        # the same edges as before: two sums over two hashes of each tell
        now = new.agg(F.count("*"), *[F.sum(F.xxhash64(F.lit(k), "u", "v").cast("decimal(38,0)")) for k in (0, 1)]).first()
        if now == seen:
            return new.select(F.col("u").alias("code"), F.col("v").alias("root"))
        e, seen = new, now


def possible(candidates: DataFrame, sketches: DataFrame, jaccard: float) -> DataFrame:
    """Those of the node pairs a, b whose sketches (node, size, bits) don't rule out the Jaccard similarity: all that have
    it, and few others."""

    def check(batches):
        for b in batches:
            ok = []
            for x, y, n, m in zip(b.x, b.y, b.size_x, b.size_y):
                both = shared(x, n, y, m) if min(n, m) >= jaccard * max(n, m) else 0
                ok.append(both >= jaccard * (n + m - both))
            yield b.loc[ok, ["a", "b"]]

    x, y = (sketches.select(F.col("node").alias(k), F.col("bits").alias(v), F.col("size").alias(f"size_{v}")) for k, v in (("a", "x"), ("b", "y")))
    return candidates.join(x, "a").join(y, "b").select("a", "b", "x", "y", "size_x", "size_y").mapInPandas(released(check), "a long, b long")


def verified(candidates: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """Those of the node pairs a, b whose sets of word pairs have the Jaccard similarity."""

    def check(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.x, b.y):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = 0
                if min(len(x), len(y)) >= jaccard * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= jaccard * (len(x) + len(y) - both))
            yield b.loc[ok, ["a", "b"]]

    x, y = (sets.select(F.col("node").alias(k), F.col("pairs").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return candidates.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(released(check), "a long, b long")


def linked(docs: DataFrame, sketches: DataFrame, nodes: DataFrame, near: DataFrame, jaccard: float) -> DataFrame:
    """node, root over the verified pairs among nodes (code, node, h) whose codes are the same or near. docs has text and
    h, sketches node, size and bits. Pairs that are linked by others needn't be compared: first each node is compared with
    the least node of its code, and that one with those of the least and of the nearest code near it; then all pairs that
    this left apart. Sketches, of a thirtieth to a sixteenth of the sets' bytes, are compared before sets are."""
    codes_ = nodes.groupBy("code").agg(F.min("node").alias("least"), F.count("*").alias("n"))
    busy = near.select(F.explode(F.array("a", "b")).alias("code")).unionByName(codes_.where("n > 1").select("code")).distinct()
    some = stored(nodes.join(busy, "code", "left_semi"), "nodes")

    def pairs_of(batches):
        for b in batches:
            yield pd.DataFrame({"node": b.node, "pairs": [np.unique(hashes(t)).tobytes() for t in b.text]})

    bits = stored(sketches.join(small(some.select("node").distinct()), "node", "left_semi").dropDuplicates(["node"]), "bits")

    def similar(candidates):
        likely = stored(possible(candidates, bits, jaccard), "likely")
        # only texts that have a likely partner are read for their word pairs; their one shuffle serves both sides
        own = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        first = some.join(own, "node", "left_semi").groupBy("node").agg(F.min("h").alias("h"))
        texts = docs.join(small(first), "h").select("node", "text")
        sets = texts.mapInPandas(released(pairs_of), "node long, pairs binary").dropDuplicates(["node"])
        out = stored(verified(likely, sets, jaccard), "edges")
        forget(likely)
        return out

    def ordered(x: DataFrame) -> DataFrame:
        return x.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()

    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    partners = both.groupBy(F.col("a").alias("code")).agg(F.min("b").alias("p"), F.min_by("b", F.struct(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))), "b")).alias("q"))
    partners = partners.select("code", F.explode(F.array_distinct(F.array("p", "q"))).alias("other"))
    least = codes_.select("code", "least")
    stars = some.join(least, "code").select(F.col("node").alias("x"), F.col("least").alias("y"))
    across = partners.join(least.withColumnRenamed("least", "x"), "code").join(least.select(F.col("code").alias("other"), F.col("least").alias("y")), "other").select("x", "y")
    found = similar(ordered(stars.unionByName(across)))
    roots = stored(components(found), "roots")
    at_ = stored(some.join(roots.withColumnRenamed("code", "node"), "node", "left").select("code", "node", F.coalesce("root", "node").alias("root")), "at")
    span = at_.groupBy("code").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    left, right = (span.select(F.col("code").alias(k), F.col("lo").alias(f"lo_{k}"), F.col("hi").alias(f"hi_{k}")) for k in "ab")
    apart = near.join(left, "a").join(right, "b").where("least(lo_a, lo_b) < greatest(hi_a, hi_b)").select("a", "b")
    apart = apart.unionByName(span.where("lo < hi").select(F.col("code").alias("a"), F.col("code").alias("b")))
    left, right = (at_.select(F.col("code").alias(k), F.col("node").alias(n), F.col("root").alias(f"root_{k}")) for k, n in (("a", "x"), ("b", "y")))
    rest = ordered(apart.join(left, "a").join(right, "b").where("root_a <> root_b"))
    more = similar(rest)
    if not more.isEmpty():
        roots = stored(components(more.unionByName(roots.select(F.col("code").alias("a"), F.col("root").alias("b")))), "roots")
    forget(some, bits, found, more, at_)
    return roots.withColumnRenamed("code", "node")


def grouped(docs: DataFrame, radius: int, jaccard: float) -> DataFrame:
    """doc_id, h (of the text), n (rows alike in both), group_id, first: whether the group's first document is it."""
    rows = pick(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("h"))
    coded = stored(codes(rows), "codes")
    own = coded.groupBy("doc_id", "h").agg(F.min("code").alias("code"), F.min("node").alias("node"), F.count("*").alias("n"))
    nodes = stored(coded.where("code IS NOT NULL").groupBy("code", "node").agg(F.min("h").alias("h")), "nodes")
    near = pairs(nodes.select("code").distinct(), radius)
    sketches = coded.where("node IS NOT NULL").select("node", "size", "bits")
    roots = linked(rows.select("text", "h"), sketches, nodes, near, jaccard)
    at_ = own.where("code IS NOT NULL").join(roots, "node", "left").select("doc_id", "h", "n", F.coalesce("root", "node").alias("root"))
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("lead")
    out = at_.join(at_.groupBy("root").agg(lead), "root")
    out = out.select("doc_id", "h", "n", F.col("lead.doc_id").alias("group_id"), (F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("h") == F.col("lead.h"))).alias("first"), F.lit(True).alias("words"))
    alone = own.where("code IS NULL").select("doc_id", "h", "n", F.col("doc_id").alias("group_id"), F.lit(True).alias("first"), F.lit(False).alias("words"))
    return stored(out.unionByName(alone), "groups")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, jaccard: float = JACCARD) -> DataFrame:
    """doc_id, group_id (the least doc_id of its group, null if none has one), keep; a row for each row. Groups are
    joined by pairs whose codes are within the radius and whose sets of word pairs have the Jaccard similarity. Of each
    group, one row is kept: that with the least doc_id, nulls last, and of rows with one doc_id, that with the least
    hash of its text. Rows without words, null and empty texts included, are no duplicates of anything and stay."""
    own = grouped(docs, radius, jaccard).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return own.select("doc_id", "group_id", (F.col("first") & ((F.col("copy") == 1) | ~F.col("words"))).alias("keep"))


def kept(docs: DataFrame, radius: int = RADIUS, jaccard: float = JACCARD) -> DataFrame:
    """The rows that near_duplicates keeps. The texts of other rows aren't moved where the list of the dropped is short
    enough to be sent to the executors."""
    own = grouped(docs, radius, jaccard)
    key = F.xxhash64("doc_id", "h", F.col("doc_id").isNull()).alias("lost")
    rows, doc_id, text = plain(docs), at(docs, "doc_id"), at(docs, "text")
    rows = rows.withColumn("lost", F.xxhash64(doc_id, F.xxhash64(text), F.col(doc_id).isNull()))
    out = rows.join(small(own.where("NOT first").select(key)), "lost", "left_anti")
    many = own.where("first AND words AND n > 1").select(key)
    if not many.isEmpty():  # rows alike in id and text: one of them stays
        many = small(many)
        out = out.join(many, "lost", "left_anti").unionByName(out.join(many, "lost", "left_semi").dropDuplicates(["lost"]))
    return out.drop("lost").toDF(*docs.columns)
