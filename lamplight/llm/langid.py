"""Operator 8: n-gram Bloom filters with one bit slice a language."""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from lamplight.llm.common import pick

N, K, LOG = 4, 3, 21  # characters of an n-gram, hashes, log2 of the filter's rows


def rows_of(text: str) -> np.ndarray:
    """The K filter rows of each n-gram of the text in lower case, padded with spaces."""
    u = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(u) - N + 1
    if n <= 0:
        return np.empty((K, 0), np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(N):
        h = (h ^ u[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.stack([(h >> np.uint64(64 - LOG - i * 20)) & np.uint64((1 << LOG) - 1) for i in range(K)]).astype(np.int64)


def train(docs: DataFrame, per_language: int = 1000):
    """Languages and filter rows, each with a bitmask for every 64 languages. The slice of a language holds all n-grams
    of about per_language of its documents, picked by a hash of the text; of fewer it has all. Only packed slices, a
    quarter of a megabyte a language, come to the driver."""
    some = pick(docs, "lang", "text").where("lang IS NOT NULL AND length(text) > 0")
    counts = {r.lang: r["count"] for r in some.groupBy("lang").count().collect()}
    langs = sorted(counts)
    few = docs.sparkSession.createDataFrame([(lang, min(1.0, per_language / n)) for lang, n in counts.items()], "lang string, share double")
    picked = some.join(F.broadcast(few), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003.0 < F.col("share")).select("lang", "text")

    def bits(x: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(1 << LOG, bool)
        for rows in x:
            out[rows] = True
        return out

    def slices(batches):
        for b in batches:
            for lang, own in b.groupby("lang"):
                yield pd.DataFrame({"lang": [lang], "slice": [zstandard.compress(np.packbits(bits([rows_of(t) for t in own.text])).tobytes(), 1)]})

    def merge(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        both = np.zeros(1 << LOG >> 3, np.uint8)
        for x in b["slice"]:
            both |= np.frombuffer(zstandard.decompress(x), np.uint8)
        return pd.DataFrame({"lang": [key[0]], "slice": [zstandard.compress(both.tobytes(), 1)]})

    table, at_ = np.zeros((-(-len(langs) // 64), 1 << LOG), np.uint64), {lang: i for i, lang in enumerate(langs)}
    for r in picked.mapInPandas(slices, "lang string, slice binary").groupBy("lang").applyInPandas(merge, "lang string, slice binary").toLocalIterator():
        own = np.unpackbits(np.frombuffer(zstandard.decompress(bytes(r["slice"])), np.uint8)).astype(np.uint64)
        table[at_[r.lang] // 64] |= own << np.uint64(at_[r.lang] % 64)
    return langs, table


def identify(docs: DataFrame, per_language: int = 1000) -> DataFrame:
    """doc_id, lang, predicted, share, keep; a row for each row, null ids and repeated rows included. Each language's
    hits are corrected for its slice's false positives; the largest share of the n-grams decides, ties go to the first
    name. Null, empty and blank texts have no prediction, nor has any text of a table that declares no language; keep
    tells that the prediction is the declared language, or that no language is declared."""
    langs, table = train(docs, per_language)
    sent, rows = docs.sparkSession.sparkContext.broadcast(table), pick(docs, "doc_id", "text", "lang")

    def each(batches):
        t = sent.value
        fp = np.array([float(((t[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) ** K for i in range(len(langs))])
        for b in batches:
            who, share = [], []
            for text in b.text:
                x = rows_of(text) if text and not text.isspace() else np.empty((K, 0), np.int64)
                if not x.shape[1] or not langs:
                    who.append(None)
                    share.append(None)
                    continue
                hits = np.empty(len(langs))
                for plane in range(len(t)):
                    masks = t[plane, x[0]] & t[plane, x[1]] & t[plane, x[2]]
                    for i in range(64 * plane, min(len(langs), 64 * plane + 64)):
                        hits[i] = np.count_nonzero(masks & np.uint64(1 << i % 64))
                s = (hits / x.shape[1] - fp) / np.maximum(1 - fp, 1e-9)
                k = int(np.argmax(s))
                who.append(langs[k] if s[k] > 0 else None)
                share.append(float(s[k]))
            yield pd.DataFrame({"doc_id": b.doc_id, "lang": b.lang, "predicted": pd.Series(who, dtype=object), "share": pd.Series(share, dtype="float64")})

    out = rows.mapInPandas(each, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang string, predicted string, share double")
    return out.withColumn("keep", F.coalesce(F.col("predicted") == F.col("lang"), F.col("lang").isNull() & F.col("predicted").isNotNull()))
