"""Plain versions of the operators, without Spark, to hold the queries against."""

import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import regex

from lamplight.llm import decontaminate, license_scan, mixing, secrets, simhash


def groups(rows, radius=simhash.RADIUS, jaccard=simhash.JACCARD):
    """The group (least position) of each text, from all pairs."""
    sets = [set(simhash.hashes(t).tolist()) for t in rows]
    codes = [simhash.fingerprint(t) for t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and ((codes[i] ^ codes[j]) & (2**64 - 1)).bit_count() <= radius:
                both = len(sets[i] & sets[j])
                if both >= jaccard * (len(sets[i]) + len(sets[j]) - both):
                    a, b = sorted((top(i), top(j)))
                    root[b] = a
    return [top(i) for i in range(len(rows))]


def found_items(text, items, rate=0.05):
    """Every item compared with the whole text."""
    t = decontaminate.normalise(text or "")
    out = {}
    for item_id, item in items:
        item = decontaminate.normalise(item or "")
        if item and t:
            d, _ = decontaminate.myers(item, t)
            if d <= decontaminate.budget(item, rate):
                out[item_id] = d
    return out


def found_notices(text, rate=0.1):
    """The least edits of each notice, searched in the whole text without seeds."""
    x = license_scan.flat(license_scan.lowered(text or ""))
    out = {}
    for name, notice in license_scan.NOTICES.items():
        k = int(len(notice) * rate)
        if m := regex.search(f"(?b)(?:{regex.escape(notice)}){{e<={k}}}", x):
            out[name] = sum(m.fuzzy_counts)
    return out


def credentials(text, models):
    """All values behind keywords and runs after prefixes, looked for at every position."""
    low, found = secrets.lowered(text), []
    for i in range(len(text)):
        for word in (*secrets.KEYWORDS, *(p.lower() for p in models.prefixes)):
            if not low.startswith(word, i):
                continue
            if word in secrets.KEYWORDS and (x := secrets.assigned(text, i + len(word))):
                value, w = text[x[0] : x[1]], None
                for kind, (a, bound, chars, lo, hi, keyword) in models.kinds.items():
                    if keyword and lo <= len(value) <= hi and set(value) <= chars:
                        w = w or secrets.symbols(value, models.prefixes, x[2])
                        if a.score(w) >= bound and a.score(w) > models.none.score(w):
                            found.append((a.score(w), x[0], x[1], kind))
            for p in models.prefixes:
                if p.lower() == word and text.startswith(p, i) and not (i and text[i - 1] in secrets.MIXED):
                    for kind, (a, bound, chars, lo, hi, keyword) in models.kinds.items():
                        run = text[i : i + next((j for j in range(len(text) - i) if text[i + j] not in chars or j > hi), len(text) - i)]
                        while len(run) > lo and run[-1] in ".-_":
                            run = run[:-1]
                        if not keyword and lo <= len(run) <= hi and (s := a.score(secrets.symbols(run, models.prefixes))) >= bound:
                            found.append((s, i, i + len(run), kind))
    out = []
    for s, a, z, kind in sorted(set(found), key=lambda x: (-x[0], x[1:])):
        if all(z <= b or a >= y for b, y, *_ in out):
            out.append((a, z, kind, s))
    return sorted(out)


class KneserNey:
    """Interpolated modified Kneser-Ney over characters, by the formulas, from dictionaries."""

    def __init__(self, texts):
        self.c = {3: Counter(), 2: Counter(), 1: Counter()}
        for t in texts:
            x = [0, 0, *(ord(c) + 1 for c in t)]
            self.c[3].update(zip(x, x[1:], x[2:]))
        self.c[2].update(g[1:] for g in self.c[3])
        self.c[1].update(g[1:] for g in self.c[2])
        self.d, self.total, self.off = {}, defaultdict(float), defaultdict(float)
        for m, c in self.c.items():
            n = [max(1, sum(v == k for v in c.values())) for k in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            self.d[m] = [0.0, *(min(k - 1e-3, max(1e-3, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3))]
            for g, v in c.items():
                self.total[g[:-1], m] += v
                self.off[g[:-1], m] += self.d[m][min(v, 3)]

    def p(self, g):
        m = len(g)
        if not m:
            return 1 / 0x110001
        total = self.total.get((g[:-1], m), 0)
        if not total:
            return self.p(g[1:])
        v = self.c[m].get(g, 0)
        return (v - self.d[m][min(v, 3)]) / total + self.off[g[:-1], m] / total * self.p(g[1:])

    def nats(self, text):
        """Of a token and of a type, on average."""
        x = [0, 0, *(ord(c) + 1 for c in text)]
        grams = list(zip(x, x[1:], x[2:]))
        return -np.mean([math.log(self.p(g)) for g in grams]), -np.mean([math.log(self.p(g)) for g in set(grams)])


def mixed(docs: pd.DataFrame) -> pd.DataFrame:
    with duckdb.connect() as db:
        db.register("documents", docs)
        return db.sql(mixing.SQL).df()
