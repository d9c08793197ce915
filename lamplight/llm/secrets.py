"""Operator 6: probabilistic automata learnt from labelled credentials score candidates."""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lamplight.llm.common import at, pick, plain

KEYWORDS = ("password", "passwd", "passphrase", "pwd", "secret", "secret_key", "secretkey", "token", "api_key", "apikey", "api-key", "access_key", "accesskey", "private_key", "auth_key", "credential", "credentials")
ASSIGNED = re.compile(r"[A-Za-z_\-]{0,16}[\"']?(\s{0,2})(=>|:=|[=:])(\s{0,2})([\"'`]?)([^\s\"'`<>(){}\[\],;]{6,256})")
UP, LOW, DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
HEX, MIXED, MARKS = "0123456789abcdef", UP + LOW + DIGITS, "!@#$%^&*-_+=?.~/:|"
WORDS = "the and for that with this from have not are was you your must should never reset change required invalid expired missing value field please enter here below next login user account policy string empty none null true false unknown optional example forgotten".split()


def labelled(n: int = 500, seed: int = 0) -> dict[str, list[tuple[str, bool]]]:
    """n credentials of each publicly known format, seeded: (text, whether it is written behind a keyword)."""
    r = random.Random(seed)
    some = lambda chars, k: "".join(r.choices(chars, k=k))
    near = lambda a, b, chars: some(chars, r.randint(a, b))
    url = MIXED + "-_"

    def behind(make):
        keyword = ["{}={}", "{} = {}", "{}: {}", '{} = "{}"', '{}="{}"', "{}='{}'", '{}": "{}"', "{}:{}"]
        return [(r.choice(keyword).format("K", make()), True) for _ in range(n)]

    bare = {
        "access_key": lambda: r.choice(["AKIA", "ASIA"]) + some(UP + DIGITS, 16),
        "forge_token": lambda: r.choice(["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]) + some(MIXED, 36),
        "forge_fine_token": lambda: "github_pat_" + some(MIXED, 22) + "_" + some(MIXED, 59),
        "lab_token": lambda: "glpat-" + some(url, 20),
        "payment_key": lambda: r.choice(["sk_live_", "sk_test_", "rk_live_", "pk_live_"]) + near(24, 34, MIXED),
        "chat_token": lambda: r.choice(["xoxb-", "xoxp-", "xoxa-"]) + some(DIGITS, r.randint(10, 13)) + "-" + some(DIGITS, r.randint(10, 13)) + "-" + some(MIXED, r.randint(24, 34)),
        "cloud_key": lambda: "AIza" + some(url, 35),
        "web_token": lambda: "eyJ" + near(15, 60, url) + ".eyJ" + near(20, 160, url) + "." + near(40, 60, url),
        "mail_key": lambda: "SG." + some(url, 22) + "." + some(url, 43),
        "package_token": lambda: "npm_" + some(MIXED, 36),
        "hub_token": lambda: "hf_" + some(UP + LOW, 34),
    }
    out = {kind: [(make(), False) for _ in range(n)] for kind, make in bare.items()}
    out["hex_token"] = behind(lambda: some(HEX, r.choice([24, 32, 40, 48, 64])))
    out["base64_secret"] = behind(lambda: some(MIXED + "/+", r.choice([32, 40, 43, 44, 64])) + r.choice(["", "", "=", "=="]))
    out["password"] = behind(lambda: near(8, 24, r.choice([HEX, UP + LOW, LOW + DIGITS, MIXED, MIXED + MARKS, MIXED + MARKS])))
    return out


def unlabelled(n: int = 2000, seed: int = 0) -> list[str]:
    """What stands behind the keywords in prose and settings without being a credential: the negatives."""
    r = random.Random(seed)
    word = lambda: r.choice([str.lower, str.lower, str.lower, str.title, str.upper])(r.choice(WORDS))
    make = [word, word, word, lambda: word() + r.choice([".", "!", "-", "_"]) + word(), lambda: "$" + word().upper() + "_" + word().upper(), lambda: "*" * r.randint(6, 12), lambda: "x" * r.randint(6, 12), lambda: str(r.randint(0, 10**6))]
    return [r.choice(["{}: {}", "{}: {}", "{}: {}", "{}:{}", "{} = {}", "{}={}"]).format("K", r.choice(make)()) for _ in range(n)]


def kind_of(c: str) -> str:
    return "d" if c in DIGITS else "x" if c in "abcdef" else "l" if c in LOW else "u" if c in UP else "s" if c in MARKS else c


def symbols(value: str, prefixes: tuple[str, ...], before: tuple[str, ...] = ()) -> list[str]:
    """A prefix that the labelled credentials have stays as it is; what follows is generalised to kinds of characters.
    before: what was read of a keyword."""
    head = max((p for p in prefixes if value.startswith(p)), key=len, default="")
    return [*before, *(f"={c}" for c in head), *map(kind_of, value[len(head) :]), "$"]


def assigned(text: str, start: int) -> tuple[int, int, tuple[str, ...]] | None:
    """(start, end) of the value that the keyword ending before start is given, and how it is written."""
    if not (m := ASSIGNED.match(text, start)):
        return None
    end = m.end(5)
    while end > m.start(5) and text[end - 1] in ".:" and not m[4]:  # ends the sentence
        end -= 1
    return (m.start(5), end, ("K", "_" if m[1] else "", m[2][-1:], "_" if m[3] else "", "q" if m[4] else "")) if end - m.start(5) >= 6 else None


def shared(words: list[str], least: float = 0.05) -> list[str]:
    """The prefixes of three or more characters that at least this share of the words begin with, as long as they get."""
    out, todo = [], [""]
    while todo:
        p = todo.pop()
        n = Counter(w[len(p)] for w in words if w.startswith(p) and len(w) > len(p))
        more = [p + c for c, k in n.items() if k >= least * len(words) and k >= 0.12 * sum(n.values())]
        if more:
            todo += more
        elif len(p) >= 3:
            out.append(p)
    return out


class Automaton:
    """ALERGIA: prefix-tree states merge where Hoeffding's bound doesn't tell them apart."""

    def __init__(self, words: list[list[str]], alpha: float = 0.01):
        self.n, self.next, self.bound = [0], [{}], math.sqrt(0.5 * math.log(2 / alpha))
        for w in words:
            at = 0
            self.n[0] += 1
            for c in w:
                if c not in self.next[at]:
                    self.next.append({})
                    self.n.append(0)
                    self.next[at][c] = [len(self.n) - 1, 0]
                edge = self.next[at][c]
                edge[1] += 1
                at = edge[0]
                self.n[at] += 1
        red, blue = [0], [e[0] for e in self.next[0].values()]
        while blue:
            q = blue.pop(0)
            for p in red:
                if self._alike(p, q):
                    for s in red:
                        for e in self.next[s].values():
                            if e[0] == q:
                                e[0] = p
                    self._fold(p, q)
                    break
            else:
                red.append(q)
            known = set(red)
            blue = sorted({e[0] for s in red for e in self.next[s].values()} - known)
        # only states that are left are kept
        at_ = {q: i for i, q in enumerate(red)}
        self.n, self.next = [self.n[q] for q in red], [{c: [at_[e[0]], e[1]] for c, e in self.next[q].items()} for q in red]

    def _alike(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            na, nb = self.n[a], self.n[b]
            if not na or not nb or a == b:
                continue
            far = self.bound * (na**-0.5 + nb**-0.5)
            for c in {*self.next[a], *self.next[b]}:
                x, y = self.next[a].get(c), self.next[b].get(c)
                if abs((x[1] if x else 0) / na - (y[1] if y else 0) / nb) > far:
                    return False
                if x and y and nb > 20 and na > 20:
                    todo.append((x[0], y[0]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """q is the root of a tree: its counts go to p and below."""
        todo = [(p, q)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            self.n[a] += self.n[b]
            for c, (to, k) in self.next[b].items():
                if c in self.next[a]:
                    self.next[a][c][1] += k
                    todo.append((self.next[a][c][0], to))
                else:
                    self.next[a][c] = [to, k]

    def score(self, w: list[str], floor: float = 1e-4) -> float:
        """Mean log likelihood of a symbol; what no edge takes costs the floor and ends the walk."""
        at, total = 0, 0.0
        for i, c in enumerate(w):
            e = self.next[at].get(c)
            if not e:
                return (total + (len(w) - i) * math.log(floor)) / len(w)
            total += math.log(e[1] / self.n[at])
            at = e[0]
        return total / len(w)


class Models:
    """All that is learnt: of each kind its automaton, the least score, its alphabet and lengths; the prefixes; and the
    automaton of what stands behind keywords without being a credential."""

    def __init__(self, n: int = 500, seed: int = 0, slack: float = 0.1):
        train, held = labelled(n, seed), labelled(n, seed + 1)
        self.prefixes = tuple(p for words in train.values() for p in shared([w for w, keyword in words if not keyword]))
        self.kinds = {}
        for kind, words in train.items():
            cut = [self._cut(w, keyword) for w, keyword in words]
            a = Automaton([symbols(v, self.prefixes, k) for v, k in cut])
            fits = sorted(a.score(symbols(v, self.prefixes, k)) for v, k in (self._cut(*w) for w in held[kind]))
            length = [len(v) for v, _ in cut]
            self.kinds[kind] = (a, fits[n // 200] - slack, {c for v, _ in cut for c in v}, min(length), max(length), words[0][1])
        self.none = Automaton([symbols(v, self.prefixes, k) for v, k in (self._cut(w, True) for w in unlabelled(seed=seed)) if v])
        self.hits = ahocorasick.Automaton()
        for p in self.prefixes:
            self.hits.add_word(p.lower(), (len(p), p))
        for k in KEYWORDS:
            self.hits.add_word(k, (len(k), None))
        self.hits.make_automaton()

    @staticmethod
    def _cut(word: str, keyword: bool) -> tuple[str, tuple[str, ...]]:
        found = assigned(word, 1) if keyword else (0, len(word), ())
        return (word[found[0] : found[1]], found[2]) if found else ("", ())

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, kind, score) of the credentials, of those that overlap the likeliest."""
        low, found = lowered(text), []
        for end, (n, prefix) in self.hits.iter(low):
            start = end + 1 - n
            if prefix is None:
                if not (x := assigned(text, end + 1)):
                    continue
                a, z, before = x
                value = text[a:z]
                w = symbols(value, self.prefixes, before)
                least = self.none.score(w)
                for kind, (model, bound, chars, lo, hi, keyword) in self.kinds.items():
                    if keyword and lo <= len(value) <= hi and chars.issuperset(value) and (s := model.score(w)) >= bound and s > least:
                        found.append((s, a, z, kind))
            elif text.startswith(prefix, start) and not (start and text[start - 1] in MIXED):
                for kind, (model, bound, chars, lo, hi, keyword) in self.kinds.items():
                    if keyword:
                        continue
                    z = start
                    while z < len(text) and z - start <= hi and text[z] in chars:
                        z += 1
                    while z - start > lo and text[z - 1] in ".-_":
                        z -= 1
                    if lo <= z - start <= hi and (s := model.score(symbols(text[start:z], self.prefixes))) >= bound:
                        found.append((s, start, z, kind))
        out: list[tuple[int, int, str, float]] = []
        for s, a, z, kind in sorted(found, key=lambda x: (-x[0], x[1:])):
            if all(z <= b or a >= y for b, y, *_ in out):
                out.append((a, z, kind, s))
        return sorted(out)


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def scan(docs: DataFrame, n: int = 500, seed: int = 0) -> DataFrame:
    """doc_id, start, end (of the credential, in code points), kind, score: the mean log likelihood of a symbol. Scored
    are all values behind a keyword and all runs that begin with a prefix of the labelled credentials. Null and empty
    texts have none; a null id stays null; repeated rows repeat theirs; of overlapping ones the likeliest is told, of
    equally likely ones the first. Whole texts are read, however long."""
    models = Models(n, seed)
    rows = pick(docs, "doc_id", "text")

    def each(batches):
        for b in batches:
            found = [(i, *x) for i, t in zip(b.doc_id, b.text) if t for x in models.scan(t)]
            yield pd.DataFrame(found, columns=["doc_id", "start", "end", "kind", "score"])

    return rows.where("length(text) > 0").mapInPandas(each, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start int, end int, kind string, score double")


def kept(docs: DataFrame, n: int = 500, seed: int = 0) -> DataFrame:
    """The rows whose own text has no credential, whatever their ids; null and empty texts stay. Nothing is moved."""
    models = Models(n, seed)

    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not t or not models.scan(t) for t in texts], dtype=bool)

    return plain(docs).where(F.pandas_udf(clean, "boolean")(at(docs, "text"))).toDF(*docs.columns)
