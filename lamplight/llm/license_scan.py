"""Operator 3: short licence notices, found with up to a share of edits."""

from __future__ import annotations

import re

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame

from lamplight.llm.common import pick

NOTICES = {
    "apache-2.0": "licensed under the apache license, version 2.0",
    "mit": "released under the mit license",
    "mit-text": "permission is hereby granted, free of charge, to any person",
    "cc-by-nc-4.0": "licensed under cc by-nc 4.0",
    "cc-by-4.0": "licensed under a creative commons attribution 4.0",
    "cc-by-sa-4.0": "creative commons attribution-sharealike 4.0",
    "cc0": "this work is dedicated to the public domain",
    "gpl-3.0": "this work is licensed under the gnu general public license, version 3",
    "gpl-text": "under the terms of the gnu general public license",
    "lgpl": "under the terms of the gnu lesser general public license",
    "agpl-3.0": "under the terms of the gnu affero general public license",
    "all-rights-reserved": "all rights reserved",
    "bsd": "redistribution and use in source and binary forms",
    "isc": "permission to use, copy, modify, and/or distribute this software",
    "mpl-2.0": "subject to the terms of the mozilla public license, v. 2.0",
    "epl-2.0": "under the terms of the eclipse public license",
    "boost-1.0": "distributed under the boost software license, version 1.0",
    "unlicense": "free and unencumbered software released into the public domain",
    "spdx": "spdx-license-identifier:",
}
#: What a comment begins a line with.
MARKS = re.compile(r"\n[ \t]*(?:[*#/;>|%!]+|--+|//+|dnl|rem)(?=[ \t])")


def build(notices: dict[str, str], rate: float):
    """The exact seeds of every notice (edits + 1 pieces) and its bounded-error expression."""
    found, at, forms = ahocorasick.Automaton(), {}, {}
    for name, text in notices.items():
        k = int(len(text) * rate)
        cut = [len(text) * i // (k + 1) for i in range(k + 2)]
        for a, b in zip(cut, cut[1:]):
            at.setdefault(text[a:b], []).append((name, a))
        masks = {c: sum(1 << i for i, x in enumerate(text) if x == c) for c in text}
        forms[name] = (regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={k}}}"), len(text), k, masks)
    for p, where in at.items():
        found.add_word(p, (len(p), where))
    found.make_automaton()
    return found, forms


def distance(masks: dict[str, int], m: int, text: str) -> int:
    """The least edit distance of a notice to a part of the text, bit-parallel."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, d, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xh = ((((eq & pv) + pv) ^ pv) | eq) & full
        xv, ph, mh = eq | mv, mv | (~(xh | pv) & full), pv & xh
        d += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        best = min(best, d)
    return best


def spans(form, k: int, masks: dict[str, int], m: int, low: str, a: int, z: int):
    """The best match, and those of what lies on either side of it. Windows that a count of edits rules out never reach
    the expression."""
    todo = [(a, z)]
    while todo:
        a, z = todo.pop()
        if z - a >= m - k and distance(masks, m, low[a:z]) <= k and (x := form.search(low, a, z)):
            yield x
            todo += [(a, x.start()), (x.end(), z)]


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def flat(low: str) -> str:
    """Comment marks at the beginning of lines left out, white space collapsed."""
    return " ".join(MARKS.sub("\n", low).split())


def positions(low: str, n: int) -> list[int]:
    """Where in the text each character of flat(low) is."""
    gone, out, spaced = set(), [], False
    for m in MARKS.finditer(low):
        gone.update(range(m.start() + 1, m.end()))
    for i, c in enumerate(low):
        if c.isspace():
            spaced = bool(out)
        elif i not in gone:
            if spaced:
                out.append(i - 1)
            out.append(i)
            spaced = False
    return out[:n]


def scan_text(text: str, built) -> list[tuple[str, int, int, int]]:
    """(notice, start, end, edits) of the non-overlapping matches; positions are code points of the text."""
    found, forms = built
    low = lowered(text)
    x = flat(low)
    spots: dict[str, list] = {}
    for end, (n, where) in found.iter(x):
        for name, a in where:
            spots.setdefault(name, []).append(end + 1 - n - a)
    out = []
    for name, starts in spots.items():
        form, m, k, masks = forms[name]
        windows: list[list[int]] = []
        for s in sorted(starts):
            a, z = max(0, s - k), s + m + k
            if windows and a <= windows[-1][1]:
                windows[-1][1] = max(windows[-1][1], z)
            else:
                windows.append([a, z])
        for a, z in windows:
            out += [(name, m_.start(), m_.end(), sum(m_.fuzzy_counts)) for m_ in spans(form, k, masks, m, x, a, min(z, len(x)))]
    if out:
        at_ = positions(low, len(x))
        out = [(name, at_[a], at_[z - 1] + 1, edits) for name, a, z, edits in out if z > a]
    return sorted(out, key=lambda r: (r[1], r[2], r[0]))


def scan(docs: DataFrame, notices: dict[str, str] = NOTICES, rate: float = 0.1) -> DataFrame:
    """doc_id, notice, start, end, edits (at most rate of the notice's length). Case, runs of white space and comment
    marks at the beginning of lines cost no edits. Null and empty texts have none; repeated rows repeat their matches; a
    null id stays null; of matches of one notice that overlap, the one with the fewest edits is told, of equal ones the
    first, and then what lies before and after it; different notices may overlap. Whole texts are read."""
    rows = pick(docs, "doc_id", "text")

    def each(batches):
        built = build(notices, rate)
        for b in batches:
            found = [(i, *x) for i, t in zip(b.doc_id, b.text) if t for x in scan_text(t, built)]
            yield pd.DataFrame(found, columns=["doc_id", "notice", "start", "end", "edits"])

    return rows.where("length(text) > 0").mapInPandas(each, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, notice string, start int, end int, edits int")
