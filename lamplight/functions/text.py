"""Scalar functions on text, as column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def slug(c):
    """F1."""
    return F.expr(f"trim(BOTH '-' FROM regexp_replace(lower({c}), '[^a-z0-9]+', '-'))")


def fenced(c):
    """the first fenced block, else the whole text, without outer white space."""
    form = r"(?s)```[A-Za-z+#]*\n(.*?)```"
    return F.regexp_replace(F.when(c.rlike(form), F.regexp_extract(c, form, 1)).otherwise(c), r"(?U)^\s+|\s+$", "")


def words(c):
    """F5."""
    return F.size(F.regexp_extract_all(c, F.lit(WORD), F.lit(0))).cast("long")


def lines_of_code(c):
    """lines with anything but white space."""
    return F.size(F.filter(F.split(c, "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"), lambda x: x.rlike(r"(?U)\S"))).cast("long")


def outcome(compiled, rate, diagnostics):
    """F17."""
    d = F.lower(diagnostics)
    return F.when(compiled & (rate == 1), "passed").when(compiled, "wrong_output").when(d.contains("redefinition"), "redefinition").when(d.contains("timed out"), "timeout").otherwise("compile_error")


def node_kind(c):
    """F10."""
    return F.when(c.contains("TreeNode"), "tree_node").when(c.contains("ListNode"), "list_node").otherwise("plain")


def correctness(passed, expected):
    """the share of the expected pairs that passed, of as many results as are expected; 0 where either is empty."""
    own = F.slice(passed, 1, F.greatest(F.least(F.size(passed), expected), F.lit(1)))
    return F.when((F.size(passed) <= 0) | (expected <= 0), 0.0).otherwise(F.size(F.filter(own, lambda x: x)) / expected)


def all_or_nothing(rate):
    """F16: pass@1 of one sample."""
    return F.when(F.col(rate) == 1.0, 1.0).otherwise(0.0)


def one_or_zero(flag):
    """F14."""
    return F.coalesce(F.col(flag), F.lit(False)).cast("double")


def truncated(c, n: int = 2000):
    """the first n characters."""
    return F.left(c, F.lit(n))


def folder(c):
    """number and title of a folder named '{number}. {title}'; null for any other."""
    form = r"^([0-9]+)\. (.+)$"
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(form), F.struct(F.regexp_extract(c, form, 1).cast("long").alias("parallel_id"), F.regexp_extract(c, form, 2).alias("title")))


def entry_point(c):
    """PF11: the call's name; 'solve' where none is given."""
    return F.regexp_replace(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("solve")), r"^Solution\(\)\.", "")


def prompt(instruction, code):
    """F8: the instruction, and after a blank line the code if there is any."""
    return F.concat(instruction, F.when(F.coalesce(F.length(code), F.lit(0)) > 0, F.concat(F.lit("\n\n"), code)).otherwise(""))


def chat(content, before: str | None = None, after: str = ""):
    """the content as a model's template wants it; as it is where the model has none."""
    return content if before is None else F.concat(F.lit(before), content, F.lit(after))


def model_name(*candidates):
    """what follows the last slash of the first name that is given."""
    return F.element_at(F.split(F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates]), "/"), -1)


def formatted(x, percent: bool = False):
    """two decimals, or a percentage with one, halves to even; a dash for null."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x.isNull(), "\u2014").otherwise(F.format_string("%.1f%%", F.bround(100 * x, 1)) if percent else F.format_string("%.2f", F.bround(x, 2)))


def signed(base, tuned, percent: bool = False, lower_is_better=None):
    """How much better tuned is, with its sign; a dash where one is null."""
    d = tuned - base if lower_is_better is None else F.when(lower_is_better, base - tuned).otherwise(tuned - base)
    said = F.format_string("%.1f%%", F.bround(100 * d, 1)) if percent else F.format_string("%.2f", F.bround(d, 2))
    return F.when(d.isNull(), "\u2014").otherwise(F.concat(F.when(d >= 0, "+").otherwise(""), said))


def nested(document, *path: str):
    """a number deep in a JSON document; names may have commas, dots and signs."""
    # each level is read by itself, since its siblings may be of other kinds
    at = document
    for name in path[:-1]:
        at = F.from_json(at, "map<string,string>")[name]
    return F.from_json(at, "map<string,string>")[path[-1]].cast("double")
