"""Operator 2: token budgets down a domain-language-source tree, filled from seeded epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lamplight.llm.common import at, forget, pick, plain, stored

LEAF = ("domain", "lang", "source")
#: The target weights that the query and the pipeline use; a node without one has 1.
WEIGHTS = {("web",): 3.0, ("curated",): 1.0, ("web", "en"): 4.0, ("web", "de"): 2.0, ("web", "fr"): 2.0, ("curated", "en"): 2.0}
CURATED = 10  # sources src0 to src9 are the curated domain, all others the web


def domain(source: Column) -> Column:
    """The domain that a source belongs to: 'curated' for the first CURATED of the numbered sources, else 'web'."""
    return F.when(source.rlike(r"^src[0-9]$"), "curated").otherwise("web")


def allocate(capacity: dict[tuple, int], total: float, weights: dict[tuple, float] | None = None) -> dict[tuple, int]:
    """Whole tokens of each leaf (path) from what it can hold. At each node the budget goes to children by weight (1
    where none is given, a weight of 0 gets nothing); what a child can't hold goes to its siblings by their weights, and
    only what all of them can't hold goes up."""
    weights, out = weights or {}, {}

    def down(path: tuple, leaves: dict[tuple, int], left: float) -> None:
        if path in leaves:
            out[path] = int(min(left, leaves[path]))
            return
        room: dict[tuple, int] = {}
        for leaf, c in leaves.items():
            room[leaf[: len(path) + 1]] = room.get(leaf[: len(path) + 1], 0) + c
        w = {p: weights.get(p, 1.0) for p in room}
        # the children that fill up first come first; each gets its room while the level of the rest is above it
        order = sorted((p for p in room if w[p] > 0), key=lambda p: (room[p] / w[p], p))
        share, open_ = dict.fromkeys(room, 0.0), sum(w[p] for p in order)
        for k, p in enumerate(order):
            level = left / open_
            if level < room[p] / w[p]:
                share |= {q: w[q] * level for q in order[k:]}
                break
            share[p] = float(room[p])
            left, open_ = left - room[p], open_ - w[p]
        for p in room:
            down(p, {leaf: c for leaf, c in leaves.items() if leaf[: len(p)] == p}, share[p])

    if capacity:
        down((), capacity, float(total))
    return out


def place(epoch, doc_id, text, seed: int) -> Column:
    """Where a document stands in an epoch: 60 bits of a hash of seed, epoch, id and text."""
    parts = F.concat_ws("|", F.lit(seed), epoch, F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(parts), 1, 15), 16, 10).cast("long")


def described(docs: DataFrame) -> tuple[DataFrame, dict]:
    """plain(docs), and its expressions of the leaf and the tokens."""
    lang, source, text = (F.col(at(docs, n)) for n in ("lang", "source", "text"))
    leaf = {"domain": domain(F.coalesce(source, F.lit(""))), "lang": F.coalesce(lang, F.lit("none")), "source": F.coalesce(source, F.lit("none"))}
    tokens = F.when(F.length(text) > 0, F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "))).otherwise(0)
    return plain(docs), leaf | {"tokens": F.when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", 0).otherwise(tokens).cast("long")}


def bounds(docs: DataFrame, fraction: float, max_epochs: int, weights: dict | None, seed: int) -> DataFrame:
    """domain, lang, source, epoch, last: the place of the last document that a leaf takes in an epoch."""
    spark, (rows, say) = docs.sparkSession, described(docs)
    # only numbers go on from here; leaves are few, and of the places only sums by their first 10 bits
    own = stored(rows.select(*[say[k].alias(k) for k in LEAF], say["tokens"].alias("tokens"), *[place(F.lit(e), at(docs, "doc_id"), at(docs, "text"), seed).alias(f"h{e}") for e in range(max_epochs)]), "places")
    capacity = {tuple(r[k] for k in LEAF): int(r.n or 0) for r in own.groupBy(*LEAF).agg(F.sum("tokens").alias("n")).collect()}
    budgets = allocate({k: n * max_epochs for k, n in capacity.items()}, fraction * sum(capacity.values()), weights)
    left = spark.createDataFrame([(*leaf, e, max(0, min(n - e * capacity[leaf], capacity[leaf]))) for leaf, n in budgets.items() for e in range(max_epochs)], "domain string, lang string, source string, epoch int, budget long").where("budget > 0")
    t = own.select(*LEAF, "tokens", F.posexplode(F.array(*[f"h{e}" for e in range(max_epochs)])).alias("epoch", "h")).withColumn("bucket", F.shiftright("h", 50))
    by = [*LEAF, "epoch"]
    w = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = t.groupBy(*by, "bucket").agg(F.sum("tokens").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0))).join(F.broadcast(left), by)
    # a leaf's budget ends in one bucket of an epoch, whose documents alone are ordered
    edge = sums.where("base < budget AND base + n >= budget").select(*by, "bucket", "base", "budget")
    ties = t.join(F.broadcast(edge), [*by, "bucket"]).groupBy(*by, "base", "budget", "h").agg(F.sum("tokens").alias("n"))
    run = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = stored(ties.withColumn("before", F.col("base") + run).where("before < budget").groupBy(*by).agg(F.max("h").alias("last")), "bounds")
    forget(own)
    return last


def taken(docs: DataFrame, fraction: float = 0.6, max_epochs: int = 2, weights: dict | None = WEIGHTS, seed: int = 0) -> tuple[DataFrame, dict]:
    """plain(docs) with domain, lang, source, epoch and last, a row for each time that a row is taken; its expressions.
    A row's place alone decides, so nothing but the few bounds is moved."""
    last = bounds(docs, fraction, max_epochs, weights, seed)
    rows, say = described(docs)
    for e in range(max_epochs):
        rows = rows.withColumn(f"__h{e}", place(F.lit(e), at(docs, "doc_id"), at(docs, "text"), seed))
    rows = rows.select("*", *[say[k].alias(f"__{k}") for k in LEAF], F.posexplode(F.array(*[f"__h{e}" for e in range(max_epochs)])).alias("__epoch", "__h"))
    few = F.broadcast(last.select(*[F.col(c).alias(f"__{c}") for c in last.columns]))
    return rows.join(few, ["__domain", "__lang", "__source", "__epoch"]).where("__h <= __last"), say


def mix(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, domain, lang, source, tokens, epoch: what each leaf takes. The budget is the fraction of all tokens. Each
    epoch of a leaf is its documents ordered by a hash of seed, epoch, id and text; a document is taken if the tokens
    before it are fewer than what is left of the leaf's budget, and the next epoch begins once all of one are taken. A
    null lang or source is 'none'. Rows alike in id and text tie: they are taken or left together. Documents without
    tokens, null and empty texts included, are taken if one after them is. A table without tokens yields no rows."""
    rows, say = taken(docs, **kw)
    return rows.select(F.col(at(docs, "doc_id")).alias("doc_id"), *[F.col(f"__{k}").alias(k) for k in LEAF], say["tokens"].alias("tokens"), F.col("__epoch").alias("epoch"))


def mixed(docs: DataFrame, **kw) -> DataFrame:
    """The rows that mix takes, with all their columns, as often as epochs take them, and mix_epoch (mix_epoch_2 and so
    on where there is such a column)."""
    rows, _ = taken(docs, **kw)
    name, k = "mix_epoch", 1
    while name.lower() in {c.lower() for c in docs.columns}:
        k += 1
        name = f"mix_epoch_{k}"
    return rows.select(*plain(docs).columns, "__epoch").toDF(*docs.columns, name)


def _sql(weights: dict, fraction: float = 0.6, epochs: int = 2, seed: int = 0) -> str:
    """mix over documents in DuckDB's SQL."""
    w = lambda depth: "CASE " + " ".join("WHEN " + " AND ".join(f"{k} = '{v}'" for k, v in zip(LEAF, p)) + f" THEN {x}" for p, x in weights.items() if len(p) == depth) + " ELSE 1.0 END" if any(len(p) == depth for p in weights) else "1.0"

    def level(depth: int, above: str) -> str:
        by, up = ", ".join(LEAF[:depth]), ", ".join(LEAF[: depth - 1])
        part = f"PARTITION BY {up}" if up else ""
        order = f"ORDER BY room / w, {LEAF[depth - 1]}"
        join = f"JOIN {above} USING ({up})" if up else f"CROSS JOIN {above}"
        return f"""
  r{depth} AS (SELECT {by}, sum(tokens)::DOUBLE * {epochs} AS room, {w(depth)}::DOUBLE AS w FROM d GROUP BY {by}),
  o{depth} AS (SELECT *, share AS left_, coalesce(sum(room) OVER ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone, row_number() OVER ({part} {order}) AS rn,
    sum(w) OVER ({part} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_ FROM r{depth} {join}),
  f{depth} AS (SELECT *, (left_ - gone) / open_ AS level, (left_ - gone) / open_ < room / w AS short FROM o{depth}),
  g{depth} AS (SELECT *, min(CASE WHEN short THEN rn END) OVER ({part}) AS cut, arg_min(level, rn) FILTER (WHERE short) OVER ({part}) AS at_ FROM f{depth}),
  s{depth} AS (SELECT {by}, CASE WHEN cut IS NOT NULL AND rn >= cut THEN w * at_ ELSE room END AS share FROM g{depth})"""

    return f"""
WITH d AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(source, ''), '^src[0-9]$') THEN 'curated' ELSE 'web' END AS domain,
    coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, text,
    CAST(CASE WHEN trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = '' THEN 0
      ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS BIGINT) AS tokens FROM documents),
  s0 AS (SELECT {fraction} * sum(tokens) AS share FROM d),{level(1, "s0")},{level(2, "s1")},{level(3, "s2")},
  c AS (SELECT {", ".join(LEAF)}, sum(tokens) AS held FROM d GROUP BY ALL),
  b AS (SELECT *, greatest(0, least(floor(share)::BIGINT - epoch * held, held)) AS budget FROM s3 JOIN c USING ({", ".join(LEAF)}) CROSS JOIN (SELECT unnest(range({epochs})) AS epoch)),
  p AS (SELECT d.*, epoch, budget, ('0x' || substr(md5({seed} || '|' || epoch || '|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
    FROM d JOIN b USING ({", ".join(LEAF)})),
  q AS (SELECT *, sum(tokens) OVER (PARTITION BY {", ".join(LEAF)}, epoch ORDER BY h RANGE UNBOUNDED PRECEDING)
    - sum(tokens) OVER (PARTITION BY {", ".join(LEAF)}, epoch, h) AS before FROM p)
SELECT doc_id, {", ".join(LEAF)}, tokens, CAST(epoch AS INTEGER) AS epoch FROM q WHERE before < budget"""


SQL = _sql(WEIGHTS)
