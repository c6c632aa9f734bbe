"""Mixing sources to target weights by hierarchical budgets over a domain-language-source tree.

A node's budget goes to its children by weight, each capped by the tokens of its subtree (times max_epochs). What a
child can't take goes to its siblings by weight; only what all siblings together can't take is left to the node's own
siblings, because the node's cap then binds one level up. Each level is one window over the children of a node: with
children in order of cap / weight, the capped ones come first, and the rest share one level. A leaf takes its whole
epochs, then the prefix of the next epoch's seeded order that reaches its budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquill.llm.common import discard, materialise, split_words

LEVELS = ["domain", "lang", "source"]

#: Default weights; a node that is not named has weight 1 among its siblings.
WEIGHTS = [("lang", "en", 3.0), ("lang", "de", 1.5)]


def default_domain(docs: DataFrame) -> Column:
    """A row's `domain`, where docs has that column, else its source's: the first digit of its number, or '-'."""
    if "domain" in docs.columns:
        return F.col("domain").cast("string")
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce("source", F.lit("")), r"(\d)\d*$", 1), F.lit("")), F.lit("-"))


def _weight(level: str, weights) -> Column:
    out = F.when(F.lit(False), F.lit(1.0))
    for at, name, w in weights:
        if at == level:
            out = out.when(F.col(level) == name, F.lit(float(w)))
    return out.otherwise(1.0)


def fill(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes (budget of the parent, cap, weight, order) with `share` added: weighted shares under caps."""
    w = Window.partitionBy(*parent, "__all").orderBy(F.asc_nulls_last("__ratio"), "__name") if parent else Window.partitionBy("__all").orderBy(F.asc_nulls_last("__ratio"), "__name")
    rows = nodes.withColumn("__all", F.lit(1)).withColumn("__ratio", F.try_divide("cap", F.nullif("weight", F.lit(0.0))))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rest = w.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("__level", F.try_divide(F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.nullif(F.sum("weight").over(rest), F.lit(0.0))))
    full = F.coalesce(F.col("__ratio") <= F.col("__level"), F.lit(False))
    rows = rows.withColumn("__full", full)
    level = F.max(F.when(~F.col("__full"), F.col("__level"))).over(Window.partitionBy(*parent, "__all"))
    share = F.when(F.col("__full"), F.col("cap")).otherwise(F.col("weight") * F.coalesce(level, F.lit(0.0)))
    return rows.withColumn("share", F.greatest(F.least(share, F.col("cap")), F.lit(0.0))).drop("__all", "__ratio", "__level", "__full")


def leaf_budgets(rows: DataFrame, total: int, max_epochs: int, weights=WEIGHTS) -> DataFrame:
    """(domain, lang, source, tokens, budget) from rows (domain, lang, source, n_tokens)."""
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").cast("double").alias("tokens"))
    leaves = materialise(leaves.withColumn("cap", F.col("tokens") * max_epochs), "leaves")
    above = None
    for depth, level in enumerate(LEVELS):
        path = LEVELS[: depth + 1]
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", _weight(level, weights)).withColumn("__name", F.col(level))
        nodes = nodes.withColumn("budget", F.lit(float(total))) if above is None else nodes.join(above, path[:-1])
        above = fill(nodes, path[:-1]).drop("budget", "__name")
        if depth < len(LEVELS) - 1:
            above = above.select(*path, F.col("share").alias("budget"))
    return above.select(*LEVELS, F.col("tokens").cast("long").alias("tokens"), F.floor(F.col("share") + 1e-6).cast("long").alias("budget"))


def mix(docs: DataFrame, fraction: float = 0.5, max_epochs: int = 2, seed: int = 7, weights=WEIGHTS, domain: Column | None = None) -> DataFrame:
    """(doc_id, th, domain, lang, source, n_tokens, copies) for the rows of docs (doc_id, text, lang, source) that
    are taken at least once.

    The budget is `fraction` of all tokens (blank-separated words). copies counts whole epochs, plus 1 if the row is
    in the last epoch's prefix, which ends with the row that reaches the leaf's budget. Orders: md5 of seed, epoch and
    doc_id, ties by doc_id and text. Null texts have no tokens and are taken with whole epochs only; null lang and
    source are empty names. Repeated rows count each; an empty table gives none.

    No leaf is sorted as a whole: tokens are summed by leaf and 4,096 stretches of the order, and only rows in the
    stretch that the budget cuts are sorted, so a leaf with a third of all rows spreads over all tasks."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce(domain if domain is not None else default_domain(docs), F.lit("")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.size(split_words(F.col("text"))).cast("long").alias("n_tokens"))
    rows = materialise(rows, "tokens")
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    leaves = leaf_budgets(rows, int(total * fraction), max_epochs, weights)
    epochs = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)
    leaves = materialise(leaves.withColumn("epochs", epochs).withColumn("left", F.col("budget") - F.col("epochs") * F.col("tokens")), "budgets")
    placed = rows.join(leaves, LEVELS).withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    placed = materialise(placed.withColumn("stretch", F.substring("key", 1, 3)), "placed")
    discard(rows, leaves)
    sums = placed.where("n_tokens > 0 and left > 0").groupBy(*LEVELS, "stretch", "left").agg(F.sum("n_tokens").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("stretch")) - F.col("n")).where(F.col("before") < F.col("left"))
    sums = sums.withColumn("whole", F.col("before") + F.col("n") <= F.col("left")).select(*LEVELS, "stretch", "before", "whole")
    inside = placed.where("n_tokens > 0 and left > 0").join(sums, [*LEVELS, "stretch"])
    order = Window.partitionBy(*LEVELS, "stretch").orderBy("key", F.asc_nulls_first("doc_id"), "th").rowsBetween(Window.unboundedPreceding, -1)
    cut = inside.where(~F.col("whole")).withColumn("at", F.col("before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).where(F.col("at") < F.col("left"))
    cols = ["doc_id", "th", *LEVELS, "n_tokens"]
    prefix = inside.where("whole").select(*cols, F.lit(1).alias("c")).union(cut.select(*cols, F.lit(1).alias("c")))
    every = placed.where("epochs > 0").select(*cols, F.col("epochs").cast("int").alias("c"))
    return _merged(every, prefix, cols)


def _merged(every: DataFrame, prefix: DataFrame, cols: list[str]) -> DataFrame:
    """Whole epochs and prefix, one row for each (row, kind); summed where a row is in both. Repeated rows share a
    line with their copies added up; `rows` counts none of them twice."""
    return every.union(prefix).groupBy(*cols).agg(F.sum("c").cast("long").alias("copies"))


def mix_documents(docs: DataFrame, fraction: float = 0.8, max_epochs: int = 1, seed: int = 7, weights=WEIGHTS) -> DataFrame:
    """docs (all columns, whatever their names), each row as often as the mixture takes it.

    Rows equal in doc_id and text share their copies: the k-th of r such rows, in the order of a hash of all their
    columns, gets every r-th copy. Rows that are equal in all columns are the same, so a task that runs again after a
    lost executor deals them alike."""
    taken = mix(docs, fraction, max_epochs, seed, weights).groupBy(F.coalesce("doc_id", F.lit(-1)).alias("d"), F.col("doc_id").isNull().alias("n"), F.col("th").alias("t")).agg(F.sum("copies").alias("copies"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("i"), F.col("doc_id").isNull().alias("o"), F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    numbered = Window.partitionBy("i", "o", "h")
    out = rows.join(taken, (F.col("i") == F.col("d")) & (F.col("o") == F.col("n")) & (F.col("h") == F.col("t")))
    out = out.withColumn("k", F.row_number().over(numbered.orderBy(F.xxhash64("row")))).withColumn("r", F.count("*").over(numbered))
    out = out.withColumn("c", F.expr("(copies + r - k) div r")).where("c > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "c"))).select("row.*")


def op5_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", "domain", "lang", "source", "n_tokens", "copies")


ORACLE = r"""
WITH r AS (SELECT doc_id, md5(coalesce(text, '')) AS th, coalesce(nullif(regexp_extract(coalesce(source, ''), '(\d)\d*$', 1), ''), '-') AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE * 2 AS cap FROM r GROUP BY ALL),
n1 AS (SELECT domain, sum(cap) AS cap, 1.0::DOUBLE AS weight, (SELECT floor(sum(n_tokens) * 0.5)::DOUBLE FROM r) AS budget FROM leaf GROUP BY domain),
l1 AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM n1),
s1 AS (SELECT domain, CASE WHEN cap / weight <= lev THEN cap ELSE weight * max(CASE WHEN cap / weight > lev THEN lev END) OVER () END AS share FROM l1),
n2 AS (SELECT domain, lang, sum(cap) AS cap, CASE lang WHEN 'en' THEN 3.0 WHEN 'de' THEN 1.5 ELSE 1.0 END::DOUBLE AS weight, any_value(share) AS budget FROM leaf JOIN s1 USING (domain) GROUP BY domain, lang),
l2 AS (SELECT *, (budget - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (PARTITION BY domain ORDER BY cap / weight, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM n2),
s2 AS (SELECT domain, lang, CASE WHEN cap / weight <= lev THEN cap ELSE weight * max(CASE WHEN cap / weight > lev THEN lev END) OVER (PARTITION BY domain) END AS share FROM l2),
n3 AS (SELECT domain, lang, source, tokens, cap, 1.0::DOUBLE AS weight, share AS budget FROM leaf JOIN s2 USING (domain, lang)),
l3 AS (SELECT *, (budget - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (PARTITION BY domain, lang ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM n3),
s3 AS (SELECT domain, lang, source, tokens, floor(least(cap, CASE WHEN cap / weight <= lev THEN cap ELSE weight * max(CASE WHEN cap / weight > lev THEN lev END) OVER (PARTITION BY domain, lang) END) + 1e-6)::BIGINT AS budget FROM l3),
e AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens::BIGINT ELSE 0 END AS epochs FROM s3),
p AS (SELECT r.*, epochs, budget - epochs * tokens::BIGINT AS rest, md5('7:' || epochs || ':' || doc_id) AS k FROM r JOIN e USING (domain, lang, source)),
c AS (SELECT *, epochs + CASE WHEN n_tokens > 0 AND coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id, th ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < rest THEN 1 ELSE 0 END AS c FROM p)
SELECT doc_id, domain, lang, source, n_tokens, sum(c)::BIGINT AS copies FROM c WHERE c > 0 GROUP BY doc_id, th, domain, lang, source, n_tokens
"""
