"""Quality rules with host verdicts: rule failures by domain, shrunk by an empirical beta prior, joined back.

Everything a rule needs is computed within the row, so the text never moves: only counts by domain are shuffled. A
domain is rejected when its rate of failing rows, shrunk, is over HOST_LIMIT; its rows go even if they pass the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquill.llm.common import discard, let, materialise, split_words

WINDOW = 8
#: A domain whose shrunk failure rate is above this is rejected as a whole.
HOST_LIMIT = 0.5


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of consecutive words that the text holds twice or more. words must be a lambda's variable.

    Windows are compared by 64-bit hashes; only texts with some repeated hash are sorted."""

    def counted(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            before = F.concat(F.array(F.lit(None).cast("long")), s["h"])
            after = F.concat(F.slice(s["h"], 2, F.size(s)), F.array(F.lit(None).cast("long")))
            marks = F.arrays_zip(s["h"].alias("h"), before.alias("b"), after.alias("a"), s["i"].alias("i"))
            twice = F.filter(marks, lambda m: (m["h"] == m["b"]) | (m["h"] == m["a"]))
            return F.sort_array(F.transform(twice, lambda m: m["i"]))

        def covered(at: Column) -> Column:
            step = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window))))
            return F.aggregate(step, F.lit(0).cast("long"), lambda s, x: s + x)

        return let(ordered, lambda s: let(starts(s), covered))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(window))))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), counted(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) >= window, some).otherwise(F.lit(0).cast("long"))


def features(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed, failed added, which
    replace columns of these names.

    Null and empty texts have no words. failed: any rule, base or soft (many symbols, many repeated lines, odd word lengths)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    of_words = let(split_words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeat_words(w).alias("rep")))
    out = docs.withColumn("__w", of_words).withColumn("__l", of_lines)
    out = out.withColumns({"n_words": F.col("__w.n"), "word_chars": F.col("__w.chars"), "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"), "n_dup_lines": F.col("__l.dup"), "n_lines": F.col("__l.n"), "n_repeat_words": F.col("__w.rep")}).drop("__w", "__l")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    soft = (10 * F.col("n_symbols") > F.col("n_words")) | (2 * F.col("n_dup_lines") > F.col("n_lines")) | (F.col("word_chars") > 15 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn("failed", base | soft)


def beta_prior(by: DataFrame) -> tuple[float, float]:
    """(mean, strength) of the domains' beta prior from their counts (n, x), by moments: domains weigh by their rows, and
    the part of the rates' variance that sampling explains is taken off, so that few rows don't widen the prior. Without
    any variance left the strength is 1e6; it is at least 1. Five sums over the domains reach the driver."""
    n, x = F.col("n").cast("double"), F.col("x").cast("double")
    k, rows, hits, squares, sizes = by.agg(F.count("*"), F.sum(n), F.sum(x), F.sum(x * x / n), F.sum(n * n)).first()
    if not rows:
        return 0.0, 1e6
    mean = hits / rows
    spread = squares - hits * hits / rows  # sum of n (rate - mean)^2
    width = rows - sizes / rows
    noise = mean * (1 - mean)
    between = (spread - (k - 1) * noise) / (width - (k - 1)) if width > k - 1 else 0.0
    return mean, (min(max(noise / between - 1, 1.0), 1e6) if between > 0 else 1e6)


def host_verdicts(rows: DataFrame, host: str, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, n, x, rate, rejected): failure rates by domain, shrunk towards the domains' common rate by a beta prior.

    rows has `failed`. A null domain is one domain, the empty one. The written table is small, so later joins broadcast
    it if it measures small."""
    by = rows.groupBy(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")).agg(F.count("*").alias("n"), F.count_if("failed").alias("x"))
    by = materialise(by, "hosts")
    mean, strength = beta_prior(by)
    shrunk = (F.col("x") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    out = materialise(by.withColumn("rate", shrunk).withColumn("rejected", F.col("rate") > limit), "verdicts")
    discard(by)
    return out


def quality_filter(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """docs (all columns, whatever their names) without rows that fail a base rule or stand in a rejected domain.

    The texts are judged in one pass: rows are written with their flags, domains are counted from the flags alone, and
    the rows that pass are read back. Repeated rows are judged alike and stay; an empty table gives none."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("source"))
    flagged = materialise(features(rows).select("row", "source", "base_failed", "failed"), "flagged")
    bad = host_verdicts(flagged.select("source", "failed"), "source", limit).where("rejected").select(F.col("host").alias("bad"))
    return flagged.where(~F.col("base_failed")).join(bad, F.col("source") == F.col("bad"), "left_anti").select("row.*")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Every document with its counts; rows of the table, repeated ones too, are judged one by one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows = materialise(features(docs).drop("text"), "features")
    verdicts = host_verdicts(rows, "source").select("host", "rate", "rejected")
    out = rows.join(verdicts, F.coalesce(rows.source, F.lit("")) == verdicts.host, "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))).alias("kept"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, row_number() OVER () AS r FROM d),
g AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
f AS (SELECT doc_id, host, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
a AS (SELECT *, base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars > 15 * n_words OR word_chars < 2 * n_words AS failed FROM b),
h AS (SELECT host, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS x FROM a GROUP BY host),
s AS (SELECT count(*)::DOUBLE AS k, sum(n) AS n, sum(x) AS x, sum(x * x / n) AS xx, sum(n * n) AS nn FROM h),
m AS (SELECT x / n AS mean, (x / n) * (1 - x / n) AS noise, CASE WHEN n - nn / n > k - 1 THEN (xx - x * x / n - (k - 1) * (x / n) * (1 - x / n)) / (n - nn / n - (k - 1)) ELSE 0 END AS between_ FROM s),
p AS (SELECT mean, CASE WHEN between_ > 0 THEN least(greatest(noise / between_ - 1, 1), 1e6) ELSE 1e6 END AS strength FROM m),
v AS (SELECT host, (x + mean * strength) / (n + strength) > 0.5 AS rejected FROM h, p)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM a JOIN v USING (host)
"""
