"""URL filters: host and path rules, then trust and distrust propagated over host edges, thresholded per host.

Trust is a personalised PageRank from trusted hosts along links; distrust is one from blocked hosts against them. A
host is a seed if the rules allow, or block, more than SEED of all its pages, so a rule for one path doesn't spread.
Edges are links in the pages (counted by host pair before any iteration) and the two-way edge between a host and the
domain above it, unless that is a public suffix, under which strangers are neighbours. Both ranks are iterated until no
host's rank changes by more than TOLERANCE of itself, and then scaled to a sum of 1: that equals giving the rank of
hosts without edges back to the seeds in every round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquill.llm.common import HOT, ascii_lower, discard, materialise

# The rules (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

# Domains under which unrelated people have hosts, as patterns; a list of public suffixes can be given.
SUFFIXES = [r"(?:ac|co|com|edu|go|gob|gov|ne|net|nom|or|org)\.[a-z]{2}", r"(?:blogspot|wordpress|tumblr|substack|weebly|wixsite|appspot|herokuapp)\.com", r"(?:github|gitlab)\.io", r"(?:netlify|vercel|web)\.app", r"pages\.dev", r"(?:azurewebsites|cloudfront)\.net"]

DAMPING, TOLERANCE = 0.85, 1e-4
#: The share of a host's pages that the rules must allow, or block, before the host is a seed.
SEED = 0.5
#: Rounds between two writes of the ranks, where their change is measured.
STEP = 8
#: A page without a rule is blocked if its host's distrust is over this share of distrust and trust.
LIMIT = 0.5

HREF = r"""(?i)\b(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or without ://."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule, ruled. The longest fitting rule wins; rules are a bounded list in the plan."""
    host, path = parts(F.col("url"))
    out = pages.withColumn("host", host).withColumn("path", path)
    hit = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("ruled")))
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        hit = hit.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("ruled")))
    return out.withColumn("__hit", hit).withColumns({"rule": F.col("__hit.rule"), "ruled": F.col("__hit.ruled")}).drop("__hit")


def host_edges(pages: DataFrame, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """(src, dst, w): links between different hosts by count, and family edges of weight 1. pages: host, html."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1))).alias("to"))
    links = links.select("src", ascii_lower(F.col("to")).alias("dst")).groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    up = pages.select("host").distinct().select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.([^.]+\..+)$", 1).alias("dst"))
    up = up.where((F.col("dst") != "") & ~F.col("dst").rlike("^(?:" + "|".join(suffixes) + ")$"))
    family = up.union(up.select("dst", "src")).distinct().withColumn("w", F.lit(1.0))
    both = links.union(family).where("src <> dst and src <> '' and dst <> ''")
    return both.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = DAMPING, tolerance: float = TOLERANCE, hot: int = HOT) -> DataFrame:
    """(host, rank) from seeds (host, seed) along edges, after so many rounds, or if none are given after the first of
    them in which no rank changes by more than tolerance of itself; a change cannot grow later, as it is at most the
    largest among the host's sources. Each round joins the ranks with the edges and sums by target, partially before
    the shuffle; every STEP rounds they are written out, to cut the lineage. A host of over `hot` edges has them dealt
    into parts, and its rank goes to each. Without seeds or edges only the seeds have ranks."""
    out = materialise(edges.groupBy("src").agg(F.sum("w").alias("all"), F.ceil(F.count("*") / hot).cast("int").alias("parts")), "out")
    salt = F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int")
    share = materialise(edges.join(out, "src").select("src", salt.alias("part"), "dst", (F.col("w") / F.col("all")).alias("p")), "share")
    many = out.where("parts > 1").select(F.col("src").alias("hub"), "parts")
    many = None if many.isEmpty() else materialise(many, "hubs")
    discard(out)

    def dealt(ranks: DataFrame) -> DataFrame:
        if many is None:
            return ranks.withColumn("of", F.lit(0))
        parts = F.coalesce("parts", F.lit(1))
        return ranks.join(many, ranks.host == many.hub, "left").select("host", "rank", F.explode(F.sequence(F.lit(0), parts - 1)).alias("of"))

    start = materialise(seeds.select("host", F.col("seed").alias("rank")), "ranks")
    ranks, kept, n = start, None, 0
    start = start.select("host", (F.col("rank") * (1 - damping)).alias("rank"))
    while rounds is None or n < rounds:
        n += 1
        from_ = dealt(ranks)
        moved = share.join(from_, (share.src == from_.host) & (share.part == from_.of)).select(F.col("dst").alias("host"), (F.col("p") * F.col("rank") * damping).alias("rank"))
        both = moved.union(start)
        if n % STEP == 0 or n == rounds:  # the ranks before this round go along
            both = both.withColumn("was", F.lit(0.0)).union(ranks.select("host", F.lit(0.0), "rank"))
            ranks = materialise(both.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was")).where("rank > 0"), "ranks")
            if kept is not None:
                discard(kept)
            kept = ranks
            if rounds is None and (ranks.agg(F.max(F.abs(F.col("rank") - F.col("was")) / F.col("rank"))).first()[0] or 0.0) <= tolerance:
                break
            ranks = ranks.select("host", "rank")
        else:
            ranks = both.groupBy("host").agg(F.sum("rank").alias("rank"))
    discard(share, *[many] * (many is not None))
    return ranks.select("host", "rank")


def filter_urls(pages: DataFrame, rules=RULES, limit: float = LIMIT, seed: float = SEED) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url, html).

    Without a rule the host's distrust / (trust + distrust) decides: block above limit, else allow; hosts that
    neither reaches, and pages without a host, are allowed. Of rules of one length that fit, the first by (verdict,
    host, path) holds. Null urls and html are empty; repeated rows stay; other columns are ignored; no rows give
    none."""
    judged = judge(pages.select("page_id", "url", "html"), rules)
    edges = materialise(host_edges(judged), "hostedges")
    rows = materialise(judged.select("page_id", "host", "path", "rule", "ruled"), "judged")
    by = rows.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("allow"), F.count_if(F.col("ruled") == "block").alias("block"))
    by = materialise(by.where((F.col("allow") > seed * F.col("n")) | (F.col("block") > seed * F.col("n"))), "seeds")
    # one iteration for both: their hosts differ by a sign before the name
    tagged = lambda sign, c: F.concat(F.lit(sign), F.col(c)).alias(c)
    along = edges.select(tagged("+", "src"), tagged("+", "dst"), "w")
    against = edges.select(tagged("-", "src"), tagged("-", "dst"), "w").toDF("dst", "src", "w").select("src", "dst", "w")
    seeds = [by.where(F.col(verdict) > seed * F.col("n")).select(tagged(sign, "host"), F.col(verdict).cast("double").alias("seed")) for sign, verdict in (("+", "allow"), ("-", "block"))]
    ranks = propagate(along.union(against), seeds[0].union(seeds[1]))
    sums = dict(ranks.groupBy(F.substring("host", 1, 1).alias("sign")).agg(F.sum("rank")).collect())
    trust, distrust = (ranks.where(F.col("host").startswith(sign)).select(F.expr("substring(host, 2)").alias("host"), (F.col("rank") / F.lit(sums.get(sign, 1.0))).alias(name)) for sign, name in (("+", "trust"), ("-", "distrust")))
    share = F.round(F.coalesce("distrust", F.lit(0.0)) / (F.coalesce("trust", F.lit(0.0)) + F.coalesce("distrust", F.lit(0.0))), 9)
    bad = materialise(distrust.join(trust, "host", "full").withColumn("share", share).where(F.col("share") > limit).select(F.col("host").alias("__host"), "share"), "badhosts")
    discard(edges, by)
    out = rows.join(bad, rows.host == bad["__host"], "left")
    verdict = F.coalesce("ruled", F.when(F.col("share").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op8_urls(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
