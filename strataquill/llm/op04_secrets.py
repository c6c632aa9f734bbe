"""Secret scans: base patterns with exact places, and weak credential parts linked within scopes.

A part that is too weak to report alone (a bare key-like token; a login name or mail address; an endpoint, which is a URL
or an IPv4 address) is reported only when a complementary part stands within SCOPE code points of it in the same text. Linking is an interval join: parts meet
by (row, stretch of SCOPE code points) and a left semi join keeps the weak ones, so no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquill.llm.common import let, materialise, text_hash

SCOPE = 200
#: Matches whose places are added up in one list.
RUN = 256

# The kinds in their order, and their patterns. Only assign checks a group's length afterwards.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "key": r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{32,}={0,2}(?![A-Za-z0-9+/=_-])",
    "login": r"(?i)\b(?:client_?id|user(?:name)?|login|account)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{3,}|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "endpoint": r"(?i)\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|ssh|ftps?)://[^\s\"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.])",
}
KINDS = list(PATTERNS)
# Which kinds complete a weak one.
COMPLEMENTS = {"key": ["access", "login", "endpoint"], "login": ["assign", "access", "hex", "key"], "endpoint": ["assign", "access", "hex", "key"]}


def places(text: Column, kind: str) -> Column:
    """array<struct<start, kind, end>> in code points, leftmost and non-overlapping: what stands between the
    matches (split) and the matches alternate, so their lengths add up to the places."""
    p = PATTERNS[kind]
    no = F.lit(KINDS.index(kind))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    hits = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    parts = F.zip_with(F.split(text, p, -1), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("len")))
    if kind == "assign":
        parts = F.zip_with(parts, F.regexp_extract_all(text, F.lit(p), F.lit(2)), lambda x, v: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), (F.length(v) >= 6).alias("ok")))
    else:
        parts = F.transform(parts, lambda x: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), F.lit(True).alias("ok")))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + x["gap"]
        end = begin + F.coalesce(x["len"], F.lit(0))
        spans = F.when(x["len"].isNotNull() & x["ok"], F.concat(s["spans"], F.array(F.struct(begin.alias("start"), no.alias("kind"), end.alias("end"))))).otherwise(s["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    # an aggregate copies its list in every step, so runs of RUN matches are placed apart and moved by what is before them
    runs = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN).cast("int")), lambda g: F.slice(x, g * RUN + 1, F.lit(RUN)))
    local = F.transform(let(parts, runs), lambda r: F.aggregate(r, F.struct(F.lit(0).alias("at"), none.alias("spans")), step))

    def moved(x: Column) -> Column:
        before = F.aggregate(x, F.array(F.lit(0)), lambda s, r: F.concat(s, F.array(F.element_at(s, -1) + r["at"])))
        return F.flatten(F.zip_with(x, F.slice(before, 1, F.size(x)), lambda r, by: F.transform(r["spans"], lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end")))))

    return F.when(text.rlike(p), let(local, moved)).otherwise(none)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """found (doc_id, th, base, weak) -> (doc_id, th, confirmed): the weak spans with a complement in scope."""
    weak = found.where(F.size("weak") > 0).select("doc_id", "th", F.explode("weak").alias("w"), "base", "weak").select("doc_id", "th", "w")
    probe = weak.distinct().select(F.coalesce("doc_id", F.lit(-1)).alias("d"), F.col("doc_id").isNull().alias("n"), "doc_id", "th", "w", F.explode(F.sequence(F.expr(f"w.start div {scope}") - 1, F.expr(f"w.end div {scope}") + 1)).alias("bin"))
    part = found.where(F.size("weak") > 0).select("doc_id", "th", F.explode(F.concat("base", "weak")).alias("c")).distinct()
    part = part.select(F.coalesce("doc_id", F.lit(-1)).alias("d2"), F.col("doc_id").isNull().alias("n2"), F.col("th").alias("th2"), "c", F.explode(F.sequence(F.expr(f"c.start div {scope}"), F.expr(f"c.end div {scope}"))).alias("bin2"))
    fits = F.lit(False)
    for kind, others in COMPLEMENTS.items():
        fits = fits | ((F.col("w.kind") == KINDS.index(kind)) & F.col("c.kind").isin([KINDS.index(o) for o in others]))
    gap = F.greatest(F.col("c.start") - F.col("w.end"), F.col("w.start") - F.col("c.end"))
    on = (F.col("d") == F.col("d2")) & (F.col("n") == F.col("n2")) & (F.col("th") == F.col("th2")) & (F.col("bin") == F.col("bin2")) & fits & (gap <= scope)
    return probe.join(part, on, "left_semi").groupBy("d", "n", F.col("th").alias("th2")).agg(F.collect_set("w").alias("confirmed"))


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row of docs (doc_id, text); other columns are
    ignored. Null texts are empty; repeated rows stay; null doc_ids stay; an empty table gives none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text_hash().alias("th"), *[places(text, k).alias(k) for k in KINDS])
    base = F.concat("assign", "access", "hex")
    rows = rows.select("doc_id", "th", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]], F.array_sort(base).alias("base"), F.concat("key", "login", "endpoint").alias("weak"))
    rows = materialise(rows, "spans")
    known = materialise(linked(rows, scope), "linked")
    on = (F.coalesce(rows.doc_id, F.lit(-1)) == known.d) & (rows.doc_id.isNull() == known.n) & (rows.th == known.th2)
    out = rows.join(known, on, "left")
    spans = F.array_sort(F.concat("base", F.coalesce("confirmed", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(spans).alias("spans"))


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
