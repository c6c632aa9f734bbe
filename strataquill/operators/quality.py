"""Validation of evaluation rows, score matrices and scans for markers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.functions.text import locate_span, squeeze, strip
from strataquill.sources.shared import written

# The limits and types of the row validator.
TYPES = ["factual", "comparative", "multi_step"]
MIN_QUESTION, MIN_ANSWER, MIN_PASSAGE = 15, 10, 40


def issues(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(question_id, severity, message) of rows (question_id, question, question_type, reference_answer,
    gold_passages array<struct<doc_id, passage>>, verified); known: (doc_id, text).

    A row with a missing field has only those issues; a passage has only its first."""
    def make(cond, sev, msg):
        return F.when(cond, F.struct(F.lit(sev).alias("severity"), (F.lit(msg) if isinstance(msg, str) else msg).alias("message")))

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    fields = ["question_id", "question", "question_type", "reference_answer"]
    missing = [make(empty(f), "error", f"missing required field '{f}'") for f in fields]
    missing.append(make(F.coalesce(F.size("gold_passages"), F.lit(0)) <= 0, "error", "missing required field 'gold_passages'"))
    first = F.filter(F.array(*missing), lambda x: x.isNotNull())
    q, a = strip(F.col("question")), strip(F.col("reference_answer"))
    rest = F.filter(F.array(
        make(~F.col("question_type").isin(TYPES), "error", "unknown question_type"),
        make(F.length(q) < MIN_QUESTION, "warning", "question is very short"),
        make(~q.endswith("?"), "warning", "question does not end with '?'"),
        make(F.length(a) < MIN_ANSWER, "error", "reference_answer is too short"),
        make((F.col("question_type") == "multi_step") & (F.size("gold_passages") < 2), "error", "multi_step needs two gold passages"),
        make(~F.coalesce("verified", F.lit(False)), "warning", "not yet verified"),
    ), lambda x: x.isNotNull())
    every = F.when(F.size(first) > 0, first).otherwise(rest)
    of_rows = rows.select("question_id", F.explode(every).alias("x")).select("question_id", "x.*")
    passages = rows.where(F.size(first) == 0).select("question_id", F.posexplode("gold_passages").alias("i", "g"))
    passages = passages.select("question_id", "i", F.col("g.doc_id").alias("doc_id"), strip(F.coalesce("g.passage", F.lit(""))).alias("passage"))
    checked = passages.join(known.select("doc_id", "text"), "doc_id", "left")
    what = F.when(F.col("text").isNull(), "unknown doc_id").when(F.length("passage") < MIN_PASSAGE, "passage is too short").when(locate_span(F.col("text"), F.col("passage")).isNull(), "passage not found")
    of_passages = checked.select("question_id", F.lit("error").alias("severity"), F.concat(F.lit("gold_passages["), F.col("i"), F.lit("]: "), what).alias("message")).where("message is not null")
    return of_rows.unionByName(of_passages)


def resolve_spans(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(question_id, gold_idx, doc_id, start, end, locator): the place of each gold passage. Rows with errors stop it."""
    errors = issues(rows, known).where("severity = 'error'")
    n = errors.count()
    if n:
        raise ValueError(f"{n} errors in the evaluation rows, such as {[tuple(r) for r in errors.limit(5).collect()]}")
    return gold_spans(rows, known)


def gold_spans(rows: DataFrame, known: DataFrame) -> DataFrame:
    """resolve_spans without the check: passages that are not found have no row."""
    kind = rows.schema["gold_passages"].dataType.elementType.names
    locator = F.coalesce("g.locator", F.lit("")) if "locator" in kind else F.lit("")
    each = rows.select("question_id", F.posexplode("gold_passages").alias("gold_idx", "g")).select("question_id", "gold_idx", F.col("g.doc_id").alias("doc_id"), F.col("g.passage").alias("passage"), locator.alias("locator"))
    found = each.join(known.select("doc_id", "text"), "doc_id").withColumn("at", locate_span(F.col("text"), strip(F.col("passage"))))
    return found.where("at is not null").select("question_id", "gold_idx", "doc_id", "at.start", "at.end", "locator")


def summary(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(what, name, n): counts of rows, verified rows, errors and warnings (name null), rows by type, passages by document."""
    found = issues(rows, known).groupBy("severity").agg(F.count("*").alias("n"))
    totals = rows.agg(F.count("*").alias("rows"), F.count_if(F.coalesce("verified", F.lit(False))).alias("verified"))
    both = [F.struct(F.lit(c).alias("what"), F.lit(None).cast("string").alias("name"), F.col(c).alias("n")) for c in ("rows", "verified")]
    out = totals.select(F.inline(F.array(*both)))
    out = out.union(found.select(F.concat("severity", F.lit("s")), F.lit(None).cast("string"), "n"))
    out = out.union(rows.groupBy("question_type").agg(F.count("*").alias("n")).select(F.lit("type"), "question_type", "n"))
    docs = rows.select(F.explode("gold_passages").alias("g")).where("g.doc_id is not null").groupBy(F.col("g.doc_id").cast("string").alias("d")).agg(F.count("*").alias("n"))
    return out.union(docs.select(F.lit("document"), "d", "n"))


def near_duplicates(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """(key, first): later rows whose text equals an earlier one up to case and white space.

    Texts meet by digest: the first of each is found by an aggregation, and no text is sorted or moved."""
    same = written(rows.select(key, *{order} - {key}, F.md5(F.lower(squeeze(F.col(text)))).alias("norm")), "digests")
    place = F.struct(order, key)
    firsts = same.groupBy("norm").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("norm", "a", F.col(f"a.{key}").alias("first"))
    return same.join(firsts, "norm").where(place > F.col("a")).select(key, "first")


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def score_matrix(conditions: DataFrame, questions: DataFrame, metrics: DataFrame, scores: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(condition, question_id, metric, state): the expected cells and what became of them: scored, missing, nan.

    conditions, metrics: short literal tables; excluded (condition, metric) is not expected."""
    grid = F.broadcast(conditions.crossJoin(metrics))
    if excluded is not None:
        grid = F.broadcast(conditions.crossJoin(metrics).join(excluded, ["condition", "metric"], "left_anti"))
    cells = questions.select("question_id").crossJoin(grid)
    state = F.when(F.col("hit").isNull() | F.col("score").isNull(), "missing").when(F.isnan("score"), "nan").otherwise("scored")
    got = scores.select("condition", "question_id", "metric", "score").withColumn("hit", F.lit(True))
    return cells.join(got, ["condition", "question_id", "metric"], "left").select("condition", "question_id", "metric", state.alias("state"))


def nan_scores(scores: DataFrame) -> DataFrame:
    return scores.where(F.isnan("score")).select("condition", "question_id", "metric")


def orphans(scores: DataFrame, expected: DataFrame) -> DataFrame:
    return scores.join(expected, ["condition", "question_id", "metric"], "left_anti")


def missing_plan(matrix: DataFrame) -> DataFrame:
    """(condition, question_id, metrics): what is still to be computed, one row a sample."""
    todo = matrix.where("state <> 'scored'")
    return todo.groupBy("condition", "question_id").agg(F.array_sort(F.collect_list("metric")).alias("metrics"))


def first_missing(matrix: DataFrame) -> DataFrame:
    """(condition, question_id, metric): the first missing cell of each condition."""
    return matrix.where("state = 'missing'").groupBy("condition").agg(F.min(F.struct("question_id", "metric")).alias("x")).select("condition", "x.*")


def state_totals(matrix: DataFrame) -> DataFrame:
    """Counts by condition and over all (condition null)."""
    count = lambda s: F.count_if(F.col("state") == s).alias(f"n_{s}")
    return matrix.rollup("condition").agg(count("scored"), count("missing"), count("nan"), F.count("*").alias("n"))


def merged_scores(cached: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Finite new scores win over cached ones; NaN is never stored."""
    fresh = new.where(F.col("score").isNotNull() & ~F.isnan("score")).select(*keys, F.col("score").alias("fresh"))
    return cached.join(fresh, keys, "full").select(*keys, F.coalesce("fresh", "score").alias("score"))


def marker_scan(rows: DataFrame, key: str, markers: list[str]) -> DataFrame:
    """(key, marker) for each literal that a text contains; markers are a short list in the plan."""
    return rows.select(key, F.explode(F.filter(F.array(*[F.when(F.col("text").contains(m), F.lit(m)) for m in markers]), lambda m: m.isNotNull())).alias("marker"))


def coverage(evidence: DataFrame, doc: str, thin: float = 0.12, least: int = 10) -> DataFrame:
    """(doc, n, share, thin): how evidence spreads over documents."""
    by = evidence.groupBy(doc).agg(F.count("*").alias("n"))
    total = evidence.agg(F.count("*").alias("total"))
    share = by.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total"))  # one row
    return share.select(doc, "n", "share", ((F.col("share") < thin) & (F.col("total") > least)).alias("thin"))


def provenance(registry: DataFrame, report: DataFrame, default: str = "not recorded") -> DataFrame:
    """registry (doc_id, ...) with the hashes of a build report (doc_id, sha256), or the default."""
    return registry.join(report.select("doc_id", "sha256"), "doc_id", "left").withColumn("sha256", F.coalesce("sha256", F.lit(default)))
