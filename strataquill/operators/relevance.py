"""Relevance by interval overlap, and retrieval metrics. Gold: (question_id, gold_idx, doc_id, start, end); hits:
(question_id, doc_id, start, end, rank). Every overlap join is led by equality on question and document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquill.functions.text import overlap, strip, tokens
from strataquill.operators.search import TextIndex, TextScan
from strataquill.sources.shared import new_path, written

#: Pairs of questions and documents up to this number travel to the documents' texts; more are met by a shuffle.
TRAVEL = 1_000_000


def locate_gold(items: DataFrame, docs: DataFrame, index: TextIndex | TextScan | None = None, probe: int = 24) -> DataFrame:
    """(question_id, gold_idx, doc_id, start, end): the leftmost place of each item's text in each document.

    A document that holds an item holds all its words but for the first and last, which may go on. So items meet
    documents by equality on the rarest of these words, with the postings of a kept index or scan of docs or of a new scan,
    and what meets is verified. Items of fewer than three words meet them on their first characters instead."""
    asked = items.select("question_id", F.col("text").alias("item"), tokens(F.col("text")).alias("t")).where("item <> ''")
    inner = asked.where(F.size("t") > 2).select("question_id", F.explode(F.array_distinct(F.slice("t", 2, F.size("t") - 2))).alias("term"))
    index = index or TextScan(docs.select("doc_id", "text"), "doc_id", new_path(docs.sparkSession, "terms"))
    rarest = inner.join(index.frequencies(inner), "term").groupBy("question_id").agg(F.min_by("term", F.struct("n", "term")).alias("term"))
    rarest = written(rarest, "rarest")
    found = rarest.join(index.postings(rarest).select(F.col(index.key).alias("doc_id"), "term"), "term").select("question_id", "doc_id")
    short = asked.where(F.size("t") <= 2)
    least = short.agg(F.min(F.length("item"))).first()[0]
    if least is not None:
        size = min(probe, least)
        starts = F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - size + 1, F.lit(1))), lambda i: F.substring("text", i, F.lit(size)))
        grams = docs.select("doc_id", F.explode(F.array_distinct(starts)).alias("gram"))
        found = found.union(grams.join(short.select("question_id", F.substring("item", 1, size).alias("gram")), "gram").select("question_id", "doc_id"))
    found = written(found, "found")
    if found.count() <= TRAVEL:
        found = F.broadcast(found)  # the texts stay where they lie
    pairs = docs.select("doc_id", "text").join(found, "doc_id").join(asked.select("question_id", "item"), "question_id")
    at = F.position("item", "text") - 1
    spans = pairs.select("question_id", "doc_id", at.alias("start"), (at + F.length("item")).alias("end")).where("start >= 0")
    return spans.withColumn("gold_idx", F.row_number().over(Window.partitionBy("question_id").orderBy("doc_id")) - 1)


def _meets(min_overlap: int) -> Column:
    h, g = F.col, lambda c: F.col(f"g.{c}")
    return (h("h.question_id") == g("question_id")) & (h("h.doc_id") == g("doc_id")) & (overlap(h("h.start"), h("h.end"), g("start"), g("end")) >= min_overlap)


def relevant_hits(hits: DataFrame, gold: DataFrame, min_overlap: int) -> DataFrame:
    """Left semi join: the hits that overlap some gold span."""
    return hits.alias("h").join(gold.alias("g"), _meets(min_overlap), "left_semi")


def covered_gold(hits: DataFrame, gold: DataFrame, min_overlap: int) -> DataFrame:
    """Distinct (question_id, gold_idx) that some hit overlaps, with the best rank."""
    pairs = hits.alias("h").join(gold.alias("g"), _meets(min_overlap))
    return pairs.groupBy("g.question_id", "g.gold_idx").agg(F.min("h.rank").alias("rank"))


def flags(hits: DataFrame, gold: DataFrame, min_overlap: int) -> DataFrame:
    """All hits with `relevant`."""
    keys = relevant_hits(hits, gold, min_overlap).select("question_id", "rank").withColumn("relevant", F.lit(True))
    return hits.join(keys, ["question_id", "rank"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))


def question_metrics(questions: DataFrame, hits: DataFrame, gold: DataFrame, k: int, min_overlap: int) -> DataFrame:
    """questions with precision (over k, not over what came back), recall (of gold spans; 0 without gold), reciprocal
    rank (over all hits) and hit. k <= 0 gives precision 0."""
    flagged = flags(hits, gold, min_overlap).groupBy("question_id").agg(
        F.count_if(F.col("relevant") & (F.col("rank") <= k)).alias("n_rel"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    covered = covered_gold(hits, gold, min_overlap).where(F.col("rank") <= k).groupBy("question_id").agg(F.count("*").alias("n_cov"))
    sizes = gold.groupBy("question_id").agg(F.count("*").alias("n_gold"))
    out = questions.join(flagged, "question_id", "left").join(covered, "question_id", "left").join(sizes, "question_id", "left")
    precision = F.coalesce("n_rel", F.lit(0)) / F.lit(k) if k > 0 else F.lit(0.0)
    return out.select(*questions.columns, precision.cast("double").alias("precision"), F.coalesce(F.coalesce("n_cov", F.lit(0)) / F.col("n_gold"), F.lit(0.0)).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), (F.coalesce("n_rel", F.lit(0)) > 0).alias("hit"))


def summarise(metrics: DataFrame, by: str) -> DataFrame:
    """Means, sample deviations (0 for one row) and hit rates, by group and over all (group null), in one pass."""
    aggs = [F.count("*").alias("n"), F.avg(F.col("hit").cast("int")).alias("hit_rate")]
    for m, name in (("precision", "precision"), ("recall", "recall"), ("rr", "mrr")):
        aggs += [F.avg(m).alias(name), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{name}_sd")]
    return metrics.groupingSets([[F.col(by)], []], F.col(by)).agg(*aggs)


def precision_ceiling(questions: DataFrame, chunks: DataFrame, gold: DataFrame, k: int, min_overlap: int) -> DataFrame:
    """(question_id, n_relevant, ceiling): relevant chunks in the whole corpus, and the best precision they allow."""
    g, c = gold.alias("g"), chunks.alias("c")
    on = (F.col("g.doc_id") == F.col("c.doc_id")) & (overlap(F.col("c.start"), F.col("c.end"), F.col("g.start"), F.col("g.end")) >= min_overlap)
    counts = g.join(c, on).groupBy("g.question_id").agg(F.countDistinct("c.doc_id", "c.start").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return questions.select("question_id").join(counts, "question_id", "left").select("question_id", n.alias("n_relevant"), (F.least(n, F.lit(k)) / k).alias("ceiling"))


def attainment(observed: Column, ceiling: Column) -> Column:
    return F.when(ceiling == 0, F.lit(float("nan"))).otherwise(observed / ceiling)


def nearest_gap(questions: DataFrame, hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(question_id, doc_hit, gap): least distance between a hit and a gold span of one document; 0 if they meet, null
    without a shared document."""
    on = (F.col("h.question_id") == F.col("g.question_id")) & (F.col("h.doc_id") == F.col("g.doc_id"))
    gap = F.greatest(F.lit(0), F.col("g.start") - F.col("h.end"), F.col("h.start") - F.col("g.end"))
    near = hits.alias("h").join(gold.alias("g"), on).groupBy("h.question_id").agg(F.min(gap).alias("gap"))
    return questions.select("question_id").join(near, "question_id", "left").select("question_id", F.col("gap").isNotNull().alias("doc_hit"), "gap")


def prompt_context(hits: DataFrame) -> DataFrame:
    """(question_id, context, n_contexts, context_chars) from hits (question_id, rank, doc_id, chunk_id, text)."""
    block = F.format_string("[%d] (source: %s, chunk %s)\n%s", F.col("rank"), F.col("doc_id").cast("string"), F.col("chunk_id").cast("string"), strip(F.col("text")))
    got = hits.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("x"), F.sum(F.length("text")).alias("context_chars"), F.count("*").alias("n_contexts"))
    return got.select("question_id", F.array_join("x.b", "\n\n").alias("context"), "n_contexts", "context_chars")


def relevant_distribution(counts: DataFrame, value: str = "n_relevant") -> DataFrame:
    """(least, mean, most, n_zero) of the relevant chunks a question has."""
    return counts.agg(F.min(value).alias("least"), F.avg(value).alias("mean"), F.max(value).alias("most"), F.count_if(F.col(value) == 0).alias("n_zero"))


def paraphrase_rollup(results: DataFrame) -> DataFrame:
    """results (question_id, label, recall, doc_hit, gap) -> (label, mean_recall, doc_hit_rate, median_gap, mean_delta)
    with deltas against the label 'original' of the same question; one row for every label of any question."""
    base = results.where("label = 'original'").select("question_id", F.col("recall").alias("base"))
    both = results.join(base, "question_id", "left")
    return both.groupBy("label").agg(F.bround(F.avg("recall"), 3).alias("mean_recall"), F.bround(F.avg(F.col("doc_hit").cast("int")), 3).alias("doc_hit_rate"), F.median("gap").alias("median_gap"), F.bround(F.avg(F.col("recall") - F.col("base")), 3).alias("mean_delta"))


def paraphrase_deltas(results: DataFrame) -> DataFrame:
    """(question_id, delta, verdict): how far the mean recall of a question's paraphrases lies from the original's."""
    other = F.col("label") != "original"
    by = results.groupBy("question_id").agg((F.avg(F.when(other, F.col("recall"))) - F.max(F.when(~other, F.col("recall")))).alias("delta"))
    return by.withColumn("verdict", drop_verdict(F.col("delta")))


def drop_verdict(delta: Column) -> Column:
    return F.when(delta < -0.15, "fragile").when(delta < -0.05, "moderate").otherwise("robust")


def worst(deltas: DataFrame, n: int = 5) -> DataFrame:
    """The n questions that lose most."""
    return deltas.orderBy("delta", "question_id").limit(n)
