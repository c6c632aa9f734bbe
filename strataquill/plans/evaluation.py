"""Evaluation of conditions: answers, judged scores, phrasings, summaries and paired comparisons, all as relations.

Models come in as functions of columns. A judge is judge(metric, question, answer, contexts, reference, attempt) ->
Column of doubles, NaN where it failed."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from strataquill.functions import text as T
from strataquill.operators import quality, relevance, stats
from strataquill.plans import pipelines
from strataquill.plans.conditions import BASELINE
from strataquill.sources import tables

# The metrics of a run, those a judge gives, and those of them that need retrieved contexts.
RUN_METRICS = ["precision", "recall", "rr"]
JUDGED = ["faithfulness", "answer_relevancy", "context_precision", "context_recall"]
NEED_CONTEXT = ["context_precision", "context_recall"]


def comparisons(spark: SparkSession, k: int = 5) -> DataFrame:
    """(family, a, b, metric): what is compared, as a relation. Families are corrected apart."""
    name = lambda chunking, retrieval: f"{chunking}_{retrieval}_k{k}"
    chunking = [(name("semantic", r), name("fixed", r)) for r in ("dense", "hybrid")]
    retrieval = [(name(c, "hybrid"), name(c, "dense")) for c in ("fixed", "semantic")]
    rows = [("chunking", a, b, "faithfulness") for a, b in chunking]
    rows += [("retrieval", a, b, m) for m in RUN_METRICS for a, b in retrieval]
    rows += [("contexts by retrieval", a, b, m) for m in NEED_CONTEXT for a, b in retrieval]
    rows += [("contexts by chunking", a, b, m) for m in NEED_CONTEXT for a, b in chunking]
    rows += [("any retrieval", name(c, r), BASELINE, "faithfulness") for c in ("fixed", "semantic") for r in ("dense", "hybrid")]
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("family", "a", "b", "metric"), r)]) for r in rows])))


def stub_answer(context: Column) -> Column:
    """The first extract's first sentence, or the refusal."""
    first = F.nullif(F.regexp_extract(context, r"(?s)^\[1\][^\n]*\n(.*?[.!?])(?:\s|$)", 1), F.lit(""))
    return F.coalesce(first, F.lit("The provided guideline extracts do not state this."))


def share_of(part: Column, whole: Column) -> Column:
    """The share of part's distinct words that stand in whole; NaN without words."""
    own = F.array_distinct(T.tokens(part))
    return F.when(F.size(own) == 0, F.lit(float("nan"))).otherwise(F.size(F.array_intersect(own, T.tokens(whole))) / F.size(own))


def stub_judge(metric: Column, question: Column, answer: Column, contexts: Column, reference: Column, attempt: int) -> Column:
    """Shares of words in place of a model: of the answer in the contexts, of the question in the answer, of the contexts
    in the reference, of the reference in the contexts."""
    context = F.array_join(contexts, "\n")
    return F.when(metric == "faithfulness", share_of(answer, context)).when(metric == "answer_relevancy", share_of(question, answer)).when(metric == "context_precision", share_of(context, reference)).otherwise(share_of(reference, context))


def call_ladder(call: Callable[[str, str], str], variants: Iterable[str], prompt: str, transient: Callable[[str], bool], attempts: int = 5, least: float = 4, most: float = 60, sleep=time.sleep) -> tuple[str, str]:
    """(text, variant): what a model's client returns for the first variant of a request that it accepts, for use in
    an Arrow function around the client. Errors that pass start the ladder again after a wait that doubles; those that
    stay, and empty texts, lead to the next variant; when none is left, an error names all."""
    for attempt in range(attempts):
        said = []
        for variant in variants:
            try:
                text = (call(prompt, variant) or "").strip()
            except Exception as e:  # whatever the client raises
                if transient(str(e)):
                    if attempt == attempts - 1:
                        raise
                    sleep(min(most, max(least, 2.0 ** (attempt + 1))))
                    break
                said.append(f"{variant}: {e}")
                continue
            if text:
                return text, variant
            said.append(f"{variant}: empty")
        else:
            raise RuntimeError("no variant was accepted: " + "; ".join(said))
    raise RuntimeError("unreachable")


@lru_cache(maxsize=8)
def retriever(spark: SparkSession, path: str, index_name: str, condition: Row) -> Callable[[DataFrame], DataFrame]:
    """A condition's search over a built index, kept for the last eight."""
    index = spark.read.parquet(f"{path}/index/{index_name}")
    return lambda questions: pipelines.retrieve(index, questions, condition)


def hits_of(index: DataFrame, questions: DataFrame, condition: Row, key: str = "chunk_id", lexical=None) -> DataFrame:
    """Hits with their chunks: (question_id, rank, score, key, doc_id, start, end, text)."""
    found = pipelines.retrieve(index, questions, condition, key, lexical=lexical)
    return found.join(index.select(key, "doc_id", "start", "end", "text"), key)


def answer_questions(index: DataFrame | None, questions: DataFrame, condition: Row, generate: Callable[[Column], Column] | None = None, key: str = "chunk_id") -> DataFrame:
    """questions (question_id, text) with the prompt, answer, retrieved chunks, contexts, their characters, whether it is
    a refusal, the condition and the time. generate takes the prompt; without one the stub takes the context."""
    stamp = T.utc_stamp(F.current_timestamp())
    if condition.retrieval == "none":
        out = questions.select("question_id", "text", F.lit("").alias("context"), F.array().cast(f"array<struct<rank:int,score:double,{key}:string,doc_id:long,start:long,end:long>>").alias("retrieved"), F.array().cast("array<string>").alias("contexts"), F.lit(0).cast("long").alias("context_chars"))
        prompt = T.bare_prompt(F.col("text"))
    else:
        hits = hits_of(index, questions, condition, key)
        shown = relevance.prompt_context(hits.withColumn("chunk_id", F.col(key))).drop("n_contexts")
        lists = hits.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", F.col(key).cast("string").alias(key), F.col("doc_id").cast("long").alias("doc_id"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))).alias("retrieved"), F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("x"))
        out = questions.select("question_id", "text").join(lists, "question_id").join(shown, "question_id").select("question_id", "text", "context", "retrieved", F.col("x.text").alias("contexts"), "context_chars")
        prompt = T.grounded_prompt(F.col("context"), F.col("text"))
    out = out.withColumn("prompt", prompt)
    answer = generate(F.col("prompt")) if generate else stub_answer(F.col("context"))
    return out.withColumn("answer", answer).withColumn("refusal", T.is_refusal(F.col("answer"))).withColumns({"condition": F.lit(condition.condition), "fingerprint": F.lit(condition.fingerprint), "asked_at": stamp})


def run_condition(index: DataFrame | None, questions: DataFrame, gold: DataFrame, condition: Row, min_overlap: int = 40, key: str = "chunk_id", lexical=None) -> DataFrame:
    """questions with precision, recall, rr, hit and the condition; all null for the condition without retrieval."""
    if condition.retrieval == "none":
        nothing = [F.lit(None).cast("double").alias(c) for c in RUN_METRICS]
        return questions.select("*", *nothing, F.lit(None).cast("boolean").alias("hit"), F.lit(condition.condition).alias("condition"))
    hits = tables.written(hits_of(index, questions, condition, key, lexical).drop("text"), "hits")
    return relevance.question_metrics(questions, hits, gold, condition.k, min_overlap).withColumn("condition", F.lit(condition.condition))


def generate_phase(indexes: dict[str, DataFrame], questions: DataFrame, gold: DataFrame, chosen: DataFrame, path: str, generate=None) -> list[str]:
    """Answers and metrics of the conditions in chosen, a table each under path; one that is there with the same
    fingerprint stays. Returns the names of those that were computed."""
    done = []
    for c in chosen.collect():  # a handful of rows
        index = indexes.get(c.index_name)
        asked = answer_questions(index, questions, c, generate).drop("asked_at", "fingerprint")
        measured = run_condition(index, questions.select("question_id", "text"), gold, c).drop("condition", "text")
        if tables.write_table(asked.join(measured, "question_id"), f"{path}/{c.condition}", c.fingerprint):
            done.append(c.condition)
    return done


def require_known(results: DataFrame, questions: DataFrame) -> None:
    """Answers to questions that the set doesn't have stop the scoring."""
    strange = results.join(questions, "question_id", "left_anti").select("question_id")
    n = strange.count()
    if n:
        raise KeyError(f"{n} answered questions are not in the set: {[r[0] for r in strange.orderBy('question_id').limit(5).collect()]}")


def score_condition(results: DataFrame, questions: DataFrame, cached: DataFrame, metrics: list[str], judge=stub_judge, limit: int | None = None) -> DataFrame:
    """(condition, question_id, metric, score, from_cache, scored_now): one row for every answer and metric.

    results: (condition, question_id, answer, contexts); questions: (question_id, question, reference_answer); cached:
    (condition, question_id, metric, score). Cached finite scores stay; only missing metrics are judged, of the first
    `limit` answers that miss any (by question_id, in each condition); the rest go along with what they have. NaN is
    judged once more and else left null. Metrics of contexts don't apply to the condition without retrieval."""
    require_known(results, questions)
    asked = results.withColumn("metric", F.explode(F.array(*[F.lit(m) for m in metrics])))
    asked = asked.where(~((F.col("condition") == BASELINE) & F.col("metric").isin(NEED_CONTEXT)))
    key = ["condition", "question_id", "metric"]
    held = cached.where("score is not null and not isnan(score)").groupBy(*key).agg(F.max("score").alias("held"))
    rows = asked.join(held, key, "left").join(questions.select("question_id", "question", "reference_answer"), "question_id")
    missing = rows.where("held is null").select("condition", "question_id").distinct()
    place = F.row_number().over(Window.partitionBy("condition").orderBy("question_id"))
    todo = missing.withColumn("place", place).where(F.lit(True) if limit is None else F.col("place") <= limit).select("condition", "question_id", F.lit(True).alias("now"))
    rows = rows.join(todo, ["condition", "question_id"], "left").withColumn("now", F.coalesce("now", F.lit(False)) & F.col("held").isNull())
    given = lambda attempt: judge(F.col("metric"), F.col("question"), F.col("answer"), F.when(F.size("contexts") > 0, F.col("contexts")).otherwise(F.array(F.lit(""))), F.col("reference_answer"), attempt)
    rows = rows.withColumn("first", F.when(F.col("now"), given(1)))
    rows = rows.withColumn("again", F.when(F.col("now") & (F.col("first").isNull() | F.isnan("first")), given(2)))
    fresh = F.when(~F.isnan("first"), F.col("first")).otherwise(F.when(~F.isnan("again"), F.col("again")))
    return rows.select(*key, F.coalesce("held", fresh).alias("score"), F.col("held").isNotNull().alias("from_cache"), F.col("now").alias("scored_now"))


def score_phase(path: str, results: DataFrame, questions: DataFrame, metrics: list[str], judge=stub_judge, limit: int | None = None) -> DataFrame:
    """score_condition against the cache table under path, to which finite new scores are appended; scores that could
    not be had are logged beside it. Returns the records."""
    spark = results.sparkSession
    schema = "condition string, question_id long, metric string, score double"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/scores")
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    cached = spark.read.schema(schema).parquet(f"{path}/scores") if there else spark.createDataFrame([], schema)
    records = tables.written(score_condition(results, questions, cached, metrics, judge, limit), "records")
    records.where("scored_now and score is not null").select("condition", F.col("question_id").cast("long"), "metric", "score").write.mode("append").parquet(f"{path}/scores")
    tables.log_failures(records.where("scored_now and score is null").select("condition", "question_id", "metric", T.utc_stamp(F.current_timestamp()).alias("at")), f"{path}/failures")
    return records


def long_scores(runs: DataFrame, judged: DataFrame) -> DataFrame:
    """(condition, question_id, metric, value) of run metrics and judged ones; nulls have no row, NaN has."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in RUN_METRICS])
    of_runs = runs.select("condition", "question_id", F.inline(each))
    of_judge = judged.select("condition", "question_id", "metric", F.col("score").cast("double").alias("value"))
    return of_runs.unionByName(of_judge).where("value is not null")


def write_summary(scores: DataFrame) -> DataFrame:
    """(condition, <metric>, <metric>_n ...): means and numbers of values, a row a condition."""
    wide = scores.groupBy("condition").pivot("metric", [*RUN_METRICS, *JUDGED]).agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    return wide.select("condition", *[c for m in [*RUN_METRICS, *JUDGED] for c in (F.col(f"{m}_mean").alias(m), F.col(f"{m}_n"))])


def observed(scores: DataFrame, metric: str = "precision") -> DataFrame:
    """(condition, observed): the mean of a metric; conditions without values have no row."""
    return scores.where(F.col("metric") == metric).groupBy("condition").agg(F.avg("value").alias("observed"))


def attainments(chosen: DataFrame, ceilings: DataFrame, scores: DataFrame) -> DataFrame:
    """(condition, ceiling, observed, attainment): what conditions (condition, chunking) reach of what the chunking
    (chunking, ceiling) allows; observed is null for a condition without a run."""
    out = chosen.join(ceilings, "chunking").join(observed(scores), "condition", "left")
    return out.select("condition", "ceiling", "observed", relevance.attainment(F.col("observed"), F.col("ceiling")).alias("attainment"))


def compare(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """(family, a, b, metric, x, y, diff): a row for each comparison of wanted and question that both conditions have."""
    a = scores.select(F.col("condition").alias("a"), "question_id", "metric", F.col("value").alias("x"))
    b = scores.select(F.col("condition").alias("b"), "question_id", "metric", F.col("value").alias("y"))
    both = wanted.join(a, ["a", "metric"]).join(b, ["b", "metric", "question_id"])
    return both.select("family", "a", "b", "metric", "x", "y", (F.col("x") - F.col("y")).alias("diff"))


def analyse(scores: DataFrame, wanted: DataFrame, alpha: float = 0.05, n_boot: int = 5000) -> DataFrame:
    """One row a comparison of at least six pairs: sizes, means, upper median of the differences, effect and its interval,
    W, p, p by Holm within the family, and whether that is below alpha."""
    key = F.concat_ws("|", "family", "a", "b", "metric")
    pairs = tables.written(compare(scores, wanted).withColumn("id", key), "pairs")
    out = stats.effects(pairs, "id").join(stats.wilcoxon(pairs, "id").select("id", "w", "z", "p"), "id").join(stats.bootstrap_ci(pairs, "id", n_boot), "id")
    out = wanted.withColumn("id", key).join(out, "id")
    return stats.holm(out, "p", "family").withColumn("significant", F.col("p_holm") < alpha).drop("id")


def phrasings(questions: DataFrame, probes: DataFrame) -> DataFrame:
    """(question_id, question_type, label, text) of probes (question_id, paraphrases): each question as it is and as each
    paraphrase. Probes of unknown questions are left out."""
    every = questions.join(probes.select("question_id", "paraphrases"), "question_id").select("question_id", "question_type", F.posexplode(F.concat(F.array("text"), "paraphrases")).alias("i", "text"))
    return every.select("question_id", "question_type", F.when(F.col("i") == 0, "original").otherwise(F.concat(F.lit("paraphrase_"), "i")).alias("label"), "text")


def evaluate_phrasings(search: Callable[[DataFrame], DataFrame], questions: DataFrame, probes: DataFrame, gold: DataFrame, k: int, min_overlap: int = 40) -> DataFrame:
    """(question_id, question_type, label, recall, doc_hit, gap, top_score) of each phrasing. search: (question_id, text)
    to hits with doc_id, start, end, rank, score."""
    each = phrasings(questions, probes).withColumn("asked", F.concat_ws("#", F.col("question_id").cast("string"), "label"))
    hits = tables.written(search(each.select(F.col("asked").alias("question_id"), "text")).select("question_id", "doc_id", "start", "end", "rank", "score"), "hits")
    spans = each.select("question_id", "asked").join(gold, "question_id").drop("question_id").withColumnRenamed("asked", "question_id")
    asked = each.select(F.col("asked").alias("question_id"))
    recall = relevance.question_metrics(asked, hits, spans, k, min_overlap).select(F.col("question_id").alias("asked"), "recall")
    gaps = relevance.nearest_gap(asked, hits, spans).withColumnRenamed("question_id", "asked")
    tops = hits.where("rank = 1").select(F.col("question_id").alias("asked"), F.col("score").alias("top_score"))
    out = each.drop("text").join(recall, "asked").join(gaps, "asked").join(tops, "asked", "left")
    return out.select("question_id", "question_type", "label", "recall", "doc_hit", "gap", "top_score")


def unscored(scores: DataFrame, answers: DataFrame) -> DataFrame:
    """(condition, question_id, metric, refusal): scores that are NaN, with whether the answer was a refusal, which no
    judge can score."""
    return quality.nan_scores(scores).join(answers.select("condition", "question_id", T.is_refusal(F.col("answer")).alias("refusal")), ["condition", "question_id"])
