"""Composite operators: ingestion, chunks, index build, retrieval; external models come in as functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from strataquill.functions import text as T
from strataquill.functions.vectors import hashed_bag
from strataquill.operators import search, segment
from strataquill.plans.conditions import one
from strataquill.sources.tables import write_table


def encode(c: Column) -> Column:
    """The offline text encoder."""
    return hashed_bag(F.coalesce(T.tokens(c), F.array().cast("array<string>")))


def ingest(pages: DataFrame, patterns: list[tuple[str, str]] = (), threshold: float = 0.5) -> DataFrame:
    """pages (doc_id, page_no, text) -> documents (doc_id, text, n_pages, n_chars_raw, n_chars_clean, pct_retained,
    n_footers_removed, n_furniture_lines, published, updated): cleaned, reflowed, blocks parted by blank lines; the dates
    are those of the first two pages."""
    tidy = pages.withColumn("plain", T.normalise(F.col("text")))
    head = F.when(F.col("page_no") < 2, F.col("plain"))
    footers = T.count_blocks(F.col("plain"), patterns[0][0]) if patterns else F.lit(0)
    dates = [F.min_by(T.dated(head, label), F.when(T.dated(head, label).isNotNull(), F.col("page_no"))).alias(name) for label, name in (("Published:", "published"), ("Last updated:", "updated"))]
    sizes = tidy.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(F.length("text")).cast("long").alias("n_chars_raw"), F.sum(footers).cast("long").alias("n_footers_removed"), *dates)
    tidy = tidy.withColumn("text", T.strip_blocks(F.col("plain"), list(patterns)))
    furn = segment.furniture(tidy, threshold)
    lines = segment.clean_lines(tidy, furn)
    whole = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "line_no", "line"))).alias("x")).select("doc_id", F.array_join("x.line", "\n").alias("text"))
    blocks = segment.reflow(whole).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("x")).select("doc_id", F.array_join("x.text", "\n\n").alias("text"))
    n_furn = furn.groupBy("doc_id").agg(F.count("*").alias("n_furniture_lines"))
    out = blocks.join(sizes, "doc_id").join(n_furn, "doc_id", "left").withColumn("n_chars_clean", F.length("text"))
    return out.withColumn("n_furniture_lines", F.coalesce("n_furniture_lines", F.lit(0))).withColumn("pct_retained", F.bround(100 * F.col("n_chars_clean") / F.col("n_chars_raw"), 1))


def build_chunks(docs: DataFrame, condition: Row | None = None, encode_fn=encode) -> DataFrame:
    """(chunk_id, doc_id, ordinal, start, end, n_chars, text, strategy) as a condition (a row of conditions()) says."""
    c = condition or one(docs.sparkSession)
    if c.chunking == "fixed":
        spans = segment.chunk_fixed(docs, c["size"], c["overlap"]).select("doc_id", "start", "end")
    elif c.chunking == "semantic":
        spans = segment.chunk_semantic(docs, encode_fn, c["percentile"], c["buffer"], c["max_chars"])
    else:
        raise ValueError(f"unknown chunking strategy {c.chunking!r}")
    merged = segment.merge_undersized(spans, c["min_chars"])
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1
    rows = merged.withColumn("ordinal", n).join(docs.select("doc_id", F.col("text").alias("__t")), "doc_id")
    body = F.expr("substring(__t, int(start) + 1, int(end - start))")
    return rows.select(T.chunk_id(F.col("doc_id"), c.chunking, F.col("ordinal")).alias("chunk_id"), "doc_id", "ordinal", "start", "end", F.length(body).alias("n_chars"), body.alias("text"), F.lit(c.chunking).alias("strategy"))


def encode_query(c: Column, prefix: str = "", encode_fn=encode) -> Column:
    """A question's vector: some encoders want questions, and only them, after a prefix."""
    return encode_fn(F.concat(F.lit(prefix), c))


def build_index(chunks: DataFrame, encode_fn=encode, dims: int = 64) -> DataFrame:
    """chunks with `embedding`; the vector lies in the chunk's row, and a wrong size fails."""
    v = chunks.withColumn("embedding", encode_fn(F.col("text")))  # a filter on it would encode each text twice
    return v.withColumn("embedding", F.when(F.size("embedding") == dims, F.col("embedding")).otherwise(F.raise_error(F.lit("embedding has a wrong dimension"))))


def retrieve(index: DataFrame, questions: DataFrame, condition: Row, key: str = "chunk_id", encode_fn=encode, lexical=None, prefix: str = "") -> DataFrame:
    """Hits (question_id, key, score, rank, ...). lexical: a kept TextIndex over the index's texts, if there is one."""
    asked = questions.withColumn("embedding", encode_query(F.col("text"), prefix, encode_fn))
    if condition.retrieval == "dense":
        return search.dense(index, asked, condition.k, key)
    if condition.retrieval == "hybrid":
        return search.hybrid(lexical or index.select(key, "text"), index, questions, asked, condition.k, key, condition.pool, condition.rrf_k)
    raise ValueError(f"unknown retrieval method {condition.retrieval!r}")


def build_all(spark: SparkSession, pages: DataFrame, path: str, patterns=(), overwrite: bool = False, encode_fn=encode) -> DataFrame:
    """Documents and the index of each chunking strategy as tables under path, each written if it is not there with the
    same settings. Returns the report: (strategy, index_name, n_chunks, distinct), distinct false where two strategies
    have numbers of chunks within a twentieth of each other, as if one of them had not run."""
    write_table(ingest(pages, patterns), f"{path}/documents", "documents", overwrite=overwrite)
    docs = spark.read.parquet(f"{path}/documents").select("doc_id", "text")
    names = [r.doc_id for r in docs.select(F.col("doc_id").cast("string")).distinct().orderBy("doc_id").limit(100).collect()]
    rows = []
    for strategy in ("fixed", "semantic"):
        c = one(spark, strategy, docs=names)
        write_table(build_index(build_chunks(docs, c, encode_fn), encode_fn), f"{path}/index/{c.index_name}", c.fingerprint, overwrite=overwrite)
        n = spark.read.parquet(f"{path}/index/{c.index_name}").count()
        rows.append((strategy, c.index_name, n))
    counts = [n for _, _, n in rows]
    distinct = max(counts) - min(counts) >= 0.05 * max(*counts, 1)
    return spark.createDataFrame([(*r, distinct) for r in rows], "strategy string, index_name string, n_chunks long, distinct boolean")


def calibrate(profile: DataFrame, group: str, order: str, percentiles: list[float], target: float) -> DataFrame:
    """(percentile, n, mean_size, ratio, best): segments per percentile over one distance profile; best is nearest to
    the target mean, the first on ties."""
    limits = profile.groupBy(group).agg(F.percentile("dist", F.array(*[F.lit(p / 100) for p in percentiles])).alias("q"))
    limits = limits.select(group, F.posexplode("q").alias("i", "limit"))
    cut = (F.round("dist", 9) > F.round("limit", 9)).cast("int")
    per = profile.join(limits, group).groupBy("i", group).agg((F.coalesce(F.sum(cut), F.lit(0)) + 1).alias("segments"), F.count("*").alias("items"))
    out = per.groupBy("i").agg(F.sum("segments").alias("n"), (F.sum("items") / F.sum("segments")).alias("mean_size"))
    names = F.element_at(F.array(*[F.lit(float(p)) for p in percentiles]), F.col("i") + 1)
    out = out.select("i", names.alias("percentile"), "n", "mean_size", (F.col("mean_size") / target).alias("ratio"))
    best = out.agg(F.min_by("i", F.struct(F.abs(F.col("ratio") - 1), "i")).alias("best_i"))
    return out.join(F.broadcast(best)).select("percentile", "n", "mean_size", "ratio", (F.col("i") == F.col("best_i")).alias("best"))
