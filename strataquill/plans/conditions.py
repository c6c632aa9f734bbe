"""Run conditions as a relation: one row a condition; names, index names and fingerprints are columns over it."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A condition's settings where nothing else is said, and the name of the one that retrieves nothing.
SETTINGS = {"size": 1000, "overlap": 150, "percentile": 85.0, "buffer": 1, "max_chars": 2000, "min_chars": 100, "rrf_k": 60, "pool": 30, "encoder": "hashed-bag-64", "generator": "extractive-stub", "temperature": 0.0}
BASELINE = "baseline_noretrieval"
SCHEMA = "chunking string, retrieval string, k int"


def conditions(spark: SparkSession, chunking=("fixed", "semantic"), retrieval=("dense", "hybrid"), ks=(5,), baseline: bool = True, docs=(), **settings) -> DataFrame:
    """All combinations, and the baseline (no chunks, no retrieval, k 0) once. settings replace SETTINGS by name."""
    unknown = settings.keys() - SETTINGS.keys()
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    cells = [*product(chunking, retrieval, ks), *[("none", "none", 0)] * baseline]
    rows = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(c).alias("chunking"), F.lit(r).alias("retrieval"), F.lit(k).alias("k")) for c, r, k in cells])))
    rows = rows.select("*", *[F.lit(settings.get(name, value)).alias(name) for name, value in SETTINGS.items()])
    rows = rows.withColumn("docs", F.lit("-".join(sorted(docs))))
    return rows.withColumns({"condition": condition_name(), "index_name": index_name(), "fingerprint": fingerprint(rows.columns)})


def condition_name() -> Column:
    return F.when(F.col("retrieval") == "none", F.lit(BASELINE)).otherwise(F.concat_ws("_", "chunking", "retrieval", F.concat(F.lit("k"), F.col("k").cast("string"))))


def index_name() -> Column:
    """Of documents and chunking alone, so that conditions that only search differently share an index."""
    whole = F.regexp_replace(F.col("percentile").cast("string"), r"\.0$", "")
    tail = F.when(F.col("chunking") == "fixed", F.format_string("fixed_%d_%d", "size", "overlap")).when(F.col("chunking") == "semantic", F.format_string("semantic_p%s_b%d_m%d", whole, F.col("buffer"), F.col("max_chars"))).otherwise(F.col("chunking"))
    return F.concat(F.col("docs"), F.lit("__"), tail)


def fingerprint(names: list[str]) -> Column:
    """Ten digits of the hash of all settings, by name."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(names))), 256), 1, 10)


def one(spark: SparkSession, chunking: str = "fixed", retrieval: str = "dense", k: int = 5, **settings):
    """A single condition as a row."""
    return conditions(spark, (chunking,), (retrieval,), (k,), baseline=False, **settings).first()


def depths(rows: DataFrame, best: str, ks=(3, 5, 10)) -> DataFrame:
    """The condition named best at each depth of ks."""
    own = [c for c in rows.columns if c not in ("condition", "index_name", "fingerprint")]
    swept = rows.where(F.col("condition") == best).select(*own).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return swept.withColumns({"condition": condition_name(), "index_name": index_name(), "fingerprint": fingerprint(own)})


def judge_budget(samples: Column, conditions: Column, tokens_per_sample: Column, usd_per_million: float, tokens_per_day: int = 200_000) -> Column:
    """struct(total_tokens, cost_usd, days)."""
    total = samples * conditions * tokens_per_sample
    return F.struct(total.alias("total_tokens"), F.bround(total / 1e6 * usd_per_million, 2).alias("cost_usd"), F.bround(total / tokens_per_day, 1).alias("days"))
