"""Sources and sinks: page files, JSON relations, keyed caches with the key in the file name, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.functions.text import strip
from strataquill.sources.shared import written  # noqa: F401

def read_pages(spark: SparkSession, path: str, pdf_text=None) -> DataFrame:
    """(doc_id, page_no, text, source_format, sha256) of files. Text is UTF-8, bytes that are not become U+FFFD,
    cut at blank lines, blank parts dropped; a file that starts with %PDF- goes to pdf_text, an Arrow UDF of bytes to array<string>, or else fails by name."""
    files = spark.read.format("binaryFile").load(path)
    is_pdf = F.substring("content", 1, 5) == F.lit(b"%PDF-")
    whole = F.expr("make_valid_utf8(cast(content as string))")
    text = F.filter(F.split(whole, r"\n\s*\n"), lambda p: strip(p) != "")
    pdf = pdf_text(F.col("content")) if pdf_text else F.raise_error(F.concat(F.lit("no PDF reader given for "), "path")).cast("array<string>")
    pages = files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("doc_id"), F.when(is_pdf, "pdf").otherwise("text").alias("source_format"), F.sha2("content", 256).alias("sha256"), F.when(is_pdf, pdf).otherwise(text).alias("pages"))
    return pages.select("doc_id", F.posexplode("pages").alias("page_no", "text"), "source_format", "sha256")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or object file against a fixed schema; anything else fails."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(condition, question_id, metric, key_hash, score, bad) from files condition__question__metric__hash.json."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path).select("value", F.split(F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""), "__").alias("k"))
    parsed = F.from_json("value", "score double", {"mode": "PERMISSIVE", "allowNonNumericNumbers": "true"})
    return raw.select(*[F.get("k", F.lit(i)).alias(n) for i, n in enumerate(["condition", "question_id", "metric", "key_hash"])], parsed["score"].alias("score"), parsed["score"].isNull().alias("bad"))


def run_names(spark: SparkSession, path: str) -> DataFrame:
    """Distinct conditions of the run files in a folder; judge files are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select(F.col("_metadata.file_name").alias("f"))
    names = files.where(~F.col("f").contains("__ragas")).select(F.regexp_replace("f", r"\.json$", "").alias("condition")).distinct()
    return names.withColumn("k", F.nullif(F.regexp_extract("condition", r"_k(\d+)$", 1), F.lit("")).cast("int"))


def write_table(df: DataFrame, path: str, fingerprint: str, partition: list[str] | None = None, overwrite: bool = False) -> bool:
    """Write unless the table there has the same fingerprint; True if it was written. Stale tables are replaced."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not overwrite and where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        old = spark.read.parquet(path).select("fingerprint").first()
        if old is not None and old[0] == fingerprint:
            return False
    w = df.withColumn("fingerprint", F.lit(fingerprint)).write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(path)
    return True


def misses(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Rows whose key is not in the cache; null payloads count as absent."""
    return wanted.join(cache.where("payload is not null").select(key), key, "left_anti")


def log_failures(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_guarded(df: DataFrame, problems: DataFrame, path: str) -> bool:
    """Write only if there is no error among the problems."""
    if problems.where("severity = 'error'").limit(1).count():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def purge_nan(scores: DataFrame) -> DataFrame:
    return scores.where(~F.isnan("score"))


def write_json(df: DataFrame, path: str, order: list[str]) -> None:
    """A result of a few rows, in order, as one file of JSON lines."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_documents(docs: DataFrame, path: str) -> None:
    """Documents twice: all their columns as JSON lines, and their texts alone, a folder a document."""
    docs.drop("text").write.mode("overwrite").json(f"{path}/json")
    docs.select("doc_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("doc_id").option("lineSep", "\u0000").text(f"{path}/txt")


def preview(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows, for a message."""
    return df.orderBy(*order).limit(n)
