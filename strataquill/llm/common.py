"""Helpers the corpus operators share: scratch tables in the shared folder, row keys, token counts."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The blanks that separate words, and the signs that separate ASCII-alphanumeric words.
BLANKS = r"[\x20\x09-\x0D]+"
NON_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Rows of one key that a join leaves to one task; a key of more is dealt into parts.
HOT = 2000

_own: list[str] = []
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where that is unset, a folder of our own, but only if driver
    and executors are one process on one machine; on a cluster that fails."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: the operators need a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="strataquill-"))
    return _own[0]


def new_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A new path in the shared folder; lasting: scratch() leaves it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not lasting:
        _made.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that materialise writes inside are deleted at the end, but for those given to the function it yields: what
    was computed from them must be written by then. Without such a block they stay, as results that are not computed yet
    read them."""
    before, kept = len(_made), []
    try:
        yield lambda df: kept.append(df._scratch)
    finally:
        mine = [p for p in _made[before:] if p not in kept]
        _made[before:] = [p for p in _made[before:] if p in kept]
        for path in mine:
            _delete(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut, and a lost executor costs no rework.

    The reread table carries its true size, so that Catalyst broadcasts it only when it is measured to be small."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by materialise that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._scratch)
        if df._scratch in _made:
            _made.remove(df._scratch)


def split_join(rows: DataFrame, keyed: DataFrame, key: str, how: str = "inner", hot: int = HOT) -> DataFrame:
    """rows joined with keyed (key, n, others), one row a key; n: how many rows have the key. keyed is a written table.

    Keys of over `hot` rows are dealt into parts, each with a copy of the keyed row, so no task gets one key whole.
    Their list is written apart (at most rows / hot keys), so that Spark broadcasts it only if it measures small."""
    parts = F.ceil(F.col("n") / hot).cast("int")
    if (keyed.agg(F.max("n")).first()[0] or 0) <= hot:
        return rows.join(keyed if how == "left_semi" else keyed.drop("n"), key, how)
    many = materialise(keyed.where(F.col("n") > hot).select(F.col(key).alias("__key"), parts.alias("__parts")), "hot")
    salt = F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("array")])
    left = rows.join(many, rows[key] == F.col("__key"), "left").drop("__key")
    left = left.withColumn("__part", F.coalesce(F.pmod(salt, F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    right = keyed.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(right if how == "left_semi" else right.drop("n"), [key, "__part"], how).drop("__part")


def as_text(values: list[bytes | None]) -> pa.Array:
    """A string column of bytes as they are; Arrow's cast would refuse those that are not UTF-8."""
    raw = pa.array(values, pa.binary())
    return pa.Array.from_buffers(pa.string(), len(raw), raw.buffers(), raw.null_count, raw.offset)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. lower() is the same for pure ASCII and much faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def words_of(c: Column, separators: str = BLANKS) -> Column:
    """The words of a text; none for null or blank texts."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), separators), lambda w: w != "")


def text_hash() -> Column:
    """With doc_id this names a row up to exact repeats, which get equal results from every operator."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row; a bare reference inside a lambda would be computed each time."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_words(c: Column) -> Column:
    """The blank-separated words of a text, without a lambda; none for null or blank texts."""
    bare = F.btrim(F.coalesce(c, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANKS))
