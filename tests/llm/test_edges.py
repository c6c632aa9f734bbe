"""Empty tables, nulls, bytes that are not UTF-8, repeated rows and columns with clashing names, for every operator."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

NAMES = ["op1_toxicity", "op2_tokens", "op3_license", "op4_secrets", "op5_mix", "op6_decontaminate", "op7_lines", "op8_urls", "op9_simhash", "op10_quality", "pipeline"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, docs, pages=None):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    (pages if pages is not None else spark.createDataFrame([], "page_id long, url string, html string")).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, tmp_path, name):
    from strataquill.llm.queries import QUERIES

    folder = write(spark, tmp_path, spark.createDataFrame([], DOCS))
    out = QUERIES[name](spark, folder)
    assert out.count() == 0 and out.columns


ODD = [(1, b"caf\xff broken \xc3( text of quite some words to be kept by all the rules of this and that list one day " * 2), (2, b"fine words here " * 9), (3, None), (4, b""), (None, b"\xf0\x28\x8c\xbc no id"), (2, b"fine words here " * 9), (5, b"\xff")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rows = spark.createDataFrame([(d, bytearray(t) if t is not None else None, i) for i, (d, t) in enumerate(ODD)], "doc_id long, raw binary, n_words long")
    extra = ["matches", "labels", "score", "failed", "n_lines", "spans", "items", "host", "__n", "__p", "__b", "__th", "__i", "__h", "__k", "row", "fp", "root", "evidence", "k", "th"]
    docs = rows.select("doc_id", F.expr("cast(raw as string)").alias("text"), F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(3).cast("long").alias("n_chars"), "n_words", *[F.lit("x").alias(c) for c in extra])
    return write(spark, tmp_path_factory.mktemp("odd"), docs)


@pytest.mark.parametrize("name", [n for n in NAMES if n != "op8_urls"])
def test_odd_rows(spark, odd, name):
    """Every row has its result, whatever its bytes, and repeated rows equal ones."""
    from strataquill.llm.queries import QUERIES

    out = QUERIES[name](spark, odd).collect()
    have = Counter(r.doc_id for r in out)
    if name in ("op5_mix", "pipeline"):
        assert set(have) <= {d for d, _ in ODD}
    else:
        assert have == Counter(d for d, _ in ODD)


def test_bytes_stay(spark, odd):
    """The stages of the pipeline keep columns and bytes."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd}/documents.parquet")
    raw = {(r.doc_id, r.h) for r in docs.select("doc_id", F.hex(F.col("text").cast("binary")).alias("h")).collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns
        assert {(r.doc_id, r.h) for r in out.select("doc_id", F.hex(F.col("text").cast("binary")).alias("h")).collect()} <= raw
        docs = out


def test_tokens_of_broken_bytes():
    import public_tokenizers
    from tokenizers import Tokenizer

    from strataquill.llm.op02_tokens import Encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    raw = [b"caf\xff broken \xc3( end. x\xff. \xff", b"\xe2\x82 \xf0\x28\x8c\xbc,"]
    ids, _ = Encoder(path).encode(raw)
    want = [Tokenizer.from_file(path).encode(t.decode(errors="replace"), add_special_tokens=False).ids + [2] for t in raw]
    assert ids.tolist() == sum(want, [])


def test_tokens_equal_the_library():
    """Random strings of awkward pieces, and every code point up to U+3000 before, after and between letters and stops."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from strataquill.llm.op02_tokens import Encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder, rng = Tokenizer.from_file(path), Encoder(path), random.Random(1)
    pieces = list("abcXYZ.,.,  \n\t\x0b\x0c\r'\"-_01 éßİКकिß日本") + ["<|endoftext|>", "<|", "'s", "'ll", ". ", ",", "\u0958", " ", " ", "ﬁ", "\u200b", "e\u0301", "\U0001f600", "\x1c", "\x85", ".."]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    texts += [f"{chr(c)}. a{chr(c)}b z.{chr(c)} {chr(c)}" for c in range(0x3000)]
    for i in range(0, len(texts), 500):
        some = texts[i : i + 500]
        ids, counts = encoder.encode([x.encode() for x in some])
        want = [library.encode(x, add_special_tokens=False).ids + [2] for x in some]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_scratch_is_deleted(spark):
    import os

    from strataquill.llm.common import materialise, scratch

    with scratch(spark):
        where = materialise(spark.range(3), "gone")._scratch.removeprefix("file://")
        assert os.path.isdir(where)
    assert not os.path.exists(where)
