"""License scans: phrases by place, and an exact set-similarity join of text blocks with licence templates.

A text block is any run of consecutive words that is SPAN times as long as the template, over line ends too; its set
holds its words. A template matches a block that contains at least THRESHOLD of its words, among them those that tell
it from other licences. The join: words are ordered by their frequency over all documents, rarest first. Of a template
of n words, need of which must be met, only the first n - need + 1 (its prefix) can be the rarest that a matching block
shares. Documents meet templates by equality on prefix words. Then a block goes on only if the place of its rarest
shared word in the template leaves enough words after it (positional filter) and it holds enough of the template's
words at all (length filter); those blocks are counted exactly, by a join with the template's words in their range. A
run that starts before its first template word holds no more than the one from that word on, so only those are blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataquill.llm.common import NON_ALNUM, ascii_lower, discard, materialise, text_hash

THRESHOLD, SPAN = 0.8, 1.5

# The phrases of the base rule and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Labels, licence notices in their usual wording, and the words of theirs that a block can't do without.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0", "apache"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc nc"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0"),
    ("gpl", "licensed under the gnu general public license version 3", "gnu"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    ("reserved", "copyright all rights reserved", "rights reserved"),
]


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(label, text, must) of a list of such tuples; a longer list can be given as a table of these columns."""
    return _rows(spark, ["label", "text", "must"], templates)


def _rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A small table of literals in the plan."""
    made = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*made)))


def need_of(size: int, threshold: float) -> int:
    return math.ceil(threshold * size - 1e-9)


def _normal(c: Column) -> Column:
    """The lower-cased words, each followed by one blank but the last."""
    return F.trim(F.regexp_replace(ascii_lower(c), NON_ALNUM, " "))


def _texts(words) -> Column:
    return F.array(*[F.lit(w) for w in sorted(words)]) if words else F.array().cast("array<string>")


def _phrases(n: Column) -> dict[str, Column]:
    """n_base, first_word, last_word and base (labels) from the normalised text. Where a phrase stands, the words before
    it are counted by their blanks; doubling them lets neighbouring places of a phrase be counted apart."""
    padded = F.concat(F.lit(" "), n, F.lit(" "))
    blanks = lambda c: (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")
    places, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        want = f" {phrase} "
        wide = "  ".join(["", *phrase.split(), ""])[1:-1]
        doubled = F.replace(padded, F.lit(" "), F.lit("  "))
        there = padded.contains(want)
        places.append(F.when(there, (F.length(doubled) - F.length(F.replace(doubled, F.lit(wide), F.lit("")))) / len(wide)).otherwise(0).cast("long"))
        firsts.append(F.when(there, blanks(F.substring(padded, F.lit(1), F.instr(padded, want) - 1))))
        before = F.length(padded) - (F.instr(F.reverse(padded), want[::-1]) + len(want) - 1)
        lasts.append(F.when(there, blanks(F.substring(padded, F.lit(1), before))))
        labels.append(F.when(there, F.lit(label)))
    base = F.array_sort(F.array_distinct(F.filter(F.array(*labels), lambda x: x.isNotNull())))
    return {"n_base": sum(places[1:], places[0]), "first_word": F.least(*firsts), "last_word": F.greatest(*lasts), "base": base}


def matches(bodies: DataFrame, held: DataFrame, templates: list, threshold: float = THRESHOLD, span: float = SPAN) -> DataFrame:
    """(doc_id, th, label, score) of all templates found: bodies (doc_id, th, body) are normalised texts, held (word,
    docs) the words' frequencies over all documents."""
    spark = bodies.sparkSession
    counts = {r.word: r.docs for r in held.collect()}  # one row a template word, however many documents
    rows, sizes = [], []
    for t, (label, text, must) in enumerate(templates):
        words = sorted(set(text.split()), key=lambda w: (counts.get(w, 0), w))
        need = need_of(len(words), threshold)
        sizes.append((t, label, len(words), need, len(set(must.split())), math.ceil(span * len(text.split()))))
        rows += [(t, w, i, i <= len(words) - need, w in must.split()) for i, w in enumerate(words)]
    of_words = _rows(spark, ["t", "word", "place", "prefix", "must"], rows)
    of_templates = _rows(spark, ["t", "label", "size", "need", "musts", "span"], sizes)
    key = ["doc_id", "th", "t"]
    tokens = bodies.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.struct(F.col("doc_id").isNull().alias("n"), "th").alias("th"), F.posexplode(F.split("body", " ")).alias("pos", "word"))
    known = materialise(tokens.join(of_words, "word"), "known")
    met = known.where("prefix").select(*key).distinct()
    shared = known.join(met, key, "left_semi").join(of_templates, "t")
    # in steps of a template's span the next 1 is what a block holds; the half keeps the next span's first word out
    ahead = Window.partitionBy(*key).orderBy(F.col("pos") / (F.col("span") - 0.5)).rangeBetween(0, 1)
    blocks = shared.withColumn("held", F.count("*").over(ahead)).withColumn("rarest", F.min("place").over(ahead))
    blocks = blocks.where((F.col("held") >= F.col("need")) & (F.col("size") - F.col("rarest") >= F.col("need")))
    blocks = blocks.select(*key, F.col("pos").alias("start"), "label", "size", "need", "musts", "span")
    inside = blocks.join(known.select(*key, "pos", "place", "must"), key).where("pos between start and start + span - 1")
    exact = inside.groupBy(*key, "start", "label", "size", "need", "musts").agg(F.countDistinct("place").alias("n"), F.countDistinct(F.when(F.col("must"), F.col("place"))).alias("m"))
    found = exact.where("n >= need and m = musts").groupBy("doc_id", "th", "label").agg(F.max(F.col("n") / F.col("size")).alias("score"))
    return found.select("doc_id", "th.n", "th.th", "label", "score")


def scan_licenses(docs: DataFrame, templates: DataFrame | list = TEMPLATES, threshold: float = THRESHOLD, span: float = SPAN) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, matches, labels, score) for each row of docs (doc_id,
    text); other columns are ignored. templates: (label, text, must) in a list or table; it reaches the driver.

    The texts are read once; what goes on are counts and, of documents that hold some template's telling words, the
    normalised text. Null texts are empty. Rows, repeated ones too, stay; null doc_ids stay; no rows give none.

    matches: the templates found, with the share of their words in the best block; score: the largest share, 1 where a
    phrase stands, else 0."""
    if isinstance(templates, DataFrame):
        templates = [tuple(r) for r in templates.select("label", "text", "must").collect()]
    vocabulary = {w for _, t, _ in templates for w in t.split()}
    telling = {w for _, _, m in templates for w in m.split()}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), _normal(F.coalesce("text", F.lit(""))).alias("n"))
    n, words = F.col("n"), F.split("n", " ")
    n_words = F.when(n == "", 0).otherwise(F.length(n) - F.length(F.replace(n, F.lit(" "), F.lit(""))) + 1).cast("long")
    have = F.array_intersect(_texts(vocabulary), words)
    rows = rows.select("doc_id", "th", n_words.alias("n_words"), *[c.alias(k) for k, c in _phrases(n).items()], have.alias("have"), "n")
    body = F.when(F.arrays_overlap(F.col("have"), _texts(telling)), F.col("n"))
    rows = materialise(rows.withColumn("body", body).drop("n"), "phrases")
    held = rows.select(F.explode("have").alias("word")).groupBy("word").agg(F.count("*").alias("docs"))
    bodies = rows.where("body is not null").groupBy("doc_id", "th").agg(F.first("body").alias("body"))
    found = matches(bodies, held, templates, threshold, span)
    by = found.groupBy(F.col("doc_id").alias("d"), F.col("n").alias("no"), F.col("th").alias("t")).agg(F.array_sort(F.collect_list(F.struct("label", "score"))).alias("matches"))
    by = materialise(by, "licences")
    out = rows.join(by, (F.coalesce(rows.doc_id, F.lit(-1)) == by.d) & (rows.doc_id.isNull() == by.no) & (rows.th == by.t), "left")
    out = out.withColumn("matches", F.coalesce("matches", F.array().cast("array<struct<label:string,score:double>>")))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("matches.score")), F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), "matches", F.array_join(F.array_sort(F.array_union("base", F.col("matches.label"))), ",").alias("labels"), score.alias("score"))


def op3_license(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
