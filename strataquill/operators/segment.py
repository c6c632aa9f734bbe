"""Segmentation: lines, blocks, sentences, fixed and semantic chunks with exact offsets."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquill.functions import text as T


def furniture(pages: DataFrame, threshold: float = 0.5, max_len: int = 120) -> DataFrame:
    """(doc_id, line, n_pages) of lines that repeat over pages (doc_id, page_no, text): short stripped lines, counted
    once a page, on at least max(2, threshold of the pages)."""
    lines = pages.select("doc_id", "page_no", F.explode(T.lines(F.col("text"))).alias("line")).withColumn("line", T.strip(F.col("line")))
    counts = lines.where((F.col("line") != "") & (F.length("line") <= max_len)).distinct().groupBy("doc_id", "line").agg(F.count("*").alias("n_pages"))
    sizes = pages.groupBy("doc_id").agg(F.floor(F.count("*") * threshold).alias("half"))
    return counts.join(sizes, "doc_id").where(F.col("n_pages") >= F.greatest(F.lit(2), "half")).select("doc_id", "line", "n_pages")


def clean_lines(pages: DataFrame, furn: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, line) without furniture and page numbers; bullets become '- '; blank lines stay."""
    lines = pages.select("doc_id", "page_no", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line")).withColumn("line", T.strip(F.col("line")))
    kept = lines.where(~F.col("line").rlike(T.PAGE_NUMBER)).join(furn.select("doc_id", "line"), ["doc_id", "line"], "left_anti")
    return kept.select("doc_id", "page_no", "line_no", F.regexp_replace("line", T.BULLET, "- ").alias("line"))


def reflow(docs: DataFrame) -> DataFrame:
    """(doc_id, block_no, text): lines joined into blocks. A line opens a block after a blank line, at the start, or
    if it looks like one (a running sum of openings numbers the blocks)."""
    lines = docs.select("doc_id", F.posexplode(F.split(T.join_hyphens(F.col("text")), "\n")).alias("n", "line")).withColumn("line", T.strip(F.col("line")))
    w = Window.partitionBy("doc_id").orderBy("n")
    opens = F.coalesce(F.lag("line").over(w) == "", F.lit(True)) | F.col("line").rlike(T.BLOCK_START)
    marked = lines.withColumn("open", (opens & (F.col("line") != "")).cast("int")).withColumn("block_no", F.sum("open").over(w))
    joined = marked.where("line <> ''").groupBy("doc_id", "block_no").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("x"))
    return joined.select("doc_id", "block_no", F.regexp_replace(F.array_join(F.col("x.line"), " "), "[ \t]{2,}", " ").alias("text"))


def sentence_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_no, start, end): paragraphs end sentences, and so do .!? before white space. A mark is put before
    such white space, so that the lengths of the pieces add up to the offsets."""
    w = Window.partitionBy("doc_id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    paras = docs.select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("p", "para"))
    paras = paras.withColumn("at", F.coalesce(F.sum(F.length("para") + 2).over(w), F.lit(0)))
    marked = F.split(F.regexp_replace("para", r"([.!?])(\s+)", "$1\u0001$2"), "\u0001")
    pieces = paras.select("doc_id", "p", "at", F.posexplode(marked).alias("i", "piece"))
    w = Window.partitionBy("doc_id", "p").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("off", F.col("at") + F.coalesce(F.sum(F.length("piece")).over(w), F.lit(0)))
    lead = F.when(F.col("i") > 0, F.length("piece") - F.length(F.regexp_replace("piece", r"^\s+", ""))).otherwise(0)
    spans = pieces.where(F.col("piece").rlike(r"\S")).select("doc_id", (F.col("off") + lead).cast("long").alias("start"), (F.col("off") + F.length("piece")).cast("long").alias("end"))
    return spans.withColumn("sent_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1)


def context_windows(sentences: DataFrame, buffer: int = 1) -> DataFrame:
    """sentences (doc_id, sent_no, sentence) with `context`: each with its neighbours, joined by blanks."""
    w = Window.partitionBy("doc_id").orderBy("sent_no").rowsBetween(-buffer, buffer)
    return sentences.withColumn("context", F.array_join(F.collect_list("sentence").over(w), " "))


def distance_profile(vectors: DataFrame, group: str, order: str, product) -> DataFrame:
    """vectors with `dist`: one minus the product with the next vector of the group; null for the last."""
    w = Window.partitionBy(group).orderBy(order)
    return vectors.withColumn("dist", 1 - product(F.col("embedding"), F.lead("embedding").over(w)))


def breakpoints(profile: DataFrame, group: str, order: str, percentile: float) -> DataFrame:
    """profile with `segment`: a new one starts after each distance strictly above the group's percentile (linear)."""
    limits = profile.groupBy(group).agg(F.percentile("dist", F.lit(percentile / 100)).alias("limit"))
    w = Window.partitionBy(group).orderBy(order)
    cut = F.coalesce((F.round(F.lag("dist").over(w), 9) > F.round("limit", 9)).cast("int"), F.lit(0))
    return profile.join(limits, group).withColumn("cut", cut).withColumn("segment", F.sum("cut").over(w)).drop("cut")


def merge_undersized(chunks: DataFrame, min_chars: int, order: str = "start") -> DataFrame:
    """(doc_id, start, end) from chunks (doc_id, start, end): short chunks join the one before (running sum of long
    ones), and a short first group joins its successor, with the successor's end."""
    w = Window.partitionBy("doc_id").orderBy(order)
    long = (F.col("end") - F.col("start") >= min_chars) | (F.row_number().over(w) == 1)
    groups = chunks.withColumn("long", long.cast("int")).withColumn("g", F.sum("long").over(w))
    merged = groups.groupBy("doc_id", "g").agg(F.min_by("start", order).alias("start"), F.max("end").alias("end"))
    w = Window.partitionBy("doc_id").orderBy("g")
    merged = merged.withColumn("next", F.lead("end").over(w)).withColumn("before", F.lag("end").over(w) - F.lag("start").over(w))
    merged = merged.withColumn("prev_start", F.lag("start").over(w))
    folded = (F.col("g") == 1) & (F.col("end") - F.col("start") < min_chars) & F.col("next").isNotNull()
    takes = (F.col("g") == 2) & (F.col("before") < min_chars)
    start = F.when(takes, F.col("prev_start")).otherwise(F.col("start"))
    return merged.where(~folded).select("doc_id", start.alias("start"), "end")


def halve(text: str, start: int, end: int, most: int) -> list[tuple[int, int]]:
    """Spans of at most `most` characters: cut at the last blank within 200 of the middle, else in the middle."""
    todo, out = [(start, end)], []
    while todo:
        s, e = todo.pop()
        if e - s <= most:
            out.append((s, e))
            continue
        mid = (s + e) // 2
        low = max(s, mid - 200)
        cut = text.rfind(" ", low, min(e, mid + 200))
        if cut <= low or not s < cut < e:
            cut = mid
        todo += [(cut, e), (s, cut)]
    return out


# Separators from coarse to fine.
SEPARATORS = ["\n\n", "\n", ". ", " ", ""]


def fixed_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of at most `size` characters that overlap by at most `overlap`. A piece too long for its separator is cut
    by the next finer one; a separator starts the piece after it; pieces are gathered while they fit; ends without
    white space."""
    pieces: list[tuple[int, int]] = []
    todo = [(0, len(text), 0)]
    while todo:
        s, e, level = todo.pop()
        if e - s <= size:
            pieces.append((s, e))
        elif SEPARATORS[level] == "":
            pieces += [(i, min(i + 1, e)) for i in range(s, e)]
        else:
            sep, cuts, at = SEPARATORS[level], [s], text.find(SEPARATORS[level], s + 1, e)
            while at >= 0:
                cuts.append(at)
                at = text.find(sep, at + len(sep), e)
            cuts.append(e)
            todo += [(a, b, level + 1) for a, b in reversed(list(zip(cuts, cuts[1:])))]
    pieces.sort()
    out, first = [], 0
    for i, (s, e) in enumerate(pieces):
        if e - pieces[first][0] > size:
            out.append((pieces[first][0], pieces[i - 1][1]))
            while first < i and (pieces[i - 1][1] - pieces[first][0] > overlap or e - pieces[first][0] > size):
                first += 1
    if pieces:
        out.append((pieces[first][0], pieces[-1][1]))
    spans = []
    for s, e in out:
        body = text[s:e]
        s, e = s + len(body) - len(body.lstrip()), s + len(body.rstrip())
        if e > s and (not spans or (s, e) != spans[-1]):
            spans.append((s, e))
    return spans


def _spread(docs: DataFrame, spans) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, s, e, t[s:e]) for d, t in zip(b["doc_id"], b["text"]) for i, (s, e) in enumerate(spans(t or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "start", "end", "text"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ordinal int, start int, end int, text string")


def chunk_fixed(docs: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """(doc_id, ordinal, start, end, text), text[start:end] == text of the chunk."""
    return _spread(docs, lambda t: fixed_spans(t, size, overlap))


# What white space is to Java's regular expressions.
BLANKS = " \t\n\x0b\f\r"


def sentences_of(text: str) -> list[tuple[int, int]]:
    """The spans of sentence_spans for one text."""
    out, at = [], 0
    for para in text.split("\n\n"):
        cuts = [0, *(m.start(1) for m in re.finditer(rf"[.!?]([{BLANKS}]+)", para)), len(para)]
        for i, (s, e) in enumerate(zip(cuts, cuts[1:])):
            body = para[s:e].lstrip(BLANKS)
            if body:
                out.append((at + (e - len(body) if i else s), at + e))
        at += len(para) + 2
    return out


def limit_of(dist: np.ndarray, share: float) -> float:
    """Spark's percentile: linear between the two nearest places."""
    x, at = np.sort(dist), (len(dist) - 1) * share
    low, high = math.floor(at), math.ceil(at)
    return x[low] if x[low] == x[high] else (high - at) * x[low] + (at - low) * x[high]


def chunk_semantic(docs: DataFrame, encode, percentile: float = 85.0, buffer: int = 1, max_chars: int = 2000, min_chars: int = 0) -> DataFrame:
    """(doc_id, start, end): sentences are cut where neighbouring contexts differ most. encode: Column of texts to
    Column of unit vectors (native, or an Arrow UDF that loads its model once a worker).

    A document's sentences follow each other in one task, before and after they are encoded, so nothing is shuffled; the
    first of them carries the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "end", "last", "context", "text"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                spans = sentences_of(text)
                said = [text[s:e] for s, e in spans]
                for n, (s, e) in enumerate(spans):
                    ids.append(i)
                    rows.append((s, e, n == len(spans) - 1, " ".join(said[max(0, n - buffer):n + buffer + 1]), None if n else text))
                    if len(rows) >= 4096:
                        yield packed(batch, ids, rows)
                        ids, rows = [], []
            if rows:
                yield packed(batch, ids, rows)

    def packed(batch: pa.RecordBatch, ids: list, rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            ends = np.flatnonzero(batch.column(3).to_numpy(zero_copy_only=False)) + 1
            if not len(ends):
                held.append(batch)  # a document of many sentences goes on
                continue
            t = pa.Table.from_batches([*held, batch.slice(0, ends[-1])]).combine_chunks()
            held = [batch.slice(ends[-1])] if ends[-1] < batch.num_rows else []
            vectors = t["embedding"].combine_chunks().flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            product = np.zeros(max(0, len(vectors) - 1))
            for j in range(vectors.shape[1]):  # in the order in which `dot` adds
                product += vectors[:-1, j] * vectors[1:, j]
            dist, start, end = 1 - product, t["start"].to_numpy(), t["end"].to_numpy()
            texts, ids, spans, first = t["text"], [], [], 0
            for stop in np.flatnonzero(t["last"].to_numpy(zero_copy_only=False)) + 1:
                own, text = dist[first:stop - 1], texts[first].as_py()
                cuts = np.flatnonzero(np.round(own, 9) > np.round(limit_of(own, percentile / 100), 9)) + first + 1 if len(own) else []
                for a, b in zip([first, *cuts], [*cuts, stop]):
                    for s, e in halve(text, int(start[a]), int(end[b - 1]), max_chars):
                        body = text[s:e]
                        if body.strip():
                            ids.append(first)
                            spans.append((s + len(body) - len(body.lstrip()), s + len(body.rstrip())))
                first = stop
            if spans:
                yield pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks().take(pa.array(ids)), *[pa.array(c, pa.int64()) for c in zip(*spans)]], ["doc_id", "start", "end"])

    sents = docs.select("doc_id", "text").where("text is not null").mapInArrow(split, f"doc_id {kind}, start long, end long, last boolean, context string, text string")
    vectors = sents.select("doc_id", "start", "end", "last", "text", encode(F.col("context")).alias("embedding"))
    spans = vectors.mapInArrow(cut, f"doc_id {kind}, start long, end long")
    return merge_undersized(spans, min_chars) if min_chars else spans


def check_offsets(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """chunks (doc_id, start, end, text) with `exact`: in range, and the text at the offsets is the chunk's."""
    d = docs.select("doc_id", F.col("text").alias("source_text"))
    inside = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("source_text"))
    same = F.expr("substring(source_text, int(start) + 1, int(end - start))") == F.col("text")
    return chunks.join(d, "doc_id", "left").withColumn("exact", F.coalesce(inside & same, F.lit(False))).drop("source_text")


def length_stats(chunks: DataFrame, by: str) -> DataFrame:
    """(by, n, shortest, median, mean, longest) of the chunks' lengths; the median of an even number is between two."""
    size = F.col("end") - F.col("start")
    return chunks.groupBy(by).agg(F.count("*").alias("n"), F.min(size).alias("shortest"), F.percentile(size, F.lit(0.5)).alias("median"), F.avg(size).alias("mean"), F.max(size).alias("longest"))
