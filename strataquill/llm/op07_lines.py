"""Line dedup by winnowing: repeated runs of lines are found by fingerprints and cut from all but their first place.

A run of lines counts from MIN_CHARS characters on, be it one line or many. Select: from each line starts its window,
the fewest lines with so many characters; the least line hash of a window is its fingerprint, and each line that is
the least of some window is selected once, with the hashes of the lines around it. A run that counts holds a whole
window, so all its copies have the same selected line. Join: fingerprints with one place end there. Extend: around the
others the match is extended line by line both ways, up to the next line that starts or ends a window, and compared by
digest with its first place in the corpus; from there on the neighbouring windows go on. Every line of a repeated run
is in the window that starts at it or, near the run's end, in the one that ends with the run, so all that is deleted
together are the maximal repeated runs. A place meets only the first one, so a line in a third of all documents makes
no pairs, and keys of many places are dealt into parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.llm.common import as_text, discard, materialise, split_join, text_hash

MIN_CHARS = 50
_PLACE = "doc_id long, th long, "


def _window(sizes: list[int], start: int, step: int, least: int) -> int | None:
    """The last line of the fewest lines from start on (step 1) or back (step -1) with at least so many characters."""
    total, at = 0, start
    while 0 <= at < len(sizes):
        total += sizes[at]
        if total >= least:
            return at
        at += step
    return None


def _least(digests: list[bytes], first: int, last: int) -> int:
    return digests.index(min(digests[first : last + 1]), first)


def select(text: bytes, min_chars: int = MIN_CHARS) -> list[tuple[int, int, list[int], list[int], bytes]]:
    """(fingerprint, its place in the following lists, line numbers, sizes, digests) for each selected line: the lists
    go on both ways until they hold min_chars characters, so that all windows around the line lie in them."""
    lines = [(n, s) for n, line in enumerate(text.split(b"\n")) if (s := line.strip())]
    sizes = [len(s) if s.isascii() else len(s.decode("utf-8", "replace")) for _, s in lines]
    digests = [xxhash.xxh3_128_digest(s) for _, s in lines]
    chosen = set()
    for i in range(len(lines)):
        end = _window(sizes, i, 1, min_chars)
        if end is None:
            break
        chosen.add(_least(digests, i, end) if end > i else i)
    out = []
    for p in sorted(chosen):
        low = _window(sizes, p - 1, -1, min_chars) or 0
        high = _window(sizes, p + 1, 1, min_chars)
        high = len(lines) if high is None else high + 1
        out.append((int.from_bytes(digests[p][:8], "little", signed=True), p - low, [n for n, _ in lines[low:high]], sizes[low:high], b"".join(digests[low:high])))
    return out


def windows(at: int, sizes: list[int], digests: bytes, min_chars: int = MIN_CHARS) -> list[tuple[int, int, bytes]]:
    """(first, last, digest) of the windows that belong to the selected line at: those that start at some line, and
    those that end at some line. A window belongs to the least line of the window that starts with it."""
    own = [digests[i : i + 16] for i in range(0, len(digests), 16)]
    found = set()
    for first in range(at + 1):
        last = _window(sizes, first, 1, min_chars)
        if last is not None and last >= at and _least(own, first, last) == at:
            found.add((first, last))
            reach = last + 1  # later ends of windows whose start is the same
            while reach < len(sizes) and _window(sizes, reach, -1, min_chars) == first:
                found.add((first, reach))
                reach += 1
    return [(a, b, xxhash.xxh3_128_digest(digests[16 * a : 16 * (b + 1)])) for a, b in sorted(found)]


def repeated_runs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, th, spans): the windows [first, last] to delete, for rows that have any."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for doc, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                for row in select(text.as_py() or b"", min_chars):
                    for c, v in zip(cols, (doc, th, *row)):
                        c.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "th", "fp", "at", "lines", "sizes", "digests"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for doc, th, at, lines, sizes, digests in zip(*(c.to_pylist() for c in batch.columns)):
                for first, last, digest in windows(at, sizes, digests, min_chars):
                    for c, v in zip(cols, (doc, th, digest, lines[first], lines[last])):
                        c.append(v)
            types = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "th", "digest", "first", "last"])

    def places(rows: DataFrame, key: str, place) -> DataFrame:
        """(key, n, a): keys of two places or more, their number of rows and first place; aggregated before the shuffle."""
        by = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(place).alias("a"), F.max(place).alias("b"))
        return by.where("a <> b").select(key, "n", "a")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), "text")
    found = materialise(rows.mapInArrow(chosen, _PLACE + "fp long, at int, lines array<int>, sizes array<int>, digests binary"), "selected")
    shared = materialise(places(found.withColumn("line", F.element_at("lines", F.col("at") + 1)), "fp", F.struct("doc_id", "th", "line")).select("fp", "n"), "shared")
    met = split_join(found, shared, "fp", "left_semi").select("doc_id", "th", "at", "lines", "sizes", "digests")
    near = materialise(met.mapInArrow(spread, _PLACE + "digest binary, first int, last int"), "near")
    discard(found, shared)
    firsts = materialise(places(near, "digest", F.struct("doc_id", "th", "first", "last")), "firsts")
    same = F.col("doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("th") == F.col("a.th"))
    later = split_join(near, firsts, "digest").where(~same | (F.col("first") > F.col("a.last")))
    out = materialise(later.groupBy("doc_id", "th").agg(F.collect_set(F.array("first", "last")).alias("spans")), "runs")
    discard(near, firsts)
    return out


def cut_lines(text: bytes, spans: list[list[int]]) -> tuple[bytes, list[int]]:
    """(text without the spans' lines, their numbers)."""
    lines = text.split(b"\n")
    gone = np.zeros(len(lines), bool)
    for first, last in spans:
        gone[first : last + 1] = True
    return b"\n".join(x for x, g in zip(lines, gone) if not g), np.flatnonzero(gone).tolist()


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, removed) for each row of docs (doc_id, text); other columns are ignored.

    text is without the maximal runs of lines that stand earlier too and have at least min_chars characters (code
    points, blanks at the lines' ends not counted); earlier means lesser (doc_id, text hash, line), nulls first, and
    not overlapping. Lines compare without blanks at their ends; blank lines count for nothing but go with a run
    around them. Rows equal in doc_id and text are one place, and stay. Null texts stay null, with one empty line.
    Bytes that are not UTF-8 stay as they are. An empty table gives none."""
    spans = repeated_runs(docs, min_chars).select(F.coalesce("doc_id", F.lit(-1)).alias("d"), F.col("doc_id").isNull().alias("n"), F.col("th").alias("t"), "spans")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), "text")
    on = (F.coalesce(rows.doc_id, F.lit(-1)) == spans.d) & (rows.doc_id.isNull() == spans.n) & (rows.th == spans.t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed = [], [], []
            for text, spans in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
                raw = text.as_py()
                kept, gone = cut_lines(raw or b"", spans.as_py() or [])
                texts.append(raw if raw is None else kept)
                counts.append((raw or b"").count(b"\n") + 1)
                removed.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column(0), as_text(texts), pa.array(counts, pa.int64()), pa.array([len(r) for r in removed], pa.int64()), pa.array(removed, pa.list_(pa.int32()))], ["doc_id", "text", "n_lines", "n_removed", "removed"])

    return rows.join(spans, on, "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string, n_lines long, n_removed long, removed array<int>")


def op7_lines(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "removed", F.crc32("text").alias("kept_crc32"))
