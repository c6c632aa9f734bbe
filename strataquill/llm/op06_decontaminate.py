"""Benchmark decontamination: a generalised suffix automaton of the test items, streamed over by training words.

The automaton is built over the items' normalised words as integers. Documents stream through it; at each word it
holds the longest match that ends there. A match of at least `window` words (or a whole shorter item) is a hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataquill.llm.common import as_text, discard, materialise

#: Items are split into automata of at most so many words (about 660 bytes a word, once a Python worker), streamed over one after another.
AUTOMATON_WORDS = 200_000
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def item_words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) runs of ASCII letters, digits and non-ASCII bytes."""
    return text.lower().translate(_TABLE).split()


class Automaton:
    """Generalised suffix automaton; items: (item_id, words), each with at least one word."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[str | None] = [i for i, _ in items]
        marks: list[set[int]] = [set()]  # items in which a state's strings occur, from their prefix states
        self.whole: dict[int, list[int]] = {}  # state -> short items that it ends
        self.shortest = min((min(len(w), window) for _, w in items), default=window)
        for n, (_, words) in enumerate(items):
            last, path = 0, []
            for word in words:
                last = self._extend(last, self.vocab.setdefault(word, len(self.vocab)), marks)
                path.append(last)
                marks[last].add(n)
            if len(words) < window:
                self.whole.setdefault(last, []).append(n)
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.length[self.link[state]] >= window:  # shorter strings need no items
                marks[self.link[state]] |= marks[state]
        self.found = [tuple(sorted(m)) if self.length[s] >= window else () for s, m in enumerate(marks)]

    def _extend(self, last: int, symbol: int, marks: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length

        def clone(p: int, q: int) -> int:
            new = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            marks.append(set())
            link[q] = new
            while p >= 0 and nxt[p].get(symbol) == q:
                nxt[p][symbol] = new
                p = link[p]
            return new

        if symbol in nxt[last]:
            q = nxt[last][symbol]
            return q if length[q] == length[last] + 1 else clone(last, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        marks.append(set())
        p = last
        while p >= 0 and symbol not in nxt[p]:
            nxt[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][symbol]
            link[new] = q if length[q] == length[p] + 1 else clone(p, q)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Hit spans [first word, end) in order, merged where they overlap, and the items with occurring windows."""
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.r_[False, ids >= 0, False].astype(np.int8)))
        spans: list[list[int]] = []
        items: set[int] = set()
        for start, end in zip(known[::2].tolist(), known[1::2].tolist()):
            if end - start >= self.shortest:
                self._stream(ids[start:end].tolist(), start, spans, items)
        return spans, items

    def _stream(self, ids: list[int], at: int, spans: list[list[int]], items: set[int]) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for end, symbol in enumerate(ids, at + 1):
            while state and symbol not in nxt[state]:
                state = link[state]
                matched = length[state]
            if symbol in nxt[state]:
                state = nxt[state][symbol]
                matched += 1
            hit, s = 0, state
            if matched >= window:
                hit = matched
                while length[link[s]] >= window:
                    s = link[s]
                items.update(self.found[s])
            if self.whole:
                s = state
                while s > 0:
                    if s in self.whole and length[s] <= matched:
                        items.update(self.whole[s])
                        hit = max(hit, length[s])
                    s = link[s]
            if hit:
                first = end - hit
                while spans and spans[-1][1] > first:
                    first = min(first, spans.pop()[0])
                spans.append([first, end])


def _automata(benchmark: DataFrame, window: int, limit: int) -> Iterator[Automaton]:
    """Automata over at most `limit` words each (a longer item is one of its own); items stream to the driver."""
    group, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        words = item_words((row[1] or "").encode())
        if words and group and size + len(words) > limit:
            yield Automaton(group, window)
            group, size = [], 0
        if words:
            group.append((row[0], words))
            size += len(words)
    if group:
        yield Automaton(group, window)


def match_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, limit: int = AUTOMATON_WORDS, cut: bool = False) -> DataFrame:
    """docs with n_words, spans (array of [first word, end)) and items (array of item_ids) added; no row moves.

    With cut the texts come back without the spans; n_words and spans are of the whole texts.

    Null texts have no words; an item without item_id counts in spans, not in items; an item without words matches
    nothing; repeated items and rows count each. An empty benchmark gives empty spans, an empty table no rows. Existing
    columns of these names are replaced. Bytes that are not UTF-8 are parts of words and stay as they are."""
    schema_in = docs.drop("n_words", "spans", "items")
    out = schema_in.withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<array<int>>"), "items": F.array().cast("array<string>")})
    automata = list(_automata(benchmark, window, limit)) or [Automaton([], window)]
    sc = docs.sparkSession.sparkContext
    kept = None
    for n, automaton in enumerate(automata):
        shared = sc.broadcast(automaton)
        text_at = schema_in.columns.index("text")
        cut_now = cut and n == len(automata) - 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, text_at=text_at, cut_now=cut_now) -> Iterator[pa.RecordBatch]:
            scan = shared.value.scan
            names = shared.value.items
            for batch in batches:
                counts, spans, items, texts = [], [], [], []
                old = zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1))
                for text, (had, had_items) in zip(batch.column(text_at).cast(pa.binary()), old):
                    raw = text.as_py()
                    words = item_words(raw or b"")
                    found, ids = scan(words)
                    if len(had):
                        found = _union(found + had.as_py())
                    if cut_now:
                        texts.append(cut_words(raw, found) if found else raw)
                    counts.append(len(words))
                    spans.append(found)
                    items.append(sorted({names[i] for i in ids if names[i] is not None} | set(had_items.as_py())))
                new = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))]
                kept_columns = batch.columns[:-3]
                if cut_now:
                    kept_columns[text_at] = as_text(texts)
                yield pa.RecordBatch.from_arrays(kept_columns + new, batch.schema.names)

        out = out.mapInArrow(run, out.schema)
        if len(automata) > 1 and n < len(automata) - 1:  # one automaton in memory at a time
            written = materialise(out, "matched")
            if kept is not None:
                discard(kept)
            out = kept = written
    return out


def _union(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def cut_words(text: bytes, spans: list[list[int]]) -> bytes:
    """text without the bytes from the first to the last word of each span."""
    if not spans:
        return text
    plain = np.frombuffer(text.translate(_TABLE), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.r_[False, plain, False].astype(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    out, at, upto = [], 0, -1
    for s, e in spans:
        if s != upto:  # what lies between touching spans goes too
            out.append(text[at : begins[s]])
        at, upto = ends[e - 1], e
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """docs without benchmark passages: spans of at least `window` matched words (or whole shorter items) are cut
    from the texts; documents with more than max_coverage of their words hit go. Columns stay; n_chars, if there,
    is counted anew for texts that were cut. Untouched rows keep their text byte for byte."""
    hits = F.aggregate("spans", F.lit(0), lambda s, x: s + x[1] - x[0])

    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others, F.lit(None).cast("int").alias("__none")).alias("__row"), "text")
    matched = match_benchmark(rows, benchmark, window, cut=True)
    out = matched.where(hits <= max_coverage * F.col("n_words")).withColumn("__cut", F.size("spans") > 0)

    def column(c: str):
        if c == "n_chars":
            return F.when(F.col("__cut"), F.length("text")).otherwise(F.col("__row.n_chars")).cast(docs.schema[c].dataType)
        return F.col("text") if c == "text" else F.col(f"__row.`{c}`")

    return out.select(*[column(c).alias(c) for c in docs.columns])


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = match_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
size AS (SELECT DISTINCT least(len(w), 10) AS n FROM item WHERE len(w) > 0),
grams AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
place AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, size WHERE len(w) >= n)),
hit AS (SELECT r, i, place.n, item_id FROM place JOIN grams USING (g, n)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM low LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
