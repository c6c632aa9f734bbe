"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, calibrated votes.

Fit: a bounded sample of labelled rows (max_examples, half of each class if there are so many); all its terms are
indexed, with their document frequencies over all documents. A term's weight is TF-IDF times FLOOR plus how far its
log-odds differ between the classes: words that tell nothing weigh little, but none is left out, and the sample's size
sets no threshold. Index: the sample's unit vectors, ordered so that like ones are neighbours, in blocks of BLOCK ids;
each term has its largest weight in each block. Search: the query's weights times these maxima bound every block's
scores; blocks are scored in order of their bounds until the next bound is below the k-th best score, so the result is
exact. The DENSE most frequent terms keep full columns instead of lists: a batch of texts meets them in one matrix
product, whose largest value in a block is their exact part of its bound. Votes weigh 1 / (distance + SOFT); leave-one-out votes of the sample, reweighted to the labelled rows' class
shares, calibrate them by isotonic regression.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
BLOCK, SOFT, FLOOR = 64, 0.05, 0.05
#: Frequent terms whose postings are full columns (8 bytes an example each), and texts that are scored at once.
DENSE, TEXTS = 512, 64


def terms_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_TABLE).split()


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + size), one range after another."""
    upto = np.cumsum(sizes)
    return np.repeat(starts - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0, dtype=upto.dtype)


class Index:
    """Block-max inverted index of labelled examples. rows: (doc_id, label, {term: count}); scale: factors of the
    terms' weights, 1 where missing; dense: how many of the most frequent terms keep their postings as full columns.

    The full columns meet a batch of queries in one matrix product; all other terms have posting lists with a largest
    weight for each block. How many columns are full changes the time, not the results."""

    def __init__(self, rows: Iterable[tuple[int, int, dict[bytes, int]]], df: dict[bytes, int], n_docs: int, k: int = 15, scale: dict[bytes, float] | None = None, dense: int = DENSE):
        self.k = k
        self.term = {t: i for i, t in enumerate(sorted(df))}
        self.idf = np.array([(math.log((1 + n_docs) / (1 + df[t])) + 1) * (scale or {}).get(t, 1.0) for t in self.term])
        vectors = [(self.weigh(c), label, doc) for doc, label, c in rows]
        vectors.sort(key=lambda v: (max(v[0], key=v[0].get, default=-1), v[1], v[2]))
        self.docs, self.labels = [v[2] for v in vectors], np.array([v[1] for v in vectors], np.int64)
        self.vectors = [v[0] for v in vectors]
        self.blocks = -(-len(vectors) // BLOCK)
        size = sum(map(len, self.vectors))
        at = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(v) for v in self.vectors])
        term = np.fromiter(chain.from_iterable(self.vectors), np.int32, size)
        weight = np.fromiter(chain.from_iterable(v.values() for v in self.vectors), np.float64, size)
        held = np.bincount(term, minlength=len(self.term))
        often = np.argsort(-held, kind="stable")[:dense]
        often = often[held[often] > 0]
        self.column = np.full(len(self.term), -1, np.int32)  # a term's full column, if it has one
        self.column[often] = np.arange(len(often))
        self.full = np.zeros((len(often), self.blocks * BLOCK))
        full = self.column[term] >= 0
        self.full[self.column[term[full]], at[full]] = weight[full]
        at, weight, term = at[~full], weight[~full], term[~full]
        # postings by (term, example); entries: the runs of a term's postings in one block, with their largest weight
        order = np.lexsort((at, term))
        self.at, self.weight, term = at[order], weight[order], term[order]
        size, block = len(self.at), self.at // BLOCK
        self.start = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])][:size]).astype(np.int32)
        self.count = np.diff(np.r_[self.start, size]).astype(np.int32)
        self.block, self.at = block[self.start], (self.at % BLOCK).astype(np.uint8)
        self.top = np.maximum.reduceat(self.weight, self.start) if size else np.zeros(0)
        self.first = np.searchsorted(term[self.start], np.arange(len(self.term) + 1))
        self.steps: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def weigh(self, counts: dict[bytes, int]) -> dict[int, float]:
        """Unit vector: (1 + log tf) idf of the known terms."""
        w = {i: (1 + math.log(c)) * self.idf[i] for t, c in sorted(counts.items()) if (i := self.term.get(t)) is not None}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    def weigh_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The texts' unit vectors like weigh's: (bounds, terms, weights), text i from bounds[i] to bounds[i + 1]."""
        words = [terms_of(t) for t in texts]
        of = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        ids = np.fromiter(map(self.term.get, chain.from_iterable(words), repeat(-1)), np.int64, len(of))
        n = max(len(self.term), 1)
        keys, counts = np.unique((of * n + ids)[ids >= 0], return_counts=True)
        of, ids = keys // n, keys % n
        w = (1 + np.log(counts)) * self.idf[ids]
        norm = np.sqrt(np.bincount(of, w * w, len(texts)))
        return np.searchsorted(of, np.arange(len(texts) + 1)), ids, w / norm[of]

    def search(self, query: dict[int, float], skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples with positive similarity: (indices, similarities), ties by index."""
        ids, sims = self.nearest(query, skip)
        return ids[: self.k], sims[: self.k]

    def nearest(self, query: dict[int, float], skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples with positive similarity and all that tie with the k-th, like search."""
        terms, weights = np.fromiter(query, np.int64, len(query)), np.fromiter(query.values(), np.float64, len(query))
        return next(self.nearest_of(np.array([0, len(terms)]), terms, weights, [skip]))

    def nearest_of(self, bounds: np.ndarray, terms: np.ndarray, weights: np.ndarray, skip: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """nearest for each of some vectors as weigh_texts gives them."""
        column = self.column[terms]
        full = np.zeros((len(bounds) - 1, len(self.full)))
        of = np.repeat(np.arange(len(full)), np.diff(bounds))
        full[of[column >= 0], column[column >= 0]] = weights[column >= 0]
        base = full @ self.full
        tops = base.reshape(len(full), self.blocks, BLOCK).max(2, initial=0.0)
        for i in range(len(full)):
            own = slice(bounds[i], bounds[i + 1])
            rest = column[own] < 0
            yield self._nearest(terms[own][rest], weights[own][rest], base[i], tops[i], skip[i] if skip else -1)

    def _nearest(self, terms: np.ndarray, weights: np.ndarray, base: np.ndarray, tops: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """base: the frequent terms' part of every example's similarity; tops: its largest value in each block. Block
        bounds are these plus the other terms' weights times their largest ones in the block."""
        count = self.first[terms + 1] - self.first[terms]
        entry = _ranges(self.first[terms], count)
        by = np.repeat(weights, count)
        of_block = self.block[entry]
        bound = tops + np.bincount(of_block, by * self.top[entry], self.blocks)
        blocks = np.argsort(-bound, kind="stable")
        ids, sims, kth, done, step = np.zeros(0, np.int64), np.zeros(0), 0.0, 0, 3
        while done < len(blocks) and bound[blocks[done]] > 0 and bound[blocks[done]] >= kth - 1e-9:
            mine = blocks[done : done + step]
            mine = mine[(bound[mine] > 0) & (bound[mine] >= kth - 1e-9)]
            slot = np.full(self.blocks, -1, np.int32)
            slot[mine] = np.arange(len(mine), dtype=np.int32) * BLOCK
            now = np.flatnonzero(slot[of_block] >= 0)
            part, n = entry[now], self.count[entry[now]]
            post = _ranges(self.start[part], n)
            to = self.at[post] + np.repeat(slot[of_block[now]], n)
            acc = base.reshape(-1, BLOCK)[mine].ravel() + np.bincount(to, np.repeat(by[now], n) * self.weight[post], len(mine) * BLOCK)
            at = (mine[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            new = np.flatnonzero((acc > max(kth - 1e-9, 1e-12)) & (at != skip))
            ids, sims = np.concatenate([ids, at[new]]), np.concatenate([sims, acc[new]])
            if len(ids) >= self.k:
                kth = np.partition(sims, -self.k)[-self.k]
                ids, sims = ids[sims >= kth - 1e-9], sims[sims >= kth - 1e-9]
            done, step = done + step, step * 8
        sims = np.round(sims, 12)  # sums in another order differ in later digits
        order = np.lexsort((ids, -sims))
        ids, sims = ids[order], sims[order]
        stop = np.searchsorted(-sims, 1e-11 - sims[self.k - 1], "right") if len(ids) > self.k else len(ids)
        return ids[:stop], sims[:stop]

    def vote(self, query: dict[int, float], skip: int = -1) -> tuple[float, list[int]]:
        """(raw vote, evidence); examples as near as the k-th all vote, so no label or id decides among them. Without a neighbour the vote is below all others: -1."""
        return self._vote(*self.nearest(query, skip))

    def _vote(self, ids: np.ndarray, sims: np.ndarray) -> tuple[float, list[int]]:
        if not len(ids):
            return -1.0, []
        w = 1 / (np.maximum(1 - sims, 0) + SOFT)
        return round(float((w * self.labels[ids]).sum() / w.sum()), 9), [self.docs[i] for i in ids[:3]]

    def calibrate(self, share: float) -> None:
        """Isotonic regression of labels on leave-one-out votes, with `share` of toxic rows in all labelled ones."""
        n1 = int(self.labels.sum())
        n0 = len(self.labels) - n1
        if not n1 or not n0:
            self.steps = (np.array([-1.0, 1.0]), np.array([share, share]))
            return
        weight = {1: share / n1, 0: (1 - share) / n0}
        raw = Counter()
        for start in range(0, len(self.vectors), TEXTS):
            some = self.vectors[start : start + TEXTS]
            terms = np.fromiter(chain.from_iterable(some), np.int64)
            weights = np.fromiter(chain.from_iterable(v.values() for v in some), np.float64)
            found = self.nearest_of(np.cumsum([0, *map(len, some)]), terms, weights, list(range(start, start + len(some))))
            for near, y in zip(found, self.labels[start:].tolist()):
                raw[(self._vote(*near)[0], y)] += weight[y]
        pools: list[list[float]] = []  # first, last, weight, toxic weight
        for x in sorted({x for x, _ in raw}):
            pools.append([x, x, raw[(x, 0)] + raw[(x, 1)], raw[(x, 1)]])
            while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
                _, last, w, t = pools.pop()
                pools[-1] = [pools[-1][0], last, pools[-1][2] + w, pools[-1][3] + t]
        soft = 0.5 / len(self.labels)  # no pool is sure
        xs, ys = [], []
        for first, last, w, t in pools:
            y = (t + soft * share) / (w + soft)
            xs += [first, last] if last > first else [first]
            ys += [y, y] if last > first else [y]
        self.steps = (np.array(xs), np.array(ys))

    def score(self, counts: dict[bytes, int]) -> tuple[float, list[int]]:
        return self._score(*self.vote(self.weigh(counts)))

    def score_texts(self, texts: list[bytes]) -> list[tuple[float, list[int]]]:
        """score for each text, TEXTS of them at a time."""
        return [self._score(*self._vote(*near)) for i in range(0, len(texts), TEXTS) for near in self.nearest_of(*self.weigh_texts(texts[i : i + TEXTS]))]

    def _score(self, raw: float, evidence: list[int]) -> tuple[float, list[int]]:
        p = 0.999 * float(np.interp(raw, *self.steps)) + 0.001 * (raw + 1) / 2  # ties within a pool keep the votes' order
        return min(max(p, 0.0), 1.0), evidence


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _known_counts(rows: DataFrame, terms: set[bytes]) -> DataFrame:
    """(df, term): per batch, in how many of its texts each term stands; bounded by the terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = Counter(), 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                df.update(terms.intersection(terms_of(text.as_py() or b"")))
                n += 1
        df[b""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.binary()), pa.array(list(df.values()), pa.int64())], ["term", "df"])

    return rows.select("text").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = 4000, k: int = 15) -> Index:
    """An index from labels (doc_id, toxic) and docs (doc_id, text).

    Training rows: labelled, not null, crc32(doc_id as text) mod 5 not 0; a doc_id labelled twice is toxic if once
    so. The sample takes each class by hash order of doc_id. Of a doc_id with several texts the least counts. Without
    examples of both classes every score is the toxic share (0 without any). At most max_examples texts' term counts
    and one document frequency for each of their terms reach the driver."""
    train = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    shares = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    half = max_examples // 2
    want = {y: max(half, max_examples - shares.get(1 - y, 0)) for y in (0, 1)}
    ids = [train.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(want[y]) for y in (0, 1)]
    chosen = ids[0].union(ids[1]).withColumnRenamed("doc_id", "id")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [Counter(terms_of(text.as_py())) for text in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array([list(c) for c in counts], pa.list_(pa.binary())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))], ["doc_id", "toxic", "terms", "n"])

    found = sample.select("doc_id", "toxic", "text").mapInArrow(words, "doc_id long, toxic int, terms array<binary>, n array<int>").toArrow().sort_by("doc_id")
    has = {0: Counter(), 1: Counter()}
    own: dict[bytes, bytes] = {}  # one object a term
    rows = []
    for batch in found.to_batches(64):
        for doc, y, terms, n in zip(*(c.to_pylist() for c in batch.columns)):
            has[y].update(terms)
            rows.append((doc, y, {own.setdefault(t, t): c for t, c in zip(terms, n)}))
    del found
    n1 = sum(y for _, y, _ in rows)
    n0 = len(rows) - n1

    def odds(n: int, of: int) -> float:
        return math.log((n + 0.5) / (of - n + 0.5))

    scale = {t: FLOOR + abs(odds(has[1][t], n1) - odds(has[0][t], n0)) for t in own}
    counted = {bytes(r["term"]): r["df"] for r in _known_counts(docs, set(own)).collect()}
    n_docs = counted.pop(b"", 0)
    index = Index(rows, {t: counted.get(t, 0) for t in own}, n_docs, k, scale)
    total = sum(shares.values())
    index.calibrate(shares.get(1, 0) / total if total else 0.0)
    index.vectors = []  # only the calibration needs them
    return index


def score_toxicity(docs: DataFrame, labels: DataFrame, max_examples: int = 4000, k: int = 15) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for each row of docs (doc_id, text).

    Whole texts; null ones are empty and score like texts without a known term. evidence: the nearest examples'
    doc_ids. Repeated rows score alike; null doc_ids stay, not held out; an empty table gives none; other columns are
    ignored; bytes that are not UTF-8 are parts of words like any other."""
    index = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_examples, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = index.value.score_texts
        for batch in batches:
            texts, found = batch.column(2).cast(pa.binary()), []
            for i in range(0, len(texts), TEXTS):
                found += score([t or b"" for t in texts[i : i + TEXTS].to_pylist()])
            scores, evidence = [p for p, _ in found], [e for _, e in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(p >= 0.5) for p in scores], pa.int32()), pa.array(evidence, pa.list_(pa.int64()))], ["doc_id", "held_out", "score", "predicted", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
