"""SimHash near-duplicates: blocked candidates, a pivot distance table, exact Hamming verification, components.

Documents are first collapsed to distinct fingerprints. The pivot table holds the Hamming distance of each of them to
PIVOTS reference fingerprints; by the triangle inequality a pair whose largest coordinate difference exceeds the radius
cannot link and is discarded, and survivors are verified. Which pairs are compared at all is set by blocking: the 64
bits are cut into four bands, and two fingerprints that differ in at most two bits agree on at least two whole bands,
so the six band pairs are exact block keys. A bucket yields a spanning forest of its links rather than all its pairs.

near_dedup, the pipeline's stage, verifies survivors by the exact Jaccard similarity of the shingle sets; its blocks are
bands of MinHash values, and its radius is so wide that it loses no pair of that similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataquill.llm.common import discard, materialise, split_join, text_hash
from strataquill.llm.components import components

#: Reference fingerprints in the pivot table; any fixed set is right, random ones prune well.
PIVOTS = np.random.default_rng(9).integers(0, 2**64, 24, dtype=np.uint64)
#: Bands and rows of MinHash blocking: a pair of Jaccard similarity 0.8 shares a band with probability 0.9998.
LSH_BANDS, LSH_ROWS = 12, 3
_ODD = np.random.default_rng(5).integers(0, 2**63, LSH_BANDS * LSH_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Above this many distinct fingerprints in a bucket, they are linked through one-bit neighbours instead.
BUCKET = 4096
#: Bits in which the fingerprints of similar sets may differ, from so many shingles on: at a Jaccard similarity of 0.8 a
#: bit differs with probability 0.151, so over RADIUS of them differ with 2e-8; smaller sets are compared without it.
RADIUS, RADIUS_FROM = 26, 50
#: Parts in which the members of a component are joined with its id.
SALTS = 16
#: Shingles of a candidate component that one task compares at once (8 bytes each, and as much again for a second part).
PART = 4_000_000


def shingle_hashes(text: bytes, width: int, seed: int) -> np.ndarray:
    """XXH64 of each run of width words (repeats included), or of the whole sequence if it has fewer words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, seed) for g in grams), np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half the hashes; zero for none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):  # 64 bytes a hash while it is counted
        bits = np.unpackbits(hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0])


def minhash_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per LSH band. Documents without words share one key."""
    if not len(hashes):
        return np.zeros(1, np.uint64)
    least = np.array([(hashes * k).min() for k in _ODD]).reshape(LSH_BANDS, LSH_ROWS)
    key = np.arange(1, LSH_BANDS + 1, dtype=np.uint64)
    for i in range(LSH_ROWS):
        key = (key ^ least[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def fingerprints(docs: DataFrame, width: int, seed: int = 42) -> DataFrame:
    """(doc_id, th, fp) for each row; null texts are empty. Whole texts, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(shingle_hashes(text.as_py() or b"", width, seed)) for text in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "th", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), "text")
    return rows.mapInArrow(run, "doc_id long, th long, fp long")


def pivot_distances(fp: Column) -> Column:
    """The row of a fingerprint in the pivot table: its Hamming distance to each of PIVOTS."""
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(int(p)))).cast("tinyint") for p in PIVOTS.view(np.int64)])


def far_apart(table: np.ndarray, row: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of the pivot table differ from `row` by more than the radius in some coordinate: by the triangle
    inequality their fingerprints are farther apart than that."""
    return np.abs(table - row).max(-1, initial=0) > radius


def _forest(fps: np.ndarray, table: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints (indices): pivot filter, then verification."""
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    root, links = np.arange(len(fps)), []
    stops = np.searchsorted(table[:, 0], table[:, 0] + radius, "right")
    for i, stop in enumerate(stops):
        near = i + 1 + np.flatnonzero(root[i + 1 : stop] != root[i])
        near = near[~far_apart(table[near], table[i], radius)]
        near = near[np.bitwise_count(fps[near] ^ fps[i]) <= radius]
        for j in near:
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                links.append((int(order[i]), int(order[j])))
    return links


def _neighbours(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint with its 64 one-bit neighbours: two fingerprints differ in at most two bits exactly if they
    share such a node or are one, so these edges have the same components as the links, in linear space."""
    bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return np.repeat(fps, 64), (fps[:, None] ^ bits[None, :]).ravel()


def bucket_links(keyed: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """keyed (k, fp, pivots) -> edges (a, b) with the components of all links at distance <= radius (at most 2) in a
    bucket k. Buckets are streamed in key order from sorted partitions.

    A bucket of up to `bucket` members is held as 32 bytes a member; one of more goes on through one-bit neighbours,
    which need no memory and are exact for radius 2, so for smaller radii it fails."""
    if radius > 2:
        raise ValueError("fingerprints link at two differing bits at most")

    def made(a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.uint64).view(np.int64)), pa.array(np.asarray(b, np.uint64).view(np.int64))], ["a", "b"])

    def forest(fps: np.ndarray, table: np.ndarray) -> pa.RecordBatch:
        links = _forest(fps, table, radius)
        return made(fps[[x for x, _ in links]], fps[[y for _, y in links]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, wide = None, [], False  # the bucket that may go on: its members so far, or that it is past `bucket`

        def finished() -> Iterator[pa.RecordBatch]:
            if held and sum(len(f) for f, _ in held) > 1:
                yield forest(np.concatenate([f for f, _ in held]), np.concatenate([t for _, t in held]))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            table = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(fps), -1)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:]):
                if keys[s] != key:
                    yield from finished()
                    key, held, wide = keys[s], [], False
                if wide:
                    yield made(*_neighbours(fps[s:e]))
                    continue
                held.append((fps[s:e], table[s:e]))
                if sum(len(f) for f, _ in held) > bucket:
                    if radius < 2:
                        raise ValueError("a bucket is too large for a radius below 2")
                    yield made(*_neighbours(np.concatenate([f for f, _ in held])))
                    held, wide = [], True
        yield from finished()

    dealt = keyed.repartition("k").sortWithinPartitions("k", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def _band_keys(table: DataFrame) -> DataFrame:
    """Six exact block keys: the pairs of the four 16-bit bands, tagged by pair."""
    band = [F.shiftrightunsigned(F.col("fp"), 48 - 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [F.shiftleft(F.lit(n).cast("long"), 32) + F.shiftleft(band[i], 16) + band[j] for n, (i, j) in enumerate(combinations(range(4), 2))]
    return table.select(F.explode(F.array(*keys)).alias("k"), "fp", "pivots")


def classes(prints: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """(fp, root, least, n) for every distinct fingerprint, materialised; root is null for one without links, least is
    its least doc_id, n its rows. prints is a materialised result of fingerprints(). The pivot table, with one row a distinct
    fingerprint, is made and written once; every bucket reads its rows from there."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    table = materialise(nodes.withColumn("pivots", pivot_distances(F.col("fp"))), "pivots")
    found = components(bucket_links(_band_keys(table), radius, bucket))
    out = materialise(table.drop("pivots").join(found, table.fp == found.node, "left").select("fp", "root", "least", "n"), "classes")
    discard(table)
    return out


def _component_ids(found: DataFrame) -> DataFrame:
    """(fp, root, component_id, n) of a result of classes(). A component's id meets its members in SALTS parts, so that
    no task gets a large component whole; fingerprints without links need no join."""
    linked = found.where("root is not null")
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = ids.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")
    named = linked.select("fp", "root", "n", salt.alias("salt")).join(ids, ["root", "salt"]).select("fp", "root", "component_id", "n")
    return named.union(found.where("root is null").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"), "n"))


def simhash_components(docs: DataFrame, width: int = 5, radius: int = 2, seed: int = 42, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, th, fp, root, component_id) for each row of docs (doc_id, text).

    component_id is the least doc_id in the transitive closure of links at Hamming distance <= radius (at most 2). Null
    texts are empty; texts without words have fingerprint zero and link like any other. Repeated rows stay. A null
    doc_id stays and never names a component that has another id. Other columns are ignored; no rows give no rows.
    Words are runs of bytes, so that bytes that are not UTF-8 are parts of words."""
    prints = materialise(fingerprints(docs, width, seed), "prints")
    found = classes(prints, radius, bucket)
    named = materialise(_component_ids(found), "named")
    discard(found)
    return split_join(prints, named, "fp")


def shingle_sets(docs: DataFrame, width: int, seed: int = 42) -> DataFrame:
    """(doc_id, th, node, n, keys) for each row: a hash of the set of its shingles, their number, MinHash band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, bands = [], [], []
            for text in batch.column(2).cast(pa.binary()):
                own = np.unique(shingle_hashes(text.as_py() or b"", width, seed))
                nodes.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                sizes.append(len(own))
                bands.append(minhash_keys(own).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "th", "node", "n", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), "text")
    return rows.mapInArrow(run, "doc_id long, th long, node long, n long, keys array<long>")


def _chains(keyed: DataFrame, similarity: float) -> DataFrame:
    """keyed (k, n, node) -> links (a, b) of neighbours by size in a bucket whose sizes allow the similarity. Any two
    members of a bucket that can be so similar are connected; nothing of a bucket is held but its last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            if batch.num_rows:
                k, n, node = (np.concatenate([x, c.to_numpy(zero_copy_only=False)]) for x, c in zip(last, batch.columns))
                near = np.flatnonzero((k[1:] == k[:-1]) & (n[:-1] >= similarity * n[1:] - 1e-9))
                last = [k[-1:], n[-1:], node[-1:]]
                yield pa.RecordBatch.from_arrays([pa.array(node[near]), pa.array(node[near + 1])], ["a", "b"])

    return keyed.repartition("k").sortWithinPartitions("k", "n", "node").mapInArrow(run, "a long, b long")


def similar_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (indices) among sorted sets of hashes with the components of all pairs of at least this Jaccard
    similarity. Sets meet in their prefixes, rarest hash first, so no such pair is missed; pairs whose rows in the pivot
    table or whose fingerprints are too far apart are discarded; each link is exact."""
    fps = np.array([simhash(s) for s in sets], np.uint64)
    table = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    root, sizes, index, links = np.arange(len(sets)), np.array([len(s) for s in sets]), {}, []

    def far(i: int, j: int) -> bool:
        return min(sizes[i], sizes[j]) >= RADIUS_FROM and bool(far_apart(table[j], table[i], RADIUS) or int(fps[i] ^ fps[j]).bit_count() > RADIUS)

    for i in order:
        own = sets[i]
        prefix = own[np.argsort(counts[np.searchsorted(values, own)], kind="stable")]
        prefix = prefix[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1].tolist()
        met = [index[h] for h in prefix if h in index]
        for j in np.unique(np.fromiter(chain.from_iterable(met), np.int64)).tolist() if met else []:
            if root[i] != root[j] and sizes[j] >= similarity * sizes[i] - 1e-9 and not far(i, j):
                both = len(np.intersect1d(own, sets[j], assume_unique=True))
                if both >= similarity * (sizes[i] + sizes[j] - both) - 1e-9:
                    root[root == root[j]] = root[i]
                    links.append((i, j))
        for h in prefix:
            index.setdefault(h, []).append(i)
    return links


def verified_links(docs: DataFrame, prints: DataFrame, similarity: float, width: int, part: int = PART, seed: int = 42) -> DataFrame:
    """(a, b): nodes whose shingle sets have at least this Jaccard similarity, enough of them to connect all such pairs
    that share a band.

    Components of the candidates (_chains) gather such pairs, and the sets of one component are compared in one task;
    a component of more than `part` shingles is dealt into parts, and each two parts meet in a task of their own."""
    keyed = prints.where("n > 0").select(F.explode("keys").alias("k"), "n", "node").distinct()
    rough = components(_chains(keyed, similarity))
    one = prints.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("row"), F.first("n").alias("n"))
    member = materialise(one.join(rough, "node").select("node", "root", "n", "row.*"), "candidates")
    parts = member.groupBy("root").agg(F.ceil(F.sum("n") / part).cast("int").alias("parts"))
    large = parts.where("parts > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = member.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(large, ["root", "salt"], "left")
    mine = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts") > 1, F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != mine)).otherwise(F.array(F.lit(0))))
    placed = salted.withColumn("mine", F.coalesce(mine, F.lit(0))).withColumn("other", other)
    placed = placed.select(F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"), "node", F.col("doc_id").alias("d"), F.col("th").alias("t"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"), "text").join(placed, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets = None, [], []

        def made():
            links = similar_links(sets, similarity) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in links], pa.int64()), pa.array([nodes[y] for _, y in links], pa.int64())], ["a", "b"])

        for batch in batches:
            for task, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                if task != key:
                    yield made()
                    key, nodes, sets = task, [], []
                if not nodes or nodes[-1] != node:  # repeated rows
                    nodes.append(node)
                    sets.append(np.unique(shingle_hashes(text.as_py() or b"", width, seed)))
        yield made()

    dealt = texts.select("task", "node", "text").repartition("task").sortWithinPartitions("task", "node")
    return dealt.mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, width: int = 5, similarity: float = 0.8, part: int = PART) -> DataFrame:
    """docs without near-duplicates: of each component the row with the least (doc_id, text hash) stays whole.

    Documents are linked if the Jaccard similarity of their sets of five-word shingles is at least 0.8, which is checked
    exactly for each link; candidates share a MinHash band, as a pair at just 0.8 does with probability 0.9998. Rows
    keep their columns, whatever their names; texts without words form one group. The row that stays is found by two aggregations, over
    shingle sets and over components; no component is joined with its rows. An empty table gives none."""
    prints = materialise(shingle_sets(docs, width), "prints")
    found = components(verified_links(docs, prints, similarity, width, part)).withColumnRenamed("node", "member")
    nodes = prints.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("row"))
    linked = nodes.join(found, F.col("node") == F.col("member"), "left")
    keep = materialise(linked.groupBy(F.coalesce("root", "node")).agg(F.min("row").alias("row")).select("row.*"), "keep")
    keep = keep.select(F.coalesce("doc_id", F.lit(-1)).alias("d"), F.col("doc_id").isNull().alias("n"), F.col("th").alias("t"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d"), F.col("doc_id").isNull().alias("n"), text_hash().alias("t"))
    # one shuffle serves the join and the repeated rows: both are by the same columns
    return keyed.join(keep, ["d", "n", "t"], "left_semi").dropDuplicates(["d", "n", "t"]).select("row.*")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = simhash_components(docs, width=3, radius=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
