"""Token ids as a binary format: Simple-8b words, with escapes and per-block offsets.

Format, little-endian; a file table holds one segment a row (shard, seg, n_docs, n_ids, payload), rows in order:
  magic "S8B1", uint32 n_docs, n_ids, n_blocks, n_words, n_escapes;
  int64 doc_id[n_docs]; uint8 has_id[n_docs]; uint32 length[n_docs] (ids, end id included);
  uint32 block_word[n_blocks + 1]: the first word of each block of BLOCK ids; a word never spans two blocks;
  uint64 escape[n_escapes]; uint64 word[n_words].
A word's low 4 bits select how many values of how many bits its other 60 bits hold (COUNTS, WIDTHS). Selector 15 is an
escape: the word stands for one value of any size, at the index of its payload in the escape table. A last word of a
block may be partly filled; the id count says where it ends. Every block decodes alone, or all at once by selector.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataquill.llm.common import as_text, new_path, text_hash

# The values a word holds and their bits, by selector (selectors 0 and 1: runs of zeros).
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2], np.int64)
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30], np.int64)
ESCAPE = 15

BLOCK = 1024
SEGMENT = 262_144
END_ID = 2
#: Chunks an encoder remembers (some 200 bytes each), and bytes of text it takes at once.
REMEMBER, SLICE = 1_000_000, 8_000_000
_U = np.uint64


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """uint64 ids -> (words, block_word, escapes). Greedy: each word takes the most values that fit."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, _U), np.zeros(1, np.uint32), np.zeros(0, _U)
    bits = np.frexp(ids.astype(np.float64))[1].astype(np.int8)  # may round up from 2**53 on, where only escapes are
    # widest[i]: bits of the widest of the c ids from i on, within the block (missing ones count as zero)
    grid = np.zeros(blocks * BLOCK, np.int8)
    grid[:n] = bits
    grid = grid.reshape(blocks, BLOCK)
    left = (BLOCK - np.arange(BLOCK)).astype(np.int16)

    def spread(wide: np.ndarray, by: int) -> np.ndarray:
        out = wide.copy()
        if by < BLOCK:
            np.maximum(out[:, :-by], wide[:, by:], out=out[:, :-by])
        return out

    power, reach = {1: grid}, 1
    while reach * 2 <= 240:
        power[reach * 2] = spread(power[reach], reach)
        reach *= 2
    choice = np.full((blocks, BLOCK), ESCAPE, np.int8)
    for s in range(len(COUNTS) - 1, -1, -1):
        c = int(COUNTS[s])
        base = 1 << (c.bit_length() - 1)
        wide = spread(power[base], c - base) if c > base else power[base]
        np.copyto(choice, np.int8(s), where=wide <= np.int8(WIDTHS[s]))
    # one value of 31 to 60 bits, or one at a block's end that no count above holds, goes to the escape table
    took = np.minimum(np.append(COUNTS, 1).astype(np.int16)[choice], left[None, :])
    at, starts = np.zeros(blocks, np.int64), []
    size = np.full(blocks, BLOCK)
    size[-1] = n - (blocks - 1) * BLOCK
    live = np.arange(blocks)
    while len(live):
        starts.append(live * BLOCK + at[live])
        at[live] += took[live, at[live]]
        live = live[at[live] < size[live]]
    starts = np.sort(np.concatenate(starts))
    picked = choice.ravel()[starts]
    words = picked.astype(_U)
    padded = np.zeros((blocks, BLOCK + 240), _U)  # a word reads zeros, not the next block's ids
    whole = np.zeros(blocks * BLOCK, _U)
    whole[:n] = ids
    padded[:, :BLOCK] = whole.reshape(blocks, BLOCK)
    padded, place = padded.ravel(), starts + starts // BLOCK * 240
    for s in np.unique(picked):
        if s == ESCAPE or WIDTHS[s] == 0:
            continue
        of = np.flatnonzero(picked == s)
        from_ = place[of]
        acc = words[of]
        for k in range(int(COUNTS[s])):
            acc |= padded[from_ + k] << _U(4 + k * int(WIDTHS[s]))
        words[of] = acc
    far = np.flatnonzero(picked == ESCAPE)
    words[far] |= np.arange(len(far), dtype=_U) << _U(4)
    offsets = np.searchsorted(starts, np.arange(blocks + 1) * BLOCK)
    offsets[-1] = len(starts)
    return words, offsets.astype(np.uint32), ids[starts[far]]


def unpack(words: np.ndarray, block_word: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The n ids of all blocks at once; one block's words with its own count decode alike."""
    out = np.zeros(n, _U)
    if not n:
        return out
    picked = (words & _U(15)).astype(np.int64)
    counts = np.append(COUNTS, 1)[picked]
    upto = np.cumsum(counts)
    first = block_word[:-1].astype(np.int64)
    before = np.where(first > 0, upto[first - 1], 0)
    block = np.searchsorted(first, np.arange(len(words)), "right") - 1
    starts = upto - counts - before[block] + block * BLOCK
    limit = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(picked):
        of = np.flatnonzero(picked == s)
        if s == ESCAPE:
            out[starts[of]] = escapes[(words[of] >> _U(4)).astype(np.int64)]
        elif WIDTHS[s]:
            mask = (_U(1) << _U(WIDTHS[s])) - _U(1)
            for k in range(int(COUNTS[s])):
                there = starts[of] + k < limit[of]
                out[starts[of][there] + k] = (words[of][there] >> _U(4 + k * int(WIDTHS[s]))) & mask
    return out


def segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words, offsets, escapes = pack(ids.astype(_U))
    head = struct.pack("<4s5I", b"S8B1", len(doc_ids), len(ids), len(offsets) - 1, len(words), len(escapes))
    named = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is not None for d in doc_ids)
    return b"".join([head, named, np.array(lengths, "<u4").tobytes(), offsets.astype("<u4").tobytes(), escapes.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def read_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of one segment."""
    magic, n_docs, n_ids, n_blocks, n_words, n_escapes = struct.unpack_from("<4s5I", payload)
    if magic != b"S8B1":
        raise ValueError("not a token segment")
    at, parts = 24, []
    for dtype, n in (("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs), ("<u4", n_blocks + 1), ("<u8", n_escapes), ("<u8", n_words)):
        parts.append(np.frombuffer(payload, dtype, n, at))
        at += parts[-1].nbytes
    named, has, lengths, offsets, escapes, words = parts
    return [d if h else None for d, h in zip(named.tolist(), has)], lengths, unpack(words, offsets, escapes, n_ids)


class Encoder:
    """Encodes texts with a tokenizer whose pre-tokenizer never joins across white space and drops it: so the ids of
    a text are those of its blank-separated chunks in turn. Its normaliser lower-cases, and letters end at a full stop
    or comma, so chunks are met again lower-cased and without those. Chunks met before come from a bounded memory;
    every other one goes through the library. Texts that may hold a special token are only split at blanks."""

    def __init__(self, path: str, remember: int = REMEMBER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remember = remember
        model = json.loads(self.tokenizer.to_str())["model"]
        suffix = model.get("end_of_word_suffix")
        self.ends = None
        if suffix:
            self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _look_up(self, chunks: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(chunks, letters first; all their ids; counts). A chunk of letters is one piece to the pre-tokenizer, whose
        last id alone is a word end, so such chunks are encoded in runs and cut there; a run in which this does not hold is not used."""
        plain = [c.decode(errors="replace") for c in chunks]
        letters = [c for c, p in zip(chunks, plain) if p.isalpha()] if self.ends is not None else []
        runs = [letters[i : i + 256] for i in range(0, len(letters), 256)]
        alpha, parts, sizes = [], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([b" ".join(r).decode() for r in runs], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids])
            # every piece has one word end, so as many ends as chunks mean one piece each; the normaliser can break
            # letters into several (a dotted capital I, some Devanagari letters), and then the run's chunks go singly
            if len(ends) == len(run):
                alpha += run
                parts.append(ids)
                sizes.append(np.diff(ends, prepend=-1))
        ids, sizes = np.concatenate(parts), np.concatenate(sizes)
        met = set(alpha)
        rest = [c for c in chunks if c not in met]
        lists = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode(errors="replace") for c in rest], add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(lists), np.uint32, sum(map(len, lists)))
        return alpha + rest, np.concatenate([ids, flat]), np.concatenate([sizes, np.fromiter(map(len, lists), np.int64, len(lists))])

    def encode(self, texts: pa.Array | list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by END_ID; counts). Arrow splits the texts and numbers their distinct chunks,
        so that only those become Python objects."""
        if len(self.known) > self.remember or len(self.flat) > 8 * self.remember:
            self._reset()
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else as_text(texts), "")
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        # letters and a stop after them are separate pieces
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, r"([A-Za-z])([.,])([\t\n\v\f\r ]|$)", r"\1 \2\3"))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        known = self.known
        found = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        missed = np.flatnonzero(found < 0).tolist()
        if missed:
            new = [words[i] for i in missed]
            self._add(*self._look_up(new))
            found[missed] = [known[c] for c in new]
        found = found[coded.indices.to_numpy()]
        ends = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        took = np.insert(self.sizes[found], ends, 1)
        upto = np.cumsum(took)
        last = upto[ends + np.arange(len(ends))]
        ids = np.full(upto[-1], END_ID, np.uint32)
        text = np.ones(len(ids), bool)
        text[last - 1] = False
        ids[text] = self._ids(found)
        return ids, np.diff(np.r_[0, last])

    def _add(self, chunks: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.known.update(zip(chunks, range(len(self.sizes), len(self.sizes) + len(chunks))))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, ids])

    def _ids(self, chunks: np.ndarray) -> np.ndarray:
        took = self.sizes[chunks]
        upto = np.cumsum(took)
        return self.flat[np.repeat(self.starts[chunks] - (upto - took), took) + np.arange(took.sum())]


#: One encoder for each tokenizer in a Python worker: later tasks find the chunks that earlier ones met.
_encoders: dict[tuple[str, int], Encoder] = {}


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", remember: int = REMEMBER, slice_bytes: int = SLICE) -> None:
    """Encode docs (doc_id, text) and write them under path in ascending doc_id order (nulls first; ties by text).

    tokenizer: a file's path, or a name that the public_tokenizers package resolves. One shard is one range of
    doc_ids, sorted by spilling; a shard is a stream of segments of about SEGMENT ids, so memory is bounded by a
    batch of rows and the longest text. Null texts are empty; bytes that are not UTF-8 are read as U+FFFD; other columns
    are ignored; repeated rows are written each. No rows write no segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from strataquill.llm.op02_tokens import _encoders  # the worker's own, not a copy sent with the task

        where = tokenizer
        if os.sep not in where:
            import public_tokenizers

            where = public_tokenizers.path(where)
        if (where, remember) not in _encoders:
            _encoders[where, remember] = Encoder(where, remember)
        encoder, shard, seg = _encoders[where, remember], TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in _slices(batch, slice_bytes):
                ids, counts = encoder.encode(rows.column(1))
                names, upto = rows.column(0).to_pylist(), np.cumsum(counts)
                out, first = [], 0
                while first < len(names):
                    before = upto[first - 1] if first else 0
                    stop = max(first + 1, int(np.searchsorted(upto, before + SEGMENT, "right")))
                    payload = segment(names[first:stop], counts[first:stop].tolist(), ids[before : upto[stop - 1]])
                    out.append((shard, seg, stop - first, int(upto[stop - 1] - before), payload))
                    first, seg = stop, seg + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["shard", "seg", "n_docs", "n_ids", "payload"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("th"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, F.asc_nulls_first("doc_id"), "th").sortWithinPartitions(F.asc_nulls_first("doc_id"), "th").select("doc_id", "text")
    dealt.mapInArrow(run, "shard int, seg long, n_docs long, n_ids long, payload binary").write.option("compression", "none").parquet(path)


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most `most` bytes of text, or one row."""
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(1).cast(pa.binary())])
    upto, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = upto[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(upto, before + most, "right")))
        yield batch.slice(first, stop - first)
        first = stop


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of a written table: doc_id, start (ids before it), n_tokens, ids_crc32[, ids].

    Offsets come from id counts: shards are totalled, then segments within a shard, so no window spans the corpus
    but the one over shards."""
    table = spark.read.schema("shard int, seg long, n_docs long, n_ids long, payload binary").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, seg, payload in zip(*(batch.column(i) for i in range(3))):
                names, lengths, ids = read_segment(payload.as_py())
                ids, upto = ids.astype("<u4"), np.cumsum(lengths, dtype=np.int64)
                pieces = [ids[e - n : e] for e, n in zip(upto.tolist(), lengths.tolist())]
                cols = [pa.array([shard.as_py()] * len(names), pa.int32()), pa.array([seg.as_py()] * len(names), pa.int64()), pa.array(names, pa.int64()), pa.array(upto - lengths), pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64())]
                if with_ids:
                    cols.append(pa.array([p.tolist() for p in pieces], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, ["shard", "seg", "doc_id", "at", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    shards = table.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    shards = shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))
    segs = table.select("shard", "seg", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("seg")) - F.col("n_ids")).alias("off"))
    offsets = segs.join(shards, "shard").select("shard", "seg", (F.col("base") + F.col("off")).alias("base"))
    rows = table.select("shard", "seg", "payload").mapInArrow(run, "shard int, seg long, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    out = rows.join(offsets, ["shard", "seg"]).withColumn("start", F.col("base") + F.col("at"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


def encode_corpus(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", path: str | None = None, remember: int = REMEMBER, slice_bytes: int = SLICE) -> DataFrame:
    """Write docs' token ids (to path, or a new folder among the shared ones) and return the digests read back."""
    path = path or new_path(docs.sparkSession, "tokens", lasting=True)
    write_tokens(docs, path, tokenizer, remember, slice_bytes)
    return read_tokens(docs.sparkSession, path)


def op2_tokens(spark, sf_dir: str) -> DataFrame:
    return encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
