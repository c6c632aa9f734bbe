"""Line dedup against a search for all maximal repeated runs; the helpers it uses."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataquill.llm.common import split_join
from strataquill.llm.op07_lines import MIN_CHARS, dedup_lines, op7_lines, select, windows


def brute_maximal_runs(texts, least=MIN_CHARS):
    """Lines to delete: in a run equal to an earlier run that it doesn't overlap, extended as far as both are equal."""
    lines = [[(n, s) for n, line in enumerate(t.split("\n")) if (s := line.strip())] for t in texts]
    gone = [set() for _ in texts]
    for d, own in enumerate(lines):
        for e in range(d + 1):
            for i in range(len(own)):
                for j in range(len(lines[e]) if e < d else i):
                    n = 0
                    while i + n < len(own) and j + n < (len(lines[e]) if e < d else i) and own[i + n][1] == lines[e][j + n][1]:
                        n += 1
                    if n and sum(len(s) for _, s in own[i : i + n]) >= least:
                        gone[d].update(range(own[i][0], own[i + n - 1][0] + 1))
    return [sorted(g) for g in gone]


def texts_with_runs(seed, n=30):
    a, b, c = "long line " * 8, "ten chars.", "é" * 20
    texts = [f"{a}\n{b}\n\n{c}\nown first", f"before\n{a}\n{b}\n{c}\nown second", f"{b}\n{a}\n{c}", f"x\n{a}\n{c}\n{b}"]
    texts += ["two short lines here, hardly fifty\ncharacters in all of it", "two short lines here, hardly fifty\ncharacters in all of it", "boilerplate that stands alone in one line of two documents", "other\n  boilerplate that stands alone in one line of two documents \nmore", "tiny", "tiny", "", "\n\n"]
    rng = np.random.default_rng(seed)
    pool = [chr(97 + k) * size for k, size in enumerate((1, 2, 5, 12, 20, 24, 26, 49, 50, 70))]
    return texts + ["\n".join(pool[k] for k in rng.integers(0, 10, int(rng.integers(1, 14)))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_maximal_runs(spark, tmp_path, seed):
    texts = texts_with_runs(seed)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in op7_lines(spark, str(tmp_path)).collect()}
    want = brute_maximal_runs(texts)
    assert [sorted(out[i].removed) for i in range(len(texts))] == want
    assert want[1] == [1, 2, 3] and want[5] == [0, 1] and want[7] == [1] and want[9] == []
    for i, t in enumerate(texts):
        kept = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i])
        assert (out[i].n_lines, out[i].n_removed, out[i].kept_crc32) == (t.count("\n") + 1, len(want[i]), zlib.crc32(kept.encode()))


def test_selection_is_thinner_than_the_lines():
    text = "\n".join(f"{i:02}" for i in range(100)).encode()
    rows = select(text)
    assert 4 <= len(rows) < 40  # windows of 25 lines: one least line for many of them
    own = {(lines[a], lines[b]) for _, at, lines, sizes, digests in rows for a, b, _ in windows(at, sizes, digests)}
    assert own == {(i, i + 24) for i in range(76)}
    assert select(b"") == [] and select(b"short\ntext") == []


def test_edges(spark):
    long = "this one line is long enough to be a run of its own, surely"
    rows = [(None, long, "x"), (1, long, "y"), (1, long, "y"), (2, f"{long}\n{long}", "z"), (3, None, "n"), (4, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = sorted((r.doc_id or 0, r.n_lines, r.removed, r.text) for r in dedup_lines(docs).collect() if r.text is not None)
    assert out == [(0, 1, [], long), (1, 1, [0], ""), (1, 1, [0], ""), (2, 2, [0, 1], ""), (4, 1, [], "")]
    assert [(r.doc_id, r.n_lines) for r in dedup_lines(docs).collect() if r.text is None] == [(3, 1)]
    assert dedup_lines(docs.limit(0)).count() == 0
    odd = spark.sql("select id doc_id, cast(concat(cast('" + long + "\n' as binary), x'61FF') as string) text from range(2)")
    assert sorted(tuple(r) for r in dedup_lines(odd).select("doc_id", "removed", F.hex(F.col("text").cast("binary"))).collect())== [(0, [], (long + '\n').encode().hex().upper() + '61FF'), (1, [0, 1], '')]


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_split_join(spark, how):
    rows = spark.createDataFrame([(i, 1 if i < 40 else i) for i in range(60)], "i long, k long")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("a"))
    keyed = spark.createDataFrame(keyed.where("k < 55").collect())
    got = split_join(rows, keyed, "k", how, hot=7)
    assert sorted((r.i, r.k) for r in got.collect()) == [(i, 1 if i < 40 else i) for i in range(55)]
    assert ("a" in got.columns) == (how == "inner")
