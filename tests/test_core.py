"""Retrieval operators: hand-computed values, invariants, and islands against sequential folds."""

import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataquill.functions import text as T
from strataquill.operators import quality, relevance, search, segment, stats
from strataquill.plans import pipelines
from strataquill.plans.conditions import conditions, depths, judge_budget, one as condition


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_tokens_and_spans(spark):
    assert one(spark, T.tokens(F.lit("Take 48.5 mg SGLT-2, see 1.6.10."))) == ["take", "48.5", "mg", "sglt-2", "see", "1.6.10"]
    for a, want in (((0, 10, 20, 30), 0), ((0, 100, 50, 200), 50), ((0, 100, 10, 20), 10), ((0, 10, 10, 20), 0)):
        assert one(spark, T.overlap(*map(F.lit, a))) == want
    span = one(spark, T.locate_span(F.lit("x a  b\nc. y"), F.lit("a b c.")))
    assert (span.start, span.end) == (2, 9)
    assert one(spark, T.locate_span(F.lit("abc"), F.lit("zz"))) is None
    assert one(spark, T.normalise(F.lit("a\r\nb‑c­\u0002\x01d"))) == "a\nb-cd"


def test_errors_and_refusals(spark):
    for message, want in (("429 too many", True), ("503 UNAVAILABLE", True), ("400 INVALID_ARGUMENT 500", False), ("404", False), ("odd", False), ("read timeout", True)):
        assert one(spark, T.is_transient(F.lit(message))) is want
    assert one(spark, T.is_refusal(F.lit("The provided guideline extracts do not state this.")))


def test_rrf(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "question_id long, k long, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 13, 2), (1, 10, 3)], "question_id long, k long, rank int")
    out = {r.k: r for r in search.fuse({"dense": a, "sparse": b}, 5, "k").collect()}
    assert math.isclose(out[10].score, 1 / 61 + 1 / 63, abs_tol=1e-9) and out[11].sparse_rank is None and out[10]["rank"] == 1


def test_metrics(spark):
    gold = spark.createDataFrame([(1, 0, 7, 100, 800), (1, 1, 8, 0, 50), (2, 0, 7, 0, 10)], "question_id long, gold_idx int, doc_id long, start int, end int")
    hits = spark.createDataFrame([(1, 7, 0, 139, 1), (1, 7, 0, 140, 2), (1, 9, 100, 800, 3), (1, 7, 300, 900, 4)], "question_id long, doc_id long, start int, end int, rank int")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "question_id long")
    out = {r.question_id: r for r in relevance.question_metrics(asked, hits, gold, 5, 40).collect()}
    assert (out[1].precision, out[1].recall, out[1].rr, out[1].hit) == (0.4, 0.5, 0.5, True)
    assert (out[2].precision, out[2].recall, out[3].recall, out[3].hit) == (0, 0, 0, False)
    assert {r.precision for r in relevance.question_metrics(asked, hits, gold, 0, 40).collect()} == {0.0}
    gaps = {r.question_id: r.gap for r in relevance.nearest_gap(asked, hits, gold).collect()}
    assert gaps == {1: 0, 2: None, 3: None}


def test_locate_gold(spark, tmp_path):
    texts = ["x" * 30 + "the quick brown fox jumps over it", "no", "the quick brown fox jumps over it", "quick brown the fox jumps over", "xthe quick brown fox jumps overx. no", "Ünï çödé only", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = ["the quick brown fox jumps over", "no", "çödé", "fox jumps", "", "absent words of no document", "t", "the quick brown fox jumps over it and on"]
    items = spark.createDataFrame(list(enumerate(wanted)), "question_id long, text string")
    want = []
    for q, w in enumerate(wanted):
        found = [(d, t.find(w)) for d, t in enumerate(texts) if w and t and w in t]
        want += [(q, n, d, at, at + len(w)) for n, (d, at) in enumerate(found)]
    for index in (None, search.TextIndex(docs, "doc_id", str(tmp_path / "index"))):
        rows = relevance.locate_gold(items, docs, index).select("question_id", "gold_idx", "doc_id", "start", "end").collect()
        assert sorted(map(tuple, rows)) == want


def test_kept_index_equals_one_pass(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("question_id"), "text")
    index = search.TextIndex(docs, "doc_id", str(tmp_path / "index"), buckets=3)
    assert sorted(map(tuple, index.bm25(asked, 4).collect())) == sorted(map(tuple, search.bm25(docs, asked, 4).select("question_id", "doc_id", "score", "rank").collect()))
    plan = index.postings(spark.createDataFrame([("the",)], "term string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters")[1][:80]


def test_indexes_follow_their_table(spark, tmp_path):
    from strataquill.plans.indexes import text_index

    where = str(tmp_path / "t")
    get = lambda: text_index(spark, where, "t", "doc_id", lambda: spark.read.parquet(where))
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").write.parquet(where)
    first = get()
    assert get() is first and first.n == 1
    spark.createDataFrame([(2, "a c c")], "doc_id long, text string").write.mode("append").parquet(where)
    assert get() is not first and (get().n, get().words) == (2, 5)


def test_keep_zero(spark):
    docs = spark.createDataFrame([(i, "a" if i == 7 else f"w{i}") for i in range(30)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a"), (2, "none at all")], "question_id long, text string")
    out = search.bm25(docs, asked, 4, keep_zero=True).collect()
    assert sorted((r.question_id, r["rank"], r.doc_id) for r in out) == [(1, 1, 7), (1, 2, 0), (1, 3, 1), (1, 4, 2), (2, 1, 0), (2, 2, 1), (2, 3, 2), (2, 4, 3)]


def test_dense_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(40)], "k long, embedding array<float>")
    q = v.where("k < 4").select(F.col("k").alias("question_id"), "embedding")
    a, b = (sorted(map(tuple, search.dense(v, q, 3, "k", block).collect())) for block in (1, 1 << 20))
    assert a == b and len(a) == 12
    rows = [(i, np.array([i % 5, i % 3, 1.0])) for i in range(40)]
    want = [(i, j, round(float(x @ y), 9)) for i, x in rows[:4] for j, y in sorted(rows, key=lambda r: (-(x @ r[1]), r[0]))[:3]]
    assert sorted((r.question_id, r.k, r.score) for r in search.dense(v, q, 3, "k").collect()) == sorted(want)
    named = v.withColumn("k", F.format_string("c%02d", "k"))
    assert sorted((r.question_id, int(r.k[1:]), r.score) for r in search.dense(named, q, 3, "k").collect()) == sorted(want)
    assert search.dense(v, q.limit(0), 3, "k").count() == 0


def test_merge_undersized_against_fold(spark):
    rng, rows, want = random.Random(1), [], set()
    for d in range(150):
        at, spans = 0, []
        for _ in range(rng.randint(1, 8)):
            n = rng.choice([3, 8, 20])
            spans.append((at, at + n))
            at += n + 1
        rows += [(d, *s) for s in spans]
        out = []
        for s, e in spans:
            if out and e - s < 10:
                out[-1] = (out[-1][0], max(out[-1][1], e))
            else:
                out.append((s, e))
        if len(out) > 1 and out[0][1] - out[0][0] < 10:
            out[:2] = [(out[0][0], out[1][1])]
        want |= {(d, *s) for s in out}
    got = segment.merge_undersized(spark.createDataFrame(rows, "doc_id long, start long, end long"), 10)
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("size,overlap", [(300, 50), (1000, 150), (150, 0), (5000, 500)])
def test_fixed_spans(size, overlap):
    text = "\n\n".join(" ".join(f"Word{i} is 3.5 mg, e.g. so." for i in range(n)) for n in (3, 60, 1)) + "\n\n" + "x" * 3000
    spans = segment.fixed_spans(text, size, overlap)
    assert all(0 < e - s <= size for s, e in spans)
    assert all(a[1] - b[0] <= overlap for a, b in zip(spans, spans[1:]))
    left = set(range(len(text))) - {i for s, e in spans for i in range(s, e)}
    assert all(text[i].isspace() for i in left)


def test_halve():
    text = "ab " * 1000 + "z" * 900
    spans = segment.halve(text, 0, len(text), 400)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert all(e - s <= 400 for s, e in spans)


def test_semantic_chunks_and_offsets(spark):
    docs = spark.createDataFrame([(1, "Cats purr. Cats sleep. Cats eat.\n\nTax law is long. Tax law is dull. Tax law is old.")], "doc_id long, text string")
    chunks = pipelines.build_chunks(docs, condition(spark, "semantic", percentile=80.0, min_chars=5))
    checked = segment.check_offsets(chunks, docs)
    assert checked.where("exact").count() == chunks.count() >= 2
    moved = segment.check_offsets(chunks.withColumn("start", F.col("start") + 1), docs)
    assert moved.where("exact").count() == 0
    with pytest.raises(ValueError):
        pipelines.build_chunks(docs, condition(spark, "odd"))


def exact_signed_rank_p(diffs):
    """By all signs of the ranks."""
    d = sorted((x for x in diffs if x), key=abs)
    total = len(d) * (len(d) + 1) // 2
    plus = sum(i for i, x in enumerate(d, 1) if x > 0)
    low = min(plus, total - plus)
    sums = [sum(i for i in range(1, len(d) + 1) if m >> (i - 1) & 1) for m in range(2 ** len(d))]
    return min(1.0, 2 * sum(s <= low for s in sums) / 2 ** len(d))


def test_stats(spark):
    diffs = [1.5, -0.5, 2.0, 0.0, 3.0, -1.0, 2.5]
    clear = [1.5, -0.5, 2.0, 3.0, -1.0, 2.5, 0.25, 4.0]
    pairs = spark.createDataFrame([("a", d, 0.0, d) for d in diffs] + [("b", 1.0, 0.0, 1.0)] * 5 + [("c", 0.0, 0.0, 0.0)] * 6 + [("d", d, 0.0, d) for d in clear], "f string, x double, y double, diff double")
    w = {r.f: r for r in stats.wilcoxon(pairs, "f").collect()}
    assert set(w) == {"a", "c", "d"} and (w["a"].w, w["a"].n_used) == (3.0, 6) and (w["c"].w, w["c"].p) == (0.0, 1.0)
    assert math.isclose(w["d"].p, exact_signed_rank_p(clear))
    assert math.isclose(w["a"].p, math.erfc(abs(w["a"].z) / math.sqrt(2)), rel_tol=1e-6)
    tails = spark.createDataFrame([(z / 4,) for z in range(-40, 41)], "z double").select("z", stats.two_sided(F.col("z")).alias("p")).collect()
    assert all(math.isclose(r.p, math.erfc(abs(r.z) / math.sqrt(2)), rel_tol=2e-7) for r in tails)
    ps = spark.createDataFrame([("x", 0.01), ("y", 0.04), ("z", 0.03)], "id string, p double")
    assert {r.id: round(r.p_holm, 9) for r in stats.holm(ps, "p").collect()} == {"x": 0.03, "z": 0.06, "y": 0.06}
    medians = {r.f: r.median_diff for r in stats.effects(pairs, "f").collect()}
    assert medians == {f: sorted(v)[len(v) // 2] for f, v in (("a", diffs), ("b", [1.0] * 5), ("c", [0.0] * 6), ("d", clear))}


def test_bootstrap(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(0.3, 1, 400).round(2).tolist()
    pairs = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0)] * 5, "f string, diff double")
    mean, wide = sum(values) / 400, 1.96 * float(np.std(values)) / 20
    for block in (4096, 50):  # one block of values, and several
        ci = {r.f: r for r in stats.bootstrap_ci(pairs, "f", 3000, block=block).collect()}
        assert abs(ci["a"].ci_low - (mean - wide)) < 0.015 and abs(ci["a"].ci_high - (mean + wide)) < 0.015
        assert (ci["b"].ci_low, ci["b"].ci_high) == (1.0, 1.0)


def test_validator(spark):
    rows = [("q1", "Is it so?", "factual", "Yes it is so.", [(1, "p" * 50)], True), ("q2", None, "factual", "", None, False), ("q3", "What is the long dose here", "odd", "short", [(9, "z" * 50), (1, "tiny")], False)]
    schema = "question_id string, question string, question_type string, reference_answer string, gold_passages array<struct<doc_id:long,passage:string>>, verified boolean"
    known = spark.createDataFrame([(1, "aa " + "p" * 60)], "doc_id long, text string")
    got = {(r.question_id, r.message) for r in quality.issues(spark.createDataFrame(rows, schema), known).collect()}
    assert ("q1", "question is very short") in got and ("q3", "gold_passages[0]: unknown doc_id") in got and ("q3", "gold_passages[1]: passage is too short") in got
    assert {m for q, m in got if q == "q2"} == {f"missing required field '{f}'" for f in ("question", "reference_answer", "gold_passages")}


def test_conditions(spark):
    grid = conditions(spark, docs=("b", "a"))
    rows = {r.condition: r for r in grid.collect()}
    assert len(rows) == 5 and rows["fixed_dense_k5"].index_name == "a-b__fixed_1000_150" == rows["fixed_hybrid_k5"].index_name
    assert rows["baseline_noretrieval"].k == 0 and all(len(r.fingerprint) == 10 for r in rows.values()) and len({r.fingerprint for r in rows.values()}) == 5
    assert rows["semantic_dense_k5"].index_name == "a-b__semantic_p85_b1_m2000"
    assert condition(spark, docs=("b", "a")).fingerprint == rows["fixed_dense_k5"].fingerprint != condition(spark, size=999, docs=("b", "a")).fingerprint
    assert sorted(r.condition for r in depths(grid, "fixed_dense_k5").collect()) == ["fixed_dense_k10", "fixed_dense_k3", "fixed_dense_k5"]
    assert one(spark, judge_budget(F.lit(60), F.lit(5), F.lit(3500), 0.3)).total_tokens == 1_050_000
    with pytest.raises(ValueError):
        conditions(spark, top=3)


def test_white_space(spark):
    page = "HEADER\x85  Page 1 of 3\t\r\n\tbody one\xa0\u2028\t- item\x0b•\u3000dot\n\n"
    assert one(spark, T.lines(F.lit(page))) == page.splitlines() and one(spark, T.lines(F.lit(""))) == []
    odd = "".join(map(chr, [9, 28, 31, 32, 133, 160, 8232, 12288]))
    assert one(spark, T.strip(F.lit(f"{odd}a{odd}b{odd}"))) == f"{odd}a{odd}b{odd}".strip()
    assert one(spark, T.squeeze(F.lit(f"{odd}a{odd}b{odd}"))) == "a b"
    pages = spark.createDataFrame([(1, i, page.replace("Page 1", f"Page {i}").replace("body one", f"body {i}")) for i in range(3)], "doc_id long, page_no int, text string")
    furn = segment.furniture(pages)
    assert {r.line for r in furn.collect()} == {"HEADER", "- item", "•\u3000dot"}
    lines = segment.clean_lines(pages, furn.where("line <> '•\u3000dot'"))
    assert sorted({r.line for r in lines.collect()}) == ["", "- dot", "body 0", "body 1", "body 2"]
    docs = spark.createDataFrame([(1, "\tone\x0c\n\xa0\t- item\x85\n two\u2003\nthr-\nee")], "doc_id long, text string")
    assert [r.text for r in segment.reflow(docs).orderBy("block_no").collect()] == ["one", "- item two three"]
    tricky = one(spark, T.locate_span(F.lit("x a\\Eb.*  (c)\ny"), F.lit("a\\Eb.* (c)")))
    assert (tricky.start, tricky.end) == (2, 13)


def test_broken_utf8_pages(spark, tmp_path):
    from strataquill.sources import tables

    (tmp_path / "latin.txt").write_bytes("Café one.\n\nTwo".encode("latin-1"))
    rows = tables.read_pages(spark, str(tmp_path)).orderBy("page_no").collect()
    assert [r.text for r in rows] == ["Caf\ufffd one.", "Two"]


def test_end_to_end(spark, tmp_path):
    from strataquill.sources import tables

    (tmp_path / "one.txt").write_text("Header\nMetformin lowers glucose.\n1\n\nHeader\nStatins lower lipids in most adults.\n2\n\nHeader\nRest helps.\n3")
    pages = tables.read_pages(spark, str(tmp_path)).select(F.lit(1).cast("long").alias("doc_id"), "page_no", "text")
    docs = pipelines.ingest(pages)
    text = docs.first().text
    assert "Header" not in text and "Metformin lowers glucose." in text
    chunks = pipelines.build_chunks(docs.select("doc_id", "text"), condition(spark, size=40, overlap=0, min_chars=5))
    index = pipelines.build_index(chunks.withColumn("chunk_no", F.col("ordinal").cast("long")))
    asked = spark.createDataFrame([(1, "statins lipids")], "question_id long, text string")
    for how in ("dense", "hybrid"):
        top = pipelines.retrieve(index, asked, condition(spark, "fixed", how, 1), "chunk_no").join(index, "chunk_no").first()
        assert "Statins" in top.text
    assert tables.write_table(docs, str(tmp_path / "t"), "f1") and not tables.write_table(docs, str(tmp_path / "t"), "f1") and tables.write_table(docs, str(tmp_path / "t"), "f2")


def test_score_files(spark, tmp_path):
    from strataquill.sources import tables

    for name, body in (("a__q1__m__0", '{"score": 0.5}'), ("a__q2__m__0", '{"score": NaN}'), ("b__q1__m__0", "{bad")):
        (tmp_path / f"{name}.json").write_text(body)
    got = {(r.condition, r.question_id): r for r in tables.read_scores(spark, str(tmp_path)).collect()}
    assert got["a", "q1"].score == 0.5 and math.isnan(got["a", "q2"].score) and got["b", "q1"].bad


def test_without_corpus_operators(tmp_path):
    """The rest stands without the corpus operators, and a broken one is not passed over in silence."""
    import shutil
    import subprocess
    import sys

    import __spark_entry__ as e

    home = os.path.dirname(os.path.abspath(e.__file__))
    names = subprocess.run(["git", "-C", home, "ls-files", "*.py"], capture_output=True, text=True, check=True).stdout.split()
    for name in names:
        if os.path.exists(f"{home}/{name}") and not name.startswith(("strataquill/llm/", "tests/")) and name != "corpus_pipeline.py":
            os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
            shutil.copy(f"{home}/{name}", f"{tmp_path}/{name}")
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'bm25_top5' in q and set(o) <= set(q) and not any(n.startswith('op1') for n in q); print(len(q))"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert int(run().stdout) > 40
    os.makedirs(tmp_path / "strataquill/llm")
    (tmp_path / "strataquill/llm/__init__.py").write_text("")
    (tmp_path / "strataquill/llm/queries.py").write_text("import a_missing_dependency")
    (tmp_path / "corpus_pipeline.py").write_text("")
    assert "a_missing_dependency" in run().stderr


def test_postings_of_empty_texts(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, "...")], "doc_id long, text string")
    assert {tuple(r) for r in search.postings(docs, "doc_id").select("doc_id", "term", "tf", "dl").collect()} == {(1, "a", 2, 3), (1, "b", 1, 3)}


def test_follow_appends_new_files_once(spark, tmp_path):
    from strataquill.streaming.incremental import follow

    source, target, at = (str(tmp_path / n) for n in ("source", "target", "checkpoint"))

    def turn(rows):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(source)
        follow(spark, source, "doc_id long, text string", target, at).awaitTermination()
        return sorted((r.doc_id, r.text) for r in spark.read.parquet(target).collect())

    first = turn([(1, "One sentence here. " * 20)])
    assert {d for d, _ in first} == {1}
    both = turn([(2, "Another sentence there. " * 20), (1, "The first document once more. " * 20)])
    assert {d for d, _ in both} == {1, 2} and [x for x in both if x[0] == 1] == first
    follow(spark, source, "doc_id long, text string", target, at).awaitTermination()
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(target).collect()) == both


def test_mean_scores_round_by_their_thousandfold(spark, tmp_path):
    from strataquill.plans import queries

    cents = [3, 10, 3, 2, 1, 1, 7, 9, 10, 9, 4, 0, 8, 10, 8, 4, 8, 4, 5, 9, 5, 10, 6, 6, 5, 8, 7, 5, 3, 6, 9, 1, 5, 5, 5, 9, 7, 7, 7, 3]  # mean 0.0585
    rows = [(1, 1, "R", c / 100) for c in cents]
    spark.createDataFrame(rows, "l_linenumber int, l_suppkey long, l_returnflag string, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [r.value for r in queries._long(spark, str(tmp_path)).collect()] == [0.059]


def test_scan_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(0, 9))) for _ in range(300)]
    docs = spark.createDataFrame([*((f"k{i}", t) for i, t in enumerate(texts)), ("k", None)], "chunk_id string, text string").repartition(3)
    questions = {q: [rng.choice("abcdefghijz") for _ in range(4)] for q in range(9)}
    asked = spark.createDataFrame([(q, " ".join(w)) for q, w in questions.items()], "question_id long, text string")
    own = {f"k{i}": t.split() for i, t in enumerate(texts)} | {"k": []}
    df = {w: sum(w in t for t in own.values()) for w in "abcdefghij"}
    n, mean = len(own), sum(map(len, own.values())) / len(own)
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    floor = sum(raw.values()) / len(raw)
    want = set()
    for q, words in questions.items():
        score = {k: round(sum((0.25 * floor if raw[w] < 0 else raw[w]) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in words if w in t), 6) for k, t in own.items() if set(words) & set(t)}
        want |= {(q, k, s, i + 1) for i, (k, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5])}
    scan = search.TextScan(docs, "chunk_id", str(tmp_path / "terms"))
    got = scan.bm25(asked, 5)
    assert {tuple(r) for r in got.select("question_id", "chunk_id", "score", "rank").collect()} == want
    assert "postings" not in [p.name for p in tmp_path.iterdir()]


def test_semantic_chunks_equal_sentences_by_windows(spark):
    from strataquill.functions.vectors import dot

    texts = ["One two. Three four!  Five.\n\n Six seven? Eight\nnine. \t", "", "No end", None, "a. b. c. d. e. f. g. h.", "\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = segment.sentence_spans(docs)
    sents = spans.join(docs, "doc_id").withColumn("sentence", F.expr("substring(text, int(start) + 1, int(end - start))")).drop("text")
    vectors = segment.context_windows(sents).withColumn("embedding", pipelines.encode(F.col("context")))
    parts = segment.breakpoints(segment.distance_profile(vectors, "doc_id", "sent_no", dot), "doc_id", "sent_no", 85.0)
    whole = {(r.doc_id, texts[r.doc_id][r.a:r.b].strip()) for r in parts.groupBy("doc_id", "segment").agg(F.min("start").alias("a"), F.max("end").alias("b")).collect()}
    out = segment.chunk_semantic(docs, pipelines.encode)
    assert {(r.doc_id, texts[r.doc_id][r.start:r.end]) for r in out.collect()} == whole
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_words_and_windows_in_arrow_equal_columns(spark):
    import pyarrow as pa

    from strataquill.functions.text import tokens

    rng = random.Random(5)
    texts = ["", None, "a.b-c.", ".a", "a", "-", "A..b-.c-9", "Kelvin.İstanbul Ångström-ß.z", "Ünï.çödé\U0001f600x-y", "b.", ".c", "x-", "-y"]
    texts += ["".join(rng.choice("aB9.- éİK\U0001f600\n") for _ in range(rng.randrange(40))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [r.t or [] for r in docs.select("doc_id", tokens(F.col("text")).alias("t")).orderBy("doc_id").collect()]
    words, n = search.words_of(pa.array(texts).slice(1))
    assert words.to_pylist() == [w for t in want[1:] for w in t] and n.tolist() == [len(t) for t in want[1:]]
    row, number, cut = search.windows(pa.array([None, *texts]).slice(1), 7, 5)
    assert list(zip(row.tolist(), number.tolist(), cut.to_pylist())) == [(i, k, (t or "")[5 * k:5 * k + 7]) for i, t in enumerate(texts) for k in range(max(len(t or "") - 1, 0) // 5 + 1)]
    want = sorted(map(tuple, docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("t")).groupBy("t").count().collect()))
    got = [tuple(r) for r in search.frequencies(docs.repartition(3), most=2).collect()]
    assert sorted(r[:2] for r in got if r[0] is not None) == want and (None, len(texts), n.sum()) in got


def test_phrasings_read_chunks_without_shuffling_texts(spark, tmp_path, monkeypatch):
    """The texts of a large table are dealt anew by no reading, however few its splits; chunks are cut in Arrow, as SQL cuts them."""
    from strataquill.plans import queries

    texts = ["é" * 299 + "word-one " + "x" * 500, None, "", "a" * 400, "b" * 301]
    spark.createDataFrame([(i + 7, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    chunks = {(r.chunk_no, r.text or "") for r in queries._chunks(spark, str(tmp_path)).collect()}
    assert "Repartition" in queries._documents(spark, str(tmp_path))._jdf.queryExecution().toString()
    monkeypatch.setattr(queries, "DEALT", 0)
    docs = queries._documents(spark, str(tmp_path))
    assert "Repartition" not in docs._jdf.queryExecution().toString()
    batch = docs.toArrow().combine_chunks().to_batches()[0]
    assert set(zip(*[c.to_pylist() for c in queries._cut(batch.column(0), batch.column(1))])) == chunks
    scan = queries._chunk_scan(spark, str(tmp_path))
    assert (scan.n, scan.words) == (len(chunks), sum(len(re.findall(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*", t.lower())) for _, t in chunks))
