"""The toxicity query against brute-force cosine over all examples."""

import math
import zlib
from collections import Counter

import numpy as np

from strataquill.llm.op01_toxicity import FLOOR, SOFT, fit, score_toxicity, terms_of


def test_whole_query_by_brute_force(spark):
    rng = np.random.default_rng(11)
    texts = []
    for i in range(700):
        words = [f"n{t}" for t in rng.zipf(1.3, int(rng.integers(0, 60))) % 400]
        texts.append(" ".join(words + [f"bad{rng.integers(0, 6)}"] * int(i % 7 == 0)))
    texts += texts[:40] + ["", "unknown words only"]
    docs = spark.createDataFrame([*enumerate(texts), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(0, 700, 2)], "doc_id long, toxic int")
    train = [i for i in range(0, 700, 2) if zlib.crc32(str(i).encode()) % 5]
    counts = {i: Counter(terms_of(texts[i].encode())) for i in train}
    df = Counter(t for x in [*texts, ""] for t in set(terms_of(x.encode())))
    n1 = sum(i % 7 == 0 for i in train)
    n0, has = len(train) - n1, {y: Counter(t for i in train if (i % 7 == 0) == y for t in counts[i]) for y in (0, 1)}
    odds = lambda n, of: math.log((n + 0.5) / (of - n + 0.5))
    vocab = sorted({t for c in counts.values() for t in c})
    weight = [(math.log((1 + len(texts) + 1) / (1 + df[t])) + 1) * (FLOOR + abs(odds(has[1][t], n1) - odds(has[0][t], n0))) for t in vocab]
    place = {t: i for i, t in enumerate(vocab)}

    def unit(c):
        v = np.zeros(len(vocab))
        for t, n in c.items():
            if t in place:
                v[place[t]] = (1 + math.log(n)) * weight[place[t]]
        return v / (np.linalg.norm(v) or 1)

    examples = np.array([unit(counts[i]) for i in train])
    toxic = np.array([i % 7 == 0 for i in train])
    index, k = fit(docs, labels, k=9), 9

    def want(text):
        sims = np.round(examples @ unit(Counter(terms_of(text.encode()))), 12)
        kth = np.sort(sims)[-k]
        near = (sims >= kth - 1e-11) & (sims > 1e-12)
        w = near / (np.maximum(1 - sims, 0) + SOFT)
        raw = (w * toxic).sum() / w.sum() if near.any() else -1.0
        return 0.999 * np.interp(raw, *index.steps) + 0.001 * (raw + 1) / 2

    out = score_toxicity(docs, labels, k=9).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        assert abs(r.score - want("" if r.doc_id is None else texts[r.doc_id])) < 1e-6


def test_how_many_columns_are_full_changes_nothing():
    from strataquill.llm.op01_toxicity import Index

    rng = np.random.default_rng(3)
    vocab = [f"t{i}".encode() for i in range(60)]
    rows = [(i, int(i % 3 == 0), {vocab[t]: int(rng.integers(1, 4)) for t in rng.zipf(1.5, 8) % 60}) for i in range(300)]
    texts = [b" ".join(vocab[t] for t in rng.zipf(1.4, 12) % 60) for _ in range(150)] + [b"", b"none"]
    some = [Index(rows, {t: 5 for t in vocab}, 1000, k=7, dense=n).score_texts(texts) for n in (0, 5, 60)]
    assert some[0] == some[1] == some[2]
    one = Index(rows, {t: 5 for t in vocab}, 1000, k=7)
    assert some[0] == [one.score(Counter(terms_of(t))) for t in texts]


def test_edges(spark):
    docs = spark.sql("select 1L doc_id, cast(x'616263FF20646566' as string) text, 'x' score union all select null, null, 'y' union all select 2, 'abc', 'z' union all select 2, 'abc', 'z'")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    out = score_toxicity(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted", "evidence"] and out.count() == 4
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert score_toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
