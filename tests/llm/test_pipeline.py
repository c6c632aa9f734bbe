"""The whole pipeline against a brute-force version of its five stages."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM, BLANK = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")


def failures(text):
    w = BLANK.findall(text)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    rep = len({j for s in at.values() if len(s) > 1 for i in s for j in range(i, i + 8)})
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    chars = sum(map(len, w))
    base = len(w) < 20 or 100 * rep > 30 * len(w)
    soft = 10 * len(re.findall(r"[#*$%&|<>]", text)) > len(w) or 2 * (len(lines) - len(set(lines))) > len(lines) or chars > 15 * len(w) or chars < 2 * len(w)
    return base, base or soft


def quality(rows):
    judged = [(r, *failures(r["text"] or "")) for r in rows]
    n, x = Counter(r["source"] or "" for r, _, _ in judged), Counter(r["source"] or "" for r, _, f in judged if f)
    total, k = sum(n.values()), len(n)
    mean = sum(x.values()) / total
    noise, width = mean * (1 - mean), total - sum(v * v for v in n.values()) / total
    spread = sum(n[h] * (x[h] / n[h] - mean) ** 2 for h in n)
    between = (spread - (k - 1) * noise) / (width - (k - 1))
    strength = min(max(noise / between - 1, 1.0), 1e6) if between > 0 else 1e6
    bad = {h for h in n if (x[h] + mean * strength) / (n[h] + strength) > 0.5}
    return [r for r, base, _ in judged if not base and (r["source"] or "") not in bad]


def place(r):
    th = xxhash.xxh64_intdigest((r["text"] or "").encode(), 42)
    return r["doc_id"] is not None, r["doc_id"] or 0, th - 2**64 if th >= 2**63 else th


def near_duplicates(rows):
    sets = []
    for r in rows:
        w = BLANK.findall((r["text"] or "").translate(LOW))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    order = sorted(range(len(rows)), key=lambda i: place(rows[i]))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = defaultdict(set)
    for i, s in enumerate(sets):
        for g in s or {()}:
            by[g].add(i)
    for i, j in {(i, j) for v in by.values() for i in v for j in v if i < j}:
        if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    kept = {}
    for i in order:
        kept.setdefault(find(i), i)
    return [rows[i] for i in kept.values()]


def benchmark(rows, items, window=10):
    out = []
    grams = [tuple(w[i : i + window]) for w in items for i in range(max(len(w) - window + 1, 1)) if w]
    firsts = defaultdict(list)
    for g in set(grams):
        firsts[g[0]].append(g)
    for r in rows:
        spans = [(m.start(), m.end()) for m in ALNUM.finditer((r["text"] or "").translate(LOW))]
        w = [(r["text"] or "").translate(LOW)[a:b] for a, b in spans]
        hit = {j for i in range(len(w)) for g in firsts.get(w[i], ()) if tuple(w[i : i + len(g)]) == g for j in range(i, i + len(g))}
        if len(hit) > 0.5 * len(w):
            continue
        if hit:
            text, at = "", 0
            for i in sorted(hit):
                if i - 1 not in hit:
                    text += r["text"][at : spans[i][0]]
                at = spans[i][1]
            text += r["text"][at:]
            r = {**r, "text": text, "n_chars": len(text)}
        out.append(r)
    return out


def mixture(rows, fraction=0.8, seed=7):
    from strataquill.llm.op05_mix import LEVELS, WEIGHTS

    named = []
    for r in rows:
        digit = re.search(r"(\d)\d*$", r["source"] or "")
        named.append((r, {"domain": digit[1] if digit else "-", "lang": r["lang"] or "", "source": r["source"] or ""}, len(BLANK.findall(r["text"] or ""))))
    weights = {(at, name): w for at, name, w in WEIGHTS}
    out = []

    def share(budget, some, levels):
        cap = sum(n for _, _, n in some)
        if not levels:
            left = int(np.floor(budget + 1e-6))
            whole = cap > 0 and left >= cap
            left -= cap * whole
            key = lambda x: (hashlib.md5(f"{seed}:{int(whole)}:{'null' if x[0]['doc_id'] is None else x[0]['doc_id']}".encode()).hexdigest(), x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, hashlib.md5((x[0]["text"] or "").encode()).hexdigest())
            before = 0
            for r, _, n in sorted(some, key=key):
                if whole or (n and before < left):
                    out.append(r)
                before += n
            return
        groups = defaultdict(list)
        for x in some:
            groups[x[1][levels[0]]].append(x)
        caps = {g: sum(n for _, _, n in v) for g, v in groups.items()}
        todo, given, left = set(groups), {}, budget
        while todo:
            level = left / sum(weights.get((levels[0], g), 1.0) for g in todo)
            full = {g for g in todo if caps[g] <= level * weights.get((levels[0], g), 1.0)}
            if not full:
                given.update({g: level * weights.get((levels[0], g), 1.0) for g in todo})
                break
            given.update({g: caps[g] for g in full})
            left -= sum(caps[g] for g in full)
            todo -= full
        for g, v in groups.items():
            share(given[g], v, levels[1:])

    share(int(sum(n for _, _, n in named) * fraction), named, LEVELS)
    return out


def test_whole_run(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    own = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    long = " ".join(f"w{i * 37 % 101}x{i}" for i in range(120))
    base = {"lang": "en", "source": "src3", "n_chars": 7}
    made = [long, long + " tail of it", long.replace("w37x1 ", "other "), long.upper(), None, "", "short one", items[0], f"{long[:300]} {items[1]} {long[300:700]}", f"z {long} y {' '.join(items[2].split()[:12])} x", "İstanbul क़ " + long[5:400] + " end of क़it", "# " * 15 + "symbols " * 9]
    own += [{**base, "doc_id": 5000 + i, "text": t} for i, t in enumerate(made)] + [{**base, "doc_id": None, "text": "no id here " + long[50:600]}, {**base, "doc_id": 5000, "text": long, "lang": None, "source": None}]
    own += [{**base, "doc_id": 6000 + i, "text": f"{'| ' * 30}{i} junk of a host {long[i * 9 : i * 9 + 200]}", "source": "junkhost"} for i in range(30)]
    own += [{**base, "doc_id": 7000, "text": "good text on the host of junk: " + long[::-1], "source": "junkhost"}]
    spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in own], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = quality(own)
    assert not any(r["doc_id"] == 7000 for r in rows) and not failures(own[-1]["text"])[1]  # the host's verdict counts
    kept = near_duplicates(rows)
    assert len(kept) < len(rows)
    clean = benchmark(kept, [ALNUM.findall(t.translate(LOW)) for t in items])
    assert sum(r["text"] != k["text"] for r, k in zip(clean, kept)) or len(clean) < len(kept)
    mixed = mixture(clean)
    assert 0 < len(mixed) < len(clean)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, at = [], 0
    for r in sorted(mixed, key=place):
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    out = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r.doc_id is not None)
    assert out == sorted(w for w in want if w[0] is not None)
