"""Periodic runs against a search over all periods, and the query's digests against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tremor.llm import recompression, registry

WORDS = lambda t: [w for w in re.split(r"[ \t-\r]+", t or "") if w]


def plain_runs(x):
    """(start, end, period) by start and period: for each period the longest stretches, of equal ones the smallest period."""
    found, n = {}, len(x)
    for q in range(1, n // 2 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and x[e] == x[e + q]:
                e += 1
            if e > s and e + q - s >= max(12, 2 * q):
                found.setdefault((s, e + q), q)
            s = max(e, s) + 1
    return sorted(((s, e, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def found(texts):
    first = np.r_[0, np.cumsum([len(t) for t in texts])]
    out = [[] for _ in texts]
    for t, s, e, q in zip(*(x.tolist() for x in recompression.runs(np.array([w for t in texts for w in t], np.int64), first)), strict=True):
        out[t].append((s, e, q))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_runs_of_random_texts(seed):
    draw, texts = random.Random(seed), []
    for _ in range(20):
        k, n = draw.choice([1, 2, 2, 3, 5, 40]), draw.choice([0, 1, 11, 12, 13, 40, 120, 300])
        x = [draw.randrange(k) for _ in range(n)]
        if n > 12 and draw.random() < 0.6:
            p, a = draw.randint(1, n // 3 + 1), draw.randrange(n)
            x = [x[a + (i - a) % p] if i >= a and a + (i - a) % p < n else x[i] for i in range(n)]
        if n > 40 and draw.random() < 0.3:
            x = x[:20] + x[:7] * 6 + x[20:] + (x[:7] * 2)[:13]
        texts.append(x)
    assert found(texts) == [plain_runs(x) for x in texts]


def test_runs_of_fibonacci_and_equal_words():
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    assert found([b, a, [7] * 500]) == [plain_runs(b), plain_runs(a), [(0, 500, 1)]]


def test_grid_beyond_the_kept_one(monkeypatch):
    monkeypatch.setattr(recompression, "GRID", 64)
    monkeypatch.setattr(recompression, "QUERIES", 50)
    monkeypatch.setattr(recompression, "_GRID", {})
    draw = random.Random(8)
    x = [draw.randrange(3) for _ in range(150)]
    texts = [x + x + x[:40], x[:70] * 3, x[:20]]
    assert found(texts) == [plain_runs(t) for t in texts]


def test_extensions():
    draw = random.Random(2)
    x = np.array([draw.randrange(2) for _ in range(700)] + [0] * 200 + [0, 1] * 150 + [9])
    g = recompression.Grammar(x)
    a, b = np.array([draw.randrange(len(x) - 1) for _ in range(4000)]), np.array([draw.randrange(len(x) - 1) for _ in range(4000)])
    a, b = a[a != b], b[a != b]
    want = [next(k for k in range(len(x)) if x[i + k] != x[j + k] or max(i, j) + k == len(x) - 1) for i, j in zip(a, b, strict=True)]
    assert g.extend(a, b).tolist() == want


def planted(doc_id, words):
    if doc_id is None or not words or zlib.crc32(str(doc_id).encode()) % 10:
        return words
    g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    x = planted(doc_id, WORDS(text))
    runs = [(s, e - s, q) for s, e, q in plain_runs(x)]
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(x) if i not in drop)))


def test_query_on_awkward_documents(spark, docs, none, tmp_path):
    more = spark.createDataFrame([(300 + k, " ".join(["a", "b", "c"][: 1 + k % 3] * (4 + k)) + " x", "en", "s", None, 0.5, True, 9, "k", 3) for k in range(40)], docs.schema)
    both = docs.union(more)
    both.write.parquet(f"{tmp_path}/a/documents.parquet")
    got = registry.op13_runs(spark, f"{tmp_path}/a")
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [digest(r.doc_id, r.text) for r in both.collect()]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert sum(w[1] for w in want) > 20
    none.write.parquet(f"{tmp_path}/b/documents.parquet")
    assert registry.op13_runs(spark, f"{tmp_path}/b").count() == 0


def test_other_columns_come_along(spark, docs):
    out = recompression.collapse_runs(docs, keep=["doc_id", "text", "length"]).collect()
    assert len(out) == docs.count()
    for r in out:
        assert r.n_words == len(WORDS(r.rest.text)) and r.n_words - r.n_removed == len(WORDS(r.text)) and r.rest.length == 3
