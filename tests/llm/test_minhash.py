"""Near-duplicate components against all pairs, and components against union-find."""

import random
import re

import pytest

from tremor.llm import minhash
from tremor.llm.components import components


def shingles(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode())) if w]
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


class Union(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_all_pairs(docs, none, percent):
    rows = [(r.doc_id, shingles(r.text)) for r in docs.select("doc_id", "text").collect()]
    want = components_of(rows, percent)
    got = minhash.near_duplicates(docs, percent).collect()
    assert order((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == order((i, len(x), c, i is None or i == c) for (i, x), c in zip(rows, want, strict=True))
    assert minhash.near_duplicates(none, percent).count() == 0


def order(rows):
    return sorted(rows, key=str)


def components_of(rows, percent):
    """By all pairs: the smallest id reachable from each row (id, set); an equal id is no link."""
    u = Union()
    for i, (a, x) in enumerate(rows):
        for j, (b, y) in enumerate(rows[:i]):
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                u.join(i, j)
    least = {}
    for i, (a, _) in enumerate(rows):
        least[u.find(i)] = min(least.get(u.find(i), a), a) if a is not None else None
    return [least[u.find(i)] for i in range(len(rows))]


def test_rows_with_one_id_and_different_texts(spark):
    draw = random.Random(21)
    x, y = ([f"t{draw.randrange(10**6)}" for _ in range(50)] for _ in range(2))
    near = lambda w: [*w[:25], "other", *w[26:]]
    rows = [(1, x), (5, near(x)), (5, y), (9, near(y)), (5, y), (7, []), (5, [])]
    for _ in range(3):
        draw.shuffle(rows)
        docs = spark.createDataFrame([(i, " ".join(w), 3, "h") for i, w in rows], "doc_id long, text string, v int, text_hash string")
        want = components_of([(i, shingles(" ".join(w))) for i, w in rows], 80)
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, 80).collect()]
        assert order(got) == order((i, len(shingles(" ".join(w))), c) for (i, w), c in zip(rows, want, strict=True))


def test_a_group_wider_than_the_threshold(spark):
    """Many copies of one text with edits of different sizes: links form a chain, buckets are larger than a cell."""
    draw = random.Random(3)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(150):
        words = base[:]
        for _ in range(draw.choice([1, 2, 3, 6, 9, 14])):
            words[draw.randrange(200)] = f"e{draw.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    cell, minhash.CELL = minhash.CELL, 16
    try:
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    finally:
        minhash.CELL = cell
    sets, u = [shingles(t) for _, t in rows], Union()
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                u.join(i, j)
    assert got == {k: u.find(k) for k in range(150)}


def test_components(spark):
    draw = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(draw.randrange(60), draw.randrange(60)) for _ in range(40)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3), (100, 101)]
    u = Union()
    for a, b in edges:
        if a is not None and a != b:
            u.join(a, b)
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: u.find(x) for x in list(u) if u.find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_low_bytes_that_agree_by_chance_dont_lose_a_pair(spark):
    """The pair's signatures share the low bytes of band 0 but not its bucket; their first bucket is band 1, and theirs alone."""
    draw = random.Random(817)
    words = [f"w{draw.randrange(10**6)}" for _ in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:30], "other", *words[31:]]))], "doc_id long, text string")
    one, two = minhash.signatures(docs.withColumn("text_hash", minhash.text_hash("text"))).orderBy("doc_id").collect()
    assert one.sig[:4] == two.sig[:4] and one.keys[0] != two.keys[0] and one.keys[1] == two.keys[1]
    assert [r.component_id for r in minhash.near_duplicates(docs, 80).collect()] == [1, 1]
