"""Event clusters against brute force over all pairs."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tremor.operators import clusters


def union(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("large", [8192, 3])
def test_near_links_join_what_is_near(spark, large, monkeypatch):
    monkeypatch.setattr(clusters, "LARGE", large)
    draw = random.Random(4)
    prints = [draw.getrandbits(64) for _ in range(40)]
    for _ in range(160):
        p = draw.choice(prints)
        for _ in range(draw.randint(1, 4)):
            p ^= 1 << draw.randrange(64)
        prints.append(p)
    prints = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    links = clusters.near_links(spark.createDataFrame([(p,) for p in prints] + [(prints[0],)], "print long"))
    at = {p: k for k, p in enumerate(prints)}
    got = union(len(prints), [(at[r.a], at[r.b]) for r in links.collect()])
    near = [(i, j) for i, j in combinations(range(len(prints)), 2) if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= clusters.DISTANCE]
    assert got == union(len(prints), near) and len(set(got)) < len(got) - 20
    assert links.count() < 25 * len(prints)


def test_components_of_chains_stars_and_rings(spark):
    chain = [(k, k + 1) for k in range(0, 60)]
    star = [(1000, 1000 - k) for k in range(1, 80)]
    ring = [(2000 + k, 2000 + (k + 1) % 7) for k in range(7)]
    got = {r.id: r.root for r in clusters.components(spark.createDataFrame(chain + star + ring + [(5, 5)], "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[1000 - k] == 921 for k in range(80)) and all(got[2000 + k] == 2000 for k in range(7))
    assert clusters.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_event_clusters_on_awkward_articles(spark):
    draw = random.Random(6)
    vocabulary = ["".join(draw.choice("aeioulmnrst") for _ in range(6)) for _ in range(400)]
    story = [draw.choice(vocabulary) for _ in range(300)]
    near = story[:]
    near[150] = "other"
    rows = [(1, " ".join(story)), (2, " ".join(near)), (3, " ".join(story)), (3, " ".join(draw.choice(vocabulary) for _ in range(200))), (4, None), (5, ""), (6, "!!"), (7, "word"), (8, "Word."), (None, " ".join(story)), (None, "alone and without an id")]
    df = spark.createDataFrame([(i, t, "c", 1.0) for i, t in rows], "doc_id long, text string, cluster_id string, print double")
    got = sorted(((r.id, r.cluster_id, r.cluster_size) for r in clusters.event_clusters(df).collect()), key=str)
    assert got == sorted([(1, 1, 4), (2, 1, 4), (3, 1, 4), (3, 3, 1), (4, 4, 1), (5, 5, 1), (6, 6, 1), (7, 7, 2), (8, 7, 2), (None, 1, 4), (None, None, 1)], key=str)
    assert clusters.event_clusters(df.limit(0)).count() == 0


def test_one_vote_a_cluster(spark):
    rows = [("a", 1, 1.0), ("a", 1, 0.0), ("a", 1, 1.0), ("a", 2, 0.0), ("b", 1, 1.0)]
    got = {r.lang: r for r in clusters.votes(spark.createDataFrame(rows, "lang string, cluster_id long, score double"), ["lang"]).collect()}
    assert (got["a"].n_articles, got["a"].n_events, got["a"].attention, got["a"].event_risk, got["a"].amplification) == (4, 2, 0.5, 0.5, 2.0)
    assert got["b"].event_risk == 1.0


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_forests_of_many_buckets_whatever_the_batches(size):
    """Buckets of 1 to 150 prints, cut anywhere by batches: the components of brute force, one link for each other print."""
    draw, rows = random.Random(size), []
    for key, many in enumerate([1, 2, 2, 5, 40, clusters.FEW, clusters.FEW + 1, 150]):
        seeds = [draw.getrandbits(60) for _ in range(max(1, many // 6))]
        prints = sorted({draw.choice(seeds) ^ sum(1 << draw.randrange(60) for _ in range(draw.randrange(3))) for _ in range(many)})
        rows += [(p, 1, 0, key) for p in prints]
    batches = [pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*rows[k : k + size], strict=True)], ["print", "t", "part", "key"]) for k in range(0, len(rows), size)]
    got = [(r["a"], r["b"]) for b in clusters._forests(iter(batches)) for r in b.to_pylist()]
    want = []
    for key in range(8):
        mine = [r[0] for r in rows if r[3] == key]
        near = [(i, j) for i, j in combinations(range(len(mine)), 2) if (mine[i] ^ mine[j]).bit_count() <= clusters.DISTANCE]
        want += [(mine[a], p) for a, p in zip(union(len(mine), near), mine, strict=True) if mine[a] != p]
    assert sorted(got) == sorted(want) and len(want) > 20
