"""Clusters of near-equal articles by SimHash, and indices in which a cluster has one vote.

Equal fingerprints collapse first. Two fingerprints that differ in at most DISTANCE of 64 bits agree on three of six blocks, so
they meet in one of twenty tables, each keyed by three blocks; a bucket that is still large is dealt out once more, by the
quarter of its other bits on which such a pair must agree too. A bucket puts out a spanning forest of its links, at most one
link a fingerprint, never all pairs. Components come from min-label propagation with pointer jumping.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.sources.shared import written

DISTANCE = 3
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))  # first bit and length; with three differences, three agree
LARGE = 8192  # fingerprints of a bucket that is dealt out once more
FEW = 64  # prints of a bucket that is taken together with others
SALTS = 64
_REMEMBERED = 1 << 17  # word hashes that a task keeps
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20  # texts that a Python worker is handed at a time


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.md5(word.encode()).digest()[8:], "little")


def fingerprints(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print) of every row with a text of words: bit by bit the majority over its distinct pairs of neighbouring words (of a
    single word, that word), ties 0. Words are lower-case runs of letters and digits. Texts without words have a null print."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            out = []
            for text in batch.column(1):
                words = re.findall(r"[^\W_]+", (text.as_py() or "").lower())
                if len(known) > _REMEMBERED:
                    known.clear()
                for w in set(words):
                    if w not in known:
                        known[w] = word_hash(w)
                h = np.array([known[w] for w in words], np.uint64)
                pairs = np.unique(h[:-1] * np.uint64(31) + h[1:]) if len(h) > 1 else h
                if not len(pairs):
                    out.append(None)
                    continue
                up = np.zeros(64, np.int64)
                for k in range(0, len(pairs), 65536):
                    up += np.unpackbits(pairs[k : k + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                out.append(int(np.packbits(2 * up > len(pairs), bitorder="little").view("<i8")[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["id", "print"])

    return texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, print long")


def _bits(first: int, many: int) -> Column:
    return F.shiftrightunsigned("print", first).bitwiseAND(F.lit((1 << many) - 1).cast("long"))


def _labels(prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """For each print, sorted within its bucket, the place of the smallest print of its component of near prints there."""
    n, code, label = len(prints), prints.view(np.uint64), np.arange(len(prints))
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, n])
    for start, many in zip(first[size > FEW], size[size > FEW], strict=True):
        mine, of = code[start : start + many], np.arange(many)
        for k in range(many):
            near = np.flatnonzero(np.bitwise_count(mine[k + 1 :] ^ mine[k]) <= DISTANCE) + k + 1
            if len(near):
                old = np.unique(of[np.r_[k, near]])
                if len(old) > 1:
                    of[np.isin(of, old)] = old[0]
        label[start : start + many] = of + start
    # All pairs of all other buckets at once: print i and the one `apart` places behind it.
    left = np.repeat(np.where(size > FEW, 0, first + size), size) - np.arange(n)  # prints from here to the bucket's end
    near, here = [], np.flatnonzero(left > 1)
    for apart in range(1, FEW):
        here = here[left[here] > apart]
        if not len(here):
            break
        i = here[np.bitwise_count(code[here + apart] ^ code[here]) <= DISTANCE]
        near.append((i, i + apart))
    i, j = (np.concatenate(x) for x in zip(*near, strict=True)) if near else (label[:0], label[:0])
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b), a the smallest print of its component, between the prints of each bucket that are near each other. Rows come
    by bucket and print; many buckets are taken at a time, and the last one waits for the next batch."""

    def links(prints: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
        label = _labels(prints, bucket)
        other = label != np.arange(len(prints))
        return pa.RecordBatch.from_arrays([pa.array(prints[label[other]]), pa.array(prints[other])], ["a", "b"])

    rest: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
    for batch in batches:
        rows = [np.concatenate([r, batch.column(c).to_numpy().astype(np.int64)]) for r, c in zip(rest, ("print", "t", "part", "key"), strict=True)]
        if not len(rows[0]):
            continue
        bucket = np.cumsum(np.r_[0, (np.diff(np.stack(rows[1:])) != 0).any(axis=0)])
        done = int(np.searchsorted(bucket, bucket[-1]))
        if done:
            yield links(rows[0][:done], bucket[:done])
        rest = [r[done:] for r in rows]
    if len(rest[0]):
        yield links(rest[0], np.zeros(len(rest[0]), np.int64))


def near_links(prints: DataFrame) -> DataFrame:
    """(a, b) between distinct prints at most DISTANCE bits apart: enough of them to join all that are linked."""
    keys = [F.struct(F.lit(t).alias("t"), F.lit(0).cast("long").alias("part"), sum((_bits(*BLOCKS[k]) * F.lit(1 << 11 * n).cast("long") for n, k in enumerate(c)), F.lit(0).cast("long")).alias("key")) for t, c in enumerate(combinations(range(6), 3))]
    rows = prints.select("print").distinct().select("print", F.explode(F.array(*keys)).alias("k")).select("print", "k.*")
    large = written(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > LARGE).select("t", "key"), "large")
    if large.isEmpty():
        return _linked(rows)
    small = rows.join(large, ["t", "key"], "left_anti")
    # Within a bucket the differences lie in the three other blocks: a quarter of those bits has none.
    others = F.element_at(F.array(*(F.array(*(F.lit(BLOCKS[k][0] + i) for k in range(6) if k not in c for i in range(BLOCKS[k][1]))) for c in combinations(range(6), 3))), F.col("t") + 1)
    quarter = lambda q: F.aggregate(F.slice("others", 8 * q + 1, 8 if q < 3 else 16), F.lit(0).cast("long"), lambda acc, at: acc * 2 + F.call_function("bit_get", F.col("print"), at))
    again = rows.join(large, ["t", "key"], "left_semi").withColumn("others", others)
    parts = F.explode(F.array(*(F.struct(F.lit(q + 1).cast("long").alias("part"), quarter(q).alias("sub")) for q in range(4)))).alias("p")
    dealt = again.select("print", "t", "key", parts).select("print", "t", (F.col("key") * (1 << 16) + F.col("p.sub")).alias("key"), F.col("p.part").alias("part"))
    every = small.select("print", "t", "key", "part").unionByName(dealt.select("print", "t", "key", "part"))
    return _linked(every)


def _linked(rows: DataFrame) -> DataFrame:
    """The links of all buckets (t, part, key) of prints."""
    dealt = rows.repartition("t", "part", "key").sortWithinPartitions("t", "part", "key", "print")
    return dealt.select("print", "t", "part", "key").mapInArrow(_forests, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root) of all ends of links (a, b): the smallest id that can be reached. Each round takes the smallest label among the
    neighbours and then the label's own label, and is written, so a lost executor repeats one round at most."""
    both = written(links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        heard = lookup(both, "b", labels.select(F.col("id").alias("b"), "root")).groupBy(F.col("a").alias("id")).agg(F.min("root").alias("heard"))
        told = labels.join(heard, "id").select("id", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        jump = lookup(told, "root", labels.select(F.col("id").alias("root"), F.col("root").alias("further")))
        fresh = written(jump.select("id", "old", F.least("root", F.coalesce("further", "root")).alias("root")), "labels")
        labels = fresh.select("id", "root")
        if fresh.where("old <> root").isEmpty():
            return labels


def lookup(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """rows with the columns of `table` (one row a key) where it has their key. Rows ask in SALTS parts, each part once, so that
    no key's rows meet in one task."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    told = salted.select(key, "_salt").distinct().join(table, key)
    return salted.join(told, [key, "_salt"], "left").drop("_salt")


def event_clusters(articles: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, cluster_id, cluster_size) for every row of articles: the cluster is named by its smallest id, its size counts rows.

    Rows of equal ids are articles of their own. A text without words is near nothing: it is a cluster by itself, of size 1. A
    null id takes part but doesn't name a cluster; a cluster of such rows only has a null name.
    """
    spark = articles.sparkSession
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, BATCH_BYTES)
    try:
        prints = written(fingerprints(articles, id_col, text_col), "prints")
    finally:
        spark.conf.set(BATCH, before)
    with_words = prints.where("print is not null")
    distinct = written(with_words.groupBy("print").agg(F.min("id").alias("id"), F.count("*").alias("n")), "distinct")
    roots = components(near_links(distinct))
    rooted = distinct.join(roots.select(F.col("id").alias("print"), "root"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    named = rooted.groupBy("root").agg(F.min("id").alias("cluster_id"), F.sum("n").alias("cluster_size"))
    places = lookup(rooted.select("print", "root"), "root", named).drop("root")
    found = lookup(with_words, "print", places).select("id", "cluster_id", "cluster_size")
    alone = prints.where("print is null").select("id", F.col("id").alias("cluster_id"), F.lit(1).cast("long").alias("cluster_size"))
    return found.unionByName(alone)


def votes(scored: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_articles, n_events, attention, event_risk, amplification for rows (keys, cluster_id, score): attention is the mean
    score of articles; in event_risk each cluster votes once, with its highest score; amplification is articles an event."""
    each = scored.groupBy(*keys, "cluster_id").agg(F.max("score").alias("severity"), F.sum("score").alias("total"), F.count("*").alias("n"))
    out = each.groupBy(*keys).agg(F.sum("n").alias("n_articles"), F.count("*").alias("n_events"), F.sum("total").alias("_t"), F.avg("severity").alias("event_risk"))
    return out.select(*keys, "n_articles", "n_events", F.try_divide("_t", "n_articles").alias("attention"), "event_risk", F.try_divide("n_articles", "n_events").alias("amplification"))
