"""Near-duplicate documents by circulant MinHash: two permutations give all coordinates, then bands, then exact Jaccard.

The first permutation scatters a document's word shingles over a universe of `UNIVERSE` positions; the second one is a
table `pi` of that universe. Coordinate k is the smallest pi[(position + k) mod UNIVERSE], so one contiguous read of
`COORDS` entries serves all coordinates of a shingle.

How links are found without all pairs of a group:
1. Equal shingle sets are one class, whatever the ids; everything after works on classes, each with one text of its rows.
2. `BANDS` bands of `COORDS // BANDS` coordinates give bucket keys. In each bucket, in cells of at most `CELL` rows, each
   document proposes the partner whose signature agrees best; proposals are verified on the full sets.
3. Components are contracted. Within a bucket only members outside its largest component ("strays") still matter: they
   are compared, in cells, with all members of other components. Here 16 bits of every shingle hash bound the intersection
   from above, so that hardly a pair is proposed that isn't a link; each stray proposes its best partners in each other
   component, and more of them (8, 64, ...) in a next round, until nothing was left unproposed. So no link between
   components that share a bucket stays unseen, and no pair inside one is looked at.
In step 2 a pair is passed over if fewer than `agreeing(similarity)` coordinates agree, five standard deviations below the
expected number; step 3 passes over a pair only if its bound rules the similarity out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .shared import slices, with_text, written

SHINGLE = 5
UNIVERSE = 1 << 20
COORDS, BANDS = 128, 32
CELL = 1024
GROWTH = 8


def agreeing(percent: int) -> int:
    """Coordinates that two sets with the least similarity share, less five standard deviations."""
    p = percent / 100
    return int(COORDS * p - 5 * (COORDS * p * (1 - p)) ** 0.5)


def sets_of(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words has its whole sequence, none has none."""
    data = W.LOWER[data]
    starts, ends, first = W.spans(data, offsets)
    h = W.hashes(data, starts, ends)
    grams = W.windows(h, shingle)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        out.append(np.unique(grams[a : b - shingle + 1]) if b - a >= shingle else W.windows(h[a:b], int(b - a)) if b > a else h[:0])
    return out


class Signer:
    """The two permutations, made once per task from a fixed seed."""

    def __init__(self) -> None:
        pi = np.random.default_rng(20240229).permutation(UNIVERSE).astype(np.uint32)
        self.runs = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: COORDS - 1]]), COORDS)

    def sign(self, found: np.ndarray) -> np.ndarray:
        at = (W.mix(found ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(UNIVERSE - 1)).astype(np.int64)
        return np.minimum.reduce([self.runs[at[k : k + 2048]].min(axis=0) for k in range(0, len(at), 2048)])


def text_hash(text: str) -> Column:
    """Tells texts of rows with equal ids apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


_SIGNED = "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, sig binary, keys array<long>"


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per document (doc_id, text, text_hash): set size, a 128-bit hash of the set, the signature's low bytes and the band
    keys (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for batch in batches:
            for first, end, data, offsets in slices(batch):
                found = sets_of(data, offsets, shingle)
                h1 = np.array([W.mix(x).sum(dtype=np.uint64) for x in found], np.uint64).view(np.int64)
                h2 = np.array([W.mix(x ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) for x in found], np.uint64).view(np.int64)
                full = np.array([len(x) > 0 for x in found], bool)
                sig = np.array([signer.sign(x) for x in found if len(x)], np.uint32).reshape(-1, COORDS)
                bands = sig.reshape(len(sig), BANDS, COORDS // BANDS).astype(np.uint64)
                keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2]).copy()
                for k in range(bands.shape[2]):
                    keys = W.mix(keys * np.uint64(0xD6E8FEB86659FD93) + bands[:, :, k])
                at = np.full(end - first, -1)
                at[full] = np.arange(len(sig))
                low = sig.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        batch.column(2).slice(first, end - first),
                        pa.array([len(x) for x in found], pa.int64()),
                        pa.array(h1, pa.int64()),
                        pa.array(h2, pa.int64()),
                        pa.array([low[k].tobytes() if k >= 0 else None for k in at], pa.binary()),
                        pa.array([keys[k].view(np.int64) if k >= 0 else None for k in at], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "h1", "h2", "sig", "keys"],
                )

    return docs.mapInArrow(run, _SIGNED)


def ranked(order: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The rank of each row within its group, when rows are taken in `order`."""
    to = groups[order]
    by = np.argsort(to, kind="stable")
    begins = np.flatnonzero(np.r_[True, to[by][1:] != to[by][:-1]])
    rank = np.empty(len(order), np.int64)
    rank[order[by]] = np.arange(len(order)) - np.repeat(begins, np.diff(np.r_[begins, len(order)]))
    return rank


def by_signature(x: pd.DataFrame, percent: int) -> Iterator[tuple[int, int, bool]]:
    """Each row of a cell with the partner whose signature agrees best, first among those that haven't met it yet.

    The signature's low bytes may agree by chance in a band where the pair shares no bucket, so they only order partners: a
    pair that seems to have met is taken last, but never left out.
    """
    n, doc, band = x["n"].to_numpy(), x["doc_id"].to_numpy(), int(x["band"].iloc[0])
    sig = np.frombuffer(b"".join(x["sig"]), np.uint8).reshape(len(x), COORDS)
    least = agreeing(percent)
    for i in range(len(x)):
        same = sig == sig[i]
        agree = same.sum(axis=1)
        agree[i] = 0
        at = np.flatnonzero((agree >= least) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
        if len(at):
            met = same[at].reshape(len(at), BANDS, -1)[:, :band].all(axis=2).any(axis=1)
            yield doc[i], doc[at[np.lexsort((doc[at], -agree[at], met))[0]]], len(at) > 1


def by_bound(x: pd.DataFrame, percent: int, best: int) -> Iterator[tuple[int, int, bool]]:
    """Each left row of a cell with at most `best` right rows of each other component that the bound allows."""
    side, comp, n, doc = (x[c].to_numpy() for c in ("side", "comp", "n", "doc_id"))
    right = np.flatnonzero(side != 1)
    bins = [np.frombuffer(v, np.uint16) for v in x["bins"]]
    if not len(right):
        return
    every, begin = np.concatenate([bins[k] for k in right]), np.cumsum([0, *(len(bins[k]) for k in right[:-1])])
    table = np.zeros(1 << 16, np.int32)
    for i in np.flatnonzero(side > 0):
        if not (comp[right] != comp[i]).any():
            continue
        table[bins[i]] = 1
        most = np.minimum(np.add.reduceat(table[every], begin), n[i])  # shared shingles, at most
        table[bins[i]] = 0
        at = np.flatnonzero((comp[right] != comp[i]) & (100 * most >= percent * (n[i] + n[right] - most)))
        if not len(at):
            continue
        closeness = most[at] / (n[i] + n[right[at]] - most[at])
        keep = ranked(np.lexsort((doc[right[at]], -closeness)), comp[right[at]]) < best
        for k in at[keep]:
            yield doc[i], doc[right[k]], not keep.all()


def proposals(cells: DataFrame, percent: int, best: int = 0) -> DataFrame:
    """(a, b, more) from cells (key, cell, ...): `by_signature`, or with a `best` `by_bound`. more: some were left out.

    cells: band, doc_id, n, sig; or doc_id, n, bins, comp, side (0 right, 1 left, 2 both).
    """

    def cell(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        found = list(by_bound(x, percent, best) if best else by_signature(x, percent))
        if found:
            a, b, more = (np.array(c) for c in zip(*found, strict=True))
            yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "more": more})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for part in parts:
            if left is not None:
                part = pd.concat([left, part], ignore_index=True)
            key, at = part["key"].to_numpy(), part["cell"].to_numpy()
            begins = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (at[1:] != at[:-1])][: len(part)])
            for x, y in zip(begins[:-1], begins[1:], strict=True):
                yield from cell(part.iloc[x:y])
            left = part.iloc[begins[-1] :] if len(begins) else None
        if left is not None and len(left):
            yield from cell(left)

    dealt = cells.repartition("key", "cell").sortWithinPartitions("key", "cell")
    return dealt.mapInPandas(run, "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more"))


def binned(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, bins): 16 bits of every shingle hash of texts (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch):
                out = [(W.mix(x) >> np.uint64(48)).astype(np.uint16).tobytes() for x in sets_of(data, offsets, shingle)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(out, pa.binary())], ["doc_id", "bins"])

    return texts.mapInArrow(run, "doc_id long, bins binary")


def verified(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) whose full shingle sets satisfy 100 * intersection >= percent * union.

    Rows of one a come to a task in a sorted stream, a's own text first; an a with many partners is salted.
    """
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(1 << 20)).alias("draw"))
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / 64).alias("ways"))
    salted = salted.join(counts, "a").select("a", F.expr("draw % ways").alias("salt"), "b")
    rows = salted.select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("doc_id")).unionByName(salted.select("a", "salt").distinct().select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("doc_id")))
    dealt = rows.join(texts, "doc_id").repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, of = None, None
        for batch in batches:
            a, salt, role, doc = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("a", "salt", "role", "doc_id"))
            for first, _, data, offsets in slices(batch):
                kept = []
                for k, mine in enumerate(sets_of(data, offsets, shingle), first):
                    if role[k] == 0:
                        base, of = mine, (a[k], salt[k])
                        continue
                    assert of == (a[k], salt[k])
                    both = len(np.intersect1d(base, mine, assume_unique=True))
                    if both and 100 * both >= percent * (len(base) + len(mine) - both):
                        kept.append((a[k], doc[k]))
                if kept:
                    x = np.array(kept, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash for every row of docs.

    Documents are linked when 100 * |A & B| >= percent * |A | B| over distinct word shingles (A-Z lower-cased); component_id
    is the smallest id reachable. Null and empty texts have no shingles and stand alone; so does a row with a null id (its
    component is null and it is kept). Rows with equal ids are documents of their own: an equal id is no link. text_hash
    tells their texts apart. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    docs = with_text(docs, id_col, text_col).withColumn("text_hash", text_hash("text"))
    signed = written(signatures(docs, shingle), "signatures")
    real = signed.where("n_shingles > 0 and doc_id is not null")
    # v numbers the classes. All rows of a class have one signature; the text of the least (id, hash) stands for it.
    of_class = real.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("least"), F.min_by("text_hash", "doc_id").alias("text_hash"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    classes = written(of_class.withColumn("v", F.monotonically_increasing_id()), "classes")
    reps = classes.select(F.col("v").alias("doc_id"), F.col("n_shingles").alias("n"), "sig", "keys")
    band = reps.select("doc_id", F.posexplode("keys").alias("band", "key"))
    shared_keys = band.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    # Written, so that the join stands alone and AQE can split a hot key's rows.
    buckets = written(band.join(written(shared_keys, "keys"), "key").select("key", "band", "doc_id", "m"), "buckets")
    members = classes.select(F.col("v").alias("doc_id"), F.col("least"), "text_hash").join(buckets.select("doc_id").distinct(), "doc_id", "left_semi").withColumnRenamed("doc_id", "v")
    named = docs.withColumnRenamed("doc_id", "least").join(members, ["least", "text_hash"]).dropDuplicates(["least", "text_hash"])
    texts = written(named.select(F.col("v").alias("doc_id"), "text"), "texts")
    signs = reps.select("doc_id", "n", "sig")
    cells = buckets.join(signs, "doc_id").select("key", F.expr(f"pmod(xxhash64(doc_id), ceil(m / {CELL}))").alias("cell"), "band", "doc_id", "n", "sig")
    tried = written(proposals(cells, percent), "proposals").select("a", "b")
    roots = components(written(verified(tried, texts, percent, shingle), "links"))
    wide = buckets.where("m > 2")  # the only pair of a smaller bucket has been proposed or passed over
    bins = written(binned(texts.join(wide.select("doc_id").distinct(), "doc_id", "left_semi"), shingle), "bins").join(reps.select("doc_id", "n"), "doc_id")
    best = 1
    while True:
        # Written, as five plans below read it: a row for each band of a document in a bucket of three and more.
        placed = wide.join(roots.withColumnRenamed("v", "doc_id"), "doc_id", "left").select("key", "doc_id", "m", F.coalesce("root", "doc_id").alias("comp"))
        placed = written(placed, "placed")
        sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("c"), F.max("m").alias("m"))
        main = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("main"), F.max("m").alias("m")).where("main.c < m")
        main = main.select("key", F.col("main.comp").alias("main"), F.expr(f"ceil((m - main.c) / {CELL})").alias("ns"), F.expr(f"ceil(m / {CELL})").alias("nm"))
        rows = placed.join(written(main, "main"), "key").join(bins, "doc_id").withColumn("stray", F.col("comp") != F.col("main"))
        # A cell is a run of strays (left) against a run of all members (right); a small bucket is one cell.
        kept = ["doc_id", "n", "bins", "comp"]
        one = rows.where("nm = 1").select("key", F.lit(0).cast("long").alias("cell"), *kept, F.when(F.col("stray"), 2).otherwise(0).alias("side"))
        many = rows.where("nm > 1").withColumns({"i": F.expr("pmod(xxhash64(doc_id), ns)"), "j": F.expr("pmod(xxhash64(doc_id, 7), nm)")})
        right = many.select("*", F.explode(F.expr("sequence(0L, ns - 1)")).alias("at")).select("key", F.expr("at * nm + j").alias("cell"), *kept, F.lit(0).alias("side"))
        left = many.where("stray").select("*", F.explode(F.expr("sequence(0L, nm - 1)")).alias("at")).select("key", F.expr("i * nm + at").alias("cell"), *kept, F.lit(1).alias("side"))
        found = written(proposals(one.unionByName(right).unionByName(left), percent, best), "proposals")
        new = written(found.join(tried, ["a", "b"], "left_anti").select("a", "b"), "untried")
        if new.isEmpty():
            if found.where("more").isEmpty():
                break
        else:
            links = verified(new, texts, percent, shingle)
            for end in ("a", "b"):  # links between components, and the components' own hooks
                links = links.join(roots.select(F.col("v").alias(end), F.col("root").alias(f"{end}_root")), end, "left").withColumn(end, F.coalesce(f"{end}_root", end)).select("a", "b")
            roots = components(written(links.unionByName(roots.select(F.col("v").alias("a"), F.col("root").alias("b"))), "links"))
            tried = tried.unionByName(new)
        best *= GROWTH
    rooted = classes.join(roots, "v", "left").select("h1", "h2", "n_shingles", "least", F.coalesce("root", "v").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of_set = rooted.join(written(smallest, "smallest"), "root").select("h1", "h2", "n_shingles", "component")
    placed = signed.select("doc_id", "text_hash", "n_shingles", "h1", "h2").join(of_set, ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")
