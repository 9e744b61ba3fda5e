"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask picks some of the next few words; their hash is a seed. Every 13 words with at most two substitutions contain a
place where one of the two masks meets equal words only (checked over all pairs of places), so the seed join loses no
overlap of that kind. Each hit fixes an item and a diagonal; the words along it are compared where the seed hit, before
any shuffle. An item of fewer words than a window is one seed of its whole length, without substitutions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Places that each mask looks at. Two masks of weight 6 that are lossless for WINDOW words with SUBSTITUTIONS differing.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
WINDOW, SUBSTITUTIONS = 13, 2
AROUND = WINDOW - 1  # words before a seed's place that can matter to it
BROADCAST_SEEDS = 200_000  # a larger seed table (some 300 bytes a row) is joined by a shuffle


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and marks."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{M}]+"), "")


def _seeds(df: DataFrame, keep: list[str], array: str, at: str) -> DataFrame:
    """A row for each place of `array` and each mask that fits there: keep, at, array, key."""
    placed = df.select(*keep, array, F.posexplode(array).alias(at, "_"))
    keys = []
    for k, mask in enumerate(MASKS):
        key = F.xxhash64(F.lit(k), *(F.get(array, F.col(at) + o) for o in mask))
        keys.append(F.when(F.col(at) + mask[-1] < F.size(array), key))
    return placed.select(*keep, array, at, F.explode(F.array(*keys)).alias("key")).where("key is not null")


def _near(seeds: DataFrame, array: str, at: str) -> DataFrame:
    """Seeds with only the words of their array that a window around them can hold, and their place among those."""
    back = F.least(F.lit(AROUND), F.col(at))
    return seeds.withColumns({array: F.slice(array, F.col(at) - back + 1, back + WINDOW), at: back})


def _whole(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched) for items of fewer than WINDOW words that a text has word by word. One key for each place
    and each length that such an item has, so at most WINDOW - 1 of them."""
    short = items.where(F.size("item").between(1, WINDOW - 1)).select("item_id", "item", F.size("item").alias("n"), F.xxhash64("item").alias("key"))
    lengths = sorted(r.n for r in short.select("n").distinct().collect())
    placed = texts.where(F.size("doc") > 0).select("doc_id", "doc", F.posexplode("doc").alias("p", "_"))
    parts = [F.when(F.col("p") + n <= F.size("doc"), F.slice("doc", F.col("p") + 1, n)) for n in lengths]
    each = placed.select("doc_id", F.explode(F.array(*parts) if parts else F.array(F.lit(None).cast("array<string>"))).alias("part")).where("part is not null")
    joined = each.withColumn("key", F.xxhash64("part")).join(F.broadcast(short) if short.count() <= BROADCAST_SEEDS else short, "key")
    return joined.where("part = item").select("doc_id", "item_id", F.col("n").alias("matched"))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, matched): documents that share WINDOW consecutive words with an item, at most SUBSTITUTIONS of
    them differing; matched is the largest number of equal words in such a window.

    An item of fewer than WINDOW words overlaps the documents that hold all of it word by word. Null and empty texts overlap
    nothing. A small seed table is broadcast; its rows are counted first, and a larger one takes a shuffle join, for which
    each seed takes only the words around it along.
    """
    every = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text)).alias("item")).dropDuplicates()
    items = every.where(F.size("item") >= WINDOW)
    seeds = _near(_seeds(items, ["item_id"], "item", "q"), "item", "q")
    small = seeds.count() <= BROADCAST_SEEDS
    texts = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("doc"))
    places = _seeds(texts.where(F.size("doc") >= WINDOW), ["doc_id"], "doc", "p")
    joined = places.join(F.broadcast(seeds), "key") if small else _near(places, "doc", "p").join(seeds, "key")
    # The words around the hit on either side: every window that holds the seed lies in them. The partition id is only there
    # to keep the comparison below from being pushed into the join, which would then copy the document for every place.
    back = F.least(F.lit(AROUND), "p", "q")
    many = back + F.least(F.lit(WINDOW), F.size("doc") - F.col("p"), F.size("item") - F.col("q"))
    near = joined.select("doc_id", "item_id", F.slice("doc", F.col("p") - back + 1, many).alias("doc"), F.slice("item", F.col("q") - back + 1, many).alias("item"), F.spark_partition_id().alias("part"))
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("bits"), F.lit(0).alias("best"))

    def step(state: Column, same: Column) -> Column:
        """The last WINDOW comparisons as bits, and the most equal words in a full window so far."""
        n, bits = state["n"] + 1, (state["bits"] * 2 + same.cast("int")).bitwiseAND((1 << WINDOW) - 1)
        best = F.when(n >= WINDOW, F.greatest(state["best"], F.bit_count(bits))).otherwise(state["best"])
        return F.struct(n.alias("n"), bits.alias("bits"), best.alias("best"))

    equal = F.zip_with("doc", "item", lambda x, y: x == y)
    walked = near.select("doc_id", "item_id", "part", F.aggregate(equal, begin, step)["best"].alias("matched"))
    found = walked.where((F.col("matched") >= WINDOW - SUBSTITUTIONS) & (F.col("part") >= 0)).select("doc_id", "item_id", "matched")
    if not every.where(F.size("item").between(1, WINDOW - 1)).isEmpty():
        found = found.unionByName(_whole(texts, every))
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_items, contaminated for every row of docs: how many benchmark items it overlaps (see `overlaps`).

    Rows with equal ids share their items. A null id, an empty table or an empty benchmark gives 0 items.
    """
    found = overlaps(docs, benchmark, id_col, text_col).groupBy("doc_id").agg(F.count("*").alias("n_items"))
    joined = docs.select(F.col(id_col).alias("doc_id")).join(found, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.col("n_items").isNotNull().alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that overlap no benchmark item, with all their columns. Each row is judged by its own text, named by
    its SHA-256, whatever its id: rows with equal ids or without one stay or go for themselves. Null texts stay.
    """
    key = F.unhex(F.sha2("text", 256))
    found = overlaps(docs.select(key.alias("key"), "text"), benchmark, id_col="key")
    rows = docs.select(key.alias("key"), F.struct("*").alias("row"))
    return rows.join(found.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select("row.*")


# Every window with at most two substitutions holds four equal words in a row, so this joins on those and compares.
ORACLE = f"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda x: x <> '') as doc from documents),
b as (select distinct item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda x: x <> '') as item from benchmark),
bi as (select * from b where len(item) >= {WINDOW}),
dp as (select doc_id, doc, unnest(range(1, len(doc) - 2)) as p from d where len(doc) >= {WINDOW}),
bp as (select item_id, item, unnest(range(1, len(item) - 2)) as q from bi),
dk as (select doc_id, p, doc[p] || ' ' || doc[p + 1] || ' ' || doc[p + 2] || ' ' || doc[p + 3] as k from dp),
bk as (select item_id, q, item[q] || ' ' || item[q + 1] || ' ' || item[q + 2] || ' ' || item[q + 3] as k from bp),
g as (select distinct doc_id, item_id, p - q as diagonal from dk join bk using (k)),
m as (select doc_id, item_id, list_transform(range(1, len(item) + 1), lambda i: case when i + diagonal >= 1 and doc[greatest(i + diagonal, 1)] = item[i] then 1 else 0 end) as same from g join d using (doc_id) join bi using (item_id)),
f as (select distinct doc_id, item_id from m where len(list_filter(range(1, len(same) - {WINDOW - 2}), lambda i: list_sum(same[i : i + {WINDOW - 1}]) >= {WINDOW - SUBSTITUTIONS})) > 0),
bs as (select item_id, ' ' || array_to_string(item, ' ') || ' ' as item from b where len(item) between 1 and {WINDOW - 1}),
fs as (select distinct doc_id, item_id from d join bs on contains(' ' || array_to_string(doc, ' ') || ' ', item)),
n as (select doc_id, count(*) as n_items from (from f union from fs) group by doc_id)
select d.doc_id, coalesce(n_items, 0) as n_items, n_items is not null as contaminated from documents d left join n using (doc_id)
"""
