"""The trie of conversation prefixes, from whole sequences.

Identical conversations collapse to one weighted sequence with the list of those that end there. Each distinct sequence gives
a row for each of its prefixes, and sums over equal prefixes give every node's members: a trie without pointers, in which all
aggregates combine before the shuffle, so that the root and common first turns are no hot keys. A sequence that is a proper
prefix of another one is dropped by an anti-join; the others are the leaves.

A subtree's sum needs no walk either. A node is charged to its owner, the sequence of its smallest member; the nodes that a
sequence owns are the end of its path, since a smallest member stays the smallest further down. So the sum below a node is the
sum, over all sequences through it, of what each owns from that depth on: one more row for each prefix, however long the
conversation is.

Nodes are named by a chain of SHA-256 digests over (role, text); texts themselves are not shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

ROOT = hashlib.sha256(b"").digest()
CHUNK = 4096  # ids of one run of an end list that a task sorts at once
SALTS = 64  # parts that the children of one node are dealt out to while they look up their parent


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns: array of (digest, words)) with each conversation's turns in order: null first, equal ones by digest.

    Null roles and texts are empty. Rows without a conversation id are left out. words counts `[^\\x20\\x09-\\x0D]+` of the text.
    """
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, what), 256))
    each = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), F.regexp_count(what, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")).where("conv_id is not null")
    lists = each.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt(convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations (see `conversations`) whose first h turns are those of conversation c - c % every (all of them if it has
    fewer, none if there is no such conversation), before their own turns after the first h; h = crc32(decimal c) % most."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    first = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("leader"), F.slice("turns", 1, most - 1).alias("theirs"))
    own = convs.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("leader"))
    joined = own.join(first, "leader", "left")
    head = F.coalesce(F.slice("theirs", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return joined.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def chain(digests: list[bytes]) -> list[bytes]:
    """The names of the nodes on a path, the root first."""
    keys = [ROOT]
    for d in digests:
        keys.append(hashlib.sha256(keys[-1] + d).digest())
    return keys


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, turns) with the name of the last node."""
    for batch in batches:
        names = [chain(t["digest"] for t in turns)[-1] for turns in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary())], ["conv_id", "turns", "key"])


def sequences(convs: DataFrame) -> DataFrame:
    """(key, conv_id, n, ends_sha256, turns): the distinct sequences with their smallest member, how many conversations each
    stands for, and the SHA-256 of their ids, ascending and comma-joined. A sequence's ids come together in runs of CHUNK
    consecutive numbers first, sorted within a run."""
    kind = convs.schema["turns"].dataType.simpleString()
    named = convs.select("conv_id", "turns").mapInArrow(_ends, f"conv_id long, turns {kind}, key binary")
    run = F.floor(F.col("conv_id") / CHUNK).alias("run")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    parts = named.groupBy("key", run).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), ids.alias("ids"), F.first("turns").alias("turns"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run", "ids"))), lambda r: r["ids"]), ",")
    return parts.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.sha2(whole, 256).alias("ends_sha256"), F.first("turns").alias("turns"))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, n, turns) as a row for each prefix: key, depth, conv_id, n, inner (does the sequence go on)."""
    for batch in batches:
        keys, depth, owner, n, inner = [], [], [], [], []
        for c, many, turns in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            path = chain(t["digest"] for t in turns)
            keys += path
            depth += range(len(path))
            owner += [c] * len(path)
            n += [many] * len(path)
            inner += [True] * (len(path) - 1) + [False]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(depth, pa.int64()), pa.array(owner, pa.int64()), pa.array(n, pa.int64()), pa.array(inner, pa.bool_())], ["key", "depth", "conv_id", "n", "inner"])


def _charged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, turns, leaf, ends_sha256, owned: members of each owned node, from the top) as a row for each prefix: key, what
    the sequence owns from there on (saved), whether it is a leaf below, the children it owns, and for owned nodes the node."""
    for batch in batches:
        rows = []
        for c, turns, leaf, ends, owned in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            path, size = chain(t["digest"] for t in turns), len(turns)
            owned = owned or []
            top = size + 1 - len(owned)  # the depth of the first owned node
            below = 0
            for d in range(size, -1, -1):
                mine = d >= top
                if mine and d:
                    below += (owned[d - top] - 1) * turns[d - 1]["words"]
                parent = path[d - 1] if mine and d == top and d else None
                rows.append((path[d], d, below, int(leaf), int(d + 1 >= top and d < size), c if mine else None, owned[d - top] if mine else None, c if mine and d > top else None, parent, ends if d == size else None))
        cols = list(zip(*rows, strict=True)) or [()] * 10
        kinds = [pa.binary(), *[pa.int64()] * 7, pa.binary(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["key", "depth", "saved", "leaf", "kids", "conv_id", "n", "parent_conv", "parent_key", "ends"])


def prefix_tree(convs: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the conversations (conv_id, turns: array of (digest, words)), the empty one included:
    key, parent_key, conv_id (smallest member), depth, parent_conv_id (the parent's conv_id; root: null), n_convs, n_children,
    n_leaves (childless nodes in its subtree), saved_tokens (over the subtree, members less one times the words of a node's
    last turn), ends_sha256 (of the ids that end there). No conversations, no rows; conversations without turns count.
    """
    seqs = written(sequences(convs), "sequences")
    rows = seqs.select("conv_id", "n", "turns").mapInArrow(_prefixes, "key binary, depth long, conv_id long, n long, inner boolean")
    nodes = written(rows.groupBy("key").agg(F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.max("inner").alias("inner")), "nodes")
    leaves = seqs.join(nodes.where("inner").select("key"), "key", "left_anti").select("conv_id", F.lit(True).alias("leaf"))
    owned = nodes.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "n"))).alias("owned"))
    known = seqs.join(owned, "conv_id", "left").join(leaves, "conv_id", "left")
    ready = known.select("conv_id", "turns", F.coalesce("leaf", F.lit(False)).alias("leaf"), "ends_sha256", F.col("owned.n").alias("owned"))
    charged = ready.mapInArrow(_charged, "key binary, depth long, saved long, leaf long, kids long, conv_id long, n long, parent_conv long, parent_key binary, ends string")
    sums = [F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"), F.sum("kids").alias("n_children"), F.max("ends").alias("ends")]
    once = [F.max("depth").alias("depth"), F.max("conv_id").alias("conv_id"), F.max("n").alias("n_convs"), F.max("parent_conv").alias("parent_conv"), F.max("parent_key").alias("parent_key")]
    tree = written(charged.groupBy("key").agg(*sums, *once), "tree")
    # The tops of owned paths look their parent up. One node may be the parent of most of them, so they ask in SALTS parts,
    # each part once.
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt")
    asked = tree.where("parent_key is not null").select("parent_key", salt).distinct()
    told = asked.join(nodes.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("asked_conv")), "parent_key")
    both = tree.withColumn("salt", salt).join(told, ["parent_key", "salt"], "left")
    return both.select("key", "parent_key", "conv_id", "depth", F.coalesce("parent_conv", "asked_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


# CRC-32 is a fold over the digits of the id with the usual table of 256 remainders; a node is the list of its turns.
ORACLE = r"""
with bits as (select v, list_reduce(list_prepend(cast(v as ubigint), cast(range(8) as ubigint[])), lambda c, i: case when c & 1 = 1 then xor(c >> 1, cast(3988292384 as ubigint)) else c >> 1 end) as r from range(256) t(v)),
lut as (select list(r order by v) as l from bits),
t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
o as (select conv_id, list({'k': length(role) || ':' || role || text, 'w': len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))} order by turn nulls first, role, text) as turns from t group by conv_id),
h as (select conv_id, turns, cast(xor(list_reduce(list_prepend(cast(4294967295 as ubigint), list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ord(x) as ubigint))), lambda c, x: xor(c >> 8, l[cast(xor(c, x) & 255 as bigint) + 1])), cast(4294967295 as ubigint)) % 4 as bigint) as h from o, lut),
r as (select h.conv_id, list_concat(case when x.turns is null then [] else x.turns[1:h.h] end, h.turns[h.h + 1:]) as s from h left join o x on x.conv_id = h.conv_id - h.conv_id % 20),
p as (select conv_id, s, unnest(range(len(s) + 1)) as depth from r),
q as (select conv_id, depth, list_transform(s[1:depth], lambda y: y.k) as node, list_transform(s[1:depth - 1], lambda y: y.k) as parent, case when depth = 0 then 0 else s[depth].w end as w, depth = len(s) as ends from p),
n as (select node, any_value(depth) as depth, case when any_value(depth) > 0 then any_value(parent) end as parent, min(conv_id) as conv_id, count(*) as n_convs, max(w) as w, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '')) as ends_sha256 from q group by node),
k as (select parent, count(*) as n_children from n where parent is not null group by parent),
m as (select n.*, coalesce(n_children, 0) as n_children from n left join k on k.parent = n.node),
up as (select m.node[1:a.d] as node, m.n_children, m.n_convs, m.w from m, lateral (select unnest(range(m.depth + 1)) as d) a),
s as (select node, count(*) filter (n_children = 0) as n_leaves, sum((n_convs - 1) * w) as saved from up group by node)
select m.conv_id, m.depth, pn.conv_id as parent_conv_id, m.n_convs, m.n_children, s.n_leaves, cast(s.saved as bigint) as saved_tokens, m.ends_sha256
from m join s on s.node = m.node left join n pn on pn.node = m.parent
"""
