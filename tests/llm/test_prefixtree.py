"""The prefix trie against a trie built node by node: copies, shared heads, long conversations, nulls, missing leaders."""

import hashlib
import random
import re
import zlib

from tremor.llm import prefixtree, registry

SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string, n long"


def plain(rows):
    by = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in by.items()}
    members, ends = {}, {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20 if c >= 0 else c + -c % 20, [])[:h] + mine[h:])
        ends.setdefault(path, []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        words = len([w for w in re.split(r"[ \t-\r]+", p[-1][1]) if w]) if p else 0
        leaves, saved = 0 if p in kids else 1, (len(members[p]) - 1) * words
        for k in kids.get(p, []):
            a, b = below(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for p, m in members.items():
        leaves, saved = below(p)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves, saved, digest))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def made(seed):
    draw = random.Random(seed)
    says = [None, "", "one", "two  words", "\n three of\tthem\v", "é ß"]
    rows = []
    for c in [*range(-45, 160), 9000, 9001, 9020]:
        if c % 20 == 0 and draw.random() < 0.3:
            continue  # no leader
        for t in range(draw.choice([1, 2, 3, 4, 5])):
            rows.append((c, t if t or draw.random() < 0.8 else None, draw.choice(["user", "assistant", None]), draw.choice(says), 1, "k", 2))
    copy = [(None, "user", "same"), (1, "assistant", "same again"), (2, "user", "and more words")]
    rows += [(c, *x, 1, "k", 2) for c in range(5000, 5400) for x in copy]
    rows += [(7000, t, "user", f"long {t % 3}", 1, "k", 2) for t in range(150)] + [(7001, t, "user", f"long {t % 3}", 1, "k", 2) for t in range(140)]
    rows += [(None, 0, "user", "no id", 1, "k", 2)]
    draw.shuffle(rows)
    return rows


def test_equals_a_plain_trie(spark):
    rows = made(4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = prefixtree.prefix_tree(prefixtree.rebuilt(prefixtree.conversations(df)))
    assert collected(got) == plain(rows)


def test_query_columns_and_empty_table(spark, tmp_path):
    rows = [(1, 0, "user", "a b", 1, "k", 2), (20, 0, None, None, 1, "k", 2), (20, 0, None, None, 1, "k", 2)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/a/conversations.parquet")
    got = registry.op12_prefixtree(spark, f"{tmp_path}/a")
    assert got.dtypes == [("conv_id", "bigint"), ("depth", "bigint"), ("parent_conv_id", "bigint"), ("n_convs", "bigint"), ("n_children", "bigint"), ("n_leaves", "bigint"), ("saved_tokens", "bigint"), ("ends_sha256", "string")]
    assert collected(got) == plain(rows)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert registry.op12_prefixtree(spark, f"{tmp_path}/b").count() == 0
    spark.createDataFrame([(None, 0, "user", "x", 1, "k", 2)], SCHEMA).write.parquet(f"{tmp_path}/c/conversations.parquet")
    assert registry.op12_prefixtree(spark, f"{tmp_path}/c").count() == 0


def test_turnless_conversations_are_members_of_the_root(spark):
    convs = spark.createDataFrame([(3, []), (1, []), (2, [(b"x", 4)])], "conv_id long, turns array<struct<digest:binary,words:int>>")
    root, one = sorted(prefixtree.prefix_tree(convs).collect(), key=lambda r: r.depth)
    assert (root.conv_id, root.n_convs, root.n_children, root.n_leaves, root.saved_tokens) == (1, 3, 1, 1, 0)
    assert root.ends_sha256 == hashlib.sha256(b"1,3").hexdigest() and root.parent_conv_id is None
    assert (one.conv_id, one.parent_conv_id, one.n_leaves) == (2, 1, 1)
