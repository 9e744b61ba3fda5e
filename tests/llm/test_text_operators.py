"""Substring dedup, decontamination, shards, page extraction and toxicity against plain versions."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tremor.llm import decontaminate, html, shards, substrings, toxicity
from tremor.llm.shared import with_text


def test_remove_repeats_equals_brute_force(docs, none):
    rows = [(r.doc_id, [w for w in re.split(rb"[\x20\x09-\x0d]+", (r.text or "").encode()) if w]) for r in docs.select("doc_id", "text").collect()]
    origin = {}
    for i, words in rows:
        if i is not None:
            for k in range(len(words) - 12):
                w = tuple(words[k : k + 13])
                origin[w] = min(origin.get(w, i), i)
    want = []
    for i, words in rows:
        gone = set()
        for k in range(len(words) - 12):
            if i is not None and origin[tuple(words[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        want.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    got = [(r.doc_id, r.n_words, r.n_removed, r.text) for r in substrings.remove_repeats(docs).collect()]
    key = lambda x: (x[0] is not None, x[0] or 0, x[3])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(x[2] for x in want) > 100
    for r in substrings.remove_repeats(docs).collect():
        assert sum(f.words for f in r.factors) == r.n_removed
    assert substrings.remove_repeats(none).count() == 0


def test_factors_equal_a_naive_parse(docs):
    """Each factor is the longest run of windows whose earliest sources stand in a row in one document."""
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").distinct().collect() if r.doc_id is not None)
    split = [(i, (t or "").split()) for i, t in rows]
    source = {}
    for i, words in split:
        for k in range(len(words) - 12):
            w = tuple(words[k : k + 13])
            source[w] = min(source.get(w, (i, k)), (i, k))
    got = {(r.doc_id, r.n_words): [tuple(f) for f in r.factors] for r in substrings.remove_repeats(docs).collect()}
    seen = 0
    for i, words in split:
        want, k, covered = [], 0, 0
        while k <= len(words) - 13:
            doc, at = source[tuple(words[k : k + 13])]
            if doc >= i:
                k += 1
                continue
            n = 1
            while k + n <= len(words) - 13 and source[tuple(words[k + n : k + n + 13])] == (doc, at + n):
                n += 1
            begin = max(k, covered)
            covered = k + n + 12
            want.append((begin, covered - begin, doc, at + begin - k))
            k += n
        assert got[i, len(words)] == want
        seen += len(want)
    assert seen > 10


def test_one_hash_that_collides_is_no_source():
    """A window's hash alone, or an anchor alone, gives no source: both must agree."""
    anchor, code = np.array([5, 5, 9], np.uint64), np.array([7, 8, 7], np.uint64)
    single = pa.scalar([{"w": 7, "anchor": 5, "origin": 1, "pos": 40}, {"w": 8, "anchor": 6, "origin": 1, "pos": 41}], pa.list_(pa.struct([(c, pa.int64()) for c in ("w", "anchor", "origin", "pos")])))
    hit, doc, pos = substrings.sources(anchor, code, pa.scalar(None, pa.list_(pa.struct([]))), single)
    assert hit.tolist() == [True, False, False] and (doc[0], pos[0]) == (1, 40)
    assert substrings.factors(hit, doc, pos) == [(0, 13, 1, 40)]


def test_rows_with_one_id_are_cut_each_for_itself(spark):
    draw = random.Random(13)
    text = lambda n: " ".join(f"v{draw.randrange(10**6)}" for _ in range(n))
    a, b = text(30), text(30)
    rows = [(1, a, "x"), (5, f"{a} tail", "y"), (5, b, "z"), (5, b, "z"), (9, f"{b} end", "q"), (None, a, "n")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, rest string")
        got = sorted((r.doc_id or 0, r.rest.rest, r.text) for r in substrings.remove_repeats(docs, keep=["rest"]).collect())
        assert got == sorted([(1, "x", a), (5, "y", "tail"), (5, "z", b), (5, "z", b), (9, "q", "end"), (0, "n", a)])


def test_decontamination_tolerates_substitutions(spark, none):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(draw.randint(13, 40)))) for k in range(30)] + [(30, "short item"), (31, None), (32, ""), (33, "alone"), (0, "clash of words")]
    rows = [(0, None), (1, ""), (2, "a b c"), (None, items[0][1]), (200, "a Short, ITEM here"), (201, "short a item"), (202, "Alone!"), (203, "aloneness short items"), (204, "of a clash of words"), (2, "a short item"), (2, "a short item")]
    for k in range(3, 120):
        text = items[draw.randrange(30)][1].split()
        a = draw.randrange(len(text))
        part = text[a:] if k % 2 else text
        for _ in range(draw.choice([0, 1, 2, 3, 5])):
            part[draw.randrange(len(part))] = word()
        rows.append((k, " ".join([word() for _ in range(draw.randint(0, 9))] + [x.upper() + "," for x in part] + [word() for _ in range(9)])))
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want = {}
    for i, t in rows:
        words = split(t)
        for j, s in items:
            item = split(s)
            if 0 < len(item) < 13 and any(words[p : p + len(item)] == item for p in range(len(words))) or any(sum(x == y for x, y in zip(words[p : p + 13], item[q : q + 13], strict=False)) >= 11 for p in range(len(words) - 12) for q in range(len(item) - 12)):
                want.setdefault(i, set()).add(j)
    got = decontaminate.contamination(d, b).collect()
    assert {r.doc_id: r.n_items for r in got if r.doc_id is not None} == {i: len(want.get(i, ())) for i, _ in rows if i is not None}
    assert all(r.contaminated == (r.n_items > 0) for r in got) and len(got) == len(rows)
    limit, decontaminate.BROADCAST_SEEDS = decontaminate.BROADCAST_SEEDS, 0
    try:
        again = decontaminate.contamination(d, b)
        assert "BroadcastHashJoin [key" not in again._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(r.n_items for r in again.collect()) == sorted(r.n_items for r in got)
    finally:
        decontaminate.BROADCAST_SEEDS = limit
    assert decontaminate.contamination(none, b).count() == 0
    assert not decontaminate.contamination(d, b.limit(0)).where("contaminated").count()


def test_shards(docs, none):
    got = shards.assign(docs, 7).collect()
    counts = {}
    for r in got:
        counts.setdefault(r.shard, []).append(r.slot)
    assert len(got) == docs.count() and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in counts.values())
    texts = {r.doc_id: r.text for r in with_text(docs).collect()}
    for r in got:
        if r.doc_id is not None:
            raw = texts[r.doc_id].encode()
            assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    assert shards.assign(none, 7).count() == 0
    few = shards.assign(docs.limit(3), 7).collect()
    assert len({r.shard for r in few}) == 3


def curve(bits):
    """The Hilbert curve over 2 ** bits x 2 ** bits cells, by the recursion of its four quarters."""
    if not bits:
        return [(0, 0)]
    part, half = curve(bits - 1), 1 << (bits - 1)
    return [(y, x) for x, y in part] + [(x, y + half) for x, y in part] + [(x + half, y + half) for x, y in part] + [(2 * half - 1 - y, half - 1 - x) for x, y in part]


def test_hilbert_visits_neighbours():
    side = np.arange(16)
    flat = np.stack(np.meshgrid(side, side, indexing="ij"), -1).reshape(-1, 2)
    order = flat[np.argsort(shards.hilbert(flat, 4))].tolist()
    assert order in ([list(c) for c in curve(4)], [[y, x] for x, y in curve(4)])
    for dims, bits in ((3, 4), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        at = shards.hilbert(cells, bits)
        assert sorted(at.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(axis=1) == 1).all()


def test_shards_follow_the_curve_and_whole_strings(spark):
    rows = [(k, "x" * (k % 37), f"https://example.org/{k % 20:02d}") for k in range(400)]
    got = shards.assign(spark.createDataFrame(rows, "doc_id long, text string, source string"), 8).orderBy("shard", "slot").collect()
    assert [(r.place, r.doc_id) for r in got] == sorted((r.place, r.doc_id) for r in got)
    per = [len({rows[r.doc_id][2] for r in got if r.shard == k}) for k in range(8)]
    assert max(per) < 20  # each shard holds some of the sources only


def test_written_shards(spark, docs):
    from tremor.llm.shared import new_place

    clash = docs.withColumnRenamed("score", "shard").withColumnRenamed("key", "slot")
    at = new_place(spark, "shards")
    shards.write_shards(clash, at, 5)
    back = spark.read.parquet(at)
    assert back.select("shard_").distinct().count() == 5
    assert sorted(map(str, back.select(clash.columns).collect())) == sorted(map(str, clash.collect()))


PAGES = {
    "<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><a href='/'>Home</a></nav><article><h1>Head</h1><p>First &amp; <b>bold</b>\n text.<p>Second &lt;x&gt; &copy; 5<br>more</article><footer>foot</footer></body></html>": "Head\nFirst & bold text.\nSecond <x> © 5 more",
    "<article><p>Keep</p><div class='ad banner'>Buy</div><p>Tail</p><section id=comments><p>nice</p></section></article>": "Keep\nTail",
    "": "",
    "<nav>only</nav>": "",
    "<article><p>Cut off here <b>bol": "Cut off here bol",
    "<body><ul><li><a href=1>Menu one</a></ul><ul class=menu><li>Menu two</ul><div><p>" + "A sentence of the text. " * 8 + "</p><p>Short one.</p><p>" + "Another sentence. " * 9 + "</p></div><div class=footer>(c)</div></body>": ("A sentence of the text. " * 8).strip() + "\nShort one.\n" + ("Another sentence. " * 9).strip(),
    "<main><form><p>name<input></form><p hidden>gone</p><p>stays</p><aside><p>side</p></aside></main>": "stays",
}


def test_pages(spark):
    rows = [(k, f"u{k}", page, "text") for k, page in enumerate(PAGES)] + [(99, None, None, "t"), (99, "u", "x" * 100_000, "t")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = [*PAGES.values(), "", "x" * 100_000]
    assert sorted((r.page_id, r.text) for r in got) == sorted(zip([r[0] for r in rows], want, strict=True))
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LONG = "A sentence of the main text. " * 12
TEXT = LONG.strip()


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><div><p>{LONG}</p></div><aside><article><p>Teaser</p></article></aside></body>", TEXT),
        (f"<body><div><p>{LONG}</p></div><div class=related><article><a href=x>Teaser</a></article></div></body>", TEXT),
        (f"<body><!-- <main> --><script>var a = '<article>';</script><div><p>{LONG}</p></div></body>", TEXT),
        (f"<body><div><p>{LONG}</p></div><ul class=menu><li>One</ul><article><p>Card</p></article></body>", TEXT),
        (f"<body><div class='content no-sidebar'><article><p>{LONG}</p><div class=ad>Buy</div><p>Tail</p></article></div></body>", f"{TEXT}\nTail"),
        (f"<body><div class='with-ads'><p>{LONG}</p></div></body>", TEXT),
        (f"<body><div class='comments-open'><article><p>{LONG}</p></article></div></body>", TEXT),
        (f"<body><div class='social-story'><article><p>{LONG}</p></article><div class='cookie-bar'>We use cookies</div></div></body>", TEXT),
        (f"<body><div class='menu-reform'><p>{LONG}</p></div><article><p>{LONG}</p><div class='menu-reform'><p>Real text.</p></div></article></body>", f"{TEXT}\nReal text."),
        (f"<body><div class='social-science'><p>{LONG}</p></div><div class='cookie-bar'>We use cookies and you may like them</div></body>", TEXT),
        (f"<body><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul><h1>Head of it</h1><p>A <label>marked</label> word, <button>x</button>here. {LONG}</p><p>Tail</p></body>", f"Head of it\nA marked word, here. {TEXT}\nTail"),
        (f"<article><p>{LONG}</p><div class=ad>Buy</div><aside>x</aside><p>Short</p><div class=ad>Buy</div><p>End</p></article>", f"{TEXT}\nShort\nEnd"),
        (f"<body><article><p>{LONG}</p></article><div class='article-comments'><p>{LONG}</p></div></body>", TEXT),
    ],
)
def test_a_mark_or_a_name_doesnt_empty_a_page(page, want):
    assert html.main_text(page) == want


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(6)
    word = lambda: "".join(draw.choice("aeiourstlnm") for _ in range(draw.randint(2, 7)))
    vocabulary = [word() for _ in range(400)]
    bad = ["zwidiot", "kwoxscum", "vypjerk"]
    rows, labels = [], []
    for k in range(900):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(5, 60))]
        toxic = int(k % 5 == 0)
        if toxic:
            insult = draw.choice(bad)
            if k % 3 == 0:
                insult = insult[:3] + draw.choice("-*.x") + insult[3:]
            words.insert(draw.randrange(len(words)), insult)
        rows.append((k, ". ".join([" ".join(words[:20]), " ".join(words[20:])]), toxic))
        labels.append((k, 1, toxic))
    rows += [(900, None, 0), (901, "", 0), (902, rows[1][1], 0), (None, "z w i d i o t", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_holds_out(labelled):
    docs, labels = labelled
    got = toxicity.scores(with_text(docs), labels).collect()
    truth = {r.doc_id: r.score for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert right >= 0.97 * len(held)
    assert [r.score for r in got if r.doc_id == 902] == [r.score for r in got if r.doc_id == 1]


def test_toxicity_without_labels(labelled, none):
    docs, labels = labelled
    assert {r.predicted for r in toxicity.scores(with_text(docs), labels.limit(0)).collect()} == {0}
    assert toxicity.scores(with_text(none), labels).count() == 0


def test_kernel_equals_its_definition():
    from itertools import combinations

    import numpy as np

    def phi(w):
        out = {}
        for at in combinations(range(len(w)), toxicity.LENGTH):
            key = "".join(w[k] for k in at)
            out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    words = ["idiot", "idi-ot", "abcabc", "xyz", "aaaa"]
    s = toxicity._codes(words, 8)
    want = np.array([[sum(v * phi(b).get(k, 0) for k, v in phi(a).items()) for b in words] for a in words])
    assert np.allclose(toxicity.kernel(s, s), want, rtol=1e-4)
    assert np.allclose(toxicity._self(s), np.diag(want), rtol=1e-4)
    model = toxicity.Model(words[:3], np.array([1.0, -0.5, 0.25]), 0.1, 1.0, 0.0)
    assert np.allclose(model.margins(words), want[:, :3] @ model.weight / np.sqrt(np.diag(want)) + 0.1, rtol=1e-3)


def test_decontaminated_judges_each_row_by_its_text(spark):
    draw = random.Random(11)
    words = lambda n: " ".join("".join(draw.choice("aeioulmnrst") for _ in range(5)) for _ in range(n))
    item, clean = words(20), words(40)
    rows = [(5, item, "a"), (5, clean, "b"), (5, clean, "b"), (7, words(40), "c"), (None, "x " + item, "d"), (None, clean, "e"), (8, None, "f"), (9, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    benchmark = spark.createDataFrame([(0, item)], "item_id long, text string")
    left = decontaminate.decontaminated(docs, benchmark)
    assert left.columns == docs.columns and sorted(r.key for r in left.collect()) == ["b", "b", "c", "e", "f", "g"]
    assert decontaminate.decontaminated(docs.limit(0), benchmark).count() == 0
    assert decontaminate.decontaminated(docs, benchmark.limit(0)).count() == len(rows)
