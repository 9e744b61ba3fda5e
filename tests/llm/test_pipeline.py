"""The pipeline on a small table against brute force for every stage but the score, which is checked on planted texts."""

import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORDS = lambda t: [w for w in re.split(r"[ \t-\r]+", t or "") if w]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("aeioulmnrst") for _ in range(draw.randint(3, 7)))
    vocabulary = [word() for _ in range(500)]
    text = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    item, passage = text(30), text(60)
    rows, labels = [], []
    for k in range(400):
        words, toxic = text(draw.randint(20, 120)), 0
        if k % 4 == 0:
            words.insert(draw.randrange(len(words)), draw.choice(["zwidiot", "kwoxscum"]))
            toxic = 1
        rows.append([k, " ".join(words), "en", "s", 0])
        labels.append((k, 1, toxic))
    base = text(100)
    rows.append([1000, " ".join(base), "en", "s", 0])
    rows.append([1001, " ".join(base), "en", "s", 0])
    near = base[:]
    near[50] = "other"
    rows.append([1002, " ".join(near), "en", "s", 0])
    rows.append([1003, " ".join(text(20) + item + text(20)), "en", "s", 0])
    rows.append([1004, " ".join(text(40) + passage + text(30)), "en", "s", 0])
    rows.append([1005, " ".join(text(35) + passage + text(45)), "en", "s", 0])
    rows += [[1006, None, "en", "s", 0], [1007, "", "en", "s", 0], [None, " ".join(text(30)), "en", "s", 0]]
    at = tmp_path_factory.mktemp("sf")
    docs = [(i, t, a, b, len(t or "")) for i, t, a, b, _ in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), labels


def test_stages(spark, tables):
    at, labels = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    toxic = {i for i, _, t in labels if t}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns
        docs = corpus_pipeline.written(out, name)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = {i for i, *_ in labels} - toxic
    assert len(toxic & kept["toxicity"].keys()) <= 2 and len(clean - kept["toxicity"].keys()) <= 3
    assert {1000, 1003, 1004, 1005, 1006, 1007, None} <= kept["minhash"].keys() and not {1001, 1002} & kept["minhash"].keys()
    assert kept["toxicity"].keys() - kept["minhash"].keys() == {1001, 1002}
    before, after = WORDS(kept["minhash"][1005]), WORDS(kept["substrings"][1005])
    assert before[:35] + before[95:] == after and kept["substrings"][1004] == kept["minhash"][1004]
    assert kept["substrings"].keys() - kept["decontaminate"].keys() == {1003}
    packed = corpus_pipeline.pack_sequences(spark, docs, at)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept["decontaminate"].keys()


def test_run(spark, tables):
    rows = corpus_pipeline.run(spark, tables[0])
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    by = {}
    for r in rows.collect():
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
