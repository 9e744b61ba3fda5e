"""Token files, counts and packing against the library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tremor.llm import packing, shared, tokenfiles, tokens, toxicity
from tremor.llm.shared import new_place, with_text

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def encoded(docs, path, end):
    library = Tokenizer.from_file(path)
    rows = sorted(with_text(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text))
    return [(r.doc_id, library.encode(r.text, add_special_tokens=False).ids + end) for r in rows]


def test_token_files(spark, docs, none):
    at = new_place(spark, "tokens")
    tokenfiles.write_token_files(with_text(docs), at, WORDS, 1)
    got = sorted(((r.start, r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in tokenfiles.read_token_files(spark, at).collect()))
    start, want = 0, []
    for doc, ids in encoded(docs, WORDS, [1]):
        want.append((start, doc, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    at = new_place(spark, "tokens")
    tokenfiles.write_token_files(with_text(none), at, WORDS, 1)
    assert tokenfiles.read_token_files(spark, at).count() == 0


def test_token_counts(docs, none):
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(with_text(docs), BYTES, 50).collect()))
    sizes = sorted((r.doc_id is not None, r.doc_id or 0, len(r.text.encode()), r.text) for r in with_text(docs).collect())
    library = Tokenizer.from_file(BYTES)
    assert got == sorted((a, b, n, m := len(library.encode(t, add_special_tokens=False).ids), m > 50) for a, b, n, t in sizes)
    assert tokens.token_counts(with_text(none), BYTES).count() == 0


def test_packing(docs, none):
    got = packing.pack_documents(with_text(docs), BYTES, 2, capacity=256).collect()
    want = sorted((-1 if doc is None else doc, tuple(ids)) for doc, ids in encoded(docs, BYTES, [2]))
    by, bins = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert 1 <= r.length <= 256 and len(r.ids) == 4 * r.length
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    single = [d for d, rows in by.items() if d is not None and len({r.piece for r in rows}) == len(rows)]
    for d in single:
        rows = sorted(by[d], key=lambda r: r.piece)
        ids = b"".join(r.ids for r in rows)
        assert (d, tuple(np.frombuffer(ids, "<u4").tolist())) in want
        assert [r.start for r in rows] == np.cumsum([0, *(r.length for r in rows)])[:-1].tolist()
        assert all(r.length == 256 for r in rows[1:])
    total = sum(len(ids) for _, ids in encoded(docs, BYTES, [2]))
    assert sum(r.length for r in got) == total and len(bins) <= -(-total // 256) + 2
    assert packing.pack_documents(with_text(none), BYTES).count() == 0


def test_a_worker_keeps_what_one_operator_learnt():
    first = tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert tokens.encoder(public_tokenizers.path("byte_bpe_50k.json")) is first
    assert shared.learnt("another", dict) == {}
    assert tokens.encoder(public_tokenizers.path("byte_bpe_50k.json")) is not first
    shared.forget()
    assert not shared._LEARNT


@pytest.mark.parametrize("kept", [(), ("doc_id", "text", "lang")])
def test_scores_are_the_same_whatever_is_kept(spark, kept):
    docs = spark.createDataFrame([(1, "you utter scum", "en"), (2, None, None), (3, "", "de"), (None, "a fine day", "en"), (5, "a fine day", "fr")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(docs, labels, keep=kept).collect()}
    plain = {r.doc_id: r.score for r in toxicity.scores(docs, labels).collect()}
    assert {k: r.score for k, r in got.items()} == plain and plain[2] == plain[3] and plain[None] == plain[5]
    if kept:
        assert got[2].rest.text is None and got[1].rest.text == "you utter scum" and got[5].rest.lang == "fr"


@pytest.mark.parametrize("table", [{}, {"the": 1}])
def test_counts_do_not_depend_on_the_broadcast_table(docs, table, monkeypatch):
    """Which units were drawn for it changes no count: with none or one of them the counts are the library's."""
    shared.forget()
    monkeypatch.setattr(tokens, "frequent_units", lambda *_: table)
    library = Tokenizer.from_file(BYTES)
    want = sorted(len(library.encode(r.text, add_special_tokens=False).ids) for r in with_text(docs).collect())
    assert sorted(r.n_tokens for r in tokens.token_counts(with_text(docs), BYTES, 50).collect()) == want
