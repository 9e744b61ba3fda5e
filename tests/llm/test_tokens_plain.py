"""Parts of the token operators that need no Spark: the codec, the unit cuts against the library, the bin patterns."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tremor.llm import packing, simple8b, tokens

ODD = [
    "", " ", "\n", "a", " a", "a ", "a  b", "a \n b", "\n\na", "it's they'll 'S we'Re", "x" * 5000, "12345 6 789,0", "éà ̸x", "ΣΑΣ ΟΔΟΣ İstanbul ß",
    "a b  c　　d​e\x1cf\x1d g", "<|endoftext|>", "a  <|endoftext|>\n\n b<|startoftext|> c", "日本語 テキスト。\tend", "😀😀 a️b", "\x85x y ", "a\r\n\r\nb \x0b\x0c c", "don't  'tis   rock'n'roll ",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name):
    encoder = tokens.Encoder(public_tokenizers.path(name))
    draw = random.Random(5)
    mixed = ["".join(draw.choice(["a", "B", "é", "é", "1", " ", "  ", "\n", "'s", "'", ",", " ", " ", "日", "<|endoftext|>", "\x1f", "ß"]) for _ in range(draw.randrange(40))) for _ in range(3000)]
    for text in ODD + mixed:
        assert encoder.ids(text).tolist() == encoder.units.encode(text), repr(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_even_texts_at_once(name):
    """Texts without odd signs take the way that cuts all of them in native code."""
    encoder = tokens.Encoder(public_tokenizers.path(name))
    draw = random.Random(8)
    texts = ["".join(draw.choice(["The", "word", "É", "é", "12", " ", " ", "  ", "\n", "'s", ",", ".", "\xa0", "\u2003", "\x85", "\u200b", "ß", "İ", "\t"]) for _ in range(draw.randrange(30))) for _ in range(2000)]
    ids, n = encoder.batch(pa.array(texts))
    want = [encoder.units.encode(x) for x in texts]
    assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_many_texts_at_once_and_a_memory_that_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_UNITS", 40)
    draw = random.Random(6)
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    first = tokens.Known(tokens.Units(public_tokenizers.path("byte_bpe_50k.json")), {"hello": 1, "\x01hello": 1})
    for _ in range(30):
        texts = ["", *(" ".join("".join(draw.choice("abcé,.") for _ in range(draw.choice([1, 3, 5, 60]))) for _ in range(draw.randrange(30))) for _ in range(8)), "hello hello"]
        want = [encoder.units.encode(x) for x in texts]
        ids, n = encoder.batch(pa.array(texts), 7)
        assert ids.tolist() == [i for x in want for i in [*x, 7]] and n.tolist() == [len(x) + 1 for x in want]
        number, units = first.look(pa.array(texts))
        assert tokens.per_text(first.n[number], units).tolist() == [len(x) for x in want]
    assert len(encoder.known.number) <= 400 and len(first.number) <= 400


def test_simple8b_round_trip():
    draw = np.random.default_rng(3)
    runs = [np.zeros(0, np.uint64), np.zeros(300, np.uint64), np.arange(1000, dtype=np.uint64), np.array([2**64 - 1, 0, 2**60, 2**60 - 1, 5, 2**63], np.uint64)]
    runs += [draw.integers(0, 2 ** int(draw.integers(1, 64)), int(draw.integers(0, 700)), dtype=np.uint64) for _ in range(200)]
    runs += [np.array([2**61 + 7, 2**62] * 90, np.uint64)]
    n = np.array([len(x) for x in runs])
    words, block_word, run_block = simple8b.encode(np.concatenate(runs), n)
    size = np.concatenate([np.minimum(m - np.arange(0, m, simple8b.BLOCK), simple8b.BLOCK) for m in n]).astype(np.int64)
    assert simple8b.decode(words, block_word, size).tolist() == np.concatenate(runs).tolist()
    for k, x in enumerate(runs):  # each run alone
        a, b = run_block[k], run_block[k + 1]
        assert simple8b.decode(words[block_word[a] : block_word[b]], block_word[a : b + 1] - block_word[a], size[a:b]).tolist() == x.tolist()
    assert len(words) < 1.0 * sum(n) and simple8b.encode(np.full(1280, 9000, np.uint64), np.array([1280]))[0].size == 1280 // 4


def test_fullest_equals_brute_force():
    draw = random.Random(1)
    for _ in range(300):
        counts = {draw.randint(1, 30): draw.randint(1, 4) for _ in range(draw.randint(1, 6))}
        room = draw.randint(0, 80)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * c for s in sums for c in range(n + 1)}
        got = packing.fullest(counts, room)
        assert sum(got) == max(s for s in sums if s <= room)
        assert all(got.count(k) <= counts.get(k, 0) for k in got)


def test_bins_use_everything_once():
    draw = random.Random(2)
    counts = {k: draw.randint(0, 50) for k in range(1, 1025)}
    found = packing.bins(dict(counts))
    used = {k: 0 for k in counts}
    for pattern, times in found:
        assert times > 0 and sum(k * n for k, n in pattern.items()) <= 1024
        for k, n in pattern.items():
            used[k] += n * times
    assert used == counts
    total = sum(k * n for k, n in counts.items())
    assert sum(t for _, t in found) <= total / 1024 * 1.01 + 1
    assert packing.bins({}) == []


def test_a_capitalised_word_beside_itself_with_a_comma():
    """Both new at once: the word is learnt as the other's stem and must not be numbered again, or later words take its number."""
    encoder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("Hello there Hello, World World. cat", "zebra Hello World dogs monkeys quartz", "Hello World"):
        assert encoder.ids(text).tolist() == encoder.units.encode(text)


@pytest.mark.parametrize("letter", ["क़", "য়", "ଢ଼", "יִ"])
def test_letters_whose_composed_form_ends_in_a_mark(letter):
    encoder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for text in (f"{letter},", f"a{letter}. b", f"A{letter}, {letter}"):
        assert encoder.ids(text).tolist() == encoder.units.encode(text)
