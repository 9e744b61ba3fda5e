"""Exact token ids at cached speed: texts are cut where the tokenizer itself can never join, and a worker encodes each unit once.

The cuts follow from the tokenizer's own settings. A byte-level pre-tokenizer never matches across the start of a run of
non-space characters (with its one leading blank); a normaliser that squeezes white space before a pattern that drops it
never matches across white space at all; neither joins letters with the commas and full stops that end a word. A text that
holds one of the added tokens' strings, and any tokenizer of another kind, goes to the library whole.

What a worker has learnt stays with its Python process, which Spark uses again for later tasks, until a task of another
operator takes its place.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .shared import learnt, slices

# Unicode White_Space, which the tokenizers' patterns mean by \s. Fixed values.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORDS = re.compile(f"[^{BLANK}]+")
_BYTES = re.compile(f" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
_WIDE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SEPARATORS = re.compile(r"[\x1c-\x1f]")  # white space to str.split, not to the tokenizers
_UNEVEN = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")
CACHE_UNITS = 800_000  # units a worker remembers before it lets go of the later half
CACHE_CHARS = 48  # longer units are encoded each time
SLICE = 8 << 20  # bytes of text that are cut and looked up at a time (one longer text is one step)


class Units:
    """Cuts texts into units and encodes units. One per worker and tokenizer file.

    A unit is named by a key: byte-level units that begin with a blank by the rest of them, all others by \\x01 and
    themselves, so that plain texts are cut by `str.split` alone.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre, norm = told["pre_tokenizer"] or {}, told["normalizer"]
        kinds = [x["type"] for x in (norm or {}).get("normalizers", [])]
        self.added = [x["content"] for x in told["added_tokens"]]
        self.odd = "[\x01\x1c-\x1f]|" + "|".join(map(re.escape, self.added))  # texts with these are cut one by one
        self.kind = "whole"
        if norm is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
            self.kind = "bytes"
        elif kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"]:
            squeeze, split = norm["normalizers"][1], pre["pretokenizers"][0]
            if (squeeze["pattern"], squeeze["content"]) == ({"Regex": r"\s+"}, " ") and (split["behavior"], split["invert"]) == ("Removed", True):
                self.kind = "words"

    def encode(self, unit: str) -> list[int]:
        return self.library.encode(unit, add_special_tokens=False).ids

    def keys(self, text: str) -> list[str]:
        """The keys of a text's units in order."""
        if self.kind == "whole" or "\x01" in text or any(x in text for x in self.added):
            return ["\x01" + text]
        if self.kind == "words":
            return text.split() if not _SEPARATORS.search(text) else _WORDS.findall(text)
        if text and not any(x in text for x in _UNEVEN) and text[0] not in " \n" and text[-1] not in " \n" and (text.isascii() or not _WIDE.search(text)):
            return ("\x01" + text.replace("\n", " \x01\n \x01")).split(" ")
        return [x[1:] if x[0] == " " and len(x) > 1 and x[1] not in " \n" else "\x01" + x for x in _BYTES.findall(text)]

    def flat(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The keys of all texts in a row, and how many each text has."""
        if self.kind == "words" and not pc.any(pc.match_substring_regex(texts, self.odd)).as_py():
            lists = pc.utf8_split_whitespace(texts)
            keys, n = lists.flatten(), np.diff(lists.offsets.to_numpy())
            full = pc.not_equal(keys, "")  # blanks at either end of a text leave an empty piece
            seen = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))]
            ends = np.cumsum(n)
            return keys.filter(full), seen[ends] - seen[ends - n]
        each = [self.keys(x) for x in texts.to_pylist()]
        return pa.array(chain.from_iterable(each), pa.large_string()), np.fromiter(map(len, each), np.int64, len(each))

    def unit(self, key: str) -> str:
        return key[1:] if key[0] == "\x01" else key if self.kind == "words" else " " + key

    def letters(self) -> None:
        """Prepares the short way for words of plain letters: what the normaliser and the pre-tokenizer make of each letter."""
        from tokenizers import pre_tokenizers

        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        made = lambda c: level.pre_tokenize_str(c)[0][0]
        small = (lambda c: c) if self.kind == "bytes" else str.lower
        self.letter = {k: made(small(chr(k))) for k in range(0x250) if chr(k).isalpha() and len(small(chr(k))) == 1}
        self.blank = made(" ") if self.kind == "bytes" else ""
        self.model = self.library.model

    def encode_all(self, keys: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """(some keys, the ids of their units in a row, how many each has), until all keys have come, in any order.

        Words of plain letters are one pre-token that needs no normalising; they go to the library's model at once, which takes
        half the time.
        """
        if self.kind != "whole" and not hasattr(self, "letter"):
            self.letters()
        plain, pieces, rest = [], [], []
        for key in keys:
            bare, lead = (key[1:], "") if key[0] == "\x01" else (key, self.blank if self.kind != "whole" else "")
            if self.kind == "whole" or not bare.isalpha() or not (bare.isascii() or self.letter.keys() >= set(map(ord, bare))):
                rest.append(key)
                continue
            plain.append(key)
            pieces.append(lead + (bare.translate(self.letter) if not bare.isascii() else bare if self.blank else bare.lower()))
        if plain:
            made = [[t.id for t in self.model.tokenize(x)] for x in pieces]
            yield plain, np.fromiter(chain.from_iterable(made), np.uint32), np.fromiter(map(len, made), np.int64, len(made))
        for k in range(0, len(rest), 4096):
            part = rest[k : k + 4096]
            made = [e.ids for e in self.library.encode_batch_fast([*map(self.unit, part)], add_special_tokens=False)]
            yield part, np.fromiter(chain.from_iterable(made), np.uint32), np.fromiter(map(len, made), np.int64, len(made))


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def ends_in_letter(c: str) -> bool:
    """Whether a letter is still one when it is normalised and made small: a small İ and some letters' composed forms end in a
    mark, which the tokenizer joins with a following sign."""
    return c.isalpha() and (c.isascii() or (len(c.lower()) == 1 and unicodedata.is_normalized("NFC", c)))


class Known:
    """What a worker knows of units: each key has a number, by which arrays hold how many ids it has and which.

    `first` (key -> how many ids) is known from the start and never let go; its ids aren't known, so only counts may be asked.
    """

    def __init__(self, units: Units, first: dict[str, int] | None = None) -> None:
        self.units, self.lengths_only = units, first is not None
        self.number = dict(zip(first or (), range(len(first or ())), strict=True))
        self.kept = len(self.number)  # these many are never let go
        self.n = np.array([*(first or {}).values()], np.int64)
        self.start, self.ids, self.used = np.zeros(self.kept, np.int64), np.zeros(1 << 16, np.uint32), 0

    def _add(self, keys: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        before = len(self.number)
        self.number.update(zip(keys, range(before, before + len(keys)), strict=True))
        if before + len(keys) > len(self.n):
            more = max(len(keys), len(self.n))
            self.n, self.start = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.n, self.start))
        self.n[before : before + len(keys)] = n
        if not self.lengths_only:
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids)), np.uint32)])
            self.start[before : before + len(keys)] = self.used + np.cumsum(n) - n
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)

    def _forget(self, size: int) -> None:
        """Lets go of all but the first `size` units."""
        self.used = int(self.start[size]) if size < len(self.number) else self.used
        self.number = dict(islice(self.number.items(), size))

    def _learn(self, new: list[str]) -> None:
        """Adds unknown keys. A letter and a following comma or full stop are never one token, so such a unit is its stem and
        the sign. Where the normaliser makes letters small, a capitalised word is its small one."""
        if self.units.kind == "words":
            big = {x: x.lower() for x in new if x.isascii() and x.isalpha() and not x.islower()}
            if big:
                self._learn(list({x: 0 for x in chain((x for x in new if x not in big), big.values()) if x not in self.number}))
                big = {x: small for x, small in big.items() if x not in self.number}  # some have just been learnt as stems
                of = np.fromiter((self.number[x] for x in big.values()), np.int64, len(big))
                n = self.n[of]
                self._add(list(big), self.ids[:0] if self.lengths_only else self.ids[ranges(self.start[of], n)], n)
                return
        stems: dict[str, str] = {}
        if self.units.kind != "whole":
            stems = {x: x[:-1] for x in new if x[-1] in ",." and len(x) > 1 and ends_in_letter(x[-2])}
        signs = {x: "\x01" + x if self.units.kind == "bytes" else x for x in ",."}
        alone = [x for x in dict.fromkeys(chain((x for x in new if x not in stems), stems.values(), signs.values() if stems else ())) if x not in self.number]
        for part in self.units.encode_all(alone):
            self._add(*part)
        if stems:
            both = np.array([(self.number[stem], self.number[signs[x[-1]]]) for x, stem in stems.items()], np.int64)
            n = self.n[both]
            ids = np.zeros(0, np.uint32) if self.lengths_only else self.ids[ranges(self.start[both].ravel(), n.ravel())]
            self._add(list(stems), ids, n.sum(axis=1))

    def look(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The number of every unit of all texts in a row, and how many units each text has.

        Numbers hold until the next call. Equal units are found by one hash table in native code; only distinct ones are
        looked up here.
        """
        if len(self.number) > CACHE_UNITS + self.kept:
            self._forget(self.kept + CACHE_UNITS // 2)
        flat, units = self.units.flat(texts)
        coded = flat.dictionary_encode()
        found = coded.dictionary.to_pylist()
        new = [x for x in found if x not in self.number]
        short = [x for x in new if len(x) <= CACHE_CHARS]
        self._learn(short)
        size = len(self.number)
        if len(short) < len(new):
            self._learn([x for x in new if len(x) > CACHE_CHARS])
        number = np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))
        if size < len(self.number):  # the long units' numbers and ids stand behind the others until the next call
            self._forget(size)
        return number[coded.indices.to_numpy(zero_copy_only=False)], units


def per_text(n: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Sums of n over the units of each text."""
    ends = np.cumsum(units)
    total = np.r_[0, np.cumsum(n)]
    return total[ends] - total[ends - units]


class Encoder:
    """Ids of whole texts. Use `encoder` inside tasks: it gives the one of this Python process."""

    def __init__(self, path: str) -> None:
        self.known = Known(Units(path))
        self.units = self.known.units

    def batch(self, texts: pa.StringArray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text's followed by end_id, and how many each text has."""
        number, units = self.known.look(texts)
        n = self.known.n[number]
        ids, many = self.known.ids[ranges(self.known.start[number], n)], per_text(n, units)
        if end_id is None:
            return ids, many
        return np.insert(ids, np.cumsum(many), np.uint32(end_id)), many + 1

    def ids(self, text: str) -> np.ndarray:
        return self.batch(pa.array([text]))[0]


def encoder(path: str) -> Encoder:
    """This Python process's encoder for a tokenizer file, with all it has learnt in earlier tasks."""
    return learnt(("ids", path), lambda: Encoder(path))


# --- token counts -------------------------------------------------------------------------------------------------

FREQUENT = 1 << 16  # entries of the broadcast table
SAMPLE_TEXTS = 4096  # texts that are expected to be drawn for it
PER_TEXT = 512  # units that a drawn text names at most, its most frequent ones


def frequent_units(docs: DataFrame, path: str, size: int = FREQUENT) -> dict[str, int]:
    """The token counts of units that occur often, from a drawn sample of about SAMPLE_TEXTS whole texts.

    Each drawn text names its PER_TEXT most frequent units, so that the driver sees at most SAMPLE_TEXTS * PER_TEXT small
    rows, whatever the size of docs; nothing is shuffled. Which units the table holds never changes a count, only its speed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, seen = Units(path), Counter()
        for batch in batches:
            for text in batch.column("text"):
                seen.update(dict(Counter(x for x in units.keys(text.as_py()) if len(x) <= CACHE_CHARS).most_common(PER_TEXT)))
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["unit", "n"])

    rows = docs.count()
    drawn = docs.select("text").sample(min(1.0, SAMPLE_TEXTS / max(rows, 1)), 7).mapInArrow(run, "unit string, n long")
    named = drawn.toArrow().group_by("unit").aggregate([("n", "sum")]).sort_by([("n_sum", "descending"), ("unit", "ascending")])
    library = Units(path)
    found: dict[str, int] = {}
    for keys, _, n in library.encode_all(named.column("unit").slice(0, size).to_pylist()):
        found.update(zip(keys, n.tolist(), strict=True))
    return found


def counted(path: str, table: Broadcast) -> Known:
    """What this Python process knows of unit lengths: the broadcast table, and all it has learnt in earlier tasks."""
    return learnt(("lengths", path), lambda: Known(Units(path), table.value))


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text; null text counts as empty).

    Two tiers inside the scan: a broadcast table of at most FREQUENT unit lengths, then what this Python process has learnt
    of the other units, in this task or an earlier one. No unit is shuffled. Empty texts have 0 tokens; no row is dropped.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_units(docs, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counted(path, table)
        for batch in batches:
            for first, end, _, offsets in slices(batch, limit=SLICE):
                part = batch.slice(first, end - first)
                number, units = known.look(part.column("text"))
                n = per_text(known.n[number], units)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
