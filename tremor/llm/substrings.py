"""Substring dedup by relative Lempel-Ziv parsing over words.

Every document is factored from left to right against all documents with smaller ids as reference. The reference is indexed
by anchors: in each window of WINDOW words the run of ANCHOR words with the smallest hash, so that equal windows have equal
anchors. An index entry is an anchor with the document and word position of its first source; a shuffle partition of the
index is one reference block, and a document's anchors go to every block that could hold them.

A factor begins at the first window that a reference block holds, takes its earliest source (smallest id, then position) and
grows word by word while the next window's source is the next word of the same document. Where that ends, the next factor
begins at the window across the boundary, if it has a source of its own: so the check at factor boundaries loses no window.
Factors of at least WINDOW words are duplicate spans.

Two steps keep the index small. Most anchors are seen in one document only and end there. An anchor whose surrounding
phrase is the same wherever it occurs is settled at once: the smallest id has the phrase first. Only the windows around the
other shared anchors (edges of copied passages, edited places) are looked up one by one. Either way a source is taken only
if two 64-bit hashes agree, that of the anchor and that of the phrase or window around it, never one alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import parallelism, slices, written

WINDOW, ANCHOR = 13, 5


@dataclass
class Windows:
    """Of some texts: each window's anchor, hash, text (`whole`: does it lie in one text) and word position in its text."""

    anchor: np.ndarray
    hash: np.ndarray
    whole: np.ndarray
    text: np.ndarray
    at: np.ndarray
    first: np.ndarray  # each text's first word, one more at the end

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Windows:
        starts, ends, first = W.spans(data, offsets)
        n = len(starts) - WINDOW + 1
        if n <= 0:
            none, zero = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return cls(none, none, np.zeros(0, bool), zero, zero, first)
        grams = W.windows(W.hashes(data, starts, ends), ANCHOR)
        anchor = grams[:n].copy()
        for k in range(1, WINDOW - ANCHOR + 1):
            np.minimum(anchor, grams[k : k + n], out=anchor)
        mid, last = ANCHOR - 1, WINDOW - ANCHOR  # three runs of words that cover the window
        code = W.mix((grams[:n] * np.uint64(0xD6E8FEB86659FD93) + grams[mid : mid + n]) * np.uint64(0x9E3779B97F4A7C15) + grams[last : last + n])
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        return cls(anchor, code, text[:n] == text[WINDOW - 1 :], text[:n], np.arange(n) - first[text[:n]], first)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """The windows that lie in one text, and which of them begin a run of windows with one anchor."""
        at = np.flatnonzero(self.whole)
        if not len(at):
            return at, at
        return at, np.flatnonzero(np.r_[True, (self.anchor[at[1:]] != self.anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)])


def phrases(docs: DataFrame, hashed: bool) -> DataFrame:
    """(anchor, doc_id, and phrase or at) of every run of windows with one anchor: the hash of the whole run, or the word at
    which it begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, _, data, offsets in slices(batch):
                w = Windows.of(data, offsets)
                at, begins = w.runs()
                if not len(at):
                    continue
                out = [pa.array(w.anchor[at[begins]].view(np.int64)), pa.array(ids[first + w.text[at[begins]]])]
                if hashed:
                    nth = np.arange(len(at)) - np.repeat(begins, np.diff(np.r_[begins, len(at)]))
                    out.append(pa.array(np.add.reduceat(W.mix(w.hash[at] + nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)), begins).view(np.int64)))
                else:
                    out.append(pa.array(w.at[at[begins]], pa.int32()))
                yield pa.RecordBatch.from_arrays(out, ["anchor", "doc_id", "phrase" if hashed else "at"])

    return docs.mapInArrow(run, "anchor long, doc_id long, " + ("phrase long" if hashed else "at int"))


def lookups(docs: DataFrame) -> DataFrame:
    """(anchor, w, doc_id, at): the windows around the anchors in `mixed` of docs (doc_id, text, rest, mixed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, mixed = batch.column(0).to_numpy(), batch.column(3)
            for first, end, data, offsets in slices(batch):
                w = Windows.of(data, offsets)
                wanted = np.zeros(len(w.whole), bool)
                edge = np.searchsorted(w.text, np.arange(end - first + 1))
                for k in range(end - first):
                    a, b = edge[k], edge[k + 1]
                    if b > a:
                        wanted[a:b] = np.isin(w.anchor[a:b], mixed[first + k].values.to_numpy().view(np.uint64))
                at = np.flatnonzero(wanted & w.whole)
                yield pa.RecordBatch.from_arrays([pa.array(w.anchor[at].view(np.int64)), pa.array(w.hash[at].view(np.int64)), pa.array(ids[first + w.text[at]]), pa.array(w.at[at], pa.int32())], ["anchor", "w", "doc_id", "at"])

    return docs.mapInArrow(run, "anchor long, w long, doc_id long, at int")


def _found(known: pa.ListScalar, names: Sequence[str]) -> list[np.ndarray] | None:
    """The fields of a list of structs, ordered by the first one."""
    if not known.is_valid or not len(known):
        return None
    fields = [known.values.field(c).to_numpy(zero_copy_only=False) for c in names]
    order = np.argsort(fields[0].view(np.uint64), kind="stable")
    return [x[order] for x in fields]


def sources(anchor: np.ndarray, code: np.ndarray, settled: pa.ListScalar, single: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one text's windows: which have an earlier source, its document and its word position."""
    n = len(anchor)
    hit, doc, pos = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if known := _found(settled, ("anchor", "origin", "pos")):
        k = np.minimum(np.searchsorted(known[0].view(np.uint64), anchor), len(known[0]) - 1)
        hit = known[0].view(np.uint64)[k] == anchor
        begins = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        nth = np.arange(n) - np.repeat(begins, np.diff(np.r_[begins, n]))
        doc, pos = np.where(hit, known[1][k], 0), np.where(hit, known[2][k] + nth, 0)
    if known := _found(single, ("w", "anchor", "origin", "pos")):
        k = np.minimum(np.searchsorted(known[0].view(np.uint64), code), len(known[0]) - 1)
        more = (known[0].view(np.uint64)[k] == code) & (known[1].view(np.uint64)[k] == anchor)
        hit, doc, pos = hit | more, np.where(more, known[2][k], doc), np.where(more, known[3][k], pos)
    return hit, doc, pos


def factors(hit: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> list[tuple[int, int, int, int]]:
    """The greedy parse of one text: (first word, words, source document, its word). A factor that begins across the end of
    the one before takes the words after that end."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    goes_on = (at[1:] == at[:-1] + 1) & (doc[at[1:]] == doc[at[:-1]]) & (pos[at[1:]] == pos[at[:-1]] + 1)
    begins = np.flatnonzero(np.r_[True, ~goes_on])
    start, end = at[begins], at[np.r_[begins[1:] - 1, len(at) - 1]] + WINDOW
    cut = np.maximum(start, np.r_[0, end[:-1]])  # ends grow, as windows do
    return list(zip(cut.tolist(), (end - cut).tolist(), doc[start].tolist(), (pos[start] + cut - start).tolist(), strict=True))


_FACTOR = pa.struct([("start", pa.int64()), ("words", pa.int64()), ("source", pa.int64()), ("source_word", pa.int64())])
_PARSED = "doc_id long, n_words long, n_removed long, text string, whole string, factors array<struct<start:long,words:long,source:long,source_word:long>>"


def parsed(docs: DataFrame, others: str) -> DataFrame:
    """The greedy parse of docs (doc_id, text, rest, settled, single): `rest`, a struct of type `others`, comes along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            settled, single = batch.column(3), batch.column(4)
            for first, end, data, offsets in slices(batch):
                w = Windows.of(data, offsets)
                edge = np.searchsorted(w.text, np.arange(end - first + 1))
                raw, n_removed, texts, found = data.tobytes(), [], [], []
                for k in range(end - first):
                    words = raw[offsets[k] : offsets[k + 1]].split()
                    a, n = edge[k], int(w.first[k + 1] - w.first[k])
                    b = a + max(n - WINDOW + 1, 0)
                    mine = factors(*sources(w.anchor[a:b], w.hash[a:b], settled[first + k], single[first + k])) if b > a else []
                    if mine:
                        keep = np.ones(n, bool)
                        for x, many, _, _ in mine:
                            keep[x : x + many] = False
                        words = list(compress(words, keep.tolist()))
                    n_removed.append(n - len(words))
                    texts.append(b" ".join(words))
                    found.append([dict(zip(("start", "words", "source", "source_word"), x, strict=True)) for x in mine])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        pa.array(np.diff(w.first), pa.int64()),
                        pa.array(n_removed, pa.int64()),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                        batch.column(1).slice(first, end - first),
                        pa.array(found, pa.list_(_FACTOR)),
                        batch.column(2).slice(first, end - first),
                    ],
                    ["doc_id", "n_words", "n_removed", "text", "whole", "factors", "rest"],
                )

    return docs.mapInArrow(run, f"{_PARSED}, rest {others}")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words joined by one space), whole (the text as it was), factors (the removed
    spans with their sources) and rest (a struct of the columns in `keep`) for every row of docs.

    A word goes if a window of 13 words covers it whose word sequence also starts in a document with a smaller id; all
    windows are judged on the input. Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Null texts have no words; a null id is
    neither source nor copy; rows with equal ids are no copies of each other, and each is cut for itself. Other columns are
    ignored, whatever their names. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.struct(*(F.col(c) for c in keep or [id_col])).alias("rest"))
    known = docs.where("doc_id is not null").select("doc_id", "text")
    ends = phrases(known, hashed=True).groupBy("anchor").agg(F.min("doc_id").alias("origin"), F.max("doc_id").alias("last"), (F.min("phrase") == F.max("phrase")).alias("same"))
    shared = written(ends.where("origin < last").select("anchor", "origin", "same"), "anchors")
    met = written(phrases(known, hashed=False).join(shared, "anchor"), "met")
    begins = written(met.where("same and doc_id = origin").groupBy("anchor").agg(F.min("at").alias("pos")), "begins")
    settled = met.where("same and origin < doc_id").join(begins, "anchor").select("doc_id", F.struct("anchor", "origin", "pos").alias("settled"), F.lit(None).cast("long").alias("mixed"))
    mixed = met.where("not same").select("doc_id", F.lit(None).cast(settled.schema["settled"].dataType).alias("settled"), F.col("anchor").alias("mixed"))
    hits = written(settled.unionByName(mixed).groupBy("doc_id").agg(F.collect_set("settled").alias("settled"), F.collect_set("mixed").alias("mixed")), "hits")
    dealt = docs.repartition(parallelism(docs), "doc_id")  # used three times below with the same columns, so shuffled once
    around = lookups(dealt.join(hits.where("size(mixed) > 0").select("doc_id", "mixed"), "doc_id"))
    # Shuffled once for both uses: the last filter names at, and the first one what the join asks for, so the columns and rows
    # of both are the same.
    near = around.where("w is not null and anchor is not null and doc_id is not null and at is not null").repartition("w", "anchor")
    origin = near.groupBy("w", "anchor").agg(F.max("doc_id").alias("last"), F.min(F.struct("doc_id", "at")).alias("source")).where("source.doc_id < last")
    origin = origin.select("w", "anchor", F.col("source.doc_id").alias("origin"), F.col("source.at").alias("pos"))
    single = near.join(origin, ["w", "anchor"]).where("origin < doc_id and at + pos >= 0").groupBy("doc_id").agg(F.collect_set(F.struct("w", "anchor", "origin", "pos")).alias("single"))
    ready = dealt.join(hits.select("doc_id", "settled"), "doc_id", "left").join(single, "doc_id", "left")
    return parsed(ready, docs.schema["rest"].dataType.simpleString())
