"""Toxicity by a support vector machine over a gapped subsequence kernel with Nyström landmarks.

The kernel compares two words by all subsequences of LENGTH characters they share, each weighted down by DECAY for every
character it spans, so an insult still resembles itself with characters inserted or left out. A text is toxic if one of its
sentences is, and a sentence if one of its words is: labels are given for texts only, so training picks in each toxic text
the word that speaks loudest (multiple-instance learning) and repeats. Words are scored once per worker and remembered.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations
from math import exp, lgamma, log
from sys import intern
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget

LENGTH, DECAY = 3, 0.6
LANDMARKS = 256
LONGEST = 24  # characters: a longer word is scored by its overlapping pieces of this length
SAMPLE = 3000  # labelled texts of each class that training reads at most, chosen by a hash of the id
ROUNDS = 5
REMEMBERED = 400_000  # word scores a worker keeps
THRESHOLD = 0.7
ALIKE = 0.97  # kernel value from which a word adds nothing to the landmarks
LOUD = 2.5  # log of how much more often a telling word is in toxic texts

_WORD = re.compile(r"[^\s.,;:!?\"()\[\]{}<>«»„“”…]+")
_INNER = re.compile(r"[^\w]|_")
_SPACED = re.compile(r"(?<!\S)(?:\w[\s.\-_*]+){3,}\w(?!\S)")


def sentences(text: str) -> list[list[str]]:
    """The words of each line or sentence, lower-cased; letters spelt out with blanks or signs between become a word too."""
    out = []
    for line in text.lower().splitlines():
        out.append(_WORD.findall(line))
        out += [[_INNER.sub("", m)] for m in _SPACED.findall(line)]
    return out


def units(text: str) -> set[str]:
    """All distinct words of a text (of all its sentences)."""
    low = text.lower()
    found = set(_WORD.findall(low))
    found.update(_INNER.sub("", m) for m in _SPACED.findall(low))
    return found


def _codes(words: list[str], wide: int) -> np.ndarray:
    """Words as rows of code points, filled with zeros."""
    out = np.zeros((len(words), wide), np.uint32)
    for k, w in enumerate(words):
        out[k, : len(w)] = np.frombuffer(w.encode("utf-32-le", "replace"), "<u4")
    return out


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Subsequence kernel of all rows of s with all rows of t (codes filled with zeros), by Lodhi's recursion.

    near[i][j] is K'_i of the part of s read so far with the first j characters of t.
    """
    n, m, wide = len(s), len(t), t.shape[1]
    lam, two = np.float32(DECAY), np.float32(DECAY * DECAY)
    one = np.ones((n, m), np.float32)
    near = [[np.zeros((n, m), np.float32) for _ in range(wide + 1)] for _ in range(LENGTH)]
    total = np.zeros((n, m), np.float32)
    for k in range(s.shape[1]):
        x = s[:, k]
        if not x.any():
            break
        same = [((x[:, None] == t[None, :, j]) & (x != 0)[:, None]).astype(np.float32) * two for j in range(wide)]
        live = (x != 0).astype(np.float32)[:, None]
        shrink = 1 - live * (1 - lam)
        for j in range(LENGTH - 1, wide):
            total += same[j] * near[LENGTH - 1][j]
        for i in range(LENGTH - 1, 0, -1):  # from the longest, so that each uses the previous values of the shorter
            ends = np.zeros((n, m), np.float32)
            for j in range(i, wide + 1):
                ends = lam * ends + same[j - 1] * (one if i == 1 else near[i - 1][j - 1])
                near[i][j] = shrink * near[i][j] + live * ends
    return total


def kernels(s: np.ndarray, t: np.ndarray, rows: int = 64) -> np.ndarray:
    """`kernel`, so many rows of s at a time: its recursion holds LENGTH tables for each character of t."""
    return np.concatenate([kernel(s[k : k + rows], t) for k in range(0, len(s), rows)])


def triples(length: int) -> tuple[np.ndarray, np.ndarray]:
    """All places i < j < k of a word, and the weight that each span gives its characters."""
    at = np.array(list(combinations(range(length), LENGTH)), np.int64).reshape(-1, LENGTH)
    return at, np.float32(DECAY) ** (at[:, -1] - at[:, 0] + 1).astype(np.float32)


@dataclass
class Model:
    """Landmark words with their weights: the margin of a word is sum(weight * K(word, landmark)) / sqrt(K(word, word)) + bias.

    The kernel is an inner product over character triples, so the weighted sum over all landmarks is one table over
    triples of the landmarks' characters: a word reads its own triples there, whatever the number of landmarks.
    """

    landmarks: list[str]
    weight: np.ndarray
    bias: float
    slope: float
    offset: float
    table: np.ndarray | None = None
    signs: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.signs = np.array(sorted({ord(c) for w in self.landmarks for c in w}), np.uint32)
        n = len(self.signs) + 1
        table = np.zeros(n**LENGTH, np.float64)
        for word, weight in zip(self.landmarks, self.weight, strict=True):
            at, span = triples(len(word))
            c = self._sign(_codes([word], len(word)))[0]
            np.add.at(table, (c[at[:, 0]] * n + c[at[:, 1]]) * n + c[at[:, 2]], weight * span)
        self.table = table.astype(np.float32)

    def _sign(self, codes: np.ndarray) -> np.ndarray:
        """Characters as numbers, 0 for those that no landmark has."""
        at = np.searchsorted(self.signs, codes)
        at[at == len(self.signs)] = 0
        return np.where(self.signs[at] == codes, at + 1, 0) if len(self.signs) else np.zeros(codes.shape, np.int64)

    def margins(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.bias, np.float64)
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w), []).append(k)
        n = len(self.signs) + 1
        for length, mine in by.items():
            if length < LENGTH or not len(self.signs):
                continue
            if length > LONGEST:
                step = LONGEST // 2
                for k in mine:
                    out[k] = self.margins([words[k][i : i + LONGEST] for i in range(0, length - step, step)]).max()
                continue
            at, span = triples(length)
            for k in range(0, len(mine), 4096):
                part = mine[k : k + 4096]
                codes = _codes([words[i] for i in part], length)
                c = self._sign(codes).astype(np.int32)
                got = np.zeros(len(part), np.float32)
                for (i, j, m), s in zip(at.tolist(), span.tolist(), strict=True):
                    got += self.table[(c[:, i] * n + c[:, j]) * n + c[:, m]] * np.float32(s)
                out[part] += got / np.sqrt(np.maximum(_self(codes), 1e-12))
        return out

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def _self(s: np.ndarray) -> np.ndarray:
    """K(word, word) of many words at once: the recursion of `kernel` with each row against itself only."""
    n, wide = s.shape
    lam, two = np.float32(DECAY), np.float32(DECAY * DECAY)
    near = [[np.zeros(n, np.float32) for _ in range(wide + 1)] for _ in range(LENGTH)]
    total = np.zeros(n, np.float32)
    for k in range(wide):
        live = (s[:, k] != 0).astype(np.float32)
        shrink = 1 - live * (1 - lam)
        same = (s[:, k, None] == s) * two * live[:, None]
        for j in range(LENGTH - 1, wide):
            total += same[:, j] * near[LENGTH - 1][j]
        for i in range(LENGTH - 1, 0, -1):
            ends = np.zeros(n, np.float32)
            for j in range(i, wide + 1):
                ends = lam * ends + same[:, j - 1] * (1 if i == 1 else near[i - 1][j - 1])
                near[i][j] = shrink * near[i][j] + live * ends
    return total


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton steps on the active rows."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    hold = np.full(len(w), ridge)
    hold[-1] = 1e-6
    for _ in range(30):
        active = y * (x @ w) < 1
        a, c = x[active], cost[active]
        new = np.linalg.solve((a * c[:, None]).T @ a + np.diag(hold), (a * c[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a calibrated probability, with Platt's softened targets."""
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.c_[x, np.ones(len(x))]
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (p - t) + 1e-3 * (w - [1.0, 0.0]))
        w = w - np.clip(step, -3, 3)
    return float(max(w[0], 0.1)), float(w[1])


def telling(toxic: Counter, clean: Counter, n1: int, n0: int, rate: float = 0.1) -> list[str]:
    """Words seen in toxic texts too often for chance: binomial tails, false discovery rate `rate` (Benjamini-Hochberg)."""
    q = n1 / (n1 + n0)

    def tail(d: int, t: int) -> float:
        """P(at least d of t texts are toxic), its leading term with a geometric bound on the rest."""
        if d <= q * t:
            return 1.0
        term = exp(lgamma(t + 1) - lgamma(d + 1) - lgamma(t - d + 1) + d * log(q) + (t - d) * log(1 - q))
        ratio = (t - d) / (d + 1) * q / (1 - q)
        return min(1.0, term / (1 - ratio)) if ratio < 1 else 1.0

    p = sorted((tail(d, d + clean[w]), w) for w, d in toxic.items() if d > 1)
    last = max((k for k, (x, _) in enumerate(p, 1) if x <= rate * k / max(len(p), 1)), default=0)
    return [w for _, w in p[:last]]


def unlike(bags: list[list[str]], labels: np.ndarray) -> np.ndarray:
    """Marks texts to learn from: of copies and near copies with one label the first, else one text's words would pass for
    words of many. Two bags are alike if two of 16 min-hash pairs agree."""
    odd = np.random.default_rng(11).integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    seen: set[tuple] = set()
    keep = np.ones(len(bags), bool)
    for k, bag in enumerate(bags):
        h = np.array([crc32(w.encode("utf-8", "replace")) for w in bag], np.uint64)
        if not len(h):
            continue
        low = ((h[:, None] * odd) >> np.uint64(13)).min(axis=0).tolist()
        keys = [(int(labels[k]), i, low[i], low[i + 1]) for i in range(0, 16, 2)]
        keep[k] = sum(x in seen for x in keys) < 2
        seen.update(keys)
    return keep


def unalike(words: list[str], room: int) -> list[str]:
    """Landmarks in order of preference: each word whose kernel value with every earlier one stays below ALIKE."""
    words = list(dict.fromkeys(words))[: 2 * room]
    if not words:
        return []
    s = _codes(words, max(map(len, words)))
    size = np.sqrt(np.maximum(_self(s), 1e-12))
    alike = kernels(s, s) / size[:, None] / size[None, :] >= ALIKE
    chosen: list[int] = []
    for k in range(len(words)):
        if len(chosen) < room and not alike[k, chosen].any():
            chosen.append(k)
    return [words[k] for k in chosen]


def bag_of(text: str) -> list[str]:
    """The distinct words of a text's sentences that the kernel can compare."""
    return sorted({w for s in sentences(text) for w in s if LENGTH <= len(w) <= LONGEST})


def fit(bags: list[list[str]], labels: list[int]) -> Model:
    """Trains on the words of whole texts with labels 1 (toxic) or 0. With one class only, every score is that class's share."""
    y = np.array(labels, int)
    if not y.any() or y.all():
        return Model([], np.zeros(0), 0.0, 1.0, 4.0 if y.any() else -4.0)
    fresh = unlike(bags, y)
    bags, y = [bag for bag, k in zip(bags, fresh, strict=True) if k], y[fresh]
    # Two thirds of each class are learnt from; scores are calibrated on all, so also on words the machine hasn't seen.
    nth = np.where(y == 1, np.cumsum(y) - 1, np.cumsum(1 - y) - 1)
    judged, learnt = (bags, y), nth % 3 != 1
    bags, y = [bag for bag, k in zip(bags, learnt, strict=True) if k], y[learnt]
    toxic, clean = Counter(), Counter()
    for bag, label in zip(bags, y, strict=True):
        (toxic if label else clean).update(bag)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    loud = {w: log((n + 0.5) / (n1 + 1)) - log((clean[w] + 0.5) / (n0 + 1)) for w, n in toxic.items()}
    guilty = [bag for bag, label in zip(bags, y, strict=True) if label and bag]
    sure = {w for w in telling(toxic, clean, n1, n0) if loud[w] >= LOUD}
    unclear = [bag for bag in guilty if not sure.intersection(bag)]
    common = [w for w, _ in clean.most_common(600)]
    innocent = sorted(clean)
    every, hard, model = sorted({w for bag in unclear for w in bag}), [], None
    for _ in range(ROUNDS):
        counts = Counter({w: toxic[w] for w in sure})
        if model is None and not sure:
            counts.update(max(bag, key=lambda w: (loud[w], w)) for bag in guilty)
        elif model is not None:  # texts that no sure word explains: their loudest word, if the kernel agrees
            heard = dict(zip(every, model.margins(every), strict=True))
            counts.update(w for bag in unclear if heard[w := max(bag, key=lambda v: (heard[v] + 0.25 * loud[v], v))] > -0.5)
        positive = sorted(counts, key=lambda w: (-counts[w], w))
        negative = sorted(set(common) | set(hard))
        marks = unalike(positive, LANDMARKS * 3 // 4)
        marks += unalike([w for w in hard + common if w not in set(marks)], LANDMARKS - len(marks))
        t = _codes(marks, max(map(len, marks)))
        size = np.sqrt(_self(t))
        gram = kernels(t, t) / size[:, None] / size[None, :]
        value, vector = np.linalg.eigh(gram.astype(np.float64))
        good = value > 1e-4
        root = vector[:, good] / np.sqrt(value[good])
        rows = positive + negative
        s = _codes(rows, max(map(len, rows)))
        x = kernels(s, t) / np.sqrt(np.maximum(_self(s), 1e-12))[:, None] / size[None, :] @ root
        weight = np.array([counts[w] for w in positive], float) ** 0.75
        cost = np.r_[weight / weight.sum(), np.full(len(negative), 2 / len(negative))] * 2000
        w, bias = _svm(x, np.r_[np.ones(len(positive)), -np.ones(len(negative))], cost)
        model = Model(marks, root @ w / size, bias, 1.0, 0.0)
        wrong = model.margins(innocent)
        hard = sorted(set(hard) | {innocent[k] for k in np.argsort(-wrong)[:400]})
    rest = sorted({w for bag in judged[0] for w in bag})
    scores = dict(zip(rest, model.margins(rest), strict=True))
    top = np.array([max((scores[w] for w in bag), default=model.bias) for bag in judged[0]])
    model.slope, model.offset = _logistic(top, judged[1])
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on labelled rows of docs (doc_id, text) whose crc32(doc_id as text) mod 3 isn't 1: at most `sample` of each class.
    Texts are reduced to their distinct words where they lie; only those come to the driver."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out("doc_id"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(bag_of, batch.column(1).to_pylist()), pa.list_(pa.string()))], ["doc_id", "bag"])

    rows = []
    for label in (1, 0):
        chosen = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id")
        mine = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        bags = mine.mapInArrow(words, "doc_id long, bag array<string>").orderBy("doc_id", "bag").limit(2 * sample).toArrow().column("bag")
        rows += [([intern(w) for w in bag.as_py()], label) for bag in bags]  # each word once in memory
    return fit([x for x, _ in rows], [y for _, y in rows])


def held_out(column: str) -> Column:
    return F.crc32(F.encode(F.col(column).cast("string"), "utf-8")) % 3 == 1


def scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and rest (a struct of the columns in `keep`) for every row of docs; only the text
    decides a score.

    Null and empty texts have no words and get the score of a text with nothing to say. Equal texts score alike, whatever
    their ids. Without labels, or with one class, all texts score the same. A null id is not held out. Other columns are
    ignored, whatever their names. An empty table gives no rows.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(train(plain, labels, sample))
    # A text goes to the worker once: as a field of its row where the caller keeps it, else beside it.
    inside = "text" in keep
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*(F.col(c) for c in keep or ["doc_id"])).alias("rest"), *([] if inside else ["text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        model, known = shared.value, {}
        for batch in batches:
            for k in range(0, len(batch), 1024):
                part = batch.slice(k, 1024)
                texts = part.column(1).field("text") if inside else part.column(2)
                bags = [units(x or "") for x in texts.to_pylist()]
                if len(known) > REMEMBERED:
                    known = {}
                new = list(set().union(*bags).difference(known))
                known.update(zip(new, model.margins(new).tolist(), strict=True))
                out = [model.score(max(map(known.__getitem__, bag), default=model.bias)) for bag in bags]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.float64()), part.column(1)], ["doc_id", "score", "rest"])
        known.clear()
        forget()

    scored = rows.mapInArrow(run, f"doc_id long, score double, rest {rows.schema['rest'].dataType.simpleString()}")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "rest")
