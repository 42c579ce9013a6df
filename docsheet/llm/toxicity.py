"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel compares windows of text by their common subsequences of three letters that
span at most five, each letter of span costing a factor, divided by the lengths of both feature
vectors; so insults with gaps or inserted characters stay close to the plain ones. Words of at
most ``WINDOW`` letters are one window; in longer ones, of whatever length, windows of that size
start at every second letter, and the worst of them speaks for the word. Letters are lower-cased,
digits and signs that stand for letters are read as such, other punctuation is dropped, and runs
of single letters are joined. A document scores by a logistic curve over its three worst words,
how many of its words lie on the toxic side, and its length.

Labels belong to documents, not windows (multiple instances): windows that are in far more
toxic rows than chance allows are the first positives; then, in turns, the machine is fitted
and the worst window of each toxic row that has one on the toxic side, or near it, becomes its
witness. Seeds also come in disguises drawn at random: one and two letters put in, one left
out, one doubled. Clean windows that the last machine finds worst join the negatives. On the
landmarks the machine is linear, and as the kernel is a product of subsequence weights, it
folds into one weight per subsequence.

Null and empty texts score as documents without any window. Repeated rows and
ties score alike. Only the id and text columns are read. An empty table gives an
empty table; without labels of both kinds every score is the share of toxic labels.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow

#: Symbols: 1 to 26 letters, 27 to 30 other bytes, 31 (``EDGE``) either end of a word; 0 separates.
SYMBOLS = 32
EDGE = b"\x1f"
#: Weight of each letter of span, and places of the second and third letter after the first.
DECAY, GAPS = 0.7, tuple((j, k) for k in range(2, 5) for j in range(1, k))
#: Letters of a window, and from one window of a longer word to the next.
WINDOW, STEP = 14, 2
#: Words whose decisions a task remembers.
REMEMBERED = 300_000
#: What the logistic curve sees of a document.
FEATURES = 9
#: Decisions from which on a word is counted.
LEVELS = (0.0, 0.4, 0.8)
#: Digits and signs read as letters (fixed values).
_READ = {ord(a): ord(b) - 96 for a, b in zip("013457@$", "oieastas", strict=True)}
_FOLD = bytes(0 if c in b" \t\n\x0b\x0c\r" else c - 64 if 65 <= c <= 90 else c - 96 if 97 <= c <= 122 else 27 + c % 4 if c >= 128 else _READ.get(c, 0) for c in range(256))
_DROP = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c in b" \t\n\x0b\x0c\r" or c in _READ)) + b"2689"
_SINGLES = re.compile(rb"(?<![^\0])[^\0](?:\0+[^\0](?![^\0]))+")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as symbols, in order; single letters next to each other make one word."""
    raw = (text or "").encode("utf-8", "replace").translate(_FOLD, _DROP)
    return [w for w in _SINGLES.sub(lambda m: m[0].replace(b"\0", b""), raw).split(b"\0") if w]


def windows(word: bytes) -> list[bytes]:
    """The windows of a word with its ends marked."""
    word = EDGE + word + EDGE
    if len(word) <= WINDOW:
        return [word]
    return [word[at : at + WINDOW] for at in range(0, len(word) - WINDOW + STEP, STEP)]


def kernel(a: bytes, b: bytes) -> float:
    """The kernel of two windows, by their vectors."""
    return float(vector(a) @ vector(b))


def vector(window: bytes) -> np.ndarray:
    """Feature vector of a window, of length 1 (0 for fewer than three letters)."""
    v = np.zeros(SYMBOLS**3)
    for j, k in GAPS:
        for i in range(len(window) - k):
            v[window[i] << 10 | window[i + j] << 5 | window[i + k]] += DECAY ** (k + 1)
    size = np.sqrt(v @ v)
    return v / size if size else v


def products(units: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Inner products of the vectors of ``units`` with ``weights`` (one weight, or a row of them, per subsequence)."""
    s = np.frombuffer(b"\0".join(units) + b"\0", np.uint8).astype(np.int64)
    ends = np.flatnonzero(s == 0)
    unit = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1))
    left = ends[unit] - np.arange(len(s))  # symbols up to the end of the window
    keys = [np.empty(0, np.int64)]
    for j, k in GAPS:
        if len(s) > k:
            at = np.flatnonzero(left[:-k] > k)
            keys.append(unit[at] << 17 | s[at] << 12 | s[at + j] << 7 | s[at + k] << 2 | (k - 2))
    key = np.sort(np.concatenate(keys))
    out = np.zeros((len(units), *weights.shape[1:]), weights.dtype)
    if not len(key):
        return out
    same = np.flatnonzero(np.diff(key >> 2, prepend=-1))  # repeated subsequences of a window are one feature
    value = np.add.reduceat(np.array([DECAY ** (k + 1) for k in range(2, 6)])[key & 3], same)
    owner, code = key[same] >> 17, key[same] >> 2 & (SYMBOLS**3 - 1)
    norm = np.sqrt(np.bincount(owner, value * value, len(units)))
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    terms = weights[code] * (value / norm[owner]).astype(weights.dtype).reshape(-1, *[1] * (weights.ndim - 1))
    out[owner[starts]] = np.add.reduceat(terms, starts)
    return out


class Decisions(dict):
    """By word: the largest decision of the machine on its windows, from -1 to 1 (beyond the margins more says nothing)."""

    def __init__(self, model: dict) -> None:
        super().__init__()
        self.weights, self.bias = model["weights"], model["bias"]

    def of(self, words: list[bytes]) -> np.ndarray:
        new = list({w for w in words if w not in self})
        if new and len(self) > REMEMBERED:
            self.clear()
            new = list(set(words))
        held, units, firsts = [], [], []
        for w in new:
            held.append(w)
            firsts.append(len(units))
            units += windows(w)
            if len(units) > 20_000:
                self._judge(held, units, firsts)
                held, units, firsts = [], [], []
        if held:
            self._judge(held, units, firsts)
        return np.fromiter(map(self.__getitem__, words), float, len(words))

    def _judge(self, words: list[bytes], units: list[bytes], firsts: list[int]) -> None:
        values = np.maximum.reduceat(products(units, self.weights), firsts)
        self.update(zip(words, np.clip(values + self.bias, -1, 1).tolist(), strict=True))


def describe(text: str | None, decisions: Decisions) -> np.ndarray:
    """What the logistic curve sees of a text: the three largest decisions (-1 where there are fewer words), and the logarithms
    of how many words are over each of ``LEVELS``, of the shares of those over the last two, and of the number of words."""
    words = words_of(text)
    top, over = [-1.0] * 3, np.zeros(len(LEVELS))
    for part in range(0, len(words), 100_000):
        values = decisions.of(words[part : part + 100_000])
        top = sorted([*top, *np.partition(values, max(0, len(values) - 3))[-3:].tolist()])[-3:]
        over += [(values > level).sum() for level in LEVELS]
    return np.array([*top, *np.log1p(over), *np.log1p(1000 * over[1:] / max(1, len(words))), math.log1p(len(words))])


def _appearances(bags: list[set[bytes]]) -> Counter:
    """By window: in how many rows it is."""
    return Counter(u for bag in bags for u in bag)


def _disguises(unit: bytes, draw: random.Random) -> list[bytes]:
    letter = lambda: bytes([draw.randint(1, 26)])
    at = lambda: draw.randint(2, len(unit) - 2)
    put = lambda w, i: w[:i] + letter() + w[i:]
    out = [put(unit, i) for i in range(2, len(unit) - 1) for _ in range(2)]
    out += [put(put(unit, at()), at()) for _ in range(2 * len(unit))]
    out += [unit[:i] + unit[i + 1 :] for i in range(2, len(unit) - 2) if len(unit) > 6]
    out += [unit[: i + 1] + unit[i:] for i in range(1, len(unit) - 1)]
    return out


def train(rows: list[tuple[str | None, int]], landmarks: int = 200, clean_windows: int = 8000, turns: int = 4, seed: int = 7) -> dict:
    """Model from (text, label) rows: weight of each subsequence, bias, and slope and offset of the final logistic curve (fitted on every third row, the machine on the others)."""
    draw = random.Random(seed)
    share = (sum(y == 1 for _, y in rows) + 0.5) / (len(rows) + 1)
    blank = {"weights": np.zeros(SYMBOLS**3, np.float32), "bias": -1.0, "slope": np.zeros(FEATURES), "offset": math.log(share / (1 - share))}
    rows, rest = [r for k, r in enumerate(rows) if k % 3], rows[::3]  # the curve is fitted on rows that the machine hasn't seen
    bags = [{u for w in set(words_of(t)) for u in windows(w) if len(u) >= 6} for t, _ in rows]
    bad = list({frozenset(b) for b, (_, y) in zip(bags, rows, strict=True) if y == 1})  # copies of one row count once
    good = list({frozenset(b) for b, (_, y) in zip(bags, rows, strict=True) if y == 0})
    if not bad or not good:
        return blank
    bad.sort(key=sorted)
    in_bad, in_good = _appearances(bad), _appearances(good)
    p = len(bad) / (len(bad) + len(good))

    def chance(u: bytes) -> float:
        """Log-likelihood ratio (G squared) of the split of a window's rows between toxic and other rows against none."""
        a, b = in_bad[u], in_good[u]
        return 2 * (a * math.log(a / (p * (a + b))) + (b * math.log(b / ((1 - p) * (a + b))) if b else 0))

    seeds = [u for u, n in in_bad.items() if n >= 3 and n * len(good) > 4 * (in_good[u] + 0.5) * len(bad) and chance(u) > 12]
    seeds = sorted(seeds, key=lambda u: (-chance(u), u))[: landmarks // 2]
    if not seeds:
        return blank
    every = sorted(in_good)
    found = sorted(u for u in in_bad if u not in in_good)
    disguised = sorted({d for u in seeds for d in _disguises(u, draw)} - in_good.keys() - set(seeds))
    disguised = draw.sample(disguised, min(len(disguised), 3000))
    witnesses, clean = [], draw.sample(every, min(len(every), clean_windows))
    for turn in range(turns):
        marks = seeds + draw.sample(clean, min(len(clean), landmarks - len(seeds)))
        basis = np.array([vector(u) for u in marks])  # landmarks x subsequences
        values, vectors = np.linalg.eigh(basis @ basis.T + 1e-6 * np.eye(len(marks)))
        root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
        table = np.ascontiguousarray(basis.T, np.float32)
        units = seeds + witnesses + disguised + clean
        z = np.concatenate([products(units[k : k + 1000], table) for k in range(0, len(units), 1000)]).astype(float) @ root
        z = np.hstack([z, np.ones((len(z), 1))])
        kind = np.repeat([0, 1, 2], [len(seeds) + len(witnesses), len(disguised), len(clean)])
        cost = np.array([0.2, 0.3, 0.5])[kind] / np.maximum(1, np.bincount(kind, minlength=3))[kind]
        w = _fit(z, np.where(kind < 2, 1.0, -1.0), cost, rounds=400 if turn == turns - 1 else 100)
        model = blank | {"weights": (basis.T @ (root @ w[:-1])).astype(np.float32), "bias": float(w[-1])}
        if turn < turns - 1:
            value = dict(zip(found, (products(found, model["weights"]) + model["bias"]).tolist(), strict=True))
            best = (max(((value[u], u) for u in bag if u in value), default=(-1.0, b"")) for bag in bad)
            witnesses = sorted({u for v, u in best if v > -0.2} - set(seeds))
            worst = np.argsort(-products(every, model["weights"]), kind="stable")[: clean_windows // 2].tolist()
            clean = draw.sample(every, min(len(every), clean_windows // 2)) + [every[k] for k in worst]
    decisions = Decisions(model)
    seen = np.array([describe(t, decisions) for t, _ in rest])
    model["slope"], model["offset"] = _logistic(seen, np.array([v for _, v in rest], float))
    return model


def _fit(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-4, rounds: int = 400) -> np.ndarray:
    """Linear support vector machine with squared hinge loss by accelerated gradients."""
    w = last = np.zeros(z.shape[1])
    step = 1 / (2 * np.linalg.eigvalsh((z * cost[:, None]).T @ z)[-1] + ridge)
    for k in range(rounds):
        v = w + k / (k + 3) * (w - last)
        gap = np.maximum(0, 1 - y * (z @ v))
        last, w = w, v - step * (ridge * v - 2 * z.T @ (cost * y * gap))
    return w


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and offset of a logistic curve by damped Newton steps."""
    shift, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    u = np.column_stack([(x - shift) / scale, np.ones(len(x))])
    b = np.zeros(u.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(u @ b, -30, 30)))
        b += np.clip(np.linalg.solve(u.T @ (u * (p * (1 - p))[:, None]) + 0.05 * np.eye(len(b)), u.T @ (y - p) - 0.05 * b), -2, 2)
    slope = b[:-1] / scale
    return slope, float(b[-1] - slope @ shift)


def labelled_rows(docs: DataFrame, labels: DataFrame, per_label: int = 1500) -> list[tuple[str | None, int]]:
    """At most ``per_label`` rows of each label in the order of a hash of their id, none of those held out."""
    own = labels.where("toxic is not null").select("doc_id", "toxic").where(~held_out()).join(docs.select("doc_id"), "doc_id", "left_semi")
    out = []
    for label in (0, 1):
        order = (F.xxhash64("doc_id"), F.col("doc_id"))
        ids = own.where(F.col("toxic") == label).orderBy(*order).limit(per_label).select("doc_id")  # bounded, so texts aren't shuffled
        chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").orderBy(*order).limit(per_label)
        out += [(r["text"], label) for r in chosen.select("text").toLocalIterator()]
    return out


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def curve(seen: np.ndarray, model: dict) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(seen @ model["slope"] + model["offset"], -30, 30)))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        decisions = Decisions(m)
        for batch in batches:
            seen = np.array([describe(t.as_py(), decisions) for t in batch.column(1)]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(curve(seen, m))], ["doc_id", "score"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(labelled_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
