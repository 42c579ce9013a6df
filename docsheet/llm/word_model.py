"""Quality classifier: an interpolated modified Kneser-Ney model of word bigrams, trained on trusted text.

Counts are aggregated per block of texts in the tasks and summed in hash shards; the lower order counts distinct words
before a word. The model is a table of counts by shard: its bigrams, and its words with what they are as contexts. To score, texts are
taken in blocks: a block asks each shard for the counts of its distinct words and bigrams, once for all of its texts, shards
answer in a join with the table, and the answers of a block, put together, give the probability of each of its tokens. So
the same two shuffles serve at every size, nothing of the model reaches the driver or is broadcast, and a frequent word is asked for once by a block.
Blocks, shards and their pieces travel as arrays, one row for each piece.

Scoring goes in ``BATCHES`` (by the text), each written before the next, and shuffle files go
with their query, so the disk in use is a fraction of what a single pass would shuffle; each batch reads the documents' files again.

A trusted document's words are in the table, so its own perplexity says nothing of new text. Every fifth trusted
document (by a hash of its id) is therefore left out of the counts, and the thresholds are quantiles of those.

Words are what ASCII white space separates, with digits alike; they are known by hashes of 40 bits, bigrams by 64. A start mark stands
before every text. Null, empty and blank texts have no perplexity (null) and aren't kept. Rows that repeat an id and text share
their score. A null language is a language of its own; one with fewer than ``least_trusted`` held-out documents
uses the quantile of all. Without held-out text nothing is rejected. Results travel in one struct column,
``quality_model``; a column of that name is replaced, all others pass through. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_table, having_ids, map_arrow, materialise, scratch, set_aside, sharded_table
from .neardup import _MIX, _spread, _WordHashes

#: One of so many trusted documents is held out for the thresholds.
FOLDS = 5
#: Words of a block of texts; a longer text is a block of its own.
HELD = 1 << 18
#: Passes of the scoring, least number of buckets of the table, and shards for each of them.
BATCHES, BUCKETS, SHARDS = 8, 64, 2
#: Words more frequent than one in so many were looked up in the tasks before blocks asked for each word once; nothing reads it now.
HOT = 20_000
#: Digits are alike, other white space is a space.
_NORMAL = bytes(48 if 48 <= c <= 57 else 32 if c in b"\0\t\n\x0b\x0c\r" else c for c in range(256))
#: A shard's sorted bigrams and their counts, or its sorted words and their rows of ``stats`` (distinct words before, total as a context, bigrams of it counted once, twice, more often); ``sums`` holds what the discounts need.
COUNTS = "shard int, keys binary, n binary, words binary, stats binary, sums array<long>"
#: What a block asks a shard for, or (part -1) the block itself: bigram and word of each token, ids and lengths of its texts.
ASKED = "shard int, block long, part int, pairs binary, words binary, texts binary"


class Discounts(NamedTuple):
    """Of bigrams and of words, by min(count, 3); words before a word in all; probability of a word never seen."""

    upper: tuple[float, ...]
    lower: tuple[float, ...]
    total: int
    unseen: float


def _codes(text: str | None, hashes: dict) -> np.ndarray:
    """40-bit hashes of the words of a text."""
    words = (text or "").encode("utf-8", "replace").translate(_NORMAL).split()
    return (np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)) >> np.uint64(24)).astype(np.int64)


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _spread(first.astype(np.uint64) * _MIX[0] + second.astype(np.uint64) * _MIX[1])


def _packed(x: np.ndarray) -> bytes:
    """64-bit integers byte plane by byte plane: planes of zeros compress to nothing."""
    return x.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes, kind: type = np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind)[:, 0]


def _edges(shards: int) -> np.ndarray:
    """The least 64-bit key of every shard but the first."""
    return np.array([k * 2**64 // shards for k in range(1, shards)], np.uint64)


def _parts(keys: np.ndarray, edges: np.ndarray) -> list[slice]:
    """Where the keys of each shard lie among sorted ones."""
    at = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    return [slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]


def _places(words: np.ndarray) -> np.ndarray:
    """Words as keys that shards are ranges of."""
    return words.astype(np.uint64) << np.uint64(24)


def _blocks(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, lengths, words, words before them) of the texts of a block, from (id, text)."""
    hashes, texts, size = _WordHashes(), [], 0

    def out():
        lengths = np.array([len(c) for _, c in texts], np.int64)
        c0 = np.concatenate([c for _, c in texts])
        c1 = np.concatenate([np.zeros(1, np.int64), c0[:-1]])
        c1[np.cumsum(lengths) - lengths] = 0
        return np.array([k for k, _ in texts], np.int64), lengths, c0, c1

    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            codes = _codes(text.as_py(), hashes)
            if len(codes):
                texts.append((row, codes))
                size += len(codes)
            if size >= held:
                yield out()
                texts, size = [], 0
    if texts:
        yield out()


def _summed(first: np.ndarray, second: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by their keys: these, sorted, the pairs and the sums of ``n`` (of ones)."""
    keys, at, back = np.unique(_mixed(first, second), return_index=True, return_inverse=True)
    return keys, first[at], second[at], np.bincount(back, n, len(at)).astype(np.int64)


def _counted(shards: int, held: int):
    """(shard, c1, c0, n): the distinct bigrams of blocks of texts, in a piece for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(shards)
        for _, _, c0, c1 in _blocks(batches, held):
            keys, *columns = _summed(c1, c0)
            pieces = [(k, *(_packed(x[own]) for x in columns)) for k, own in enumerate(_parts(keys, edges)) if own.start < own.stop]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*pieces, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["shard", "c1", "c0", "n"])

    return run


def _table(rows: list[tuple]) -> pa.Table:
    """Rows of ``COUNTS``."""
    kinds = {"shard": pa.int32(), "keys": pa.binary(), "n": pa.binary(), "words": pa.binary(), "stats": pa.binary(), "sums": pa.list_(pa.int64())}
    return pa.table({c: pa.array([r[k] for r in rows], kind) for k, (c, kind) in enumerate(kinds.items())})


def _joined(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([_unpacked(x) for x in column.to_pylist()])


def _bigrams(shards: int):
    """The bigrams of a shard from its pieces, and their words in a piece for each shard of the words."""

    def run(pieces: pa.Table) -> pa.Table:
        keys, c1, c0, n = _summed(*(_joined(pieces[c]) for c in ("c1", "c0", "n")))
        words, at = np.unique(np.concatenate([c1, c0]), return_inverse=True)
        before, after = at[: len(c1)], at[len(c1) :]
        summed = lambda where, by=None: np.bincount(where, by, len(words)).astype(np.int64)
        stats = np.array([summed(after), summed(before, n), summed(before, n == 1), summed(before, n == 2), summed(before, n > 2)])
        own = (pieces["shard"][0].as_py(), _packed(keys), _packed(n), None, None, [int((n == k).sum()) for k in (1, 2, 3, 4)])
        return _table([own, *((k, None, None, _packed(words[s]), _packed(np.ascontiguousarray(stats[:, s]).ravel()), None) for k, s in enumerate(_parts(_places(words), _edges(shards))) if s.start < s.stop)])

    return run


def _words(pieces: pa.Table) -> pa.Table:
    """The words of a shard from its pieces."""
    words, at = np.unique(_joined(pieces["words"]), return_inverse=True)
    columns = np.concatenate([_unpacked(x).reshape(5, -1) for x in pieces["stats"].to_pylist()], axis=1)
    stats = np.zeros((5, len(words)), np.int64)
    for k in range(5):
        np.add.at(stats[k], at, columns[k])
    n = stats[0]
    return _table([(pieces["shard"][0].as_py(), None, None, _packed(words), _packed(stats.ravel()), [*(int((n == k).sum()) for k in (1, 2, 3, 4)), int(n.sum()), int((n > 0).sum())])])


def _asked(shards: int, held: int):
    """Rows of ``ASKED``, from (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, first = _edges(shards), TaskContext.get().partitionId() << 32
        for block, (ids, lengths, c0, c1) in enumerate(_blocks(batches, held), first):
            words, w = np.unique(np.concatenate([np.zeros(1, np.int64), c0]), return_inverse=True)
            pairs, p = np.unique(_mixed(c1, c0), return_inverse=True)
            home = int(_spread(np.array([block], np.uint64))[0]) * shards >> 64  # blocks' own rows are spread over the shards
            pieces = [(home, block, -1, _packed(p), _packed(w[1:]), _packed(np.concatenate([ids, lengths])))]
            for k, (own, single) in enumerate(zip(_parts(pairs, edges), _parts(_places(words), edges), strict=True)):
                pieces.append((k, block, k, _packed(pairs[own]), _packed(words[single]), None))
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*pieces, strict=True), kinds, strict=True)], ["shard", "block", "part", "pairs", "words", "texts"])

    return run


def _found(table: np.ndarray, keys: np.ndarray, values: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """The columns of ``values`` of the ``keys`` that the sorted ``table`` has; else ``missing``."""
    if not len(table):
        return np.repeat(missing[:, None], len(keys), 1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[:, at], missing[:, None])


def _answered(d: Discounts):
    """(block, part, pairs, words, texts): counts of the bigrams asked for; lower-order probability, 1 / total and weight left to the lower order of the words."""

    def run(asked: pa.Table, shard: pa.Table) -> pa.Table:
        keys, n, words, values = np.zeros(0, np.uint64), np.zeros((1, 0), np.int64), np.zeros(0, np.int64), np.zeros((3, 0))
        for row in shard.to_pylist():
            if row["keys"] is not None:
                keys, n = _unpacked(row["keys"], np.uint64), _unpacked(row["n"])[None]
            else:
                words, stats = _unpacked(row["words"]), _unpacked(row["stats"]).reshape(5, -1)
                total = np.maximum(stats[1], 1)
                left = (stats[2:] * np.array(d.upper[1:])[:, None]).sum(0)
                values = np.array([(stats[0] - np.array(d.lower)[np.minimum(stats[0], 3)]) / max(d.total, 1) + d.unseen, (stats[1] > 0) / total, np.where(stats[1] > 0, left / total, 1.0)])
        zero, never = np.zeros(1, np.int64), np.array([d.unseen, 0.0, 1.0])
        pairs, singles = [], []
        for part, x, y in zip(asked["part"].to_pylist(), asked["pairs"].to_pylist(), asked["words"].to_pylist(), strict=True):
            pairs.append(x if part < 0 else _packed(_found(keys, _unpacked(x, np.uint64), n, zero)[0]))
            singles.append(y if part < 0 else _found(words, _unpacked(y), values, never).astype(np.float32).tobytes())
        return pa.table({"block": asked["block"], "part": asked["part"], "pairs": pa.array(pairs, pa.binary()), "words": pa.array(singles, pa.binary()), "texts": asked["texts"]})

    return run


def _scored(d: Discounts):
    """(_row, _logp, _n) of the texts of a block, from the answers to it."""

    def run(pieces: pa.Table) -> pa.Table:
        parts = sorted(zip(pieces["part"].to_pylist(), pieces["pairs"].to_pylist(), pieces["words"].to_pylist(), pieces["texts"].to_pylist(), strict=True), key=lambda x: x[0])
        (_, p, w, texts), answers = parts[0], parts[1:]
        ids, lengths = _unpacked(texts).reshape(2, -1)
        n = np.concatenate([_unpacked(x) for _, x, _, _ in answers])
        lower, share, left = np.concatenate([np.frombuffer(y, np.float32).reshape(3, -1) for _, _, y, _ in answers], axis=1).astype(float)
        starts = np.cumsum(lengths) - lengths
        w = _unpacked(w)
        c = np.concatenate([np.zeros(1, np.int64), w[:-1]])
        c[starts] = 0  # the start mark is the least of the words
        over = n - np.array(d.upper)[np.minimum(n, 3)]
        logp = np.log(over[_unpacked(p)] * share[c] + left[c] * lower[w])
        return pa.table({"_row": ids, "_logp": np.add.reduceat(logp, starts), "_n": lengths})

    return run


def _discounts(counts: list[int | None]) -> tuple[float, ...]:
    """The discounts of an order (0 of a count of 0) from its counts of counts."""
    t1, t2, t3, t4 = (t or 0 for t in counts)
    if not (t1 and t2 and t3):  # too little text for the estimates
        return 0.0, 0.5, 0.75, 0.9
    y = t1 / (t1 + 2 * t2)
    return 0.0, *(min(max(d, 0.05), k) for k, d in ((0.95, 1 - 2 * y * t2 / t1), (1.95, 2 - 3 * y * t3 / t2), (2.95, 3 - 4 * y * t4 / t3)))


@contextmanager
def _tidy(spark: SparkSession):
    """Shuffle files go with their query."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _buckets(spark: SparkSession) -> int:
    return max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def train(trusted: DataFrame, text: str = "text"):
    """(the table of counts, bucketed by shard, so that joins with it move only the other side; discounts; number of shards). The table goes at the end."""
    buckets = _buckets(trusted.sparkSession)
    shards = buckets * SHARDS
    pieces = map_arrow(trusted.select(F.lit(0).alias("id"), text), _counted(shards, HELD), "shard int, c1 binary, c0 binary, n binary")
    counted = materialise(pieces.groupBy("shard").applyInArrow(_bigrams(shards), COUNTS), "zstd")
    bigrams = counted.where("keys is not null")
    words = materialise(counted.where("keys is null").select("shard", "words", "stats").groupBy("shard").applyInArrow(_words, COUNTS), "zstd")
    sums = lambda table, many: list(table.agg(*[F.sum(F.col("sums")[k]) for k in range(many)]).first())
    upper = _discounts(sums(bigrams, 4))
    *ones, total, many = (n or 0 for n in sums(words, 6))
    lower = _discounts(ones)
    off = lower[1] * ones[0] + lower[2] * ones[1] + lower[3] * (many - ones[0] - ones[1])
    discounts = Discounts(upper, lower, total, (off / total if total else 1.0) / (many + 1))
    with sharded_table(bigrams.unionByName(words).drop("sums"), "shard", buckets) as table:
        delete_table(counted)
        delete_table(words)
        yield table, discounts, shards


def score(docs: DataFrame, model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without their text, with _n (words) and _logp, by joins of the distinct words and bigrams of each block of documents with the shards of the model."""
    table, discounts, shards = model
    rows = docs.withColumn("_row", F.xxhash64(id_col, text))
    parts = []
    for k in range(BATCHES):
        own = rows.where(F.pmod("_row", F.lit(BATCHES)) == k).select("_row", F.col(text).alias("_text"))
        asked = map_arrow(own, _asked(shards, HELD), ASKED)
        answers = asked.groupBy("shard").cogroup(table.groupBy("shard")).applyInArrow(_answered(discounts), "block long, part int, pairs binary, words binary, texts binary")
        parts.append(materialise(answers.groupBy("block").applyInArrow(_scored(discounts), "_row long, _logp double, _n long")))
    scores = reduce(DataFrame.unionByName, parts).groupBy("_row").agg(F.max("_logp").alias("_logp"), F.max("_n").alias("_n"))  # rows that repeat id and text
    out = rows.drop(text).join(scores, "_row", "left").drop("_row")
    return out.withColumn("_n", F.coalesce("_n", F.lit(0))).withColumn("_logp", F.coalesce("_logp", F.lit(0.0)))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, least_trusted: int = 20, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` without their text and with ``quality_model``: n_words, perplexity, threshold and kept.

    Trusted are documents that ``labels`` (doc_id, quality) marks 1. A document is kept if its perplexity is at most
    the ``quantile`` of the held-out trusted documents of its language.
    """
    docs, back = set_aside(docs.drop("quality_model"), "_row", "_text", "_n", "_logp", "_ppl", "_lang", "_limit")
    with _tidy(docs.sparkSession), scratch(docs.sparkSession):
        trusted = materialise(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("id")).distinct())
        held_out = F.pmod(F.xxhash64("id"), F.lit(FOLDS)) == 0
        counted = having_ids(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), materialise(trusted.where(~held_out)))
        with train(counted) as model:
            scored = materialise(score(docs, model, id_col, text).withColumn("_ppl", F.when(F.col("_n") > 0, F.exp(-F.col("_logp") / F.col("_n")))), kept=True)
        held_out_ids = materialise(trusted.where(held_out), kept=True)
    return back(verdicts(scored, held_out_ids, "n_words", quantile, least_trusted, id_col, lang))


def verdicts(scored: DataFrame, trusted: DataFrame, unit: str, quantile: float, least_trusted: int, id_col: str, lang: str) -> DataFrame:
    """``quality_model`` from _n, _logp and _ppl: ``unit`` (of _n), perplexity, threshold and kept."""
    own = having_ids(scored.select(F.col(id_col).alias("id"), F.col(lang).alias("_lang"), F.col("_ppl")).where("_ppl is not null"), trusted)
    limit = F.percentile_approx("_ppl", F.lit(quantile), F.lit(10_000)).alias("_limit")
    every = own.agg(limit).first()["_limit"]
    limits = own.groupBy("_lang").agg(limit, F.count(F.lit(1)).alias("_many")).where(F.col("_many") >= least_trusted).drop("_many")
    threshold = F.coalesce(F.col("_limit"), F.lit(every).cast("double"))
    out = scored.join(limits, F.col(lang).eqNullSafe(F.col("_lang")), "left")
    kept = F.coalesce((F.col("_n") > 0) & (threshold.isNull() | (F.col("_ppl") <= threshold)), F.lit(False))
    verdict = F.struct(F.col("_n").alias(unit), F.col("_ppl").alias("perplexity"), threshold.alias("threshold"), kept.alias("kept"))
    return out.withColumn("quality_model", verdict).drop("_n", "_logp", "_ppl", "_lang", "_limit")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    q = F.col("quality_model")
    judged = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "lang", *[q[c].alias(c) for c in ("n_words", "perplexity", "threshold", "kept")])
