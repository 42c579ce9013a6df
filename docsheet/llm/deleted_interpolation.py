"""Language-model scoring: word n-grams by deleted interpolation.

An order's maximum-likelihood estimate count(context, word) / count(context) is mixed with the order below it, the lowest with one share for each
known word and one for all others. The weight of an estimate depends on how often its context was counted (a bucket for each doubling);
the weights are learned by expectation-maximisation on held-out counts: one of ``FOLDS`` training documents (by the crc32 of its id) is left
out, the others give the estimates, the words left out give the counts. The final estimates use all training documents.

How it runs. Texts are written in blocks of some ``BLOCK`` bytes. A block sends its distinct n-grams, as 64-bit hashes with their counts, to the shards of the
hash; a shard sums them and answers each block with the totals, in the order that the block asked in. So a gram moves once for a block, not for each document
or occurrence, and counts are exact whatever the sizes: shards grow in number with the text, not in size. Grams of three words and more are only
asked where the words before them were counted ``LEAST`` times; rarer contexts say no more than the order below. What reaches the driver are totals and, for each bucket, a histogram
of the ratios between an estimate and the order below it (``BINS`` at most), from which the weights follow.

Tokens are the words between ASCII white space with A-Z lower-cased, then one end for each text; a null text is empty and has an end only. A null id reads
as empty text, so it's held out. Repeated rows count and are scored each for itself. Columns other than id and text aren't read, so names can't clash.
An empty table gives an empty table; without training text all words share alike. Two different grams are taken for one with a chance of 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import map_arrow, materialise, scratch, sharded_table, ship

#: Bytes of text in a block and in the distinct grams of a shard, about.
BLOCK = 12 << 20
#: A held-out document of so many trains the weights.
FOLDS = 10
#: Order of the model, least count of the contexts of three words and more, buckets of contexts, bins of a histogram (16 an octave).
ORDER, LEAST, BUCKETS, BINS = 3, 3, 24, 2048
#: Bytes hashed at once.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(13).integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_ORDERS = np.array([0x452821E638D01377, 0xBE5466CF34E90C6D, 0xC0AC29B7C97C50DD, 0x3F84D5B5B5470917, 0x9216D5D98979FB1B], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    made = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)])) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
    return made[0], made[1]


def _word_hashes(data: np.ndarray, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some bytes, and where they start: polynomials over the bytes, as differences of one running sum."""
    space = _SPACE[data]
    edges = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    first, last = np.nonzero(edges == -1)[0], np.nonzero(edges == 1)[0]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * powers[0][: len(data)], dtype=np.uint64)])
    return _mixed((sums[last] - sums[first]) * powers[1][first] + (last - first).astype(np.uint64) * np.uint64(_BASE)), first


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, number of tokens of each text), ends included."""
    words, sizes, powers = [], [], _powers(PIECE)
    pending: list[np.ndarray] = []
    starts: list[int] = [0]

    def flush() -> None:
        data = np.concatenate(pending) if pending else np.zeros(0, np.uint8)
        hashes, first = _word_hashes(data, powers if len(data) <= PIECE else _powers(len(data)))
        bounds = np.searchsorted(first, starts)
        counts = np.diff(bounds)
        sizes.append(counts + 1)
        at = np.cumsum(counts + 1) - 1
        out = np.full(len(hashes) + len(counts), END, np.uint64)
        mask = np.ones(len(out), bool)
        mask[at] = False
        out[mask] = hashes
        words.append(out)
        pending.clear()
        del starts[1:]

    blank = np.array([32], np.uint8)
    for text in texts:
        raw = text.as_buffer() if text.is_valid else None
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        if starts[-1] + len(data) + 1 > PIECE and len(starts) > 1:
            flush()
        pending += [data, blank]
        starts.append(starts[-1] + len(data) + 1)
    if len(starts) > 1:
        flush()
    return (np.concatenate(words) if words else np.zeros(0, np.uint64)), (np.concatenate(sizes) if sizes else np.zeros(0, np.int64))


class Grams:
    """The distinct n-grams of a block by order, with the place of each token's own among them. ``ends`` of each order are tokens that have such a gram."""

    def __init__(self, texts: pa.Array, train: np.ndarray) -> None:
        self.w, self.sizes = tokens(texts)
        n = len(self.w)
        first = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(n) - np.repeat(first, self.sizes)  # in its text
        self.train = np.repeat(train, self.sizes)
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def keys(self, order: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys in order, which of them each of ``ends`` has, how often training texts have them)."""
        key = _ORDERS[order] + np.zeros(len(ends), np.uint64)
        for back in range(order - 1, -1, -1):
            at = ends - back
            key = _mixed(key * np.uint64(_BASE) + (np.where(self.place[ends] >= back, self.w[at], START) if back else self.w[at]))
        distinct, mine = np.unique(key, return_inverse=True)
        return distinct, mine, np.bincount(mine, self.train[ends], len(distinct)).astype(np.int64)

    def ends(self, order: int, before: np.ndarray | None, least: int) -> np.ndarray:
        """Tokens that ask for a gram of ``order``; ``before`` are the counts of their grams of the order below (null: none)."""
        if order <= 2:
            return np.arange(len(self.w))
        at = np.nonzero(self.place >= order - 2)[0]
        return at[before[at - 1] >= least]


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first: what is zero in most of them then compresses to nothing."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _numbers(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _cut(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where each shard begins among sorted keys."""
    step = (1 << 64) // shards
    return np.searchsorted(keys, np.array([k * step for k in range(shards)], np.uint64))


def _rows(blocks: pa.Table) -> tuple[int, pa.Array, pa.Array, np.ndarray]:
    blocks = blocks.combine_chunks()
    column = lambda name: blocks.column(name).combine_chunks() if blocks.column(name).num_chunks != 1 else blocks.column(name).chunk(0)
    return blocks.column("block")[0].as_py(), column("id"), column("text"), column("train").to_numpy(zero_copy_only=False).astype(bool)


def _totals(answers: pa.Table, which: str) -> dict[int, np.ndarray]:
    """The totals of a block's grams by order, in the order of its keys."""
    parts: dict[int, list] = {}
    for order, _, data, width in sorted(zip(*(answers.column(c).to_pylist() for c in ("order", "shard", which, "width")), strict=True), key=lambda r: r[:2]):
        parts.setdefault(order, []).append(_numbers(data, f"u{width}").astype(np.int64))
    return {order: np.concatenate(x) for order, x in parts.items()}


ASKED = pa.schema([("order", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("fold", pa.bool_()), ("keys", pa.binary()), ("n", pa.binary())])
ANSWERED = pa.schema([("order", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("most", pa.binary()), ("every", pa.binary()), ("width", pa.int32()), ("types", pa.int64()), ("total", pa.int64())])


def _asked(orders: list[int], shards: int, least: int):
    """The grams of a block for the shards; of orders above 2, where the order below is counted often enough."""

    def run(key, blocks, answers=None):
        rows: list[tuple] = []
        if blocks.num_rows:
            block, _, texts, train = _rows(blocks)
            grams = Grams(texts, train)
            for order in orders:
                before = None
                if order > 2:
                    before = _token_counts(grams, _totals(answers, "every"), order - 1, least, first=min(2, order - 1))[-1]
                keys, _, n = grams.keys(order, grams.ends(order, before, least))
                at = [*_cut(keys, shards), len(keys)]
                rows += [(order, s, block, block < 0, _planes(np.diff(keys[a:b], prepend=np.uint64(0))), _planes(n[a:b].astype(np.uint32))) for s, (a, b) in enumerate(zip(at, at[1:])) if b > a]
        columns = list(zip(*rows, strict=True)) or [()] * len(ASKED)
        return pa.table([pa.array(x, f.type) for x, f in zip(columns, ASKED, strict=True)], schema=ASKED)

    return run


def _summed(key, asked):
    """Answers to the blocks: the totals of their keys over all training texts, and for blocks of the fold over the texts outside it; two rows without a block have the number of counted grams and their sum, over all and (``most`` is set) outside the fold."""
    blocks, folds = asked.column("block").to_pylist(), asked.column("fold").to_pylist()
    keys = [np.cumsum(_numbers(x, "u8"), dtype=np.uint64) for x in asked.column("keys").to_pylist()]
    counts = [_numbers(x, "u4") for x in asked.column("n").to_pylist()]
    order, shard = asked.column("order")[0].as_py(), asked.column("shard")[0].as_py()
    distinct, mine = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.concatenate(counts).astype(np.int64)
    every = np.bincount(mine, n, len(distinct)).astype(np.int64)
    outside = np.bincount(mine, np.where(np.repeat(folds, [len(k) for k in keys]), 0, n), len(distinct)).astype(np.int64)
    at, width = np.cumsum([0, *(len(k) for k in keys)]), 4 if every.max(initial=0) < 1 << 32 else 8
    sent = lambda totals, own: _planes(totals[own].astype(f"u{width}"))
    rows = [(order, shard, b, sent(outside, mine[x:y]) if f else None, sent(every, mine[x:y]), width, None, None) for b, f, x, y in zip(blocks, folds, at, at[1:])]
    rows += [(order, shard, None, mark, None, None, int((n > 0).sum()), int(n.sum())) for mark, n in ((None, every), (b"", outside))]
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), ANSWERED, strict=True)], schema=ANSWERED)


def _token_counts(grams: Grams, totals: dict[int, np.ndarray], upto: int, least: int, filters: dict[int, np.ndarray] | None = None, first: int = 1) -> list[np.ndarray]:
    """For each order from ``first`` on the count of every token's gram (0 where it wasn't asked). ``filters`` are the totals that decided what was asked, if these are others."""
    out: list[np.ndarray] = []
    asked: list[np.ndarray] = []
    for order in range(first, upto + 1):
        ends = grams.ends(order, asked[-1] if asked else None, least)
        keys, mine, _ = grams.keys(order, ends)
        for into, source in ((out, totals), (asked, filters or totals)):
            n = np.zeros(len(grams.w), np.int64)
            n[ends] = source[order][mine] if len(ends) else 0
            into.append(n)
    return out


def _probabilities(grams: Grams, counts: list[np.ndarray], texts: int, types: int, total: int, weights: list[np.ndarray], upto: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of each token by the orders below ``upto``, estimate of order ``upto`` (0 where its context is unknown), count of its context)."""
    p = np.full(len(grams.w), 1 / (types + 1))
    for order in range(1, upto + 1):
        if order == 1:
            context = np.full(len(p), total)
        else:  # what stands before a token is the gram of one order less that ends just there; a text's first token has the start before it
            before = np.concatenate([[0], counts[order - 2][:-1]])
            context = np.where(grams.place == 0, texts if order == 2 else 0, before)
            if order > 2:
                context = np.where((grams.place >= order - 2) & (context >= least), context, 0)
        estimate = np.divide(counts[order - 1], context, out=np.zeros(len(p)), where=context > 0)
        if order == upto and len(weights) < upto:
            return p, estimate, context
        share = np.where(context > 0, weights[order - 1][bucket(context)], 0.0)
        p = share * estimate + (1 - share) * p
    return p, estimate, context


def bucket(context: np.ndarray) -> np.ndarray:
    """The doublings of a count."""
    return np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64), BUCKETS - 1)


RATIOS = pa.schema([("bucket", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])


def _ratios(order: int, facts: tuple, weights: list[np.ndarray], least: int):
    """A block's words by bucket of their context and by the ratio of the estimate to the order below (16 bins an octave; -1: none)."""

    def run(key, blocks, answers):
        found = np.zeros((BUCKETS, BINS + 1), np.int64)
        if blocks.num_rows:
            _, _, texts, train = _rows(blocks)
            grams = Grams(texts, train)
            counts = _token_counts(grams, _totals(answers, "most"), order, least, _totals(answers, "every"))
            p, estimate, context = _probabilities(grams, counts, *facts, weights, order, least)
            known = (context > 0) & grams.train
            bins = np.where(estimate > 0, np.clip(np.round(16 * np.log2(np.maximum(estimate, 1e-300) / p)) + BINS // 2, 0, BINS - 1), BINS).astype(np.int64)
            np.add.at(found, (bucket(context[known]), bins[known]), 1)
        b, r = np.nonzero(found)
        return pa.table([pa.array(b, pa.int32()), pa.array(np.where(r == BINS, -1, r), pa.int32()), pa.array(found[b, r])], schema=RATIOS)

    return run


def learned(histogram: list[tuple[int, int, int]], steps: int = 500) -> np.ndarray:
    """The weight of an order for each bucket by expectation-maximisation: the share of words that come rather from its estimate than from the order below. Buckets without held-out words take the weight of the next lower one that has some, else one half."""
    out = np.full(BUCKETS, np.nan)
    for b in range(BUCKETS):
        rows = [(r, n) for x, r, n in histogram if x == b]
        if rows:
            ratio = np.array([0.0 if r < 0 else 2.0 ** ((r - BINS // 2) / 16) for r, _ in rows])
            n, share = np.array([n for _, n in rows], float), 0.5
            for _ in range(steps):
                share = float((n * share * ratio / (share * ratio + 1 - share)).sum() / n.sum())
                share = min(max(share, 1e-9), 1 - 1e-9)
            out[b] = share
        elif b:
            out[b] = out[b - 1]
    return np.nan_to_num(out, nan=0.5)


SCORED = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def _scored(facts: tuple, weights: list[np.ndarray], least: int, id_type: pa.DataType):
    schema = pa.schema([("id", id_type), *SCORED])

    def run(key, blocks, answers):
        if not blocks.num_rows:
            return schema.empty_table()
        _, ids, texts, train = _rows(blocks)
        grams = Grams(texts, train)
        counts = _token_counts(grams, _totals(answers, "every"), len(weights), least)
        _, types, total = facts
        p, _, _ = _probabilities(grams, counts, *facts, weights, len(weights), least)
        base = np.log10((counts[0] + 0.1) / (total + 0.1 * (types + 1)))
        add = lambda x: np.bincount(grams.row, x, len(grams.sizes))
        return pa.table([ids.cast(id_type), pa.array(grams.sizes), pa.array(add(counts[0] > 0).astype(np.int64)), pa.array(add(base)), pa.array(add(np.log10(p)))], schema=schema)

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the block of each row (id, text, train, fold, bytes): some ``BLOCK`` bytes of a task; blocks of the fold have negative numbers."""
    task, sizes = TaskContext.get().partitionId(), [0, 0]
    for batch in batches:
        fold, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "bytes"))
        out = np.zeros(len(fold), np.int64)
        for k in (0, 1):
            own = fold == bool(k)
            number = (task << 24) + (sizes[k] + np.cumsum(length[own])) // BLOCK
            out[own] = -1 - number if k else number
            sizes[k] += int(length[own].sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "block"])


def score(docs: DataFrame, held_out: int = 10, order: int = ORDER, least: int = LEAST, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[np.ndarray]]:
    """((id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, the weights by order and bucket).

    Texts whose id's crc32 (as text) is a multiple of ``held_out`` aren't learned from. ``base_score`` is that of single words with 0.1 added to each count; scores are sums of base-10 logarithms.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    crc = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    train = crc % held_out != 0
    with scratch(spark):
        rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).select("id", "text", train.alias("train"), (train & (F.floor(crc / held_out) % FOLDS == 0)).alias("fold"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
        placed = map_arrow(rows, _blocks, f"id {kind}, text string, train boolean, fold boolean, bytes long, block long").drop("fold")
        with sharded_table(placed, "block", parts) as table:
            size = table.agg(F.sum("bytes").alias("n"), F.count_if("train").alias("texts"), F.count_if(F.col("train") & (F.col("block") >= 0)).alias("outside")).first()
            shards = max(parts, -(-(size["n"] or 0) // BLOCK))
            texts = table.select("block", "id", "text", "train")
            own = texts.groupBy("block")
            answers, weights = None, []
            asked_kind, answered_kind = "order int, shard int, block long, fold boolean, keys binary, n binary", "order int, shard int, block long, most binary, every binary, width int, types long, total long"
            for orders in ([1, 2][:order], *([k] for k in range(3, order + 1))):
                first = answers is None
                ask = (lambda run: lambda key, blocks: run(key, blocks))(_asked(orders, shards, least)) if first else _asked(orders, shards, least)
                asked = own.applyInArrow(ask, asked_kind) if first else own.cogroup(answers.where("block is not null").groupBy("block")).applyInArrow(ask, asked_kind)
                found = materialise(asked.groupBy("order", "shard").applyInArrow(_summed, answered_kind), "zstd")
                answers = found if first else answers.unionByName(found)
            totals = answers.where("block is null and order = 1").groupBy(F.col("most").isNull().alias("all")).agg(F.sum("types").alias("types"), F.sum("total").alias("total")).collect()
            fact = {r["all"]: (size["texts"] if r["all"] else size["outside"], r["types"], r["total"]) for r in totals}
            every, outside = fact.get(True, (0, 0, 0)), fact.get(False, (0, 0, 0))
            answers = answers.where("block is not null")
            fold = texts.where("block < 0").groupBy("block")
            for k in range(1, order + 1):
                pairs = fold.cogroup(answers.where("block < 0").groupBy("block")).applyInArrow(_ratios(k, outside, list(weights), least), "bucket int, bin int, n long")
                weights.append(learned([tuple(r) for r in pairs.groupBy("bucket", "bin").agg(F.sum("n")).collect()]))
            id_type = to_arrow_type(docs.schema[id_col].dataType)
            scored = own.cogroup(answers.drop("most").groupBy("block")).applyInArrow(_scored(every, weights, least, id_type), f"id {kind}, n_tokens long, n_known long, base_score double, score double")
            scored = materialise(scored, kept=True)
    return scored.select(F.col("id").alias(id_col), (~train).alias("held_out"), "n_tokens", "n_known", F.lit(every[2]).cast("long").alias("train_tokens"), "base_score", "score"), weights


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]
