"""Near-duplicate documents: MinHash signatures under a multi-index Hamming join, links confirmed on full shingle sets.

A document's set is that of its distinct shingles of ``width`` words (its whole
sequence, if it has fewer words). Equal sets are one node. Signatures of 64 MinHash
values, 16 bits each, are cut into chunks; two signatures that differ in fewer
values than twice the chunks agree, in some chunk, on all values but one at most
(pigeonhole), so one key per chunk and left-out value finds all such pairs. The
values that may differ follow from ``percent``: a pair at that similarity differs
in more with a chance of 3e-5 at most (22 values and 12 chunks at 85 percent).

Hot buckets are not expanded into all pairs. The members of a group of copies that
agree most with the others (the sums of their buckets' sizes tell) head their
buckets: each member meets the head of its largest bucket first, then the heads of
its other buckets, then a few heads drawn by hashes, each time only if the two are
still in different components. Members whose buckets still hold several components
meet by an exact prefix filter: two sets of the wanted similarity share one of the
rarest shingles of either, as many as may be missing and one more; what is common to
many texts comes last in that order and makes no pairs. There, wide signatures tell
pairs near the threshold apart before their sets are read. So no link between
components is lost but by the chances stated with ``distance`` and ``wide_distance``.
Buckets and prefix groups of more than ``BLOCK`` members are dealt to several tasks (salted).

Null and empty texts have empty sets, are linked with nothing and stay. Rows
without a doc_id are never linked. Rows that share a doc_id are judged by their
own texts: equal sets are nodes of their own, numbered apart from the ids. Only the
id and text columns are read. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, having_ids, map_arrow, materialise, scratch, unused

#: Values of a signature, two-bit values of a wide one, and the chance that a pair at the wanted similarity differs in more values than looked for.
VALUES, WIDE, CHANCE = 64, 1024, 3e-5


def distance(percent: int) -> int:
    """The most values in which signatures may differ."""
    off = 1 - percent / 100
    beyond, d = 1.0, -1
    while beyond > CHANCE and d < VALUES:
        d += 1
        beyond = sum(comb(VALUES, k) * off**k * (1 - off) ** (VALUES - k) for k in range(d + 1, VALUES + 1))
    return d


def chunks(percent: int) -> int:
    """So many that one of them has one differing value at most."""
    return distance(percent) // 2 + 1


def wide_distance(percent: int) -> int:
    """The most two-bit values in which wide signatures may differ: 4.5 standard deviations over the mean."""
    off = 0.75 * (1 - percent / 100)
    return int(WIDE * off + 4.5 * sqrt(WIDE * off * (1 - off)))


DISTANCE, CHUNKS = distance(85), chunks(85)
#: Rounds of heads: by weight in the largest bucket of each member, then in all its buckets, then by hashes.
ROUNDS = ("largest", "all", 1, 2, 3)
#: Members of a bucket or prefix group that one task takes; more are dealt to several.
BLOCK = 256
#: Parts that the rows of one prefix shingle are dealt to before its size is known.
SALTS = 8
#: Distinct words whose hashes a task remembers.
REMEMBERED_WORDS = 500_000
FEATURES = "doc_id long, text_hash long, n_shingles long, hi long, lo long, p0 long, p1 long, p2 long, p3 long, signature binary"
PLANES = ("p0", "p1", "p2", "p3")

_MIX = np.random.default_rng(20240501).integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
#: For the words of a shingle by place, and for texts of so many words that have no whole shingle.
_PLACE = np.concatenate([_MIX[:3], np.random.default_rng(20240503).integers(1, 2**63, 29, dtype=np.uint64) | np.uint64(1)])
_SHORT = np.random.default_rng(20240505).integers(1, 2**63, 32, dtype=np.uint64)
_SCALE = np.random.default_rng(20240502).integers(1, 2**64, VALUES, dtype=np.uint64) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX[6]
    return (h ^ (h >> np.uint64(29))) * _MIX[7]


def shingles(text: str | None, hashes: dict, width: int = 3) -> np.ndarray:
    """The sorted 64-bit hashes of a text's shingle set."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(w) < width:
        return _spread((w * _PLACE[: len(w)]).sum(keepdims=True, dtype=np.uint64) + _SHORT[len(w)])
    n = len(w) - width + 1
    h = w[:n] * _PLACE[0]
    for k in range(1, width):
        h += w[k : k + n] * _PLACE[k]
    return np.unique(_spread(h))


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """128-bit hash of a set."""
    return int((s * _MIX[4]).sum(dtype=np.uint64)), int(_spread(s ^ _MIX[5]).sum(dtype=np.uint64))


def signature(items: np.ndarray) -> np.ndarray:
    """64 MinHash values, 16 bits each, of a set that isn't empty."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for part in range(0, len(items), 2048):
        h = items[part : part + 2048, None] * _SCALE
        least = np.minimum(least, (h ^ (h >> np.uint64(33))).min(axis=0))
    return (_spread(least) >> np.uint64(48)).astype("<u2")


def _features(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    names = [f.split()[0] for f in FEATURES.split(", ")]
    for batch in batches:
        for part in range(0, batch.num_rows, 2000):
            rows = batch.slice(part, 2000)
            n, keys, sigs = [], [], []
            for text in rows.column(2):
                s = shingles(text.as_py(), hashes, width)
                n.append(len(s))
                keys.append(_set_key(s))
                sigs.append(signature(s) if len(s) else np.zeros(VALUES, "<u2"))
            sig = np.array(sigs)
            key = np.array(keys, np.uint64).view(np.int64)
            bits = [np.packbits(((sig >> b) & 1).astype(np.uint8), axis=1).view(np.int64)[:, 0] for b in range(4)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n, pa.int64()), pa.array(key[:, 0]), pa.array(key[:, 1]), *map(pa.array, bits), pa.array([s.tobytes() for s in sig], pa.binary())], names)


def _chunk_keys(batches: Iterator[pa.RecordBatch], n_chunks: int = CHUNKS) -> Iterator[pa.RecordBatch]:
    """(key, id) rows: for each chunk, one key for each value left out."""
    parts = np.array_split(np.arange(VALUES), n_chunks)
    for batch in batches:
        for part in range(0, batch.num_rows, 2000):
            rows = batch.slice(part, 2000)
            sig = np.frombuffer(b"".join(rows.column(1).to_pylist()), "<u2").reshape(-1, VALUES).astype(np.uint64)
            keys = []
            for chunk in parts:
                for out in chunk:
                    h = np.full(len(sig), out, np.uint64)
                    for at in chunk:
                        if at != out:
                            h = (h ^ sig[:, at]) * _MIX[0] + (h >> np.uint64(23))
                    keys.append(_spread(h))
            key = np.array(keys).T.reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(rows.column(0).to_numpy(zero_copy_only=False), VALUES))], ["key", "id"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(id, items) from (id, hi, lo, text): the sets of those texts whose set has the hash (hi, lo)."""
    hashes = _WordHashes()
    for batch in batches:
        for part in range(0, batch.num_rows, 500):
            rows = batch.slice(part, 500)
            ids, items = [], []
            for k, hi, lo, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), rows.column(3), strict=True):
                s = shingles(text.as_py(), hashes, width)
                if _set_key(s) == (hi % 2**64, lo % 2**64):  # another text of the same doc_id has another set
                    ids.append(k)
                    items.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.binary())], ["id", "items"])


def _wide_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, wide) from (id, items): two bits of each of many MinHash values, all first bits before the second ones."""
    scale = np.random.default_rng(20240504).integers(1, 2**64, WIDE, dtype=np.uint64) | np.uint64(1)
    for batch in batches:
        rows = []
        for items in batch.column(1):
            items, least = np.frombuffer(items.as_buffer(), np.uint64), np.full(WIDE, np.iinfo(np.uint64).max, np.uint64)
            for part in range(0, len(items), 128):
                h = items[part : part + 128, None] * scale
                least = np.minimum(least, (h ^ (h >> np.uint64(33))).min(axis=0))
            least = _spread(least)
            rows.append(np.concatenate([np.packbits((least >> np.uint64(b) & np.uint64(1)).astype(np.uint8)).view(np.int64) for b in (63, 62)]))
        if rows:
            table = np.array(rows)
            wide = pa.ListArray.from_arrays(np.arange(0, table.size + 1, table.shape[1], dtype=np.int32), table.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), wide], ["id", "wide"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, token) from (id, items)."""
    for batch in batches:
        for k, items in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            tokens = np.frombuffer(items.as_py(), np.int64)
            for part in range(0, len(tokens), 1 << 16):
                own = tokens[part : part + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int64)), pa.array(own)], ["id", "token"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["ca", "cb"])

    return run


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Per document: a hash of its text, set size, 128-bit hash of the set, signature and its four low bit planes."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return map_arrow(rows, lambda batches: _features(batches, width), FEATURES)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b), the component being its least node.

    Each round joins every node to that neighbour, or itself, which comes first in a random order, and contracts the
    edges; rounds grow with the logarithm of the longest path. Nothing but counts reaches the driver.
    """
    label = None
    k = 0
    while True:
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("r"), F.col(c).alias("v"))  # noqa: B023, E731
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = materialise(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["v"].alias("root")))
        label = near if label is None else materialise(label.join(near.toDF("n2", "r2"), F.col("root") == F.col("n2"), "left").select("node", F.coalesce("r2", "root").alias("root")))
        ends = edges.join(near.toDF("a", "x"), "a").join(near.toDF("b", "y"), "b").where("x <> y")
        edges = materialise(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if edges.isEmpty():
            break
        k += 1
    least = label.groupBy("root").agg(F.min("node").alias("component"))
    return label.join(least, "root").select("node", "component")


def _close(x, y, percent: int) -> Column:
    """The signatures are within reach, and the set sizes allow the similarity; ``x`` and ``y`` name the columns of either side."""
    differ = None
    for p in PLANES:
        d = F.col(x(p)).bitwiseXOR(F.col(y(p)))
        differ = d if differ is None else differ.bitwiseOR(d)
    small, large = F.least(x("n_shingles"), y("n_shingles")), F.greatest(x("n_shingles"), y("n_shingles"))
    return (F.bit_count(differ) <= distance(percent)) & (100 * small >= percent * large)


def _blocks(n: str) -> Column:
    """How many blocks a group of ``n`` members is dealt to."""
    return F.ceil(F.col(n) / BLOCK)


def _block_of(n: str) -> Column:
    return F.pmod(F.xxhash64("id"), _blocks(n))


def _with_heads(members: DataFrame, draw: int | None = None) -> DataFrame:
    """``members`` (key, n, id, c, w, facts) of the buckets that hold several components, with ``head``: its best member (the first by hashes of ``draw``, if given).

    Buckets of more than a block are grouped per block first, and their heads sent to every block.
    """
    rows = members.withColumn("block", _block_of("n"))
    rank = F.struct((-F.col("w") if draw is None else F.xxhash64("id", F.lit(draw))).alias("w"), F.col("id").alias("h"), F.col("c").alias("hc"), *[F.col(f).alias(f"h_{f}") for f in ("n_shingles", *PLANES)])
    part = rows.groupBy("key", "block").agg(F.min(rank).alias("head"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.max("n").alias("m"))
    whole = part.groupBy("key").agg(F.min("head").alias("head"), F.min("c0").alias("c0"), F.max("c1").alias("c1"), F.max("m").alias("m")).where("c0 < c1")
    sent = whole.select("key", "head", F.explode(F.sequence(F.lit(0).cast("long"), _blocks("m") - 1)).alias("block"))
    return rows.join(sent, ["key", "block"]).drop("block")


def _prefix_pairs(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, ca, cb): all pairs of ``rest`` (id, c, facts) in different components whose sets may be similar enough, by the prefix filter."""
    tokens = materialise(map_arrow(having_ids(sets, rest.select("id")), _shingle_rows, "id long, token long"))
    shared = tokens.join(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "token")
    by_rarity = W.partitionBy("id").orderBy("df", "token")
    ranked = shared.withColumn("r", F.row_number().over(by_rarity)).withColumn("common", F.count(F.lit(1)).over(W.partitionBy("id")))
    # a shingle that no other set has comes first in the order and is only counted
    least = F.ceil(F.col("n_shingles") * percent / 100)
    prefix = ranked.join(rest, "id").where(F.col("n_shingles") - F.col("common") + F.col("r") <= F.col("n_shingles") - least + 1)
    prefix = materialise(prefix.select("token", "id", "c", "n_shingles", *PLANES))
    groups = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("token", "n")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = prefix.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(groups, ["token", "salt"]).withColumn("own", _block_of("n"))
    wide = materialise(map_arrow(having_ids(sets, materialise(own.select("id").distinct())), _wide_signatures, "id long, wide array<long>"))
    tokens_of = own.groupBy("id").agg(F.collect_set("token").alias("tokens"))
    every = own.join(wide, "id").join(tokens_of, "id").select("*", F.explode(F.sequence(F.lit(0).cast("long"), _blocks("n") - 1)).alias("other")).drop("n", "salt")
    x, y = every.alias("x"), every.alias("y")
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.own") == F.col("y.other")) & (F.col("x.other") == F.col("y.own"))
    differ, half = F.lit(0), WIDE // 64
    for k in range(half):  # read for pairs within reach only: one column, so that others cost no more than its place
        u, v = (F.get("x.wide", F.lit(at)).bitwiseXOR(F.get("y.wide", F.lit(at))) for at in (k, half + k))
        differ = differ + F.bit_count(u.bitwiseOR(v))
    found = x.join(y, same & (F.col("x.id") < F.col("y.id")) & (F.col("x.c") != F.col("y.c")) & _close("x.{}".format, "y.{}".format, percent) & (differ <= wide_distance(percent)) & (F.array_min(F.array_intersect("x.tokens", "y.tokens")) == F.col("x.token")))  # once, not for each shingle that they share
    return found.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.c").alias("ca"), F.col("y.c").alias("cb"))


def _merged(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """(node, component) of the components that those of ``pairs`` (a, b, ca, cb) join whose full sets are similar enough; null without any."""
    pairs = materialise(pairs.distinct())
    if pairs.isEmpty():
        return None
    own = having_ids(sets, materialise(pairs.select("a").union(pairs.select("b")).distinct().toDF("id")))
    full = pairs.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b").select("ca", "cb", "x", "y")
    links = map_arrow(full, _confirm(percent), "ca long, cb long")
    links = materialise(links.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
    return None if links.isEmpty() else materialise(components(links))


def _relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with their column ``c`` as ``labels`` (node, component) has it."""
    others = [x for x in rows.columns if x != "c"]
    return rows.join(labels, F.col("c") == F.col("node"), "left").select(*others, F.coalesce("component", "c").alias("c"))


def judged(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_shingles and component_id (null without a doc_id)."""
    made = materialise(features(docs, id_col, text_col, width))
    with scratch(docs.sparkSession):
        placed = materialise(_placed(made, docs, percent, id_col, text_col, width), kept=True)
    least = placed.groupBy("c").agg(F.min("first_doc").alias("component_id"))
    of_set = placed.join(least, "c").select("hi", "lo", "n_shingles", "component_id")
    out = made.select("doc_id", "text_hash", "n_shingles", "hi", "lo").join(of_set, ["hi", "lo", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"))


def _placed(made: DataFrame, docs: DataFrame, percent: int, id_col: str, text_col: str, width: int) -> DataFrame:
    """(hi, lo, n_shingles, first_doc, c): every distinct set with the least doc_id that has it and the number of its component."""
    n_chunks = chunks(percent)
    nodes = (
        made.where("n_shingles > 0 and doc_id is not null")
        .groupBy("hi", "lo", "n_shingles")
        .agg(F.min("doc_id").alias("first_doc"), *[F.first(x).alias(x) for x in (*PLANES, "signature")])
    )
    nodes = materialise(nodes.withColumn("id", F.monotonically_increasing_id()))  # written, so the numbers stay
    keys = materialise(map_arrow(nodes.select("id", "signature"), lambda batches: _chunk_keys(batches, n_chunks), "key long, id long"))
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialise(keys.join(buckets, "key"))
    weights = members.groupBy("id").agg(F.sum("n").alias("w"), F.max(F.struct("n", "key")).alias("largest")).select("id", "w", F.col("largest.key").alias("own"))
    facts = materialise(nodes.join(weights, "id").select("id", "first_doc", "hi", "lo", "w", "own", "n_shingles", *PLANES))
    texts = docs.select(F.col(id_col).cast("long").alias("first_doc"), F.col(text_col).alias("text"))
    few = facts.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = facts.select("id", "first_doc", "hi", "lo")
    sets = materialise(map_arrow(texts.join(F.broadcast(wanted) if few else wanted, "first_doc").select("id", "hi", "lo", "text"), lambda batches: _sets(batches, width), "id long, items binary"))
    if not made.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        sets = materialise(sets.dropDuplicates(["id"]))  # rows that repeat id and text
    rows = members.join(facts.drop("first_doc", "hi", "lo"), "id").withColumn("c", F.col("id"))
    labels = []
    for how in ROUNDS:
        mixed = materialise(_with_heads(rows.where("key = own") if how == "largest" else rows, how if isinstance(how, int) else None))
        near = mixed.where("c <> head.hc").where(_close(str, "head.h_{}".format, percent))
        pairs = near.select(F.least("id", "head.h").alias("a"), F.greatest("id", "head.h").alias("b"), F.when(F.col("id") < F.col("head.h"), F.col("c")).otherwise(F.col("head.hc")).alias("ca"), F.when(F.col("id") < F.col("head.h"), F.col("head.hc")).otherwise(F.col("c")).alias("cb"))
        found = _merged(pairs, sets, percent)
        rows = rows if how == "largest" else mixed.drop("head")
        if found is not None:
            labels.append(found)
            rows = _relabelled(rows, found)
        elif how in (2, 3):  # another draw found nothing: what is left goes to the exact filter
            break
    rest = materialise(_with_heads(rows).select("id", "c", "n_shingles", *PLANES).distinct())
    found = _merged(_prefix_pairs(rest, sets, percent), sets, percent)
    if found is not None:
        labels.append(found)

    placed = nodes.select("hi", "lo", "n_shingles", "first_doc", F.col("id").alias("c"))
    for step in labels:
        placed = _relabelled(placed, step)
    return placed


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (least doc_id reachable over links) and kept (doc_id = component_id).

    Sets of shingles of ``width`` words (32 at most) are linked from ``percent`` of similarity on.
    """
    rows = judged(docs, percent, id_col, text_col, width)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each component stays, one with the least doc_id.

    Of several texts in the component that have this id, the one of the least hash stays, and of rows that repeat it one.
    Rows without words or without a doc_id stay, whether repeated or not.
    """
    rows = materialise(judged(docs, percent, id_col, text_col, width).where("n_shingles > 0 and doc_id is not null"))
    first = rows.where("doc_id = component_id").groupBy("doc_id", "text_hash", "component_id").agg(F.count(F.lit(1)).alias("copies"))
    stays = first.withColumn("best", F.min("text_hash").over(W.partitionBy("component_id"))).where("text_hash = best")
    stays = materialise(stays.select("doc_id", "text_hash", "copies"))
    gone = materialise(rows.select("doc_id", "text_hash").distinct().join(stays, ["doc_id", "text_hash"], "left_anti"))
    key = unused(docs, "_id", "_hash")
    own = docs.withColumn(key[0], F.col(id_col).cast("long")).withColumn(key[1], F.xxhash64(text_col))
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    gone = gone.toDF(*key)
    left = own.join(F.broadcast(gone) if few else gone, key, "left_anti")
    repeated = stays.where("copies > 1").select("doc_id", "text_hash").toDF(*key)
    if not repeated.isEmpty():
        once = left.join(repeated, key, "left_semi").dropDuplicates(key)
        left = left.join(repeated, key, "left_anti").unionByName(once)
    return left.select(docs.columns)


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The query in DuckDB SQL: distinct sets, pairs by their common shingles, components by walking over links. For small tables.
SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS w FROM documents),
g AS (SELECT DISTINCT r, doc_id, array_to_string(w[k : k + 2], ' ') AS gram FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS k FROM d WHERE len(w) > 0)),
z AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n, md5(string_agg(gram, chr(10) ORDER BY gram)) AS h FROM g GROUP BY r),
u AS (SELECT h, n, min(r) AS r, min(doc_id) AS doc_id FROM z GROUP BY h, n),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.r < b.r AND a.r IN (SELECT r FROM u) AND b.r IN (SELECT r FROM u) GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN u s ON s.r = x JOIN u t ON t.r = y WHERE 100 * common >= 85 * (s.n + t.n - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
walk AS (SELECT r AS x, r AS y FROM u UNION SELECT walk.x, e.y FROM walk JOIN e ON walk.y = e.x),
c AS (SELECT x AS r, min(doc_id) AS component FROM walk JOIN u ON u.r = walk.y GROUP BY 1)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, d.doc_id = coalesce(c.component, d.doc_id) AS kept FROM d LEFT JOIN z ON z.r = d.r LEFT JOIN u ON u.h = z.h AND u.n = z.n LEFT JOIN c ON c.r = u.r"""
