"""Spelling variants: words of a corpus grouped with their most frequent neighbours at one edit.

Two words at one inserted, deleted or replaced code point share the first or the second half of either of them exactly. So the
vocabulary is laid out twice, sorted forwards and backwards, and cut into ranges of some ``SHARD`` words. Each range becomes a minimal acyclic
automaton whose perfect-hash numbers (the rank of a word in its range) point at the counts. A word is looked up in the ranges that can hold its half:
the half is followed exactly, the rest with one error, forwards with the first half and backwards with the second; what both find counts once.

Counts are summed in blocks of ``HELD`` words in the tasks before they are shuffled. An automaton of one range is all that a task holds
(some 300 bytes a code point of words that share nothing), words to look up stream past it. The driver holds the first word of each range.
Roots come from links that double their reach in each written round.

Null and empty texts have no words; a null id reads as empty text. Repeated rows count each time. Columns other than id and text aren't read, so names
can't clash. An empty table, or one without words, gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_table, map_arrow, materialise, scratch

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Words of a range, about, and distinct words that a counting task holds before it hands them on.
SHARD, HELD = 50_000, 1 << 18
LAST = "\U0010ffff"


def _words(every: int, least_length: int):
    """(word, n): runs with their deletions, summed in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                low = (text.as_py() or "").encode("utf-8", "replace").lower().decode()  # bytes: A-Z only
                start = zlib.crc32(f"{doc or ''}:".encode())
                for word, n in Counter(RUN.findall(low)).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return run


def vocabulary(docs: DataFrame, every: int = 97, least_length: int = 5, least_count: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of the words with so many code points and occurrences."""
    parts = map_arrow(docs.select(F.col(id_col).cast("string"), text), _words(every, least_length), "word string, n long")
    return materialise(parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))


def automaton(words: list[str]) -> list:
    """The root of the minimal acyclic automaton of sorted distinct words. A state is [final, {character: (state, words before it)}, words below]."""
    known: dict = {}
    path, last = [[False, {}, 0]], ""

    def fold(depth: int) -> None:
        while len(path) > depth:
            state = path.pop()
            key = (state[0], *((ch, id(to)) for ch, to in state[1].items()))
            if key not in known:
                before = int(state[0])
                for ch, to in state[1].items():
                    state[1][ch] = (to, before)
                    before += to[2]
                state[2] = before
                known[key] = state
            if path:
                path[-1][1][last[len(path) - 1]] = known[key]

    root = path[0]
    for word in words:
        same = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
        fold(same + 1)
        for ch in word[same:]:
            path[-1][1][ch] = state = [False, {}, 0]
            path.append(state)
        path[-1][0], last = True, word
    fold(0)
    return root


def _follow(state: list, number: int, word: str, at: int, found: set[int]) -> None:
    """Adds the number of the word that goes on with ``word[at:]``, if there is one."""
    for ch in word[at:]:
        step = state[1].get(ch)
        if step is None:
            return
        state, number = step[0], number + step[1]
    if state[0]:
        found.add(number)


def one_error(root: list, word: str, half: int) -> set[int]:
    """Numbers of the words that share the first ``half`` characters of ``word`` and go on with exactly one error."""
    state, number, found = root, 0, set()
    for ch in word[:half]:
        step = state[1].get(ch)
        if step is None:
            return found
        state, number = step[0], number + step[1]
    for at in range(half, len(word) + 1):
        more = at < len(word)
        if more:
            _follow(state, number, word, at + 1, found)
        for ch, (to, before) in state[1].items():
            _follow(to, number + before, word, at, found)
            if more and ch != word[at]:
                _follow(to, number + before, word, at + 1, found)
        step = state[1].get(word[at]) if more else None
        if step is None:
            break
        state, number = step[0], number + step[1]
    return found


def _lookups(bounds: dict[int, tuple[list[str], list[int]]]):
    """A row for each range that can hold the half of a word, in either direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for side, key, half in ((0, word, len(word) // 2), (1, word[::-1], len(word) - len(word) // 2)):
                    firsts, shards = bounds[side]
                    low, high = max(0, bisect_right(firsts, key[:half]) - 1), max(0, bisect_right(firsts, key[:half] + LAST) - 1)
                    rows += [(s, side, 1, key, n) for s in shards[low : high + 1]]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["shard", "side", "kind", "key", "n"])

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, near, best_n, best) for each lookup; the rows of a range come together, first its words in order."""
    now, keys, counts, root = None, [], [], None
    for batch in batches:
        rows = []
        for shard, side, kind, key, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (shard, side) != now:
                now, keys, counts, root = (shard, side), [], [], None
            if kind == 0:
                keys.append(key)
                counts.append(n)
                continue
            if root is None:
                root = automaton(keys)
            word = key[::-1] if side else key
            half = len(word) // 2
            found = one_error(root, key, len(word) - half if side else half)
            own = word[:half]
            near = [(-counts[k], v) for k in found for v in (keys[k][::-1] if side else keys[k],) if not side or not v.startswith(own)]
            best = min(near, default=(None, None))
            rows.append((word, n, len(near), -best[0] if near else None, best[1]))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n", "near", "best_n", "best"])


def neighbours(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n, n_near, form, form_n) of a vocabulary (word, n): its near words, and the most frequent of them (of equals the first in code-point order)."""
    size = words.count()
    layout = words.select(F.lit(0).alias("side"), F.col("word").alias("key"), "n").unionByName(words.select(F.lit(1).alias("side"), F.reverse("word").alias("key"), "n"))
    ranges = materialise(layout.repartitionByRange(max(1, -(-2 * size // shard)), "side", "key").withColumn("shard", F.spark_partition_id()))
    first = ranges.groupBy("side", "shard").agg(F.min("key").alias("key")).orderBy("side", "key").collect()
    bounds = {side: ([r["key"] for r in first if r["side"] == side], [r["shard"] for r in first if r["side"] == side]) for side in (0, 1)}
    asked = map_arrow(words.select("word", "n"), _lookups(bounds), "shard int, side int, kind int, key string, n long")
    rows = ranges.select("shard", "side", F.lit(0).alias("kind"), "key", "n").unionByName(asked)
    parts = max(len(first), int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(parts, "shard", "side").sortWithinPartitions("shard", "side", "kind", "key")
    found = map_arrow(dealt, _answered, "word string, n long, near long, best_n long, best string")
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))).alias("b")
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best).select("word", "n", "n_near", F.col("b.word").alias("form"), (-F.col("b.n")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of a table of links (word, form) without cycles: each round follows the links found so far, so a chain of n takes log n rounds."""
    links = materialise(links.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialise(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        delete_table(links)
        links = after
        if links.where("moved").isEmpty():
            return links.drop("moved")


def variants(docs: DataFrame, factor: int = 2, every: int = 97, least_length: int = 5, least_count: int = 3, id_col: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a word's form is its most frequent near word if that has ``factor`` times its count; its root is where the forms lead."""
    with scratch(docs.sparkSession):
        near = materialise(neighbours(vocabulary(docs, every, least_length, least_count, id_col, text), shard))
        formed = F.col("form_n") >= factor * F.col("n")
        linked = near.withColumn("form", F.when(formed, F.col("form"))).withColumn("form_n", F.when(formed, F.col("form_n")))
        ends = roots(linked.where("form is not null"))
        out = linked.join(ends, "word", "left")
        return materialise(out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), kept=True)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same by a join on words with one code point left out; crc32 by the table of its 256 remainders.
SQL = """
WITH RECURSIVE bits(i, k, v) AS (SELECT r.range, 0, r.range FROM range(256) r UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS MATERIALIZED (SELECT d, w, count(*) AS n FROM (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY d, w),
hexed AS (SELECT w, n, hex(encode(d || ':' || w)) AS x FROM runs),
hashed AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda p: ('0x' || substr(x, p, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) AS h FROM hexed, crc),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS MATERIALIZED (SELECT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS v FROM (SELECT word, unnest(range(1, length(word) + 1)) AS p FROM words)),
pairs AS (SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.v = b.v AND a.p = b.p AND a.word <> b.word
  UNION ALL SELECT a.word, a.v FROM less a JOIN words w ON w.word = a.v UNION ALL SELECT a.v, a.word FROM less a JOIN words w ON w.word = a.v),
near AS MATERIALIZED (SELECT DISTINCT a, b FROM pairs),
best AS (SELECT a AS word, count(*) AS n_near, min({'n': -w.n, 'word': b}) AS f FROM near JOIN words w ON w.word = b GROUP BY a),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -f.n >= 2 * w.n THEN f.word END AS form, CASE WHEN -f.n >= 2 * w.n THEN -f.n END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS spot, 0 AS k FROM formed UNION ALL SELECT k.word, f.form, k.k + 1 FROM walk k JOIN formed f ON f.word = k.spot WHERE f.form IS NOT NULL)
SELECT f.word, form, e.spot AS root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT word, arg_max(spot, k) AS spot FROM walk GROUP BY word) e ON e.word = f.word
"""
