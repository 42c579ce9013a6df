"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Documents stream through the automaton word by word; at each word the longest
suffix that occurs in some item is known. A suffix of ``window`` words and more,
or one that is a whole shorter item, marks its words as hit.

Null and empty texts have no words and no hits; items without words match
nothing. Items without an id are matched like others and only not named. Repeated
rows and items are judged one by one (equal items are all named). Items and texts may
be of any length: long items are cut into pieces that overlap by a window less a word. Results travel in one struct column, ``contamination``; a column of that
name in the input is replaced, all others pass through. An empty table gives an
empty table; an empty benchmark marks nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialise, set_aside

#: Words of test items in one automaton (some 600 bytes a word in each Python worker): a larger benchmark takes several passes over the documents.
SHARD_WORDS = 200_000
#: ASCII without letters and digits separates words; A-Z are lower-cased; all other bytes are kept.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_NORMAL).split() if text else []


class ItemAutomaton:
    """Suffix automaton of word sequences: every run of words of any item is a path from state 0."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window, self.vocabulary = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        number = self.vocabulary.setdefault
        coded = [(name, [number(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.items: dict[int, set[str]] = {}  # by state of a whole window
        self.whole: dict[int, list[tuple[int, str]]] = {}  # by state: short items that end there
        for name, words in coded:
            state = 0
            for k, w in enumerate(words):
                state = self.next[state][w]
                if k + 1 >= window:
                    self.items.setdefault(self.window_state(state), set()).add(name)
            if len(words) < window:
                self.whole.setdefault(self._holding(state, len(words)), []).append((len(words), name))
        self.shortest = min((min(len(words), window) for _, words in coded), default=window)
        self.short_ends = self._inherit()

    def _extend(self, last: int, w: int) -> int:
        old = self.next[last].get(w)
        if old is not None:
            return old if self.length[old] == self.length[last] + 1 else self._split(last, w, old)
        new = self._state(self.length[last] + 1, {})
        at = last
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at < 0:
            self.link[new] = 0
        else:
            old = self.next[at][w]
            self.link[new] = old if self.length[old] == self.length[at] + 1 else self._split(at, w, old)
        return new

    def _state(self, length: int, edges: dict[int, int], link: int = 0) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, at: int, w: int, old: int) -> int:
        """A state for the shorter runs that end like ``old``, of which those reached from ``at`` by ``w`` are the longest."""
        new = self._state(self.length[at] + 1, dict(self.next[old]), self.link[old])
        self.link[old] = new
        while at >= 0 and self.next[at].get(w) == old:
            self.next[at][w] = new
            at = self.link[at]
        return new

    def _holding(self, state: int, length: int) -> int:
        """The state on the way to the root that holds the suffix of this length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def window_state(self, state: int) -> int:
        return self._holding(state, self.window)

    def _inherit(self) -> dict[int, list[tuple[int, str]]]:
        """By state: the short items that are suffixes of its runs."""
        out: dict[int, list[tuple[int, str]]] = {}
        if self.whole:
            for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
                if found := self.whole.get(state, []) + out.get(self.link[state], []):
                    out[state] = found
        return out

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words (first, last) and the items whose windows occur."""
        runs: list[tuple[int, int]] = []
        windows: set[int] = set()
        names: set[str] = set()
        edges, link, length, shortest, window = self.next, self.link, self.length, self.shortest, self.window
        state = size = 0

        def hit(first: int, last: int) -> None:
            while runs and first <= runs[-1][1] + 1:
                first = min(first, runs.pop()[0])
            runs.append((first, last))

        for i, w in enumerate(map(self.vocabulary.get, words)):
            if w is None:
                state = size = 0
                continue
            to = edges[state].get(w)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = edges[state].get(w)
            if to is None:
                continue
            state, size = to, size + 1
            if size >= shortest:
                for n, name in self.short_ends.get(state, ()):
                    if n <= size:
                        hit(i - n + 1, i)
                        names.add(name)
                if size >= window:
                    hit(i - window + 1, i)
                    windows.add(state)
        for s in windows:
            names |= self.items[self.window_state(s)]
        names.discard(None)
        return runs, names


def _shards(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items in lists of bounded size, one list at a time."""
    shard, held, given = [], 0, False
    for row in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        words = normal_words(row["t"])
        at = 0
        while at < len(words):
            to = min(len(words), at + max(window, SHARD_WORDS - held))
            shard.append((row["i"], words[at:to]))
            held += to - at
            at = to if to == len(words) else to - window + 1  # windows over the cut are whole in the next piece
            if held >= SHARD_WORDS:
                yield shard
                shard, held, given = [], 0, True
    if shard or not given:
        yield shard


def mark(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_col: str = "item_id", item_text: str = "text", carry_text: bool = True) -> DataFrame:
    """Adds ``contamination``: n_words, n_hit, items (ids as sorted strings) and spans (code points) of the hit runs.

    A benchmark of one shard is matched in one pass over ``docs``. With more of them ``docs`` is written once with row numbers, each
    shard adds the numbers, spans and items of the rows that it hits, and these are joined back.
    """
    docs, back = set_aside(docs.drop("contamination"), "_row", "_spans", "_items")
    shards = _shards(benchmark, item_col, item_text, window)
    shard, following = next(shards), next(shards, None)
    left = [c for c in docs.columns if carry_text or c != text]
    schema = T.StructType([*(docs.schema[c] for c in left), T.StructField("contamination", RESULT)])
    share = docs.sparkSession.sparkContext.broadcast
    if following is None:
        return back(map_arrow(docs, _marker(share(ItemAutomaton(shard, window)), left, text), schema))
    rows = materialise(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = None
    while shard is not None:
        own = map_arrow(rows.select("_row", text), _marker(share(ItemAutomaton(shard, window)), ["_row"], text), T.StructType([T.StructField("_row", T.LongType()), schema["contamination"]]))
        hits = own.where("contamination.n_hit > 0").select("_row", F.col("contamination.spans").alias("s"), F.col("contamination.items").alias("i"))
        hits = materialise(hits)
        found = hits if found is None else found.unionByName(hits)
        shard, following = following, next(shards, None)
    joined = found.groupBy("_row").agg(F.flatten(F.collect_list("s")).alias("_spans"), F.array_distinct(F.flatten(F.collect_list("i"))).alias("_items"))
    return back(map_arrow(rows.join(joined, "_row", "left"), _united(left, text), schema))


def _marker(shared, left: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            out = []
            for value in batch.column(text):
                value = value.as_py()
                words = normal_words(value)
                runs, names = automaton.match(words)
                spans = []
                if runs:
                    at = [m.span() for m in _WORD.finditer(value)]
                    spans = [(at[a][0], at[b][1]) for a, b in runs]
                out.append(_result(len(words), sum(b - a + 1 for a, b in runs), names, spans))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in left), pa.array(out, _ARROW)], [*left, "contamination"])

    return run


def _united(left: list[str], text: str):
    """Results from the spans and items that all shards found together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, found, names in zip(batch.column(text), batch.column("_spans").to_pylist(), batch.column("_items").to_pylist(), strict=True):
                value = value.as_py()
                spans = _union([(s["start"], s["end"]) for s in found or ()])
                out.append(_result(len(normal_words(value)), sum(len(_WORD.findall(value[a:b])) for a, b in spans), names or (), spans))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in left), pa.array(out, _ARROW)], [*left, "contamination"])

    return run


def _result(n_words: int, n_hit: int, names, spans: list[tuple[int, int]]) -> dict:
    return {"n_words": n_words, "n_hit": n_hit, "items": sorted(names), "spans": [{"start": a, "end": b} for a, b in spans]}


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove(marked: DataFrame, max_coverage: float = 0.5, max_words: int | None = None, text: str = "text") -> DataFrame:
    """Cuts the hit spans out of the texts of a marked table and drops documents over the limits: a share of hit words above ``max_coverage``, or more than ``max_words`` hit words."""
    c = F.col("contamination")
    kept = marked.where((c["n_hit"] <= max_coverage * c["n_words"]) & (F.lit(True) if max_words is None else c["n_hit"] <= max_words))
    t = F.col(text)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"])).alias("out"))
    cut = F.aggregate(c["spans"], zero, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    return kept.withColumn(text, F.when(F.size(c["spans"]) > 0, cut).otherwise(t)).drop("contamination")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    c = F.col("contamination")
    marked = mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry_text=False)
    return marked.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"))


#: The query in DuckDB SQL: windows as joined words, hit words as positions.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT DISTINCT item, n, array_to_string(w[k : k + n - 1], ' ') AS gram FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
g AS (SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS gram FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i))),
f AS (SELECT r, g.n, k, item FROM g JOIN i ON g.n = i.n AND g.gram = i.gram),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS j FROM f) GROUP BY r),
s AS (SELECT r, count(DISTINCT item) AS n_items, coalesce(string_agg(DISTINCT item, ',' ORDER BY item), '') AS items FROM f GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)"""
