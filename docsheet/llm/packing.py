"""Packing of tokenized documents into training sequences by best-fit decreasing.

A document's ids are cut into full windows first; what remains (less than a
window) goes to the tightest open window that holds it, longest first, found
in a segment tree over remaining capacities. Each task packs its own rows in
blocks of bounded size, so nothing is shuffled and memory doesn't grow with
the input; a block leaves a few windows short at most.

A null text counts as empty: its only id is the end mark. Repeated rows are
packed one by one; ties in length go by arrival. Only the id and text columns
are read, so other columns cannot clash. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow

#: White space that the regex engine of the fast encoder has no stack for, if it is some ten times as long.
_WIDE_SPACE = re.compile(r"(?<!\s)\s{10000}")
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class OpenWindows:
    """Open windows by remaining capacity; the tightest fit is found in a segment tree."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << (window - 1).bit_length()
        self.some = bytearray(2 * self.leaves)  # 1: an open window below this node
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def _mark(self, capacity: int) -> None:
        node = capacity + self.leaves
        self.some[node] = bool(self.open[capacity])
        while node > 1:
            node >>= 1
            self.some[node] = self.some[2 * node] | self.some[2 * node + 1]

    def put(self, window: int, capacity: int) -> None:
        self.open[capacity].append(window)
        if len(self.open[capacity]) == 1:
            self._mark(capacity)

    def take(self, length: int) -> tuple[int, int] | None:
        """Removes and returns (window, capacity) of the least capacity of ``length`` or more."""
        if length >= self.leaves:
            return None
        node, some = length + self.leaves, self.some
        while not some[node]:
            while node & 1:  # climb out of right children
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if some[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        window = self.open[capacity].pop()
        if not self.open[capacity]:
            self._mark(capacity)
        return window, capacity


def best_fit(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(window number, offset) of each piece, longest packed first."""
    tree, out, made = OpenWindows(window), [(0, 0)] * len(lengths), 0
    for k in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[k])
        if found is None:
            found, made = (made, window), made + 1
        out[k] = (found[0], window - found[1])
        if found[1] > lengths[k]:
            tree.put(found[0], found[1] - lengths[k])
    return out


def _encoder(path: str):
    """The byte-level BPE of ``path`` (ranks beside their base 64 bytes); special tokens are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path) as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _file_encoder(path: str, ranks: str | None = None):
    """The ids that the tokenizers library gives for the tokenizer file ``path``: its added tokens are single ids.

    ``ranks`` is the same vocabulary as BPE ranks: texts without added tokens and very long white space are encoded with it, as that is faster.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    exact = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    if not ranks:
        return exact
    fast = _encoder(ranks)
    return lambda text: exact(text) if any(t in text for t in added) or _WIDE_SPACE.search(text) else fast(text)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = 2048, end_id: int = 1, block_tokens: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit).

    ``tokenizer`` is a tokenizer file (.json), or one of byte-level BPE ranks without added tokens; by default byte_bpe_50k.json.
    ``block_tokens`` bounds what a task holds while it packs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        if tokenizer is None:
            encode = _file_encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
        else:
            encode = (_file_encoder if tokenizer.endswith(".json") else _encoder)(tokenizer)
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 40
        rows: list[tuple] = []  # full windows
        rest: list[tuple] = []  # (doc_id, start, length, doc_tokens, ids)
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, held
            placed = best_fit([r[2] for r in rest], window)
            out = rows + [(r[0], r[1], r[2], r[3], sequence + w, at, r[4]) for r, (w, at) in zip(rest, placed, strict=True)]
            sequence += 1 + max((w for w, _ in placed), default=-1)
            rows.clear(), rest.clear()
            held = 0
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = array("I", encode(text.as_py() or ""))
                ids.append(end_id)
                n = len(ids)
                for start in range(0, n, window):
                    part = ids[start : start + window]
                    if len(part) == window:
                        rows.append((doc, start, window, n, sequence, 0, part.tobytes()))
                        sequence += 1
                    else:
                        rest.append((doc, start, len(part), n, part.tobytes()))
                    held += len(part)
                    if held >= block_tokens:
                        yield flush()
        if held:
            yield flush()

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
