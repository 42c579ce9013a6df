"""WARC archives as chunked record tables, written and read back by Spark.

A record is a group of rows (record_id, chunk_no): payloads longer than a chunk are written as segmented records (WARC
1.1, "continuation"). They are cut by bytes in the JVM; Python sees one chunk at a time and carries the digest from chunk
to chunk, both when writing and when reading. Equal payloads of ``least`` bytes and more are stored once; the other records
revisit it.

Archives are plain text files for Spark, split at record breaks (the end of one record and the version of the next). What
counts is the stated length: where a payload holds a break itself, the reader walks through the blocks of that file in
order and gives the record's parts as chunks. Versions 1.0 and 1.1 are read, compressed by file as Spark does it. Paths may be in any store that Spark reaches.

That reader holds a record that its writer didn't segment as one line. Archives of others, whose records may be of any size, go through
``read_ranges``: a first pass walks from header to header by the stated lengths, without reading payloads; the payloads then become (record,
chunk) rows by byte ranges, dealt to the tasks chunk by chunk, so that no task holds more than a chunk of any record. It reads uncompressed files in stores that pyarrow opens.

A null payload is empty, a null url an empty one. Repeated rows are records of their own (of equal payloads, the
largest id and then the last row is the response). Only the id, url and payload columns are read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialise, scratch, shared_folder

#: Fixed values of the format; a break ends inside the version of the next record.
VERSION, END = "WARC/1.0\r\n", "\r\n\r\n"
BREAK = END + "WARC/1."
#: Bytes of a chunk.
CHUNK = 1 << 20
#: Bytes of a header at most, for archives read by ranges.
MOST_HEADER = 1 << 20
#: Revisits up to this number (some 120 bytes each) are broadcast, so payloads stay where they are; beyond it the join shuffles.
BROADCAST_REVISITS = 200_000
CHUNKS = "record long, page_id long, url string, chunk_no long, last boolean, payload binary, bytes long, total_bytes long, digest string"
DATE = "2024-01-01T00:00:00Z"


def _carry_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds digest, that of all chunks of a record up to each; the chunks of a record come in order."""
    now, sha = None, hashlib.sha1()
    for batch in batches:
        digests = []
        for record, chunk in zip(batch.column(0).to_pylist(), batch.column("payload"), strict=True):
            if record != now:
                now, sha = record, hashlib.sha1()
            sha.update(chunk.as_buffer())  # no copy
            digests.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], [*batch.schema.names, "digest"])


def chunks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", size: int = CHUNK) -> DataFrame:
    """(record, page_id, url, chunk_no, last, payload, bytes, total_bytes, digest) rows: the digest and the total are those of all chunks up to this one.

    Payloads of one chunk are digested where they are; longer ones go to Python chunk by chunk.
    """
    whole = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.monotonically_increasing_id().alias("n"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), whole.alias("whole"))
    total = F.octet_length("whole").cast("long")
    one = rows.where(total <= size).select(
        (2 * F.col("n")).alias("record"), "page_id", "url", F.lit(0).cast("long").alias("chunk_no"), F.lit(True).alias("last"), F.col("whole").alias("payload"), total.alias("bytes"), total.alias("total_bytes"), F.sha1("whole").alias("digest")
    )
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((total - 1) / size)))
    cut = rows.where(total > size).select("*", total.alias("total"), numbers.alias("chunk_no"))
    upto = F.least(F.col("total"), (F.col("chunk_no") + 1) * size)
    parts = cut.select(
        (2 * F.col("n") + 1).alias("record"), "page_id", "url", "chunk_no", (upto == F.col("total")).alias("last"), F.substring("whole", (F.col("chunk_no") * size + 1).cast("int"), F.lit(size)).alias("payload"), (upto - F.col("chunk_no") * size).alias("bytes"), upto.alias("total_bytes")
    )
    return one.unionByName(map_arrow(parts, _carry_digests, CHUNKS))


def resolve(table: DataFrame, least: int = 1000) -> DataFrame:
    """Adds ``first_record`` and ``first_page``, those of the response of each record's payload, to a chunk table (written before)."""
    whole = table.where("last").select("record", "page_id", "total_bytes", "digest")
    best = F.max(F.struct(F.col("page_id").alias("p"), F.col("record").alias("r")))
    firsts = whole.where(F.col("total_bytes") >= least).groupBy("digest", "total_bytes").agg(best.alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = whole.join(firsts, ["digest", "total_bytes"]).where(F.col("f.r") != F.col("record"))
    revisits = materialise(found.select(F.col("record").alias("_r"), F.col("f.r").alias("first_record"), F.col("f.p").alias("first_page"), F.col("digest").alias("_d"), F.col("total_bytes").alias("_t")))
    few = revisits.limit(BROADCAST_REVISITS + 1).count() <= BROADCAST_REVISITS
    return table.join(F.broadcast(revisits) if few else revisits, F.col("record") == F.col("_r"), "left").drop("_r")


def _urn(record: Column, page: Column, chunk: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), record, F.lit(":"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), chunk, F.lit(">"))


def blocks(resolved: DataFrame) -> DataFrame:
    """One ``value`` per WARC record (or segment of one), without the last line feed, which the text writer adds."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = F.col("first_record").isNotNull()
    first, whole = F.col("chunk_no") == 0, (F.col("chunk_no") == 0) & F.col("last")
    urn = _urn(F.col("record"), F.col("page_id"), F.col("chunk_no"))
    target = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "_")
    kind = F.when(revisit, "revisit").when(first, "response").otherwise("continuation")
    digest = F.concat(F.lit("sha1:"), F.coalesce("_d", "digest"))
    head = F.concat(
        F.lit(VERSION), line("WARC-Type", kind), line("WARC-Record-ID", urn), line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", target),
        F.when(revisit, F.concat(line("WARC-Refers-To", _urn(F.col("first_record"), F.col("first_page"), F.lit(0))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        F.when(revisit | F.col("last"), F.concat(line("WARC-Payload-Digest", digest), line("X-Payload-Length", F.coalesce("_t", "total_bytes").cast("string")))).otherwise(""),
        F.when(~revisit & ~whole, F.concat(line("WARC-Segment-Number", (F.col("chunk_no") + 1).cast("string")), F.when(~first, line("WARC-Segment-Origin-ID", _urn(F.col("record"), F.col("page_id"), F.lit(0)))).otherwise(""))).otherwise(""),
        F.when(~revisit & ~whole & F.col("last"), line("WARC-Segment-Total-Length", F.col("total_bytes").cast("string"))).otherwise(""),
        line("Content-Length", F.when(revisit, 0).otherwise(F.col("bytes")).cast("string")), F.lit("\r\n"),
    )
    body = F.concat(head, F.when(revisit, "").otherwise(F.col("payload").cast("string")), F.lit("\r\n\r"))
    return resolved.where(~revisit | first).select(body.alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = 1000, size: int = CHUNK, **columns: str) -> None:
    """Writes ``pages`` as uncompressed WARC files under ``path``, one per partition."""
    with scratch(pages.sparkSession):
        blocks(resolve(materialise(chunks(pages, size=size, **columns), "zstd"), least)).write.option("lineSep", "\n").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives under ``path``: record_id, chunk_no (segment number times 2^32, from 0, plus the part of the segment), type, url, refers_to, segmented (may have several chunks), declared_digest, declared_bytes, payload (binary) and complete (its length is the one stated)."""
    order = F.monotonically_increasing_id()  # lines of a split come in order
    lines = spark.read.option("lineSep", BREAK).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), order.alias("line"))
    records = _parsed(lines.select("*", F.lit(0).cast("long").alias("part")))
    # a block that is too short goes on in the next one: then its file is read in order
    broken = records.where("not complete").select("file").distinct()
    if not broken.isEmpty():
        broken = materialise(broken)
        walked = lines.join(broken, "file").repartition("file").sortWithinPartitions("file", "block", "line").select("file", "block", "line", "value")
        again = _parsed(materialise(map_arrow(walked, _walk, "file string, block long, line long, value binary, part long, head string, size long, held long")))
        records = records.join(broken, "file", "left_anti").unionByName(again)
    return records.drop("file").where("record_id is not null")


def _header(value: str | Column) -> Column:
    """The header of a record as text; a file's first one has the whole version."""
    return F.substring_index(F.col(value).cast("string"), END, 1)


def _parsed(lines: DataFrame) -> DataFrame:
    """Chunks from blocks: (value, file, part) and, of walked files, their header, stated size and bytes held in all parts."""
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?i)(?:^|\n){name}: *([^\r\n]*)", 1), F.lit(""))
    walked = "head" in lines.columns
    heads = lines if walked else lines.withColumn("head", _header("value"))
    raw = F.col("value") if walked else F.substring("value", F.octet_length("head") + (len(END) + 1), F.octet_length("value"))
    parts = heads.select("file", "part", "head", raw.alias("raw"), field("Content-Length").try_cast("long").cast("int").alias("size"), *(["held"] if walked else []))
    over = (F.col("held") if walked else F.octet_length("raw")) - F.col("size")
    number = F.coalesce(field("WARC-Segment-Number").try_cast("long"), F.lit(1)) - 1
    payload = F.col("raw") if walked else F.when(over == len(END), F.substring("raw", F.lit(1), F.col("size"))).otherwise(F.col("raw"))
    return parts.select(
        "file", F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID")).alias("record_id"),
        (number * (1 << 32) + F.col("part")).alias("chunk_no"),
        field("WARC-Type").alias("type"), field("WARC-Target-URI").alias("url"), field("WARC-Refers-To").alias("refers_to"),
        (field("WARC-Segment-Number").isNotNull() | F.lit(walked)).alias("segmented"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("declared_digest"), field("X-Payload-Length").try_cast("long").alias("declared_bytes"),
        payload.alias("payload"), F.coalesce(over.isin(0, len(END)), F.lit(False)).alias("complete"),
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of files in order as parts of records by their stated lengths: value (bytes of the payload), part (from 0), head, size and held (bytes of the payload up to here, those of its last part beyond the size included)."""
    names = ["file", "block", "line", "value", "part", "head", "size", "held"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    now, part, head, size, held, between = None, 0, "", 0, 0, BREAK.encode()
    for batch in batches:
        for file, block, line, value in zip(*(batch.column(k) for k in range(4)), strict=True):
            body = memoryview(value.as_buffer())
            if file.as_py() != now or held >= size:
                now, part, held = file.as_py(), 0, 0
                at = value.as_py().find(END.encode())
                # a payload that begins like a version makes a break with the end of its header
                between = (BREAK if at >= 0 else BREAK[len(END) :]).encode()
                at = len(body) if at < 0 else at
                head = bytes(body[:at]).decode("utf-8", "replace")
                body = body[at + len(END) :]
                size = next((int(x.split(":", 1)[1]) for x in head.splitlines() if x.lower().startswith("content-length:") and x.split(":", 1)[1].strip().isdigit()), 0)
            else:
                body, between = memoryview(between + bytes(body)), BREAK.encode()
                part += 1
            take = bytes(body[: size - held])
            left = len(body) - len(take)
            held += len(take)
            # what is beyond the stated size is counted, but not kept, if it isn't the end of the file's last record
            row = (now, block.as_py(), line.as_py(), take, part, head, size, held + (left if left not in (0, len(END)) else 0))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)


def _opened(uri: str):
    """A file by the address that Spark gives it."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return store.open_input_file(path)


def _record_at(file, at: int, end: int, step: int = 1 << 16) -> tuple[int, str, int] | None:
    """(start, header, first byte of the payload) of the first record at or after ``at``; null if there is none. What is between records is passed over."""
    start, held = None, b""
    while at < end or held:
        if at < end:
            file.seek(at)
            more = file.read(min(step, end - at))
            at += len(more)
            held += more
        if start is None:
            found = held.find(VERSION[:7].encode())
            if found < 0:
                held = held[-6:] if at < end else b""
                continue
            held, start = held[found:], at - len(held) + found
        stop = held.find(END.encode())
        if stop >= 0:
            return start, held[:stop].decode("utf-8", "replace"), start + stop + len(END)
        if at >= end or len(held) > MOST_HEADER:  # no header after all: on behind the mark
            at, start, held = start + len(VERSION[:7]), None, b""
    return None


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, head, at, size, complete) of every record of the files: headers are read, payloads passed over."""
    for batch in batches:
        for uri, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows, at = [], 0
            with _opened(uri) as file:
                while (found := _record_at(file, at, end)) is not None:
                    _, head, first = found
                    size = next((int(x.split(":", 1)[1]) for x in head.splitlines() if x.lower().startswith("content-length:") and x.split(":", 1)[1].strip().isdigit()), 0)
                    rows.append((uri, head, first, min(size, end - first), first + size <= end))
                    at = first + size
                    if len(rows) >= 1000:
                        yield _index_rows(rows)
                        rows = []
            if rows:
                yield _index_rows(rows)


def _index_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "head", "at", "size", "complete"])


def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the payload of each row (file, start, length and others): one chunk at a time."""
    uri, file = None, None
    for batch in batches:
        for k, (name, start, length) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "start", "length")), strict=True)):
            if name != uri:
                uri, file = name, _opened(name)
            file.seek(start)
            yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in batch.columns), pa.array([file.read(length)], pa.binary())], [*batch.schema.names, "payload"])


def read_ranges(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """The chunk table of uncompressed archives under ``path``, as ``read_archives`` gives it, with no payload over ``size`` bytes.

    A record cut off by the end of its file is there as far as it goes and not complete; text between records is passed over.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    parts = max(1, min(files.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    records = materialise(map_arrow(files.repartition(parts), _indexed, "file string, head string, at long, size long, complete boolean"), kept=True)
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?i)(?:^|\n){name}: *([^\r\n]*)", 1), F.lit(""))
    number = F.coalesce(field("WARC-Segment-Number").try_cast("long"), F.lit(1)) - 1
    named = records.select(
        "file", "at", "size", F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID")).alias("record_id"), number.alias("number"), field("WARC-Type").alias("type"), field("WARC-Target-URI").alias("url"), field("WARC-Refers-To").alias("refers_to"),
        (field("WARC-Segment-Number").isNotNull() | (F.col("size") > size)).alias("segmented"), F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("declared_digest"), field("X-Payload-Length").try_cast("long").alias("declared_bytes"), "complete",
    ).where("record_id is not null")
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("size") - 1) / size), F.lit(0))))
    each = named.withColumn("part", pieces)
    ranges = each.select(
        "record_id", (F.col("number") * (1 << 32) + F.col("part")).alias("chunk_no"), "type", "url", "refers_to", "segmented", "declared_digest", "declared_bytes", "complete",
        "file", (F.col("at") + F.col("part") * size).alias("start"), F.least(F.lit(size).cast("long"), F.col("size") - F.col("part") * size).alias("length"),
    )
    dealt = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).sortWithinPartitions("file", "start")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema) + ", payload binary"
    return map_arrow(dealt, _ranged, schema).select("record_id", "chunk_no", "type", "url", "refers_to", "segmented", "declared_digest", "declared_bytes", "payload", "complete")


def digests(table: DataFrame) -> DataFrame:
    """(record_id, type, url, refers_to, n_chunks, payload_bytes, payload_digest, intact): a record per group of chunks.

    A record that isn't segmented is digested where it is. The chunks of another come sorted to one task, which carries a digest
    from each to the next and never joins them. ``intact``: all chunks complete and in sequence, and bytes and digest as declared. A revisit has the declared bytes and digest of its response.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def close() -> None:
            if now:
                first, last, n, total, sha, good = now
                revisit = first[2] == "revisit"
                good = good and last[7] and (revisit or (last[5] in (None, sha.hexdigest()) and last[6] in (None, total)))
                rows.append((first[0], first[2], first[3], first[4], n, first[6] if revisit else total, first[5] if revisit else sha.hexdigest(), bool(good)))

        for batch in batches:
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 3, 4, 5, 6, 8)), strict=True)):
                payload = batch.column(7)[k].as_buffer()
                if not now or now[0][0] != row[0]:
                    close()
                    now = [row, row, 0, 0, hashlib.sha1(), row[1] == 0]
                elif row[1] >> 32 != now[1][1] >> 32:  # the next segment: the one before is complete, none is left out
                    now[5] = now[5] and bool(now[1][7]) and row[1] == (now[1][1] >> 32) + 1 << 32
                else:
                    now[5] = now[5] and row[1] == now[1][1] + 1
                now[4].update(payload)
                now[1:4] = row, now[2] + 1, now[3] + len(payload)
            if rows:
                yield _records(rows)
                rows = []
        close()
        if rows:
            yield _records(rows)

    columns = ("record_id", "chunk_no", "type", "url", "refers_to", "declared_digest", "declared_bytes", "payload", "complete")
    revisit, size, sha = F.col("type") == "revisit", F.length("payload").cast("long"), F.sha1("payload")
    fine = F.col("complete") & (revisit | (F.coalesce(F.col("declared_digest") == sha, F.lit(True)) & F.coalesce(F.col("declared_bytes") == size, F.lit(True))))
    single = table.where("not segmented").select(
        "record_id", "type", "url", "refers_to", F.lit(1).cast("long").alias("n_chunks"), F.when(revisit, F.col("declared_bytes")).otherwise(size).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(sha).alias("payload_digest"), F.coalesce(fine, F.lit(False)).alias("intact"),
    )
    dealt = table.where("segmented").select(*columns).repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    return single.unionByName(map_arrow(dealt, run, "record_id string, type string, url string, refers_to string, n_chunks long, payload_bytes long, payload_digest string, intact boolean"))


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 4 + [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    names = ["record_id", "type", "url", "refers_to", "n_chunks", "payload_bytes", "payload_digest", "intact"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc/{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = digests(read_archives(spark, path))
    page = lambda urn: F.regexp_extract(urn, r"^<urn:record:\d+:(-?\d*):", 1).try_cast("long")
    return records.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page(F.col("refers_to")).alias("refers_to"), "intact", "n_chunks")


#: The query in DuckDB SQL.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to, true AS intact, CAST(CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 1 ELSE greatest(1, ceil(payload_bytes / 1048576.0)) END AS BIGINT) AS n_chunks FROM f"""
