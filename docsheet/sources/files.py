"""Scans of binary document files: header, kind and section table as columns of a ``binaryFile`` frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binary import uid_checksum, uint

#: Identifiers of file kinds, (kind, first, second, third); clip art has only the first.
KINDS = (("word", 0x10000037, 0x1000006D, 0x1000007F), ("texted", 0x10000037, 0x1000006D, 0x10000085), ("sketch", 0x10000037, 0x1000006D, 0x1000007D), ("sheet", 0x10000037, 0x1000006D, 0x10000088), ("mbm", 0x10000037, 0x10000042, 0))
CLIPART = 0x10000041


def scan(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and content of the files under ``path``; Spark leaves empty files out."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def headers(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds uid1 to uid4, checksum_ok and kind: that of a known header with a right checksum, ``clipart``, else ``unknown`` (``error`` for a wrong checksum or a short file)."""
    for k in range(4):
        files = files.withColumn(f"uid{k + 1}", uint(F.col(content), 4 * k, 4))
    ok = F.col("uid4") == uid_checksum(F.col("uid1"), F.col("uid2"), F.col("uid3"))
    kind = F.when(F.col("uid1") == CLIPART, "clipart").when(F.col("uid4").isNull() | ~ok, "error")
    for name, a, b, c in KINDS:
        third = (F.col("uid3") == c) if c else F.lit(True)
        kind = kind.when((F.col("uid1") == a) & (F.col("uid2") == b) & third, name)
    return files.withColumn("checksum_ok", ok).withColumn("kind", kind.otherwise("unknown"))


def sections(files: DataFrame, table_offset: Column, content: str = "content") -> DataFrame:
    """(path, ordinal, section_id, offset) of the section table at ``table_offset``: a byte with twice the number of entries, then pairs of 32-bit words; entries beyond the file's end are left out."""
    data = F.col(content)
    count = F.floor(uint(data, table_offset, 1) / 2).cast("int")
    entries = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(uint(data, table_offset + 1 + 8 * k, 4).alias("section_id"), uint(data, table_offset + 5 + 8 * k, 4).alias("offset")))
    return files.where(count > 0).select("path", F.posexplode(entries).alias("ordinal", "s")).select("path", "ordinal", "s.section_id", "s.offset").where("offset is not null")


def last_of_section(table: DataFrame, section_id: int) -> DataFrame:
    """(path, offset): of entries with the same id the last one counts."""
    return table.where(F.col("section_id") == section_id).groupBy("path").agg(F.max_by("offset", "ordinal").alias("offset"))


def subrange(data: Column, start: Column, length: Column) -> Column:
    """Part of a binary column; null if it doesn't lie inside."""
    return F.when((start >= 0) & (start + length <= F.length(data)), F.substring(data, (start + 1).cast("int"), length.cast("int")))


def application_is(name: Column, wanted: str) -> Column:
    """Whether an application's name is the wanted one, in either case."""
    return F.lower(name) == wanted.lower()


def jump_table(data: Column, offset: Column) -> Column:
    """The 32-bit offsets of a jump table: their number (32 bits) and then each; null if the file ends before."""
    count = uint(data, offset, 4)
    whole = (count >= 0) & (offset + 4 + 4 * count <= F.length(data))
    return F.when(whole & (count > 0), F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda k: uint(data, offset + 4 + 4 * k, 4))).when(whole, F.array().cast("array<bigint>"))


def status(files: DataFrame, table: DataFrame, password_section: int) -> DataFrame:
    """Adds ``status``: ``encrypted`` for files with a password section, ``error`` for those of kind error, else ``ok``."""
    locked = table.where(F.col("section_id") == password_section).select("path").distinct().withColumn("_locked", F.lit(True))
    kind = F.when(F.col("_locked"), "encrypted").when(F.col("kind") == "error", "error").otherwise("ok")
    return files.join(locked, "path", "left").withColumn("status", kind).drop("_locked")


#: Levels of messages (fixed values), the gravest first.
LEVELS = ("fatal", "error", "warn", "progress", "debug")


def messages(files: DataFrame, found: list[tuple[str, Column, Column, Column]], by: list[str], level: str = "warn") -> DataFrame:
    """Diagnostics as rows (by, level, offset, message) from (level, condition, offset, message), those of ``level`` and graver ones."""
    kept = [x for x in found if LEVELS.index(x[0]) <= LEVELS.index(level)]
    rows = F.array(*[F.when(condition, F.struct(F.lit(name).alias("level"), offset.cast("long").alias("offset"), message.alias("message"))) for name, condition, offset, message in kept])
    return files.select(*by, F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("_m")).select(*by, "_m.*")
