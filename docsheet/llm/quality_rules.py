"""Quality rules per document and per host, with DataFrame functions only.

Each document is measured once. Documents that fail a rule are counted per
host (the ``source`` column by default), the failure rates are shrunk with a
beta prior estimated from all hosts, and the verdicts on the hosts are joined
back to the documents.

Null and empty texts have no words and fail. A null host is a host of its own.
Repeated rows are measured one by one. Results travel in one struct column,
``quality``; a column of that name in the input is replaced, all others pass
through. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, let, materialise, unused

#: Hosts up to this number are broadcast (a row is under 200 bytes); beyond it the join shuffles.
BROADCAST_HOSTS = 20_000


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more: windows are compared by 64-bit hashes; only documents with any repeat are sorted."""
    windows = F.when(
        F.size(words) >= 3,
        F.transform(F.slice(words, F.lit(1), F.size(words) - 2), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda a, k, x: F.coalesce(F.get(a, k)["h"] == x["h"], F.lit(False))
        twice = let(ordered, lambda a: F.filter(a, lambda x, k: same(a, k - 1, x) | same(a, k + 1, x)))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        new = let(starts, lambda s: F.transform(s, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - x, F.lit(3)))))
        return F.aggregate(new, F.lit(0), lambda a, x: a + x)

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0)))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``quality``: n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed and soft (number of further rules failed)."""
    t = F.coalesce(F.col(text), F.lit(""))
    gone = lambda chars: F.length(F.translate(t, chars, ""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    raw = F.struct(
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("r"))).alias("w"),
        gone(SPACES).cast("long").alias("chars"),
        (F.length(t) - gone("#*$%&|<>")).cast("long").alias("symbols"),
        let(lines, lambda a: F.struct(F.size(a).cast("long").alias("n"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("d"))).alias("l"),
    )

    def judged(q: Column) -> Column:
        n, repeat = q["w"]["n"], q["w"]["r"]
        soft = (10 * q["symbols"] > n).cast("int") + (10 * q["l"]["d"] > 3 * q["l"]["n"]).cast("int") + ((q["chars"] < 2 * n) | (q["chars"] > 15 * n)).cast("int")
        return F.struct(
            n.alias("n_words"), q["chars"].alias("word_chars"), q["symbols"].alias("n_symbols"), q["l"]["d"].alias("n_dup_lines"), q["l"]["n"].alias("n_lines"), repeat.alias("n_repeat_words"),
            ((n < 50) | (100 * repeat > 50 * n)).alias("base_failed"), soft.alias("soft"),
        )

    return docs.withColumn("quality", let(raw, judged))


def host_verdicts(measured: DataFrame, host: str = "source", worst_rate: float = 0.8, watch: float = 2.0) -> DataFrame:
    """One row per host: host, n, failed, rate (shrunk), rejected and watched.

    The beta prior has the mean of all documents and the variance between hosts beyond what chance gives (method of
    moments); a host's rate is its posterior mean. Hosts over ``worst_rate`` are rejected, those over ``watch`` times the
    prior mean are watched. The prior is two numbers, so it may pass through the driver.
    """
    failed = F.col("quality.base_failed") | (F.col("quality.soft") > 0)
    hosts = materialise(measured.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(failed.cast("long")).alias("failed")))
    total = hosts.agg(F.count(F.lit(1)).alias("h"), F.sum("n").alias("n"), F.sum("failed").alias("f"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("ff")).first()
    n = total["n"] or 0
    mean = (total["f"] or 0) / n if n else 0.0
    spread = max(0.0, (total["ff"] or 0.0) / n - mean * mean - mean * (1 - mean) * (total["h"] - 1) / n) if n else 0.0
    strength = min(1e6, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1e6
    rate = (F.col("failed") + mean * strength) / (F.col("n") + strength)
    return hosts.withColumn("rate", rate).withColumn("rejected", rate > worst_rate).withColumn("watched", rate > watch * mean)


def judge(docs: DataFrame, text: str = "text", host: str = "source", carry_text: bool = True) -> DataFrame:
    """Adds ``quality`` with all measures and ``kept``: base rules passed, host not rejected, and fewer than two further rules failed (one, on a watched host).

    The measured rows are written once and read for both the host counts and the join; ``carry_text=False`` leaves the
    text out of them. The join broadcasts the hosts if they are few, else it shuffles and leaves hot hosts to adaptive skew splitting.
    """
    host_, verdict = unused(docs, "_host", "_verdict")
    measured = measure(docs, text)
    measured = materialise(measured if carry_text else measured.drop(text))
    hosts = host_verdicts(measured, host).select(F.col("host").alias(host_), F.struct("rate", "rejected", "watched").alias(verdict))
    few = hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    joined = measured.join(F.broadcast(hosts) if few else hosts, F.col(host).eqNullSafe(F.col(host_)), "left")
    found = F.col(verdict)
    limit = F.when(found["watched"], 1).otherwise(2)
    kept = ~F.col("quality.base_failed") & ~found["rejected"] & (F.col("quality.soft") < limit)
    return joined.withColumn("quality", F.col("quality").withField("host_rate", found["rate"]).withField("kept", kept)).drop(host_, verdict)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judge(docs, carry_text=False).select("doc_id", *[F.col(f"quality.{x}").alias(x) for x in names], F.round("quality.host_rate", 9).alias("host_rate"))


#: The query in DuckDB SQL.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, source, t, regexp_extract_all(t, '[^ \t-\r]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l FROM d),
g AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r),
m AS (SELECT w.r, doc_id, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
q AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(10 * n_symbols > n_words AS INT) + CAST(10 * n_dup_lines > 3 * n_lines AS INT) + CAST(word_chars < 2 * n_words OR word_chars > 15 * n_words AS INT) AS soft FROM m),
h AS (SELECT source, count(*) AS n, CAST(sum(CAST(base_failed OR soft > 0 AS INT)) AS DOUBLE) AS f FROM q GROUP BY source),
a AS (SELECT sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) - pow(sum(f) / sum(n), 2) - sum(f) / sum(n) * (1 - sum(f) / sum(n)) * (count(*) - 1) / sum(n) AS spread FROM h),
p AS (SELECT mean, CASE WHEN spread > 0 THEN least(1e6, greatest(1.0, mean * (1 - mean) / spread - 1)) ELSE 1e6 END AS strength FROM a),
v AS (SELECT source, mean, (f + mean * strength) / (n + strength) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.8 AND soft < CASE WHEN rate > 2 * mean THEN 1 ELSE 2 END AS kept, round(rate, 9) AS host_rate
FROM q JOIN v ON q.source IS NOT DISTINCT FROM v.source"""
