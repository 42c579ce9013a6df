"""Secret scans with DataFrame functions only.

Three fixed patterns give the base spans; character Markov models of random
strings and of ordinary identifiers, compared by their log-likelihood ratio,
add spans of kind ``markov``.

Null and empty texts have no spans. Repeated rows are judged one by one, ties
cannot arise (spans of one kind never overlap), other columns pass through
untouched, an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

#: Kind, pattern (Java), least characters of the value, quick test.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
#: What the models judge: unbroken runs of this alphabet.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

#: Ordinary words that identifiers are made of (fixed values, labelled 0).
WORDS = (
    "account action address array average backup batch block buffer build cache call change channel char check child class clear client clock code column command config connection "
    "content context copy counter create current data date default delete device document domain double download driver element enable entry error event example export factory field file filter "
    "first folder format frame function global group handle handler hash header height host identifier image import index input instance integer internal invalid item iterator label language last layer layout length "
    "level library limit line list listener local lock manager map match maximum memory menu message method minimum model module mouse name network next node number object offset option order output package page parameter "
    "parent password path pattern pointer position previous process profile program property protocol queue range record region remote report request resource response result return root schedule screen script search section "
    "selection server service session setting signal size source stack start state status stream string style symbol system table target task template test thread timer title total transaction type update upload user value variable vector version view visible width window worker"
).split()
#: Common longer words of German, French and Spanish without marks (fixed values, labelled 0).
FOREIGN = (
    "gesellschaft entwicklung wissenschaft geschwindigkeit verantwortung wirtschaft freundschaft beziehung unterricht entscheidung verhandlung zusammenarbeit bundesregierung krankenhaus arbeitsplatz schreibtisch nachrichten versicherung "
    "gouvernement environnement developpement connaissance entreprise maintenant aujourdhui quelquefois probablement heureusement appartement administration bibliotheque changement ensemble lumiere chateau nouveaux "
    "universidad conocimiento desarrollo gobierno trabajadores posiblemente ciudadanos responsabilidad naturaleza comunidad importante necesario pueblo escuela siguiente historia ayuntamiento felicidades"
).split()
#: Parts of pronounceable syllables, of which invented words are made (labelled 0).
ONSETS, VOWELS, CODAS = "b c d f g h k l m n p r s t v w br ch dr fl gr kl pr sch sh st th tr wh".split(), "a e i o u a e i o ai ea ei ie oi ou eu io ue".split(), ["", "", "n", "r", "s", "t", "l", "ng", "nd", "st", "ch", "nt", "rt", "x"]


def random_samples(spark: SparkSession, rows: int, first: int = 0) -> DataFrame:
    """``rows`` random strings (label 1) of 20 to 64 characters: hexadecimal in either case, base 64, base 64 for URLs, letters of either or of one case, small letters with digits."""
    digest = F.sha2(F.col("id").cast("string"), 512)
    b64 = F.base64(F.unhex(digest))
    letters = F.translate(b64, "0123456789+/=", "QxJzKvBwYfGhP")
    kinds = [digest, F.upper(digest), b64, F.translate(b64, "+/", "-_"), letters, F.lower(letters), F.upper(letters), F.translate(F.lower(b64), "+/=", "qjz")]
    body = F.get(F.array(*kinds), (F.col("id") % len(kinds)).cast("int"))
    size = (F.lit(20) + F.pmod(F.xxhash64("id"), F.lit(45))).cast("int")
    return spark.range(first, first + rows, 1, 4).select(F.substring(body, F.lit(1), size).alias("text"), F.lit(1).alias("label"))


def identifier_samples(spark: SparkSession, rows: int, first: int = 0) -> DataFrame:
    """``rows`` ordinary identifiers and run-on words (label 0): three words joined as snake, kebab, path, camel case or run together, and invented words of five to eight syllables, some with a short number."""

    def pick(words: list[str], salt: int) -> Column:
        return F.get(F.array(*map(F.lit, words)), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(words))).cast("int"))

    few = [F.transform(F.array(*[pick(WORDS, k) for k in range(3)]), f) for f in (lambda x: x, F.initcap, F.upper)]
    snake, camel, shout = few
    way = F.pmod(F.xxhash64("id", F.lit(99)), F.lit(10))
    tail = F.when(F.col("id") % 5 == 0, F.pmod(F.xxhash64("id", F.lit(98)), F.lit(100)).cast("string")).otherwise("")
    syllable = lambda k: F.concat(pick(ONSETS, 10 + 3 * k), pick(VOWELS, 11 + 3 * k), pick(CODAS, 12 + 3 * k))
    run = F.array_join(F.slice(F.array(*[syllable(k) for k in range(8)]), F.lit(1), (F.pmod(F.xxhash64("id", F.lit(97)), F.lit(4)) + 5).cast("int")), "")
    words = F.concat(pick(FOREIGN, 90), pick(FOREIGN, 91))
    text = (
        F.when(way == 0, F.array_join(snake, "_"))
        .when(way == 1, F.array_join(snake, "-"))
        .when(way == 2, F.array_join(snake, "/"))
        .when(way == 3, F.array_join(camel, ""))
        .when(way == 4, F.array_join(shout, "_"))
        .when(way == 5, F.upper(run))
        .when(way == 6, F.initcap(words))
        .when(way == 7, words)
        .when(way == 8, F.initcap(run))
        .otherwise(run)
    )
    return spark.range(first, first + rows, 1, 4).select(F.concat(text, tail).alias("text"), F.lit(0).alias("label"))


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios (natural log, random over ordinary) of each next character given the one before.

    ``samples`` holds (text, label): label 1 random, 0 ordinary. Position ``128 * before + next`` (ASCII codes) of the
    result. The counts are grouped in Spark; what reaches the driver is bounded by twice the square of the alphabet.
    """
    chars = F.split("text", "")
    pairs = F.explode(F.zip_with(F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0))), F.slice(chars, 2, F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b)))
    counts = {(r["label"], r["pair"]): r["n"] for r in samples.where("length(text) > 1").select("label", pairs.alias("pair")).where(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    ratios = [0.0] * (128 * 128)
    for a in ALPHABET:
        logs = []
        for label in (1, 0):
            row = [counts.get((label, a + b), 0) + smoothing for b in ALPHABET]
            logs.append([math.log(x / sum(row)) for x in row])
        for b, hot, plain in zip(ALPHABET, *logs, strict=True):
            ratios[128 * ord(a) + ord(b)] = hot - plain
    return ratios


def _spans(text: Column, pattern: str, kind: str, passes) -> Column:
    """All leftmost non-overlapping matches as structs of start, end (code points, end exclusive), rank of the kind and value, those that fail ``passes(match)`` dropped."""
    rank = KINDS.index(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(matches: Column) -> Column:
        def step(acc: Column, pair: Column) -> Column:
            start = acc["at"] + F.length(pair["gap"])
            end = start + F.length(pair["m"])
            one = F.struct(start.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), pair["m"].alias("value"))
            return F.struct(end.alias("at"), F.when(passes(pair["m"]), F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

        gaps = F.split(text, pattern, -1)
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,rank:int,value:string>>").alias("out"))
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
        return F.aggregate(pairs, zero, step, lambda acc: acc["out"])

    return let(found, lambda m: F.when(F.exists(m, passes), placed(m)))


def _score(ratios: list[float], token: Column) -> Column:
    """Mean log-likelihood ratio per character pair of an ASCII token."""
    table = F.split(F.lit(" ".join(map(repr, ratios))), " ").cast("array<double>")  # folded into one literal
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    sums = lambda c: F.aggregate(
        F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.get(table, a * 128 + b)), F.lit(0.0), lambda acc, x: acc + x
    )
    return let(codes, lambda c: sums(c) / (F.size(c) - 1))


def scan(docs: DataFrame, ratios: list[float], text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Adds ``secret_spans``: an array of (start, end, kind, value), sorted by start and kind.

    Markov spans are candidate runs of 20 characters and more whose mean log-likelihood ratio per character pair exceeds
    ``threshold``; those that overlap a base span are left out, so base spans stay as they are.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    assign = F.when(t.rlike(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"), _spans(t, ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6))
    access = F.when(t.contains("AKIA"), _spans(t, ACCESS, "access", lambda m: F.length(m) >= 20))
    # a run of 24 has no non-hexadecimal neighbours inside: the quick test and the full pattern agree on what passes
    hexes = F.when(t.rlike("[0-9a-f]{24}"), _spans(t, HEX, "hex", lambda m: F.length(m) >= 24))
    rare = lambda m: _score(ratios, m) > threshold
    marked = F.when(t.rlike(CANDIDATE), _spans(t, CANDIDATE, "markov", rare))
    none = F.array().cast("array<struct<start:int,end:int,rank:int,value:string>>")
    base = F.concat(*[F.coalesce(x, none) for x in (assign, access, hexes)])
    clear = lambda b, m: F.filter(m, lambda x: ~F.exists(b, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    both = let(F.struct(base.alias("b"), F.coalesce(marked, none).alias("m")), lambda s: F.concat(s["b"], clear(s["b"], s["m"])))
    kinds = F.array(*map(F.lit, KINDS))
    sorted_spans = let(both, lambda a: F.transform(F.array_sort(F.transform(a, lambda s: F.struct(s["start"], s["rank"], s["end"], s["value"]))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(kinds, s["rank"]).alias("kind"), s["value"].alias("value"))))
    return docs.withColumn("secret_spans", sorted_spans)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replaces each run of touching or overlapping spans of a scanned table by ``mark``; drops ``secret_spans``."""
    t = F.col(text)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.when(s["start"] > acc["at"], F.concat(F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).when((acc["at"] == 0) & (s["start"] == 0), F.lit(mark)).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    cleaned = F.aggregate("secret_spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    return docs.withColumn(text, F.when(F.size("secret_spans") > 0, cleaned).otherwise(t)).drop("secret_spans")


def default_model(spark: SparkSession, rows: int = 4000) -> list[float]:
    """The ratios trained on ``rows`` labelled samples of each class."""
    return train(random_samples(spark, rows).unionByName(identifier_samples(spark, rows)))


def digest(scanned: DataFrame) -> DataFrame:
    """The counted and joined form of a scanned table."""
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secret_spans", lambda s: s["kind"] != "markov")
    return scanned.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(scan(docs, default_model(spark)))


def sql(ratios: list[float], threshold: float = 0.3) -> str:
    """The query in DuckDB SQL, the trained ratios as a literal list."""
    table = "[" + ", ".join(map(repr, ratios)) + "]::DOUBLE[]"
    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"

    def spans(rank: int, pattern: str, quick: str, passes: str) -> str:
        """Leftmost matches with their places: what lies between them and they themselves, summed up."""
        return f"""SELECT r, {rank} AS k, a AS s, a + length(m) AS e, m FROM (SELECT r, m, sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
        FROM (SELECT r, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(g[1 : len(m)]) AS g FROM (SELECT r, regexp_extract_all(t, {quoted(pattern)}) AS m, string_split_regex(t, {quoted(pattern)}) AS g FROM d WHERE regexp_matches(t, {quoted(quick)})) WHERE len(m) > 0) WINDOW w AS (PARTITION BY r ORDER BY i)) WHERE {passes}"""

    score = "list_sum(list_transform(range(1, length(m)), lambda i: w[128 * unicode(m[i]) + unicode(m[i + 1]) + 1])) / (length(m) - 1)"
    base = [spans(0, ASSIGN, ASSIGN, f"length(regexp_extract(m, {quoted(ASSIGN)}, 1)) >= 6"), spans(1, ACCESS, "AKIA", "length(m) >= 20"), spans(2, HEX, "[0-9a-f]{24}", "length(m) >= 24")]
    shown = "string_agg(CASE k " + " ".join(f"WHEN {k} THEN '{kind}'" for k, kind in enumerate(KINDS)) + " END || ':' || s || ':' || e, ',' ORDER BY s, k)"
    return f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), ratios AS (SELECT {table} AS w),
    base AS MATERIALIZED ({" UNION ALL ".join(base)}),
    runs AS ({spans(3, CANDIDATE, CANDIDATE, "true")}),
    likely AS (SELECT r, k, s, e, m FROM runs, ratios WHERE {score} > {threshold}),
    every AS (SELECT r, k, s, e FROM base UNION ALL SELECT r, k, s, e FROM likely l WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = l.r AND b.s < l.e AND l.s < b.e)),
    summed AS (SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, {shown} FILTER (WHERE k < 3) AS b, {shown} AS a FROM every GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM d LEFT JOIN summed USING (r)"""
