"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for the rest.

The n-grams are those of host and path, and those of their shapes, in which digits are alike, letters are alike and
a letter like the one before it is marked: so form tells (digits, hyphens, length, repeated letters, depth), whatever the words.
The weights are trained from a small labelled URL table and applied as a DataFrame expression. A null url, or one without ``://``, has an empty host and
path: no rule fits and the model sees no n-gram, so it is allowed. Repeated rows
are judged one by one; of rules that fit, the longest wins (rules are distinct, so
there are no ties). Results travel in one struct column, ``url_verdict``; a
column of that name is replaced, all others pass through.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, let

#: Fixed values: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: General words that labelled URLs are made of, those of unwanted pages (gambling, drugs, pornography, loans, pirated and harmful software, advertising) and those of others.
UNWANTED = "casino poker roulette blackjack jackpot slots betting bookmaker lottery bingo viagra cialis pharmacy pills steroids payday loans replica porn xxx escort nude webcam warez torrent crack keygen serials adserver banner popup affiliate clickbait spyware phishing".split()
WANTED = "news docs wiki forum shop store library science health sport music travel garden school university museum archive research weather recipes history city book photo street market theater engineering kitchen language mountain journal painting".split()
#: Parts of invented names, which stand for hosts without any known word.
ONSETS, VOWELS, CODAS = "b c d f g h k l m n p r s t v w br ch dr fl gr kl pr sh st th tr".split(), "a e i o u ai ea ei ie ou".split(), ["", "n", "r", "s", "t", "l", "ng", "nd", "st"]
BITS = 13
#: Urls over this probability are blocked.
THRESHOLD = 0.65
#: Factors of the code points of an n-gram in its hash.
FACTORS = (1, 131, 1371, 2917)


def drawn(text: str) -> int:
    """A number that looks drawn, the same for equal texts."""
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:4], "big")


def invented(k: int) -> str:
    """A pronounceable name of two to four syllables, the same for equal ``k``."""
    draw = lambda salt, options: options[drawn(f"{salt}:{k}") % len(options)]
    bare = draw("b", (0, 0, 0, 1))  # some are abbreviations, with a syllable without vowels
    return "".join(draw(f"o{j}", ONSETS) + ("" if bare and j == 0 else draw(f"v{j}", VOWELS)) + draw(f"c{j}", CODAS) for j in range(draw("n", (2, 3, 4))))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def labelled(rows: int = 6000, first: int = 0, unwanted=UNWANTED, wanted=WANTED) -> list[tuple[str, str, int]]:
    """The small labelled table: (host, path, 1 for unwanted), made by rule from the words above and invented names.

    Most unwanted hosts differ in form from others, too: numbers in and behind words, chains of hyphens, stretched letters, long
    compounds, deep paths of short tokens. One in six has none of that, and some wanted hosts have a year or a hyphen. ``first`` starts other draws.
    """
    out = []
    for k in range(first, first + rows):

        def pick(options, salt: int, k: int = k):
            return options[drawn(f"{salt}:{k}") % len(options)]

        bad = k % 2
        plain = lambda salt: invented(17 * k + salt) if pick((0, 1), salt + 40) else pick(wanted, salt)  # noqa: B023, E731
        a, b = (pick(unwanted, 1), pick((pick(unwanted, 2), plain(2)), 12)) if bad else (plain(1), plain(2))
        a, b = pick(((a, b), (b, a)), 13)
        stem = pick((f"{a}-{b}", f"{a}{b}", a if a in unwanted or not bad else b), 4)
        number = drawn(f"21:{k}")
        page = drawn(f"7:{k}") % 9973
        lang = pick(("en", "de", "fr", "es"), 9)
        path = pick(("/", "/{0}/{1}", "/{0}/{1}.html", "/{0}/{1}/", "/{0}/{2}/{1}"), 8).format(lang, page, plain(10))
        form = pick(("number", "hyphens", "stretched", "compound", "inside", "none"), 20) if bad else pick(("year", "none", "none", "none", "none", "none", "none", "none"), 20)
        if form == "number":
            stem = f"{stem}{number % 900 + 100}"
        elif form == "year":
            stem = f"{stem}{number % 30 + 1}"
        elif form == "hyphens":
            stem = "-".join((plain(22), a, b, plain(23))[number % 2 :])
        elif form == "stretched":
            at = number % len(stem)
            stem = stem[:at] + stem[at] * (3 + number % 3) + stem[at:]
        elif form == "compound":
            stem = a + b + plain(24) + str(number % 100)
        elif form == "inside":
            at = number % (len(stem) - 1) + 1
            stem = f"{stem[:at]}{number % 10}{stem[at:]}{number // 10 % 10}"
        if form not in ("none", "year") and pick((0, 1, 2), 25) == 0:
            path = "".join(f"/{chr(97 + (number >> s) % 26)}{(number >> s) % 1000}" for s in range(0, 20, 4))
        host = pick(("www.", "m.", "blog.", ""), 5) + stem + "." + pick(("example.com", "example.org", "example.net"), 6)
        out.append((host, path, bad))
    return out


def shape(text: str) -> str:
    """Digits as 0, letters as a, a letter like the one before it as =; other characters stay."""
    kinds = lambda c: "0" if "0" <= c <= "9" else "a" if "a" <= c.lower() <= "z" and c.isascii() else c
    return "".join("=" if kinds(c) == "a" and k and c == text[k - 1] else kinds(c) for k, c in enumerate(text))


def bucket(kind: int, gram: str) -> int:
    """Hash of an n-gram of the host (kind 0), the path (1) or their shapes (2 and 3) by its code points."""
    return (kind * 1777 + sum(ord(c) * f for c, f in zip(gram, FACTORS))) % (1 << BITS)


def _grams(host: str, path: str) -> list[int]:
    """Buckets of the 3- and 4-grams of host and path and of their shapes, with a mark at either end."""
    marked = f"^{host}$", f"^{path}$"
    return [bucket(kind, s[i : i + n]) for kind, s in enumerate((*marked, *map(shape, marked))) for n in (3, 4) for i in range(len(s) - n + 1)]


def train(table: list[tuple[str, str, int]], epochs: int = 10, rate: float = 2.0, decay: float = 1e-6) -> list[float]:
    """Weights of a logistic regression by stochastic gradients over the small labelled table; the last one is the intercept."""
    weights = [0.0] * ((1 << BITS) + 1)
    rows = [(_grams(h, p), y) for h, p, y in table]
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for grams, y in rows:
            scale = 1 / math.sqrt(max(1, len(grams)))
            z = weights[-1] + scale * sum(weights[g] for g in grams)
            error = y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            for g in grams:
                weights[g] += step * (scale * error - decay * weights[g])
            weights[-1] += 0.1 * step * error
    return [round(w, 6) for w in weights]


def score(weights: list[float], host: Column, path: Column) -> Column:
    """Probability that a url is unwanted; 0 without a host."""
    table = F.split(F.lit(" ".join(map(repr, weights))), " ").cast("array<double>")

    def shaped(codes: Column) -> Column:
        letter = lambda c: c.between(97, 122) | c.between(65, 90)
        return F.transform(codes, lambda c, i: F.when(c.between(48, 57), 48).when(letter(c), F.when((i > 0) & (c == F.get(codes, i - 1)), 61).otherwise(97)).otherwise(c))

    def grams(kind: int, text: Column) -> Column:
        def of(codes: Column, n: int, kind: int) -> Column:
            starts = F.when(F.size(codes) >= n, F.sequence(F.lit(0), F.size(codes) - n)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.get(table, F.pmod(sum((F.get(codes, i + k) * FACTORS[k] for k in range(n)), F.lit(kind * 1777)), F.lit(1 << BITS))))

        return let(F.transform(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: F.ascii(c)), lambda a: F.concat(of(a, 3, kind), of(a, 4, kind), let(shaped(a), lambda b: F.concat(of(b, 3, kind + 2), of(b, 4, kind + 2)))))

    every = F.concat(grams(0, host), grams(1, path))
    z = let(every, lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.sqrt(F.greatest(F.size(a), F.lit(1)))) + F.lit(weights[-1])
    return F.when(host == "", F.lit(0.0)).otherwise(1 / (1 + F.exp(-z)))


def judge(pages: DataFrame, weights: list[float], rules=RULES, threshold: float = THRESHOLD, url: str = "url") -> DataFrame:
    """Adds ``url_verdict``: host, path, rule, score (null where a rule decides) and verdict."""
    host, path = split_url(F.col(url))

    def ruled(u: Column) -> Column:
        best = F.lit(None).cast("string"), F.lit(None).cast("string")
        for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest comes last and wins
            fits = ((u["host"] == h) | u["host"].endswith("." + h)) & u["path"].startswith(p)
            best = F.when(fits, F.lit(h + p)).otherwise(best[0]), F.when(fits, F.lit(verdict)).otherwise(best[1])
        return F.struct(u["host"].alias("host"), u["path"].alias("path"), best[0].alias("rule"), best[1].alias("ruled"))

    def decided(u: Column) -> Column:
        p = F.when(u["rule"].isNull(), score(weights, u["host"], u["path"]))
        return let(p, lambda p: F.struct(u["host"].alias("host"), u["path"].alias("path"), u["rule"].alias("rule"), p.alias("score"), F.coalesce(u["ruled"], F.when(p > threshold, "block").otherwise("allow")).alias("verdict")))

    return pages.withColumn("url_verdict", let(let(F.struct(host.alias("host"), path.alias("path")), ruled), decided))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    v = F.col("url_verdict")
    return judge(pages, train(labelled())).select("page_id", *[v[c].alias(c) for c in ("host", "path", "rule", "verdict")], F.round(v["score"], 6).alias("score"))


def sql() -> str:
    """The query in DuckDB SQL, the trained weights as a literal list."""
    weights = "[" + ", ".join(map(repr, train(labelled()))) + "]::DOUBLE[]"
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
    first = lambda at: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[at]}'" for f in fits) + " END"
    of = lambda column, kind, n: f"list_transform(range(1, greatest(1, len({column}) - {n - 2})), lambda i: w[({kind * 1777} + {' + '.join(f'{column}[i + {k}] * {FACTORS[k]}' for k in range(n))}) % {1 << BITS} + 1])"
    shaped = lambda x: f"list_transform({x}, lambda c, i: CASE WHEN c BETWEEN 48 AND 57 THEN 48 WHEN c BETWEEN 97 AND 122 OR c BETWEEN 65 AND 90 THEN CASE WHEN i > 1 AND c = {x}[i - 1] THEN 61 ELSE 97 END ELSE c END)"
    lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
    cut AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{lower[0]}', '{lower[1]}') AS host, regexp_extract(r, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM rest),
    fit AS (SELECT *, {first(1)} AS rule, {first(2)} AS ruled, list_transform(string_split('^' || host || '$', ''), lambda c: CAST(unicode(c) AS BIGINT)) AS h, list_transform(string_split('^' || path || '$', ''), lambda c: CAST(unicode(c) AS BIGINT)) AS p, (SELECT {weights}) AS w FROM cut),
    shaped AS (SELECT *, {shaped('h')} AS sh, {shaped('p')} AS sp FROM fit),
    grams AS (SELECT *, {" || ".join(of(column, kind, n) for kind, column in enumerate(("h", "p", "sh", "sp")) for n in (3, 4))} AS g FROM shaped),
    scored AS (SELECT *, CASE WHEN rule IS NOT NULL THEN NULL WHEN host = '' THEN 0.0 ELSE 1 / (1 + exp(-(list_sum(g) / sqrt(greatest(len(g), 1)) + w[{(1 << BITS) + 1}]))) END AS s FROM grams)
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN s > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, round(s, 6) AS score FROM scored"""
