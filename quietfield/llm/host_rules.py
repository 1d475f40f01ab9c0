"""Quality rules with host-level verdicts.

Each document is measured by native expressions over its whole text and fails some of `RULES`. Failures of every rule are
summed by host. A rule's rates at all hosts have a beta prior, fitted by moments of the beta-binomial law: each host weighs
by its documents, and the variance that chance alone gives to rates of few documents is taken off. Rates are shrunk towards
it, so a small host needs much evidence and a large one speaks for itself. A host fails a rule if its shrunk rate lies more
than `DEVIATIONS` standard deviations of the prior above the mean, within `LIMITS`; a document is kept if it passes the base
rules itself and its host fails no rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, let, with_groups

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rules whose failures are summed by host; the first two are the base rules.
RULES = ("short", "repeats", "symbols", "dup_lines")
#: A host fails a rule beyond mean + DEVIATIONS * deviation of the prior, but never below the first limit and always above the second.
DEVIATIONS, LIMITS = 2.0, (0.25, 0.75)
#: The prior counts as so many documents at least, so one document never condemns a host.
MIN_STRENGTH = 5.0


def line_counts(text: Column) -> Column:
    """(n: lines with a word, dup: those that equal an earlier one)."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))


def n_repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, given its array of words.

    Windows are compared by 64-bit hashes sorted within the row: n log n steps for n words."""

    def windows(w: Column) -> Column:
        one = F.transform(w, lambda x: F.xxhash64(x))
        three = let(one, lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))))
        return F.slice(three, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))

    def again(h: Column) -> Column:
        """The hashes that occur more than once; with repeats but for the last of each."""
        return let(F.sort_array(h), lambda s: F.filter(s, lambda x, i: x == F.get(s, i + 1)))

    def starts(h: Column) -> Column:
        """Places of repeated windows, in order. Few different repeats are looked up, many are sorted."""
        few = lambda r: F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(r, x), i)), lambda x: x.isNotNull())
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        many = let(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), lambda x: x["at"])))
        return let(F.array_distinct(again(h)), lambda r: F.when(F.size(r) <= 16, few(r)).otherwise(many))

    def covered(at: Column) -> Column:
        begin = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last"))
        return F.aggregate(at, begin, step)["n"]

    return let(windows(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(starts(h)))).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: id, host, the measures of its whole text, base_failed, and a boolean for each of RULES. Null text has no words."""
    t = F.col("t")
    out = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    out = out.withColumn("w", F.regexp_extract_all(t, F.lit(f"({WORD})"), 1))
    out = out.select(
        "id", "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        line_counts(t).alias("lines"), n_repeat_words(F.col("w")).alias("n_repeat_words"),
    )
    out = out.withColumns({"n_dup_lines": F.col("lines.dup"), "short": F.col("n_words") < MIN_WORDS, "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")})
    out = out.withColumns({"symbols": 10 * F.col("n_symbols") > F.col("n_words"), "dup_lines": 10 * F.col("lines.dup") > 3 * F.col("lines.n"), "base_failed": F.col("short") | F.col("repeats")})
    return out.drop("lines")


def prior(hosts: DataFrame, rule: str) -> tuple[float, float]:
    """(mean, intraclass correlation) of a rule's beta prior over hosts (host_docs, host_<rule>); its strength is 1 / correlation - 1.

    At a correlation of 0 hosts do not differ beyond chance."""
    n, k = F.col("host_docs").cast("double"), F.col(f"host_{rule}").cast("double")
    r = hosts.agg(F.count("*").alias("hosts"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(n * n).alias("nn"), F.sum(k * k / n).alias("kk")).first()  # five numbers
    if not r.n or not 0 < r.k < r.n:
        return (r.k / r.n if r.n else 0.0), 0.0
    m = r.k / r.n
    spread = (r.kk - r.k * r.k / r.n) / (m * (1 - m)) - (r.hosts - 1)
    room = r.n - r.nn / r.n - (r.hosts - 1)
    return m, min(1.0, max(0.0, spread / room)) if room > 0 else 0.0


def host_rates(rows: DataFrame, rules: Sequence[str] = RULES) -> DataFrame:
    """(host, host_docs, host_<rule> and rate_<rule> for each rule, host_ok) of (host, boolean for each rule) rows, null hosts being one host."""
    hosts = cut(rows.groupBy("host").agg(F.count("*").alias("host_docs"), *[F.count_if(r).alias(f"host_{r}") for r in rules]))
    ok = F.lit(True)
    for r in rules:
        m, rho = prior(hosts, r)
        strength = max(1 / rho - 1, MIN_STRENGTH) if rho > 0 else None
        rate = F.lit(m) if strength is None else (F.col(f"host_{r}") + F.lit(m * strength)) / (F.col("host_docs") + F.lit(strength))
        hosts = hosts.withColumn(f"rate_{r}", rate)
        ok &= F.col(f"rate_{r}") <= min(max(m + DEVIATIONS * (m * (1 - m) * rho) ** 0.5, LIMITS[0]), LIMITS[1])
    return hosts.withColumn("host_ok", ok)


def host_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row of docs: id, host, the measures, the rules, base_failed, the host's counts and rates, host_ok and kept.

    Repeated rows count as rows, a null host is a host of its own, ties at a limit are kept, an empty table gives none."""
    rows = measures(docs, id_col, text_col, host_col).withColumns({"key": F.coalesce(F.concat(F.lit("h"), "host"), F.lit("")), "_n": F.monotonically_increasing_id()})
    rows = cut(rows)
    hosts = host_rates(rows.select(F.col("key").alias("host"), *RULES)).withColumnRenamed("host", "key")
    out = with_groups(rows, hosts, "key", ["_n"])
    return out.drop("key", "_n").withColumn("kept", ~F.col("base_failed") & F.col("host_ok")).withColumnRenamed("id", id_col)


def op2_host_rules(spark, sf_dir: str) -> DataFrame:
    """Per document: its measures, the base verdict and the verdict with its host's."""
    out = host_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_docs", *[f"host_{r}" for r in RULES])


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM x),
r AS (SELECT doc_id, count(DISTINCT i + k.k) AS n FROM y, (SELECT unnest([0, 1, 2]) AS k) k WHERE y.n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(l.lines, 0) AS lines, coalesce(r.n, 0) AS n_repeat_words
    FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id),
b AS (SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats, 10 * n_symbols > n_words AS symbols, 10 * n_dup_lines > 3 * lines AS dup_lines, short OR repeats AS base_failed FROM m),
h AS (SELECT source, count(*) AS host_docs, count_if(short)::BIGINT AS host_short, count_if(repeats)::BIGINT AS host_repeats, count_if(symbols)::BIGINT AS host_symbols, count_if(dup_lines)::BIGINT AS host_dup_lines FROM b GROUP BY source),
u AS (SELECT source, host_docs::DOUBLE AS n, unnest(['short', 'repeats', 'symbols', 'dup_lines']) AS rule, unnest([host_short, host_repeats, host_symbols, host_dup_lines])::DOUBLE AS k FROM h),
p AS (SELECT rule, count(*) AS hosts, sum(n) AS n, sum(k) AS k, sum(n * n) AS nn, sum(k * k / n) AS kk, sum(k) / sum(n) AS m FROM u GROUP BY rule),
q AS (SELECT rule, m, CASE WHEN m > 0 AND m < 1 AND n - nn / n - (hosts - 1) > 0 THEN least(1, greatest(0, ((kk - k * k / n) / (m * (1 - m)) - (hosts - 1)) / (n - nn / n - (hosts - 1)))) ELSE 0 END AS rho FROM p),
v AS (SELECT source, bool_and(CASE WHEN rho > 0 THEN (k + m * greatest(1 / rho - 1, 5)) / (n + greatest(1 / rho - 1, 5)) ELSE m END <= least(0.75, greatest(0.25, m + 2 * sqrt(m * (1 - m) * rho)))) AS host_ok FROM u JOIN q USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept, host_docs, host_short, host_repeats, host_symbols, host_dup_lines
FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
