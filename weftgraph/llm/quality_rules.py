"""Operator 2: document rules and host-level verdicts, in DataFrame functions only.

A document's own rules come from its words, lines and repeats.  Hosts are
judged by how many of their documents fail: each host's rate is shrunk towards
a beta prior fitted to all hosts' rates by moments, so a host of few documents
needs more than a few failures.  The prior also says what is unusual: a host is
rejected when its shrunk rate lies ``HOST_SDS`` standard deviations of the
prior above the mean and is ``HOST_TIMES`` the mean, or over a fixed rate.  Host counts are combined before their
shuffle; verdicts go back to documents by an equi-join that Spark broadcasts
only when the written verdict table is under its size threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

WINDOW = 8
#: How far above the prior's mean a host's rate has to lie: in standard deviations of the prior, and as a multiple.
HOST_SDS = 3.0
HOST_TIMES = 2.0
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; none of a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), "")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more in the same text."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            same = lambda x, k: F.when((F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]), x["i"])
            return F.sort_array(F.array_compact(F.transform(p, same)))

        def total(at: Column) -> Column:
            spans = F.transform(at, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - x, F.lit(window))))
            return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x)

        return _let(_let(pairs, places), total)

    def windows(hashes: Column) -> Column:
        last = F.size(hashes) - window
        one = lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(window)))
        return F.transform(F.sequence(F.lit(0), last), one)

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(hashes))

    long_enough = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(windows(h), count))
    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(long_enough)


def measures(text: Column, words: Column) -> dict[str, Column]:
    """The counts that the rules use, all long."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(body, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def quality_rules(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    keep_cols: list[str] | None = None,
    min_words: int = 20,
    max_repeat_percent: int = 30,
    max_host_rate: float = 0.5,
) -> DataFrame:
    """Judge every document by its own rules and by its host.

    Returns one row per input row: ``row`` (a struct of ``keep_cols``, all
    columns if not given), ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``base_failed`` (fewer than
    ``min_words`` words, or more than ``max_repeat_percent`` % of them in
    repeated windows), ``host_rate`` (the shrunk share of the host's documents
    that fail), ``host_bound`` (the rate over which a host is rejected,
    ``max_host_rate`` at most), ``kept`` (neither the document nor its host is
    rejected).

    A null text has no words and fails; documents without a host form one host
    of their own; rows may repeat; columns of any name may be carried in
    ``row``; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "quality-rules")
    carried = F.struct(*(F.col(f"`{c}`") for c in (keep_cols or docs.columns))).alias("row")
    text = F.col(text_col).cast("string")
    worded = docs.select(carried, text.alias("text"), F.col(host_col).cast("string").alias("host"), words_of(text).alias("words"))
    counted = worded.select("row", "host", *(c.alias(n) for n, c in measures(F.col("text"), F.col("words")).items()))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    scored = scratch.keep(counted.withColumn("base_failed", failed), "scored")

    hosts = scored.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("bad"))
    hosts = scratch.keep(hosts, "hosts")
    rate = F.col("bad") / F.col("n")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("spread"))
    # Moments of a beta: the spread gives how many documents the prior counts for.
    weight = F.when(F.col("spread") > 0, F.least(F.greatest(F.col("mean") * (1 - F.col("mean")) / F.col("spread") - 1, F.lit(1.0)), F.lit(1e6))).otherwise(F.lit(1e6))
    prior = prior.select("mean", weight.alias("weight")).first()
    mean, strength = (prior["mean"] or 0.0), prior["weight"]
    shrunk = (F.col("bad") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    spread = (mean * (1 - mean) / (strength + 1)) ** 0.5
    bound = min(max_host_rate, max(mean + HOST_SDS * spread, HOST_TIMES * mean))
    verdicts = scratch.keep(hosts.select(F.col("host").alias("of"), shrunk.alias("host_rate")), "verdicts")
    judged = scored.join(verdicts, F.col("host").eqNullSafe(F.col("of")), "left")
    kept = ~F.col("base_failed") & (F.col("host_rate") <= bound)
    return judged.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", F.lit(bound).alias("host_bound"), kept.alias("kept"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, hash(list_slice(ws, i, i + 7))) AS c FROM p),
r AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM k WHERE c > 1),
s AS (SELECT doc_id, sum(n) AS n FROM r GROUP BY doc_id),
m AS (
  SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(s.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN s ON w.doc_id = s.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS bad FROM b GROUP BY source),
q AS (SELECT avg(bad / n) AS mean, coalesce(var_pop(bad / n), 0) AS spread FROM h),
z AS (SELECT mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 1.0), 1e6) ELSE 1e6 END AS weight FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (bad + mean * weight) / (h.n + weight)
    <= least(0.5, greatest(mean + 3 * sqrt(mean * (1 - mean) / (weight + 1)), 2 * mean)) AS kept
FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source CROSS JOIN z
"""
