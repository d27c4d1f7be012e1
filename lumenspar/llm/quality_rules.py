"""Host-level quality rules, in DataFrame expressions only.

Rule failures of documents are added up by host, each host's failure rate is
shrunk by a beta prior fitted to all hosts, and the verdict on the host goes back
to its documents.

Defined results: a null or empty text has no words, lines or symbols and fails the
base rules; a null host is a host of its own; repeated rows each count and each
come back; an empty table gives an empty result. Input columns that are not named
in the call are not read, so clashing names cannot occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspar.work import materialize

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A host is refused from this shrunken failure rate on.
HOST_RATE = 0.5
#: Strength of the prior where hosts do not differ enough to fit one.
MAX_STRENGTH = 1000.0


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _repeat_words(words: Column, width: int) -> Column:
    """Number of words inside any ``width``-word window that the text has twice or more.

    Windows are compared by 64-bit hash. Texts without a repeated window, the usual
    case, stop after one distinct count; the others sort (hash, place) once.
    """

    def count(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def flagged(s: Column) -> Column:
            n = F.size(s)
            same = lambda i, j: F.element_at(s, i + 1)["h"] == F.element_at(s, j + 1)["h"]
            places = F.transform(
                s,
                lambda x, i: F.when(
                    F.when(i > 0, same(i, F.greatest(i - 1, F.lit(0)))).otherwise(False)
                    | F.when(i < n - 1, same(i, F.least(i + 1, n - 1))).otherwise(False),
                    x["i"],
                ),
            )
            return F.array_sort(F.array_compact(places))

        covered = F.aggregate(
            _let(pairs, flagged),
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
            lambda a, i: F.struct(
                (a["n"] + (i + width - F.greatest(a["end"], i))).cast("long").alias("n"),
                (i + width).cast("int").alias("end"),
            ),
            lambda a: a["n"],
        )
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered)

    def hashes(hashed: Column) -> Column:
        at = lambda i, k: F.element_at(hashed, i + k)
        places = F.sequence(F.lit(1), F.size(hashed) - (width - 1))
        return F.transform(places, lambda i: F.xxhash64(*[at(i, k) for k in range(width)]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < width + 1, F.lit(0).cast("long")).otherwise(_let(_let(hashed, hashes), count))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for the row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def document_metrics(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Rule inputs of each document: id, host, n_words and the four base counts. No shuffle."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"))
    base = base.select(
        "doc_id",
        "host",
        "text",
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        F.filter(F.split("text", "\n"), lambda line: F.translate(line, SPACES, "") != "").alias("lines"),
    )
    measured = _let(
        words_of(F.col("text")),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w, 5).alias("n_repeat_words")),
    )
    return base.select(
        "doc_id",
        "host",
        measured.alias("m"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    ).select(
        "doc_id",
        "host",
        "m.n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "m.n_repeat_words",
    )


def with_failures(metrics: DataFrame) -> DataFrame:
    """Adds base_failed, and failed: the base rules or many symbols for the letters."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    failed = base | (10 * F.col("n_symbols") > F.col("word_chars"))
    return metrics.withColumns({"base_failed": base, "failed": failed})


def host_rates(rated: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """Per host: n_docs, n_failed, rate shrunk by the beta prior of all hosts, host_failed.

    The prior's mean is the rate over all documents; its strength comes from the
    hosts' spread by moments (weighted by documents), so where hosts hardly differ
    they are drawn close to the mean. Map-side sums reduce a hot host to one row a task.
    """
    hosts = rated.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")
    )
    n, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    prior = hosts.agg(
        F.sum(n).alias("total"),
        F.sum(f).alias("failures"),
        F.sum(f * f / n).alias("squares"),
        F.sum(n * n).alias("sizes"),
        F.count(F.lit(1)).cast("double").alias("hosts"),
    )
    mean = F.col("failures") / F.col("total")
    within = mean * (1 - mean)
    spread = F.col("squares") - F.col("failures") * mean - (F.col("hosts") - 1) * within
    scale = F.col("total") - F.col("sizes") / F.col("total") - (F.col("hosts") - 1)
    variance = F.when(scale > 0, spread / F.when(scale > 0, scale))
    strength = F.when(
        (variance > 0) & (within > 0), F.least(F.greatest(within / F.when(variance > 0, variance) - 1, F.lit(1.0)), F.lit(MAX_STRENGTH))
    ).otherwise(F.lit(MAX_STRENGTH))
    # two numbers for all hosts
    fitted = prior.select(mean.alias("mean"), strength.alias("strength")).first()
    mean, strength = F.lit(float(fitted["mean"] or 0.0)), F.lit(float(fitted["strength"] or MAX_STRENGTH))
    rate = (f + mean * strength) / (n + strength)
    return hosts.select("host", "n_docs", "n_failed", rate.alias("rate"), (rate >= host_rate).alias("host_failed"))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_rate: float = HOST_RATE
) -> DataFrame:
    """Each document with its counts, base_failed, its host's shrunken rate and kept.

    Texts are scanned once; the narrow counts are written to the shared folder, then
    summed by host and joined to the verdicts. The join is left to the planner: few
    hosts are broadcast by their measured size, many are joined by shuffle, where a
    hot host is split. A null host joins its own row (null-safe).
    """
    rated = materialize(with_failures(document_metrics(docs, id_col, text_col, host_col)), "rules")
    hosts = host_rates(rated, host_rate).withColumnRenamed("host", "of_host")
    joined = rated.join(hosts, F.col("host").eqNullSafe(F.col("of_host")), "left")
    return joined.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed",
        "rate", "host_failed", (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: translate(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') <> '') AS lines
  FROM documents),
windows AS (SELECT doc_id, source, i, list_slice(w, i, i + 4) AS win FROM d, unnest(range(1, len(w) - 3)) AS u(i)),
twice AS (SELECT doc_id, win FROM windows GROUP BY doc_id, win HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, i + k AS place FROM windows JOIN twice USING (doc_id, win), unnest(range(0, 5)) AS o(k)),
hits AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id),
m AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words,
    length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN hits USING (doc_id)),
r AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > word_chars AS failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS f FROM r GROUP BY source),
p AS (SELECT sum(n) AS total, sum(f) AS failures, sum(f * f / n) AS squares, sum(n * n) AS sizes, count(*)::DOUBLE AS hosts FROM h),
v AS (
  SELECT failures / total AS mean, failures / total * (1 - failures / total) AS within,
    squares - failures * failures / total - (hosts - 1) * (failures / total * (1 - failures / total)) AS spread,
    total - sizes / total - (hosts - 1) AS scale FROM p),
s AS (
  SELECT mean, CASE WHEN scale > 0 AND spread > 0 AND within > 0
    THEN least(greatest(within / (spread / scale) - 1, 1), 1000) ELSE 1000 END AS strength FROM v),
k AS (SELECT source, (f + mean * strength) / (n + strength) >= 0.5 AS host_failed FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT host_failed AS kept
FROM r JOIN k ON r.source IS NOT DISTINCT FROM k.source
"""
