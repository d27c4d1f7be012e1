"""URL filter: host and path rules, and beyond them a character language-model ratio.

Two character models of variable order, one of accepted and one of rejected URLs, are
counted from URLs that the rules already decide. Each n-gram's probability interpolates
with the next shorter one (Witten-Bell); one that training did not see after its context
has the context's escape weight times the shorter one's probability. A URL's score is the
mean over its characters of the log ratio of the two models' probabilities; the threshold
is the one that separates held-out URLs best (mean of both classes' hit rates).
DataFrame expressions only.

Defined results: a null url or one without ``://`` has an empty host and path, no rule
fits it and it scores nought; without training URLs of both kinds all that no rule
decides is allowed; repeated rows and null ids each come back; an empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspar.work import materialize

RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: The SQL twin's bounds: different training URLs of each kind, about, and the characters of the
#: longest that serves. The query has none, so on tables beyond them the two may differ.
MAX_TRAIN, MAX_TRAIN_CHARS = 20_000, 2_000
ORDER = 4
#: Beyond so many n-grams (long URLs) the model is joined by shuffle, not broadcast.
MAX_BROADCAST_NGRAMS = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return (
        F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER),
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
    )


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null; a fixed, short list."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].find("/"))):
        at = rule.index("/")
        fits = F.concat(F.lit("."), host).endswith("." + rule[:at]) & path.startswith(rule[at:])
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _positions(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s)))


def _gram(s: Column, i: Column, k: int) -> Column:
    """The k characters that end at place i; null where they would begin before the text."""
    return F.when(i >= k, F.substr(s, i - (k - 1), F.lit(k)))


def train(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """n-grams with their log ratio ``delta``, from ``urls(s, accepted)``; grams of k characters have k = 1..order.

    ``escape`` is the log ratio of the escape weights of the gram as a context, null where
    it is none; the row of the empty gram, k = 0, has that of no context.
    """
    at = urls.select("s", "accepted", F.explode(_positions(F.col("s"))).alias("i"))
    grams = at.select("accepted", F.explode(F.array(*[_gram(F.col("s"), F.col("i"), k) for k in range(1, order + 1)])).alias("g"))
    counts = grams.where("g is not null").groupBy("g").agg(
        F.sum(F.col("accepted").cast("long")).alias("a"), F.sum((~F.col("accepted")).cast("long")).alias("r")
    )
    counts = materialize(
        counts.select("g", F.length("g").alias("k"), F.expr("left(g, length(g) - 1)").alias("ctx"), F.expr("right(g, length(g) - 1)").alias("suffix"), "a", "r"),
        "url-grams",
    )
    stats = counts.groupBy("k", "ctx").agg(
        *[F.sum(c).alias(f"n{c}") for c in "ar"], *[F.sum((F.col(c) > 0).cast("long")).alias(f"t{c}") for c in "ar"], F.count(F.lit(1)).alias("v")
    )
    both = counts.join(stats, ["k", "ctx"])
    smooth = lambda c, lower: F.when(
        F.col(f"n{c}") > 0, (F.col(c) + F.col(f"t{c}") * lower) / (F.col(f"n{c}") + F.col(f"t{c}"))
    ).otherwise(lower)
    base = 1.0 / (F.col("v") + 1)
    level = both.where("k = 1").select("g", "k", smooth("a", base).alias("pa"), smooth("r", base).alias("pr"))
    out = level
    for k in range(2, order + 1):
        lower = level.select(F.col("g").alias("suffix"), F.col("pa").alias("la"), F.col("pr").alias("lr"))
        level = both.where(F.col("k") == k).join(lower, "suffix").select(
            "g", "k", smooth("a", F.col("la")).alias("pa"), smooth("r", F.col("lr")).alias("pr")
        )
        out = out.unionByName(level)
    escape = lambda c: F.when(F.col(f"n{c}") > 0, F.ln(F.col(f"t{c}") / (F.col(f"n{c}") + F.col(f"t{c}")))).otherwise(0.0)
    contexts = stats.select(F.col("ctx").alias("g"), (escape("a") - escape("r")).alias("escape"))
    grams = out.select("g", "k", (F.ln("pa") - F.ln("pr")).alias("delta"))
    model = grams.join(contexts, "g", "full").select("g", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("delta", F.lit(0.0)).alias("delta"), "escape")
    return materialize(model, "url-model")


def score(rows: DataFrame, keys: list[str], model: DataFrame, order: int = ORDER) -> DataFrame:
    """``keys`` and score of each row of ``rows(*keys, s)``; a null s scores null.

    Characters meet the model by broadcast joins as long as its counted size allows
    that; the sums go to one row a URL before the only shuffle. The row number in the
    grouping keeps repeated rows apart.
    """
    broadcast = model.count() <= MAX_BROADCAST_NGRAMS
    sent = lambda part: F.broadcast(part) if broadcast else part
    no_context = model.where("k = 0").first()
    at = rows.select(F.monotonically_increasing_id().alias("row"), *keys, "s")
    at = at.select("*", F.explode_outer(_positions(F.col("s"))).alias("i"))
    value, escape = F.lit(0.0), F.lit(no_context.escape if no_context else 0.0)
    for k in range(1, order + 1):
        part = model.where(F.col("k") == k).select(F.col("g").alias(f"g{k}"), F.col("delta").alias(f"d{k}"))
        at = at.join(sent(part), _gram(F.col("s"), F.col("i"), k) == F.col(f"g{k}"), "left")
        # an unseen gram escapes to the next shorter one, if its context was seen
        value = F.coalesce(f"d{k}", value + F.coalesce(escape, F.lit(0.0)))
        if k < order:
            part = model.where((F.col("k") == k) & F.col("escape").isNotNull()).select(F.col("g").alias(f"c{k}"), F.col("escape").alias(f"e{k}"))
            at = at.join(sent(part), _gram(F.col("s"), F.col("i") - 1, k) == F.col(f"c{k}"), "left")
            escape = F.col(f"e{k}")
    return at.groupBy("row", *keys).agg(F.avg(F.when(F.col("i").isNotNull(), value)).alias("score")).drop("row")


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", order: int = ORDER
) -> DataFrame:
    """Each page's host, path, rule, score (null where a rule decides) and verdict.

    Every different URL that a rule decides trains, but for a hash fold of them, which all
    serve for the threshold; every URL is judged.
    """
    url = F.col(url_col).cast("string")
    host, path = host_and_path(url)
    parsed = pages.select(F.col(id_col).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    parsed = parsed.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).withColumn("s", F.concat("host", "path"))
    decided = parsed.where("found is not null and s != ''").select("s", (F.col("found.verdict") == "allow").alias("accepted"))
    decided = materialize(decided.distinct().withColumn("held", F.substring(F.md5("s"), 9, 1) < "4"), "url-decided")
    kinds = decided.select("accepted").distinct().count()
    keys = ["page_id", "host", "path", "found"]
    if kinds < 2:
        judged = parsed.select(*keys, F.lit(0.0).alias("score"))
        threshold = float("-inf")
    else:
        model = train(decided.where("not held"), order)
        threshold = calibrate(score(decided.where("held"), ["accepted"], model, order))
        judged = score(parsed.withColumn("s", F.when(F.col("found").isNull(), F.col("s"))), keys, model, order)
    verdict = F.when(F.coalesce("score", F.lit(0.0)) < threshold, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), "score", F.coalesce(F.col("found.verdict"), verdict).alias("verdict")
    )


def calibrate(held: DataFrame) -> float:
    """The score that separates held-out URLs best: the largest sum of both hit rates.

    Works on one row per distinct score rounded to four places, so few however many URLs there are.
    """
    by = held.groupBy(F.round("score", 4).alias("at")).agg(
        F.sum(F.col("accepted").cast("long")).alias("a"), F.sum((~F.col("accepted")).cast("long")).alias("r")
    )
    best = by.sparkSession.sql(
        """SELECT at FROM (
             SELECT at, sum(r) OVER (w) - r AS below, sum(a) OVER (w) - a AS lost, sum(a) OVER () AS na, sum(r) OVER () AS nr
             FROM {held} WINDOW w AS (ORDER BY at))
           ORDER BY below * na - lost * nr DESC, at LIMIT 1""",
        held=by,
    ).first()
    return float("-inf") if best is None else best.at


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    gram = lambda end, k: f"CASE WHEN {end} >= {k} THEN substr(s, {end} - {k - 1}, {k}) END" if k else f"CASE WHEN {end} >= 0 THEN '' END"
    joins = " ".join(
        f"LEFT JOIN counts c{k} ON c{k}.g = {gram('i', k)} LEFT JOIN stats x{k} ON x{k}.ctx = {gram('i - 1', k - 1)} AND x{k}.k = {k}" for k in range(1, ORDER + 1)
    )

    def chance(c: str) -> str:
        p = "(SELECT 1.0::DOUBLE / (count(*) + 1) FROM counts WHERE k = 1)"
        for k in range(1, ORDER + 1):
            p = f"CASE WHEN x{k}.n{c} > 0 THEN (coalesce(c{k}.{c}, 0) + x{k}.t{c} * {p}) / (x{k}.n{c} + x{k}.t{c}) ELSE {p} END"
        return p

    # the full probabilities of both models, for every character
    ratio = f"ln({chance('a')}) - ln({chance('r')})"
    cases = " ".join(
        f"WHEN ('.' || host) LIKE '%.{r[: r.index('/')]}' AND starts_with(path, '{r[r.index('/') :]}') THEN '{v} {r}'"
        for v, r in sorted(RULES, key=lambda r: (len(r[1]), r[1].find("/")), reverse=True)
    )
    return rf"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(x, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(x, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
parsed AS (SELECT row_number() OVER () AS row, page_id, host, path, host || path AS s, CASE {cases} END AS found FROM hp),
once AS (SELECT DISTINCT s, starts_with(found, 'allow') AS accepted FROM parsed WHERE found IS NOT NULL AND s <> '' AND length(s) <= {MAX_TRAIN_CHARS}),
decided AS (SELECT s, accepted, count(*) OVER (PARTITION BY accepted) AS n FROM once),
sample AS (SELECT s, accepted, substr(md5(s), 9, 1) < '4' AS held FROM decided WHERE ('0x' || substr(md5(s), 1, 8))::BIGINT * n < {MAX_TRAIN * 2**32}),
grams AS (
  SELECT accepted, substr(s, i - k + 1, k) AS g FROM sample, unnest(range(1, length(s) + 1)) AS u(i), unnest(range(1, {ORDER + 1})) AS o(k)
  WHERE NOT held AND i >= k),
counts AS (SELECT g, length(g) AS k, left(g, length(g) - 1) AS ctx, sum(accepted::INT)::DOUBLE AS a, sum((NOT accepted)::INT)::DOUBLE AS r FROM grams GROUP BY g),
stats AS (SELECT k, ctx, sum(a) AS na, sum(r) AS nr, sum((a > 0)::INT)::DOUBLE AS ta, sum((r > 0)::INT)::DOUBLE AS tr FROM counts GROUP BY k, ctx),
held AS (SELECT row_number() OVER () AS row, s, accepted FROM sample WHERE held),
hs AS (SELECT row, any_value(accepted) AS accepted, avg({ratio}) AS score FROM held, unnest(range(1, length(s) + 1)) AS u(i) {joins} GROUP BY row),
by_ AS (SELECT round(score, 4) AS score_at, sum(accepted::INT) AS a, sum((NOT accepted)::INT) AS r FROM hs GROUP BY 1),
cut AS (
  SELECT score_at FROM (SELECT score_at, sum(r) OVER (w) - r AS below, sum(a) OVER (w) - a AS lost, sum(a) OVER () AS na, sum(r) OVER () AS nr FROM by_ WINDOW w AS (ORDER BY score_at))
  ORDER BY below * na - lost * nr DESC, score_at LIMIT 1),
ps AS (SELECT row, avg({ratio}) AS score FROM parsed, unnest(range(1, length(s) + 1)) AS u(i) {joins} WHERE found IS NULL GROUP BY row)
SELECT page_id, host, path, split_part(found, ' ', 2) AS rule,
  coalesce(split_part(found, ' ', 1), CASE WHEN coalesce(score, 0) < (SELECT score_at FROM cut) THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed LEFT JOIN ps USING (row)
"""


SQL = _sql()
