"""Removal of repeated line runs, from the suffix groups that prefix doubling makes over line ids.

All documents' lines, one after another, are a text over line ids. Doubling names the
prefix of 2^k lines of every suffix: the names of its two halves make a pair, and all
suffixes with the same pair get one name, the first place where it stands. A name's group
is an interval of the suffix array whose longest common prefix is 2^k lines at least; a
group of one drops out, so each round works only on what still repeats, and the rounds end
with the longest repeat. The order between different names is never used and so not made.

Going back down, the intervals get their exact longest common prefixes. In a group of 2^k
lines only the first places of its parts at 2^(k+1) lines are left to tell apart; halving
steps split them by the names of ever shorter pieces that follow. A place that is not the
first of its part has found its longest earlier copy, so in the end every place has the
length of the longest run that begins there and stood earlier, and the first place of that
run. Runs that no longer run before them covers are maximal; these decide what goes.
DataFrame expressions only.

A later copy goes if its maximal run has ``min_lines`` lines or more, or ``min_chars``
characters or more in all; shorter runs recur by chance. Documents rank by id, so the copy
in the smallest id stays. Lines are known by 128 bits of hash.

Defined results: a null or empty text has no lines and stays as it is; blank lines take
no part and stay; trailing space does not tell lines apart; a run never crosses from one
document to the next; rows that repeat both id and text count as one document and are
treated alike; null ids rank first; an empty table gives an empty result. Other columns
pass through, but for ones named as those that are added (n_lines, n_deleted, n_runs,
longest_run, longest_source) or beginning with ``_line_``, which give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspar.work import compact

MIN_LINES = 3
MIN_CHARS = 50
SPACES = " \t\x0b\x0c\r"
ADDED = ("n_lines", "n_deleted", "n_runs", "longest_run", "longest_source")


def _keys(id_col: str, text_col: str) -> list[Column]:
    """Two hashes that name a document by id and text; equal rows have equal ones."""
    return [F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(text_col, F.lit(7), id_col).alias("k2")]


def _solid(text: Column) -> Column:
    """(t, line) of every line that is not blank: without trailing space, and its number."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(F.rtrim(x, F.lit(SPACES)).alias("t"), i.alias("line")))
    return F.filter(lines, lambda x: F.ltrim(x["t"], F.lit(SPACES)) != "")


def placed_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a line: its place in the order of all lines, the lines left in its document, id.

    Only hashes are sorted by document, not texts; documents of one id spread by hash.
    """
    ids = F.transform(_solid(F.col(text_col)), lambda x: F.struct(F.xxhash64(x["t"]).alias("h1"), F.xxhash64(x["t"], F.lit(7)).alias("h2")))
    rows = docs.select(F.col(id_col).alias("doc"), *_keys(id_col, text_col), ids.alias("lines")).where(F.size("lines") > 0)
    rows = compact(rows.dropDuplicates(["k1", "k2"]), "lines")
    ranked = rows.repartitionByRange(F.col("doc").asc_nulls_first(), "k1", "k2").sortWithinPartitions(F.col("doc").asc_nulls_first(), "k1", "k2")
    each = ranked.select("doc", "k1", "k2", F.size("lines").alias("n"), F.posexplode("lines").alias("at", "x"))
    placed = each.select(
        F.monotonically_increasing_id().alias("place"), (F.col("n") - F.col("at")).alias("left"), F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2"), "doc", "k1", "k2", "at"
    )
    return compact(placed, "places")


def _named(rows: DataFrame, *by: str) -> DataFrame:
    """(place, left, name) of the rows whose key repeats; the name is the key's first place.

    Counting is summed map-side first. The groups are written before they are joined back,
    so that the join reads plain tables and Spark splits a hot key.
    """
    groups = rows.groupBy(*by).agg(F.min("place").alias("name"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return compact(rows.join(compact(groups, "groups"), [*by]).select("place", "left", "name"), "names")


def doubled(level: DataFrame, half: int) -> DataFrame:
    """Names of prefixes of ``2 * half`` lines from those of ``half`` lines."""
    second = level.select((F.col("place") - half).alias("place"), F.col("name").alias("second"))
    pairs = level.where(F.col("left") > half).join(second, "place").select("place", "left", F.col("name").alias("first"), "second")
    return _named(pairs, "first", "second")


def _refined(active: DataFrame, level: DataFrame, half: int) -> DataFrame:
    """One halving step: rows (cur, head, place, left) of suffixes that share ``cur`` lines, split by ``half`` more.

    Parts of two or more go on with ``cur + half`` lines; the first places of all parts go
    on with ``cur``, as between them no more than a smaller piece is shared.
    """
    next_ = level.select((F.col("place")).alias("then"), F.col("name").alias("next"))
    ahead = active.withColumn("then", F.when(F.col("left") > F.col("cur"), F.col("place") + F.col("cur")))
    # who has no name ahead is a part of its own
    split = compact(ahead.join(next_, "then", "left").select("cur", "head", "place", "left", "next"), "ahead")
    parts = split.where("next is not null").groupBy("cur", "head", "next").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    known = split.join(compact(parts.where("n > 1"), "parts"), ["cur", "head", "next"], "left")
    longer = known.where("n > 1").select((F.col("cur") + half).alias("cur"), F.col("first").alias("head"), "place", "left")
    rest = known.where("n is null or first = place").select("cur", "head", "place", "left")
    return compact(longer.unionByName(rest), "active")


def earlier_copies(places: DataFrame) -> DataFrame:
    """(place, best, source): the longest run from each place that stood earlier, and its first place.

    Places whose line never stood before have no row.
    """
    levels = [_named(places.select("place", "left", "h1", "h2"), "h1", "h2")]
    while not levels[-1].isEmpty():
        levels.append(doubled(levels[-1], 2 ** (len(levels) - 1)))
    active = None
    for k in reversed(range(len(levels) - 1)):
        if active is not None:
            active = _refined(active, levels[k], 2**k)
        # the first places of the parts of each group of 2^k lines; if it has but one, nothing is left to tell
        first = levels[k].join(levels[k + 1].where("name <> place").select("place"), "place", "left_anti")
        apart = compact(first.where("place <> name").select("name").distinct(), "apart")
        group = first.join(apart, "name", "left_semi").select(F.lit(2**k).cast("long").alias("cur"), F.col("name").alias("head"), "place", "left")
        active = group if active is None else active.unionByName(group)
    if active is None:
        return places.select("place", F.lit(0).cast("long").alias("best"), F.col("place").alias("source")).limit(0)
    return compact(active.where("place <> head").select("place", F.col("cur").alias("best"), F.col("head").alias("source")), "copies")


def copied_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with lines that stood earlier: k1, k2 and its maximal runs in order.

    A run is (first, lines, source, source_first): the place of its first line among the
    document's lines that are not blank, its length, and id and place of the first copy.
    """
    places = placed_lines(docs, id_col, text_col)
    copies = earlier_copies(places)
    of = places.select(F.col("place").alias("source"), F.col("doc").alias("source_doc"), F.col("at").alias("source_at"))
    named = compact(copies.join(of, "source").select("place", "best", "source_doc", "source_at"), "sources")
    hit = places.select("place", "k1", "k2", "at").join(named, "place")
    run = F.struct(F.col("at").alias("first"), F.col("best").cast("int").alias("lines"), F.col("source_doc").alias("source"), F.col("source_at").alias("source_first"))
    runs = hit.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(run)).alias("x"))
    before = lambda i: F.get(F.col("x"), i - 1)
    covered = lambda r, i: (i > 0) & (before(i)["first"] + 1 == r["first"]) & (before(i)["lines"] > r["lines"])
    return runs.select("k1", "k2", F.filter("x", lambda r, i: ~covered(r, i)).alias("runs"))


def _union(runs: Column) -> Column:
    """(first, end) of the stretches that runs in order make together."""
    last = lambda found: F.element_at(found, -1)
    one = lambda first, end: F.array(F.struct(first.alias("first"), end.alias("end")))
    return F.aggregate(
        runs,
        F.expr("cast(array() as array<struct<first:int,end:int>>)"),
        lambda found, r: F.when(
            (F.size(found) > 0) & (last(found)["end"] >= r["first"]),
            F.concat(F.slice(found, 1, F.size(found) - 1), one(last(found)["first"], F.greatest(last(found)["end"], r["first"] + r["lines"]))),
        ).otherwise(F.concat(found, one(r["first"], r["first"] + r["lines"]))),
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with ``text`` less its later copies, plus n_lines, n_deleted, n_runs, longest_run and longest_source.

    n_runs counts the stretches deleted; longest_run and longest_source are length and
    source of the longest maximal run among them. Documents that lose nothing are untouched
    to the byte; others lose whole lines with their line ends.
    """
    runs = compact(copied_runs(docs, id_col, text_col), "runs").toDF("_line_k1", "_line_k2", "_line_runs")
    carried = [c for c in docs.columns if c not in ADDED and not c.startswith("_line_")]
    marked = docs.select(*carried, *[c.alias(f"_line_doc_{n}") for n, c in zip(("k1", "k2"), _keys(id_col, text_col), strict=True)])
    both = marked.join(runs, (F.col("_line_doc_k1") == F.col("_line_k1")) & (F.col("_line_doc_k2") == F.col("_line_k2")), "left")
    solid = F.when(F.col("_line_runs").isNotNull(), _solid(F.col(text_col)))
    both = both.withColumn("_line_solid", solid)
    chars = lambda r: F.aggregate(F.slice("_line_solid", r["first"] + 1, r["lines"]), F.lit(0), lambda n, x: n + F.length(x["t"]))
    both = both.withColumn("_line_runs", F.filter("_line_runs", lambda r: (r["lines"] >= min_lines) | (chars(r) >= min_chars)))
    both = both.withColumn("_line_gone", _union(F.col("_line_runs")))
    number = lambda i: F.get(F.col("_line_solid"), i)["line"]
    ranges = F.transform("_line_gone", lambda g: F.struct(number(g["first"]).alias("first"), number(g["end"] - 1).alias("last")))
    both = both.withColumn("_line_ranges", ranges)
    # blank lines within a range stay
    kept = F.filter(
        F.split(F.col(text_col), "\n", -1),
        lambda x, i: ~F.exists("_line_ranges", lambda g: (g["first"] <= i) & (i <= g["last"])) | (F.translate(x, SPACES, "") == ""),
    )
    cut = F.when(F.size("_line_gone") > 0, F.array_join(kept, "\n")).otherwise(F.col(text_col))
    n = F.size(F.filter(F.split(F.col(text_col), "\n", -1), lambda x: F.translate(x, SPACES, "") != ""))
    deleted = F.aggregate("_line_gone", F.lit(0), lambda k, g: k + g["end"] - g["first"])
    # of the longest, the first
    longest = F.element_at(F.array_sort(F.transform("_line_runs", lambda r: F.struct((-r["lines"]).alias("n"), r["first"].alias("first"), r["source"].alias("source")))), 1)
    longest = F.when(F.size("_line_runs") > 0, longest)
    return both.select(
        *[F.col(c) if c != text_col else cut.alias(c) for c in carried],
        F.when(F.col(text_col).isNull(), 0).otherwise(n).cast("long").alias("n_lines"), F.coalesce(deleted, F.lit(0)).cast("long").alias("n_deleted"),
        F.greatest(F.coalesce(F.size("_line_gone"), F.lit(0)), F.lit(0)).cast("long").alias("n_runs"),
        F.coalesce(-longest["n"], F.lit(0)).cast("long").alias("longest_run"), longest["source"].alias("longest_source"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_deleted", "n_runs", "longest_run", "longest_source", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


SQL = rf"""
WITH d AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS d FROM (SELECT DISTINCT doc_id, text FROM documents)),
ln AS (SELECT d, i, rtrim(string_split(text, chr(10))[i], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t, string_split(text, chr(10))[i] AS raw
  FROM d, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
p AS (SELECT *, row_number() OVER (ORDER BY d, i) AS p FROM ln WHERE ltrim(t, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
c AS (SELECT *, sum(length(t)) OVER (ORDER BY p) AS chars FROM p),
pair AS (SELECT a.p, b.p AS q, a.d AS da, b.d AS db FROM p a JOIN p b ON a.t = b.t AND b.p < a.p),
island AS (SELECT *, p - row_number() OVER (PARTITION BY da, db, p - q ORDER BY p) AS g FROM pair),
lcp AS (SELECT da, p, q, row_number() OVER (PARTITION BY da, db, p - q, g ORDER BY p DESC) AS n FROM island),
best AS (SELECT da AS d, p, max(n) AS n, min(q) FILTER (n = top) AS q FROM (SELECT *, max(n) OVER (PARTITION BY p) AS top FROM lcp) GROUP BY da, p),
maximal AS (SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.d = best.d AND b.p = best.p - 1 AND b.n = best.n + 1)),
run AS (
  SELECT m.*, s.d AS sd FROM maximal m JOIN c x ON x.p = m.p JOIN c y ON y.p = m.p + m.n - 1 JOIN p s ON s.p = m.q
  WHERE m.n >= {MIN_LINES} OR y.chars - x.chars + length(x.t) >= {MIN_CHARS}),
gone AS (SELECT DISTINCT d, p + k AS p FROM run, unnest(range(0, n)) AS u(k)),
line AS (SELECT ln.*, gone.p AS g FROM ln LEFT JOIN p USING (d, i) LEFT JOIN gone ON gone.p = p.p),
del AS (SELECT d, count(*) AS n_deleted, sum((NOT EXISTS (SELECT 1 FROM gone b WHERE b.d = gone.d AND b.p = gone.p - 1))::INT) AS n_runs FROM gone GROUP BY d),
long_ AS (SELECT d, n AS longest_run, sd FROM run QUALIFY row_number() OVER (PARTITION BY d ORDER BY n DESC, p) = 1),
kept AS (SELECT d, string_agg(raw, chr(10) ORDER BY i) FILTER (g IS NULL) AS t FROM line GROUP BY d),
n AS (SELECT d, count(*) AS n_lines FROM p GROUP BY d)
SELECT o.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted, coalesce(n_runs, 0)::BIGINT AS n_runs,
  coalesce(longest_run, 0)::BIGINT AS longest_run, src.doc_id AS longest_source, md5(coalesce(CASE WHEN n_deleted IS NULL THEN o.text ELSE kept.t END, '')) AS text_md5
FROM documents o LEFT JOIN d ON o.doc_id IS NOT DISTINCT FROM d.doc_id AND o.text IS NOT DISTINCT FROM d.text
LEFT JOIN n ON n.d = d.d LEFT JOIN del ON del.d = d.d LEFT JOIN long_ ON long_.d = d.d LEFT JOIN d src ON src.d = long_.sd LEFT JOIN kept ON kept.d = d.d
"""
