"""Tokens, BM25 in five variants, and fusion with vector search."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyspark
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenspar.functions.vectors import let
from lumenspar.operators.search import first_of_rows
from lumenspar.operators.stems import STEMMERS
from lumenspar.work import materialize

METHODS = ("robertson", "lucene", "atire", "bm25l", "bm25plus")


@dataclass(frozen=True)
class LexicalConfig:
    method: str = "bm25plus"
    k1: float = 1.2
    b: float = 0.75
    delta: float = 0.5
    language: str | None = None
    ngrams: int = 1
    stem: bool = False
    pattern: str = "(?U)(\\w+)"


def tokens(text: Column, config: LexicalConfig = LexicalConfig()) -> Column:  # noqa: B008
    """Words in lower case, stemmed, then without stop words, then with n-grams."""
    out = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(config.pattern))
    if config.stem:
        out = stem(out, config.language or "english")
    if config.language:
        stop = stopwords(config.language)
        out = F.filter(out, lambda t: ~t.isin(*stop))
    return with_ngrams(out, config.ngrams) if config.ngrams > 1 else out


def with_ngrams(words: Column, n: int) -> Column:
    """The words, then their 2- to n-grams joined by an underscore."""

    def grams(w: Column, k: int) -> Column:
        none = F.expr("cast(array() as array<int>)")
        starts = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - (k - 1))).otherwise(none)
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, k), "_"))

    return let(lambda w: F.concat(w, *[grams(w, k) for k in range(2, n + 1)]), words)


_ALIASES = {
    "en": "english", "fr": "french", "de": "german", "es": "spanish", "it": "italian", "pt": "portuguese", "nl": "dutch", "da": "danish",
    "fi": "finnish", "hu": "hungarian", "no": "norwegian", "nb": "norwegian", "ru": "russian", "sv": "swedish", "tr": "turkish",
}


def stopwords(language: str) -> list[str]:
    """Stop words by language name or two-letter code, whatever the case; unknown ones have none.

    The lists are Spark's own, read from its library, so that no session is needed.
    """
    name = language.lower()
    name = _ALIASES.get(name, name)
    return _stopwords(name) if name in _ALIASES.values() else []


@cache
def _stopwords(name: str) -> list[str]:
    # pyspark may be imported from the archive that lies in Spark's python/lib
    homes = [*Path(pyspark.__file__).parents, *(Path(os.environ[x]) for x in ("SPARK_HOME",) if x in os.environ)]
    found = [jar for home in homes for jar in sorted(home.glob("jars/spark-mllib_*.jar"))]
    if found:
        with zipfile.ZipFile(found[0]) as jar:
            words = jar.read(f"org/apache/spark/ml/feature/stopwords/{name}.txt").decode().splitlines()
    else:
        from pyspark.ml.feature import StopWordsRemover

        words = StopWordsRemover.loadDefaultStopWords(name)
    return sorted({w.lower() for w in words if w})


def _porter(word: str) -> str:
    """English stem (Porter's first algorithm)."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    vowel = lambda w, i: w[i] in "aeiou" or (w[i] == "y" and i > 0 and not vowel(w, i - 1))
    has_vowel = lambda w: any(vowel(w, i) for i in range(len(w)))

    def measure(w: str) -> int:
        shape = "".join("v" if vowel(w, i) else "c" for i in range(len(w)))
        return sum(shape[i : i + 2] == "vc" for i in range(len(shape) - 1))

    double = lambda w: len(w) > 1 and w[-1] == w[-2] and not vowel(w, len(w) - 1)
    cvc = lambda w: len(w) > 2 and not vowel(w, len(w) - 3) and vowel(w, len(w) - 2) and not vowel(w, len(w) - 1) and w[-1] not in "wxy"
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    elif (w.endswith("ed") and has_vowel(w[:-2])) or (w.endswith("ing") and has_vowel(w[:-3])):
        w = w[:-2] if w.endswith("ed") else w[:-3]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif measure(w) == 1 and cvc(w):
            w += "e"
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for steps in (_STEP2, _STEP3):
        for old, new in steps:
            if w.endswith(old):
                w = w[: -len(old)] + new if measure(w[: -len(old)]) > 0 else w
                break
    for old in _STEP4:
        if w.endswith(old):
            base = w[: -len(old)]
            if measure(base) > 1 and (old != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"]


def stem(words: Column, language: str = "english") -> Column:
    """Stems of arrays of words of a language; words of one without a stemmer stay as they are."""
    name = _ALIASES.get(language.lower(), language.lower())
    one = _porter if name == "english" else STEMMERS.get(name)
    if one is None:
        return words

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def stems(words: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        return words.map(lambda ws: [known[w] if w in known else known.setdefault(w, one(w)) for w in ws], na_action="ignore")

    return stems(words)


#: Keys that begin so are the system's own (a fixed value).
RESERVED = "__hs_"


def document_text(metadata: Column, reserved: str = RESERVED) -> Column:
    """All values of a metadata map, but for reserved keys."""
    return F.array_join(F.map_values(F.map_filter(metadata, lambda k, _: ~k.startswith(reserved))), " ")


@dataclass(frozen=True)
class LexicalIndex:
    """postings(term, id, tf), lengths(id, dl) and df(term, df) of a set of documents."""

    postings: DataFrame
    lengths: DataFrame
    df: DataFrame
    words: DataFrame | None = None  # (id, dl, tokens) of an index of some terms


def build_index(docs: DataFrame, id_col: str, token_col: Column, terms: Sequence[str] | None = None) -> LexicalIndex:
    """The index of all terms, or of some: then only these have postings, and the texts are read once for all tables.

    Documents, not postings, are dealt by id, as these are fewer bytes; what one holds is then counted where it lies.
    """
    if terms is not None:
        kept = F.filter("tokens", lambda t: t.isin(*dict.fromkeys(terms)))
        words = docs.select(F.col(id_col).alias("id"), token_col.alias("tokens")).select("id", F.size("tokens").cast("long").alias("dl"), kept.alias("tokens"))
        words = materialize(words, "words")
    else:
        words = docs.repartition(id_col).select(F.col(id_col).alias("id"), token_col.alias("tokens"))
    lengths = words.select("id", "dl") if terms is not None else docs.select(F.col(id_col).alias("id"), F.size(token_col).cast("long").alias("dl"))
    # explode itself has Spark ask for the size first, and so tokenize twice
    each = words.select("id", F.explode_outer("tokens").alias("term")).where("term is not null")
    postings = each.groupBy("term", "id").agg(F.least(F.count(F.lit(1)), F.lit(65535)).alias("tf"))
    return LexicalIndex(postings, lengths, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), words if terms is not None else None)


def upsert(index: LexicalIndex, docs: DataFrame, id_col: str, token_col: Column) -> LexicalIndex:
    """The index with some documents put in or in the place of their older selves.

    Only the changed documents are tokenized; document frequencies move by what their
    postings take away and bring.
    """
    new = build_index(docs, id_col, token_col)
    ids = new.lengths.select("id")
    gone = index.postings.join(ids, "id", "left_semi")
    moved = index.df.select("term", "df").unionByName(gone.select("term", F.lit(-1).cast("long").alias("df"))).unionByName(new.postings.select("term", F.lit(1).cast("long").alias("df")))
    postings = index.postings.join(ids, "id", "left_anti").unionByName(new.postings)
    lengths = index.lengths.join(ids, "id", "left_anti").unionByName(new.lengths)
    return LexicalIndex(postings, lengths, moved.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0"))


def store_index(index: LexicalIndex, path: str) -> LexicalIndex:
    """Writes the index as tables, postings sorted by term, and returns it as it reads from there.

    Postings are made once: sorting them by range and counting the documents of a term read what is written.
    """
    spark = index.postings.sparkSession
    made = materialize(index.postings, "postings")
    made.repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    stored = spark.read.schema(made.schema).parquet(f"{path}/postings")
    stored.groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{path}/df")
    index.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> LexicalIndex:
    return LexicalIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "df")))


def corpus_stats(index: LexicalIndex) -> DataFrame:
    """One row: n documents and their mean length, at least 1."""
    return index.lengths.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def corpus_summary(docs: DataFrame, token_col: Column) -> DataFrame:
    """One row: n documents, their mean length, at least 1, and how many different terms they have; one pass over the texts."""
    counts = docs.select(F.explode_outer(token_col).alias("term")).where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    both = docs.agg(F.count(F.lit(1)).alias("n")).crossJoin(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.count(F.lit(1)).alias("terms")))
    return both.select("n", F.greatest(F.try_divide("all", "n").cast("double"), F.lit(1.0)).alias("avgdl"), "terms")


def idf(method: str, n: Column, df: Column) -> Column:
    return {
        "robertson": lambda: F.ln((n - df + 0.5) / (df + 0.5)),
        "lucene": lambda: F.ln(1 + (n - df + 0.5) / (df + 0.5)),
        "atire": lambda: F.ln(n / df),
        "bm25l": lambda: F.ln((n + 1.0) / (df + 0.5)),
        "bm25plus": lambda: F.ln((n + 1.0) / df),
    }[method]()


def term_score(method: str, tf: Column, dl: Column, avgdl: Column, k1: float, b: float, delta: float) -> Column:
    norm = (1 - b) + b * dl / avgdl
    return {
        "robertson": lambda: tf / (k1 * norm + tf),
        "lucene": lambda: tf / (k1 * norm + tf),
        "atire": lambda: tf * (k1 + 1) / (tf + k1 * norm),
        "bm25l": lambda: (k1 + 1) * (tf + delta) / (k1 + tf + delta),
        "bm25plus": lambda: (k1 + 1) * tf / (k1 * norm + tf) + delta,
    }[method]()


def bm25(index: LexicalIndex, terms: Sequence[str], config: LexicalConfig = LexicalConfig(), allowed: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """(id, score) summed over the distinct query terms; ``allowed(id)`` restricts the rows.

    Query terms are a literal filter that reaches the postings; statistics are one row.
    """
    wanted = list(dict.fromkeys(terms))
    rows = index.postings.where(F.col("term").isin(wanted))
    if allowed is not None:
        rows = rows.join(allowed.select("id"), "id", "left_semi")
    stats = corpus_stats(index).first()
    n, avgdl = F.lit(float(stats.n)), F.lit(float(stats.avgdl))
    found = rows.join(index.df.where(F.col("term").isin(wanted)), "term").join(index.lengths, "id")
    score = idf(config.method, n, F.col("df")) * term_score(config.method, F.col("tf"), F.col("dl"), avgdl, config.k1, config.b, config.delta)
    return found.groupBy("id").agg(F.sum(score).alias("score"))


def keyword_candidates(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "id").limit(max(3 * k, 200))


def _ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Ranks over a candidate list, which is short by construction."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rrf(vector_hits: DataFrame, keyword_hits: DataFrame, rrf_k: float = 60.0) -> DataFrame:
    """(id, score): reciprocal ranks added up over two candidate lists."""
    v = _ranked(vector_hits, F.col("distance"), F.col("id")).select("id", F.col("rank").alias("rv"))
    t = _ranked(keyword_hits, F.desc("score"), F.col("id")).select("id", F.col("rank").alias("rt"))
    part = lambda r: F.coalesce(1.0 / (rrf_k + F.col(r)), F.lit(0.0))
    return v.join(t, "id", "full").select("id", (part("rv") + part("rt")).alias("score"))


def weighted_fusion(vector_hits: DataFrame, keyword_hits: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(id, score): inverted min-max distance times alpha, and BM25 min-max times the rest."""
    alpha = min(max(alpha, 0.0), 1.0)
    w = Window.partitionBy()
    span = lambda c: F.greatest(F.max(c).over(w) - F.min(c).over(w), F.lit(1e-9))
    v = vector_hits.select("id", (1 - (F.col("distance") - F.min("distance").over(w)) / span("distance")).alias("v"))
    t = keyword_hits.select("id", ((F.col("score") - F.min("score").over(w)) / span("score")).alias("t"))
    return v.join(t, "id", "full").select("id", (alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("t", F.lit(0.0))).alias("score"))


def hybrid_search(
    vector_hits: DataFrame, index: LexicalIndex | None, terms: Sequence[str], k: int, fuse: Callable[[DataFrame, DataFrame], DataFrame] = rrf,
    config: LexicalConfig = LexicalConfig(),  # noqa: B008
) -> DataFrame:
    """(id, distance) with distance = 10 - fused score; without terms the vector hits alone."""
    near = vector_hits.orderBy("distance", "id").limit(max(10 * k, 100)).select("id", "distance")
    if not terms:
        return near.orderBy("distance", "id").limit(k)
    fused = fuse(near, keyword_candidates(bm25(index, terms, config), k))
    return fused.select("id", (10 - F.col("score")).alias("distance")).orderBy("distance", "id").limit(k)


def vocabulary(index: LexicalIndex) -> DataFrame:
    """(term, df, token_id): ids by falling frequency, then by term.

    Terms are sorted by range; a task's ids begin where those of the tasks before it end,
    which takes one row a task.
    """
    placed = materialize(index.df.orderBy(F.desc("df"), "term").select("term", "df", F.monotonically_increasing_id().alias("place")), "vocabulary")
    placed = placed.select("term", "df", F.shiftright("place", 33).alias("task"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("within"))
    before = F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy("task").agg(F.count(F.lit(1)).alias("n")).select("task", F.coalesce(before, F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "task").select("term", "df", (F.col("start") + F.col("within")).alias("token_id"))


#: Marks that part words in the benchmark's tokenizer (fixed values).
MARKS = ".,!?;:\"()[]{}<>-_/\\*&^%$#@`~+=|"


def benchmark_tokens(text: Column) -> Column:
    """Words of two characters or more between space and marks, without English stop words (apostrophes dropped)."""
    stop = sorted({w.replace("'", "") for w in stopwords("en")})
    words = F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKS, " " * len(MARKS)), "(?U)\\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stop))


def benchmark_scores(index: LexicalIndex, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, id, score) of queries(query_id, term); a term that a query has twice counts twice."""
    stats = corpus_stats(index).first()
    wanted = queries.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    found = wanted.join(index.df, "term").join(index.postings, "term").join(index.lengths, "id")
    weight = idf("lucene", F.lit(float(stats.n)), F.col("df")) * (k1 + 1)
    score = weight * F.col("times") * term_score("lucene", F.col("tf"), F.col("dl"), F.lit(float(stats.avgdl)), k1, b, 0.0)
    return found.groupBy("query_id", "id").agg(F.sum(score).alias("score"))


def benchmark_top(docs: DataFrame, id_col: str, token_col: Column, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, rank) of each query's k best documents, by ``benchmark_scores`` to 6 digits and id.

    The texts are read once; of each the terms that queries have are kept. Then a task scores its
    documents for all queries, some at a time, and keeps k a query, so that a pair of query and
    document is no row. Ids are keys. The queries' terms are on the driver.
    """
    wanted = queries.where(F.col("term").isNotNull()).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")).orderBy("term", "query_id").collect()
    spark = docs.sparkSession
    if not wanted:
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    terms = sorted({r.term for r in wanted})
    index = build_index(docs, id_col, token_col, terms)
    stats = corpus_stats(index).first()
    df = {r.term: r.df for r in index.words.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    weight = np.array([np.log(1 + (stats.n - df[t] + 0.5) / (df[t] + 0.5)) * (k1 + 1) if t in df else 0.0 for t in terms])
    ids = np.array(sorted({r.query_id for r in wanted}), np.int64)
    place = {t: i for i, t in enumerate(terms)}
    term, query = np.array([place[r.term] for r in wanted]), np.searchsorted(ids, [r.query_id for r in wanted])
    order = np.lexsort((query, term))
    run = _scores(terms, weight, term[order], query[order], np.array([r.times for r in wanted], float)[order], ids, float(stats.avgdl), k, k1, b)
    found = index.words.select(F.col("id").cast("long").alias("id"), "dl", "tokens").mapInArrow(run, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


#: Pairs of document and query that are scored at once.
SCORED = 1 << 20


def _scores(terms: list[str], weight: np.ndarray, term: np.ndarray, query: np.ndarray, times: np.ndarray, query_ids: np.ndarray, avgdl: float, k: int, k1: float, b: float) -> Callable:
    """The k best documents of a task for each query; ``term``, ``query`` and ``times`` are what queries have, in order of terms."""
    n, n_terms = len(query_ids), len(terms)
    start = np.searchsorted(term, np.arange(n_terms))
    many = np.searchsorted(term, np.arange(n_terms), "right") - start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, step = pa.array(terms), 64
        best_q, best_i, best_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        bars = np.zeros(n)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, step)
                at, step = at + step, max(1, SCORED // n)  # the first few set the bars
                ids, dl = some.column("id").to_numpy(), some.column("dl").to_numpy()
                doc = np.repeat(np.arange(len(ids)), pc.list_value_length(some.column("tokens")).to_numpy())
                key, tf = np.unique(doc * n_terms + pc.index_in(some.column("tokens").flatten(), names).to_numpy(), return_counts=True)
                d, t = np.divmod(key, n_terms)
                part = weight[t] * tf / (k1 * ((1 - b) + b * dl[d] / avgdl) + tf)
                each = np.repeat(np.arange(len(key)), many[t])
                of = np.repeat(start[t], many[t]) + np.arange(len(each)) - np.repeat(np.cumsum(many[t]) - many[t], many[t])
                total = np.bincount(d[each] * n + query[of], part[each] * times[of], len(ids) * n).reshape(-1, n)
                i, q = np.nonzero((total > 0) & (total >= bars - 2e-6))
                if not len(i):
                    continue
                best_q, best_i, best_s = np.concatenate((best_q, q)), np.concatenate((best_i, ids[i])), np.concatenate((best_s, total[i, q]))
                kept, rank = first_of_rows(best_q, -np.round(best_s, 6), best_i, k)
                best_q, best_i, best_s = best_q[kept], best_i[kept], best_s[kept]
                bars[best_q[rank == k - 1]] = best_s[rank == k - 1]
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[best_q]), pa.array(best_i), pa.array(best_s)], names=["query_id", "id", "score"])

    return run


def directed_fusion(vector_hits: DataFrame, text_hits: DataFrame, vector_weight: float = 0.85) -> DataFrame:
    """(query_id, id, score): min-max scores of both lists added up by weight.

    ``vector_hits(query_id, id, score, rank)`` are likenesses if the first hit's score is no
    smaller than the last's, else distances, which are turned round.
    """
    by = Window.partitionBy("query_id")
    low, high = F.min("score").over(by), F.max("score").over(by)
    part = (F.col("score") - low) / F.greatest(high - low, F.lit(1e-9))
    rising = F.min_by("score", "rank").over(by) >= F.max_by("score", "rank").over(by)
    v = vector_hits.select("query_id", "id", F.when(rising, part).otherwise(1 - part).alias("v"))
    t = text_hits.select("query_id", "id", part.alias("t"))
    both = v.join(t, ["query_id", "id"], "full")
    return both.select("query_id", "id", (vector_weight * F.coalesce("v", F.lit(0.0)) + (1 - vector_weight) * F.coalesce("t", F.lit(0.0))).alias("score"))
