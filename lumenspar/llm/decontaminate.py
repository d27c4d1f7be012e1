"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all windows of eight consecutive words of the test items; an item
of fewer words is one shorter window. For every pattern length there is a shift
table over blocks of two words that says how far the search may jump when a block
ends at a place, and buckets keyed by hashes of the patterns' ends; only where the
jump is nought are the patterns of a bucket, by last and first block, compared with the
document, word by word. A pattern is its place in the item's words, which are held once,
so the tables take some 40 bytes a character of the test texts.

Defined results: null or wordless texts have no words and no hits; items that are
null, wordless or without an id give no window; items with the same id count once;
equal windows of different items count for each; repeated documents each come back;
an empty benchmark leaves every document clean. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspar.work import compact

WINDOW = 8
#: Test texts are searched in blocks of so many characters; a block is what is broadcast.
BLOCK_CHARS = 4_000_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """A-Z in lower case, then runs of letters, digits and all that is not ASCII."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class WuManber:
    """Finds all occurrences of the windows of m words of the items' word lists.

    ``texts`` has (item, words); those of exactly m words may be shorter items.
    """

    def __init__(self, texts: list[tuple[str, list[bytes]]], m: int):
        self.texts, self.m = texts, m
        self.b = b = min(2, m)
        self.default = m - b + 1
        self.shift: dict = {}
        #: hash of first and last block -> the windows that have them, as (text, place of the first word)
        self.buckets: dict[int, list[tuple[int, int]]] = {}
        shift = self.shift
        for t, (_, w) in enumerate(texts):
            # a block's least distance to the end of a window, for each place in the text
            for at in range(b, len(w) + 1):
                block = (w[at - 2], w[at - 1]) if b == 2 else w[at - 1]
                # windows end from m to len(w); the nearest end that leaves the block inside
                jump = max(0, m - at)
                if shift.get(block, self.default) > jump:
                    shift[block] = jump
                if at >= m:
                    self.buckets.setdefault(hash((w[at - m], w[at - m + b - 1], block)), []).append((t, at - m))

    def find(self, text: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(place of the first word, items) of each occurrence, overlapping ones too."""
        m, b, shift, default, texts = self.m, self.b, self.shift.get, self.default, self.texts
        end, n, none = m - 1, len(text), ()
        while end < n:
            block = (text[end - 1], text[end]) if b == 2 else text[end]
            jump = shift(block, default)
            if jump:
                end += jump
                continue
            here = text[end - m + 1 : end + 1]
            selected = self.buckets.get(hash((here[0], here[b - 1], block)), none)
            owners = [texts[t][0] for t, at in selected if texts[t][1][at : at + m] == here]
            if owners:
                yield end - m + 1, owners
            end += 1


def windows(items: list[tuple[str, str]], window: int = WINDOW) -> list[WuManber]:
    """A searcher for each window length that the items have."""
    by_length: dict[int, list[tuple[str, list[bytes]]]] = {}
    known: dict[bytes, bytes] = {}
    for item, text in items:
        # equal words are one object
        if w := [known.setdefault(x, x) for x in words(text)]:
            by_length.setdefault(min(window, len(w)), []).append((item, w))
    return [WuManber(texts, m) for m, texts in sorted(by_length.items())]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of bounded size; the driver holds one block at a time."""
    block: list[tuple[str, str]] = []
    size = 0
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    for row in rows.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        if block and size + len(row.t) > block_chars:
            yield block
            block, size = [], 0
        block.append((row.i, row.t))
        size += len(row.t)
    yield block


_SPANS = "spans array<int>, items array<string>"


def _scan(items: Broadcast, window: int, key: list[str], only_hits: bool) -> Callable:
    """A pass over the documents: the key, n_words, spans that are hit and the items that hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = windows(items.value, window)
        for batch in batches:
            rows, n_words, spans, found = [], [], [], []
            for i, text in enumerate(batch.column("text")):
                w = words(text.as_py())
                hits, owners = [], set()
                for s in searchers:
                    for start, who in s.find(w):
                        hits.append((start, start + s.m))
                        owners.update(who)
                if hits or not only_hits:
                    rows.append(i)
                    n_words.append(len(w))
                    spans.append(_union(hits))
                    found.append(sorted(owners))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(rows, pa.int64())) for c in key), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))],
                names=[*key, "n_words", "spans", "items"],
            )

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans and items of several passes over a document as one."""
    for batch in batches:
        flat = [[(s[i], s[i + 1]) for s in x for i in range(0, len(s), 2)] for x in batch.column("all_spans").to_pylist()]
        found = [sorted({i for x in xs for i in x}) for xs in batch.column("all_items").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("k1"), batch.column("k2"), pa.array(map(_union, flat), pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))],
            names=["k1", "k2", "spans", "items"],
        )


def _union(spans: list[tuple[int, int]]) -> list[int]:
    """Half-open spans, merged and flattened: start, end, start, end ..."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("n_words"),
                pa.array([sum(s[1::2]) - sum(s[::2]) for s in spans], pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
                batch.column("spans"),
                batch.column("items"),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "spans", "items"],
        )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, min_items: int = 2, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, spans of hit words, items, contaminated.

    The documents are searched where they lie, without a shuffle. A benchmark beyond
    ``block_chars`` takes further passes, so that no task holds two blocks; each hands on
    the documents that it hits, without their texts, and these are put together by document.
    """
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = text.schema["doc_id"].dataType.simpleString()
    # what tells rows of an id apart; rows that are equal get equal results
    keyed = text.select("doc_id", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(7), "doc_id").alias("k2"), "text")
    first, more = None, []
    for block in blocks(benchmark, item_col, item_text_col, block_chars):
        shared = spark.sparkContext.broadcast(block)
        if first is None:
            first = shared
        else:
            scan = _scan(shared, window, ["k1", "k2"], True)
            more.append(compact(keyed.mapInArrow(scan, f"k1 long, k2 long, n_words long, {_SPANS}").distinct(), "hits"))
            shared.unpersist()
    if not more:
        out = text.mapInArrow(_scan(first, window, ["doc_id"], False), f"doc_id {kind}, n_words long, {_SPANS}")
    else:
        once = compact(keyed.mapInArrow(_scan(first, window, ["doc_id", "k1", "k2"], False), f"doc_id {kind}, k1 long, k2 long, n_words long, {_SPANS}"), "scanned")
        hits = once.where(F.size("items") > 0).select("k1", "k2", "spans", "items").distinct()
        for found in more:
            hits = hits.unionByName(found.select("k1", "k2", "spans", "items"))
        gathered = hits.groupBy("k1", "k2").agg(F.collect_list("spans").alias("all_spans"), F.collect_list("items").alias("all_items"))
        merged = compact(gathered.mapInArrow(_merged, f"k1 long, k2 long, {_SPANS}"), "merged")
        none = lambda c: F.coalesce(F.col(c), F.array().cast(merged.schema[c].dataType)).alias(c)
        out = once.select("doc_id", "k1", "k2", "n_words").join(merged, ["k1", "k2"], "left").select("doc_id", "n_words", none("spans"), none("items"))
    # after one pass the digests run in the same Python task as the search
    out = out.mapInArrow(_digests, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, {_SPANS}")
    return out.withColumn("contaminated", F.col("n_items") >= min_items)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_W = r"list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_W} AS w FROM benchmark WHERE item_id IS NOT NULL),
pat AS (
  SELECT DISTINCT item, least(8, len(w)) AS m, list_slice(w, i, i + least(8, len(w)) - 1) AS win
  FROM b, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
d AS (SELECT doc_id, {_W} AS w FROM documents),
sizes AS (SELECT DISTINCT m FROM pat),
occ AS (
  SELECT doc_id, i, m, list_slice(w, i, i + m - 1) AS win FROM d, sizes, unnest(range(1, len(w) - m + 2)) AS u(i)),
hit AS (SELECT doc_id, i, pat.m, item FROM occ JOIN pat ON occ.m = pat.m AND occ.win = pat.win),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(0, m)) AS u(k) GROUP BY doc_id),
g AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)
"""
