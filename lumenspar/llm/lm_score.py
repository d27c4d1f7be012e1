"""Stupid-backoff language-model scores of documents against the corpus's own counts.

Exploded n-grams travel in blocks. Documents lie in chunks; a chunk's distinct n-gram
hashes (orders 3, 2, 1 and 0, the number of words) with their counts are cut by hash into
buckets. Grouped by bucket, the blocks give the partition of the count table that holds
the bucket's n-grams, and joined to it each block gets the corpus counts of its own
n-grams; grouped by chunk, those meet the documents again and are summed per document.
An n-gram crosses the network once for a chunk, however often the chunk has it, and a hot
n-gram costs no more than a rare one.

A document is scored by what the others have: its own n-grams are taken off all counts.
S(w | u v) = c(uvw) / c(uv) where c(uvw) is not nought; else 0.4 times the same with (u) v
dropped, down to c(w) / c(), where a word that no other document has counts one half.

Defined results: null, empty or wordless texts have no words and a score of nought;
repeated rows and ids each come back, and each counts towards the others; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspar.llm.hashing import mix, slices, word_hashes
from lumenspar.work import materialize, remove, work_path

ORDER, BACKOFF, UNSEEN = 3, 0.4, 0.5
#: Bytes in a chunk at most, but for a longer document, which is a chunk of its own, and
#: n-grams in a bucket that one task holds at a time.
CHUNK_BYTES = 1 << 24
BUCKET_NGRAMS = 2_000_000
#: N-grams are known by 56 bits of hash: sorted differences then take some five bytes each.
#: Among 10^13 different n-grams one in 7,000 shares its count with another one.
_MASK = np.uint64(0xFFFFFFFFFFFFFF00)
_WORDS = np.uint64(0x5851F42D4C957F00)  # stands for the n-gram of no words


def _pack(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes; small differences and counts have empty planes."""
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)


def _delta(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=np.uint64(0))


def ngrams(texts: pa.ChunkedArray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """[hashes of the k-grams ending at each word, k = 1..order], each row's first word's place.

    Where a k-gram would begin before its document the hash is 0.
    """
    hashes, places = [], [np.zeros(1, np.int64)]
    for part in texts.chunks:
        for _, data, offsets in slices(part):
            h, p = word_hashes(data, offsets)
            hashes.append(h)
            places.append(p[1:] + places[-1][-1])
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    at = np.concatenate(places)
    inside = np.arange(len(words)) - np.repeat(at[:-1], np.diff(at))
    out = [mix(words + np.uint64(1))]
    for k in range(2, order + 1):
        longer = np.zeros_like(words)
        longer[1:] = mix(out[-1][:-1] * np.uint64(0xD1342543DE82EF95) + words[1:] + np.uint64(k))
        out.append(np.where(inside >= k - 1, longer, np.uint64(0)))
    return [g & _MASK for g in out], at


def _distinct(grams: list[np.ndarray], n_words: int) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate(grams)
    values, counts = np.unique(every[every != 0], return_counts=True)
    at = int(np.searchsorted(values, _WORDS))
    return np.insert(values, at, _WORDS), np.insert(counts, at, n_words)


def _cuts(values: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted hashes fall in, and where each begins, with the end.

    Buckets are equal ranges of hashes; work grows with the hashes, not with the buckets.
    """
    width = np.uint64(min(2**64 // n_buckets, 2**64 - 1))
    bucket = np.minimum(values // width, np.uint64(n_buckets - 1)).astype(np.int64)
    begins = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1))
    return bucket[begins], np.append(begins, len(values))


def _blocks(order: int, n_buckets: int) -> Callable:
    def run(chunk: pa.Table) -> pa.Table:
        grams, at = ngrams(chunk.column("text"), order)
        values, counts = _distinct(grams, int(at[-1]))
        buckets, cuts = _cuts(values, n_buckets)
        rows = [
            (b, _pack(_delta(values[i:j])), _pack(counts[i:j].astype(np.uint32)))
            for b, i, j in zip(buckets.tolist(), cuts[:-1], cuts[1:], strict=True)
        ]
        b, v, c = zip(*rows, strict=True)
        return pa.table({"bucket": pa.array(b, pa.int64()), "chunk": pa.array([chunk.column("chunk")[0].as_py()] * len(b), pa.int64()), "grams": pa.array(v, pa.binary()), "counts": pa.array(c, pa.binary())})

    return run


def _merge(blocks: pa.Table) -> pa.Table:
    """The corpus counts of each block's n-grams, in the block's order."""
    values = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in blocks.column("grams").to_pylist()]
    counts = [_unpack(x, np.uint32) for x in blocks.column("counts").to_pylist()]
    every, of = np.unique(np.concatenate(values), return_inverse=True)
    total = np.bincount(of, np.concatenate(counts), minlength=len(every)).astype(np.int64)
    ends = np.cumsum([len(v) for v in values])
    found = [_pack(total[part]) for part in np.split(of, ends[:-1])]
    return pa.table({"chunk": blocks.column("chunk"), "bucket": blocks.column("bucket"), "totals": pa.array(found, pa.binary())})


SCORE = "n_words long, n_order3 long, n_order2 long, n_order1 long, n_unseen long, log_score double"


def _own(grams: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How often each n-gram stands in its own document."""
    order = np.lexsort((grams, row))
    new = np.append(True, (grams[order][1:] != grams[order][:-1]) | (row[order][1:] != row[order][:-1]))
    begins = np.flatnonzero(new)
    out = np.empty(len(grams), np.int64)
    out[order] = np.repeat(np.diff(np.append(begins, len(grams))), np.diff(np.append(begins, len(grams))))
    return out


def _scores(order: int, n_buckets: int, backoff: float) -> Callable:
    def run(chunk: pa.Table, totals: pa.Table) -> pa.Table:
        grams, at = ngrams(chunk.column("text"), order)
        values, _ = _distinct(grams, int(at[-1]))
        by_bucket = dict(zip(totals.column("bucket").to_pylist(), totals.column("totals").to_pylist(), strict=True))
        total = np.concatenate([_unpack(by_bucket[b], np.int64) for b in sorted(by_bucket)])
        if len(total) != len(values):
            raise ValueError("a chunk met the counts of other documents")
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        # counts without the document's own
        others = lambda g: np.where(g != 0, total[np.searchsorted(values, g).clip(max=len(values) - 1)] - _own(g, row), 0)
        c = [others(g) for g in grams] if len(row) else [np.zeros(0, np.int64)] * order
        n_all = np.maximum(total[np.searchsorted(values, _WORDS)] - np.diff(at), 1)[row]
        level = np.where(c[0] > 0, 1, 0)
        log = np.log(np.maximum(c[0], UNSEEN) / n_all)
        for k in range(2, order + 1):
            before = np.append(1, c[k - 2][:-1]) if len(row) else np.zeros(0)
            known = (c[k - 1] > 0) & (grams[k - 1] != 0)
            log = np.where(known, np.log(np.maximum(c[k - 1], 1) / np.maximum(before, 1)), log + np.where(grams[k - 1] != 0, np.log(backoff), 0.0))
            level = np.where(known, k, level)
        sums = lambda x: np.bincount(row, x, minlength=len(at) - 1)
        out = {"doc_id": chunk.column("doc_id"), "n_words": pa.array(np.diff(at), pa.int64())}
        out |= {f"n_order{k}": pa.array(sums(level == k).astype(np.int64)) for k in (3, 2, 1)}
        return pa.table(out | {"n_unseen": pa.array(sums(level == 0).astype(np.int64)), "log_score": pa.array(sums(log))})

    return run


def _chunk(size: Column, chunk_bytes: int) -> Column:
    """A number for each row's chunk: rows of like length, as many as the bytes allow; the longest alone.

    Steps of 16 in length: shorter than 1/2048 of a chunk, 1/128, 1/8, or longer.
    """
    row, size = F.monotonically_increasing_id(), size.cast("long")
    out = row * 4 + 3
    for tag, bits in ((2, 3), (1, 7), (0, 11)):
        out = F.when(size * 2**bits <= chunk_bytes, F.shiftright(row, bits) * 4 + tag).otherwise(out)
    return out


def lm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Per document: doc_id, n_words, the words scored at each order or unseen, and log_score (natural log, summed).

    The chunks are written once, bucketed by chunk, so neither grouping by chunk nor the
    meeting with the counts moves a text; only blocks and counts are shuffled.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    letters = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # some 5.5 bytes a word, and an n-gram of each order a word at most
    n_buckets = max(1, -(-int(letters * order / 5.5) // BUCKET_NGRAMS))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"lumenspar_lm_{uuid.uuid4().hex}", work_path(spark, "chunks")
    chunked = narrow.select(_chunk(F.octet_length("text"), chunk_bytes).alias("chunk"), "doc_id", "text")
    chunked.write.bucketBy(parts, "chunk").sortBy("chunk").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    try:
        table = spark.table(name)
        blocks = table.groupBy("chunk").applyInArrow(_blocks(order, n_buckets), "bucket long, chunk long, grams binary, counts binary")
        totals = blocks.groupBy("bucket").applyInArrow(_merge, "chunk long, bucket long, totals binary")
        scores = table.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(_scores(order, n_buckets, backoff), f"doc_id {kind}, {SCORE}")
        return materialize(scores, "scores")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(spark, path)


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("log_score", F.round("log_score", 4))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT row, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS c FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
own AS (SELECT *, count(*) OVER (PARTITION BY row) AS k0, count(*) OVER (PARTITION BY row, a) AS k1, count(*) OVER (PARTITION BY row, b, a) AS k2, count(*) OVER (PARTITION BY row, c, b, a) AS k3 FROM p),
every AS (
  SELECT *, count(*) OVER () AS t0, count(*) OVER (PARTITION BY a) AS t1, count(*) OVER (PARTITION BY b, a) AS t2, count(*) OVER (PARTITION BY c, b, a) AS t3 FROM own),
n AS (
  SELECT row, i, b, c, greatest(t0 - k0, 1)::DOUBLE AS n0, (t1 - k1)::DOUBLE AS n1, CASE WHEN b IS NULL THEN 0 ELSE t2 - k2 END::DOUBLE AS n2,
    CASE WHEN c IS NULL THEN 0 ELSE t3 - k3 END::DOUBLE AS n3 FROM every),
x AS (SELECT *, lag(n1) OVER (PARTITION BY row ORDER BY i) AS x1, lag(n2) OVER (PARTITION BY row ORDER BY i) AS x2 FROM n),
s AS (
  SELECT row, CASE WHEN n3 > 0 THEN 3 WHEN n2 > 0 THEN 2 WHEN n1 > 0 THEN 1 ELSE 0 END AS level,
    CASE WHEN n3 > 0 THEN ln(n3 / x2)
         WHEN n2 > 0 THEN ln(n2 / x1) + CASE WHEN c IS NOT NULL THEN ln(0.4) ELSE 0 END
         ELSE ln(greatest(n1, 0.5) / n0) + CASE WHEN b IS NOT NULL THEN ln(0.4) ELSE 0 END + CASE WHEN c IS NOT NULL THEN ln(0.4) ELSE 0 END END AS x
  FROM x),
t AS (SELECT row, count(*) AS n, sum((level = 3)::INT) AS n3, sum((level = 2)::INT) AS n2, sum((level = 1)::INT) AS n1, sum((level = 0)::INT) AS n0, sum(x) AS x FROM s GROUP BY row)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(n3, 0)::BIGINT AS n_order3, coalesce(n2, 0)::BIGINT AS n_order2,
  coalesce(n1, 0)::BIGINT AS n_order1, coalesce(n0, 0)::BIGINT AS n_unseen, round(coalesce(x, 0), 4) AS log_score
FROM d LEFT JOIN t USING (row)
"""
