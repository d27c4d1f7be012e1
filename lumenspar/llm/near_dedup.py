"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A sketch of t coordinates is filled in rounds: in each of the first t rounds every
shingle falls into a hashed bin with a hashed value, in the next t rounds into one fixed
bin a round, so no coordinate stays empty; the smallest (round, value) stands, kept as
one byte. Two sets agree in a coordinate with the probability of their similarity (and in
one of 256 others), as tightly concentrated as with independent hashes, for about
t ln t + n hashes in all. Bands of coordinates bring candidates together; a link stands
only after the full sets are intersected.

Texts with equal sets are one class before any of this, so a group of copies, however
large, is one row. Of the smallest classes of its buckets, a class first meets the one
whose sketch agrees most. What shares a bucket and then still lies in different components
meets in blocks: sketches travel first, and full sets only of classes whose sketches agree
with one of another component. Pairs within a found group are never compared, a pair that
shares several buckets is met in the first, and only links leave a task.

Defined results: null, empty or wordless texts have the empty set, link with nothing and
stay; texts of fewer words than a shingle have one shingle; repeated rows and ids are
each returned, and a null id never names a component unless all ids in it are null;
an empty table gives an empty result. Other columns are not read.

With 48 bands of 6 a pair at the threshold of 0.8 is missed with a chance of
(1 - 0.8^6)^48 = 5e-7, less above it; its sketches agree less than five standard
deviations below the threshold with a chance of 3e-7.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspar.components import connected_components
from lumenspar.llm.hashing import mix, shingle_sets
from lumenspar.work import compact

BANDS, ROWS = 48, 6
#: A block of a bucket: so many shingles and so many rows at most, about.
BLOCK_SHINGLES, BLOCK_ROWS = 1_000_000, 1_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_32 = np.uint64(32)


def sketch(values: np.ndarray, t: int) -> np.ndarray:
    """The t coordinates of a non-empty set of 64-bit hashes."""
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    at, n = 0, len(values)
    while at < 2 * t:
        # several rounds at a time: a later one cannot change what an earlier one filled
        to = min(2 * t, at + max(1, 4096 // n))
        rounds = np.arange(at, to, dtype=np.uint64)
        h = mix(values[None, :] + (rounds * _GOLD)[:, None])
        bins = ((h >> _32) * np.uint64(t)) >> _32
        fixed = rounds >= t
        bins[fixed] = (rounds[fixed] - np.uint64(t))[:, None]
        np.minimum.at(out, bins.ravel().astype(np.int64), ((rounds << _32)[:, None] | (h & np.uint64(0xFFFFFFFF))).ravel())
        if out.max() != np.iinfo(np.uint64).max:
            break
        at = to
    return out


def agreement_needed(t: int, percent: int) -> int:
    """Equal coordinates of t below which a pair is taken to miss the threshold."""
    p = percent / 100
    return max(1, int(t * p - 5 * (t * p * (1 - p)) ** 0.5))


def _sketches(width: int, t: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls, sketches = [], [], []
            for _, values in shingle_sets(batch.column("text"), width):
                n.append(len(values))
                cls.append(xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None)
                sketches.append((mix(sketch(values, t)) >> np.uint64(56)).astype(np.uint8).tobytes() if len(values) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sketches, pa.binary())],
                names=["doc_id", "n_shingles", "cls", "sketch"],
            )

    return run


def _buckets(n_bands: int, n_rows: int) -> Column:
    """One bucket for each band of the sketch; its last byte is the band's number."""
    part = lambda k: F.xxhash64(k, F.substring(F.col("sketch"), k * n_rows + 1, F.lit(n_rows)))
    return F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda k: F.shiftleft(part(k), 8).bitwiseOR(k.cast("long")))


def _sets(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("cls").to_pylist()
            rows, sets = [], []
            for i, (_, values) in enumerate(shingle_sets(batch.column("text"), width)):
                # an id that stands on several texts fetches them all; the class tells which is meant
                if len(values) and xxhash.xxh3_128_digest(values.tobytes()) == wanted[i]:
                    rows.append(i)
                    sets.append(values.view(np.int64))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(rows)), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return run


def _fetched(nodes: DataFrame, wanted: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the wanted classes, from their texts; one exchange of texts.

    What is wanted grows with the data, so it is never broadcast to the texts.
    """
    wanted = nodes.join(wanted, "node", "left_semi").select("node", "rep", "cls")
    found = texts.join(wanted.hint("merge"), texts.doc_id.eqNullSafe(wanted.rep)).select("node", "cls", "text")
    return compact(found.mapInArrow(_sets(width), "node long, shingles array<long>").dropDuplicates(["node"]), "sets")


def _agreements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with the number of coordinates in which their sketches agree."""
    for batch in batches:
        x, y = (_matrix(batch.column(c)) for c in ("of_a", "of_b"))
        agree = (x == y).sum(axis=1) if batch.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(agree.astype(np.int32))], names=["a", "b", "agree"])


def _matrix(sketches: pa.Array) -> np.ndarray:
    rows = sketches.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


def _star_links(company: DataFrame, nodes: DataFrame, sets: DataFrame, needed: int, percent: int) -> DataFrame:
    """Links (a, b) of each class to that of its buckets' smallest classes that agrees most, if they are.

    One pair a class, so the sets that travel are no more than the classes; the full sets
    are intersected in the JVM. All other pairs are left to the blocks.
    """
    star = company.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    of_a, of_b = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"of_{c}")) for c in "ab")
    pairs = star.join(of_b, "b").join(of_a, "a").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    close = pairs.select("a", "b", "of_a", "of_b").mapInArrow(_agreements, "a long, b long, agree int").where(F.col("agree") >= needed)
    best = compact(close.groupBy("b").agg(F.min_by("a", F.struct(-F.col("agree"), "a")).alias("a")), "star")
    set_a, set_b = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    both = best.join(set_b, "b").join(set_a, "a")
    common, size = F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b")
    return both.where(common * 100 >= percent * (size - common)).select("a", "b")


def near_pairs(rows: list[dict], band: int, n_rows: int, needed: int, percent: int) -> list[tuple[int, int, int]]:
    """(agreement, i, k) of the rows of a block, of a bucket of ``band``, that are to be compared in full.

    Rows have a label, a part, n and a sketch; if there are two parts, they meet across.
    Pairs of one label, of too different sizes, of too little agreement, or that share a
    bucket of an earlier band are left out.
    """
    labels, parts, sizes = (np.array([r[c] for r in rows]) for c in ("label", "part", "n"))
    m = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(len(rows), -1)
    across = parts.min() != parts.max()
    out = []
    for i in range(len(rows) - 1):
        rest = slice(i + 1, None)
        other = (labels[rest] != labels[i]) & (100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i]))
        if across:
            other &= parts[rest] != parts[i]
        at = np.flatnonzero(other) + i + 1
        if not len(at):
            continue
        same = m[at] == m[i]
        agree = same.sum(axis=1)
        ok = agree >= needed
        if band:
            ok &= ~same[:, : band * n_rows].reshape(len(at), band, n_rows).all(axis=2).any(axis=1)
        out += [(int(g), i, int(k)) for g, k in zip(agree[ok], at[ok], strict=True)]
    return out


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[dict]]:
    """The rows of each (bucket, i, j), which come together."""
    key, held = None, []
    for batch in batches:
        for row in batch.select(columns).to_pylist():
            if (at := (row["bucket"], row["i"], row["j"])) != key:
                if held:
                    yield held
                key, held = at, []
            held.append(row)
    if held:
        yield held


def _screened(n_rows: int, needed: int, percent: int) -> Callable:
    """The rows of each block that have somebody to be compared with in full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["bucket", "i", "j", "node", "label", "part", "n", "sketch"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        for rows in _groups(batches, columns):
            if len(rows) > 1:
                pairs = near_pairs(rows, rows[0]["bucket"] & 255, n_rows, needed, percent)
                if wanted := sorted({x for _, i, k in pairs for x in (i, k)}):
                    yield pa.RecordBatch.from_arrays([pa.array([rows[i][c] for i in wanted], t) for c, t in zip(columns, kinds, strict=True)], names=columns)

    return run


def block_links(rows: list[dict], n_rows: int, needed: int, percent: int) -> list[tuple[int, int]]:
    """Links that join what is not joined yet among the rows of a block; sets are confirmed in full."""
    top = {r["label"]: r["label"] for r in rows}

    def of(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    sets = [np.asarray(r["shingles"]) for r in rows]
    out = []
    for _, i, k in sorted(near_pairs(rows, rows[0]["bucket"] & 255, n_rows, needed, percent), reverse=True):
        a, b = of(rows[i]["label"]), of(rows[k]["label"])
        if a != b:
            common = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
            if 100 * common >= percent * (len(sets[i]) + len(sets[k]) - common):
                top[a] = b
                out.append(tuple(sorted((rows[i]["node"], rows[k]["node"]))))
    return out


def _confirmed(n_rows: int, needed: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["bucket", "i", "j", "node", "label", "part", "n", "sketch", "shingles"]):
            if found := block_links(rows, n_rows, needed, percent):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return run


def _mixed_links(company: DataFrame, nodes: DataFrame, labels: DataFrame, sets: DataFrame, n_rows: int, needed: int, percent: int) -> DataFrame:
    """Links between classes that share a bucket and lie in different components so far.

    A bucket's commonest component need not meet itself: it is cut into blocks by hash, the
    rest of the bucket into others, and each pair of blocks of which one is of the rest is
    one bounded piece of work. So no task holds a whole bucket and no pair is a row.
    """
    labelled = company.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    labelled = compact(labelled.join(nodes.select("node", "n"), "node"), "labelled")
    each = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("size"))
    blocks = lambda rows, size: F.greatest(F.ceil(size / BLOCK_SHINGLES), F.ceil(rows / BLOCK_ROWS)).cast("int")
    most = F.max(F.struct("rows", "label", "size"))
    mixed = each.groupBy("bucket").agg(most.alias("most"), F.sum("rows").alias("rows"), F.sum("size").alias("size")).where("rows > most.rows")
    mixed = compact(
        mixed.select(
            "bucket", F.col("most.label").alias("common"), blocks(F.col("rows") - F.col("most.rows"), F.col("size") - F.col("most.size")).alias("few"),
            blocks(F.col("most.rows"), F.col("most.size")).alias("many"),
        ),
        "mixed",
    )
    part = F.when(F.col("label") == F.col("common"), F.col("few") + F.pmod(F.xxhash64("node"), F.col("many"))).otherwise(F.pmod(F.xxhash64("node"), F.col("few")))
    rows = labelled.join(mixed, "bucket").withColumn("part", part.cast("int"))
    # a block of the commonest component meets those of the rest only
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("part") < F.col("few"), F.col("few") + F.col("many")).otherwise(F.col("few")) - 1))
    pieces = rows.select("bucket", "node", "label", "n", "part", others.alias("other")).select(
        "bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "node", "label", "part", "n"
    )
    dealt = lambda df: df.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    schema = "bucket long, i int, j int, node long, label long, part int, n long, sketch binary"
    met = dealt(pieces.join(nodes.select("node", "sketch"), "node"))
    wanted = compact(met.mapInArrow(_screened(n_rows, needed, percent), schema), "screened")
    full = dealt(wanted.join(sets, "node"))
    return full.mapInArrow(_confirmed(n_rows, needed, percent), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, n_bands: int = BANDS, n_rows: int = ROWS
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id and kept."""
    needed = agreement_needed(n_bands * n_rows, percent)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    drawn = compact(texts.mapInArrow(_sketches(width, n_bands * n_rows), f"doc_id {kind}, n_shingles long, cls binary, sketch binary"), "sketches")
    classes = drawn.where("cls is not null").groupBy("cls").agg(
        F.min("n_shingles").alias("n"), F.min("doc_id").alias("rep"), F.min("sketch").alias("sketch")
    )
    nodes = compact(classes.select(F.monotonically_increasing_id().alias("node"), "*"), "classes")
    in_bucket = nodes.select("node", F.explode(_buckets(n_bands, n_rows)).alias("bucket"))
    shared = in_bucket.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # written first, so that the join back is a plain one, whose hot buckets Spark splits
    shared = compact(shared.select("bucket", "pivot"), "shared")
    company = compact(in_bucket.join(shared, "bucket"), "buckets")
    sets = _fetched(nodes, company.select("node").distinct(), texts, width)
    links = compact(_star_links(company, nodes, sets, needed, percent), "links")
    labels = compact(connected_components(links.toDF("src", "dst")), "labels")

    # what shares a bucket but no component yet has to meet as well
    late = _mixed_links(company, nodes, labels, sets, n_rows, needed, percent)
    links = links.unionByName(compact(late, "links"))
    labels = connected_components(links.toDF("src", "dst"))

    member = nodes.select("node", "cls", "rep").join(labels, "node", "left").select("cls", "rep", F.coalesce("label", "node").alias("label"))
    smallest = compact(member.groupBy("label").agg(F.min("rep").alias("component_id")), "components")
    verdict = compact(member.join(smallest, "label").select("cls", "component_id"), "verdicts")
    out = drawn.select("doc_id", "n_shingles", "cls").join(verdict, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


_W = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_W} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 1 THEN [[w[1]]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])) END AS g FROM d),
n AS (SELECT doc_id, len(g)::BIGINT AS n_shingles FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id
  WHERE 100 * i >= 80 * (na.n_shingles + nb.n_shingles - i)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""
