"""Stages of the pipeline against what the operators say, on its own input each."""

import glob
import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from lumenspar.work import materialize, shared_dir
from tests.conftest import SF


def words(text, pattern):
    return re.findall(pattern, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (900, "", "en", "src1", 0), (901, None, "en", "src1", None)], docs.schema)
    docs = materialize(docs.unionByName(extra))
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "packing"]
    results = [docs]
    for _, stage in P.STAGES:
        results.append(materialize(stage(spark, results[-1], SF)))
    for r in results[:-1]:
        assert r.columns == docs.columns
    kept = [{r.doc_id: r.text for r in x.collect()} for x in results[:-1]]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i in kept[0] if i in labels and labels[i].quality == 1 and labels[i].toxic == 0]
    assert sum(i in kept[1] for i in good) >= 0.97 * len(good)
    # a line of 50 characters or more stands once in what the second stage leaves
    lines = [x.rstrip() for t in kept[2].values() for x in (t or "").split("\n") if len(x.rstrip()) >= 50]
    assert len(lines) == len(set(lines))
    gone = set(kept[1]) - set(kept[2])
    before = {x.rstrip() for i, t in kept[1].items() if i not in gone for x in (t or "").split("\n")}
    assert all(x.rstrip() in before or not x.strip() for i in gone for x in kept[1][i].split("\n"))
    # near duplicates by brute force: one of each component stays
    sets = {}
    for i, t in kept[2].items():
        w = words(t, r"[^\x20\x09-\x0D]+")
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets, key=lambda i: -1 if i is None else i)
    top = {i: i for i in ids}
    for n, i in enumerate(ids):
        for k in ids[:n]:
            both = len(sets[i] & sets[k])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[k]) - both):
                old = top[i]
                top = {x: top[k] if y == old else y for x, y in top.items()}
    assert len(kept[3]) == len(set(top.values()))
    # windows of eight words of a test item, or passages of two items, by brute force
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    items = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text, pattern)
        for k in range(max(1, len(w) - 7)):
            items.setdefault(tuple(w[k : k + 8]), set()).add(r.item_id)
    leaked = set()
    for i, t in kept[3].items():
        w = words(t, pattern)
        found = {x for m in {len(k) for k in items} for k in range(len(w) - m + 1) for x in items.get(tuple(w[k : k + m]), ())}
        if len(found) >= 2 or any(tuple(w[k : k + 8]) in items for k in range(len(w) - 7)):
            leaked.add(i)
    assert leaked
    assert set(kept[3]) - set(kept[4]) == leaked
    packed = {r.doc_id for r in results[5].select("doc_id").distinct().collect()}
    assert packed == set(kept[4])


def test_edges_of_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = materialize(docs.orderBy("doc_id").limit(60))
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (7, "another text of an id that is taken", "en", "s", 1)], docs.schema)
    extra = {c: F.lit(1) for c in ("k1", "_k1", "host", "path", "label", "node", "low", "n_lines", "place", "kept", "sequence_id")}
    more = materialize(some.unionByName(some).unionByName(odd).unionByName(odd).withColumns(extra))
    rows = lambda df: sorted(map(str, df.collect()))
    plain, many = some.unionByName(odd), more
    for name, stage in P.STAGES[:-1]:
        plain, many = materialize(stage(spark, plain, SF)), materialize(stage(spark, many, SF))
        assert many.columns == more.columns
        if name == "line_dedup":
            assert many.where("doc_id is null").count() > 0
    # one row of each document is left
    assert many.select("doc_id", "text").distinct().count() == many.count()
    assert P.packing(spark, many, SF).select("doc_id").distinct().count() == many.select("doc_id").distinct().count()
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF) if empty.columns == docs.columns else empty
        assert rows(empty) == []


def test_classifier_stage_keeps_what_the_operator_keeps(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    from lumenspar.llm.quality_classifier import classify

    kept = {r.doc_id for r in P.quality_classifier(spark, docs, SF).collect()}
    assert kept == {r.doc_id for r in classify(docs, labels).collect() if r.kept} and kept


def test_repeated_ids_are_told_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    same = docs.withColumn("doc_id", F.lit(7).cast("long"))
    left = P.without_benchmark(spark, same, SF)
    assert left.count() >= 50


def test_stages_write_few_files(spark):
    # each file is a process on a plain file system, so many small partitions must not be as many files
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for name in ("quality_classifier", "line_dedup"):
            stage = dict(P.STAGES)[name]
            made = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/lumenspar/*/*"))
            assert len(materialize(stage(spark, docs, SF)).inputFiles()) <= 4 * spark.sparkContext.defaultParallelism
            new = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/lumenspar/*/*")) - made
            assert new and all(len(glob.glob(f"{f}/part-*")) <= 4 * spark.sparkContext.defaultParallelism for f in new)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
