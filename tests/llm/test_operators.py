"""Operators against SQL, brute force, round trips and held-out labels."""

import io
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenspar.llm import hashing, line_dedup, lm_score, near_dedup, pack, quality_classifier, substring_dedup, warc
from lumenspar.llm.encode import encoder
from lumenspar.llm.queries import ORACLE, QUERIES
from lumenspar.work import work_path
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, duck, same, name):
    same(QUERIES[name](spark, SF), duck, ORACLE[name])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))


def test_word_hashes_tell_words_apart():
    texts = ["a b a", None, "", "B a\x0bÉ é", "ab ba aab aba", "x" * 5000 + " y"]
    seen = {}
    for _, data, offsets in hashing.slices(pa.array(texts)):
        h, at = hashing.word_hashes(data, offsets)
        for i, t in enumerate(texts):
            ws = words(t or "")
            assert at[i + 1] - at[i] == len(ws)
            for w, x in zip(ws, h[at[i] : at[i + 1]].tolist(), strict=True):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for shared, own in ((400, 50), (5, 1), (50, 50)):
        j = shared / (shared + 2 * own)
        a = near_dedup.sketch(np.sort(pool[: shared + own]), 288)
        b = near_dedup.sketch(np.sort(np.concatenate((pool[:shared], pool[2000 : 2000 + own]))), 288)
        assert abs((a == b).mean() - j) < 0.12
        assert a.max() < 2**64 - 1


def _components(n, links):
    top = list(range(n))
    for a, b in links:
        top = [top[a] if x == top[b] else x for x in top]
    return {frozenset(i for i in range(n) if top[i] == x) for x in top}


def test_near_links_in_blocks_match_brute_force():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**62, 60).astype(np.int64)
    sets = []
    for _ in range(40):
        keep = base[rng.random(60) > 0.1]
        sets.append(np.unique(np.concatenate((keep, rng.integers(0, 2**62, rng.integers(0, 8))))))
    want = set()
    for i in range(40):
        for k in range(i + 1, 40):
            n = len(np.intersect1d(sets[i], sets[k]))
            if 100 * n >= 80 * (len(sets[i]) + len(sets[k]) - n):
                want.add((i, k))
    needed = near_dedup.agreement_needed(288, 80)
    bytes_of = lambda s: (hashing.mix(near_dedup.sketch(s.view(np.uint64), 288)) >> np.uint64(56)).astype(np.uint8).tobytes()
    rows = [{"bucket": 0, "node": i, "label": i, "part": 0, "n": len(s), "sketch": bytes_of(s), "shingles": s} for i, s in enumerate(sets)]
    pairs = {(i, k) for _, i, k in near_dedup.near_pairs(rows, 0, 6, needed, 80)}
    assert want and want <= pairs
    # a pair that shares the bucket of an earlier band is met there
    later = {(i, k) for _, i, k in near_dedup.near_pairs(rows, 48, 6, needed, 80)}
    coordinates = [np.frombuffer(r["sketch"], np.uint8).reshape(48, 6) for r in rows]
    assert later == {(i, k) for i, k in pairs if not (coordinates[i] == coordinates[k]).all(axis=1).any()}
    assert _components(40, near_dedup.block_links(rows, 6, needed, 80)) == _components(40, want)
    parts = [r | {"part": i % 2} for i, r in enumerate(rows)]
    assert _components(40, near_dedup.block_links(parts, 6, needed, 80)) == _components(40, {(i, k) for i, k in want if i % 2 != k % 2})


def test_large_buckets_are_cut_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(60):
        w = list(base)
        for at in rng.integers(0, 200, rng.integers(0, 16)):
            w[at] = f"e{i}_{at}"
        texts.append((i, " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    whole = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, width=2).collect()}
    # a set of some 200 shingles is more than a block may hold, so each row is a block of its own
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 150)
    cut = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, width=2).collect()}
    sets = [set(zip(w, w[1:], strict=False)) for w in (t.split() for _, t in texts)]
    parent = list(range(60))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(60):
        for k in range(i):
            n = len(sets[i] & sets[k])
            if 100 * n >= 80 * (len(sets[i]) + len(sets[k]) - n):
                a, b = sorted((top(i), top(k)))
                parent[b] = a
    want = {i: top(i) for i in range(60)}
    assert whole == want and cut == want


def _spans(found):
    """Rows as pairs of (id, first word, end), in order of ids."""
    return {tuple(sorted(((r.source_doc_id, r.source_start, r.source_end), (r.doc_id, r.start_word, r.end_word)))) for r in found}


def test_passages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = substring_dedup.repeated_passages(docs).collect()
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    # every window of 50 words that stands in several documents joins them all
    where = {}
    for i in texts:
        for k in range(len(texts[i]) - 49):
            where.setdefault(tuple(texts[i][k : k + 50]), {}).setdefault(i, []).append(k)
    by = {}
    for r in found:
        by.setdefault(frozenset((r.doc_id, r.source_doc_id)), []).append(r)
    shared = 0
    for places in (p for p in where.values() if len(p) > 1):
        top = {i: i for i in places}
        for i in places:
            for j in places:
                inside = lambda r, x, s, e: any(getattr(r, s) <= k and k + 50 <= getattr(r, e) for k in places[x])  # noqa: E731, B023
                if i < j and any(
                    inside(r, r.doc_id, "start_word", "end_word") and inside(r, r.source_doc_id, "source_start", "source_end") for r in by.get(frozenset((i, j)), [])
                ):
                    top = {x: top[i] if t == top[j] else t for x, t in top.items()}
        assert len(set(top.values())) == 1
        shared += 1
    assert shared
    for r in found:
        a, b = texts[r.doc_id][r.start_word : r.end_word], texts[r.source_doc_id][r.source_start : r.source_end]
        assert min(len(a), len(b)) >= 50 and r.identity >= 0.8
        table = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for k, y in enumerate(b, 1):
                last, table[k] = table[k], last + 1 if x == y else max(table[k], table[k - 1])
        assert r.identity - 1e-9 <= table[-1] / max(len(a), len(b)) <= r.identity + 0.05


def _prose(n, tag):
    return [f"{tag}{i}" for i in range(n)]


def test_passages_whose_parts_occur_earlier_apart(spark):
    both = _prose(80, "p")
    one, two = both[:40], both[40:]
    parts = [("A", one), ("D", two), ("B", both), ("X", one), ("Y", two), ("C", both)]
    texts = [(i, " ".join((*_prose(30, f"l{x}"), *part, *_prose(30, f"r{x}")))) for i, (x, part) in enumerate(parts)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert _spans(substring_dedup.repeated_passages(docs).collect()) == {((2, 30, 110), (5, 30, 110))}


def test_passages_whose_halves_stand_elsewhere_are_all_found(spark):
    texts = []
    for g in range(60):
        run = _prose(98, f"g{g}_")
        for x, part in enumerate((run[:49], run[49:], run, run)):
            texts.append((4 * g + x, " ".join((*_prose(25, f"l{g}_{x}_"), *part, *_prose(25, f"r{g}_{x}_")))))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = _spans(substring_dedup.repeated_passages(docs).collect())
    assert found == {((4 * g + 2, 25, 123), (4 * g + 3, 25, 123)) for g in range(60)}
    again = substring_dedup.repeated_passages(docs.repartition(7)).collect()
    assert _spans(again) == found


@pytest.mark.parametrize("percent", [5, 10, 15])
def test_passages_with_edits_are_found(spark, percent):
    rng = np.random.default_rng(percent)
    texts = []
    for g in range(100):
        run = _prose(80, f"g{g}_")
        edited = list(run)
        for at in rng.choice(80, 80 * percent // 100, replace=False):
            edited[at] = f"e{g}_{at}"
        texts += [(2 * g, " ".join((*_prose(40, f"a{g}_"), *run))), (2 * g + 1, " ".join((*edited, *_prose(40, f"b{g}_"))))]
    found = substring_dedup.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    pairs = {frozenset((r.doc_id, r.source_doc_id)) for r in found}
    assert all(len(p) == 2 and min(p) // 2 == max(p) // 2 for p in pairs)
    assert len(pairs) >= {5: 99, 10: 95, 15: 90}[percent]


def test_passages_do_not_depend_on_the_layout(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    key = lambda df: sorted(map(str, df.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        dealt = key(substring_dedup.repeated_passages(docs.repartition(5)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert dealt == key(substring_dedup.repeated_passages(docs.coalesce(1)))


def test_passages_whose_seeds_stand_in_documents_between(spark):
    # 12 pairs of texts share 80 words but for every eleventh; a crowd of others, in runs of 20, holds the source's words
    lost = {}
    rows = []
    for n in range(12):
        source = [f"w{n}x{i}" for i in range(80)]
        copy = [f"e{n}x{i}" if i % 11 == 10 else w for i, w in enumerate(source)]
        rows += [(100 * n, " ".join(source)), (100 * n + 1, " ".join(copy))]
        rows += [(100 * n + 2 + k, f"z{n}x{k} " + " ".join(copy[at : at + 20])) for k, at in enumerate(at for at in range(0, 80, 10) for _ in range(8))]
        lost[n] = {100 * n, 100 * n + 1}
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), whole=True).collect()
    pairs = [{r.doc_id, r.source_doc_id} for r in found]
    assert all(x in pairs for x in lost.values())


def test_neighbours_across_batches_and_tasks():
    rng = np.random.default_rng(8)
    rows = sorted({(int(s), int(n), 2 * int(p)) for s, n, p in rng.integers(0, (6, 9, 500), (400, 3))})
    want, by = set(), {}
    for s, n, p in rows:
        by.setdefault(s, {}).setdefault(n, []).append(p)
    for nodes in by.values():
        last = None
        for n, places in sorted(nodes.items()):
            for i, p in enumerate(places):
                far = i and p - places[i - 1] >= 100
                if last and (i < len(last[1]) or far):
                    want.add((last[0], n, last[1][min(i, len(last[1]) - 1)] // 2, p // 2))
                if far:
                    want.add((n, n, places[i - 1] // 2, p // 2))
            last = (n, places)
    seed, node, place = (np.array(c) for c in zip(*rows, strict=True))
    a, b = substring_dedup.neighbours(seed, node, place, 50)
    assert {(int(node[i]), int(node[k]), int(place[i]) // 2, int(place[k]) // 2) for i, k in zip(a, b, strict=True)} == want
    for step in (1, 7, 50):
        batches = [
            pa.RecordBatch.from_arrays([pa.array(c[i : i + step], t) for c, t in zip((seed, node, place), (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["seed", "node", "place"])
            for i in range(0, len(rows), step)
        ]
        substring_dedup.TaskContext, real = type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}), substring_dedup.TaskContext
        try:
            out = [r for x in substring_dedup._matches(50)(iter(batches)) for r in x.to_pylist()]
        finally:
            substring_dedup.TaskContext = real
        found = [(r["a"], r["b"], r["pa"], r["pb"]) for r in out if r["edge"] is None]
        assert len(found) == len(set(found)) and set(found) == want
        assert sorted(r["pb"] for r in out if r["edge"]) == [0, 1]


def test_chains_use_gap_costs():
    anchors = [(0, 5, 0, 5, 7), (10, 15, 10, 15, 7), (20, 26, 20, 26, 7), (30, 36, 30, 36, 7), (500, 40, 500, 40, 7), (510, 50, 510, 50, 7)]
    assert substring_dedup.chains(anchors)[0] == [0, 1, 2, 3]
    assert sorted(map(len, substring_dedup.chains(anchors))) == [2, 4]


def _candidates(*texts):
    """Passages of the second text that also stand in the first."""
    w = [x for t in texts for x in substring_dedup._all_words(pa.array([t]))]
    first = np.cumsum([0, *map(len, w)])
    both = [substring_dedup.seeds(np.concatenate(w), first, *kind) for kind in (substring_dedup.SHORT, substring_dedup.LONG)]
    rows = sorted((int(s), int(d), 2 * int(p) + is_long) for is_long, x in enumerate(both) for d, s, p in zip(*x, strict=True))
    seed, node, place = (np.array(c) for c in zip(*((s, d, p) for s, d, p in rows), strict=True))
    a, b = substring_dedup.neighbours(seed, node, place, 50)
    a, b = (x[node[a] != node[b]] for x in (a, b))
    anchors, _ = substring_dedup.anchored(node[a], node[b], place[a] >> 1, place[b] >> 1, (place[a] & 1) > 0)
    return [p[:4] for parts in substring_dedup.candidates(anchors, 14) for p in substring_dedup.passages(*w, parts, 50, 0.8, False)]


def test_passages_far_apart_are_all_found():
    one, two = _prose(150, "p"), _prose(80, "q")
    a, b = " ".join((*one, *_prose(120, "x"), *two)), " ".join((*_prose(30, "y"), *one, *_prose(90, "z"), *two))
    assert sorted(_candidates(a, b)) == [(0, 150, 30, 180), (270, 350, 270, 350)]


def test_chains_of_little_identity_give_their_good_parts():
    one, two = _prose(60, "p"), _prose(60, "q")
    # as a whole 120 of 165 words agree
    assert sorted(_candidates(" ".join((*one, *_prose(45, "x"), *two)), " ".join((*one, *_prose(45, "y"), *two)))) == [(0, 60, 0, 60), (105, 165, 105, 165)]


def test_a_phrase_over_and_over_is_a_passage():
    assert any(x[3] - x[2] >= 100 for x in _candidates("start " + "buy now " * 60, "other words " + "buy now " * 60))


def test_long_near_copies_are_aligned_in_linear_time():
    rng = np.random.default_rng(6)
    text = rng.integers(0, 50_000, 200_000)
    other = text.copy()
    other[rng.choice(len(text), 2000, replace=False)] = 60_000
    found = _candidates(" ".join(map(str, text)), " ".join(map(str, other)))
    assert sum(x[3] - x[2] for x in found) > 199_000


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(-1, "a  b   c\n\n d <|endoftext|> it's", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long"))
    packed = pack.pack_documents(docs, path, with_ids=True).cache()
    rows = packed.collect()
    for r in docs.collect():
        own = sorted((x for x in rows if x.doc_id == r.doc_id), key=lambda x: x.piece)
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [0]
        assert [i for x in own for i in x.ids] == ids
        assert [x.start for x in own] == [sum(y.length for y in own[:k]) for k in range(len(own))]
        assert all(x.length == 2048 for x in own[1:])
        for x in own:
            assert x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
    by = {}
    for x in rows:
        by.setdefault(x.sequence_id, []).append(x)
    for xs in by.values():
        xs.sort(key=lambda x: x.offset)
        assert [x.offset for x in xs] == [sum(y.length for y in xs[:k]) for k in range(len(xs))]
        assert sum(x.length for x in xs) <= 2048
    total = sum(x.length for x in rows)
    assert len(by) <= -(-total // 2048) * 1.01 + 1
    made = {r.sequence_id: r.ids for r in pack.sequences(packed).collect()}
    assert all(made[k] == [i for x in xs for i in x.ids] for k, xs in by.items())


def test_best_fit_closes_the_fullest():
    bins = pack.BestFit(10, open_bins=2)
    assert bins.put(6) == (0, 0) and bins.put(5) == (1, 0)
    assert bins.put(4) == (0, 6)  # the tightest that fits
    assert bins.put(7) == (2, 0)
    assert bins.put(9)[0] == 3  # bin 2, the fuller of the two, closes
    assert bins.put(5) == (1, 5)


def test_packing_stays_near_the_minimum_with_few_bins():
    rng = np.random.default_rng(9)
    lengths = np.concatenate((rng.integers(1, 2049, 20_000), rng.geometric(1 / 300, 20_000).clip(max=2048), np.full(5_000, 2048)))
    rng.shuffle(lengths)
    bins = pack.BestFit(2048)
    put = list(pack.place(lengths.tolist(), bins))
    assert bins.n_open <= pack.OPEN_BINS and bins.n_bins <= 1.01 * lengths.sum() / 2048
    fill = np.zeros(bins.n_bins, int)
    ends = sorted((b, o, o + n) for (b, o), n in zip(put, lengths.tolist(), strict=True))
    for b, start, end in ends:
        assert start == fill[b] and end <= 2048
        fill[b] = end


def test_encoder_is_the_tokenizer():
    import public_tokenizers

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e = encoder(public_tokenizers.path(name))
        for text in ["", " ", "a b", "a\nb.\nc,\n\nd \n e.", "Hello, World's 12 3x", " b   c \nd", "tail ", "É\u00a0 x", "日本 語", ".\n,", "x\n"]:
            assert np.frombuffer(e.encode(text), "<u4").tolist() == e.whole.encode(text, add_special_tokens=False).ids


def test_warc_reader_checks_what_it_reads(spark):
    data = warc.member("1", "http://a/", b"<p>x</p>", None, False) + warc.member("2", None, b"<p>x</p>", "1", True)
    stream = io.BytesIO(data)
    records = [warc.parse(m) for m in warc.members(stream.read)]
    assert [r["fields"]["warc-type"] for r in records] == ["response", "revisit"] and records[0]["payload"] == b"<p>x</p>"
    assert all(r["ok"] for r in records)
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-5]).read))
    broken = next(warc.members(io.BytesIO(data).read)).replace(b"<p>x", b"<p>y")
    assert not warc.parse(broken)["ok"]
    with pytest.raises(ValueError):
        warc.parse(broken[:-6])


def test_archives_give_payloads_back(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    twice = pages.unionByName(pages.limit(5).withColumn("page_id", F.col("page_id") + 100_000))
    folder = work_path(spark, "warc-test")
    manifest = warc.write_warc(warc.with_revisits(twice, "page_id", "url", "html"), folder, archive_bytes=20_000)
    assert manifest.count() > 1
    back = warc.resolve_revisits(warc.read_warc(manifest, folder, with_payload=True)).collect()
    want = {str(r.page_id): r.html.encode() for r in twice.collect()}
    assert {r.record_id: bytes(r.payload) for r in back} == want
    assert sum(r.record_type == "revisit" for r in back) == 5


def test_classifier_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 0
    out = quality_classifier.classify(docs, labels.where(~fold)).join(labels.where(fold), "doc_id").toPandas()
    bad = (out.quality == 0) | (out.toxic == 1)
    assert (out[bad].kept).mean() < 0.08
    assert (out[~bad].kept).mean() > 0.98


def test_classifier_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    good, bad = [f"fine{i}" for i in range(40)], [f"junk{i}" for i in range(40)]
    rows, marks = [], []
    for i in range(160):
        low = rng.random() < (0.7 if i % 5 == 0 else 0.2)
        text = " ".join(rng.choice(bad if low else good, 12)) + " " + " ".join(rng.choice(good + bad, 6))
        rows.append((i if i % 9 else None, text, f"h{i % 5}", "p" if i % 2 else None))
        if i % 9 and i % 3:
            marks.append((i, 0 if low else 1, int(i % 20 == 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = quality_classifier.train(quality_classifier.sample_labels(docs, labels))
    assert set(model) == {"low", "toxic"}
    found = quality_classifier.classify(docs, labels, model=model).collect()
    known = {i: {"low": 1.0 - q, "toxic": float(x)} for i, q, x in marks}
    want = []
    chance = lambda x: 1 / (1 + np.exp(-x))
    out = [{} for _ in rows]
    for t in ("low", "toxic"):
        weights, start, base = model[t]
        odds = [start - base + sum(weights.get(f, 0.0) for f in quality_classifier.features(r[1])) for r in rows]
        count = [known[r[0]][t] if r[0] in known else chance(o + base) for r, o in zip(rows, odds, strict=True)]
        groups = {"host": {}, "path": {}}
        for r, c in zip(rows, count, strict=True):
            groups["host"].setdefault(r[2], []).append(c)
            groups["path"].setdefault(r[2:4], []).append(c)
        g = sum(count) / len(count)

        def strength(sites):
            within = sum(of * (1 - of) for _, of in sites)
            extra = sum(len(c) * (np.mean(c) - of) ** 2 for c, of in sites) - within
            n = sum(len(c) for c, _ in sites)
            return min(max(within * n / (extra * len(sites)), 1.0), 1000.0) if extra > 0 and within > 0 else 1000.0

        k_host = strength([(c, g) for c in groups["host"].values()])
        of_host = {h: (sum(c) + k_host * g) / (len(c) + k_host) for h, c in groups["host"].items()}
        k_path = strength([(c, of_host[key[0]]) for key, c in groups["path"].items()])
        for r, o, c, x in zip(rows, odds, count, out, strict=True):
            rate = (sum(count) - c) / (len(count) - 1)
            for k, site in ((k_host, groups["host"][r[2]]), (k_path, groups["path"][r[2:4]])):
                rate = (sum(site) - c + k * rate) / (len(site) - 1 + k)
            x[t] = chance(o + base + np.clip(np.log(rate / (1 - rate)) - base, -2, 2))
    want = sorted((str(r[0]), round(x["low"], 6), round(x["toxic"], 6), x["low"] <= 0.5 and x["toxic"] <= 0.5) for r, x in zip(rows, out, strict=True))
    assert sorted((str(r.doc_id), round(r.p_low, 6), round(r.p_toxic, 6), r.kept) for r in found) == want
    assert {True, False} == {r.kept for r in found}


def test_training_sample_is_bounded(spark):
    # one id on many labels and many texts
    docs = spark.range(6000).selectExpr("id % 3 as doc_id", "concat('text ', id) as text")
    labels = spark.range(6000).selectExpr("0L as doc_id", "cast(id % 2 as int) as quality", "0 as toxic")
    sample = quality_classifier.sample_labels(docs, labels, max_train=200)
    assert 100 < sample.count() < 300
    assert quality_classifier.sample_labels(docs, labels, max_bytes=900).count() < 180


def test_earlier_copies_match_a_suffix_array(spark):
    rng = np.random.default_rng(4)
    texts = ["\n".join(rng.choice(list("abc"), rng.integers(1, 25))) for _ in range(25)]
    run = "\n".join(f"r{i}" for i in range(37))
    texts += [run, f"x\n{run}\ny", f"{run}\na", "\n".join("z" * 40), "q\n" + "\n".join("z" * 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    places = line_dedup.placed_lines(docs, "doc_id", "text")
    at = {r.place: (r.doc, r.at) for r in places.collect()}
    found = {at[r.place]: (r.best, at[r.source]) for r in line_dedup.earlier_copies(places).collect()}
    # by sorting all suffixes and looking at neighbours both ways
    suffixes = sorted((tuple(t.split("\n")[i:]), (d, i)) for d, t in enumerate(texts) for i in range(len(t.split("\n"))))
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    want = {}
    for n, (mine, where) in enumerate(suffixes):
        best = (0, None)
        for step in (-1, 1):
            k, shared = n + step, len(mine)
            while 0 <= k < len(suffixes):
                shared = min(shared, common(suffixes[k][0], suffixes[k - step][0]))
                if not shared or shared < best[0]:
                    break
                if suffixes[k][1] < where and (shared > best[0] or suffixes[k][1] < best[1]):
                    best = (shared, suffixes[k][1])
                k += step
        if best[0]:
            want[where] = best
    assert found == want
    assert found[26, 1] == (37, (25, 0)) and found[28, 1] == (39, (28, 0))


def test_long_runs_need_all_rounds(spark):
    run = "\n".join(chr(97 + i % 26) + str(i // 26) for i in range(70))
    docs = spark.createDataFrame([(1, run), (2, f"new\n{run}\nend"), (3, run[: run.index("m2")] + "z")], "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.line_dedup(docs, min_lines=65, min_chars=10**6).collect()}
    assert out[2].text == "new\nend" and (out[2].n_runs, out[2].longest_run, out[2].longest_source) == (1, 70, 1)
    assert out[3].n_deleted == 0


def test_scores_do_not_depend_on_chunks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    key = lambda df: sorted((r.doc_id, r.n_order3, r.n_unseen, round(r.log_score, 4)) for r in df.collect())
    assert key(lm_score.lm_scores(docs, chunk_bytes=20_000)) == key(lm_score.lm_scores(docs))


def test_chunks_are_bounded_in_bytes(spark):
    rows = spark.range(6000).selectExpr("cast(case when id % 500 = 7 then 3000000 when id % 5 = 0 then 30000 else 1500 end as int) as size")
    chunks = rows.select("size", lm_score._chunk(F.col("size"), 1 << 21).alias("chunk")).groupBy("chunk").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    assert all(r.bytes <= 1 << 21 or r.n == 1 for r in chunks) and sum(r.n for r in chunks) == 6000
