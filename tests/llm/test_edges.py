"""Nulls, empty and long texts, repeats, empty tables and clashing names, for every operator."""

import pytest

from lumenspar.llm import decontaminate, line_dedup, lm_score, near_dedup, pack, quality_classifier, quality_rules, substring_dedup, url_filter, warc

LINE = "one quite long line of words that comes back in other texts again and again"
PROSE = " ".join(f"w{i * i % 97}x{i}" for i in range(120))
TEXTS = [
    (1, PROSE, "a", "en"),
    (2, PROSE, "a", "en"),
    (2, PROSE, "a", "en"),
    (None, None, None, None),
    (None, PROSE + " tail", None, "en"),
    (3, "", "b", None),
    (4, "  \n \n", "b", "de"),
    (5, "one", "b", "de"),
    (6, f"{LINE}\nunlike {PROSE[:50]}", "a", "en"),
    (7, f"other\n\n{LINE}", "a", "en"),
    (8, " ".join(f"v{i % 5000}" for i in range(60_000)), "c", "en"),
    (9, "x" * 300_000, "c", "en"),
    (9, "another text of the same id", "c", "en"),
    (10, "É über\x00 \U0001f600 ß", "c", "fr"),
]
EXTRA = "1 as k1, 2 as node, 'x' as label, 3 as bucket, 'h' as host, 'p' as path, 4 as piece, 5 as offset, 6 as n_lines, 7 as _line_k1, 8 as cls, 9 as row, 10 as kept, 11 as chunk, 12 as item_id, 13 as s, 14 as seed"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string, source string, lang string").selectExpr("*", *EXTRA.split(", "))


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, None), (None, 0, 1), (99, 0, 1), (6, None, None), (8, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, PROSE[:200]), (2, "one"), (3, None), (None, "two words"), (4, ""), (1, PROSE[:200]), (5, "v1 v2 v3 v4 v5 v6 v7 v8 v9")], "item_id long, text string")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_near_duplicates(docs, nothing):
    found = by_id(near_dedup.near_duplicates(docs))
    assert sum(map(len, found.values())) == len(TEXTS)
    assert found[1][0].kept and found[1][0].component_id == 1
    assert [(r.kept, r.component_id) for r in found[2]] == [(False, 1)] * 2
    assert found[3][0].n_shingles == 0 and found[3][0].kept
    assert sorted((r.component_id is None, r.kept) for r in found[None]) == [(False, False), (True, True)]
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_line_dedup(docs, nothing):
    out = line_dedup.line_dedup(docs)
    assert "n_lines" in out.columns and len(out.columns) == len(set(out.columns))
    found = by_id(out)
    assert found[1][0].text is None or found[None][0] is not None  # null ids rank first
    assert [r.n_deleted for r in found[6]] == [0] and found[6][0].text == TEXTS[8][1]
    assert found[7][0].text == "other\n" and found[7][0].n_deleted == 1
    assert found[2][0].text == found[2][1].text == ""
    assert found[4][0].text == "  \n \n" and found[4][0].n_lines == 0
    assert {r.text for r in found[None]} == {None, PROSE + " tail"}
    assert line_dedup.line_dedup(nothing).count() == 0


def test_lm_scores(docs, nothing):
    found = by_id(lm_score.lm_scores(docs))
    assert sum(map(len, found.values())) == len(TEXTS)
    assert found[3][0].n_words == 0 and found[3][0].log_score == 0
    assert found[2][0].log_score == pytest.approx(found[2][1].log_score) == pytest.approx(found[1][0].log_score)
    assert found[8][0].n_words == 60_000
    assert lm_score.lm_scores(nothing).count() == 0


def test_packing(docs, nothing):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = pack.pack_documents(docs, path).collect()
    assert {r.doc_id for r in packed} == {t[0] for t in TEXTS}
    assert all(r.length == 1 for r in packed if r.doc_id == 3)
    assert pack.pack_documents(nothing, path).count() == 0


def test_decontaminate(docs, nothing, benchmark, spark):
    found = by_id(decontaminate.decontaminate(docs, benchmark))
    assert sum(map(len, found.values())) == len(TEXTS)
    assert found[3][0].n_words == 0 and not found[3][0].contaminated
    assert found[1][0].items == ["1"] and found[5][0].items == ["2"] and found[5][0].n_hit == 1
    # 5,000 values repeat twelve times over the 60,000 words
    assert found[8][0].n_hit == 12 * 9
    assert decontaminate.decontaminate(nothing, benchmark).count() == 0
    clean = decontaminate.decontaminate(docs, benchmark.limit(0)).collect()
    assert len(clean) == len(TEXTS) and not any(r.n_hit for r in clean)
    # blocks of a few characters give what one block gives
    key = lambda r: (str(r.doc_id), r.n_words, r.n_hit, r.items_sha256)
    small = decontaminate.decontaminate(docs, benchmark, block_chars=10)
    assert sorted(map(key, small.collect())) == sorted(key(r) for rs in found.values() for r in rs)


def test_classifier(docs, nothing, labels):
    found = quality_classifier.classify(docs, labels, carry=["k1"]).collect()
    assert len(found) == len(TEXTS) and all(r.k1 == 1 and 0 <= r.p_low <= 1 and 0 <= r.rate_toxic <= 1 for r in found)
    assert quality_classifier.classify(nothing, labels).count() == 0
    untrained = quality_classifier.classify(docs, labels.limit(0)).collect()
    assert len(untrained) == len(TEXTS) and all(r.kept for r in untrained)


def test_rules(docs, nothing):
    found = by_id(quality_rules.quality_rules(docs))
    assert sum(map(len, found.values())) == len(TEXTS)
    assert found[3][0].base_failed and found[3][0].n_words == 0
    assert found[1][0].n_repeat_words == 0 and not found[1][0].base_failed
    assert found[8][0].n_repeat_words == 60_000 and found[8][0].base_failed
    assert {r.n_words for r in found[None]} == {0, 121}
    assert quality_rules.quality_rules(nothing).count() == 0


def test_passages(docs, nothing):
    found = substring_dedup.repeated_passages(docs).collect()
    pairs = {frozenset((r.doc_id, r.source_doc_id)) for r in found}
    # three documents hold the same 120 words, rows that repeat one count once; text 8 repeats itself
    joined = set().union(*(p for p in pairs if p & {1, 2, None}))
    assert joined == {1, 2, None} and sum(bool(p & {1, 2, None}) for p in pairs) == 2
    assert pairs - {frozenset((1, 2)), frozenset((1, None)), frozenset((2, None))} == {frozenset((8,))}
    assert substring_dedup.repeated_passages(nothing).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x#y", "ftp://example.net#f", "s://x.net/de/1", "s://example.net/de/8/" + "z" * 50_000, "s://é.org/es/ü", "s://org/es/"]
    urls += [f"http://site{i}.com/en/{i}" for i in range(40)] + [f"http://site{i}.net/de/{i}" for i in range(40)] + ["http://site1.com/en/1"] * 2
    pages = spark.createDataFrame([(i if i % 3 else None, u, "h", "k", 1) for i, u in enumerate(urls)], "page_id long, url string, s string, g string, row int")
    found = url_filter.judge_urls(pages).collect()
    assert len(found) == len(urls) and {r.verdict for r in found} <= {"allow", "block"}
    got = {(r.host, r.path[:10]): (r.rule, r.verdict) for r in found}
    assert got["a.example.com", "/en/7"] == ("example.com/en/7", "allow")
    assert got["example.net", "/de/8/zzzz"] == ("example.net/de/8", "block")
    assert got["org", "/es/"] == ("org/es/", "block")
    assert got["", ""][0] is None
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages.where("page_id < 4")).collect()} <= {"allow"}


def test_a_repeated_url_trains_once(spark):
    urls = [f"http://site{i}.{'com/en' if i % 2 else 'net/de'}/{i}" for i in range(60)] + [f"http://other{i}.org/{'en' if i % 2 else 'de'}/x{i}" for i in range(20)]
    verdicts = lambda us: {(r.host, r.path): (r.verdict, r.score) for r in url_filter.judge_urls(spark.createDataFrame([(i, u) for i, u in enumerate(us)], "page_id long, url string")).collect()}
    assert verdicts(urls) == verdicts(urls + [urls[0]] * 300)


def test_every_decided_url_trains(spark):
    n = 21_000  # of each kind
    urls = [f"http://site.{'com/en' if i % 2 else 'net/de'}/{i}" for i in range(2 * n)] + ["http://site.net/de/" + "q" * 3_000, "http://other.info/x"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    seen, real = [], url_filter.train
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(url_filter, "train", lambda decided, order: (seen.append(decided), real(decided, order))[1])
        patch.setattr(url_filter, "calibrate", lambda held: (seen.append(held), 0.0)[1])
        url_filter.judge_urls(pages)
    trained, held = seen
    assert trained.count() + held.count() == 2 * n + 1


def test_archives(spark):
    rows = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "n", "same"), (5, "b", "é" * 200_000), (5, "b", "é" * 200_000), (6, "c", "\r\n\r\nWARC/1.1\r\n"), (None, "z", "only null")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as first", "'x' as payload", "3 as id", "'y' as record_id")
    found = warc.archive_round_trip(pages).collect()
    assert len(found) == len(rows) and all(r.digest_ok for r in found)
    got = sorted((r.record_id or "", r.record_type, r.refers_to or "", r.payload_bytes) for r in found)
    assert got == sorted([
        ("1", "response", "", 4), ("2", "revisit", "1", 4), ("", "revisit", "1", 4), ("3", "response", "", 0), ("4", "revisit", "3", 0),
        ("5", "response", "", 400_000), ("5", "response", "", 400_000), ("6", "response", "", 14), ("", "response", "", 9),
    ])
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
