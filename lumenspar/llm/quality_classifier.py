"""Quality classifier with hierarchical empirical Bayes over host and path.

A document's own evidence is the log odds of a logistic model over words, word beginnings
and a few shapes of the text, fitted on a bounded sample of labelled rows. Hosts and
paths bring prior odds: bad documents are added up by path and host over all documents,
a labelled one by its label, any other by the chance that its text gives it; a host's
rate is shrunk towards the global rate and a path's towards its host's, each by a strength
taken from how much the sites differ. A document is left out of the sums that judge it, so
its own evidence counts once. Posterior odds are the site's odds times that evidence. Two
traits are judged so, low quality and toxicity; a document that is likelier to have either
than not is rejected.

Defined results: a null or empty text has only its shape as evidence; null host or path
is a site of its own; repeated rows each count and come back; labels that are null, or
of documents that are not there, are left out; of several labels of one id the worst
holds; where a trait has no labels of both kinds its evidence is nought and its global
rate nought, so all is kept; an empty table gives an empty result. Columns that are not
named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspar.work import compact

#: Different labelled texts to fit on, and their bytes, about; both bound the sample, the features
#: and what the fit holds. Longer texts are judged like any other, but are no examples.
MAX_TRAIN, MAX_TRAIN_BYTES, MAX_EXAMPLE_BYTES = 20_000, 64_000_000, 1_000_000
#: A feature is used from so many sample documents on, if its log odds are so many errors from nought.
MIN_DOCS, MIN_Z = 4, 3.0
MAX_STRENGTH = 1000.0
#: How far the sites may move a document's odds, in nats: a site alone rejects nothing.
SITE_BOUND = 2.0
TRAITS = ("low", "toxic")
_WORD = re.compile(r"\w+")
_SHAPES = (
    ("symbols", (0.01, 0.03, 0.1)), ("upper", (0.05, 0.1, 0.3)), ("shouts", (0.005, 0.02, 0.1)), ("twice", (0.03, 0.06, 0.2)),
    ("varied", (0.1, 0.3, 0.5)), ("words", (5, 10, 20)), ("digits", (0.05, 0.2)),
)


def features(text: str | None) -> set[str]:
    """Distinct words, their first 4 and 6 letters, and steps of the text's shape."""
    text = text or ""
    n = len(text) or 1
    tokens = text.split()
    m = len(tokens) or 1
    letters = set(_WORD.findall(text.lower()))
    values = {
        "symbols": sum(map(text.count, "#*$%&|<>")) / n,
        "upper": len(_UPPER.findall(text)) / n,
        "shouts": text.count("!") / n,
        "twice": sum(map(str.__eq__, tokens, tokens[1:])) / m,
        "varied": len(set(tokens)) / m,
        "words": len(tokens),
        "digits": len(_DIGIT.findall(text)) / n,
    }
    out = {f"={name}{sum(values[name] > s for s in steps)}" for name, steps in _SHAPES}
    out |= letters
    out |= {"^" + w[:4] for w in letters if len(w) > 4}
    out |= {"~" + w[:6] for w in letters if len(w) > 6}
    return out


_UPPER, _DIGIT = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]")


def _explode_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            found = [sorted(features(t)) for t in batch.column("text").to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            names = pa.array([x for f in found for x in f], pa.string())
            yield pa.RecordBatch.from_arrays([names, batch.column("low").take(rows), batch.column("toxic").take(rows)], names=["feature", "low", "toxic"])


def _index_features(chosen: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = chosen.value
        for batch in batches:
            found = [sorted(index[x] for x in features(t) if x in index) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column("low"), batch.column("toxic")], names=["x", "low", "toxic"])

    return run


def fit_logistic(column: np.ndarray, lengths: np.ndarray, y: np.ndarray, n_features: int, l2: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2 logistic model over binary features (accelerated gradient).

    Row r has ``lengths[r]`` features, which stand one row after the other in ``column``.
    """
    row = np.repeat(np.arange(len(lengths)), lengths)
    by_feature = np.argsort(column, kind="stable")
    row_by_feature, seen = row[by_feature], np.bincount(column, minlength=n_features)
    full_rows, full_features = np.flatnonzero(lengths), np.flatnonzero(seen)
    row_at = np.cumsum(lengths)[full_rows] - lengths[full_rows]
    feature_at = np.cumsum(seen)[full_features] - seen[full_features]
    most = lengths.max(initial=1)
    w, b = np.zeros(n_features), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    step_w, ahead, ahead_b, t = most * seen.clip(1) / 4.0 + l2, w.copy(), b, 1.0
    for _ in range(steps):
        z, pull = np.full(len(lengths), ahead_b), l2 * ahead
        if len(column):
            z[full_rows] += np.add.reduceat(ahead[column], row_at)
        miss = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        if len(column):
            pull[full_features] += np.add.reduceat(miss[row_by_feature], feature_at)
        new = ahead - pull / step_w
        new_b = ahead_b - miss.sum() / (len(y) * most / 4.0 + 1e-9)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        moved = max(np.abs(new - w).max(initial=0.0), abs(new_b - b))
        w, b, t = new, new_b, t_new
        if moved < 1e-4 * max(1.0, np.abs(w).max(initial=0.0)):
            break
    return w, b


def _fitted(n_features: int, traits: list[str]) -> Callable:
    """(trait, feature, weight) of the models; feature -1 is the intercept. All rows of the sample come to one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, lengths, labels = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], {t: [np.zeros(0)] for t in traits}
        for batch in batches:
            x = batch.column("x")
            columns.append(x.flatten().to_numpy(zero_copy_only=False))
            lengths.append(np.diff(x.offsets.to_numpy()))
            for t in traits:
                labels[t].append(batch.column(t).to_numpy(zero_copy_only=False).astype(float))
        column, n = np.concatenate(columns), np.concatenate(lengths)
        for t in traits:
            y = np.concatenate(labels[t])
            known = ~np.isnan(y)
            w, b = fit_logistic(column[np.repeat(known, n)], n[known], y[known], max(1, n_features))
            kept = np.flatnonzero(np.abs(w) > 1e-6)
            yield pa.RecordBatch.from_arrays(
                [pa.array([t] * (len(kept) + 1)), pa.array([-1, *kept.tolist()], pa.int32()), pa.array([b, *w[kept].tolist()])], names=["trait", "feature", "weight"]
            )

    return run


def sample_labels(
    docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES, max_example: int = MAX_EXAMPLE_BYTES
) -> DataFrame:
    """Different labelled texts, at most about ``max_train`` and ``max_bytes``, chosen by hash.

    Labels count once for each id, and of the texts found, which may be many for one id,
    the different ones are chosen from again, so no id or text fills the sample.
    """
    share = lambda column, seed, part: F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(2**30)) < F.lit(int(part * 2**30))
    usable = one_label_each(labels)
    some = usable.where(share("labelled", 1, min(1.0, max_train / max(1, usable.count()))))
    # written, so that its size is known when the join is planned
    some = compact(some, "labels")
    joined = docs.join(some, docs.doc_id == some.labelled).select(F.coalesce("text", F.lit("")).alias("text"), "low", "toxic")
    found = joined.where(F.octet_length("text") <= max_example).groupBy("text").agg(F.max("low").alias("low"), F.max("toxic").alias("toxic"))
    found = compact(found, "labelled")
    there = found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    return found.where(share("text", 2, min(1.0, max_train / max(1, there.n), max_bytes / max(1, there.bytes or 0))))


def one_label_each(labels: DataFrame) -> DataFrame:
    """labelled (the id), low and toxic: 1 is bad, null unknown; one row an id."""
    usable = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    return usable.groupBy(F.col("doc_id").alias("labelled")).agg(
        F.max((1 - F.col("quality")).cast("double")).alias("low"), F.max(F.col("toxic").cast("double")).alias("toxic")
    )


def train(sample: DataFrame) -> dict:
    """{trait: (weights by feature, intercept, base log odds)} from ``sample(text, low, toxic)``."""
    sample = compact(sample.select("text", "low", "toxic"), "labelled")
    totals = sample.agg(*[f(t).alias(f"{n}_{t}") for t in TRAITS for n, f in (("n", F.count), ("bad", F.sum))]).first()
    usable = [t for t in TRAITS if totals[f"bad_{t}"] and totals[f"bad_{t}"] < totals[f"n_{t}"]]
    if not usable:
        return {}
    counts = sample.mapInArrow(_explode_features, "feature string, low double, toxic double").groupBy("feature").agg(
        *[f(t).alias(f"{n}_{t}") for t in usable for n, f in (("n", F.count), ("bad", F.sum))], F.count(F.lit(1)).alias("n")
    )
    wanted = F.lit(False)
    for t in usable:
        bad, all_bad = F.coalesce(f"bad_{t}", F.lit(0.0)) + 0.5, float(totals[f"bad_{t}"])
        good, all_good = F.col(f"n_{t}") - bad + 1.0, float(totals[f"n_{t}"]) - all_bad
        odds = F.ln(bad / good) - F.ln(F.lit((all_bad + 1) / (all_good + 1)))
        wanted = wanted | (F.abs(odds) >= MIN_Z * F.sqrt(1 / bad + 1 / good))
    chosen = {r.feature: i for i, r in enumerate(counts.where((F.col("n") >= MIN_DOCS) & wanted).select("feature").orderBy("feature").collect())}
    rows = sample.mapInArrow(_index_features(sample.sparkSession.sparkContext.broadcast(chosen)), "x array<int>, low double, toxic double")
    # the sample is bounded, so one task holds it; only weights come to the driver
    fitted = rows.repartition(1).mapInArrow(_fitted(len(chosen), usable), "trait string, feature int, weight double").collect()
    names = list(chosen)
    model = {}
    for t in usable:
        weights = {r.feature: r.weight for r in fitted if r.trait == t}
        bad, n = totals[f"bad_{t}"], totals[f"n_{t}"]
        model[t] = ({names[i]: w for i, w in weights.items() if i >= 0}, weights[-1], float(np.log((bad + 0.5) / (n - bad + 0.5))))
    return model


def _evidence(shared: Broadcast, columns: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, weights = shared.value
        for batch in batches:
            out: list[list[float]] = [[], []]
            for text in batch.column("text"):
                low, toxic = start
                if weights:
                    for f in features(text.as_py()):
                        if w := weights.get(f):
                            low, toxic = low + w[0], toxic + w[1]
                out[0].append(low)
                out[1].append(toxic)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *map(pa.array, out)], names=[*columns, "low", "toxic"])

    return run


def evidence(docs: DataFrame, model: dict, columns: Sequence[str]) -> DataFrame:
    """The named columns and the log-odds evidence of each trait; no shuffle."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    # one table for both traits: what a worker holds is bounded by the sample's features
    weights = {f: tuple(model[t][0].get(f, 0.0) if t in model else 0.0 for t in TRAITS) for t in model for f in model[t][0]}
    start = tuple(model[t][1] - model[t][2] if t in model else 0.0 for t in TRAITS)
    shared = docs.sparkSession.sparkContext.broadcast((start, weights))
    return docs.select(*columns, "text").mapInArrow(_evidence(shared, list(columns)), f"{kinds}, low double, toxic double")


def _strength(n: str, mean: str, of: str) -> Column:
    """Beta strength from the spread of site means around ``of`` (moments, by size)."""
    within = F.sum(F.col(of) * (1 - F.col(of)))
    spread = F.sum(F.col(n) * (F.col(mean) - F.col(of)) ** 2)
    extra = spread - within
    return F.when(
        (extra > 0) & (within > 0), F.least(F.greatest(within * F.sum(n) / (extra * F.count(F.lit(1))), F.lit(1.0)), F.lit(MAX_STRENGTH))
    ).otherwise(MAX_STRENGTH)


def site_sums(counted: DataFrame) -> tuple[DataFrame, dict]:
    """Per (host, path): documents and bad ones of path and host; and the whole with the strengths.

    ``counted(host, path, c_low, c_toxic)`` has what each document counts. Sums run
    map-side first, so a hot host is a few rows.
    """
    sums = ("n", *[f"c_{t}" for t in TRAITS])
    paths = counted.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(c) for c in sums[1:]])
    paths = compact(paths, "sites")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(f"h_{c}") for c in sums])
    whole = hosts.agg(*[F.sum(f"h_{c}").alias(c) for c in sums]).first().asDict()
    n_all = whole["n"] or 1.0
    for t in TRAITS:
        hosts = hosts.withColumn(f"g_{t}", F.lit((whole[f"c_{t}"] or 0.0) / n_all)).withColumn(f"m_{t}", F.col(f"h_c_{t}") / F.col("h_n"))
    k_host = hosts.agg(*[_strength("h_n", f"m_{t}", f"g_{t}").alias(t) for t in TRAITS]).first()
    for t in TRAITS:
        hosts = hosts.withColumn(f"r_{t}", (F.col(f"h_c_{t}") + F.lit(k_host[t]) * F.col(f"g_{t}")) / (F.col("h_n") + F.lit(k_host[t])))
    up = hosts.select(F.col("host").alias("of_host"), *[f"h_{c}" for c in sums], *[f"r_{t}" for t in TRAITS])
    paths = paths.join(up, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host")
    k_path = paths.select("*", *[(F.col(f"c_{t}") / F.col("n")).alias(f"m_{t}") for t in TRAITS]).agg(*[_strength("n", f"m_{t}", f"r_{t}").alias(t) for t in TRAITS]).first()
    names = {"host": "of_host", "path": "of_path", **{c: f"p_{c}" for c in sums}}
    return paths.drop(*[f"r_{t}" for t in TRAITS]).withColumnsRenamed(names), {"whole": whole, "host": k_host.asDict(), "path": k_path.asDict()}


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
    max_train: int = MAX_TRAIN, model: dict | None = None, carry: Sequence[str] = (),
) -> DataFrame:
    """doc_id, the columns to ``carry``, p_low, p_toxic, rate_low, rate_toxic and kept, for each document.

    ``labels(doc_id, quality, toxic)``; rates are those of the document's path without the
    document itself. Texts are read once for the sample and once for the evidence, whose
    narrow rows are written to the shared folder and joined to labels and sites.
    """
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), *carry
    )
    model = train(sample_labels(narrow, labels, max_train)) if model is None else model
    base = {t: model[t][2] if t in model else -40.0 for t in TRAITS}
    scored = compact(evidence(narrow, model, ("doc_id", "host", "path", *carry)), "evidence")
    known = compact(one_label_each(labels).withColumnsRenamed({t: f"is_{t}" for t in TRAITS}), "labels")
    chance = lambda odds: 1 / (1 + F.exp(-odds))
    counts = [(F.coalesce(f"is_{t}", chance(F.col(t) + base[t])) if t in model else F.lit(0.0)).alias(f"c_{t}") for t in TRAITS]
    counted = compact(scored.join(known, scored.doc_id == known.labelled, "left").select(*scored.columns, *counts), "counted")
    sites, prior = site_sums(counted)
    both = counted.join(compact(sites, "sites"), F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path")), "left")
    for t in TRAITS:
        others, own = float(prior["whole"]["n"] or 0.0) - 1, F.col(f"c_{t}")
        rate = (F.lit(prior["whole"][f"c_{t}"] or 0.0) - own) / others if others > 0 else F.lit(float(1 / (1 + np.exp(-base[t]))))
        for level in ("host", "path"):
            k = float(prior[level][t])
            rate = (F.col(f"{level[0]}_c_{t}") - own + k * rate) / (F.col(f"{level[0]}_n") - 1 + k)
        rate = F.least(F.greatest(rate, F.lit(0.0)), F.lit(1.0))
        inside = F.least(F.greatest(rate, F.lit(1e-9)), F.lit(1 - 1e-9))
        shift = F.least(F.greatest(F.ln(inside / (1 - inside)) - base[t], F.lit(-SITE_BOUND)), F.lit(SITE_BOUND))
        both = both.withColumn(f"rate_{t}", rate).withColumn(f"p_{t}", chance(F.col(t) + base[t] + shift))
    return both.select(
        "doc_id", *carry, "p_low", "p_toxic", "rate_low", "rate_toxic", ((F.col("p_low") <= 0.5) & (F.col("p_toxic") <= 0.5)).alias("kept")
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels)
