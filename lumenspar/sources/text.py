"""Text ingestion: chunks of words, hash embeddings, content ids, projections per metric."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspar.functions.distance import lift
from lumenspar.functions.vectors import let, mean_vector, norm, scale


def content_id(text: Column) -> Column:
    """The first four bytes of the text's SHA-256, as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def rolling_id(text: Column) -> Column:
    """31-fold rolling hash of the characters, in 32 bits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % F.lit(4294967296))


def chunks(text: Column, size: int, overlap: float) -> Column:
    """Runs of ``size`` words that step on by the part not overlapped, joined by one space."""
    step = max(1, size - math.floor(size * overlap))

    def cut(words: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - size + step - 1, F.lit(0)), F.lit(step))
        parts = F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, size), " "))
        return F.when(F.size(words) == 0, F.expr("cast(array() as array<string>)")).otherwise(parts)

    return let(cut, F.filter(F.split(text, "\\s+"), lambda w: w != ""))


def hash_embedder(dim: int = 64) -> Callable[[Column], Column]:
    """A deterministic embedding without a model: signed counts of hashed words, unit length."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(text: str) -> list[float]:
            v = np.zeros(dim)
            for w in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            return (v / n if n else v).tolist()

        return texts.map(one, na_action="ignore")

    return embed


def mean_embedding(rows: DataFrame, by: str, vector: str, dim: int) -> DataFrame:
    """Element-wise mean of chunk embeddings."""
    return rows.groupBy(by).agg(mean_vector(F.col(vector), dim).alias("vector"))


def masked_mean(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is set; the zero vector where none is."""
    weight = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m)
    zero = F.transform(F.element_at(tokens, 1), lambda _: F.lit(0.0))
    total = F.aggregate(F.zip_with(tokens, mask, lambda t, m: F.transform(t, lambda x: x * m)), zero, lambda s, t: F.zip_with(s, t, lambda a, b: a + b))
    return scale(total, 1 / F.greatest(weight, F.lit(1e-9)))


def project(v: Column, metric: str, head: int = 32) -> Column:
    """A raw embedding made valid for a metric; values that are not numbers become 0."""
    clean = F.transform(v, lambda x: F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x))
    unit = lambda x: let(lambda a, n: F.when(n > 1e-12, scale(a, 1 / n)).otherwise(a), x, norm(x))
    if metric == "poincare":
        return let(lambda a, n: F.when(n >= 1, scale(a, 0.99999 / n)).otherwise(a), clean, norm(clean))
    if metric == "lorentz":
        return let(lift, clean)
    if metric == "hybrid":
        return let(lambda a: F.concat(lift(F.slice(a, 1, head)), unit(F.slice(a, head + 1, F.size(a)))), clean)
    return unit(clean) if metric == "cosine" else clean
