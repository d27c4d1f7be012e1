"""Keyed projections: search over vectors and metadata that are stored in disguise."""

from __future__ import annotations

import hashlib
import hmac

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenspar.functions.vectors import dot, vec


def _normals(key: bytes, n: int) -> np.ndarray:
    """n standard normals from a stream of keyed hashes (Box-Muller)."""
    words = []
    for block in range(-(-2 * n // 4)):
        words += np.frombuffer(hmac.new(key, block.to_bytes(8, "little"), hashlib.sha256).digest(), "<u8").tolist()
    u = (np.array(words[: 2 * n], dtype=float) + 0.5) / 2.0**64
    return np.sqrt(-2 * np.log(u[:n])) * np.cos(2 * np.pi * u[n : 2 * n])


def orthogonal(key: bytes, dim: int) -> np.ndarray:
    """A rotation drawn by the key; it keeps lengths and angles."""
    q, r = np.linalg.qr(_normals(key, dim * dim).reshape(dim, dim))
    return q * np.sign(np.diag(r))


def lorentz_transform(key: bytes, dim: int, beta: float = 0.1) -> np.ndarray:
    """A keyed rotation of space after a boost; it keeps the Lorentz product."""
    gamma = 1 / np.sqrt(1 - beta * beta)
    boost = np.eye(dim)
    boost[0, 0] = boost[1, 1] = gamma
    boost[0, 1] = boost[1, 0] = -gamma * beta
    spin = np.eye(dim)
    spin[1:, 1:] = orthogonal(key, dim - 1)
    return spin @ boost


def rotate(points: DataFrame, matrix: np.ndarray) -> DataFrame:
    return points.withColumn("vector", F.array(*[dot(F.col("vector"), vec(row)) for row in matrix]))


def hide(value: Column, key: str) -> Column:
    """A keyed hash of a metadata value; equal values stay equal."""
    return F.sha2(F.concat(F.lit(key), F.sha2(F.concat(F.lit(key), value), 256)), 256)


def seal(payload: Column, key: bytes) -> Column:
    return F.aes_encrypt(payload, F.lit(key))


def unseal(payload: Column, key: bytes) -> Column:
    return F.aes_decrypt(payload, F.lit(key))
