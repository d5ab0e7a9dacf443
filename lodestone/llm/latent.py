"""Distributed randomised truncated SVD of sparse weighted rows.

Rows stay where they are. For each pass the (terms x rank) test matrix is sent out, every task adds up its part of
A'(A X) over its rows, and the parts are summed by term. Only matrices of (terms x rank) reach the driver; the caller
bounds the number of terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nonzero entries handled at a time, so that (entries x rank) stays small.
CHUNK = 1 << 15
#: Tasks that add up partial matrices; more would only mean more partial matrices to sum.
MOST_PARTS = 1024
#: Bound on the terms of a decomposition: with rank 80 and 4 bytes that is 64 MB sent to each executor.
MOST_TERMS = 200_000


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Cut rows, given by the offsets of their entries, into ranges of at most ``most`` entries (a longer row is alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def project(offsets: np.ndarray, ids: np.ndarray, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Row vectors times ``basis``. offsets: of each row's entries, from 0."""
    out = np.zeros((len(offsets) - 1, basis.shape[1]), dtype=np.float32)
    for i, j in chunks(offsets):
        a, b = offsets[i], offsets[j]
        if a == b:
            continue
        part = basis[ids[a:b]] * weights[a:b, None]
        full = np.flatnonzero(np.diff(offsets[i : j + 1]))
        out[i + full] = np.add.reduceat(part, offsets[i:j][full] - a, axis=0)
    return out


def scatter(acc: np.ndarray, offsets: np.ndarray, ids: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> None:
    """Add A'Y to ``acc``."""
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for i, j in chunks(offsets):
        a, b = offsets[i], offsets[j]
        if a == b:
            continue
        order = np.argsort(ids[a:b], kind="stable")
        terms = ids[a:b][order]
        begin = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]])
        part = rows[row_of[a:b][order]] * weights[a:b][order][:, None]
        acc[terms[begin]] += np.add.reduceat(part, begin, axis=0)


def gram_times(vectors: DataFrame, x: np.ndarray, weigh) -> np.ndarray:
    """A'(A x) over all rows.

    vectors: any columns; ``weigh(batch)`` turns a record batch into (offsets, ids, weights) of its rows.
    """
    terms, rank = x.shape
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast(x.astype(np.float32))
    names = [f"v{i}" for i in range(rank)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            offsets, ids, weights = weigh(batch)
            if acc is None:
                acc = np.zeros((terms, rank), dtype=np.float32)
            scatter(acc, offsets, ids, weights, project(offsets, ids, weights, sent.value))
        if acc is not None:
            at = np.flatnonzero(np.abs(acc).sum(axis=1))
            for k in range(0, len(at), 8192):
                some = at[k : k + 8192]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), *[pa.array(acc[some, r].astype(np.float64)) for r in range(rank)]], names=["term", *names]
                )

    summed = vectors.coalesce(MOST_PARTS).mapInArrow(run, "term int, " + ", ".join(f"{n} double" for n in names)).groupBy("term").agg(*[F.sum(n).alias(n) for n in names])
    out = np.zeros((terms, rank))
    got = summed.toPandas()
    out[got["term"].to_numpy(dtype=np.int64)] = got[names].to_numpy()
    sent.unpersist()
    return out


def randomised_svd(vectors: DataFrame, terms: int, rank: int, weigh, *, over: int = 8, power: int = 1, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The right singular vectors (terms x at most ``rank``) of the largest singular values, at unit length, and the values.

    Randomised range finder with ``over`` extra columns and ``power`` further passes; passes over the data: power + 2.
    """
    if terms > MOST_TERMS:
        raise ValueError(f"{terms} terms; at most {MOST_TERMS} can be sent to the executors")
    if terms == 0:
        return np.zeros((0, 0), dtype=np.float32), np.zeros(0)
    size = min(rank + over, terms)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, size)))[0]
    for _ in range(power + 1):
        q = np.linalg.qr(gram_times(vectors, q, weigh))[0]
    inner = q.T @ gram_times(vectors, q, weigh)
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(values)[::-1][: min(rank, size)]
    order = order[values[order] > max(values.max(), 0) * 1e-9]
    return (q @ turn[:, order]).astype(np.float32), np.sqrt(values[order])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)
