"""Nearest neighbours by multi-index hashing of learned binary codes.

A rotation is learned on a bounded sample (the SAMPLE vectors whose ids hash lowest) by alternating
between the signs of the rotated vectors and the best rotation towards those signs; the signs, one for
each dimension, are a vector's code. Every vector is indexed. The vectors are dealt into blocks by a hash
of their id; a block's index holds, for each of TABLES substrings of the codes, the vectors in order of
that substring. A code within Hamming distance r of a query's agrees with it up to
floor(r / TABLES) bits in one substring at least (the pigeonhole), and for r = TABLES * a + b up to a bits
in one of the first b + 1 or up to a - 1 in one of the others. Probing those values retrieves every code within r, and the
exact cosine of the original vectors, in double precision, ranks what was retrieved. Where a block has
fewer than k codes within the radius, the radius grows until there are k, or no more vectors: nothing is
capped.

Vectors that are null or zero, or hold null or non-finite components, take no part, nor do those whose
length isn't the most frequent one (the larger if tied), nor rows with a null id. Rows that repeat an id
are vectors and queries of their own, but no row is a neighbour of its own id. Ties go to the smaller id. Other columns of the input
play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import Scratch, column, small_batches

#: Vectors that the rotation is learned on; rows of a block; queries that meet a block at once.
SAMPLE, BLOCK, QUERIES = 4096, 20_000, 20_000
#: Substrings; bits that codes may differ in.
TABLES, RADIUS = 4, 29


def learn(sample: np.ndarray, rounds: int = 40, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the sample's unit vectors, and a rotation under which their signs keep the most."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = x.mean(0)
    x = x - mean
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
        r = (u @ v).T
    return mean, r


def codes(x: np.ndarray, mean: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Bits, a row for each vector."""
    return (x / np.linalg.norm(x, axis=1, keepdims=True) - mean) @ rotation > 0


class Index:
    """A block's vectors by the substrings of their codes."""

    def __init__(self, bits: np.ndarray, tables: int = TABLES):
        self.words = packed(bits)
        self.cuts = np.linspace(0, bits.shape[1], max(tables, -(-bits.shape[1] // 20)) + 1).astype(int)  # substrings of 20 bits at most
        self.tables = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            values = substring(bits, a, b)
            order = np.argsort(values, kind="stable")
            self.tables.append((order, np.searchsorted(values[order], np.arange((1 << (b - a)) + 1)), masks(int(b - a))))

    def probe(self, bits: np.ndarray, word: np.ndarray, radius: int) -> np.ndarray:
        """The rows whose codes differ from the query's by `radius` bits at most, in order."""
        m = len(self.tables)
        most, extra = divmod(radius, m)
        found = []
        for k, (order, starts, by_count) in enumerate(self.tables):
            a, b = self.cuts[k], self.cuts[k + 1]
            reach = most if k <= extra else most - 1
            if reach < 0:
                continue
            values = by_count[: np.searchsorted(np.bitwise_count(by_count), reach, "right")] ^ substring(bits[None], a, b)[0]
            if len(values) == len(by_count):
                found = [np.arange(len(self.words))]
                break
            lo, n = starts[values], starts[values + 1] - starts[values]
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            found.append(order[at])
        mark = np.zeros(len(self.words), bool)
        for x in found:
            mark[x] = True
        rows = np.flatnonzero(mark)
        return rows[np.bitwise_count(self.words[rows] ^ word).sum(1, dtype=np.int64) <= radius]


def packed(bits: np.ndarray) -> np.ndarray:
    pad = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1).view("<u8")


def substring(bits: np.ndarray, a: int, b: int) -> np.ndarray:
    return bits[:, a:b] @ (1 << np.arange(b - a, dtype=np.int64))


def masks(n: int) -> np.ndarray:
    """All values of n bits, those of fewer ones first."""
    values = np.arange(1 << n)
    return values[np.argsort(np.bitwise_count(values), kind="stable")]


def nearest(index: Index, ids: np.ndarray, x: np.ndarray, q_id: int, q: np.ndarray, bits: np.ndarray, word: np.ndarray, k: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and cosines of the k nearest that the index retrieves."""
    while True:
        rows = index.probe(bits, word, radius)
        rows = rows[ids[rows] != q_id]
        if len(rows) >= k or radius >= len(bits):
            break
        radius += index_step(len(bits))
    some = x[rows]
    score = np.einsum("ij,j->i", some, q) / (np.sqrt(np.einsum("ij,ij->i", some, some)) * np.sqrt(q @ q))
    best = np.lexsort((ids[rows], -score))[:k]
    return ids[rows][best], score[best]


def index_step(bits: int) -> int:
    return max(1, bits // 16)


def search(vectors: DataFrame, queries: F.Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", radius: int = RADIUS, tables: int = TABLES) -> DataFrame:
    """query_id, rank, vec_id, score for the rows that `queries` (over column vec_id) picks. radius is for
    codes of 64 bits, and goes with the length of others."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "mih")
    small_batches(spark)
    x = vectors.select(column(vectors, id_col).cast("long").alias("vec_id"), column(vectors, vector_col).cast("array<double>").alias("x"))
    sound = F.expr("forall(x, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(x, v -> v <> 0)")
    x = scratch.table(x.where("vec_id is not null and x is not null").where(sound), "vectors")
    sizes = x.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head(1)
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    size, rows = sizes[0]["n"], sizes[0]["count"]
    x = x.where(F.size("x") == size)
    sample = x.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(SAMPLE).select("x").toArrow()
    mean, rotation = learn(np.array(sample.column(0).combine_chunks().flatten()).reshape(-1, size))
    radius = round(radius * size / 64)

    chosen = scratch.table(x.where(queries).withColumn("asked", F.monotonically_increasing_id()), "queries")
    blocks, parts = max(1, -(-rows // BLOCK)), max(1, -(-chosen.count() // QUERIES))
    left = x.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = chosen.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return t.column("vec_id").to_numpy(), np.array(t.column("x").combine_chunks().flatten()).reshape(-1, size)

    def block(data: pa.Table, asked: pa.Table) -> pa.Table:
        out: dict[str, list] = {"asked": [], "query_id": [], "vec_id": [], "score": []}
        if data.num_rows and asked.num_rows:
            ids, x = matrix(data)
            index = Index(codes(x, mean, rotation), tables)
            q_ids, q = matrix(asked)
            bits = codes(q, mean, rotation)
            for n, *row in zip(asked.column("asked").to_pylist(), q_ids.tolist(), q, bits, packed(bits), strict=True):
                found, score = nearest(index, ids, x, *row, k, radius)
                for name, v in zip(out, (np.full(len(found), n), np.full(len(found), row[0]), found, score), strict=True):
                    out[name].append(v)
        kinds = zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)
        return pa.table({name: pa.array(np.concatenate(out[name]) if out[name] else [], kind) for name, kind in kinds})

    near = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(block, "asked long, query_id long, vec_id long, score double")
    by_rank = W.Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
