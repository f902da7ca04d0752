"""Best-fit packing of tokenised documents into sequences of bounded length.

A document longer than a sequence is cut into full pieces, the first of which may be shorter; every other
document is one piece. Documents are range-sorted by length and ranked within it. Pieces of one length that
wait are a run (length, first rank, how many); gaps of one size that lie in consecutive sequences are a run
too (size, first sequence, how many). The runs are a table in the shared folder, and bulk-synchronous rounds
replace it until nothing waits:

* sweep: runs are dealt by ranges of size, and a task for each range sweeps it from the largest size down:
  each piece's successor is the smallest gap left that holds it;
* conflicts: pieces that want one gap go by rank, the longest first, then by their place in the sort; who
  finds no gap left in its range waits for the next round, whose ranges are wider;
* update: what filled gaps have left are gaps of a new size, which the next round sorts into their ranges;
* where a sweep of all sizes places nothing, the longest waiting pieces open sequences, as many as the
  waiting tokens need at least, and every piece of more than half a sequence.

A sweep puts one piece into a gap, or, of lengths below 1/FEW of a sequence, as many as it holds. There are
at most as many lengths as a sequence has tokens, so the table of runs stays small whatever the corpus; the
driver sees four numbers of each round. Each piece finds its sequence by joining its length and rank.

Null and empty texts are one piece, the end id. Repeated rows and ids are packed as often as they come;
ties go by doc_id (null first), piece and checksum. Other columns of the input play no part. An empty
table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import Scratch, column, map_rows, rows
from .tokens import encoder, vocabulary


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """start and length of each piece of n ids."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    vocab = vocab or vocabulary()
    end = struct.pack("<I", end_id)

    def run(batches: Iterator) -> Iterator[dict]:
        names = ("doc_id", "piece", "start", "length", "ids_crc32")
        out: dict[str, list] = {k: [] for k in names}
        for d, raw in encoder(vocab).stream(rows(batches, 0, 1)):
            raw += end
            for piece, (start, n) in enumerate(cut_points(len(raw) // 4, capacity)):
                for name, v in zip(names, (d, piece, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)])), strict=True):
                    out[name].append(v)
            if len(out["piece"]) >= 4096:
                yield out
                out = {k: [] for k in names}
        yield out

    docs = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    return map_rows(docs, run, "doc_id long,piece int,start long,length long,ids_crc32 long")


#: Ranges of size in the rounds after sequences were opened; the last goes on.
RANGES = (16, 16, 4, 4, 1)
#: Lengths below this part of a sequence fill a gap in one sweep.
FEW = 32
#: Kinds of runs: gaps, pieces that wait, and pieces that got a place.
GAP, WAITS, PLACED = 0, 1, 2

#: size is a gap's or a piece's; first is a sequence or a rank; per pieces lie in each sequence from seq on, at offset.
RUNS = "kind int, size long, first long, many long, per long, seq long, offset long"


def sweep(gaps: list[tuple[int, int, int]], waits: list[tuple[int, int, int]], capacity: int) -> list[tuple]:
    """RUNS after a sweep over those of one range of sizes: (size, first, many) each."""
    gaps, open_, out, at = sorted(gaps, reverse=True), [], [], 0
    for n, rank, left in sorted(waits, reverse=True):
        while at < len(gaps) and gaps[at][0] >= n:
            open_.append(gaps[at])
            at += 1
        while left and open_:
            size, first, many = open_.pop()
            each = size // n if FEW * n <= capacity else 1
            used = min(many, -(-left // each))
            whole, rest = divmod(min(left, used * each), each)
            for start, k, per in ((first, whole, each), (first + whole, int(rest > 0), rest)):
                if k:
                    out.append((PLACED, n, rank, k * per, per, start, capacity - size))
                    if size > n * per:
                        out.append((GAP, size - n * per, start, k, 0, 0, 0))
                    rank, left = rank + k * per, left - k * per
            if used < many:
                open_.append((size, first + used, many - used))
        if left:
            out.append((WAITS, n, rank, left, 0, 0, 0))
    return out + [(GAP, *g, 0, 0, 0) for g in open_ + gaps[at:]]


def swept(runs: DataFrame, ranges: int, capacity: int) -> DataFrame:
    """The runs after a sweep of each range."""
    names = [c.split()[0] for c in RUNS.split(", ")]

    def one(t: pa.Table) -> pa.Table:
        rows_ = list(zip(*(t.column(c).to_pylist() for c in ("kind", "size", "first", "many")), strict=True))
        out = sweep([r[1:] for r in rows_ if r[0] == GAP], [r[1:] for r in rows_ if r[0] == WAITS], capacity)
        kinds = [pa.int32(), *[pa.int64()] * 6]
        return pa.table({c: pa.array([r[i] for r in out], kinds[i]) for i, c in enumerate(names)})

    part = F.floor((F.col("size") - 1) * ranges / capacity)
    return runs.where(F.col("kind") != PLACED).withColumn("part", part).groupBy("part").applyInArrow(one, RUNS)


def opened(runs: DataFrame, k: int, sequences: int, capacity: int) -> DataFrame:
    """The runs after the k longest waiting pieces have opened a sequence each, from number `sequences` on."""
    # a row for each length, at most as many as a sequence has tokens
    before = F.coalesce(F.sum("many").over(W.Window.orderBy(F.desc("size"), "first").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    waits = runs.where(F.col("kind") == WAITS).withColumn("before", before)
    waits = waits.withColumn("take", F.greatest(F.lit(0), F.least(F.col("many"), k - F.col("before"))))
    run = lambda kind, size, first, many, per, seq: F.struct(F.lit(kind).alias("kind"), *(x.cast("long").alias(c) for c, x in zip(("size", "first", "many", "per", "seq", "offset"), (size, first, many, per, seq, F.lit(0)), strict=True)))
    size, first, many, take, seq, none = F.col("size"), F.col("first"), F.col("many"), F.col("take"), F.col("before") + sequences, F.lit(0)
    out = F.array(run(PLACED, size, first, take, F.lit(1), seq), run(GAP, capacity - size, seq, take, none, none), run(WAITS, size, first + take, many - take, none, none))
    after = waits.select(F.explode(out).alias("run")).select("run.*").where("many > 0 and size > 0")
    return after.unionByName(runs.where(F.col("kind") == GAP))


def places(waits: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """size, first, many, per, seq, offset: where pieces go, by intervals of ranks. waits: size, many (a row for each length)."""
    none = [F.lit(0).cast("long").alias(c) for c in ("per", "seq", "offset")]
    runs = scratch.table(waits.select(F.lit(WAITS).alias("kind"), "size", F.lit(0).cast("long").alias("first"), "many", *none), "runs")
    tables, at, sequences, ranges = [runs], 0, 0, 1
    while True:
        of = lambda kind, x: F.coalesce(F.sum(F.when(F.col("kind") == kind, x)), F.lit(0))
        waiting, words, big, placed = runs.agg(of(WAITS, F.col("many")), of(WAITS, F.col("size") * F.col("many")), of(WAITS, F.when(2 * F.col("size") > capacity, F.col("many")).otherwise(0)), of(PLACED, F.col("many"))).first()
        if not waiting:
            return scratch.spark.read.schema(RUNS).parquet(*(t.scratch_path for t in tables)).where(F.col("kind") == PLACED).drop("kind")
        if not placed and ranges == 1:
            k = min(waiting, max(big, -(-words // capacity)))
            runs, at, sequences, ranges = opened(runs, k, sequences, capacity), 0, sequences + k, 0
        else:
            ranges = RANGES[min(at, len(RANGES) - 1)]
            runs, at = swept(runs, ranges, capacity), at + 1
        runs = scratch.table(runs, "runs")
        tables.append(runs)


def ranked(items: DataFrame, scratch: Scratch) -> DataFrame:
    """items with rank, their place among those of their length in the order of (doc_id, piece, ...).

    They are sorted into ranges that keep lengths together: there are at most parts + capacity pairs of a
    part and a length, and that table goes to all executors.
    """
    keys = ["length", "doc_id", "piece", "start", "ids_crc32"]
    ordered = items.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator) -> Iterator[dict]:
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            length = b.column(3).to_numpy()
            place = np.arange(len(length))
            new = np.flatnonzero(np.concatenate([[True], length[1:] != length[:-1]])) if len(length) else np.zeros(0, int)
            base = np.repeat(new, np.diff(np.concatenate([new, [len(length)]])))
            place = place - base
            if len(length):
                if length[0] == last:
                    place[base == 0] += n
                last, n = int(length[-1]), int(place[-1]) + 1
            yield {k: b.column(i) for i, k in enumerate(("doc_id", "piece", "start", "length", "ids_crc32"))} | {"part": np.full(len(length), part), "place": place}

    out = scratch.table(map_rows(ordered.select("doc_id", "piece", "start", "length", "ids_crc32"), run, "doc_id long,piece int,start long,length long,ids_crc32 long,part int,place long"), "ranked")
    before = F.sum("n").over(W.Window.partitionBy("length").orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1))
    begin = out.groupBy("part", "length").agg(F.count("*").alias("n")).select("part", "length", F.coalesce(before, F.lit(0)).alias("begin"))
    return out.join(F.broadcast(scratch.table(begin, "begin")), ["part", "length"]).withColumn("rank", F.col("begin") + F.col("place")).drop("part", "place", "begin")


def pack(items: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """items (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    rows_ = ranked(items, scratch)
    runs = places(items.groupBy(F.col("length").alias("size")).agg(F.count("*").alias("many")), capacity, scratch)
    runs = scratch.table(runs.withColumnRenamed("size", "length").withColumnRenamed("offset", "begin"), "places")
    k = F.col("rank") - F.col("first")
    both = rows_.join(runs, "length").where((F.col("rank") >= F.col("first")) & (k < F.col("many")))
    sequence = F.col("seq") + F.floor(k / F.col("per"))
    return both.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.cast("long").alias("sequence_id"), (F.col("begin") + k % F.col("per") * F.col("length")).alias("offset"))


def best_fit(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", vocab: str | None = None, end_id: int = 0) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.table(pieces(docs, capacity, id_col, text_col, vocab, end_id), "pieces"), capacity, scratch)
