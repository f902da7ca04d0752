"""SimHash fingerprints and their exact links within a radius.

Fingerprints are sorted by population count and cut into tiles. Two fingerprints that differ in r bits
have population counts at most r apart, so pairs of tiles whose counts lie further apart are skipped;
every other pair of tiles is compared in full with numpy's exclusive-or and bit counts. Equal
fingerprints are one node. A tile reports a spanning forest of the links within it, and a pair of tiles one
of what its links add to that, which have the same components as all of them: a group has a link for each
fingerprint and one for each pair of tiles, however many there are of both.

Where documents are to go (one_of_each), fingerprints of several parts only propose: within each group that
a wide radius makes, the sets of shingles themselves are compared, and links are pairs whose Jaccard
similarity is LEAST or more.

Null and empty texts (and those of white space) have fingerprint zero and are linked like any other.
Repeated rows and repeated ids stay separate rows; a null id gets the smallest id it reaches, null if
there is none. Other columns of the input play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.iterate import connected_components

from .common import Scratch, column, join_counted, map_rows

#: Least and most rows of a tile; in between there are about TILES of them.
TILE_LEAST, TILE_MOST, TILES = 8192, 1_000_000, 256

#: Radius up to which tiles are cut into runs of equal counts, each compared with those in reach alone.
RUNS = 8

#: Fingerprints of documents in which near-duplicates are to be found: 64-bit parts, and the bits that may
#: differ in one part and in all. Two texts of similarity j (of their sets of shingles) differ in about
#: acos(2 j / (1 + j)) / pi of all bits: 39 of 256 for 0.8, with a deviation of 6; unrelated ones in half.
#: The bounds lie about four deviations above that: what they let in is compared in full.
PARTS, PART_BITS, ALL_BITS = 4, 22, 64

#: The least similarity of near-duplicates, as a fraction.
LEAST = 4, 5

#: Most nodes and shingles of a block of a group; groups of more are compared by pairs of blocks.
BLOCK_NODES, BLOCK_SHINGLES = 4096, 4_000_000

#: Rows (24 bytes) of documents that go that are sent to all executors; beyond it they are shuffled.
BROADCAST_ROWS = 1_000_000


def spread(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of several hash functions, made from one; the first is that itself."""
    if not k:
        return hashes
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of a text's shingles in order, repeats included."""
    line = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())  # bytes.lower: A-Z only
    if not line:
        return np.zeros(0, "<u8")
    starts = np.flatnonzero(np.frombuffer(line, np.uint8) == 32) + 1
    starts = np.concatenate([[0], starts, [len(line) + 1]])
    n = len(starts) - 1
    begin = starts[: max(1, n - shingle + 1)].tolist()
    end = (starts[min(shingle, n) :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], 42) for a, b in zip(begin, end, strict=True)], "<u8")


def majority(hashes: np.ndarray, parts: int = 1) -> bytes:
    """parts times 64 bits: each is the majority of that bit over all hashes."""
    total = np.zeros(64 * parts, np.int64)
    for k in range(parts):
        for at in range(0, len(hashes), 8192):
            bits = np.unpackbits(spread(hashes[at : at + 8192], k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total[64 * k : 64 * k + 64] += bits.sum(0, dtype=np.int32)
    return np.packbits(2 * total > len(hashes), bitorder="little").tobytes()


def fingerprint(text: str | None, shingle: int = 3, parts: int = 1) -> bytes:
    """The majority of each bit over the hashes of all shingles, repeats included."""
    return majority(shingles(text, shingle), parts)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, parts: int = 1, key: F.Column | None = None) -> DataFrame:
    """doc_id, fp (the first 64 bits as a signed long), rest (the other parts' bytes), node (a number for
    what is one node), size (its shingles) and key, a long passed on: a row for each row of docs.

    A fingerprint of one part counts repeated shingles and is its own node. One of several parts is that of
    the set of shingles, and the set is the node.
    """

    def run(batches: Iterator) -> Iterator[dict]:
        for b in batches:
            sets = [shingles(t, shingle) for t in b.column(1).to_pylist()]
            if parts > 1:
                sets = [np.unique(x) for x in sets]
            all_ = [majority(x, parts) for x in sets]
            fp = np.frombuffer(b"".join(x[:8] for x in all_), "<i8")
            node = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], "<u8").view("<i8") if parts > 1 else fp
            yield {"doc_id": b.column(0), "fp": fp, "rest": [x[8:] for x in all_], "node": node, "size": [len(x) for x in sets], "key": b.column(2)}

    key = F.lit(0).cast("long") if key is None else key
    return map_rows(docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"), key.alias("key")), run, "doc_id long,fp long,rest binary,node long,size long,key long")


class Forest:
    """Components of nodes 0..n-1 under links that come in blocks."""

    def __init__(self, n: int, roots: np.ndarray | None = None):
        self.parent = np.arange(n) if roots is None else roots.copy()

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        parent = self.parent
        while len(a):
            ra, rb = parent[a], parent[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while not np.array_equal(up := parent[parent], parent):
                parent[:] = up


def spans(x: np.ndarray, right: np.ndarray, radius: int, within: bool) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of x and of right, both sorted, outside of which no two fingerprints lie within the radius."""
    if radius > RUNS:  # too wide to leave anything out
        yield 0, len(x), 0, len(right)
        return
    order = np.bitwise_count(right).astype(np.int64) * 64 + np.bitwise_count(right >> np.uint64(32))
    mine = np.bitwise_count(x).astype(np.int64) * 64 + np.bitwise_count(x >> np.uint64(32))
    cuts = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1], [True]]))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        p, h = divmod(int(mine[lo]), 64)
        for q in range(p if within else max(0, p - radius), p + radius + 1):
            # what the halves' counts differ by in sum is a lower bound of the differing bits
            slack = (radius - abs(q - p)) // 2
            h_lo, h_hi = h + min(0, q - p) - slack, h + max(0, q - p) + slack
            a, b = np.searchsorted(order, [q * 64 + max(0, h_lo), q * 64 + min(63, h_hi) + 1])
            if a < b:
                yield lo, hi, int(a), int(b)


def compare_tiles(x: np.ndarray, y: np.ndarray | None, radius: int, total: int | None = None, roots: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Spanning links between (or, with y None, within) two sorted tiles, as positions in x followed by y.

    A tile has a row for each fingerprint and a column for each part. A link is at most `radius` bits in
    every part and `total` in all. roots: the least position that each is known to be linked with; links
    are those of roots alone.
    """
    right, shift = (x, 0) if y is None else (y, len(x))
    forest = Forest(len(x) + (0 if y is None else len(y)), roots)
    before = forest.parent.copy()
    for lo, hi, a, b in spans(x[:, 0], right[:, 0], radius, y is None):
        step = max(1, 1_000_000 // (b - a))
        for i in range(lo, hi, step):
            r, c = np.nonzero(np.bitwise_count(x[i : min(hi, i + step), 0][:, None] ^ right[None, a:b, 0]) <= radius)
            if len(r) and x.shape[1] > 1:
                apart = np.bitwise_count(x[r + i] ^ right[c + a])
                near = (apart.max(1) <= radius) & (apart.sum(1, dtype=np.int64) <= total)
                r, c = r[near], c[near]
            if len(r):
                forest.link(r + i, c + (a + shift))
    child = np.flatnonzero((forest.parent != before) & (before == np.arange(len(before))))
    if len(child):
        yield child, forest.parent[child]


def links(nodes: DataFrame, scratch: Scratch, radius: int = 3, parts: int = 1, total: int | None = None) -> DataFrame:
    """u, v: links of distinct fingerprints (columns fp, rest, node) that span every component."""
    n = nodes.count()
    tile_rows = min(TILE_MOST, max(TILE_LEAST, n // TILES))
    halves = F.bit_count(F.shiftrightunsigned("fp", 32))
    ordered = nodes.select("fp", "rest", "node", F.bit_count("fp").cast("int").alias("pop"), halves.cast("int").alias("half"))
    ordered = ordered.repartitionByRange(max(1, -(-n // tile_rows)), "pop", "half", "fp").sortWithinPartitions("pop", "half", "fp")

    def cut(batches: Iterator) -> Iterator[dict]:
        from pyspark import TaskContext

        part, k, held = TaskContext.get().partitionId(), 0, []

        def tile(rows: np.ndarray) -> dict:
            pops, roots = np.bitwise_count(rows[:, 0]), np.arange(len(rows), dtype=np.int32)
            for u, v in compare_tiles(rows[:, :parts], None, radius, total):
                roots[u] = v
            return {"tile": [part * 1_000_000 + k], "lo": [int(pops[0])], "hi": [int(pops[-1])], "fps": [rows[:, :parts].tobytes()], "ids": [rows[:, parts].tobytes()], "roots": [roots.tobytes()]}

        for b in batches:
            rows = np.empty((b.num_rows, parts + 1), np.uint64)
            rows[:, 0] = b.column(0).to_numpy().astype(np.int64).view(np.uint64)
            rows[:, 1:parts] = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(b.num_rows, parts - 1)
            rows[:, parts] = b.column(2).to_numpy().astype(np.int64).view(np.uint64)
            held.append(rows)
            if sum(map(len, held)) >= tile_rows:
                rows = np.concatenate(held)
                while len(rows) >= tile_rows:
                    yield tile(rows[:tile_rows])
                    rows, k = rows[tile_rows:], k + 1
                held = [rows]
        rows = np.concatenate([*held, np.zeros((0, parts + 1), np.uint64)])
        if len(rows):
            yield tile(rows)

    tiles = scratch.table(map_rows(ordered, cut, "tile long,lo int,hi int,fps binary,ids binary,roots binary"), "tiles")
    # tiles follow each other in order of population count: near ones meet at a count
    a = tiles.select(F.col("tile").alias("a"), F.explode(F.sequence("lo", F.col("hi") + radius)).alias("pop"))
    b = tiles.select(F.col("tile").alias("b"), F.explode(F.sequence("lo", "hi")).alias("pop"))
    pairs = scratch.table(a.join(b, "pop").where("a < b").select("a", "b").distinct(), "pairs")
    # one tile of a pair stays at home, the other comes to it: each pair moves one tile
    home = F.pmod(F.xxhash64("a", "b"), F.lit(2)) == 0
    pairs = pairs.select(F.when(home, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(home, F.col("b")).otherwise(F.col("a")).alias("b"))
    tasks = max(1, min(2000, 2 * tiles.count()))
    here = tiles.select(F.col("tile").alias("a"), F.col("fps").alias("x"), F.col("ids").alias("x_ids"), F.col("roots").alias("x_roots")).repartition(tasks, "a")
    both = pairs.join(tiles.select(F.col("tile").alias("b"), F.col("fps").alias("y"), F.col("ids").alias("y_ids"), F.col("roots").alias("y_roots")), "b")
    both = both.repartition(tasks, "a").join(here, "a").select("a", "b", "x", "y", "x_ids", "y_ids", "x_roots", "y_roots")

    def compare(batches: Iterator) -> Iterator[dict]:
        matrix = lambda raw: np.frombuffer(raw, np.uint64).reshape(-1, parts)
        for batch in batches:
            for a, b, x, y, x_ids, y_ids, x_roots, y_roots in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if a > b:  # roots lie in the earlier tile: links of a group then name few of them
                    x, y, x_ids, y_ids, x_roots, y_roots = y, x, y_ids, x_ids, y_roots, x_roots
                x, y, ids = matrix(x), matrix(y), np.frombuffer(x_ids + y_ids, np.int64)
                roots = np.concatenate([np.frombuffer(x_roots, np.int32), np.frombuffer(y_roots, np.int32) + len(x)])
                for u, v in compare_tiles(x, y, radius, total, roots):
                    yield {"u": ids[u], "v": ids[v]}

    def inside(batches: Iterator) -> Iterator[dict]:
        for batch in batches:
            for ids, roots in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                ids, roots = np.frombuffer(ids, np.int64), np.frombuffer(roots, np.int32)
                child = np.flatnonzero(roots != np.arange(len(roots)))
                yield {"u": ids[child], "v": ids[roots[child]]}

    return map_rows(tiles.select("ids", "roots"), inside, "u long,v long").unionAll(map_rows(both, compare, "u long,v long"))


def grouped(fps: DataFrame, scratch: Scratch, radius: int, parts: int = 1, total: int | None = None) -> DataFrame:
    """node, component (one number for all fingerprints that links connect)."""
    nodes = scratch.table(fps.groupBy("node").agg(F.first("fp").alias("fp"), F.first("rest").alias("rest")), "nodes")
    edges = scratch.table(links(nodes, scratch, radius, parts, total), "links")
    labels = connected_components(edges, scratch)  # id, component: of fingerprints that have links
    labels = nodes.select("node").join(labels.withColumnRenamed("id", "node"), "node", "left")
    return scratch.table(labels.select("node", F.coalesce("component", "node").alias("component")), "labelled")


def alike(sets: list[np.ndarray], cut: int = 0, label: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Components of sets of hashes under links of similarity LEAST or more, as positions; those of two or more.

    With a cut, sets of equal label are linked beforehand, and only sets before the cut are compared with
    those from there on.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mine = np.split(flat, np.cumsum(sizes)[:-1])
    mark, left = np.zeros(len(known), bool), np.ones(n, bool)
    label = np.arange(n) if label is None else label
    for first in range(n):
        if not left[first]:
            continue
        found, at = np.flatnonzero(label == label[first]).tolist() if cut else [first], 0
        left[found] = False
        while at < len(found) and left.any():
            i = found[at]
            at += 1
            middle = np.searchsorted(owner, cut) if cut else 0
            others = slice(middle, None) if i < cut or not cut else slice(0, middle)
            mark[mine[i]] = True
            both = np.bincount(owner[others][mark[flat[others]]], minlength=n)
            mark[mine[i]] = False
            near = np.flatnonzero(left & (LEAST[1] * both >= LEAST[0] * (sizes + sizes[i] - both)))
            if len(near):
                near = np.flatnonzero(left & np.isin(label, label[near])) if cut else near
                found += near.tolist()
                left[near] = False
                stay = left[owner]
                owner, flat = owner[stay], flat[stay]
        if len(found) > 1:
            yield np.array(found)


def spanning(sets: list[np.ndarray], cut: int, report: tuple[bool, bool]) -> Iterator[tuple[np.ndarray, int]]:
    """Links that span what is alike among two blocks of sets, as positions and one they are linked with: those
    within a block if it is reported, and what links between the blocks (divided at cut) add."""
    label = np.arange(len(sets))
    for (lo, hi), wanted in zip(((0, cut), (cut, len(sets))), report, strict=True):
        for found in alike(sets[lo:hi]) if hi - lo > 1 else ():
            found = np.sort(found) + lo
            label[found] = found[0]
            if wanted:
                yield found[1:], found[0]
    if 0 < cut < len(sets):
        for found in alike(sets, cut, label):
            roots = np.unique(label[found])
            if len(roots) > 1:
                yield roots[1:], roots[0]


def verified(docs: DataFrame, rows: DataFrame, scratch: Scratch, id_: F.Column, key: F.Column, text: F.Column, shingle: int) -> DataFrame:
    """u, v: links that span the components of nodes whose sets of shingles are alike, within each component
    of rows (component, node, size, doc_id, key). Each node's text is read from one of its rows in docs."""
    nodes = rows.groupBy("component", "node").agg(F.first("size").alias("size"), F.min(F.struct("doc_id", "key")).alias("who"))
    nodes = scratch.table(nodes, "members")
    groups = nodes.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("all"))
    groups = scratch.table(groups.where("n > 1"), "groups")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("all") / BLOCK_SHINGLES)).cast("int")
    nodes = join_counted(nodes, groups.select("component", blocks.alias("k"), "n"), ["component"])
    nodes = scratch.table(nodes.select("component", "k", "node", F.col("who.doc_id").alias("known_id"), F.col("who.key").alias("known_key")), "proposed")
    near = F.broadcast if nodes.count() <= BROADCAST_ROWS else (lambda df: df)
    read = docs.select(id_.alias("id"), key.alias("key"), text.alias("text"))
    read = read.join(near(nodes), F.col("id").eqNullSafe(F.col("known_id")) & (F.col("key") == F.col("known_key")))
    # a node comes to every pair of blocks that has its own
    mine = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    others = F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("k") - 1), F.col("mine")))
    read = read.withColumn("mine", mine).withColumn("other", F.explode(others))
    read = read.select("component", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine", "node", "text")
    read = read.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b", "mine", "node")

    def compare(batches: Iterator) -> Iterator[dict]:
        group, ids, sets, cut = None, [], [], 0

        def done() -> Iterator[dict]:
            # each block's own links come from one pair: the first's from (0, 1), another's from its pair with the first
            report = (group[2] <= 1, group[1] == 0) if group else ()
            for u, v in spanning(sets, cut, report) if len(sets) > 1 else ():
                of = np.array(ids, np.int64)
                yield {"u": of[u], "v": np.full(len(u), of[v])}

        for batch in batches:
            for component, a, b, mine, node, text in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (component, a, b) != group:
                    yield from done()
                    group, ids, sets, cut = (component, a, b), [], [], 0
                if not ids or node != ids[-1]:  # a row may repeat
                    ids.append(node)
                    sets.append(np.unique(shingles(text, shingle)))
                    cut += mine == a < b
        yield from done()

    return map_rows(read, compare, "u long,v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp (long), component_id: the smallest doc_id that links of at most `radius` bits reach."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.table(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    labels = grouped(fps, scratch, radius)
    least = fps.groupBy("node").agg(F.min("doc_id").alias("least")).join(labels, "node")
    least = least.groupBy("component").agg(F.min("least").alias("component_id"))
    return fps.join(labels.join(least, "component").select("node", "component_id"), "node").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, parts: int = PARTS, radius: int = PART_BITS, total: int = ALL_BITS) -> DataFrame:
    """The rows of docs, with their columns as they are, one from each group of near-duplicates: that of the
    smallest id (null last, ties by a hash of the text, one row if it repeats).

    Groups are made by links between texts whose sets of five-word shingles have a similarity of LEAST or
    more; fingerprints of 256 bits propose what to compare. With one part, the radius alone makes links.
    """
    scratch = Scratch(docs.sparkSession, "one-of-each")
    key = F.xxhash64(F.coalesce(column(docs, text_col).cast("string"), F.lit("")))
    id_ = column(docs, id_col).cast("long")
    fps = scratch.table(fingerprints(docs, id_col, text_col, shingle, parts, key), "fingerprints")
    labels = grouped(fps, scratch, radius, parts, total)
    rows = fps.groupBy("node", "doc_id", "key").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    if parts > 1:
        edges = verified(docs, rows.join(labels, "node"), scratch, id_, key, column(docs, text_col), shingle)
        same = connected_components(scratch.table(edges, "verified"), scratch)
        labels = labels.select("node").join(same.withColumnRenamed("id", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    rows = rows.join(labels, "node")
    rows = scratch.table(rows.select("component", F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key").alias("who"), F.col("n").alias("times")), "rows")
    first = scratch.table(rows.groupBy("component").agg(F.min("who").alias("first"), F.count("*").alias("n")), "first")
    judged = join_counted(rows, first, ["component"]).select(F.col("who.doc_id").alias("known_id"), F.col("who.key").alias("known_key"), (F.col("who") != F.col("first")).alias("goes"), "times")
    # a row for each id and text that goes, or that comes several times
    judged = scratch.table(judged.where("goes or times > 1"), "judged")
    total = judged.count()
    goes, more = judged.where("goes"), judged.where("not goes")
    near = F.broadcast if total <= BROADCAST_ROWS else (lambda df: df)
    on = id_.eqNullSafe(F.col("known_id")) & (key == F.col("known_key"))
    kept = docs.join(near(goes), on, "left_anti")
    if more.isEmpty():
        return kept
    once = docs.join(near(more), on, "left_semi").select(F.struct("*").alias("doc"), id_.alias("id"), key.alias("key"))
    once = once.groupBy("id", "key").agg(F.any_value("doc").alias("doc")).select("doc.*")
    return kept.join(near(more), on, "left_anti").unionAll(once)


def fingerprint_hex(fp: str = "fp") -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
