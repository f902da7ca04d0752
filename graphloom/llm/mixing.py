"""Mixing sources to target weights, along a curriculum.

Each source's share of the mix is a weight that changes over training: a linear schedule from its start to
its end. Its integral, scaled to the words the source is to give, is the source's demand; inverting it
turns the number of words taken so far into the position (0 to 1) at which the next document of the source
is trained on. Documents of a source come in the order of a hash of their ids, epoch by epoch; whole epochs
are taken first, then documents up to the target. Sorting by position interleaves the sources.

Running sums over a source are made in two steps, over 2**BUCKET_BITS ranges of the hash and within each, so that
no task holds a source, however large.

A null or blank text has size zero: such documents are taken as often as their source's epochs, and count
nothing. Sources come in order of code points, null last. Ids order documents only by their hash; repeated
rows are taken each, ties go by doc_id, then size. Other columns of the input play no part in
`ordered`, and are passed on by `mixture`. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import Scratch, column, words

#: Weights of the sources in turn, words of the mix by those there are, and times a source may be used.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Start and end of the sources' schedules in turn: what each weight is multiplied by.
SCHEDULES = ((1.0, 1.0), (0.5, 1.5), (1.5, 0.5))
#: Ranges of the hash by which a source's sums are made.
BUCKET_BITS = 12


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, schedules: tuple[tuple[float, float], ...] = SCHEDULES) -> DataFrame:
    """sizes (source, source_size and more) with target, a, b (start and end of its schedule).

    Shares go by weight; a source stops at `most` times its size, and what is above goes to the others by
    weight, until none is above. So, in order of size by weight, the sources up to some point are full and
    the others share what is left. A row for each source: its windows see no documents.
    """
    at = F.row_number().over(W.Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("at") % len(values) + 1).cast("int"))
    df = sizes.withColumn("at", at).select(*sizes.columns, pick(weights).alias("weight"), pick([s[0] for s in schedules]).alias("a"), pick([s[1] for s in schedules]).alias("b"))
    order = W.Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = W.Window.partitionBy()
    df = df.withColumns({
        "full": F.coalesce(F.sum("source_size").over(order.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)) * most,
        "rest": F.sum("weight").over(order.rowsBetween(W.Window.currentRow, W.Window.unboundedFollowing)),
        "total": F.sum("source_size").over(whole).cast("double") * F.lit(share),
    })
    # the level if all before this source are full; the first that isn't sets it for all that follow
    df = df.withColumn("level", (F.col("total") - F.col("full")) / F.col("rest"))
    df = df.withColumn("is_full", F.col("level") * F.col("weight") >= F.col("source_size") * most)
    df = df.withColumn("level", F.min(F.when(~F.col("is_full"), F.struct(F.col("full"), F.col("level"))).otherwise(None)).over(whole)["level"])
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), (F.col("source_size") * most).cast("double")), (F.col("source_size") * most).cast("double"))
    return df.select(*sizes.columns, target.alias("target"), "a", "b")


def position(before: Column, target: Column, a: Column, b: Column) -> Column:
    """When, from 0 to 1, a source has given `before` words: the root t of a t + (b - a) t**2 / 2 = before / target * (a + b) / 2."""
    y = F.when(target > 0, before / target).otherwise(F.lit(0.0)) * (a + b) / 2
    y = F.least(y, (a + b) / 2)
    return F.when(a == b, y / a).otherwise((F.sqrt(a * a + 2 * (b - a) * y) - a) / (b - a))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """doc_id, source, known (the source, never null), size, hash and bucket of each row of docs, and more columns."""
    size = F.size(words(column(docs, text_col).cast("string"))).cast("long")
    id_, source = column(docs, id_col).cast("long"), column(docs, source_col).cast("string")
    digits = F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit(""))), 1, 15)
    known = F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))  # not null: one partitioning serves window and join
    rows = docs.select(id_.alias("doc_id"), source.alias("source"), known.alias("known"), size.alias("size"), F.conv(digits, 16, 10).cast("long").alias("hash"), *more)
    return rows.withColumn("bucket", F.shiftright("hash", 60 - BUCKET_BITS))


def training_order(rows: DataFrame, sums: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (as of `sized`) with source_size, target, copies, taken, first and next (positions of the first
    copy and of the second; null if there is none). sums: known, source, bucket, in_bucket (words)."""
    names = [c for c in rows.columns if c not in ("hash", "bucket", "known")]
    sums = scratch.table(sums, "buckets")
    of = sums.groupBy("known").agg(F.first("source").alias("source"), F.sum("in_bucket").alias("source_size"))
    of = scratch.table(targets(of), "targets")
    before = F.sum("in_bucket").over(W.Window.partitionBy("known").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, -1))
    sums = sums.select("known", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    # a row for each source and bucket: 4096 times the sources, whatever there are of documents
    sums = sums.join(of.select("known", "source_size", "target", "a", "b"), "known")
    within = W.Window.partitionBy("known", "bucket").orderBy("hash", "doc_id", "size").rowsBetween(W.Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, ["known", "bucket"])
    rows = rows.withColumn("before", F.col("base") + F.col("before"))
    total = F.col("source_size")
    epochs = F.when(total > 0, F.floor(F.col("target") / total)).otherwise(F.lit(1)).cast("long")
    rest = F.col("target") - epochs * total
    more = (F.col("size") > 0) & (F.col("before") + F.col("size") / 2 <= rest)
    rows = rows.withColumn("copies", (epochs + F.when(more, 1).otherwise(0)).cast("int"))
    when = lambda done: position((F.col("before") + done).cast("double"), F.col("target"), F.col("a"), F.col("b"))
    return rows.select(
        *names, "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        F.when(F.col("copies") > 0, when(F.lit(0))).alias("first"), F.when(F.col("copies") > 1, when(total)).alias("next"),
    )


def bucket_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("known", "bucket").agg(F.first("source").alias("source"), F.sum("size").alias("in_bucket"))


def ordered(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """training_order of docs: doc_id, source, size and what it adds."""
    rows = scratch.table(sized(docs, id_col, text_col, source_col), "sizes")
    return training_order(rows, bucket_sums(rows), scratch)


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, as often as the mix takes them, in training order (ranges of position).

    Texts move twice: to their source's bucket, and to their position.
    """
    scratch = Scratch(docs.sparkSession, "mixture")
    sums = bucket_sums(sized(docs, id_col, text_col, source_col))
    order = training_order(sized(docs, id_col, text_col, source_col, F.struct("*").alias("doc")), sums, scratch)
    times = order.select("doc", "doc_id", F.explode(F.array_compact(F.array("first", "next"))).alias("at"))
    return times.repartitionByRange("at", "doc_id").sortWithinPartitions("at", "doc_id").select("doc.*")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, first and second (positions of a document's copies, null if there is
    none), in ranges of the first position."""
    order = ordered(docs, Scratch(docs.sparkSession, "mixing")).repartitionByRange("first", "doc_id").sortWithinPartitions("first", "doc_id")
    at = lambda c, name: (F.round(c, 9) + 0.0).alias(name)
    return order.select("doc_id", "size", "source_size", "target", "taken", at("first", "first"), at("next", "second"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hash
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CASE n % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         CASE n % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 1.5::DOUBLE END AS a,
         CASE n % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS b
  FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2)
            / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level,
         source_size::DOUBLE / weight AS ratio
  FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)
), t AS (
  SELECT source, source_size, a, b,
         least(coalesce((SELECT arg_min(level, ratio) FROM l WHERE level * weight < source_size * 2) * weight, source_size * 2.0::DOUBLE), source_size * 2.0::DOUBLE) AS target
  FROM l
), r AS (
  SELECT d.doc_id, d.size, t.*, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY hash, d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 1 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, epochs + CASE WHEN size > 0 AND before + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END AS copies,
         least(CASE WHEN target > 0 THEN before::DOUBLE / target ELSE 0.0::DOUBLE END * (a + b) / 2, (a + b) / 2) AS y,
         least(CASE WHEN target > 0 THEN (before + source_size)::DOUBLE / target ELSE 0.0::DOUBLE END * (a + b) / 2, (a + b) / 2) AS z
  FROM r
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken,
       round(CASE WHEN copies = 0 THEN NULL WHEN a = b THEN y / a ELSE (sqrt(a * a + 2 * (b - a) * y) - a) / (b - a) END, 9) + 0.0 AS first,
       round(CASE WHEN copies < 2 THEN NULL WHEN a = b THEN z / a ELSE (sqrt(a * a + 2 * (b - a) * z) - a) / (b - a) END, 9) + 0.0 AS second
FROM c
"""
