"""Secrets in texts, and how widely each is owned across the corpus.

Base spans are found by three patterns, leftmost and without overlap for each. The candidate value of a
span is hashed; hashes are counted by distinct repositories and owners over the whole corpus. A value that
several owners have is a copied example; one that a single owner has, and that looks random, is a live
credential, and its own place becomes a span of kind live beside the base ones.

A repository is told by its owner and a name within it. Counting goes by (hash, owner, repository), then
(hash, owner), then hash, each with partial sums, so a value in a third of all documents is one row from
each task; joining the verdicts back is left to AQE to split.

Null and empty texts have no spans. A null owner is an owner of its own. Repeated rows stay, and count as
one repository. Positions are code points, ends exclusive. Other columns of the input are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column

#: Fixed patterns: kind, expression, the group that holds the value, its least length, and an expression
#: that every text with such a match has.
NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = [
    ("assign", ASSIGN, 2, 8, ASSIGN[:-2] + "{8})"),
    ("access", "AKIA[A-Z0-9]+", 0, 16, "AKIA[A-Z0-9]{12}"),
    ("hex", "[0-9a-f]+", 0, 32, "[0-9a-f]{32}"),
]
KINDS = [p[0] for p in PATTERNS] + ["live"]

#: Owners from which on a value is a copied example; distinct characters that a random value has at least.
COPIED_OWNERS, LIVE_CHARS = 3, 8


def kind_spans(text: Column, kind: int, pattern: str, group: int, least: int, prefilter: str) -> Column:
    """Array of struct(start, kind, end, value): the matches of a pattern whose value is long enough.

    What lies between the matches gives their places: split and extract_all walk over the same matches.
    """
    quoted = F.lit(pattern)
    parts = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x)).alias("gap"), F.regexp_extract_all(text, quoted, F.lit(0)).alias("hit"), F.regexp_extract_all(text, quoted, F.lit(group)).alias("value"))
    empty = F.expr("cast(struct(0 as at, array() as spans) as struct<at: int, spans: array<struct<start: int, kind: int, end: int, value: string>>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(F.char_length(x["hit"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value")))
        long = F.coalesce(F.char_length(x["value"]) >= least, F.lit(False))
        return F.struct(end.alias("at"), F.when(long, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    found = F.aggregate(parts, empty, step, lambda acc: acc["spans"])
    return F.when(text.rlike(prefilter), found).otherwise(empty["spans"])


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start, then kind."""
    return F.array_sort(F.concat(*(kind_spans(text, k, *p[1:]) for k, p in enumerate(PATTERNS))))


def found(docs: DataFrame, scratch: Scratch, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """row (a number), owner, repo, spans with the hashes of their values: a row for each row of docs."""
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), column(docs, "doc_id").alias("doc_id"), column(docs, owner_col).cast("string").alias("owner"), column(docs, repo_col).cast("string").alias("repo"), text.alias("text"))
    rows = rows.withColumn("spans", base_spans(F.col("text")))
    hashed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"), F.sha2(s["value"], 256).alias("hash")))
    return rows.select("row", "doc_id", "owner", "repo", hashed.alias("spans"))


def ownership(spans: DataFrame) -> DataFrame:
    """hash, n_repos, n_owners, n_chars (distinct characters of the value) from rows of owner, repo and spans."""
    each = spans.where(F.size("spans") > 0).select("owner", "repo", F.explode("spans").alias("s"))
    chars = F.size(F.array_distinct(F.split("s.value", "")))
    each = each.select(F.col("s.hash").alias("hash"), "owner", "repo", chars.alias("n_chars"))
    repos = each.groupBy("hash", "owner", "repo").agg(F.max("n_chars").alias("n_chars"))
    owners = repos.groupBy("hash", "owner").agg(F.count("*").alias("n"), F.max("n_chars").alias("n_chars"))
    return owners.groupBy("hash").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"), F.max("n_chars").alias("n_chars"))


def verdicts(counts: DataFrame, copied_owners: int = COPIED_OWNERS, live_chars: int = LIVE_CHARS) -> DataFrame:
    """counts with verdict: copied (several owners), live (one owner, looks random) or other."""
    live = (F.col("n_owners") == 1) & (F.col("n_chars") >= live_chars)
    return counts.withColumn("verdict", F.when(F.col("n_owners") >= copied_owners, "copied").when(live, "live").otherwise("other"))


def judged(docs: DataFrame, scratch: Scratch, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """The rows of `found` with verdict: a map from the hashes of their candidates."""
    rows = scratch.table(found(docs, scratch, text_col, owner_col, repo_col), "spans")
    say = scratch.table(verdicts(ownership(rows)), "ownership")
    some = rows.where(F.size("spans") > 0).select("row", F.explode(F.array_distinct(F.transform("spans", lambda s: s["hash"]))).alias("hash"))
    some = some.join(say.select("hash", "verdict"), "hash").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("hash", "verdict"))).alias("verdicts"))
    return rows.join(some, "row", "left")


def line(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied (distinct values of a verdict)."""
    rows = judged(docs, Scratch(docs.sparkSession, "secrets"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    is_ = lambda s, v: F.element_at("verdicts", s["hash"]) == v
    place = lambda s: F.struct((s["end"] - F.char_length(s["value"])).alias("start"), F.lit(3).alias("kind"), s["end"].alias("end"))
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    live = F.array_distinct(F.transform(F.filter("spans", lambda s: is_(s, "live")), place))
    values = lambda v: F.coalesce(F.size(F.filter(F.map_values("verdicts"), lambda x: x == v)), F.lit(0)).cast("long")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(line(base), 256).alias("base_sha256"),
        line(F.array_sort(F.concat(base, live))).alias("spans"), values("live").alias("n_live"), values("copied").alias("n_copied"),
    )


def redacted(docs: DataFrame, text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", mark: str = "[secret]") -> DataFrame:
    """docs with every value that isn't a copied example replaced in its text by a mark."""
    scratch = Scratch(docs.sparkSession, "redacted")
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    maybe = text.rlike(PATTERNS[0][4])
    for p in PATTERNS[1:]:
        maybe = maybe | text.rlike(p[4])
    # only what may hold a secret is written down and joined; all other texts stay where they are
    row = F.monotonically_increasing_id().alias("row")
    hashed = F.transform("spans", lambda s: F.struct(s["value"].alias("value"), F.sha2(s["value"], 256).alias("hash")))
    of = lambda name: F.col("doc").getField(name).cast("string")
    rows = docs.where(maybe).select(row, F.struct("*").alias("doc")).withColumn("spans", base_spans(F.coalesce(of(text_col), F.lit(""))))
    rows = scratch.table(rows.withColumns({"spans": hashed, "owner": of(owner_col), "repo": of(repo_col)}), "candidates")
    say = verdicts(ownership(rows)).select(F.col("hash").alias("known"), "verdict")
    some = rows.where(F.size("spans") > 0).select("row", F.explode(F.array_distinct("spans")).alias("s"))
    some = some.join(say, F.col("s.hash") == F.col("known")).where("verdict <> 'copied'").select("row", F.col("s.value").alias("value"))
    # the longest first: a value may hold another
    some = some.groupBy("row").agg(F.sort_array(F.collect_set(F.struct(F.char_length("value").alias("n"), "value")), asc=False).alias("values"))
    clean = F.aggregate("values", of(text_col), lambda acc, v: F.replace(acc, v["value"], F.lit(mark)))
    doc = F.when(F.col("values").isNull(), F.col("doc")).otherwise(F.col("doc").withField(text_col, clean))
    return docs.where(~maybe).unionAll(rows.join(some, "row", "left").select(doc.alias("doc")).select("doc.*"))


SQL = rf"""
WITH p AS (
  SELECT * FROM (VALUES (0, 'assign', $q${ASSIGN}$q$, 2, 8), (1, 'access', 'AKIA[A-Z0-9]+', 0, 16), (2, 'hex', '[0-9a-f]+', 0, 32)) AS p(kind, name, pattern, grp, least)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(0)) AS owner, doc_id AS repo, coalesce(text, '') AS text FROM documents
), m AS (
  SELECT r, owner, repo, 0 AS kind, string_split_regex(text, $q${ASSIGN}$q$) AS gaps, regexp_extract_all(text, $q${ASSIGN}$q$, 0) AS hits, regexp_extract_all(text, $q${ASSIGN}$q$, 2) AS vals FROM d
  UNION ALL SELECT r, owner, repo, 1, string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0) FROM d
  UNION ALL SELECT r, owner, repo, 2, string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+', 0), regexp_extract_all(text, '[0-9a-f]+', 0) FROM d
), e AS (
  SELECT r, owner, repo, kind, unnest(range(1, len(hits) + 1)) AS i, unnest(gaps[:len(hits)]) AS gap, unnest(hits) AS hit, unnest(vals) AS val FROM m
), s AS (
  SELECT r, owner, repo, kind, val, hit,
         sum(length(gap) + length(hit)) OVER (PARTITION BY r, kind ORDER BY i) AS stop
  FROM e
), spans AS (
  SELECT r, owner, repo, kind, val, (stop - length(hit))::BIGINT AS start, stop::BIGINT AS stop
  FROM s WHERE length(val) >= CASE kind WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END
), v AS (
  SELECT val, CASE WHEN count(DISTINCT owner) >= 3 THEN 'copied' WHEN count(DISTINCT owner) = 1 AND len(list_distinct(string_split(val, ''))) >= 8 THEN 'live' ELSE 'other' END AS verdict
  FROM spans GROUP BY val
), every AS (
  SELECT r, kind, start, stop FROM spans
  UNION SELECT r, 3, stop - length(val), stop FROM spans JOIN v USING (val) WHERE verdict = 'live'
), names AS (
  SELECT r, kind, start, stop, CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'live' END || ':' || start || ':' || stop AS s FROM every
), a AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(s, ',' ORDER BY start, kind, stop) AS spans
  FROM names GROUP BY r
), n AS (
  SELECT r, count(DISTINCT val) FILTER (verdict = 'live') AS n_live, count(DISTINCT val) FILTER (verdict = 'copied') AS n_copied FROM spans JOIN v USING (val) GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN a USING (r) LEFT JOIN n USING (r)
"""
