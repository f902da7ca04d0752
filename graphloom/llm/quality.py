"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document; the ledger keeps what was measured and one integer whose
bits say which rules failed. A policy is a mask of the bits that count, so policies of any version, and
what each rule adds to one, come from the ledger by bitwise operations, without the texts.

Null, empty and blank texts have no words: they fail FEW_WORDS and no other rule. Repeated rows stay. Other
columns are passed on by `ledger` unless they clash with its own. An empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, words

#: Rules by name: their bit and when they fail. The first two are the base rules.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (1, "n_words < 20"),
    "repeated_words": (2, "100 * n_repeat_words > 30 * n_words"),
    "symbols": (4, "10 * n_symbols > n_words"),
    "capitals": (8, "100 * n_capitals > 30 * word_chars"),
    "doubled_words": (16, "100 * n_doubled > 30 * n_words"),
    "repeated_lines": (32, "2 * n_dup_lines > n_lines"),
    "word_length": (64, "word_chars < 2 * n_words or word_chars > 20 * n_words"),
}
BASE = RULES["few_words"][0] | RULES["repeated_words"][0]
#: Policies by version.
POLICIES = {"base": BASE, "v1": BASE | 4 | 8 | 16, "strict": 127}

MEASURES = ["n_words", "word_chars", "n_symbols", "n_capitals", "n_doubled", "n_lines", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame, text_col: str = "text", window: int = 8) -> DataFrame:
    """docs with MEASURES; array columns that several expressions read are made once."""
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    # an array of hashes keeps what is compared small; windows are hashed from their words' hashes
    df = docs.withColumns({"_text": text, "_words": words(text)})
    df = df.withColumns({
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    df = df.withColumn("_windows", F.expr(f"transform(if(size(_hashes) < {window}, array(), sequence(1, size(_hashes) - {window - 1})), i -> xxhash64(slice(_hashes, i, {window})))"))
    # (hash, position) in order of hash, where any window recurs; equal hashes are neighbours then
    df = df.withColumn("_sorted", F.expr("if(size(array_distinct(_windows)) < size(_windows), array_sort(transform(_windows, (h, i) -> struct(h, i))), array())"))
    df = df.withColumn("_twice", F.expr("array_sort(transform(filter(_sorted, (x, k) -> (k > 0 and get(_sorted, k - 1).h = x.h) or (k < size(_sorted) - 1 and get(_sorted, k + 1).h = x.h)), x -> x.i))"))
    covered = f"aggregate(transform(_twice, (p, k) -> if(k = size(_twice) - 1, {window}, least({window}, get(_twice, k + 1) - p))), 0L, (a, x) -> a + x)"
    found = {
        "n_words": F.size("_words"),
        "word_chars": F.char_length(F.array_join("_words", "")),
        "n_symbols": F.char_length("_text") - F.char_length(F.regexp_replace("_text", r"[#*$%&|<>]+", "")),
        "n_capitals": F.char_length(F.regexp_replace("_text", "[^A-Z]+", "")),
        "n_doubled": F.expr("size(filter(_hashes, (h, i) -> i > 0 and h = get(_hashes, i - 1)))"),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.expr(covered),
    }
    return df.withColumns({k: v.cast("long") for k, v in found.items()}).drop("_text", "_words", "_hashes", "_lines", "_windows", "_sorted", "_twice")


def ledger(docs: DataFrame, text_col: str = "text", rules: dict[str, tuple[int, str]] = RULES) -> DataFrame:
    """docs with MEASURES and failures, the bits of the rules that failed."""
    bits = [F.when(F.expr(when), F.lit(bit)).otherwise(F.lit(0)) for bit, when in rules.values()]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    # always zero, but not to be foretold: else a filter on failures would be moved below the arrays that
    # the measures are made from, and make them anew for each of their elements
    zero = F.shiftright(F.monotonically_increasing_id(), 63).cast("int")
    return measured(docs, text_col).withColumn("failures", out.bitwiseOR(zero))


def passes(mask: int) -> Column:
    """Whether a row of a ledger passes the policy of this mask."""
    return F.col("failures").bitwiseAND(F.lit(mask)) == 0


def ablation(of: DataFrame, policies: dict[str, int] = POLICIES, rules: dict[str, tuple[int, str]] = RULES) -> DataFrame:
    """policy, rule, n_failed, n_alone (that no other rule of the policy rejects), n_kept (by the policy),
    n_kept_without (if the rule were left out).

    One pass counts the rows of each pattern of bits; there are 2**rules patterns at most.
    """
    patterns = of.groupBy("failures").agg(F.count("*").alias("n"))
    pairs = [F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask).alias("mask"), F.lit(bit).alias("bit")) for p, mask in policies.items() for r, (bit, _) in rules.items() if mask & bit]
    each = patterns.withColumn("x", F.explode(F.array(*pairs))).select("failures", "n", "x.*")
    f, mask, bit = F.col("failures"), F.col("mask"), F.col("bit")
    of_policy = f.bitwiseAND(mask)
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("policy", "rule").agg(
        total(f.bitwiseAND(bit) != 0).alias("n_failed"),
        total(of_policy == bit).alias("n_alone"),
        total(of_policy == 0).alias("n_kept"),
        total(of_policy.bitwiseAND(F.bitwise_not(bit)) == 0).alias("n_kept_without"),
    )


def accepted(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns as they are, that pass a policy."""
    of = docs.select(F.struct("*").alias("doc"), column(docs, text_col).alias("text"))
    return ledger(of).where(passes(POLICIES[policy])).select("doc.*")


def digest(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """doc_id and its ledger (MEASURES, failures), with base_failed and kept by a policy."""
    out = ledger(docs.select("doc_id", "text"))
    return out.select("doc_id", *MEASURES, "failures", (~passes(BASE)).alias("base_failed"), passes(POLICIES[policy]).alias("kept"))


#: The same by brute force over the words themselves.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT r, i, list_slice(w, i, i + 7) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), covered AS (
  SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS k FROM twice) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(list_aggregate(w, 'string_agg', ''))::BIGINT AS wc,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
         length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_doubled,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered USING (r)
), f AS (
  SELECT *, coalesce(wc, 0) AS word_chars,
         (CASE WHEN n_words < 20 THEN 1 ELSE 0 END)
         + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
         + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
         + (CASE WHEN 100 * n_capitals > 30 * coalesce(wc, 0) THEN 8 ELSE 0 END)
         + (CASE WHEN 100 * n_doubled > 30 * n_words THEN 16 ELSE 0 END)
         + (CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END)
         + (CASE WHEN coalesce(wc, 0) < 2 * n_words OR coalesce(wc, 0) > 20 * n_words THEN 64 ELSE 0 END) AS failures
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_capitals, n_doubled, n_lines, n_dup_lines, n_repeat_words,
       (failures & 3) <> 0 AS base_failed, (failures & 31) = 0 AS kept, failures::INTEGER AS failures
FROM f
"""
