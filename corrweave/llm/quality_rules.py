"""Quality rules as a bitmask ledger (DataFrame functions only).

`ledger()` measures every text once and stores the measurements together with
one integer of failure bits, a bit for each rule. A policy is a versioned mask
of rules: `apply_policy()` and `ablation()` only look at the bits, so a policy
can be changed, or a rule's marginal effect counted, without reading a text
again.

The plan is a projection over the scan: no shuffle, no broadcast and no state
across rows, so one hot source or group of copies cannot skew it.

Defined cases: a null text has no words (it fails `few_words`); null doc_ids
and repeated rows are measured like any others, row by row; an empty table
gives an empty ledger; further columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, WHITE, table, words

SYMBOLS = "#*$%&|<>"

#: name -> condition over the measurements under which the rule fails; a rule's bit is its place here.
RULES = {
    "few_words": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_word_lines",
    "capitals": "100 * n_capitals > 30 * word_chars",
    "word_length": "word_chars < 2 * n_words OR word_chars > 16 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}

#: Versioned policies: the rules that reject a document.
POLICIES = {
    "base": ("few_words", "repetitive"),
    "v1": tuple(RULES),
}
PRODUCTION = "v1"


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def _repeat_words(w: Column, g: Column) -> Column:
    """Words inside a 3-word window whose hash occurs twice or more.

    Windows are sorted by (hash, place), so equal ones are neighbours; the
    places of repeated windows, in order, then cover min(3, gap to the next)
    words each. Linear but for the sort, and only texts with a repeat sort.
    """
    s = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        marked = F.transform(
            s,
            lambda x, k: F.when(
                (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"]
            ),
        )
        return F.array_sort(F.filter(marked, lambda p: p.isNotNull()))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    # A one-element array stands for a let-binding: each step is computed once.
    bound = F.transform(F.array(s), lambda s1: places(s1))
    counted = F.get(F.transform(bound, lambda p: covered(p)), F.lit(0))
    return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(counted)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements, one row for each row of `docs`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, WHITE, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    first = docs.select(
        F.col("doc_id"),
        words(F.col("text")).alias("w"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, UPPER, ""))).cast("long").alias("n_capitals"),
        lines.alias("l"),
    )
    w = F.col("w")
    hashes = F.when(
        F.size(w) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    second = first.withColumn("g", hashes)
    measured = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.col("word_chars"),
        F.col("n_symbols"),
        F.col("n_capitals"),
        F.size("l").cast("long").alias("n_word_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _repeat_words(w, F.col("g")).cast("long").alias("n_repeat_words"),
    )
    # A one-row generator: filters on the ledger can't be pushed below it, where they would measure anew for each rule.
    return second.select("doc_id", F.explode(F.array(measured)).alias("m")).select("doc_id", "m.*")


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and `fail_bits`: every rule is evaluated once."""
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()]
    return measure(docs).withColumn("fail_bits", reduce(lambda a, b: a.bitwiseOR(b), bits))


def apply_policy(led: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """`kept`: no rule of the policy failed."""
    return led.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(led: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """For each rule of the policy: documents that fail it, and documents that only it rejects.

    The ledger is first folded to its distinct bit patterns (2 to the number
    of rules at most), so the aggregate shuffles a handful of rows.
    """
    by_bits = led.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    m = mask(policy)
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in POLICIES[policy]]))
    x = by_bits.select("fail_bits", "n", rules.alias("r"))
    failed = F.col("fail_bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("fail_bits").bitwiseAND(F.lit(m)) == F.col("r.bit")
    return x.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(failed, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = apply_policy(ledger(table(spark, sf_dir, "documents")))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask("base"))) != 0
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept", "fail_bits",
    )


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, w,
         CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
         CAST(len(l) AS BIGINT) AS n_word_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines
  FROM d
), g AS (
  SELECT doc_id, i, list_slice(w, i, i + 2) AS v FROM (SELECT doc_id, w, unnest(range(1, n_words - 1)) AS i FROM m)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, v) AS c FROM g) WHERE c > 1
), p AS (
  SELECT doc_id, CAST(count(DISTINCT i + k) AS BIGINT) AS n_repeat_words
  FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), f AS (
  SELECT m.doc_id, n_words, word_chars, n_symbols, n_capitals, n_word_lines, n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM m LEFT JOIN p USING (doc_id)
), b AS (
  SELECT *, CAST(
    (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * n_symbols > 20 * n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 100 * n_dup_lines > 50 * n_word_lines THEN 8 ELSE 0 END)
    + (CASE WHEN 100 * n_capitals > 30 * word_chars THEN 16 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 16 * n_words THEN 32 ELSE 0 END) AS INTEGER) AS fail_bits
  FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM b
"""
