"""Audit of five document filters: what each order of them removes at each step, and what each filter is worth.

Four filters judge a row by itself. The fifth, "same text as a document with a smaller identifier", is an existential
self-join: rows whose text hash occurs under several identifiers are left-semi joined, on the hash, the exact text and a
smaller identifier, with one row per different text that holds its smallest identifier. The marked identifiers are united
with those that fail other filters, the failures of a document become one number of five bits, and the
documents are counted per part and number. All orders and steps follow from those 32 counts of a part alone.

Only the documents under repeated hashes carry their text through a shuffle, and equal texts combine before it on the side
that is looked up; a join dealt out by written tables lets Spark split the rows of a hot text.

Defined cases: a null or empty text has no words and fails A alone, beside E where a smaller identifier has such a text
too; a null identifier is smaller than none and has none smaller, and has no labels; rows that repeat count each, also with the
same identifier; a document with several rows of labels counts as labelled so if one of them says so; a null part is the
empty string, one with parts named so; very long texts are judged whole; an empty table has no parts and gives no rows;
other columns are not read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermeld.llm.shared import query, table, whole, words_of
from rivermeld.session import broadcast_if_small, written

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")


def failures(text: Column, words: Column) -> Column:
    """Bits of the filters A to D that the text fails: few words, few different words, capitals, symbols."""
    n = F.size(words)
    different = F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [n < 50, 100 * different < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def judged(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, hash (of the text), bits (of A to D): one narrow row per row of `docs`."""
    text = whole("text")
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"),
                       words_of(text).alias("words"))
    return rows.select("doc_id", "part", F.xxhash64("text").alias("hash"),
                       failures(F.col("text"), F.col("words")).alias("bits"))


def repeated(docs: DataFrame, facts: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, hash of the rows whose exact text a smaller identifier has."""
    seen = facts.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    several = written(seen.where("least < most").select("hash"), "repeated-hashes")
    texts = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole("text").alias("text"))
    texts = texts.withColumn("hash", F.xxhash64("text"))
    held = written(texts.join(broadcast_if_small(several), "hash", "left_semi"), "repeated-texts")
    first = held.groupBy("hash", "text").agg(F.min("doc_id").alias("least"))
    smallest = written(first.select(F.col("hash").alias("hash_"), F.col("text").alias("text_"), "least"), "first-texts")
    smaller = (F.col("hash") == F.col("hash_")) & (F.col("text") == F.col("text_")) & (F.col("least") < F.col("doc_id"))
    return held.join(smallest, smaller, "left_semi").select("doc_id", "part", "hash")


def combinations(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, bits (of all filters that fail) and counts: n (documents), good (quality is 1), toxic (toxic is 1)."""
    facts = written(judged(docs, part), "filter-failures")
    marks = repeated(docs, facts, part).select("doc_id", "part", "hash", F.lit(REPEATED).alias("bits"), F.lit(0).alias("n"))
    # A mark adds its bit to the row it came from, and no document.
    united = facts.withColumn("n", F.lit(1)).unionByName(marks)
    united = united.groupBy("doc_id", "part", "hash").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    known = broadcast_if_small(written(known, "known-labels"))
    return united.join(known, "doc_id", "left").groupBy("part", "bits").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def _orders() -> Column:
    """All orders and steps: filter_order, step, f (bit of the step's filter), m (bits of the filters before it)."""
    rows = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            rows.append(f"named_struct('filter_order', '{order}', 'step', {step}, 'f', {bit}, 'm', {before})")
            before |= bit
    return F.expr(f"array({', '.join(rows)})")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step, as the contract of op12 lists them."""
    size = 1 << len(FILTERS)
    counts = combinations(docs, labels, part).groupBy("part").agg(
        # pass_n[m]: documents of the part that fail no filter in m.
        *[F.array(*[F.expr(f"coalesce(sum({c}) FILTER (WHERE (bits & {m}) = 0), 0L)") for m in range(size)]).alias(f"pass_{c}")
          for c in ("n", "good", "toxic")],
        F.array(*[F.expr(f"coalesce(sum(n) FILTER (WHERE bits = {m}), 0L)") for m in range(size)]).alias("only"))
    removed = [[f"(pass_n[{m}] - pass_n[{m | 1 << k}])" for m in range(size) if not m >> k & 1] for k in range(len(FILTERS))]
    weight = [[factorial(m.bit_count()) * factorial(len(FILTERS) - 1 - m.bit_count()) for m in range(size) if not m >> k & 1]
              for k in range(len(FILTERS))]
    values = ", ".join(f"{1 << k}, " + " + ".join(f"{w} * {r}" for w, r in zip(weight[k], removed[k], strict=True))
                       for k in range(len(FILTERS)))
    counts = counts.withColumn("worth", F.expr(f"map({values})"))
    rows = counts.select("*", F.explode(_orders()).alias("o")).select("*", "o.*")
    lost = "{0}[m] - {0}[m | f]"
    return rows.select(
        "part", "filter_order", "step",
        F.expr("pass_n[m | f]").alias("kept"), F.expr(lost.format("pass_n")).alias("removed"),
        F.expr("pass_n[0] - pass_n[f] - (pass_n[m] - pass_n[m | f])").alias("redundant"),
        F.expr("only[f]").alias("unique_fails"), F.expr(lost.format("pass_good")).alias("good_lost"),
        F.expr(lost.format("pass_toxic")).alias("toxic_lost"), F.expr("worth[f]").alias("shapley"))


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
d AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, FALSE)) AS good, bool_or(coalesce(toxic = 1, FALSE)) AS toxic FROM labels GROUP BY doc_id),
fails AS (
    SELECT r, part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
           list_filter(['A', 'B', 'C', 'D', 'E'], lambda f: CASE f
               WHEN 'A' THEN len(w) < 50 WHEN 'B' THEN 100 * len(list_distinct(w)) < 65 * len(w)
               WHEN 'C' THEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text)
               WHEN 'D' THEN regexp_matches(text, '[#$%&*|]') ELSE coalesce(first < d.doc_id, FALSE) END) AS f
    FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), combos AS (
    SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM fails GROUP BY part, f
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT [a.x, b.x, c.x, e.x, g.x] AS o FROM letters a, letters b, letters c, letters e, letters g
    WHERE len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5
), steps AS (SELECT array_to_string(o, '') AS filter_order, step, o[step] AS x, o[1:step - 1] AS before
             FROM (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders)),
result AS (
    SELECT part, filter_order, CAST(step AS INT) AS step, x,
           coalesce(sum(n) FILTER (NOT list_has_any(f, list_append(before, x))), 0) AS kept,
           coalesce(sum(n) FILTER (NOT list_has_any(f, before) AND list_contains(f, x)), 0) AS removed,
           coalesce(sum(n) FILTER (list_has_any(f, before) AND list_contains(f, x)), 0) AS redundant,
           coalesce(sum(n) FILTER (f = [x]), 0) AS unique_fails,
           coalesce(sum(good) FILTER (NOT list_has_any(f, before) AND list_contains(f, x)), 0) AS good_lost,
           coalesce(sum(toxic) FILTER (NOT list_has_any(f, before) AND list_contains(f, x)), 0) AS toxic_lost
    FROM combos, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       sum(removed) OVER (PARTITION BY part, x)::BIGINT AS shapley
FROM result
"""


@query("op12_filter_audit", ORACLE)
def op12(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"),
                 table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
