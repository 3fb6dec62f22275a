"""Line-first cleaning in column expressions: rules per line, failing lines go, then documents that lost too much.

Everything runs inside the row of a document: one pass over the table, no shuffle, no Python on the executors.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; null in any other column
changes nothing; repeated rows are judged each on its own; an empty table gives an empty result; columns of the input
that have the names of results are not read and do not clash, as the digest is built from identifier and text alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermeld.llm.shared import SPACE_CLASS, SPACES, free_name, query, settled, spaced, table, whole, words_of

SYMBOLS = "#*$%&|<>"

#: Fixed wordings of page furniture, matched in lines of few words.
BOILERPLATE = (
    "accept (all )?cookies", "this (web)?site uses cookies", "cookie policy", "privacy policy", "terms of (use|service)",
    "all rights reserved", "enable javascript", "lorem ipsum", "click here", "sign (up|in)", "log ?in", "subscribe",
    "share (this|on)", "read more", "skip to (main )?content", "back to top",
)


@dataclass(frozen=True)
class Rules:
    """Limits of the rules. A line fails one rule to go; a document goes if it loses more than `max_lost` of its characters."""

    min_words: int = 50
    max_repeat_percent: int = 50
    line_ends: str = ".!?…:;)]\"'»”’。！？"
    separators: str = r"[|»›•·][\x20\t][^|»›•·]*[|»›•·]|\|[\x20\t]*$"
    boilerplate: str = r"(?i)\b(" + "|".join(BOILERPLATE) + r")\b"
    boilerplate_chars: int = 80
    symbol_percent: int = 10
    shouting: str = r"!![^\n]*!!"
    repeated: str = r"(?:^|[\x20\t])([^\x20\t]+)[\x20\t]+\1[\x20\t]+\1(?:[\x20\t]|$)"
    max_lost: float = 0.3


def _at(array: Column, index: Column) -> Column:
    return F.get(array, index)


def _repeated(positions: Column, words: Column, bits: Column, mask: Column, seed: int):
    """Of the start positions of 3-word windows, those whose window hash occurs twice or more, hash order.

    Each position is packed below the high bits of its hash, so one sort of longs brings equal windows together.
    """
    packed = F.sort_array(F.transform(positions, lambda i: F.call_function(
        "shiftleft", F.xxhash64(F.lit(seed), _at(words, i), _at(words, i + 1), _at(words, i + 2)), bits,
    ).bitwiseOR(i.cast("long"))))
    return packed, lambda sorted_: F.transform(
        F.filter(sorted_, lambda e, k: e.bitwiseXOR(_at(sorted_, k - 1)).between(F.lit(0), mask)
                 | e.bitwiseXOR(_at(sorted_, k + 1)).between(F.lit(0), mask)),
        lambda e: e.bitwiseAND(mask).cast("int"),
    )


def line_fails(rules: Rules) -> Callable[[Column], Column]:
    """A line, which has a word, as a column -> whether it fails a rule."""

    def fails(line: Column) -> Column:
        symbols = F.length(F.regexp_replace(line, f"[^{SYMBOLS}]+", ""))
        last = F.substring(F.rtrim(line, F.lit(SPACES)), -1, 1)
        return (
            ~F.contains(F.lit(rules.line_ends), last)
            | line.rlike(rules.separators)
            | (symbols * 100 > F.length(line) * rules.symbol_percent)
            | (F.contains(line, F.lit("!!")) & line.rlike(rules.shouting))
            | ((F.length(line) <= rules.boilerplate_chars) & line.rlike(rules.boilerplate))
            | line.rlike(rules.repeated)
        )

    return fails


def judged(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of `docs` with one struct column `verdict`: the measures, base_failed, kept and the cleaned text.

    A column of the input already named `verdict` is kept and the new one is lengthened (see `verdict_name`).
    The measures: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_lines_removed, lost (share
    of the characters of lines with words). Windows are compared by two independent 64-bit hashes.
    """
    t, w, name = free_name(docs, "whole_"), free_name(docs, "words_"), free_name(docs, "verdict")
    first, second = free_name(docs, "sorted_"), free_name(docs, "again_")
    lines, good = free_name(docs, "lines_"), free_name(docs, "good_")
    n = F.size(F.col(w))
    b, k = free_name(docs, "bits_"), free_name(docs, "mask_")
    bits, mask = F.col(b), F.col(k)
    # A text of fewer than three words has one window with nulls, which repeats nothing. No element can be null: only
    # then are the hashes sorted as plain longs.
    every = F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))
    start = docs.withColumn(t, whole(text))
    start = start.withColumn(w, words_of(F.col(t))).withColumn(
        lines, F.filter(F.split(F.col(t), "\n", -1), lambda x: x.rlike(f"[^{SPACE_CLASS[1:]}")))
    # As many low bits as the number of words needs hold the position; the rest holds the hash.
    start = start.withColumn(b, F.length(F.bin(n)))
    start = start.withColumn(k, F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)
    packed, positions = _repeated(every, F.col(w), bits, mask, 1)
    start = start.withColumn(first, packed)
    packed, _ = _repeated(positions(F.col(first)), F.col(w), bits, mask, 2)
    start = start.withColumn(second, packed)
    start = start.withColumn(first, F.sort_array(positions(F.col(second))))
    fails = line_fails(rules)
    start = start.withColumn(good, F.filter(F.col(lines), lambda x: ~fails(x)))
    covered = F.aggregate(
        F.transform(F.col(first), lambda p, k: F.least(F.lit(3), p - _at(F.col(first), k - 1))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    chars = F.length(F.array_join(F.col(lines), ""))
    left = F.length(F.array_join(F.col(good), ""))
    start = start.withColumn(name, F.struct(
        n.cast("long").alias("n_words"),
        (F.length(F.col(t)) - F.size(F.split(spaced(F.col(t)), " ", -1)) + 1).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(F.col(t), f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size(F.col(lines)) - F.size(F.array_distinct(F.col(lines)))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size(F.col(lines)).cast("long").alias("n_lines"),
        (F.size(F.col(lines)) - F.size(F.col(good))).cast("long").alias("n_lines_removed"),
        F.when(chars > 0, (chars - left) / chars).otherwise(F.lit(0.0)).alias("lost"),
        F.array_join(F.col(good), "\n").alias("cleaned"),
    ))
    v = F.col(name)
    failed = (v["n_words"] < rules.min_words) | (100 * v["n_repeat_words"] > rules.max_repeat_percent * v["n_words"])
    return start.withColumn(name, v.withField("base_failed", failed).withField(
        "kept", ~failed & (v["lost"] <= rules.max_lost))).drop(t, w, lines, good, first, second, b, k)


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Documents that pass, with their failing lines removed and n_chars counted again; the columns stay as they are."""
    name, passes = free_name(docs, "verdict"), free_name(docs, "passes")
    kept = judged(docs, "text", rules).withColumn(passes, settled(F.col(name)["kept"])).where(passes)
    out = kept.withColumn("text", F.col(name)["cleaned"])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


#: DuckDB takes the same patterns; it has no back references, so a run of one word is stated over the words of the line.
ORACLE = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), windows AS (
    SELECT r, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c
    FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM d)
), twice AS (
    SELECT r, p FROM windows QUALIFY count(*) OVER (PARTITION BY r, a, b, c) >= 2
), repeats AS (
    SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY r
), l AS (
    SELECT r, k, x, list_filter(regexp_split_to_array(x, '[\x20\t]+'), lambda y: y <> '') AS lw
    FROM (SELECT r, unnest(string_split(t, chr(10))) AS x, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS k FROM d)
    WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
), judged AS (
    SELECT *, NOT contains('.!?…:;)]"''»”’。！？', substr(regexp_replace(x, '[\x20\x09-\x0D]+$', ''), -1, 1))
              OR regexp_matches(x, '[|»›•·][\x20\t][^|»›•·]*[|»›•·]|\|[\x20\t]*$')
              OR length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) * 100 > length(x) * 10
              OR regexp_matches(x, '!![^\n]*!!')
              OR len(list_filter(range(1, len(lw) - 1), lambda i: lw[i] = lw[i + 1] AND lw[i] = lw[i + 2])) > 0
              OR (length(x) <= 80 AND regexp_matches(x, '(?i)\b(BOILERPLATE)\b')) AS fails
    FROM l
), lines AS (
    SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines, sum(length(x)) AS chars,
           count(*) FILTER (fails) AS n_lines_removed, coalesce(sum(length(x)) FILTER (NOT fails), 0) AS kept_chars
    FROM judged GROUP BY r
), m AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
           CAST(coalesce(n_lines_removed, 0) AS BIGINT) AS n_lines_removed,
           coalesce((chars - kept_chars) / chars, 0) AS lost
    FROM d LEFT JOIN repeats USING (r) LEFT JOIN lines USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.3 AS kept, n_lines_removed
FROM m
""".replace("BOILERPLATE", "|".join(BOILERPLATE))


@query("op2_quality_rules", ORACLE)
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    v = F.col("verdict")
    return judged(docs).select("doc_id", *[v[c].alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed")])
