"""Line dedup by distinct-site spread, in column expressions.

Every line with a word is hashed (128 bits). One grouped pass tells which lines occur in more than one document and on more
than one site, by least and greatest values, which combine before the shuffle. The spread of those on several sites is
estimated with HyperLogLog sketches, merged by aggregation; lines whose estimate lies near the threshold get
an exact distinct count. A line on enough sites is boilerplate; repeated lines that stand together and hold over
`passage_words` words are a copied passage whatever their spread. Both stay only in the document with the smallest
identifier and go from all others.

Defined cases: a null or empty text has no lines and stays as it is; a null site is a site of its own; a null identifier comes after all others;
identical rows (identifier, site and text) are one document; a very long text is taken line by line, in time that grows with its lines; lines equal but for white space at the ends are equal; an empty table gives an empty
result; extra columns are carried along untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rivermeld.llm.shared import SPACES, free_name, query, settled, spaced, table, whole
from rivermeld.session import written


@dataclass(frozen=True)
class Spread:
    """`sites`: distinct sites that make a line boilerplate. Estimates within `margin` of it are counted exactly."""

    sites: int = 5
    passage_words: int = 50
    sketch_bits: int = 12
    margin: float = 0.15


def _lines(text: Column) -> Column:
    return F.split(whole(text), "\n", -1)


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def _identity(docs: DataFrame, site: str) -> list[Column]:
    parts = [F.col(c).cast("string") for c in ("doc_id", site, "text")]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (1, 2)]


def line_rows(docs: DataFrame, site: str = "source") -> DataFrame:
    """f1, f2 (the document), k (place among its lines with words), h1, h2 (the line), site_, id_, words: narrow rows."""
    f1, f2 = _identity(docs, site)
    kept = F.filter(F.transform(_lines(F.col("text")), _bare), lambda x: x != "")
    # Hashes of the whole text are made before lines are opened, once a document and not once a line.
    whole_ = docs.select(
        f1.alias("f1"), f2.alias("f2"), F.xxhash64(F.col(site).cast("string")).alias("site_"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id_"), kept.alias("kept_"))
    opened = whole_.select("f1", "f2", "site_", "id_", F.posexplode("kept_").alias("k", "line_"))
    return opened.select(
        "f1", "f2", "k", F.xxhash64(F.lit(1), "line_").alias("h1"), F.xxhash64(F.lit(2), "line_").alias("h2"), "site_", "id_",
        (F.length("line_") - F.length(F.replace(spaced(F.col("line_")), F.lit(" "), F.lit(""))) + 1).cast("int").alias("words"))


def repeats(lines: DataFrame) -> DataFrame:
    """The rows of lines that several documents have, with `first` (in the document that keeps them) and `wide` (on several sites)."""
    spans = lines.groupBy("h1", "h2").agg(
        F.min("f1").alias("a"), F.max("f1").alias("b"), F.min("site_").alias("s"), F.max("site_").alias("t"), F.min("id_").alias("keeper"))
    several = spans.where("a <> b").select("h1", "h2", (F.col("s") != F.col("t")).alias("wide"), "keeper")
    # Written, so that the join deals out both sides itself and can split the rows of a very common line.
    several = written(several, "lines-in-several")
    return lines.join(several, ["h1", "h2"]).select(
        "f1", "f2", "k", "h1", "h2", "site_", "words", "wide", (F.col("id_") == F.col("keeper")).alias("first"))


def boilerplate(occurrences: DataFrame, spread: Spread) -> DataFrame:
    """h1, h2 of the lines on at least `spread.sites` distinct sites."""
    wide = occurrences.where("wide")
    sketches = wide.groupBy("h1", "h2").agg(F.hll_sketch_agg("site_", F.lit(spread.sketch_bits)).alias("sketch"))
    judged = written(sketches.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("estimate")), "line-spread")
    width = max(1.0, spread.sites * spread.margin)
    sure = judged.where(F.col("estimate") > spread.sites + width).select("h1", "h2")
    near = judged.where(F.abs(F.col("estimate") - spread.sites) <= width).select("h1", "h2")
    exact = (
        wide.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site_").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.sum("one").alias("n")).where(F.col("n") >= spread.sites).select("h1", "h2")
    )
    return sure.unionByName(exact)


def removals(docs: DataFrame, site: str = "source", spread: Spread = Spread()) -> DataFrame:
    """f1, f2 and `gone`: the places of the lines that go from the document (places among its lines with words)."""
    occurrences = written(repeats(line_rows(docs, site)).dropDuplicates(["f1", "f2", "k"]), "line-repeats")
    marked = occurrences.join(boilerplate(occurrences, spread).withColumn("everywhere", F.lit(True)), ["h1", "h2"], "left")
    order = Window.partitionBy("f1", "f2").orderBy("k")
    runs = marked.withColumn("run", F.col("k") - F.row_number().over(order))
    passage = F.sum("words").over(Window.partitionBy("f1", "f2", "run")) > spread.passage_words
    goes = runs.withColumn("passage", passage).where((F.col("everywhere") | F.col("passage")) & ~F.col("first"))
    return goes.groupBy("f1", "f2").agg(F.array_sort(F.collect_list("k")).alias("gone"))


def without_repeats(docs: DataFrame, site: str = "source", spread: Spread = Spread()) -> tuple[DataFrame, str]:
    """(the rows of `docs` and a struct column, its name): n_lines, n_removed and the text that stays.

    Lines without words stay in the text where they are.
    """
    name, a, b = free_name(docs, "lines"), free_name(docs, "f1"), free_name(docs, "f2")
    f1, f2 = _identity(docs, site)
    gone = removals(docs, site, spread).withColumnsRenamed({"f1": a, "f2": b, "gone": name})
    joined = docs.withColumns({a: f1, b: f2}).join(gone, [a, b], "left").drop(a, b)
    lines, places = free_name(docs, "lines_"), free_name(docs, "places_")
    # Lines are split once and places of those with words listed once; what goes is taken out of all places by one set
    # difference, so the work grows with the lines of a text and not with their square.
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    joined = joined.withColumn(lines, _lines(F.col("text")))
    joined = joined.withColumn(places, F.filter(every, lambda i: _bare(F.get(F.col(lines), i)) != ""))
    left = F.array_except(every, F.transform(F.col(name), lambda k: F.get(F.col(places), k)))
    rest = F.when(F.col(name).isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(F.col(lines), i)), "\n"))
    return joined.withColumn(name, F.struct(
        F.size(places).cast("long").alias("n_lines"), F.coalesce(F.size(name), F.lit(0)).cast("long").alias("n_removed"),
        rest.alias("rest"))).drop(lines, places), name


def clean(docs: DataFrame, site: str = "source", spread: Spread = Spread()) -> DataFrame:
    """Documents without their repeated lines; documents that lost all their lines go; the columns stay."""
    out, name = without_repeats(docs, site, spread)
    lines = F.col(name)
    passes = free_name(out, "passes")
    some = (lines["n_removed"] == 0) | (lines["n_removed"] < lines["n_lines"])
    out = out.withColumn(passes, settled(some)).where(passes).withColumn("text", lines["rest"])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(lines["n_removed"] > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (
    SELECT r, doc_id, source, i, regexp_replace(regexp_replace(ls[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS x
    FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)
), w AS (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY i) AS k, length(x) - length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) + 1 AS words
    FROM l WHERE x <> ''
), s AS (
    SELECT x, count(DISTINCT r) AS docs, count(DISTINCT coalesce(source, '?')) AS sites, min(coalesce(doc_id, 9223372036854775807)) AS keeper
    FROM w GROUP BY x
), rep AS (SELECT w.*, sites, keeper, k - row_number() OVER (PARTITION BY r ORDER BY k) AS run FROM w JOIN s USING (x) WHERE docs > 1),
gone AS (
    SELECT r, i FROM (SELECT *, sum(words) OVER (PARTITION BY r, run) AS together FROM rep)
    WHERE (sites >= 5 OR together > 50) AND coalesce(doc_id, 9223372036854775807) <> keeper
), kept AS (
    SELECT r, string_agg(ls[i], chr(10) ORDER BY i) AS rest FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)
    WHERE (r, i) NOT IN (SELECT (r, i) FROM gone) GROUP BY r
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       md5(coalesce(rest, '')) AS rest_md5
FROM d LEFT JOIN (SELECT r, count(*) AS n_lines FROM w GROUP BY r) USING (r)
LEFT JOIN (SELECT r, count(*) AS n_removed FROM gone GROUP BY r) USING (r) LEFT JOIN kept USING (r)
"""


@query("op10_line_dedup", ORACLE)
def op10(spark, sf_dir):
    out, name = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    lines = F.col(name)
    return out.select("doc_id", lines["n_lines"].alias("n_lines"), lines["n_removed"].alias("n_removed"),
                      F.md5(F.coalesce(lines["rest"], F.lit(""))).alias("rest_md5"))
