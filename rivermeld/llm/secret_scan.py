"""Secret scan with corpus-wide ownership, in column expressions.

Candidates are found per text; the hash of every candidate value is then counted over the whole corpus by distinct
owners and repositories. A value many owners carry is a copied example; a value of one owner is a live-looking
credential. Counting is grouped (hash, owner, repository) first, so map-side combining leaves one row per task and
triple; values holding a large share of all rows (at most `HOT_PARTS` of them, by their counts) are judged by a
broadcast and the rest by a join, so that no value makes a hot join key.

Defined cases: a null text is empty and has no spans; null owner or repository counts as one owner or repository of its
own; repeated rows of one (owner, repository) count once in the frequencies and each gets its own result; a very long
text is searched whole, in time that grows with its length and as n log n with its n matches; an empty table gives an
empty result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermeld.llm.shared import bound, query, running_sums, table, whole
from rivermeld.session import written


@dataclass(frozen=True)
class Kind:
    """A format: its pattern, the group that holds the value, and the least length of that value."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0


BASE = (
    Kind("assign", r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
         r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}"),
    Kind("hex", r"[0-9a-f]{24,}"),
)

#: Published token formats that the base patterns miss.
ADDED = (
    Kind("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Kind("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Kind("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)

#: A value with at least one in so many of all candidate rows is hot; there can be no more of them than this.
HOT_PARTS = 500


def spans_of(text: Column, kind: Kind) -> Column:
    """array<struct<start, stop, kind, value>> of the matches of one kind, positions in code points.

    The matches and the gaps between them come from one split and one extraction; their running lengths are the
    positions. Matches whose value is too short are dropped after they were consumed.
    """
    shape = "array<struct<start:bigint,stop:bigint,kind:string,value:string>>"
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else hits
    pieces = F.zip_with(
        F.zip_with(F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(hits)), hits,
                   lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit"))),
        values, lambda at, value: F.struct(at["gap"].alias("gap"), at["hit"].alias("hit"), value.alias("value")))

    def placed(items: Column) -> Column:
        ends = running_sums(F.transform(items, lambda x: x["gap"] + x["hit"]))
        return F.zip_with(items, ends, lambda x, end: F.struct(
            (end - x["hit"]).alias("start"), end.alias("stop"), F.lit(kind.name).alias("kind"), x["value"].alias("value")))

    found = bound(pieces, placed)
    kept = F.filter(found, lambda x: F.length(x["value"]) >= kind.least) if kind.least else found
    return F.when(text.rlike(kind.pattern), kept).otherwise(F.array().cast(shape))


def _listed(spans: Column, kinds: tuple[Kind, ...]) -> Column:
    """kind:start:end by start, then by the order of `kinds`, comma-joined."""
    order = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k.name), F.lit(i))])
    ordered = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"], order[x["kind"]], x["stop"], x["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def found(docs: DataFrame, text: str, owner: str, repository: list[str], keep: list[str],
          kinds: tuple[Kind, ...] = BASE + ADDED) -> DataFrame:
    """keep columns, owner_, repository_ and one array of spans per kind, written once so that rows are scanned once."""
    t = whole(text)
    named = docs.select(
        *[F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)],
        F.xxhash64(F.col(f"`{owner}`").cast("string")).alias("owner_"),
        F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in repository]).alias("repository_"), t.alias("t_"))
    scanned = named.select("*", *[spans_of(F.col("t_"), k).alias(k.name) for k in kinds]).drop("t_")
    return written(scanned.withColumn("row_", F.monotonically_increasing_id()), "secrets")


def frequencies(scanned: DataFrame, kinds: tuple[Kind, ...] = BASE + ADDED) -> tuple[DataFrame, DataFrame]:
    """(candidates: row_, value_; corpus counts per value_: n_owners, n_repositories, n_rows)."""
    candidates = scanned.select("row_", "owner_", "repository_", F.explode(F.concat(
        *[F.transform(k.name, lambda x: F.sha2(x["value"], 256)) for k in kinds])).alias("value_"))
    triples = candidates.groupBy("value_", "owner_", "repository_").agg(F.count(F.lit(1)).alias("n"))
    owners = triples.groupBy("value_", "owner_").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("r"))
    counts = owners.groupBy("value_").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("r").alias("n_repositories"), F.sum("n").alias("n_rows"))
    return candidates.select("row_", "value_"), written(counts, "secret-counts")


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repository: tuple[str, ...] = ("source", "lang"),
         keep: tuple[str, ...] = ("doc_id",), copied_owners: int = 3, kinds: tuple[Kind, ...] = BASE + ADDED) -> DataFrame:
    """One row per document: keep columns, spans per kind, and how many candidates are copied examples or owner-specific.

    n_copied: candidates whose value at least `copied_owners` owners carry; n_live: those of a single owner.
    """
    scanned = found(docs, text, owner, list(repository), list(keep), kinds)
    candidates, counts = frequencies(scanned, kinds)
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    judged = counts.select("value_", (F.col("n_owners") >= copied_owners).cast("long").alias("copied"),
                           (F.col("n_owners") == 1).cast("long").alias("live"), (F.col("n_rows") * HOT_PARTS >= total).alias("hot"))
    # Values sum to the total, so at most HOT_PARTS of them can be hot.
    hot = F.broadcast(judged.where("hot").drop("hot"))
    verdicts = candidates.join(hot, "value_").unionByName(
        candidates.join(hot, "value_", "left_anti").join(judged.where("not hot").drop("hot"), "value_"))
    per_row = verdicts.groupBy("row_").agg(F.sum("copied").alias("n_copied"), F.sum("live").alias("n_live"))
    out = scanned.join(per_row, "row_", "left")
    return out.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], *[k.name for k in kinds],
                      F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
                      F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
kinds AS (
    SELECT * FROM (VALUES
        (0, 'assign', '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1, 6),
        (1, 'access', '(AKIA[A-Z0-9]+)', 1, 20),
        (2, 'hex', '([0-9a-f]+)', 1, 24),
        (3, 'github', '(gh[pousr]_[A-Za-z0-9]{36,})', 1, 0),
        (4, 'slack', '(xox[abprs]-[A-Za-z0-9-]{10,})', 1, 0),
        (5, 'pem', '(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----)', 1, 0)) AS k(o, kind, p, g, least)
), m AS (
    SELECT r, source, lang, t, o, kind, least, hits, vals, unnest(range(1, len(hits) + 1)) AS i
    FROM (SELECT *, regexp_extract_all(t, p, 0) AS hits, regexp_extract_all(t, p, 1) AS vals FROM d, kinds)
), gaps AS (
    SELECT r, o, regexp_split_to_array(t, p) AS gap FROM d, kinds
), placed AS (
    SELECT m.*, length(hits[i]) AS n,
           list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start,
           vals[i] AS val
    FROM m JOIN gaps USING (r, o)
), s AS (
    SELECT *, CAST(start AS BIGINT) AS b, CAST(start + n AS BIGINT) AS e FROM placed WHERE length(val) >= least
), f AS (
    SELECT val, count(DISTINCT coalesce(source, '?')) AS owners FROM s GROUP BY val
), per AS (
    SELECT r, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
           string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, o) FILTER (o < 3) AS base,
           string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, o) AS spans,
           count(*) FILTER (owners >= 3) AS n_copied, count(*) FILTER (owners = 1) AS n_live
    FROM s JOIN f USING (val) GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_copied, 0) AS n_copied, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN per USING (r)
"""


@query("op1_secret_scan", ORACLE)
def op1(spark, sf_dir):
    result = scan(table(spark, sf_dir, "documents"))
    every = F.concat(*[F.col(k.name) for k in BASE + ADDED])
    return result.select(
        "doc_id", *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in BASE],
        F.sha2(_listed(F.concat(*[F.col(k.name) for k in BASE]), BASE), 256).alias("base_sha256"),
        _listed(every, BASE + ADDED).alias("spans"), "n_copied", "n_live")
