"""Merkle manifest of a table: a hash tree per group of rows, a tree over the groups' roots, and a proof for every row.

Rows are numbered within their group from one range partitioning. Each level is one window over blocks of whole runs:
columns at fixed offsets before and after a node (lag and lead), masked by the node's slot and the length of its run,
give its siblings; the first child of a run hashes its parent. The way up writes one narrow table per level. The way
down hands every node the path above it: the parent's row sorts just before its first child in the same window, so no
join is needed. Blocks have `fanout` runs of `fanout` nodes, so the rows of a large group spread over all tasks.

Defined cases: a null value is hashed as `-`, an empty text as `0:`; null groups are one group that comes first; rows of a
group are in ascending order of the order column, nulls first, and of their hash where it ties; repeated rows
are leaves of their own; a group of one row has that leaf as its root, a table of one group that group's root as root; an empty
table has no rows and no root. Very long texts are hashed where they are read and only their digests are shuffled.
Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rivermeld.llm.shared import query, table
from rivermeld.session import broadcast_if_small, written

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of one task of the range partitioning, which must not be resized while it runs, as its number is part of the place.
ROWS_PER_RANGE = 200_000

_STEPS = "array<struct<before string, after string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return digest(*[framed(v) for v in values])


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, leaf, lambda h, step: digest(step["before"], h, step["after"]))


def proof(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


@dataclass(frozen=True)
class Manifest:
    """`rows`: the carried columns with leaf, subroot, root and path of each row. `levels`: g, level, pos, n, h of every
    node of the groups' trees. `groups`: g, n_leaves, height, subroot of each group."""

    rows: DataFrame
    levels: list[DataFrame]
    groups: DataFrame


def _numbered(rows: DataFrame, group: str, order: Sequence[str], purpose: str) -> DataFrame:
    """The rows, written, with n (rows of their group) and pos (place in it, from 0) by `order`.

    Rows are sorted within ranges of (group, order); places are counted within a range, and the rows of the same group
    in earlier ranges added. One row per range and group is all that this needs besides.
    """
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_RANGE))
    keys = [F.col(group).asc(), *[F.col(c).asc_nulls_first() for c in order]]
    # The last key only keeps a hot set of identical rows from landing in one range.
    dealt = rows.withColumn("spread_", F.monotonically_increasing_id()).repartitionByRange(tasks, *keys, F.col("spread_"))
    placed = written(dealt.drop("spread_").sortWithinPartitions(*keys).withColumn("at_", F.monotonically_increasing_id()), purpose)
    placed = placed.withColumn("range_", F.shiftright("at_", 33))
    counts = placed.groupBy(group, "range_").agg(F.count("*").alias("in_range_"), F.min("at_").alias("first_"))
    before = Window.partitionBy(group).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(counts.select(
        group, "range_", "first_", F.coalesce(F.sum("in_range_").over(before), F.lit(0)).alias("start_"),
        F.sum("in_range_").over(Window.partitionBy(group)).alias("n")), f"{purpose}-starts")
    return placed.join(broadcast_if_small(starts), [group, "range_"]).withColumn(
        "pos", F.col("at_") - F.col("first_") + F.col("start_")).drop("at_", "range_", "first_", "start_")


def _siblings(fanout: int, order: str) -> tuple[Column, Column]:
    """The hashes before and after a node in its run, joined, by columns at fixed offsets within its block.

    Stated as SQL text: some thirty window columns are one call to the JVM.
    """
    over = f"OVER (PARTITION BY g, block ORDER BY {order})"
    slot = f"pos % {fanout}"
    before = [f"IF({slot} >= {k}, lag(h, {k}) {over}, '')" for k in range(fanout - 1, 0, -1)]
    after = [f"IF({slot} + {k} < least({fanout}, n - pos + {slot}), lead(h, {k}) {over}, '')" for k in range(1, fanout)]
    return F.expr(f"concat({', '.join(before)})"), F.expr(f"concat({', '.join(after)})")


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """The next level of groups that still have several nodes: each first child hashes its run."""
    block = F.floor(F.col("pos") / (fanout * fanout))
    _, after = _siblings(fanout, "pos")
    firsts = nodes.where("n > 1").select("g", "n", "pos", "h", block.alias("block")).withColumn("after", after)
    return firsts.where(F.col("pos") % fanout == 0).select(
        "g", F.ceil(F.col("n") / fanout).alias("n"), F.floor(F.col("pos") / fanout).alias("pos"),
        digest(F.col("h"), F.col("after")).alias("h"))


def _with_paths(nodes: DataFrame, above: DataFrame, fanout: int) -> DataFrame:
    """`nodes` (g, n, pos, h and others) with `way` (path, subroot, root).

    `above`: g, run, way of the runs' parents; `lone` where the node itself is the root of its group, so that it has
    no siblings.
    """
    extra = [c for c in nodes.columns if c not in ("g", "n", "pos", "h")]
    place = F.floor(F.col("pos") / (fanout * fanout)).alias("block")
    below = nodes.select("g", "n", "pos", "h", *extra, place, F.lit(1).alias("kind"))
    heads = above.select("g", (F.col("run") * fanout).alias("pos"), F.floor(F.col("run") / fanout).alias("block"),
                         F.lit(0).alias("kind"), "lone", "way")
    # The row of a parent stands before its first child, so offsets within a run do not meet it.
    before, after = _siblings(fanout, "pos, kind")
    upto = Window.partitionBy("g", "block").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = below.unionByName(heads, allowMissingColumns=True).select(
        "g", "n", "pos", "h", "kind", *extra, before.alias("before"), after.alias("after"),
        F.last("lone", True).over(upto).alias("lone"), F.last("way", True).over(upto).alias("way"))
    step = F.array(F.struct("before", "after"))
    path = F.when(F.col("lone"), F.col("way")["path"]).otherwise(F.concat(step, F.col("way")["path"]))
    return met.where("kind = 1").select("g", "n", "pos", "h", *extra, F.col("way").withField("path", path).alias("way"))


def _height(n: str, fanout: int) -> Column:
    """Levels above the leaves of a group of n rows."""
    sizes, size = [], 1
    while size < 2**63:
        sizes.append(f"IF({n} > {size}L, 1, 0)")
        size *= fanout
    return F.expr(" + ".join(sizes))


def _tree(leaves: DataFrame, fanout: int, purpose: str) -> tuple[list[DataFrame], DataFrame]:
    """(levels from the leaves up, written; g, height, n_leaves, top of each group)."""
    leaves = written(leaves, f"{purpose}-0")
    groups = leaves.where("pos = 0").select("g", F.col("n").alias("n_leaves"), _height("n", fanout).alias("height"))
    tallest = groups.agg(F.max("height")).first()[0] or 0
    levels = [leaves]
    for level in range(1, tallest + 1):
        levels.append(written(_parents(levels[-1], fanout), f"{purpose}-{level}"))
    tops = None
    for level in levels:
        one = level.where("n = 1").select("g", F.col("h").alias("top"))
        tops = one if tops is None else tops.unionByName(one)
    return levels, written(groups.join(tops, "g"), f"{purpose}-tops")


def _paths(levels: list[DataFrame], tops: DataFrame, fanout: int, purpose: str) -> DataFrame:
    """The leaves with `way`. `tops`: g, height and the way of each group's root."""
    way = None
    for level in range(len(levels) - 1, -1, -1):
        own = tops.where(F.col("height") == level).select("g", F.lit(0).cast("long").alias("run"), F.lit(True).alias("lone"), "way")
        above = own if way is None else own.unionByName(way.select("g", F.col("pos").alias("run"), F.lit(False).alias("lone"), "way"))
        way = _with_paths(levels[level], above, fanout)
        if level:
            way = written(way, f"{purpose}-way-{level}")
    return way


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "source", order: str = "doc_id",
             fanout: int = FANOUT, carried: dict[str, Column] | None = None) -> Manifest:
    """Hash trees over the rows of `docs`: leaves hash `columns`, one tree per value of `group`, one over their roots.

    `carried`: columns computed from a row of `docs` that its result row keeps beside `order`; they must be narrow.
    """
    carried = {f"c_{k}": v for k, v in (carried or {}).items()}
    # Null groups sort before all others; strings compare by their UTF-8 bytes.
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = written(docs.select(
        key.alias("g"), F.col(order).alias("order_"), leaf_hash(*[F.col(c) for c in columns]).alias("h"),
        *[v.alias(k) for k, v in carried.items()]), "leaf-hashes")
    levels, groups = _tree(_numbered(leaves, "g", ["order_", "h"], "leaf-places"), fanout, "tree")
    subroots = groups.select(F.lit("").alias("g"), F.col("g").alias("member"), F.col("top").alias("h"))
    over, whole = _tree(_numbered(subroots, "g", ["member"], "subroots"), fanout, "over")
    none = F.array().cast(_STEPS)
    crown = whole.select("g", "height", F.struct(none.alias("path"), F.lit("").alias("subroot"), F.col("top").alias("root")).alias("way"))
    placed = _paths(over, crown, fanout, "over")
    tops = written(placed.select(F.col("member").alias("g"), F.col("way").withField("subroot", F.col("h")).alias("way"))
                   .join(groups, "g"), "ways-of-groups")
    rows = _paths(levels, tops, fanout, "tree")
    names = {k: k.removeprefix("c_") for k in carried}
    return Manifest(
        rows.select(F.col("order_").alias(order), *[F.col(k).alias(v) for k, v in names.items()], F.col("h").alias("leaf"),
                    F.col("way")["subroot"].alias("subroot"), F.col("way")["root"].alias("root"), F.col("way")["path"].alias("path")),
        levels, groups.select("g", "n_leaves", "height", F.col("top").alias("subroot")))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: DuckDB: trees by recursion over levels; crc32 by its bits, as there is no such function.
ORACLE = r"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS r, coalesce('=' || source, '') AS g, doc_id, source, lang, n_chars, text,
           CASE WHEN doc_id IS NOT NULL AND xor(list_reduce(list_concat([4294967295::BIGINT],
                    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda z: ord(z)::BIGINT)),
                    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                        lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 5 = 0
                THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed
    FROM documents
), hashed AS (
    SELECT r, g, doc_id, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           sha256(front || coalesce(strlen(changed) || ':' || changed, '-')) AS other
    FROM (SELECT *, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                           coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS front FROM d)
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM hashed
), nodes AS (
    SELECT g, 0 AS level, pos, leaf AS h, n FROM leaves
    UNION ALL
    SELECT g, level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM nodes WHERE n > 1 GROUP BY g, level, pos // 16, n
), subroots AS (SELECT g, h AS subroot, level AS height FROM nodes WHERE n = 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM subroots),
over_nodes AS (
    SELECT 0 AS level, pos, subroot AS h, n FROM ranked
    UNION ALL
    SELECT level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM over_nodes WHERE n > 1 GROUP BY level, pos // 16, n
), low AS (
    SELECT a.g, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
           coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
    FROM nodes a JOIN nodes b ON a.g = b.g AND a.level = b.level AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY ALL
), high AS (
    SELECT a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
           coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
    FROM over_nodes a JOIN over_nodes b ON a.level = b.level AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY ALL
), steps AS (
    SELECT r, low.level AS k, before, after FROM leaves JOIN low ON low.g = leaves.g AND low.pos = leaves.pos // CAST(pow(16, low.level) AS BIGINT)
    UNION ALL
    SELECT r, 100 + high.level, before, after FROM leaves JOIN ranked USING (g)
    JOIN high ON high.pos = ranked.pos // CAST(pow(16, high.level) AS BIGINT)
), paths AS (SELECT r, list({'b': before, 'a': after} ORDER BY k) AS path FROM steps GROUP BY r),
folds AS (
    SELECT leaves.r, 0 AS k, other AS h, coalesce(path, []) AS path FROM leaves LEFT JOIN paths USING (r)
    UNION ALL
    SELECT r, k + 1, sha256(path[k + 1].b || h || path[k + 1].a), path FROM folds WHERE k < len(path)
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda s: s.b || s.a), ''), '')) AS proof_sha256,
       folds.h AS folded_root, folds.h = root AS verified
FROM leaves JOIN subroots USING (g) JOIN folds USING (r) CROSS JOIN (SELECT h AS root FROM over_nodes WHERE n = 1)
WHERE folds.k = len(path)
"""


@query("op11_merkle_manifest", ORACLE)
def op11(spark, sf_dir):
    """Proofs of all documents, checked against rows of which a fifth were tampered with."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lowered = F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    other = leaf_hash(*[F.col(c) for c in COLUMNS[:-1]], lowered)
    found = manifest(docs, carried={"other": F.when(hit, other)}).rows
    return found.select(
        "doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
