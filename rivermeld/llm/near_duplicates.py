"""Near-duplicate documents by MinHash with tensored banding and exact verification.

Two small collections of half keys are computed per document (each of a few minhashes); a table key is a pair of one half
key from each collection, so m + m half keys stand for m * m tables. Two documents are candidates if they share a half key
of each collection and enough half keys in all, which at the threshold fails to happen for about one link in 200,000. Only
half keys that several documents have are combined.

Documents with equal shingle sets are one node from the start. Candidates are verified on their full shingle
sets, in rounds that never list all pairs of a bucket: first every node against the representatives of its
buckets, then, where a half key still joins several components, the nodes outside the largest of them against the rest, block by block where
a bucket is large, so that no task holds a whole one. Linked nodes of one component need no further test, as only components are
asked for.

Tables between steps lie in the shared folder; nothing but counts and the end of each loop is seen by the driver.

Defined cases: a null or empty text has no shingles and is linked with nothing, it is its own component; a text of fewer
words than a shingle is one shingle; a null identifier comes after all others and is the component only of documents that
have none; repeated rows are one node and each gets a row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermeld.llm.shared import query, table
from rivermeld.session import written

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LAST = 2**63 - 1

#: Rows of two or three integers that a broadcast may have.
BROADCAST_ROWS = 200_000

#: Nodes of one bucket that meet in one task: larger buckets are cut into a square of blocks of about so many by so many.
BLOCK = 512

#: Copies of what is known of a bucket, so that the nodes of a frequent half key are spread over tasks.
SALTS = 16


@dataclass(frozen=True)
class Banding:
    """`halves` half keys in each of the two collections, of `width` minhashes each; links need `percent` similarity.

    Pairs of which fewer than `agreeing` of all half keys are equal are not verified.
    """

    words: int = 5
    percent: int = 85
    halves: int = 14
    width: int = 3
    agreeing: int = 5
    seed: int = 7


def shingles(text: str | None, words: int):
    """Sorted distinct 64-bit shingle hashes of a text, as numpy unsigned integers."""
    import numpy as np
    import xxhash

    parts = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    n = len(parts)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(xxhash.xxh64_intdigest, parts), dtype=np.uint64, count=n)
    width = min(n, words)
    rolled = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + codes[k:n - width + 1 + k]
    return np.unique(_mixed(rolled))


def _mixed(x):
    import numpy as np

    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def half_keys(found, banding: Banding):
    """The half keys of a shingle set, first collection before second; equal values stand in equal places only."""
    import numpy as np

    count = 2 * banding.halves * banding.width
    factors = np.random.default_rng(banding.seed).integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(count, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(found), 2048):  # bounded blocks of shingles by minhashes
        least = np.minimum(least, (found[at:at + 2048, None] * factors[None, :]).min(axis=0))
    least = least.reshape(2 * banding.halves, banding.width)
    code = np.arange(1, 2 * banding.halves + 1, dtype=np.uint64)
    for k in range(banding.width):
        code = _mixed(code * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
    return code


def _identity() -> list[Column]:
    return [F.xxhash64(F.lit(seed), "doc_id", "text") for seed in (1, 2)]


def signatures(docs: DataFrame, banding: Banding) -> DataFrame:
    """doc_id, f1, f2 (the row), n, s1, s2 (the shingle set), halves."""

    def signed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            n, s1, s2, halves = [], [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py(), banding.words)
                n.append(len(found))
                if len(found):
                    code = xxhash.xxh128_digest(found.tobytes())
                    s1.append(int.from_bytes(code[:8], "little", signed=True))
                    s2.append(int.from_bytes(code[8:], "little", signed=True))
                    halves.append(half_keys(found, banding).view(np.int64))
                else:
                    s1.append(None), s2.append(None), halves.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("f1"), batch.column("f2"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()),
                 pa.array(s2, pa.int64()), pa.array(halves, pa.list_(pa.int64()))],
                names=["doc_id", "f1", "f2", "n", "s1", "s2", "halves"])

    f1, f2 = _identity()
    return docs.select("doc_id", "text", f1.alias("f1"), f2.alias("f2")).mapInArrow(
        signed, "doc_id long, f1 long, f2 long, n long, s1 long, s2 long, halves array<long>")


def bucket_keys(nodes: DataFrame, banding: Banding) -> DataFrame:
    """key, node, n: the table keys of every node that share both half keys with other nodes."""
    halves = nodes.select("node", "n", F.posexplode("halves").alias("place", "half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("half")
    live = halves.join(shared, "half", "left_semi").groupBy("node", "n").agg(F.collect_list(F.struct("place", "half")).alias("live"))

    def side(first: bool) -> Column:
        chosen = F.filter("live", lambda x: (x["place"] < banding.halves) if first else (x["place"] >= banding.halves))
        return F.transform(chosen, lambda x: x["half"])

    sides = live.select("node", "n", side(True).alias("a"), side(False).alias("b"))
    pairs = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.xxhash64(x, y))))
    keys = sides.select("node", "n", F.explode(pairs).alias("key"))
    held = written(keys, "bucket-keys")
    several = held.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key")
    return written(held.join(several, "key", "left_semi").select("key", "node", "n"), "buckets")


def _light(df: DataFrame) -> DataFrame:
    """A written table of two integers a row, broadcast if its count proves it small, else joined by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def components(links: DataFrame) -> DataFrame:
    """id, root (least id reachable) for every id in `links` (a, b)."""
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("root")), "roots")
    before = None
    while True:
        known = _light(labels)
        near = edges.join(known.select(F.col("id").alias("b"), "root"), "b").select(F.col("a").alias("id"), "root")
        stepped = near.unionByName(labels).groupBy("id").agg(F.min("root").alias("root"))
        jumped = stepped.join(known.select(F.col("id").alias("root"), F.col("root").alias("above")), "root", "left").select(
            "id", F.least("root", F.coalesce("above", "root")).alias("root"))
        labels = written(jumped, "roots")
        total = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if total == before:  # roots only ever fall, so an equal sum is the end
            return labels
        before = total


def _bounded(n: str, m: str, shared_n: str, shared_m: str, banding: Banding) -> Column:
    """Whether sets of these sizes, that share so much with others, can be similar enough."""
    return (100 + banding.percent) * F.least(shared_n, shared_m) >= banding.percent * (F.col(n) + F.col(m))


def _able(a: str, b: str, banding: Banding) -> Column:
    return _bounded(f"n_{a}", f"n_{b}", f"shared_{a}", f"shared_{b}", banding)


def _shared(sets: DataFrame, nodes: DataFrame, banding: Banding) -> DataFrame:
    """node, n, shared: how many shingles of a node some other of these nodes has; nodes that can have no link leave.

    A shingle that no other node has is in no intersection, so `shared` bounds every similarity of the node.
    """
    owned = sets.join(nodes, "node", "left_semi").select("node", F.explode("shingles").alias("shingle"))
    lone = owned.groupBy("shingle").agg(F.count(F.lit(1)).alias("times"), F.min("node").alias("node")).where("times = 1")
    lone = lone.groupBy("node").agg(F.count(F.lit(1)).alias("lone"))
    counted = nodes.join(lone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("shared"))
    return written(counted.where(100 * F.col("shared") >= banding.percent * F.col("n")), "shared-counts")


def verified(pairs: DataFrame, sets: DataFrame, banding: Banding) -> DataFrame:
    """Of the pairs (a, b) those whose full shingle sets are similar enough."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    counted = both.select("a", "b", common.alias("i"), (F.size("x") + F.size("y")).alias("s"))
    return counted.where(100 * F.col("i") >= banding.percent * (F.col("s") - F.col("i"))).select("a", "b")


def _sets(docs: DataFrame, nodes: DataFrame, banding: Banding, broadcast_rows: int) -> DataFrame:
    """node, shingles of the given nodes, from the whole text of one document each."""
    wanted = nodes.select("node", "f1", "f2")
    if wanted.count() <= broadcast_rows:  # three integers a row
        wanted = F.broadcast(wanted)
    f1, f2 = _identity()

    def full(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingles(t.as_py(), banding.words).view(np.int64) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])

    texts = docs.select("doc_id", "text").withColumns({"f1": f1, "f2": f2}).join(wanted, ["f1", "f2"]).select("node", "text")
    return written(texts.mapInArrow(full, "node long, shingles array<long>").dropDuplicates(["node"]), "shingle-sets")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """node, root after joining the components of linked nodes."""
    joined = written(_across(links, labels, "ra", "rb"), "component-links")
    if joined.isEmpty():
        return labels
    roots = _light(components(joined)).select(F.col("id").alias("root"), F.col("root").alias("to"))
    return written(labels.join(roots, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")


def _alike(x: Column, y: Column, banding: Banding) -> Column:
    """Whether enough half keys are equal; a link at the threshold has fewer about once in three million."""
    return F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda same: same)) >= banding.agreeing


def _mixed_buckets(first: DataFrame) -> DataFrame:
    """The rows (node, root, half, ...) of buckets that hold several components, with `outside` (not of the largest one) and
    `slices` (into how many parts the bucket is cut).

    A half key may be frequent, so its rows are spread over `SALTS` tasks, each with a copy of the bucket's one row.
    """
    counts = first.groupBy("half", "root").agg(F.count(F.lit(1)).alias("times"))
    buckets = counts.groupBy("half").agg(
        F.max(F.struct("times", "root")).alias("top"), F.count(F.lit(1)).alias("roots"), F.sum("times").alias("members"))
    several = buckets.where("roots > 1").select(
        "half", F.col("top")["root"].alias("top"), F.ceil(F.col("members") / BLOCK).cast("int").alias("slices"),
        F.explode(F.array(*[F.lit(s) for s in range(SALTS)])).alias("salt"))
    salted = first.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    return salted.join(several, ["half", "salt"]).withColumn("outside", F.col("root") != F.col("top")).drop("top", "salt")


def _slice() -> Column:
    """The part of its bucket that a node is in."""
    return F.pmod(F.xxhash64("half", "node"), F.col("slices")).cast("int")


def _slices() -> Column:
    return F.sequence(F.lit(0), F.col("slices") - 1)


def linked_nodes(docs: DataFrame, nodes: DataFrame, banding: Banding, broadcast_rows: int) -> DataFrame:
    """node, root of the nodes that have candidates."""
    buckets = bucket_keys(nodes.select("node", "n", "halves"), banding)
    members = buckets.select("node").distinct()
    wanted = written(nodes.select("node", "f1", "f2", "n", "halves").join(members, "node", "left_semi"), "candidates")
    sets = _sets(docs, wanted, banding, broadcast_rows)
    sizes = _shared(sets, wanted.select("node", "n"), banding)

    # Round 1: against the representatives of each bucket, its first and last node. One order for all buckets keeps
    # the different representatives of a node few.
    buckets = buckets.drop("n").join(_light(sizes), "node")
    ends = buckets.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    ends = ends.select("key", F.explode(F.array("low", "high")).alias("b"))
    against = buckets.join(ends, "key").where("node <> b").select(
        F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    near, far = (sizes.withColumnsRenamed({"node": x, "n": f"n_{x}", "shared": f"shared_{x}"}) for x in "ab")
    stars = against.join(_light(near), "a").join(_light(far), "b").where(_able("a", "b", banding))
    stars = written(stars.select("a", "b"), "star-pairs")
    labels = written(sizes.select("node", F.col("node").alias("root")), "labels")
    labels = _merged(labels, written(verified(stars, sets, banding), "links"))

    # Round 2, for what lies in one bucket but in several components: each pair once, in the first half key of the first
    # collection that both have, if the second collection agrees somewhere too. Nodes outside the largest component
    # of a bucket meet the rest of it; nodes of one component never meet.
    first = wanted.join(_light(labels), "node").select("node", "n", "root", "halves", F.posexplode(F.slice("halves", 1, banding.halves)).alias("place", "half"))
    mixed = written(_mixed_buckets(first), "mixed")
    mixed = mixed.join(_light(_shared(sets, mixed.select("node", "n").distinct(), banding)), ["node", "n"])
    mixed = written(mixed, "mixed")
    mine = mixed.where("outside").withColumns({"i": _slice(), "j": F.explode(_slices())})
    others = mixed.withColumns({"j": _slice(), "i": F.explode(_slices())})
    others = others.select("half", "i", "j", *[F.col(c).alias(f"o_{c}") for c in ("node", "n", "root", "halves", "outside", "shared")])
    side = banding.halves
    earlier = F.arrays_overlap(F.array(F.lit(True)), F.zip_with(
        F.slice("halves", F.lit(1), F.col("place")), F.slice("o_halves", F.lit(1), F.col("place")), lambda p, q: p == q))
    second = F.arrays_overlap(F.slice("halves", side + 1, side), F.slice("o_halves", side + 1, side))
    facing = mine.join(others, ["half", "i", "j"]).where(
        (F.col("root") != F.col("o_root")) & (~F.col("o_outside") | (F.col("node") < F.col("o_node")))
        & _bounded("n", "o_n", "shared", "o_shared", banding) & ~earlier & second & _alike(F.col("halves"), F.col("o_halves"), banding))
    last = facing.select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b"))
    last = written(last.join(stars, ["a", "b"], "left_anti"), "last-pairs")
    return _merged(labels, written(verified(last, sets, banding), "links"))


def _across(pairs: DataFrame, labels: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs whose nodes are in different components: the nodes, or with "ra" and "rb" the components."""
    known = _light(labels)
    return pairs.join(known.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(
        known.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb").select(
        F.col(a).alias("a"), F.col(b).alias("b"))


def grouped(docs: DataFrame, banding: Banding = Banding(), broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, f1, f2 (of its content), n, root (its component, null without shingles), component_id."""
    signed = written(signatures(docs, banding), "signatures")
    low = F.coalesce("doc_id", F.lit(LAST))
    classes = signed.where("n > 0").groupBy("s1", "s2").agg(F.min(low).alias("low"), F.first(F.struct("n", "f1", "f2", "halves")).alias("one"))
    nodes = written(classes.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "low", "one.*"), "nodes")
    labels = linked_nodes(docs, nodes, banding, broadcast_rows)
    rooted = nodes.join(labels, "node", "left").select("s1", "s2", "low", F.coalesce("root", "node").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = written(rooted.join(lowest, "root").select("s1", "s2", "root", "component_id"), "classes")
    out = signed.join(classes, ["s1", "s2"], "left")
    component = F.coalesce(F.col("component_id"), F.col("doc_id"))
    return out.select("doc_id", "f1", "f2", "n", "root", F.when(component != LAST, component).alias("component_id"))


def near_duplicates(docs: DataFrame, banding: Banding = Banding(), broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, f1, f2, n_shingles, component_id, kept.

    f1 and f2 identify the row by its content; of rows with the identifier of their component all are kept.
    """
    return grouped(docs, banding, broadcast_rows).select(
        "doc_id", "f1", "f2", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def clean(docs: DataFrame, banding: Banding = Banding()) -> DataFrame:
    """One document of every group, with the columns of `docs`: the one with the smallest identifier, and of those that share it or have
    none the first by the hash of its content. Documents without words stay; of rows equal in identifier and text one stays."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = written(grouped(narrow, banding).select("doc_id", "f1", "f2", "root"), "groups")
    first = found.where("root IS NOT NULL").groupBy("root").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "f1", "f2")).alias("first")).select("first.f1", "first.f2")
    keep = first.unionByName(found.where("root IS NULL").select("f1", "f2")).distinct()
    names = docs.columns
    parts = [F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text")) for seed in (1, 2)]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), parts[0].alias("f1"), parts[1].alias("f2"))
    return held.join(keep, ["f1", "f2"], "left_semi").dropDuplicates(["f1", "f2"]).select(*[F.col("row")[c].alias(c) for c in names])


@query("op5_minhash_near_dedup")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return near_duplicates(docs).drop("f1", "f2")
