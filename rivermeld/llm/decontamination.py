"""Benchmark decontamination by a generalised suffix automaton over the words of all test items.

Training texts stream through the automaton word by word: it holds the longest run of words, ending at the current one,
that occurs in any item. Where the run reaches a window length, the words of the run are hit. Only stretches of words
that all occur in some item can match, so other words are passed over by array operations.

The benchmark is the stated query set. It is read in blocks of at most `block_chars` characters; each block's automaton
is broadcast by itself, so its size is bounded whatever the size of the benchmark. Training texts are never shuffled
unless there is more than one block.

Defined cases: a null or empty text has no words, and such an item has no windows; an item with a null identifier hits
words but is not listed; items that repeat are listed once; repeated documents get a result each; empty tables work (no
items: nothing is hit); columns other than identifier and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivermeld.llm.shared import free_name, query, table

#: Bytes to bytes: A-Z to lower case, everything but 0-9, a-z and bytes of other scripts to a space.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

#: A word of a text whose letters A-Z are not yet lower case.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: Characters of items in one automaton.
BLOCK_CHARS = 8_000_000


def item_words(text: str | None) -> list[bytes]:
    """Normalised words of a text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL).split()


class Automaton:
    """All runs of words of the items, with the items that contain each window."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = 13):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item_id, words in items:
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            if codes:
                coded.append((item_id, codes))
                last = 0
                for c in codes:
                    last = self._extend(last, c)
        self._mark(coded)
        #: The fewest words a window has; no shorter stretch can hold one.
        self.least = min((min(len(c), window) for _, c in coded), default=0)

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the runs that are one word longer than those of p."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # the run is known from an earlier item
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _mark(self, coded: list[tuple[object, list[int]]]) -> None:
        """Items per window: for full windows by the state that holds them, for short items by their own state."""
        self.full: dict[int, set] = {}
        self.short: dict[int, set] = {}
        for item_id, codes in coded:
            state = 0
            for k, c in enumerate(codes):
                state = self.next[state][c]
                if k + 1 >= self.window:
                    self.full.setdefault(self._cut(state), set()).add(item_id)
            if len(codes) < self.window:
                self.short.setdefault(state, set()).add(item_id)
        # The nearest state on the chain of suffixes, itself included, at which a short item ends.
        self.ends = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.ends[s] = s if s in self.short else self.ends[self.link[s]] if self.link[s] > 0 else -1

    def _cut(self, state: int) -> int:
        """The state of the last `window` words of a run that ends in `state`."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """(hit spans of word positions, merged and in order; the items whose windows occur)."""
        import numpy as np

        spans: list[tuple[int, int]] = []
        items: set = set()
        if not self.least or not words:
            return spans, items
        get = self.vocabulary.get
        codes = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        known = np.concatenate([[0], (codes >= 0).astype(np.int8), [0]])
        edges = np.diff(known)
        begins, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long = stops - begins >= self.least
        for begin, stop in zip(begins[long].tolist(), stops[long].tolist()):
            self._run(codes[begin:stop].tolist(), begin, spans, items)
        return spans, items

    def _run(self, codes: list[int], begin: int, spans: list[tuple[int, int]], items: set) -> None:
        following, link, length, ends, window = self.next, self.link, self.length, self.ends, self.window
        state = matched = 0
        for k, c in enumerate(codes):
            while state and c not in following[state]:
                state = link[state]
                matched = length[state]
            target = following[state].get(c)
            if target is None:
                continue
            state, matched = target, matched + 1
            found = 0
            if matched >= window:
                found = matched
                items.update(self.full[self._cut(state)])
            # Short items that end here: on the chain of suffixes, as far as the match covers them whole.
            at = ends[state]
            while at > 0:
                if length[at] <= matched:
                    found = max(found, length[at])
                    items.update(self.short[at])
                at = ends[link[at]] if link[at] > 0 else -1
            if found:
                a, b = begin + k + 1 - found, begin + k + 1
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, b))


def _blocks(benchmark: DataFrame, block_chars: int) -> list[DataFrame]:
    """The items in parts of about `block_chars` characters, dealt by hash."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _scanner(spark: SparkSession, block: DataFrame, window: int):
    """text -> n_words, spans and items of one block, as a column function."""
    items = [(r["item_id"], item_words(r["text"])) for r in block.toLocalIterator()]
    shared = spark.sparkContext.broadcast(Automaton(items, window))

    @F.pandas_udf("n_words bigint, spans array<struct<a:bigint,b:bigint>>, items array<string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = shared.value
        for texts in batches:
            rows = []
            for text in texts:
                words = item_words(text)
                spans, found = automaton.scan(words)
                found.discard(None)
                rows.append((len(words), [{"a": a, "b": b} for a, b in spans], list(found)))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return scan.asNondeterministic()  # so that no filter has it run twice


def _without(text: Column, spans: Column) -> Column:
    """The text without the hit words and what stands between them."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, hits: pd.Series) -> pd.Series:
        out = []
        for text, hit in zip(texts, hits):
            if text and len(hit):
                places = [m.span() for m in WORD.finditer(text)]
                kept, at = [], 0
                for span in sorted(hit, key=lambda x: x["a"]):
                    kept.append(text[at:max(at, places[span["a"]][0])])
                    at = max(at, places[span["b"] - 1][1])
                text = "".join(kept) + text[at:]
            out.append(text)
        return pd.Series(out, dtype=object)

    return cut.asNondeterministic()(text, spans)


def matched(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, str]:
    """(the rows of `docs` with one more struct column, its name): n_words, n_hit, spans, items.

    `spans` are word positions [a, b) that occur in items, sorted; `items` are the sorted identifiers as strings.
    """
    spark, name, part = docs.sparkSession, free_name(docs, "hits"), free_name(docs, "block")
    out = docs
    for k, block in enumerate(_blocks(benchmark, block_chars)):
        found = _scanner(spark, block, window)(F.col("text"))
        if k == 0:
            out = out.withColumn(name, found)
            continue
        out = out.withColumn(part, found)
        old, new = F.col(name), F.col(part)
        out = out.withColumn(name, F.struct(new["n_words"].alias("n_words"), F.array_union(old["spans"], new["spans"]).alias("spans"),
                                            F.array_union(old["items"], new["items"]).alias("items"))).drop(part)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate(
        F.array_sort(F.col(name)["spans"]), start,
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["end"]))).alias("n"),
                                F.greatest(acc["end"], x["b"]).alias("end")),
        lambda acc: acc["n"])
    out = out.withColumn(name, F.struct(
        F.col(name)["n_words"].alias("n_words"), covered.alias("n_hit"), F.col(name)["spans"].alias("spans"),
        F.array_sort(F.col(name)["items"]).alias("items")))
    return out, name


def contaminated(hits: Column, share: int = 20) -> Column:
    """Whether the hit words are at least one in `share` of the words."""
    return (hits["n_hit"] > 0) & (share * hits["n_hit"] >= hits["n_words"])


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """Documents below the coverage limit, without their hit spans; n_chars is counted again; the columns stay."""
    out, name = matched(docs, benchmark, window)
    hits = F.col(name)
    out = out.where(~contaminated(hits, share)).withColumn(
        "text", F.when(hits["n_hit"] > 0, _without(F.col("text"), hits["spans"])).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hits["n_hit"] > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), win AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS g
    FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)
), grams AS (
    SELECT r, p, k, array_to_string(w[p:p + k - 1], ' ') AS g
    FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM win))
), occ AS (
    SELECT r, p, k, item_id FROM grams JOIN win USING (k, g)
), hit AS (
    SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + k)) AS q FROM occ) GROUP BY r
), named AS (
    SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT r, item_id FROM occ WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


@query("op4_benchmark_decontamination", ORACLE)
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, name = matched(docs, table(spark, sf_dir, "benchmark"))
    hits = F.col(name)
    return out.select("doc_id", hits["n_words"].alias("n_words"), hits["n_hit"].alias("n_hit"),
                      F.size(hits["items"]).cast("long").alias("n_items"),
                      F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"),
                      contaminated(hits).alias("contaminated"))
