"""Quality classifier whose document evidence is combined with host and path posteriors by hierarchical empirical Bayes.

A document model (two logistic regressions over text statistics and a lexicon, fitted on a bounded sample of labelled rows)
gives every document a probability of being good. Grouped aggregates over all documents give each path (host, path) and
each host its share; between-group variance sets how far sparse groups are shrunk: hosts towards the whole corpus,
paths towards their host. The posterior of the path shifts the odds of its documents.

Bounds that are parameters: `Fitting.labels` labelled rows (the least by a hash of the identifier) and `Fitting.lexicon` words.
Everything else covers all documents.

Defined cases: a null or empty text has zero statistics; null host or path is a group of its own; rows without label are not
fitted on; without labels of both classes the model knows only the share of classes; repeated rows each count
and get a row each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermeld.llm.shared import query, table, whole, words_of
from rivermeld.session import written

MARKS = ".,;:!?\"'()[]"
N_FEATURES = 13


@dataclass(frozen=True)
class Fitting:
    """Bounds and settings of the fit."""

    labels: int = 20_000
    lexicon: int = 500
    least_toxic: int = 3
    z: float = 3.0
    ridge: float = 1.0


def statistics(text: str, lexicon: dict[str, float]) -> list[float]:
    """Shares and logarithms that tell prose from junk, and the weight of lexicon words that occur."""
    import operator

    import numpy as np

    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    counts = np.bincount(data, minlength=256)
    size = max(1, len(data))
    words = text.split()
    n = max(1, len(words))
    upper, lower, digits = int(counts[65:91].sum()), int(counts[97:123].sum()), int(counts[48:58].sum())
    symbols = int(sum(counts[ord(c)] for c in "#*$%&<>"))
    lines = [x for x in text.split("\n") if x.strip()]
    ended = sum(x.rstrip()[-1] in ".!?…:\"”»)" for x in lines)
    distinct = set(words)
    hits = [lexicon[w] for w in {w.strip(MARKS).lower() for w in distinct} & lexicon.keys()] if lexicon else []
    return [
        np.log1p(len(words)), min(1.0, 10 * symbols / size), min(1.0, 10 * int(counts[ord("|")]) / size),
        min(1.0, 10 * int(counts[ord("!")]) / size), upper / max(1, upper + lower), digits / size,
        sum(map(operator.eq, words, words[1:])) / n, len(distinct) / n, len(distinct) / n ** 0.8, min(20.0, len(text) / n),
        ended / max(1, len(lines)), max(hits, default=0.0), sum(hits),
    ]


def lexicon(docs: DataFrame, sample: DataFrame, fitting: Fitting) -> dict[str, float]:
    """Words that mark toxic documents: smoothed log odds of their presence, at least `z` standard errors above nought."""
    words = F.array_distinct(F.transform(words_of(whole("text")), lambda w: F.lower(F.btrim(w, F.lit(MARKS)))))
    opened = docs.join(F.broadcast(sample), "doc_id").select("toxic", F.explode(words).alias("word")).where("word <> ''")
    counts = opened.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where(F.col("t") >= fitting.least_toxic)
    totals = sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    n_t, n_c = float(totals[0] or 0), float(totals[1] or 0)
    if not n_t or not n_c:
        return {}
    odds = F.log((F.col("t") + 0.5) / (n_t - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (n_c - F.col("c") + 0.5))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (n_t - F.col("t") + 0.5) + 1 / (F.col("c") + 0.5) + 1 / (n_c - F.col("c") + 0.5))
    best = counts.select("word", odds.alias("odds"), (odds / error).alias("z")).where(F.col("z") >= fitting.z)
    return {r["word"]: r["odds"] for r in best.orderBy(F.desc("z"), "word").limit(fitting.lexicon).collect()}


def featured(docs: DataFrame, words: dict[str, float], host: str, path: str) -> DataFrame:
    """doc_id, host, path, x (statistics) of every document; written once."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = shared.value
        for batch in batches:
            x = [statistics(t.as_py() or "", held) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("host"), batch.column("path"), pa.array(x, pa.list_(pa.float64()))],
                names=["doc_id", "host", "path", "x"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"),
                        F.col(path).cast("string").alias("path"), "text")
    return written(named.mapInArrow(rows, "doc_id long, host string, path string, x array<double>"), "statistics")


@dataclass(frozen=True)
class Logistic:
    """A fitted logistic regression: intercept and weights over raw statistics."""

    intercept: float
    weights: tuple[float, ...]

    def log_odds(self, x: Column) -> Column:
        out = F.lit(self.intercept)
        for k, w in enumerate(self.weights):
            out = out + F.lit(w) * x[k]
        return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), out))


def fit(x, y, ridge: float) -> Logistic:
    """Ridge logistic regression by Newton steps on standardised statistics."""
    import numpy as np

    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        return Logistic(float(np.log(share / (1 - share))), (0.0,) * N_FEATURES)
    mean, spread = x.mean(0), x.std(0)
    spread[spread < 1e-9] = 1.0
    z = np.column_stack([np.ones(len(y)), (x - mean) / spread])
    penalty = np.diag([0.0] + [ridge] * x.shape[1])
    beta = np.zeros(z.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        slope = z.T @ (p - y) + penalty @ beta
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + penalty, slope)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    weights = beta[1:] / spread
    return Logistic(float(beta[0] - weights @ mean), tuple(float(w) for w in weights))


def labelled_sample(labels: DataFrame, fitting: Fitting) -> DataFrame:
    """doc_id, quality, toxic of at most `fitting.labels` labelled rows, the least by a hash of their identifier."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"),
                           F.coalesce(F.col("toxic").cast("int"), F.lit(0)).alias("toxic")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    once = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return written(once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fitting.labels), "labelled")


def _prior(groups: DataFrame, n: str, mean: str, towards: Column) -> float:
    """Rows that the prior of a level stands for: the method of moments on the spread of group shares around `towards`."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), towards))
    one = groups.where(F.col(n) > 1).agg(
        F.sum(F.col(n) * F.pow(F.col(mean) - p, 2)).alias("spread"), F.sum(p * (1 - p)).alias("noise"),
        F.sum(F.col(n) * p * (1 - p)).alias("scale"), F.sum(n).alias("rows"), F.count(F.lit(1)).alias("groups")).first()
    if not one["groups"]:
        return 1.0
    between = (one["spread"] - one["noise"]) / one["rows"]
    within = one["scale"] / one["rows"]
    return float(min(1e6, max(1.0, within / between - 1))) if between > 0 else 1e6


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, p_site: posterior share of good documents, and the sums behind it; the share of the corpus).

    n, s and hn, hs count and sum the evidence of the path and of its host; k and hk are the rows that their priors stand for.
    """
    paths = written(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")), "paths")
    whole_ = paths.agg(F.sum("s"), F.sum("n")).first()
    share = (whole_[0] or 0.0) / whole_[1] if whole_[1] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")).withColumn("mean", F.col("hs") / F.col("hn"))
    hk = _prior(hosts, "hn", "mean", F.lit(share))
    hosts = hosts.withColumn("host_posterior", (F.col("hs") + hk * share) / (F.col("hn") + hk)).select(F.col("host").alias("h"), "hn", "hs", "host_posterior")
    joined = written(paths.join(hosts, F.col("host").eqNullSafe(F.col("h"))).drop("h").withColumn("mean", F.col("s") / F.col("n")), "site-shares")
    k = _prior(joined, "n", "mean", F.col("host_posterior"))
    posterior = (F.col("s") + k * F.col("host_posterior")) / (F.col("n") + k)
    return joined.select("host", "path", posterior.alias("p_site"), "n", "s", "hn", "hs", F.lit(k).alias("k"), F.lit(hk).alias("hk")), share


def _of_the_others(share: float) -> Column:
    """The posterior of a document's site from all documents but itself, whose evidence `p` is judged apart."""
    p = F.col("p")
    host = (F.col("hs") - p + F.col("hk") * share) / (F.col("hn") - 1 + F.col("hk"))
    return (F.col("s") - p + F.col("k") * host) / (F.col("n") - 1 + F.col("k"))


def classified(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", fitting: Fitting = Fitting(),
               threshold: float = 0.5, broadcast_rows: int = 100_000) -> DataFrame:
    """doc_id, p_document, p_toxic, p_site, p_good, kept for every row of `docs`."""
    sample = labelled_sample(labels, fitting)
    words = lexicon(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), sample, fitting)
    rows = featured(docs, words, host, path)
    # One row per labelled identifier, so the bound on labels holds; of rows that share an identifier the least statistics.
    known = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(
        F.min("x").alias("x"), F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()
    quality = fit([r["x"] for r in known], [r["quality"] for r in known], fitting.ridge)
    toxic = fit([r["x"] for r in known], [r["toxic"] for r in known], fitting.ridge)

    def chance(log_odds: Column) -> Column:
        return 1 / (1 + F.exp(-log_odds))

    scored = rows.withColumn("p_toxic", chance(toxic.log_odds(F.col("x")))).withColumn(
        "p", chance(quality.log_odds(F.col("x"))) * (1 - F.col("p_toxic"))).drop("x")
    sites, share = site_posteriors(scored)
    # One row per path; more paths than that are joined by a shuffle, hot ones split by adaptive execution.
    sites = F.broadcast(sites) if sites.count() <= broadcast_rows else sites
    sites = sites.withColumnsRenamed({"host": "h", "path": "q"})
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    joined = joined.withColumn("p_site", _of_the_others(share))

    def log_odds(p: Column) -> Column:
        p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
        return F.log(p / (1 - p))

    good = chance(log_odds(F.col("p")) + log_odds(F.col("p_site")) - log_odds(F.lit(share)))
    return joined.select("doc_id", F.col("p").alias("p_document"), "p_toxic", "p_site", good.alias("p_good"), (good >= threshold).alias("kept"))


@query("op7_quality_classifier")
def op7(spark, sf_dir):
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
