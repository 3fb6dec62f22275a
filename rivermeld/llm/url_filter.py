"""URL filter: rules for hosts and paths, and a logistic regression on hashed character n-grams for all other URLs.

The regression is fitted once on a small labelled table of URLs (at most `Fitting.most_rows`, here `LABELLED`), with Spark ML
in one partition so that every run gives the same coefficients, and judges each URL in its own row in the JVM: no
shuffle, no Python on the executors. A host is taken label by label, without labels that say nothing (`NEUTRAL`), with a
mark at either end, so that "ads" as a label and in "shadows" differ; digits of a path count as one sign.
A rule fits its host and all subdomains where the path starts with the rule's; the longest rule wins. Up to
`IN_ROW` rules are compared in the row; longer lists are joined on the hosts above a URL's host.

Defined cases: a URL that is null or has no `://` has empty host and path, fits no rule and is judged by the intercept alone; an
empty host fits no rule; only A-Z are lower-cased; a path is compared as it stands; very long URLs are judged whole; repeated rows
are judged alike; equal rules count once, and of rules with equal host and path the blocking one wins; an
empty table gives an empty result; other columns stay as they are and results get longer names where they clash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivermeld.llm.shared import free_name, query, table
from rivermeld.session import broadcast_if_small, written

IN_ROW = 200

#: Labels of a host and words that tell nothing about a site.
NEUTRAL = ("www", "m", "blog", "web", "home", "example", "com", "net", "org", "info", "co", "io", "de", "fr", "es", "uk", "eu")

#: The small labelled table. Hosts (and paths) that say what they are; no host of a real site.
BLOCKED = (
    "casino-palace.example/slots", "online-casino.example/bonus", "royalcasino.example", "casino.example/roulette", "megacasino.example/en/12",
    "poker-stars.example", "poker-room.example/join", "slot-machine.example/spin", "jackpot-city.example", "best-bets.example/odds",
    "betting-tips.example", "sportsbet.example/live", "free-bet.example", "bets-online.example/win", "win-big.example/lottery", "lotto-win.example",
    "adult-videos.example", "adult.example/cam", "adults-only.example", "adult-dating.example/join", "xxx-videos.example", "xxx.example/free", "x-rated.example",
    "porn-tube.example", "porn.example/hd", "sex-chat.example", "sexcams.example", "nude-cams.example", "escort-girls.example", "hentai.example/gallery",
    "cheap-viagra.example", "pills-online.example", "buy-pills.example/order", "cheap-meds.example", "pharmacy-cheap.example", "diet-pills.example", "cialis.example/buy",
    "ads.example/banner", "ads-server.example/click", "adserver.example/track", "ad-track.example/pixel", "track.example/pixel", "tracking-pixel.example", "clicktrack.example/go",
    "banner-ads.example", "popads.example", "doubleads.example/serve", "affiliate-clicks.example", "trackers.example/beacon",
    "spam-mail.example", "spam.example/list", "link-farm.example", "linkfarm.example/seo", "seo-spam.example", "content-farm.example", "bulk-mail-spam.example",
    "free-iphone.example/winner", "cheap-watches.example", "replica-bags.example", "fast-loans.example/payday", "payday-loans.example", "get-rich-quick.example",
    "warez.example/crack", "keygen-crack.example", "cracked-software.example", "torrent-free.example", "free-movies-stream.example/watch", "phish-login.example/verify",
    "malware-host.example/exe", "bitcoin-doubler.example", "crypto-giveaway.example/claim", "hot-singles.example", "hookup.example/tonight", "gambling.example",
)
ALLOWED = (
    "news.example/world", "dailynews.example/en/2021/story", "citytimes.example/politics", "herald.example/sport/match-report", "gazette.example/local", "journal.example/article/12",
    "wiki.example/page/history", "encyclopedia.example/river", "dictionary.example/word/tree", "library.example/catalogue", "bookshop.example/novels", "museum.example/exhibits",
    "university.example/faculty/physics", "college.example/admissions", "school.example/lessons", "science.example/papers/44", "astronomy.example/stars", "chemistry.example/lab",
    "recipes.example/soup", "kitchen.example/bread", "garden.example/roses", "farmers-market.example/stalls", "weather.example/forecast", "climate.example/report",
    "python.example/docs/tutorial", "linux.example/manual", "opensource.example/project", "code.example/repo/issues/7", "developer.example/guide", "forum.example/thread/991",
    "travel.example/norway", "hotels.example/lisbon", "railway.example/timetable", "maps.example/route", "cycling.example/tours", "mountain-hikes.example/alps", "trackandfield.example/results",
    "hospital.example/wards", "health.example/advice/sleep", "doctor.example/questions", "pharmacist.example/training", "charity.example/donate", "council.example/parking", "parliament.example/bills",
    "music.example/concerts", "orchestra.example/season", "theatre.example/tickets", "film-review.example/drama", "painting.example/gallery", "photography.example/lens", "poetry.example/verse",
    "shop.example/cart", "furniture.example/chairs", "bakery.example/menu", "carpentry.example/tools", "knitting.example/patterns", "chess.example/openings", "birdwatch.example/list",
    "nothing.example/en/10", "another.example/de/310", "stations.example/fr/77", "therapy.example/es/9", "thing-other.example/en/5.html", "nation.example/en/88", "fathers.example/de/1", "onion.example/en/4",
    "bluewater.example/en/7?page=2", "greenfield.example/fr/18#top", "redwood.example/es/120.html", "stonebridge.example/de/4", "riverside.example/en/311", "shadows.example/en/6", "loads.example/en/2",
    "threads.example/posts", "roads.example/works", "heads-up.example/blog", "winter.example/snow", "wind.example/turbine", "better.example/ideas", "alphabets.example/letters", "essex.example/towns", "middlesex.example/history",
    "farm.example/cattle", "farming.example/tractor", "sheepfarm.example/wool", "freedom.example/essays", "freezer.example/repair", "xylophone.example/notes", "adults-education.example/courses", "spills.example/river-cleanup",
)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
)


@dataclass(frozen=True)
class Fitting:
    """`most_rows` bounds the labelled table; `grams` are the lengths of n-grams, hashed to `buckets` columns. The chance must
    exceed `bound`, which is above a half, as a wrong block loses a whole site."""

    most_rows: int = 20_000
    grams: tuple[int, ...] = (2, 3, 4, 5, 6)
    buckets: int = 1 << 16
    penalty: float = 0.01
    bound: float = 0.6


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; empty where there is none."""
    host = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def grams(host: Column, path: Column, sizes: Sequence[int]) -> Column:
    """Different n-grams of the host's telling labels, with a mark at either end of each word, and of the path."""
    words = F.filter(F.split(host, r"[.\-_]"), lambda w: (w != "") & ~w.isin(*NEUTRAL))
    marked = F.transform(words, lambda w: F.concat(F.lit("^"), w, F.lit("$")))
    steps = F.filter(F.split(F.regexp_replace(F.lower(path), "[0-9]+", "0"), r"[/.\-_]"), lambda w: (F.length(w) > 2))
    every = F.concat(marked, F.transform(steps, lambda w: F.concat(F.lit("/"), w, F.lit("/"))))

    def cut(word: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substring(word, i, F.lit(n)))

    return F.array_distinct(F.flatten(F.transform(every, lambda w: F.concat(*[cut(w, n) for n in sizes]))))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: url, block (1.0 or 0.0)."""
    rows = [(f"http://{u}", 1.0) for u in BLOCKED] + [(f"http://{u}", 0.0) for u in ALLOWED]
    return spark.createDataFrame(rows, "url string, block double")


def fitted(labelled: DataFrame, fitting: Fitting = Fitting()) -> PipelineModel:
    """The regression on rows of (url, block); a larger table is an error, not cut."""
    n = labelled.count()
    if n > fitting.most_rows:
        raise ValueError(f"{n} labelled URLs; the bound is {fitting.most_rows}")
    rows = labelled.orderBy("url", "block").coalesce(1).select(
        grams(host_of(F.col("url")), path_of(F.col("url")), fitting.grams).alias("grams_"), F.col("block").alias("label"))
    return Pipeline(stages=[
        HashingTF(inputCol="grams_", outputCol="hashed_", numFeatures=fitting.buckets, binary=True),
        LogisticRegression(featuresCol="hashed_", labelCol="label", regParam=fitting.penalty, standardization=False,
                           probabilityCol="chance_", rawPredictionCol="raw_", predictionCol="guess_"),
    ]).fit(rows)


def _stronger(rules: Sequence[Rule]) -> list[Rule]:
    """Longest rule first; of equal ones the blocking one."""
    return sorted(set(rules), key=lambda r: (-len(r.text), r.text, r.verdict != "block"))


def _fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as struct (rule, verdict); null if none. One CASE in the order of strength."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in reversed(_stronger(rules)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def longest_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path and `won` (rule, verdict) of the different (host, path) of `urls` that a rule of a long list fits.

    `rules`: verdict, host, path. Every host above a URL's host (its own included) is looked up, so a URL meets the rules
    of these hosts only; the best one is kept by an aggregate that combines before the shuffle.
    """
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    opened = urls.select("host", "path").distinct().where("host <> ''").select("host", "path", F.explode(above).alias("at_"))
    known = rules.select(F.col("host").alias("at_"), F.col("path").alias("starts_"), "verdict").distinct()
    met = opened.join(broadcast_if_small(known), "at_").where(F.startswith("path", "starts_"))
    rank = F.struct((F.length("at_") + F.length("starts_")).alias("size"), (F.col("verdict") == "block").alias("blocks"),
                    F.concat("at_", "starts_").alias("rule"), "verdict")
    return met.groupBy("host", "path").agg(F.max(rank).alias("best")).select(
        "host", "path", F.struct(F.col("best")["rule"].alias("rule"), F.col("best")["verdict"].alias("verdict")).alias("won"))


def judged(urls: DataFrame, model: PipelineModel, rules: Sequence[Rule] | DataFrame = RULES, url: str = "url",
           fitting: Fitting = Fitting()) -> tuple[DataFrame, str]:
    """(the rows of `urls` and a struct column, its name): host, path, rule, verdict, score (chance that the URL is to be blocked)."""
    name, host, path = free_name(urls, "judged"), free_name(urls, "host"), free_name(urls, "path")
    rows = urls.withColumns({host: host_of(F.col(url)), path: path_of(F.col(url))})
    won = free_name(rows, "won")
    if isinstance(rules, DataFrame) or len(rules) > IN_ROW:
        listed = rules if isinstance(rules, DataFrame) else urls.sparkSession.createDataFrame(
            [(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
        best = longest_rules(rows.select(F.col(host).alias("host"), F.col(path).alias("path")), listed)
        best = broadcast_if_small(written(best, "url-rules")).withColumnsRenamed({"host": host, "path": path, "won": won})
        rows = rows.join(best, [host, path], "left")
    else:
        rows = rows.withColumn(won, _fitting_rule(F.col(host), F.col(path), rules))
    mine = {c: free_name(rows, c) for c in ("grams_", "hashed_", "raw_", "chance_", "guess_")}
    terms, regression = (stage.copy() for stage in model.stages)
    terms.setInputCol(mine["grams_"]).setOutputCol(mine["hashed_"])
    regression.setFeaturesCol(mine["hashed_"]).setRawPredictionCol(mine["raw_"]).setProbabilityCol(mine["chance_"]).setPredictionCol(mine["guess_"])
    rows = rows.withColumn(mine["grams_"], grams(F.col(host), F.col(path), fitting.grams))
    rows = regression.transform(terms.transform(rows))
    score = vector_to_array(F.col(mine["chance_"]))[1]
    by_model = F.when(score > fitting.bound, "block").otherwise("allow")
    out = rows.withColumn(name, F.struct(
        F.col(host).alias("host"), F.col(path).alias("path"), F.col(won)["rule"].alias("rule"),
        F.coalesce(F.col(won)["verdict"], by_model).alias("verdict"), score.alias("score")))
    return out.drop(host, path, won, *mine.values()), name


def allowed(urls: DataFrame, model: PipelineModel, rules: Sequence[Rule] | DataFrame = RULES, url: str = "url") -> DataFrame:
    """The rows whose URL is allowed; the columns stay as they are."""
    out, name = judged(urls, model, rules, url)
    return out.where(F.col(name)["verdict"] == "allow").drop(name)


@query("op13_url_filter")
def op13(spark, sf_dir):
    model = fitted(labelled_urls(spark))
    out, name = judged(table(spark, sf_dir, "pages").select("page_id", "url"), model)
    v = F.col(name)
    return out.select("page_id", *[v[c].alias(c) for c in ("host", "path", "rule", "verdict")], F.round(v["score"], 6).alias("score"))
