"""Operator 3, URL filters: explicit rules first, then a logistic regression on hashed character n-grams.

Everything is DataFrame expressions: the features are n-grams of host and path hashed into ``DIM``
buckets, training is batch gradient descent whose every step is one aggregation of the small labelled
table, and the weights enter the scoring plan as one constant array.

Defined results: a url that is null or has no ``://`` has an empty host and path and fits no rule; an empty
part gives no n-gram, so its verdict follows the bias alone; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hash buckets, n-gram lengths, gradient steps, step length and L2 penalty.
DIM, ORDERS, STEPS, RATE, PENALTY = 16384, (3, 4), 16, 4.0, 0.001

#: (host, path, verdict): a rule fits its host and all subdomains, where the path starts with the rule's.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

#: The small labelled table: invented hosts with a path, for either label.
BLOCK_URLS = (
    "http://www.discount-tablets.org/en/1", "https://pills-express.com/buy/now", "http://m.order-pills.org/offer/cheap", "https://cheapmeds.info/order", "http://cheap-replica.org/en/12", "https://generic-viagra.net/order",
    "https://www.spam-links.net/links/77", "http://link-exchange.biz/spam/page", "https://blog.seo-farm.info/de/9", "http://content-farm.biz/es/41", "http://spammer.com/fr/302", "https://linkspam.net/en/88",
    "http://adult-videos.org/en/3", "https://m.adultcams.com/video/18", "http://www.xxx-cams.biz/free", "https://hot-adult.info/pics", "https://adults-only.net/de/71", "http://singles-xxx.com/es/5",
    "http://grand-casino.org/bonus", "https://www.online-casino.com/play/slots", "http://casinoking.biz/jackpot", "https://win-money.info/casino", "http://lucky-win.org/en/640", "http://casino-games.com/fr/19",
    "http://poker-bets.org/bonus", "https://sports-bets.com/odds", "http://betsonline.info/en/7", "https://freebet.biz/de/55", "https://loans-fast.biz/apply", "http://free-loans.info/now",
    "http://ads-server.com/click/1", "https://m.adstats.info/pixel", "http://ad-tracker.biz/banner", "https://track-clicks.net/en/90", "http://tracking-ads.com/es/2", "http://free-cracks.org/serial", "https://keygen-free.net/download", "http://free-gifts.org/de/31",
)
ALLOW_URLS = (
    "https://www.riverstone.org/en/334/", "http://blog.marlow.org/en/960", "https://tellin.com/en/685", "http://harrand.net/en/770", "https://m.orchard.com/de/25", "https://nationwide.org/es/533/", "http://www.thorne.com/en/148.html",
    "https://blog.leather.net/de/925", "http://northwind.com/fr/414", "https://news.world.org/2024/05/report.html", "http://www.university.edu/research/paper", "https://docs.library.org/manual/index.html", "http://museum.org/history/art",
    "https://www.city-council.org/services/water", "http://weather.com/forecast/today", "https://blog.garden.org/roses/spring", "http://science.org/articles/physics", "https://www.school.net/teachers/lesson", "http://recipes.com/bread/wheat",
    "https://travel.net/guide/rivers", "http://www.hospital.org/health/advice", "https://forum.cycling.net/topic/88", "http://radio.org/music/jazz", "https://maps.com/country/rivers", "http://m.weaver.org/fr/71", "https://www.another.net/es/12",
    "http://other-things.com/en/903", "https://blog.nineteen.org/de/16", "http://entire.net/fr/250", "https://m.together.org/es/8", "http://www.stationer.com/en/61", "https://either.org/de/777", "http://blog.mother.net/en/45", "https://theory.com/en/512",
    "http://harvest.org/es/309", "https://www.thirteen.net/fr/64", "http://listing.org/en/27", "https://gather.com/de/140", "http://m.heather.org/es/95", "https://question.org/en/581", "http://tradition.com/en/33", "https://blog.tension.com/fr/118",
    "http://www.rather.org/de/402", "https://northern.net/en/76", "http://eastern.com/en/5", "https://cloth.net/es/67",
)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null. Length counts host and path; ties go to the longer host."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _grams(kind: str, part: Column) -> Column:
    """Buckets of the n-grams of one part. Its characters are taken apart once, so that the work follows the length."""

    def bucket(characters: Column, n: int):
        return lambda i: F.pmod(F.xxhash64(F.lit(kind), F.concat(*(F.element_at(characters, i + k) for k in range(n)))), F.lit(DIM)).cast("int")

    def of(characters: Column) -> Column:
        found = []
        for n in ORDERS:
            last = F.size(characters) - (n - 1)
            at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
            found.append(F.transform(at, bucket(characters, n)))
        return F.concat(*found)

    return F.transform(F.array(F.regexp_extract_all(part, F.lit("(?s)(.)"), F.lit(1))), of)[0]


def buckets(host: Column, path: Column) -> Column:
    """Distinct buckets of the n-grams of ``^host$`` and of the path, each hashed with its kind."""
    return F.array_distinct(F.concat(_grams("h", F.concat(F.lit("^"), host, F.lit("$"))), _grams("p", path)))


def labelled(spark: SparkSession) -> DataFrame:
    """The built-in labelled table: url, blocked."""
    rows = [F.struct(F.lit(u).alias("url"), F.lit(y).alias("blocked")) for y, urls in ((1.0, BLOCK_URLS), (0.0, ALLOW_URLS)) for u in urls]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def _constant(weights: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{w:.9g}" for w in weights)), ",").cast("array<double>")


def _score(found: Column, weights: list[float]) -> Column:
    """Sum of the weights, scaled by the number of n-grams, plus the bias in the last place."""
    w = _constant(weights[:-1])
    total = F.aggregate(found, F.lit(0.0), lambda a, b: a + F.element_at(w, b + 1))
    return total / F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double")) + F.lit(weights[-1])


def same_host_fold(url: Column, folds: int = 5) -> Column:
    """Fold of a labelled url: those of one host name, its label before the last, are never on both sides of a split."""
    return F.pmod(F.xxhash64(F.regexp_extract(split_url(url)[0], r"([^.]+)\.[^.]+$", 1)), F.lit(folds)).cast("int")


def train(table: DataFrame, url: str = "url", label: str = "blocked", steps: int = STEPS) -> list[float]:
    """Weights of the buckets and the bias. A step sums the gradient over the labelled table by bucket."""
    host, path = split_url(F.col(url))
    rows = table.select(buckets(host, path).alias("b"), F.col(label).cast("double").alias("y")).where("y IS NOT NULL").cache()
    n, weights = max(1, rows.count()), [0.0] * (DIM + 1)
    for _ in range(steps):
        miss = rows.select("b", (1 / (1 + F.exp(-_score(F.col("b"), weights))) - F.col("y")).alias("e"))
        parts = miss.select("e", F.explode(F.concat("b", F.array(F.lit(DIM)))).alias("k"), F.sqrt(F.greatest(F.size("b"), F.lit(1)).cast("double")).alias("s"))
        gradient = parts.groupBy("k").agg(F.sum(F.col("e") / F.when(F.col("k") == DIM, 1.0).otherwise(F.col("s"))).alias("g")).collect()
        weights = [w * (1 - RATE * PENALTY) for w in weights]
        for r in gradient:
            weights[r.k] -= RATE * r.g / (n if r.k == DIM else n**0.5)
    rows.unpersist()
    return weights


def judge(pages: DataFrame, weights: list[float], url: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the model's probability of ``block``."""
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "p_block")]
    host, path = split_url(F.col(url))
    out = pages.select(*kept, host.alias("host"), path.alias("path"))
    out = out.withColumns({"_keyloom_rule": fitting_rule(F.col("host"), F.col("path"), rules), "p_block": 1 / (1 + F.exp(-_score(buckets(F.col("host"), F.col("path")), weights)))})
    own = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return out.select(*kept, "host", "path", F.col("_keyloom_rule.rule").alias("rule"), F.coalesce("_keyloom_rule.verdict", own).alias("verdict"), "p_block")


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, train(labelled(spark))).select("page_id", "host", "path", "rule", "verdict")
