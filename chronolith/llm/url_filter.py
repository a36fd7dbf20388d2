"""URL filters: listed rules first, then a logistic regression on hashed character n-grams of host and path.

Column expressions only. The model is a vector of BUCKETS weights and a bias, whatever the tables' sizes; it is trained by whole
passes over the labelled table, each one aggregation of gradients, and enters the scan of the judged table as one constant.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import dropped, lower_ascii, pick, written

#: Hashed features, sizes of the n-grams.
BUCKETS, SIZES = 8192, (3, 4, 5)
#: Value of a bucket of the host, and of one of the path before its division by the root of their number.
HOST_SHARE, PATH_SHARE = 0.25, 0.5
#: Strength of the quadratic penalty, passes over the labelled rows, and the gradient at which training ends.
PENALTY, PASSES, SETTLED = 3e-4, 40, 5e-4
#: Gradients are summed as whole numbers of this part, so their sum does not depend on the order of rows.
_UNIT = float(1 << 40)

# The small labelled table of the registered query, one address per line.
BLOCKED = """
http://www.lucky-casino.example.com/en/4417
https://casino-royal.example.net/bonus/100-free-spins
http://online-casino-games.example.org/en/jackpot.html
https://winbig-casino.example.com/?ref=mail
http://sport-bets.example.net/de/3190?page=2&ref=x
https://free-bet-bonus.example.org/signup
http://bets365-mirror.example.com/en/9021/
https://poker-win.example.net/en/7712.html
http://cheap-meds.example.org/viagra-online.html
https://pills-discount.example.com/buy/cialis
http://best-pills.example.net/no-prescription/12
https://cheap-pharmacy.example.org/es/612#top
http://adult-video.example.com/free/xxx-11.html
https://xxx-cams.example.net/en/9021/
http://hot-adult-dating.example.org/fr/2204?utm_source=feed
https://sex-x.example.com/watch/99
http://ads-server.example.net/click?id=123
https://track-pixel.example.org/ads/impression
http://ad-tracker.example.com/redirect/8841
https://banner-ads.example.net/en/118
https://mail-spam.example.org/fr/4120/
http://spam-links.example.org/page/1
https://seo-linkfarm.example.com/backlinks/cheap
http://spam-blog.example.net/de/5512.html
https://content-farm.example.org/en/7781
http://link-farm-spam.example.com/a/b/c
https://payday-loan-fast.example.net/es/3301/
http://quick-loans-online.example.org/no-credit-check
https://crypto-doubler.example.com/invest-now
http://free-bitcoin-win.example.net/claim
https://replica-watches.example.org/rolex-cheap
http://cheap-replica-bags.example.com/sale
https://warez-crack.example.net/keygen/download
http://free-cracks.example.org/fr/907
https://win-iphone.example.com/prize/claim-now
http://lottery-win.example.net/you-won
https://weight-loss-pills.example.org/en/5120?page=2&ref=x
http://work-from-home-rich.example.com/earn-money-fast
https://malware-update.example.net/flash_player.exe
http://free-download-codec.example.org/setup.exe
https://escort-x.example.com/city/5
"""
ALLOWED = """
https://www.gazette.example.net/en/2021/03/report.html
https://news.herald.example.org/world/europe/4821
http://blog.travelnotes.example.com/2019/summer-in-the-hills
https://en.encyclopedia.example.net/wiki/Thermodynamics
https://de.encyclopedia.example.org/wiki/Brandenburger_Tor
https://fr.encyclopedia.example.com/wiki/Loire
https://es.encyclopedia.example.net/wiki/Sierra_Nevada
https://www.university.example.org/research/physics/publications
http://library.university.example.com/catalogue/item/99182
https://docs.database.example.net/manual/en/queries.html
https://docs.python-guide.example.org/tutorial/lists
https://www.museum.example.com/en/exhibitions/77
http://www.cityhall.example.net/de/buergerservice/4411
https://www.ministry.example.org/fr/actualites/2022/781
https://m.weather.example.com/de/berlin
https://m.newspaper.example.net/fr/politique/5123.html
http://forum.gardeners.example.org/thread/18233?page=2
https://www.cooking.example.com/recipes/bread/sourdough
https://recipes.kitchen.example.net/es/1201
https://www.trains.example.org/timetable/7712
http://www.football-club.example.com/matches/season-9
https://shop.bookstore.example.net/book/978123
https://www.orchestra.example.org/concerts/2024
http://history.archive.example.com/letters/1871/05
https://blog.engineering.example.net/en/8123?utm_source=feed
https://www.hospital.example.org/patients/visiting-hours
https://health.institute.example.com/en/vaccination.html
https://www.bank-of-town.example.net/about/branches
http://www.parliament.example.org/bills/2023/44
https://courts.justice.example.com/judgments/5531/
https://astronomy.observatory.example.net/images/ngc-224
https://www.zoo.example.org/animals/giraffe
http://www.school-district.example.com/calendar#top
https://theatre.example.net/en/programme/3319
https://www.chess-club.example.org/games/8810
https://radio.example.com/podcasts/episode-17
https://www.bikeshop.example.net/repairs
http://maps.hiking.example.org/routes/alps/21.html
https://photos.family.example.com/album/3
https://tech.review.example.net/laptops/2020/test-5124.html
https://support.printers.example.org/drivers/faq?page=2&ref=x
https://www.poetry.example.com/authors/d/1830
http://lists.kernel.example.net/msg/771204
https://www.standards.example.org/documents/iso/9001
https://www.charity.example.com/projects/water
http://village-market.example.net/vegetables
https://www.winery.example.org/tours
https://www.tracksandfields.example.com/athletics/results
https://alphabet.example.net/letters
https://www.freedom.example.org/essays/44
https://m.lighthouse.example.com/en/5518
https://thoughts.example.net/en/4406?page=2&ref=x
http://www.northern.example.org/en/1277/
https://blog.weather-station.example.com/de/7301.html
https://the-other-theatre.example.net/fr/6620#top
http://m.thermal.example.org/es/1209?utm_source=feed
https://www.thunder.example.com/en/3381.html
https://motion.example.net/de/940
https://www.station.example.org/en/8254?page=2&ref=x
http://blog.nation.example.com/fr/5567
https://m.author.example.net/en/2045/
https://whether.example.org/es/7718.html
https://www.earth-and-water.example.com/de/3312#top
http://bread.example.net/en/6104
https://m.mountain.example.org/fr/1932?utm_source=feed
https://blog.shelter.example.com/en/9025
https://www.reading-room.example.net/es/4417/
http://m.harbour.example.org/de/5120.html
https://anthem.example.com/en/780?page=2&ref=x
https://www.rhythm.example.net/fr/8842
http://table.example.org/en/613/
https://m.garden.example.com/de/2791#top
https://blog.handicraft.example.net/es/3340
https://www.winter.example.org/en/7129?utm_source=feed
https://www.adults-learning.example.com/en/courses/18
https://pharmacology.example.net/de/3150.html
https://m.tractor.example.org/en/4471
http://www.musical.example.com/fr/90
https://hillside-church.example.net/en/2206/
https://www.better-reading.example.org/en/611.html
"""


class Rule(NamedTuple):
    """A listed verdict (``allow`` or ``block``) for a host, its subdomains and paths that start with ``path``."""

    verdict: str
    host: str
    path: str


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): the built-in labelled table, label 1 for blocked."""
    rows = [(u, 1) for u in BLOCKED.split()] + [(u, 0) for u in ALLOWED.split()]
    return spark.createDataFrame(rows, "url string, label int")


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule (host and path together, then the earlier listed) that fits, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host) + len(r.path)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, r.host + r.path).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def _grams(text: Column, kind: str) -> Column:
    """Buckets of all n-grams of the marked text. Letters are split once, so a long text costs time in proportion to its length."""
    marked = F.concat(F.lit("^"), F.translate(text, "123456789", "000000000"), F.lit("$"))

    none = F.array().cast("array<int>")

    def of_size(letters: Column, n: int) -> Column:
        bucket = lambda i: F.pmod(F.xxhash64(F.lit(kind), *[F.get(letters, i + k) for k in range(n)]), F.lit(BUCKETS)).cast("int")
        starts = F.sequence(F.lit(0), F.greatest(F.size(letters) - n, F.lit(0)))
        return F.when(F.size(letters) >= n, F.transform(starts, bucket)).otherwise(none)

    def all_sizes(letters: Column) -> Column:
        return F.when(F.size(letters) > 2, F.concat(*[of_size(letters, n) for n in SIZES])).otherwise(none)

    return F.get(F.transform(F.array(F.split(marked, "")), all_sizes), 0)


def _margin(weights: Column, bias: float, host: Column, path: Column) -> Column:
    """Bias, a quarter of the weights of the host's buckets, and half the weights of the path's over the root of their number.

    So a telling part of a host counts the same below any domain, and a long path cannot outvote its host.
    """
    part = lambda grams, end: F.aggregate(
        grams, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")),
        lambda t, g: F.struct((t["sum"] + F.get(weights, g)).alias("sum"), (t["n"] + 1).alias("n")), end,
    )
    return F.lit(bias) + part(host, lambda t: t["sum"] * HOST_SHARE) + part(path, lambda t: t["sum"] * PATH_SHARE / F.sqrt(F.greatest(t["n"], F.lit(1))))


def _constant(weights: Sequence[float]) -> Column:
    """The weights as one constant of the plan, folded from text."""
    return F.split(F.lit(",".join(f"{w:.6g}" for w in weights)), ",").cast("array<double>")


class Model(NamedTuple):
    weights: list[float]
    bias: float

    def probability(self, host: Column, path: Column) -> Column:
        """Probability that an address is to be blocked."""
        margin = _margin(_constant(self.weights), self.bias, _grams(host, "h"), _grams(path, "p"))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def trained(labelled: DataFrame, url: str = "url", label: str = "label") -> Model:
    """A model of the labelled addresses (``label`` 1: block, 0: allow; rows without a label or an address teach nothing).

    Penalised logistic loss, averaged over the rows, minimised by gradient steps of Barzilai-Borwein length. A pass sums the gradient
    in Spark into at most BUCKETS + 1 rows, the only thing the driver receives. Without labelled rows every address gets 0.5.
    """
    rows = pick(labelled, url=url, label=label).filter("url is not null and label is not null")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    table = written(rows.select(_grams(host, "h").alias("h"), _grams(path, "p").alias("p"), F.col("label").cast("double").alias("y")), "urls")
    n = table.count()
    point, last_point, last_slope = [0.0] * (BUCKETS + 1), None, None
    for _ in range(PASSES if n else 0):
        margin = _margin(_constant(point[:BUCKETS]), point[BUCKETS], F.col("h"), F.col("p"))
        error = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)) - F.col("y")
        share = lambda e, grams, value: F.transform(grams, lambda g: F.struct(g.alias("g"), (e * value).alias("v")))
        parts = lambda e: F.concat(
            share(e, "h", F.lit(HOST_SHARE)), share(e, "p", PATH_SHARE / F.sqrt(F.size("p"))), F.array(F.struct(F.lit(BUCKETS).alias("g"), e.alias("v")))
        )
        sums = (
            table.select(F.explode(F.flatten(F.transform(F.array(error), parts))).alias("x"))
            .groupBy("x.g").agg(F.sum(F.round(F.col("x.v") * _UNIT).cast("bigint")).alias("v"))
        )
        slope = [PENALTY * w for w in point]
        slope[BUCKETS] = 0.0
        for g, v in sums.collect():
            slope[g] += v / _UNIT / n
        if max(map(abs, slope)) < SETTLED:
            break
        step = 4.0
        if last_point is not None:
            moved = [a - b for a, b in zip(point, last_point)]
            turned = [a - b for a, b in zip(slope, last_slope)]
            along = sum(a * b for a, b in zip(moved, turned))
            if along > 0:
                step = along / sum(a * a for a in turned)
        last_point, last_slope = point, slope
        point = [w - step * s for w, s in zip(point, slope)]
    dropped(table)
    return Model(point[:BUCKETS], point[BUCKETS])


def judged(
    pages: DataFrame, rules: Sequence[Rule], model: Model, url: str = "url", least: float = 0.5, out: str = "filter",
) -> DataFrame:
    """``pages`` plus the struct ``out``: host, path, rule, score (the model's probability to block), verdict.

    The longest fitting rule decides, else ``block`` from the probability ``least`` on. One scan, no shuffle. A null address or one without
    ``://`` has an empty host and path, fits no rule and is judged by the bias. Repeated rows get equal results, an empty
    table none; an existing column ``out`` is replaced.
    """
    names = pages.columns
    at = names.index(url)
    plain = pages.toDF(*[f"_c{i}" for i in range(len(names))]).withColumns(
        {"_host": host_of(F.col(f"_c{at}")), "_path": path_of(F.col(f"_c{at}"))}
    )
    text, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    scored = plain.withColumns({"_rule": text, "_listed": verdict, "_score": model.probability(F.col("_host"), F.col("_path"))})
    told = F.struct(
        F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.col("_score").alias("score"),
        F.coalesce("_listed", F.when(F.col("_score") >= least, "block").otherwise("allow")).alias("verdict"),
    ).alias(out)
    return scored.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names) if n != out], told)
