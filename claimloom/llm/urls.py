"""URL filter: longest fitting host-and-path rule, else logistic regression on hashed character n-grams.

Native: parsing, rules, features and scoring are DataFrame expressions; the regression is fitted by
Spark's DataFrame-based ML on a small labelled URL table (LABELLED below, some 130 rows, a quarter held out).

Defined cases: a null url, or one without `://`, has empty host and path, no rule, and is left to the
model; repeated rows are judged alike, each on its own; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, table

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

#: URLs by hand, of many shapes; those of the second list are spam, adverts, gambling, pills, adult pages and cracks.
_GOOD = """
https://www.riverside-library.org/en/events.html https://m.harbourmuseum.net/fr/672?utm_source=feed https://blog.gardennotes.com/2019/04/pruning-roses
https://news.northvale.org/local/council-vote https://docs.parserkit.dev/guide/install.html http://wiki.oldmaps.info/index.php?title=Danube
https://archive.poetrysociety.org/item/1184 http://en.cookbookwiki.net/bread/sourdough/ https://research.fieldnotes.edu/papers/2021/moss.pdf
https://kolvar.net/es/4988/ http://m.therel.org/de/9537 https://www.tolvan.com/en/286.html https://ondarim.net/fr/1372#top http://blog.hathen.org/en/1237/
https://m.sternweg.de/de/214.html https://www.atelier-lune.fr/fr/contact https://elpatio.es/es/recetas/gazpacho http://www.bergheim.at/de/wandern/
https://weather.coastline.org/today?station=14 https://maps.cityhall.gov/streets/12 https://forum.woodwork.net/thread/8841?page=2 https://shop.teahouse.com/green/sencha
https://www.university-press.edu/catalogue/history https://github-mirror.dev/project/readme https://www.townhall.org/minutes/2020-06 http://m.railtimes.net/en/3990?utm_source=feed
https://journal.biology.org/vol12/article7 https://schoolbooks.net/maths/fractions.html https://www.symphony.org/season/tickets https://photo.birding.net/gallery/heron
https://en.dictionary.com/word/lantern https://blog.runners.net/en/7145/ https://thalen.org/en/6288.html http://m.enther.net/es/9240/ https://www.inthar.com/fr/5644/
https://www.hospital.org/visitors/parking https://legal.statutes.gov/act/1987/chapter3 http://recipes.nonna.it/pasta/ragu https://www.bakersguild.org/en/4373 https://blog.erthan.com/es/1181#top
https://lab.optics.edu/people/ https://m.bookclub.net/en/reviews/761 https://podcast.radio.org/episode/52 https://www.chessclub.com/games/open https://data.census.gov/tables/2010
http://www.ordan.net/en/134.html https://nthesh.org/de/2620/ https://m.thandor.com/en/7357/ https://blog.ashend.org/es/1732?page=2&ref=x http://tharend.net/en/4471
https://www.theatre.org/plays/hamlet http://atlas.geology.net/rocks/granite https://museum.trains.org/en/steam https://www.wetlands.org/birds/guide.html https://alumni.college.edu/news/1998
https://blog.knitting.com/patterns/scarf https://news.science.net/2022/comet https://www.parliament.gov/debates/77 https://help.mailclient.org/faq/import http://www.cheese.fr/fr/comte
""".split()
_BAD = """
https://www.lucky-casino.com/en/286?utm_source=feed http://m.free-slots.net/en/902.html https://online-casino-bonus.org/es/9240/ https://casino-royal.net/de/9537 http://best-casino.com/play
https://free-bets-now.com/fr/672 https://m.bets-online.net/en/7145/ https://sport-bets.org/en/1237/ http://www.free-bet.com/join?ref=x https://betting-tips.net/es/1181#top
https://poker-win.com/en/134.html http://m.jackpot-wheel.net/en/3990?utm_source=feed https://slots-jackpot.org/spin http://blog.win-big-slots.com/de/214.html
https://cheap-pills.com/en/4373 http://www.pills-discount.net/fr/1372 https://viagra-pills.org/buy https://m.diet-pills.com/es/1732#top https://rx-pills-online.net/order?id=7
https://ads-server.com/en/7357/ http://m.ads-click.net/en/902.html https://www.ads-network.org/de/2620/ https://track-ads.com/click?id=1 https://adtrack.net/en/6288.html http://ads.popunder.com/show
https://tracker-pixel.net/p?u=3 https://m.tracking-ads.org/fr/5644/ http://click-track.com/es/4988/ https://popup-ads.net/en/1528 https://banner-ads.com/r/88
https://spam-links.org/en/286?utm_source=feed http://www.spam-blast.com/de/214.html https://link-farm.net/en/7691 https://seo-farm.com/en/1237/ http://m.linkfarm-seo.org/es/9240/ https://spamhost.net/fr/672
https://buy-followers.com/en/4373 https://backlinks-cheap.net/de/9537 http://seo-spam.org/offer https://free-backlinks.com/en/134.html
https://xxx-cams.com/en/902.html http://m.free-xxx.net/es/1181#top https://sexy-cams.org/live https://adult-dating-now.com/fr/1372 https://hot-xxx-videos.net/en/3990 http://www.porn-free.com/en/7145/
https://payday-loans.com/en/286 http://fast-loans-now.net/apply https://loans-cheap.org/de/2620/ https://m.quick-loans.com/es/4988/ https://get-rich-fast.net/en/6288.html http://www.easy-money-now.com/join
https://crack-keygen.com/download http://m.free-cracks.net/en/7357/ https://warez-download.org/full.exe https://keygen-serial.net/fr/5644/ https://torrent-cracks.com/en/1528
https://free-iphone-win.com/claim http://prize-winner.net/es/1732?page=2&ref=x https://gift-cards-free.org/en/7691?utm_source=feed https://cheap-watches.com/replica http://replica-bags.net/de/214.html
https://miracle-cure.net/en/4373 http://weight-loss-trick.com/order https://hot-deals-now.org/fr/672 https://click-here-win.com/en/134.html https://discount-rx.net/es/9240/
""".split()
LABELLED = tuple((url, y) for urls, y in ((_GOOD, 0), (_BAD, 1)) for url in urls)


def held_out(url: str) -> bool:
    """A quarter of the table, by hash, is left out of training and tells the accuracy."""
    return zlib.crc32(url.encode()) % 4 == 0


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), *ASCII_LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    found = []
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = rule.partition("/")
        found.append(F.when(((host == name) | host.endswith("." + name)) & path.startswith("/" + rest), F.lit(rule)))
    return F.coalesce(*found)


def grams(host: Column, path: Column, n: int = 2) -> Column:
    """All n-grams of ^host$ and ^path$, tagged by part."""

    def of(part: Column, tag: str) -> Column:
        s = F.concat(F.lit("^"), part, F.lit("$"))
        return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.concat(F.lit(tag), F.substring(s, i, F.lit(n))))).otherwise(F.array(F.concat(F.lit(tag), s)))

    return F.concat(of(host, "h:"), of(path, "p:"))


def _featured(df: DataFrame, bits: int) -> DataFrame:
    return HashingTF(numFeatures=1 << bits, binary=True, inputCol="_grams", outputCol="_features").transform(df.withColumn("_grams", grams(F.col("host"), F.col("path"))))


def fit(spark: SparkSession, labelled=None, bits: int = 14, reg: float = 0.003, iterations: int = 100) -> LogisticRegressionModel:
    """Trained on the labelled URLs, by default on those of LABELLED that are not held out."""
    labelled = [(u, y) for u, y in LABELLED if not held_out(u)] if labelled is None else labelled
    rows = spark.createDataFrame([(u, float(y)) for u, y in labelled], "url string, label double").select("label", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return LogisticRegression(featuresCol="_features", labelCol="label", predictionCol="_predicted", probabilityCol="_probability", rawPredictionCol="_raw", maxIter=iterations, regParam=reg).fit(_featured(rows, bits))


def judge_urls(pages: DataFrame, model: LogisticRegressionModel, rules=RULES, bits: int = 14, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block for every row of pages(page_id, url)."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scored = model.transform(_featured(rows, bits)).withColumn("p_block", vector_to_array("_probability")[1])
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(*(F.when(F.col("rule") == r, F.lit(v)) for r, v in rules), F.when(F.col("p_block") >= threshold, "block").otherwise("allow"))
    return scored.withColumn("rule", rule).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "p_block")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), fit(spark))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the URL filter that SQL can express: parts, rule, and the verdict where a rule fits."""
    return query(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


def oracle_sql() -> str:
    rules = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    fits = " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for r, _ in rules)
    return f"""WITH u AS (SELECT page_id, coalesce(url, '') AS u FROM pages), p AS (SELECT page_id, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), '{ASCII_LOWER[0]}', '{ASCII_LOWER[1]}') AS host, regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE {fits} END AS rule FROM p) SELECT page_id, host, path, rule, CASE rule {' '.join(f"WHEN '{r}' THEN '{v}'" for r, v in rules)} END AS rule_verdict FROM r"""
