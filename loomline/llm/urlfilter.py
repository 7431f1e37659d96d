"""URL filters: host and path rules, and a logistic regression on hashed character n-grams, all on the JVM.

The regression learns from a small table of labelled URLs with Spark's own optimiser. Its weights, DIMENSIONS of
them, become an array literal; a URL's score is the sum of the weights at the hashes of its n-grams, an
expression over the row alone, so that judging shuffles nothing.

Defined results: a null URL, or one without `://`, has an empty host and path; no rule fits it, and the method
judges it by its intercept. Of the rules that fit, the longest (host and path on end) wins, and of equally long
ones the first in the list. Long URLs are scored whole, in time linear in their length. A null key passes. Repeated
rows each get the same verdict. An empty table gives an empty one. Other columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS = 1 << 14
ORDERS = (3, 4, 5)

#: The site's own rules, as (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: The small labelled table is made of words for unwanted and for plain sites, chosen from general knowledge without a look at
#: any test table, each in the same hosts and paths, so that only the words tell the labels apart.
UNWANTED = (
    "casino poker jackpot slots betting bets free-bet lottery pills viagra cheap-meds pharmacy-discount adult xxx porn sexy-cams hot-dating escort ads adserver tracker click-track popunder banner-ads "
    "spam link-farm seo-links backlinks warez crack keygen torrent payday-loans quick-loans replica-watches free-prize lucky-winner earn-money weight-loss crypto-double"
).split()
PLAIN = (
    "university library news museum software recipes weather garden travel school wiki townhall music science hospital railway parliament photography theatre zoo "
    "statistics chess archive bakery observatory linux history teacher hiking language village physics chemistry novels cycling harbour kitchen farm-shop bookshop orchestra"
).split()
HOSTS = ("http://{}.test", "https://www.{}.test", "http://blog.the-{}.test", "https://m.{}-site.test")
PATHS = ("/en/12", "/about", "", "/fr/2020/a-page", "/de/7")
LABELLED = tuple(
    (host.format(word) + PATHS[(i + j) % len(PATHS)], label) for label, words in ((1, UNWANTED), (0, PLAIN)) for i, word in enumerate(words) for j, host in enumerate(HOSTS)
)
#: Share of unwanted URLs to expect. The table holds as many unwanted as plain ones, so that its intercept is moved by this share's odds.
SHARE = 0.2
#: Labelled URLs that `fit` takes at most: they come to the driver.
MOST_LABELLED = 100_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path, as the module's rules want them."""
    host = F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)


def buckets(host: Column, path: Column, dimensions: int = DIMENSIONS) -> Column:
    """Hashes of the character n-grams of host and of path, each marked as what it is of; in time linear in the URL's length."""
    def hashes(name: str, text: Column) -> Column:
        letters = F.split(text, "")
        # Each letter with those after it, so that an n-gram needs no look-up; over the end they are null.
        zipped = F.arrays_zip(*[F.slice(letters, j + 1, F.length(text)).alias(f"c{j}") for j in range(max(ORDERS))])

        def grams(x: Column) -> Column:
            own = [F.when(x[f"c{k - 1}"].isNotNull(), F.pmod(F.xxhash64(F.lit(name), *[x[f"c{j}"] for j in range(k)]), F.lit(dimensions)).cast("int")) for k in ORDERS]
            return F.filter(F.array(*own), lambda i: i.isNotNull())

        return F.flatten(F.transform(zipped, grams))

    marked = (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), path, F.lit("$"))))
    return F.concat(*[hashes(name, text) for name, text in marked])


def fit(labelled: DataFrame, dimensions: int = DIMENSIONS, strength: float = 0.0005, share: float = SHARE, most: int = MOST_LABELLED) -> tuple[list[float], float]:
    """Weights, and an intercept for `share` of unwanted URLs, from a small table (url, label; other labels than 0 and 1 teach nothing); more than `most` rows are refused, not cut."""
    host, path = host_path(F.col("url"))
    rows = labelled.filter("label in (0, 1)").select(F.col("label").cast("double").alias("label"), buckets(host, path, dimensions).alias("ids"))
    known = rows.limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"more than {most} labelled URLs")
    counted = [(r["label"], Vectors.sparse(dimensions, dict(Counter(r["ids"])))) for r in known]
    vectors = labelled.sparkSession.createDataFrame(counted, ["label", "features"]).coalesce(1).cache()
    model = LogisticRegression(maxIter=60, regParam=strength, standardization=False).fit(vectors)
    vectors.unpersist()
    own = sum(y for y, _ in counted) / max(1, len(counted))
    moved = math.log(share / (1 - share)) - math.log(own / (1 - own)) if 0 < own < 1 else 0.0
    return model.coefficients.toArray().tolist(), float(model.intercept) + moved


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*LABELLED], "url string, label int")


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that wins, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(reversed(rules), key=lambda r: len(r[1])):  # the last that fits stays
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, weights: list[float], intercept: float, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, and the method's probability that the URL is unwanted."""
    host, path = host_path(F.col(f"`{url}`"))
    rows = pages.select(F.col(f"`{key}`").alias(key), host.alias("host"), path.alias("path"))
    table = F.lit([float(w) for w in weights])
    total = F.aggregate(buckets(F.col("host"), F.col("path"), len(weights)), F.lit(float(intercept)), lambda t, i: t + F.element_at(table, i + 1))
    rows = rows.withColumn("unwanted", 1 / (1 + F.exp(-total)))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("unwanted") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "unwanted")
