"""URL filter: host and path rules first, then gradient-boosted trees on lexical features.

Labelled URLs are those that a rule decides. Features: length, depth, digit ratio, entropy, parameters, and statistics of the host's suffix (how
frequent it is, and which share of its labelled hosts is blocked). Suffixes are dealt into ``BUCKETS`` hash buckets, so their statistics, which
cover all URLs, are a table of bounded size.

The trees are Spark MLlib's, fitted on at most ``sample`` labelled URLs, those with the least hashes, whose features are written once. A statistic that
held a row's own label would give the label away, so a labelled row sees its suffix without its own host: hosts are dealt into FOLDS folds, and the
statistics for a host are those of the other folds' hosts.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule and the method's verdict; rows given
twice get equal verdicts; with labels of one kind only, that kind is the method's verdict (allow without any); an empty table gives an empty result;
a URL of any length is read whole; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.workspace import materialize, scratch

# Host, path, verdict of each rule.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BUCKETS, FOLDS = 4096, 5
FEATURES = ("url_length", "host_length", "path_length", "depth", "host_labels", "digit_ratio", "hyphens", "entropy", "parameters", "query_length", "suffix_share", "suffix_blocked")


def parsed(pages: DataFrame) -> DataFrame:
    rest = F.when(F.instr("url", "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract("_rest", r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumn("_rest", F.coalesce(rest, F.lit(""))).withColumn("host", host).withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)).drop("_rest")


def ruled(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and label (the longest rule that fits; of equally long ones the first by name)."""

    def fits(host: str, path: str) -> Column:
        return ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)

    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    choose = lambda value: reduce(lambda w, r: w.when(fits(r[0], r[1]), value(r)), ordered, F)
    return urls.withColumn("rule", choose(lambda r: f"{r[0]}{r[1]}")).withColumn("label", choose(lambda r: float(r[2] == "block")))


def suffix() -> Column:
    return F.pmod(F.xxhash64(F.regexp_extract("host", r"([^.]*)$", 1)), F.lit(BUCKETS))


def lexical(urls: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    count = lambda c, pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    size = F.greatest(F.length("_url"), F.lit(1)).cast("double")
    entropy = F.aggregate(F.array_distinct(F.split("_url", "")), F.lit(0.0), lambda a, c: a + F.when(c == "", 0.0).otherwise((lambda n: n * F.log2(n / size) / size)((F.length("_url") - F.length(F.replace(F.col("_url"), c))).cast("double"))))
    query = F.regexp_extract("_url", r"\?([^#]*)", 1)
    return (
        urls.withColumn("_url", url).withColumn("url_length", F.length("_url")).withColumn("host_length", F.length("host")).withColumn("path_length", F.length("path"))
        .withColumn("depth", count(F.col("path"), "/")).withColumn("host_labels", count(F.col("host"), r"\.") + 1).withColumn("digit_ratio", count(F.col("_url"), "[0-9]") / size)
        .withColumn("hyphens", count(F.col("host"), "-")).withColumn("entropy", -entropy).withColumn("parameters", count(query, "=")).withColumn("query_length", F.length(query))
        .withColumn("suffix", suffix()).drop("_url")
    )


def suffix_statistics(urls: DataFrame, path: str) -> DataFrame:
    """suffix, fold, suffix_share, suffix_blocked: for labelled hosts of each fold from the other folds' hosts; in fold -1 from all. Every host counts once."""
    hosts = urls.groupBy("suffix", "host").agg(F.count("*").alias("n"), F.avg("label").alias("blocked"))
    sums = hosts.groupBy("suffix", fold().alias("fold")).agg(F.sum("n").alias("n"), F.count("blocked").alias("known"), F.coalesce(F.sum("blocked"), F.lit(0.0)).alias("blocked"))
    sums = materialize(sums, f"{path}/sums")  # BUCKETS * FOLDS rows at most
    whole = sums.groupBy("suffix").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "known", "blocked")])
    total = sums.agg(*[F.sum(c).alias(c) for c in ("n", "known", "blocked")]).first()
    folds = sums.unionByName(whole.select("suffix", F.lit(-1).alias("fold"), *[F.lit(0).alias(c) for c in ("n", "known", "blocked")]))
    prior = 2.0 * total["blocked"] / max(total["known"], 1)
    blocked = (F.col("all_blocked") - F.col("blocked") + prior) / (F.col("all_known") - F.col("known") + 2)
    return folds.join(whole, "suffix").select("suffix", "fold", (F.col("all_n") / total["n"]).alias("suffix_share"), blocked.alias("suffix_blocked"))


def fold() -> Column:
    return F.pmod(F.xxhash64("host", F.lit("fold")), F.lit(FOLDS)).cast("int")


def filter_urls(pages: DataFrame, rules=RULES, trees: int = 10, depth: int = 4, sample: int = 100_000) -> DataFrame:
    """page_id, host, path, rule, verdict, score (how likely the trees find a block; null where a rule decides)."""
    spark = pages.sparkSession
    urls = ruled(parsed(pages.select("page_id", "url")), rules)
    out = ("page_id", "host", "path", "rule")
    seen = urls.agg(F.count("label").alias("known"), F.sum("label").alias("blocked")).first()
    if not 0 < (seen["blocked"] or 0) < seen["known"]:
        rest = "block" if seen["blocked"] else "allow"
        return urls.select(*out, F.when(F.col("label").isNull(), rest).when(F.col("label") == 1, "block").otherwise("allow").alias("verdict"), F.lit(None).cast("double").alias("score"))
    path = scratch(spark)
    table = materialize(suffix_statistics(urls.withColumn("suffix", suffix()), path), f"{path}/suffixes")
    known = urls.where("label is not null").orderBy(F.xxhash64("url"), "url").limit(sample)  # the least hashes: each task keeps so many at most
    known = lexical(known).withColumn("fold", fold()).join(F.broadcast(table), ["suffix", "fold"])
    known = materialize(known.select("label", *FEATURES), f"{path}/known")
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    model = GBTClassifier(labelCol="label", maxIter=trees, maxDepth=depth, maxBins=32, seed=1).fit(assembler.transform(known).select("label", "features"))
    ready = lexical(urls).join(F.broadcast(table.where("fold = -1").drop("fold")), "suffix")
    judged = model.transform(assembler.transform(ready)).withColumn("score", F.when(F.col("label").isNull(), vector_to_array("probability")[1]))
    return judged.select(*out, F.when(F.coalesce("label", (F.col("score") >= 0.5).cast("double")) == 1, "block").otherwise("allow").alias("verdict"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
