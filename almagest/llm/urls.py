"""URL filters by association rules.

Spark's FP-growth mines combinations of URL tokens that go with a bad label.  Rules pruned by support and confidence match through an
inverted index: each rule is listed under its rarest token; a URL's token set meets the rules listed under its tokens and must hold
the rule's other tokens too.  Token sets are matched once each, however many URLs share them.  Explicit host and path rules go before mined ones.

All on DataFrame functions.  Defined cases: a null URL or one without ``://`` has an empty host and path and no tokens; without labels no rule is mined
and the method allows everything; rows that repeat are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAD = "label=bad"
SUPPORT = 0.01
CONFIDENCE = 0.6
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    """Sorted distinct tokens: scheme, host, its parent domains, path segments by depth with digits as one sign, and query keys."""
    url = F.coalesce(url, F.lit(""))
    labels = F.split(host(url), r"\.", -1)
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    segments = F.filter(F.split(path(url), "/", -1), lambda s: s != "")
    parts = F.transform(segments, lambda s, i: F.concat(F.lit("path"), i.cast("string"), F.lit("="), F.regexp_replace(s, "[0-9]+", "#")))
    keys = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#?]+)"), F.lit(1)), lambda k: F.concat(F.lit("key="), k))
    scheme = F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))))
    return F.when(F.contains(url, F.lit("://")), F.array_sort(F.array_distinct(F.concat(scheme, domains, parts, keys)))).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """antecedent, confidence, support of the rules for the bad label; ``labelled`` has tokens and bad."""
    items = labelled.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    if items.isEmpty():
        return items.sparkSession.createDataFrame([], "antecedent array<string>, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    rules = model.associationRules.filter((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD))
    return rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support")


def matched(token_sets: DataFrame, rules: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """tokens, confidence: the distinct token sets that hold a rule's antecedent, with the best rule's confidence."""
    size = rules.agg(F.coalesce(F.sum(F.octet_length(F.array_join("antecedent", " ")) + 100), F.lit(0))).first()[0]
    near = F.broadcast if size <= broadcast_bytes else lambda x: x
    often = rules.select(F.explode("antecedent").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    listed = rules.select("antecedent", "confidence", F.explode("antecedent").alias("token")).join(near(often), "token")
    index = listed.groupBy("antecedent", "confidence").agg(F.min(F.struct("often", "token")).alias("least")).select(F.col("least.token").alias("token"), "antecedent", "confidence")
    sets = token_sets.select("tokens").distinct()
    met = sets.select("tokens", F.explode("tokens").alias("token")).join(near(index), "token")
    # One key more: so the result has an exchange of its own before it is joined, and Spark may split the pages with one token set among several tasks.
    found = met.filter(F.size(F.array_except("antecedent", "tokens")) == 0).groupBy("tokens", F.size("tokens").alias("n"))
    return found.agg(F.max("confidence").alias("confidence")).select("tokens", "confidence")


def explicit_rule(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule (verdict, host, path) that fits, else null.

    A rule fits its host and all subdomains if the path starts with the rule's; of equally long ones the one with the longer host wins.
    """
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    listed = F.array(*[F.struct(F.lit(len(h) + len(p)).alias("length"), F.lit(len(h)).alias("of_host"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    fits = F.filter(listed, lambda r: ((host_ == r["host"]) | F.endswith(host_, F.concat(F.lit("."), r["host"]))) & F.startswith(path_, r["path"]))
    best = F.array_max(fits)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per page: id, host, path, rule, verdict and mined_confidence (null where no mined rule matches).

    Labels (quality, toxic) belong to the page with their id; a page is bad if its quality is 0 or it is toxic.
    """
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), host(url).alias("host"), path(url).alias("path"), url_tokens(url).alias("tokens"))
    bad = labels.select(F.col(f"`{label_id}`").alias("of"), (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    mined = mine(rows.join(bad, rows["id"] == bad["of"]).filter(F.size("tokens") > 0).select("tokens", "bad"), support, confidence)
    hits = matched(rows, mined).withColumnRenamed("tokens", "held")
    fixed = explicit_rule(F.col("host"), F.col("path"), rules)
    out = rows.join(hits, rows["tokens"] == hits["held"], "left").withColumn("fixed", fixed)
    verdict = F.coalesce("fixed.verdict", F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), F.round("confidence", 9).alias("mined_confidence"))
