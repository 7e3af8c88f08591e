"""URL filter: explicit host and path rules first, then association rules mined by FP-growth from labelled urls."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import read, save

#: (verdict, host, path): a rule fits its host and all its subdomains.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
BLOCK = "block"
#: Mined rules are broadcast up to so many, and shuffled beyond.
MAX_BROADCAST_ROWS = 100_000


def host(url: str = "url") -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), UPPER, LOWER)


def path(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def tokens(url: str = "url") -> Column:
    """Distinct tokens of a url: its host's labels, the words of its path and its query's words; numbers are one token."""
    words = lambda mark, text: F.transform(F.filter(F.split(F.translate(text, UPPER, LOWER), r"[^\p{L}\p{N}_-]+"), lambda w: w != ""), lambda w: F.concat(F.lit(mark), F.regexp_replace(w, r"^[0-9]+$", "0")))
    return F.array_distinct(F.concat(words("h:", host(url)), words("p:", path(url)), words("q:", F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 3))))


def explicit(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the columns host and path; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # a later condition comes before the earlier ones
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def mine(labelled: DataFrame, min_support: float = 0.005, min_confidence: float = 0.6) -> DataFrame:
    """rule_id, tokens, support, confidence, entry: token combinations that go with bad urls.

    labelled has url and bad (boolean). A combination is kept if it and the label stand together in min_support of the
    rows, its share of bad rows is min_confidence or more, and no part of it is at least as sure. entry is its rarest
    token, under which the index holds it. Without labelled rows there are no rules."""
    none = labelled.sparkSession.createDataFrame([], "rule_id long, tokens array<string>, support double, confidence double, entry string")
    baskets = save(labelled.filter("url is not null").select(F.array_distinct(F.concat(tokens(), F.when(F.col("bad"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>")))).alias("items")), "baskets")
    total = baskets.count()
    if not total:
        return none
    sets = FPGrowth(itemsCol="items", minSupport=min_support).fit(baskets).freqItemsets
    sets = save(sets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    bad = sets.filter(F.array_contains("items", BLOCK) & (F.size("items") > 1)).select(F.array_remove("items", BLOCK).alias("items"), F.col("freq").alias("both"))
    rules = bad.join(sets, "items").select("items", "both", "freq", (F.col("both") / F.col("freq")).alias("confidence")).filter(F.col("confidence") >= min_confidence)
    rules = save(rules, "rules")
    within = lambda k: F.filter("items", lambda x: x != k)
    parts = rules.select("items", "confidence", F.explode("items").alias("k")).select("items", "confidence", within(F.col("k")).alias("part"))
    weaker = parts.join(rules.select(F.col("items").alias("part"), F.col("confidence").alias("c")), "part").filter("c >= confidence").select("items").distinct()
    single = sets.filter((F.size("items") == 1)).select(F.col("items")[0].alias("token"), F.col("freq").alias("f"))
    entry = rules.select("items", F.explode("items").alias("token")).join(single, "token").groupBy("items").agg(F.min(F.struct("f", "token")).alias("e"))
    kept = rules.join(weaker, "items", "left_anti").join(entry, "items")
    return kept.select(F.xxhash64("items").alias("rule_id"), F.col("items").alias("tokens"), (F.col("both") / F.lit(total)).alias("support"), "confidence", F.col("e.token").alias("entry"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, confidence, tokens of the surest rule that fits each distinct url; urls without one are left out."""
    rules = save(rules, "rules")
    if rules.count() <= MAX_BROADCAST_ROWS:
        rules = F.broadcast(rules)
    posted = urls.filter("url is not null").select("url").distinct().select("url", tokens().alias("has")).select("url", "has", F.explode("has").alias("entry"))
    found = posted.join(rules, "entry").filter(F.size(F.array_intersect("tokens", "has")) == F.size("tokens"))
    best = found.groupBy("url").agg(F.max(F.struct("confidence", "support", "tokens")).alias("x"))
    return best.select("url", "x.confidence", "x.tokens")


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, min_support: float = 0.005, min_confidence: float = 0.6) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence, tokens for each row of pages (page_id, url).

    rule is the longest explicit rule that fits and gives the verdict; else the verdict is block if a mined rule fits
    (its confidence and tokens are given), else allow. A null url or one without :// has an empty host and path, and
    only mined rules can block it. Repeated rows are each judged; equal urls get equal verdicts."""
    mined = match(pages, mine(labelled, min_support, min_confidence))
    out = pages.select("page_id", "url", host().alias("host"), path().alias("path")).join(mined, "url", "left")
    rule, verdict = explicit(rules)
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("confidence").isNotNull(), BLOCK).otherwise("allow")).alias("verdict"), "confidence", "tokens")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the pages that labels covers: those of low quality or toxic are bad."""
    pages, labels = read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels")
    labelled = pages.select("page_id", "url").join(labels.withColumnRenamed("doc_id", "page_id"), "page_id").select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge(pages, labelled)
