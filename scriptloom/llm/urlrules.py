"""URL filters by association rules (operator 10), with DataFrame functions and Spark's own FP-growth.

URLs that a hand-made rule judges are the labelled ones. FP-growth finds the combinations of URL tokens that go with a
verdict; rules with too little support or confidence, and rules that one with a token less makes idle, are pruned. The rest are
matched by an inverted index: each is listed under its rarest token, and a URL meets those listed under its tokens.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_ascii, skew_join, stored, table

ALLOW, BLOCK = "allow", "block"
#: Labelled URLs that rules are mined from, about; a bound of the fit alone.
MAX_ROWS = 100_000
SUPPORT, CONFIDENCE = 0.01, 0.9
#: Rules are broadcast up to so many; beyond, the index join shuffles.
BROADCAST_RULES = 20_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
)


#: Host, then path.
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null and where ``://`` is missing."""
    given = F.coalesce(url, F.lit(""))
    return fold_ascii(F.regexp_extract(given, URL, 1)), F.regexp_extract(given, URL, 2)


def fitting(rules: tuple[Rule, ...], host: Column, path: Column, value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null; of equally long ones, the first."""
    out = F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.host + r.path))):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: ``h:`` and each label of the host, ``p:`` and each run of letters or digits of the path."""
    labels = F.transform(F.filter(F.split(host, r"[.:@]"), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, words))


def merged_tokens(baskets: DataFrame) -> DataFrame:
    """``row, items`` to ``item, tokens array<string>, count``: tokens that occur in exactly the same rows are one item, named by the first.

    A token's rows are known by their number and two sums of hashes of their ids. Tasks sum first, so a token of all rows is a row a task.
    """
    each = baskets.select("row", F.explode("items").alias("token"))
    sums = [F.sum(F.xxhash64("row", F.lit(seed)).cast("decimal(38,0)")).alias(f"s{seed}") for seed in (1, 2)]
    rows = each.groupBy("token").agg(F.count("*").alias("count"), *sums)
    alike = rows.groupBy("count", "s1", "s2").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    return alike.select(F.get("tokens", F.lit(0)).alias("item"), "tokens", "count")


def mine_lists(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``tokens array<string>, label string`` to rules ``need array<array<string>>, verdict, confidence, support, rarest``.

    A URL meets a rule if it has a token of each list; tokens of one list occur in exactly the same labelled rows, so they are one item
    for the mining: a template whose URLs share many tokens has one item set, not one for each choice of them.

    Rows without tokens or label teach nothing, repeated rows count each, no rows give no rules. A rule is idle, and left
    out, if it needs one token more than another that is as sure of the same verdict.
    """
    known = labelled.where("tokens is not null and label is not null")
    items = F.array_distinct(F.concat("tokens", F.array(F.concat(F.lit("="), F.col("label")))))
    rows = stored(known.select(items.alias("items")).withColumn("row", F.monotonically_increasing_id()))
    frequent = F.col("count") >= F.lit(support) * rows.count()
    merged = stored(merged_tokens(rows.withColumn("items", F.filter("items", lambda t: ~t.startswith("=")))).where(frequent))
    named = rows.select("row", F.explode("items").alias("token")).join(merged.select("item", F.explode("tokens").alias("token")), "token", "left")
    named = named.withColumn("item", F.coalesce("item", F.when(F.col("token").startswith("="), F.col("token")))).where("item is not null")
    baskets = stored(named.groupBy("row").agg(F.collect_set("item").alias("items")).select("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    verdict = F.get("consequent", F.lit(0))
    rules = model.associationRules.where(verdict.startswith("=") & ~F.exists("antecedent", lambda t: t.startswith("=")))
    rules = stored(rules.select(F.sort_array("antecedent").alias("need"), F.substring(verdict, 2, 100).alias("verdict"), "confidence", "support"))
    # the rule with one token less, for each token: no rules are compared pairwise
    less = rules.select("need", "verdict", "confidence", F.explode(F.transform("need", lambda t: F.filter("need", lambda x: x != t))).alias("part"))
    surer = rules.select(F.col("need").alias("part"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    idle = less.join(surer, "part").where("v = verdict and c >= confidence").select("need", "verdict").distinct()
    kept = rules.join(idle, ["need", "verdict"], "left_anti")
    kept = kept.withColumn("rule", F.xxhash64("need", "verdict"))
    each = kept.select("rule", F.explode("need").alias("item")).join(merged, "item")
    lists = each.groupBy("rule").agg(F.sort_array(F.collect_list(F.struct("count", "tokens"))).alias("lists"))
    tokens_ = F.transform("lists", lambda x: x["tokens"])
    return stored(kept.join(lists, "rule").select(tokens_.alias("need"), "verdict", "confidence", "support", F.get("lists", F.lit(0))["tokens"].alias("rarest"), F.transform("lists", lambda x: x["count"]).alias("counts")))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``need array<string>, verdict, confidence, support, rarest``: the rules of ``mine_lists``, one for each choice of tokens."""

    def chosen(done: Column, one: Column) -> Column:
        return F.flatten(F.transform(done, lambda need: F.transform(one["tokens"], lambda t: F.array_append(need, F.struct(one["count"].alias("count"), t.alias("token"))))))

    none = F.array(F.array().cast("array<struct<count:bigint,token:string>>"))
    each = mine_lists(labelled, support, confidence).withColumn("lists", F.arrays_zip(F.col("need").alias("tokens"), F.col("counts").alias("count")))
    each = each.withColumn("one", F.explode(F.aggregate("lists", none, chosen)))
    return each.select(F.sort_array(F.transform("one", lambda x: x["token"])).alias("need"), "verdict", "confidence", "support", F.array_min("one")["token"].alias("rarest"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, max_rows: int = MAX_ROWS, default: str = ALLOW) -> DataFrame:
    """``page_id, host, path, rule, verdict, by`` of each row of ``pages``.

    verdict: the hand-made rule's; else that of the surest mined rule that matches (then of most support, ``block``
    before ``allow``); else ``default``. by: ``rule``, ``mined`` or ``default``. A null or strange URL has an empty host
    and path, and no tokens. Repeated rows are judged alike, each its own row.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    named = lambda r: r.host + r.path
    each = parts.groupBy("page_id", "host", "path").agg(F.count("*").cast("int").alias("copies"))
    judged = stored(each.select("*", fitting(rules, F.col("host"), F.col("path"), named).alias("rule"), fitting(rules, F.col("host"), F.col("path"), lambda r: r.verdict).alias("label"), tokens(F.col("host"), F.col("path")).alias("tokens")))
    known = judged.where("label is not null")
    share = min(1.0, max_rows / max(known.count(), 1))
    mined = mine_lists(known.where(F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(1 << 20)) < int(share * (1 << 20))))
    open_ = judged.where("label is null").select("page_id", "host", "path", "tokens", F.explode("tokens").alias("rarest"))
    # beyond the bound a shuffle, in which a token that many URLs have is split
    index = stored(mined.withColumn("rarest", F.explode("rarest")))
    met = open_.join(F.broadcast(index), "rarest") if index.count() <= BROADCAST_RULES else skew_join(open_, index, "rarest")
    met = met.where(F.forall("need", lambda tokens: F.arrays_overlap(tokens, F.col("tokens"))))
    best = met.groupBy("page_id", "host", "path").agg(F.max(F.struct("confidence", "support", F.col("verdict").alias("verdict")))["verdict"].alias("found"))
    key = [F.xxhash64("page_id", "host", "path").alias("__k")]
    left = judged.select("*", *key)
    right = best.select(F.col("page_id").alias("i"), F.col("host").alias("h"), F.col("path").alias("p"), "found", F.xxhash64("page_id", "host", "path").alias("__j"))
    whole = left.join(right, (left["__k"] == right["__j"]) & left["page_id"].eqNullSafe(right["i"]) & (left["host"] == right["h"]) & (left["path"] == right["p"]), "left")
    by = F.when(F.col("label").isNotNull(), "rule").when(F.col("found").isNotNull(), "mined").otherwise("default")
    out = whole.select("page_id", "host", "path", "rule", F.coalesce("label", "found", F.lit(default)).alias("verdict"), by.alias("by"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy"))
    return out.drop("__copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).drop("by")
