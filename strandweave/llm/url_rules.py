"""URL filters: fixed host/path rules first, then association rules mined with FP-growth.

Transactions are the token sets of labelled pages (labels.doc_id = page_id): host name parts `h:`, path words
`p:` and query names `q:`, plus an outcome token. FP-growth mines frequent combinations. A rule says that they imply
the bad outcome (quality 0 or toxic 1). Its support must reach MIN_SUPPORT of the transactions and MIN_PAGES pages, its
confidence MIN_LIFT times the share of bad pages (half way from that share to 1, if that is less) and lie
MIN_DEVIATIONS standard deviations above that share for as many pages, and no rule whose tokens it contains may be as
confident. Tokens below the support are dropped first; a transaction keeps all others. What cannot matter is taken out of
the combinations without loss: tokens of the same pages are one item (a rule holds one of them at most, and there is
the same rule with each other), tokens of bad pages only and tokens of all pages make rules alone (no combination is more
confident than the same without them, or than they alone), and tokens of fewer bad pages than a rule needs are in none. A
rule is filed in an inverted index under its rarest item only; a url is compared with the rules of its tokens and
blocked if it holds a token of each item of one.

All of it is DataFrame code and the JVM's FP-growth. Equal urls are judged once, which takes the weight off a
repeated url. Null urls, or urls without `://`, have an empty host and path, no rule and no tokens: allowed.
Repeated pages are reported each. Labels that are null count as unlabelled; with no labels nothing is mined.
Host case is folded for A-Z only. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from strandweave.llm.common import staged

MIN_SUPPORT, MIN_LIFT, MIN_DEVIATIONS = 0.002, 1.5, 1.64
#: Labelled pages that a rule must rest on, whatever its relative support, and tokens of a transaction (None: all that are frequent).
MIN_PAGES, MAX_TOKENS = 10, None
_BAD = "="  # the outcome token; no url token is like it

#: Fixed rules: host, path, verdict.
BASE_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) by the fixed rule."""
    pattern = "://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, pattern, 1), _UPPER, _LOWER), F.regexp_extract(u, pattern, 2)


def base_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(BASE_RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels and name parts, path words, names in the query. Numbers are left out."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    def words(prefix: str, text: Column, cut: str) -> Column:
        return F.transform(F.split(text, cut), lambda w: F.when(w.rlike("[^0-9]"), F.concat(F.lit(prefix), w)))
    names = F.split(F.regexp_replace(query, "=[^&]*", ""), "&")
    every = F.flatten(F.array(words("h:", host, r"[.]"), words("h:", host, r"[.:@-]"), words("p:", path, r"[/._-]"), F.transform(names, lambda w: F.when(w != "", F.concat(F.lit("q:"), w)))))
    return F.array_distinct(F.filter(every, lambda t: t.isNotNull() & (F.length(t) > 2)))


def transactions(pages: DataFrame, labels: DataFrame, min_pages: Column, most: int | None = MAX_TOKENS) -> DataFrame:
    """Staged (row, items, bad): frequent tokens of labelled pages, and the outcome; the `most` most telling of each, if given."""
    host, path = parts(F.col("url"))
    outcome = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    rows = pages.select(F.col("page_id").alias("doc_id"), tokens(F.col("url"), host, path).alias("t")).join(outcome, "doc_id").select("t", "bad", F.monotonically_increasing_id().alias("row"))
    rows = staged(rows, "url-rows")
    each = rows.select("row", "bad", F.explode("t").alias("token"))
    total = rows.agg(F.count("*").alias("all"), F.avg("bad").alias("base"))
    often = each.groupBy("token").agg(F.count("*").alias("n"), F.sum("bad").alias("b")).join(F.broadcast(total)).where(F.col("n") >= min_pages)  # one row
    z = F.abs(F.col("b") - F.col("n") * F.col("base")) / F.sqrt(F.col("n"))
    told = each.join(often.select("token", F.round(z, 9).alias("z")), "token")
    s = F.array_sort(F.collect_list(F.struct((-F.col("z")).alias("z"), "token")))  # the tokens of one url
    best = told.groupBy("row").agg((s if most is None else F.slice(s, 1, most)).alias("s"))
    items = rows.join(best, "row", "left").select("row", F.coalesce(F.transform("s", lambda x: x["token"]), F.array().cast("array<string>")).alias("items"), "bad")
    return staged(items, "url-baskets")


def classes(baskets: DataFrame, n: int, bad_needed: int) -> DataFrame:
    """Staged (token, item, pages, alone) of the tokens with enough bad pages: `item` is the least token of the same pages; alone:
    of bad pages only, or of all pages."""
    each = baskets.select("row", "bad", "items", F.explode("items").alias("token"))
    mark = F.xxhash64("row")
    per = each.groupBy("token").agg(F.count("*").alias("pages"), F.sum("bad").alias("b"), F.bit_xor(mark).alias("x"), F.bit_xor(F.xxhash64(mark, "row")).alias("y")).where(F.col("b") >= bad_needed)
    first = per.groupBy("pages", "x", "y").agg(F.min("token").alias("item"))
    named = staged(per.join(first, ["pages", "x", "y"]).select("token", "item", "pages", ((F.col("b") == F.col("pages")) | (F.col("pages") == n)).alias("alone")), "url-named")
    # marks only propose: as many pages, and the item on each of them, is the same pages
    same = each.join(named.select("token", "item"), "token").groupBy("token").agg(F.bool_and(F.array_contains("items", F.col("item"))).alias("same"))
    return staged(named.join(same, "token").select("token", F.when(F.col("same"), F.col("item")).otherwise(F.col("token")).alias("item"), "pages", "alone"), "url-classes")


def mine_items(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_lift: float = MIN_LIFT, min_pages: int = MIN_PAGES, most: int | None = MAX_TOKENS) -> DataFrame:
    """(tokens, confidence, support, rare, groups): pruned rules that imply the bad outcome, with a token for each item; groups has
    all tokens of each item, rare those of the index item."""
    baskets = transactions(pages, labels, F.greatest(F.lit(min_pages), F.ceil(F.lit(min_support) * F.col("all"))), most)
    n, base = baskets.agg(F.count("*"), F.coalesce(F.avg("bad"), F.lit(0.0))).first()
    confidence = min(min_lift * base, (1 + base) / 2)
    pages_needed = max(min_pages, math.ceil(min_support * n))
    bad_needed = max(1, math.ceil(pages_needed * confidence - 1e-9))
    named = classes(baskets, n, bad_needed)
    outcome = F.when(F.col("bad") == 1, F.array(F.lit(_BAD))).otherwise(F.array().cast("array<string>"))
    items = baskets.select("row", "bad", F.explode("items").alias("token")).join(named.where("token = item"), "token")
    sets = baskets.select("row", "bad").join(items.where("not alone").groupBy("row").agg(F.collect_list("item").alias("s")), "row", "left")  # the items of one url
    sets = sets.select(F.concat(F.coalesce("s", F.array().cast("array<string>")), outcome).alias("items"))
    sets = staged(sets.unionByName(items.where("alone").select(F.concat(F.array("item"), outcome).alias("items"))), "url-sets")
    m = sets.count()
    # a support half a page lower, so that rounding does not drop a rule that rests on just enough pages; FP-growth
    # counts a rule's tokens and the outcome together, so its own support is that of the confidence asked for
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(0.0, (bad_needed - 0.5) / max(1, m))), minConfidence=0.0).fit(sets)
    support = F.col("support") * m / max(1, n)  # of the pages
    rules = model.associationRules.where(F.col("consequent")[0] == _BAD).select(F.array_sort("antecedent").alias("tokens"), "confidence", support.alias("support"))
    rests = F.round(F.col("support") * n / F.col("confidence"))  # pages with all tokens of the rule
    sure = F.col("confidence") >= base + MIN_DEVIATIONS * F.sqrt(base * (1 - base) / rests)
    rules = staged(rules.where((F.col("confidence") >= confidence - 1e-12) & sure & (rests >= pages_needed)), "url-rules")
    # a longer rule must be more confident than each of its parts: compare with the rules that share its tokens
    wide = rules.withColumn("token", F.explode("tokens"))
    shorter = wide.groupBy("tokens", "confidence").agg(F.first("token").alias("token")).select(F.col("tokens").alias("s_tokens"), F.col("confidence").alias("s_confidence"), "token")
    beaten = wide.join(shorter, "token").where((F.size("s_tokens") < F.size("tokens")) & (F.col("s_confidence") >= F.col("confidence")) & (F.size(F.array_intersect("tokens", "s_tokens")) == F.size("s_tokens"))).select("tokens").distinct()
    kept = rules.join(beaten, "tokens", "left_anti")
    members = named.groupBy(F.col("item").alias("token"), "pages").agg(F.array_sort(F.collect_list(named["token"])).alias("group"))  # of one item
    filed = kept.withColumn("token", F.explode("tokens")).join(members, "token")
    filed = filed.groupBy("tokens").agg(F.min_by("group", F.struct("pages", "token")).alias("rare"), F.collect_list("group").alias("groups"))
    return kept.join(filed, "tokens")


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_lift: float = MIN_LIFT, min_pages: int = MIN_PAGES, most: int | None = MAX_TOKENS) -> DataFrame:
    """(tokens, confidence, support): the rules of mine_items, each with every token of its items."""
    def longer(had: Column, group: Column) -> Column:
        return F.flatten(F.transform(had, lambda x: F.transform(group, lambda t: F.concat(x, F.array(t)))))
    each = F.aggregate("groups", F.array(F.array().cast("array<string>")), longer)
    rules = mine_items(pages, labels, min_support, min_lift, min_pages, most)
    return rules.select(F.explode(each).alias("tokens"), "confidence", "support").withColumn("tokens", F.array_sort("tokens"))


def judge_base(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict by the fixed rules alone; nulls where none fits."""
    host, path = parts(F.col("url"))
    rule, verdict = base_rule(F.col("host"), F.col("path"))
    return pages.select("page_id", host.alias("host"), path.alias("path")).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict: a row per page."""
    rules = staged(mine_items(pages, labels).select(F.explode("rare").alias("rare"), "groups"), "url-rules")
    host, path = parts(F.col("url"))
    rule, fixed = base_rule(F.col("host"), F.col("path"))
    open_urls = pages.select("url").where(F.col("url").isNotNull()).distinct().withColumns({"host": host, "path": path}).where(rule.isNull())
    probes = open_urls.select("url", tokens(F.col("url"), F.col("host"), F.col("path")).alias("t")).withColumn("rare", F.explode("t"))
    hits = probes.join(rules, "rare").where(F.forall("groups", lambda group: F.arrays_overlap(group, F.col("t"))))
    blocked = hits.select("url").distinct().withColumn("mined", F.lit("block"))
    return (
        pages.select("page_id", "url").join(blocked, "url", "left")
        .withColumns({"host": host, "path": path})
        .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(fixed, "mined", F.lit("allow")).alias("verdict"))
    )
