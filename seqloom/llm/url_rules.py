"""URL filters: mined association rules behind a fixed list of host and path rules.

Labelled URLs become sets of tokens (host labels, path segments with numbers as one token, query keys). FP-growth
mines frequent token sets together with the label; rules `tokens -> block` are kept by confidence, support
(as a share and as a count), lift and significance, and pruned where a subset of their tokens already reaches their
confidence. Frequent tokens that stand in exactly the same labelled rows are one item for mining, so thirty query keys that
always come together are not 2^30 sets; a rule then takes any of them. Tokens that nearly always come together are not
joined, and FP-growth itself has no bound on the size of a set. An inverted index from a rule's rarest token matches them: a rule
fires for a URL that holds all its tokens. Pages are labelled by the row of `labels` of their key: block if it is toxic.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, saved, table

BLOCK = "label=block"
#: Fixed list: verdict, host, path.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. Ties in length go to the earlier rule."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL; numbers count by their being one."""
    host = F.transform(F.split(host_of(url), r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path_of(url), "/"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(F.lower(x), "[0-9]+", "0")))
    query = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&")
    keys = F.transform(query, lambda x: F.concat(F.lit("q:"), F.element_at(F.split(x, "=", 2), 1)))
    return F.array_distinct(F.filter(F.concat(host, segments, keys), lambda x: F.length(x) > 2))


def document_of(url: Column) -> Column:
    """The number of the path's second segment, which names the document a page was made of; null if there is none."""
    return F.regexp_extract(path_of(url), r"^/[^/]*/([0-9]{1,18})(?![0-9])", 1).try_cast("long")


def _rarest(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """rules with `token`: the one of its tokens that counts (token, n) has the fewest of."""
    each = rules.select("rule_id", F.explode("tokens").alias("token")).join(counts, "token", "left")
    chosen = each.groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).alias("least"))
    return rules.join(chosen, "rule_id").withColumn("token", F.col("least.token")).drop("least")


def same_rows(rows: DataFrame, least: float) -> DataFrame:
    """(item, tokens) of the tokens of rows (_row, tokens) that at least `least` rows hold and that stand in the same rows as others: the first of them and all.

    Rows are compared by their number and two 64-bit sums. At most as many tokens as rows have on average, over the least share.
    """
    each = rows.select("_row", F.explode("tokens").alias("token"))
    sums = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("_row")).alias("a"), F.bit_xor(F.xxhash64("_row", F.lit(1))).alias("b"))
    alike = sums.where(F.col("n") >= least).groupBy("n", "a", "b").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    return alike.where(F.size("tokens") > 1).select(F.col("tokens")[0].alias("item"), "tokens")


def mine(rows: DataFrame, min_support: float = 0.005, min_confidence: float = 0.6, min_lift: float = 1.5, min_count: int = 10, min_z: float = 4.0) -> DataFrame:
    """(rule_id, tokens, confidence, support, ways) from rows (tokens, blocked), by FP-growth. ways holds for each token all that may stand for it.

    A rule needs min_count blocked rows, however few rows there are, and more of them than chance gives: its
    confidence lies min_z standard errors above the share of blocked rows. A rule goes if some of its tokens alone reach its
    confidence; such pairs are found by the rarest token of the smaller one.
    """
    rows = saved(rows.select("tokens", "blocked", F.monotonically_increasing_id().alias("_row")), "url-rows")
    empty = rows.sparkSession.createDataFrame([], "rule_id long, tokens array<string>, confidence double, support double, ways array<array<string>>")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("bad")).first()
    n, bad = total["n"], total["bad"]
    if bad < min_count or bad == n:
        return empty
    alike = saved(same_rows(rows, max(min_support * n, min_count)), "url-alike")
    if not alike.isEmpty():
        names = alike.select("item", F.explode("tokens").alias("token"))
        each = rows.select("_row", "blocked", F.explode_outer("tokens").alias("token")).join(F.broadcast(names), "token", "left")
        rows = each.groupBy("_row", "blocked").agg(F.collect_set(F.coalesce("item", "token")).alias("tokens"))
    items = saved(rows.select(F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(BLOCK)))).otherwise(F.col("tokens")).alias("items")), "url-items")
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_count / n), minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(F.array_contains("consequent", BLOCK) & (F.size("consequent") == 1) & (F.col("lift") >= min_lift))
    share = bad / n
    z = (F.col("confidence") - share) / F.sqrt(share * (1 - share) * F.col("confidence") / (F.col("support") * n))
    found = found.where((F.round(F.col("support") * n) >= min_count) & (z >= min_z))
    found = saved(found.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support").withColumn("rule_id", F.xxhash64("tokens")), "url-rules")
    each = found.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token"))
    smaller = _rarest(found, each.groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    smaller = smaller.select("token", F.col("tokens").alias("fewer"), F.col("confidence").alias("sure"))
    narrow = each.join(smaller, "token").where((F.size("fewer") < F.size("tokens")) & (F.col("sure") >= F.col("confidence")))
    implied = narrow.where(F.size(F.array_except("fewer", "tokens")) == 0).select("rule_id").distinct()
    kept = found.join(implied, "rule_id", "left_anti")
    place = kept.select("rule_id", F.posexplode("tokens").alias("at", "item")).join(F.broadcast(alike.withColumnRenamed("tokens", "way")), "item", "left")
    ways = place.groupBy("rule_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("way", F.array("item")).alias("way")))), lambda x: x["way"]).alias("ways"))
    return kept.join(ways, "rule_id").select("rule_id", "tokens", "confidence", "support", "ways")


def match(pages: DataFrame, rules: DataFrame, salts: int = 16) -> DataFrame:
    """(page_row, rule_ids) of the pages (page_row, tokens) in which rules (rule_id, tokens, and ways if there are any) fire.

    The index holds each rule once for each way of the one of its tokens that the fewest pages have. Pages look up all their
    tokens and check the rest of what they find. Tokens are salted, so that a common one is no single task.
    """
    rules = rules if "ways" in rules.columns else rules.withColumn("ways", F.transform("tokens", lambda t: F.array(t)))
    known = rules.select(F.explode(F.flatten("ways")).alias("token")).distinct()
    held = pages.select("page_row", "tokens", F.explode("tokens").alias("token"))
    counts = held.join(known, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    way = F.element_at("ways", F.array_position("tokens", F.col("token")).cast("int"))
    index = _rarest(rules.select("rule_id", "tokens", "ways"), counts).select("rule_id", "ways", F.explode(way).alias("token"))
    index = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = held.withColumn("salt", F.pmod(F.xxhash64("page_row"), F.lit(salts)).cast("int"))
    met = dealt.join(index, ["token", "salt"]).where(F.forall("ways", lambda w: F.arrays_overlap(w, F.col("tokens"))))
    return met.groupBy("page_row").agg(F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, key: Column | None = None, **mining: float) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined) of every row of pages.

    key is what joins a page to `labels.doc_id` (page_id if none is given); rows of labels with the same id count as
    one, toxic if any is.

    mined holds the fired rules of pages that no fixed rule decides: with one or more the verdict is block, else
    allow. Null URLs and URLs without :// have an empty host and path and no rule. Null or repeated ids are rows
    of their own; only ids with a label are learnt from. Without labels, or with an empty table, nothing is mined. URLs of any
    length are read whole; rules of one length go by their place in the list; other columns are not used.
    """
    url = F.col("url")
    own = F.col("page_id").cast("long") if key is None else key
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), own.alias("label_id"), url).select("page_id", "label_id", host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("tokens"))
    rows = saved(read.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules)).withColumn("page_row", F.monotonically_increasing_id()), "url-pages")
    known = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("blocked"))
    mined = saved(mine(rows.join(known, rows["label_id"] == known["doc_id"]).select("tokens", "blocked"), **mining), "url-mined")
    base = rows.select("page_row", "page_id", "host", "path", "fixed")
    if mined.isEmpty():
        out = base.withColumn("rule_ids", F.lit(None).cast("array<long>"))
    else:
        out = base.join(match(rows.where("fixed IS NULL").select("page_row", "tokens"), mined), "page_row", "left")
    return out.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), F.coalesce("fixed.verdict", F.when(F.size(F.coalesce("rule_ids", F.array().cast("array<long>"))) > 0, "block").otherwise("allow")).alias("verdict"), F.col("rule_ids").alias("mined"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for all pages. A page's label is that of the document whose number its path holds: their languages agree, which page_id's do not."""
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), key=document_of(F.col("url"))).drop("mined")
