"""URL filters: fixed rules first, then association rules that FP-growth mines from their verdicts.

DataFrame and ML pipeline functions only. A url is the set of its tokens: host labels, path segments,
query names and scheme. The urls that the fixed rules decide are the labelled ones. FP-growth finds the
token combinations frequent among them, and those that go with one verdict confidently enough become
mined rules. What the fixed rules look at is left out of the mining: within the labelled urls it says
nothing but which rule applied. A mined rule is found by its rarest token and then compared whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialoom.llm.base import written


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, below a path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The given rules.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"),
         Rule("allow", "org", "/fr/"))
DEFAULT = "allow"

#: A combination counts from this share of the labelled urls on, and from this many of them.
LEAST_SHARE, LEAST_COUNT = 0.002, 20
LEAST_CONFIDENCE = 0.9
#: Of a labelled url's frequent tokens FP-growth combines the most telling ones, at most so many, since
#: combinations double with each. What it leaves out is mined step by step: _combined_further().
COMBINED = 8
#: Equal rows that one task writes out for the mining.
SHARE = 10_000
LABEL = "="


def _after_scheme(url: Column) -> Column:
    return F.when(url.contains("://"), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """What follows the first :// up to /, ? or #, with A-Z lower-cased; else empty."""
    found = F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ? or #; else empty."""
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The place in rules of the longest that fits, else null."""
    fits = [((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path) for rule in rules]
    longest = sorted(range(len(rules)), key=lambda i: -len(rules[i].name))
    return F.coalesce(*[F.when(fits[i], i) for i in longest]) if rules else F.lit(None).cast("int")


def tokens(url: Column, host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The distinct tokens of a url, but for those that the rules look at; digit runs all count as 0.

    h: host label, p: path segment, q: query name, s: scheme.
    """
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    parts = (("h:", F.split(host, r"\.")), ("p:", F.split(path, "/")),
             ("q:", F.transform(F.split(query, "[&;]"), lambda q: F.regexp_extract(q, "^[^=]*", 0))),
             ("s:", F.array(F.when(url.contains("://"), F.lower(F.substring_index(url, "://", 1))).otherwise(""))))

    def of_kind(kind: str, found: Column) -> Column:
        return F.transform(F.filter(found, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))

    named = F.concat(*[of_kind(kind, found) for kind, found in parts])
    looked_at = sorted({f"h:{x}" for r in rules for x in r.host.split(".")} | {f"p:{x}" for r in rules for x in r.path.split("/")})
    return F.array_except(F.transform(named, lambda x: F.regexp_replace(x, "[0-9]+", "0")),
                          F.array(*[F.lit(x) for x in looked_at]).cast("array<string>"))


def read_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(url, n, host, path, fixed, tokens), one row per distinct url; a null url counts as empty."""
    urls = pages.groupBy(F.coalesce("url", F.lit("")).alias("url")).agg(F.count("*").alias("n"))
    return (urls.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
            .withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
            .withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path"), rules)))


def _verdict(fixed: Column, rules: tuple[Rule, ...]) -> Column:
    return F.array(*[F.lit(r.verdict) for r in rules]).cast("array<string>")[fixed]


def mine(labelled: DataFrame, least_share: float = LEAST_SHARE, least_count: int = LEAST_COUNT,
         least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """(items, verdict, confidence, support, rarest) of the mined rules, from labelled (tokens, verdict).

    Rules are pruned by support and confidence, and where a rule with fewer of the same tokens has the same
    verdict at no less confidence. Labels without rows, or with too few, give no rules. How many rules
    there can be depends on the shares, not on the number of urls. FP-growth, which sees at most COMBINED
    tokens of a url, names the candidates, and _combined_further() those of urls with more; support and
    confidence are then counted over all tokens.
    """
    spark = labelled.sparkSession
    n = labelled.count()
    least = max(least_share * n, least_count, 1)
    total = labelled.groupBy("verdict").agg((F.count("*") / F.lit(float(max(n, 1)))).alias("usual"))
    token = labelled.select("verdict", F.explode("tokens").alias("token"))
    known = (token.groupBy("token", "verdict").agg(F.count("*").alias("with"))
             .join(F.broadcast(total), "verdict")  # a row per verdict
             .groupBy("token").agg(F.sum("with").alias("many"),
                                   F.max(F.struct("with", "usual")).alias("most"))
             .where(F.col("many") >= least)
             .select("token", "many", (F.col("most.with") / F.col("many") - F.col("most.usual")).alias("telling")))
    known = written(known, "url-tokens")
    # equal sets of tokens are one row each from here on, so only they meet the frequent tokens
    sets = written(labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("n")), "url-sets")
    telling = (sets.withColumn("set", F.struct("tokens", "verdict")).select("set", "n", F.explode("tokens").alias("token"))
               .join(known, "token").groupBy("set", "n")
               .agg(F.sort_array(F.collect_list(F.struct("telling", "token")), False)["token"].alias("kept")))
    picked = telling.withColumn("kept", F.slice("kept", 1, COMBINED))
    # a set that very many urls share is handed to several tasks before its rows are written out
    shares = picked.select(F.concat("kept", F.array(F.concat(F.lit(LABEL), "set.verdict"))).alias("items"), "n", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SHARE).cast("long"))).alias("first"))
    baskets = shares.repartition("items", "first").select(
        "items", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n") - F.col("first"), F.lit(SHARE))))).select("items")
    if not n or known.isEmpty():
        return spark.createDataFrame([], "items array<string>, verdict string, confidence double, support double, rarest string")
    frequent = FPGrowth(itemsCol="items", minSupport=min(least / n, 1.0), minConfidence=least_confidence).fit(baskets)
    told = (frequent.associationRules.where(F.col("consequent")[0].startswith(LABEL))
            .select(F.array_sort("antecedent").alias("items")))
    more = _combined_further(telling.where(F.size("kept") > COMBINED), known, sets, n, least)
    told = reduce(DataFrame.unionByName, more, told).distinct()
    return _without_special_cases(_counted(written(_by_rarest(told, known), "url-candidates"), sets, n, least, least_confidence))


def _by_rarest(told: DataFrame, known: DataFrame) -> DataFrame:
    """(items, rarest) of the combinations."""
    return (told.select("items", F.explode("items").alias("token")).join(known, "token")
            .groupBy("items").agg(F.min(F.struct("many", "token")).alias("least"))
            .select("items", F.col("least.token").alias("rarest")))


def _combined_further(longer: DataFrame, known: DataFrame, sets: DataFrame, n: int, least: float) -> list[DataFrame]:
    """(items) of all rules that can be within sets of more than COMBINED frequent tokens, a frame per size.

    Combinations grow by one token at a time, as long as they can be part of a rule that is no special case:
    one verdict is frequent, the urls are fewer than those of every part, and of both verdicts. So
    nothing is enumerated but what may still tell something, and nothing that does is left out.
    """
    rows = longer.select(F.xxhash64("set").alias("of"), F.explode("kept").alias("token"))
    within = written(rows.select("of", F.array("token").alias("items")), "url-longer")
    tried = within.select("items").distinct().withColumn("less", F.lit(n + 1).cast("long"))
    found: list[DataFrame] = []
    while not within.isEmpty():
        size = len(found) + 1
        counts = (_holding(_by_rarest(tried, known), sets).groupBy("items")
                  .agg(F.sum("with").alias("all"), F.max("with").alias("most")).join(tried, "items"))
        frequent = written(counts.where((F.col("most") >= least) & (F.col("all") < F.col("less"))).select("items", "all", "most"), "url-combined")
        found.append(frequent.select("items"))
        open_ones = frequent.where((F.col("most") < F.col("all")) & (F.col("all") < n)).select("items", "all")
        own = within.join(open_ones.select("items"), "items", "left_semi").select(
            "of", F.slice("items", 1, size - 1).alias("front"), F.element_at("items", -1).alias("last"))
        other = own.select("of", "front", F.col("last").alias("next"))
        within = written(own.join(other, ["of", "front"]).where(F.col("last") < F.col("next")).select(
            "of", F.concat("front", F.array("last", "next")).alias("items")).distinct(), "url-longer")
        # each part, the combination without one of its tokens, must be open as well
        part = F.explode(F.transform("items", lambda left: F.array_remove("items", left)))
        tried = written(within.select("items").distinct().select("items", part.alias("part"))
                        .join(open_ones.select(F.col("items").alias("part"), "all"), "part")
                        .groupBy("items").agg(F.min("all").alias("less"), F.count("*").alias("parts"))
                        .where(F.col("parts") == size + 1).select("items", "less"), "url-combined")
        within = within.join(tried.select("items"), "items", "left_semi")
    return found


def _holding(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """(items, rarest, verdict, with) of the candidates (items, rarest) among all tokens of all labelled urls."""
    return (sets.withColumn("token", F.explode("tokens")).join(candidates, F.col("token") == F.col("rarest"))
            .where(F.size(F.array_except("items", "tokens")) == 0)
            .groupBy("items", "rarest", "verdict").agg(F.sum("n").alias("with")))


def _counted(candidates: DataFrame, sets: DataFrame, n: int, least: float, least_confidence: float) -> DataFrame:
    """The candidates (items, rarest) that have support and confidence among all tokens of all labelled urls."""
    held = _holding(candidates, sets)
    share = F.col("of.with") / F.col("all")
    return written(held.groupBy("items", "rarest").agg(F.sum("with").alias("all"), F.collect_list(F.struct("verdict", "with")).alias("by"))
                   .select("items", "rarest", "all", F.explode("by").alias("of"))
                   .where((F.col("of.with") >= least) & (share >= least_confidence))
                   .select("items", "of.verdict", share.alias("confidence"), (F.col("of.with") / n).alias("support"), "rarest"), "url-rules")


def _without_special_cases(mined: DataFrame) -> DataFrame:
    general = mined.select(F.col("rarest").alias("token"), *[F.col(c).alias(f"g_{c}") for c in ("items", "verdict", "confidence")])
    special = (mined.withColumn("token", F.explode("items")).join(general, "token")
               .where((F.col("verdict") == F.col("g_verdict")) & (F.col("g_confidence") >= F.col("confidence"))
                      & (F.size("g_items") < F.size("items")) & (F.size(F.array_except("g_items", "items")) == 0))
               .select("items", "verdict").distinct())
    return written(mined.join(special, ["items", "verdict"], "left_anti"), "url-rules")


def matched(urls: DataFrame, mined: DataFrame) -> DataFrame:
    """(url, best) for urls (url, tokens) that a mined rule fits: the most confident, then the most frequent.

    The rules are indexed by their rarest tokens; a url meets those that its tokens name, and a rule fits
    if all its tokens are there.
    """
    index = mined.select(F.col("rarest").alias("token"), "items", "verdict", "confidence", "support")
    order = F.struct(-F.col("confidence"), -F.col("support"), -F.size("items"), F.col("items"), F.col("verdict").alias("verdict"))
    return (urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
            .where(F.size(F.array_except("items", "tokens")) == 0)
            .groupBy("url").agg(F.min(order).alias("best"))
            .select(F.col("url").alias("of"), F.col("best.verdict").alias("mined"), F.col("best.items").alias("items")))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined) for every row of pages.

    rule names the fixed rule that decides; mined the tokens of the mined rule that does, where no fixed one
    fits. Without either the verdict is DEFAULT. Null urls and urls without :// have an empty host and path.
    Repeated rows are judged each, a null page_id stays, other columns are not read, an empty table gives no rows.
    """
    read = written(read_urls(pages, rules), "urls")
    labelled = read.where("fixed IS NOT NULL").select("tokens", _verdict(F.col("fixed"), rules).alias("verdict"))
    open_urls = read.where("fixed IS NULL")
    best = matched(open_urls, mine(labelled))
    names = F.array(*[F.lit(r.name) for r in rules]).cast("array<string>")
    judged = read.join(best, read.url == best.of, "left").select(
        F.col("url").alias("judged"), "host", "path", names[F.col("fixed")].alias("rule"),
        F.coalesce(_verdict(F.col("fixed"), rules), "mined", F.lit(DEFAULT)).alias("verdict"),
        F.array_join("items", " ").alias("mined"))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("judged"))
    return rows.join(judged, "judged").drop("judged")
