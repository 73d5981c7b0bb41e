"""URL filter: rules first, then the ratio of two character language models. DataFrame functions only.

Two variable-order Markov models are counted from the URLs that no rule decides: one of rejected URLs, one of all
others. Rejected are those whose host has a seed term, or whose host or path is built as only link farms build them
(STRUCTURE); what nothing is known of counts as accepted. Rules settle their own URLs and teach nothing: they are
made of top-level domains and languages, which the models would take for evidence (measured: every .net host then
looked rejected). Each host weighs the same, whatever the number of its URLs. Each order is smoothed with the next
shorter one (Dirichlet prior). A URL's score is the mean over its characters of log p_accepted - log p_rejected,
each character read at the longest context that the models know.

No host judges itself: the counts of a URL's own host are left out of the models that score it, so that an unlisted
host is judged by what it looks like and not by its own name among the accepted. All URLs without a rule then
calibrate the cut between the two classes: the best balanced accuracy of these held-out scores.

No gram is left out: scoring joins the distinct lines' characters to the whole table of grams, which grows
with the input. Only grams that make up a thousandth of all characters (a thousand at most) are broadcast.

Nulls and edge cases: a null url or one without :// has an empty host and path, no rule and no
characters; its score is 0 and, as nothing speaks against it, its verdict allow. Ties at the cut are
allowed. Rows are judged one by one, so repeated rows and ids change nothing (each counts as evidence once more);
extra columns keep their values whatever their names, the results are fields of one struct; without
rejected URLs the cut is the lowest score and all are allowed; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import cut, hot_keys, lower_ascii, salted_join, table

#: (verdict, host suffix + path prefix)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Terms of hosts that nobody wants in a corpus; they seed the model of rejected URLs.
SEED_TERMS = ("casino", "adult", "xxx", "porn", "bets", "betting", "poker", "spam", "viagra", "warez")
#: Hosts that are bare addresses or punycode, or with a label of 30 characters, 3 hyphens or 6 digits, and paths
#: that repeat a segment three times.
STRUCTURE = (r"^[0-9.]+$|(^|[.])xn--|[^.]{30}|-[^.]*-[^.]*-|([0-9][^.]*){6}", r"(/[^/]{2,})\1\1")
ORDER = 5
#: The weight of a host, dealt to its URLs in whole numbers, so that sums don't depend on their order.
WEIGHT = 1 << 20
PRIOR = 2.0
HOT = 1000
BINS = 400
SPAN = 4.0
#: Rules are compiled into the plan; longer lists belong in a table joined on host suffixes.
MAX_RULES = 200


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({u}, instr({u}, '://') + 3)".format(u="__url"))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct<length, rule, verdict>, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones are longer and win
        suffix, _, prefix = rule.partition("/")
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith("/" + prefix)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def normal(host: Column, path: Column) -> Column:
    """What the models read: host and path with digits as 0, between marks of begin and end."""
    return F.when(F.length(host) > 0, F.concat(F.lit("^"), F.translate(F.concat(host, lower_ascii(path)), "123456789", "000000000"), F.lit("$"))).otherwise("")


def judged(pages: DataFrame, rules=RULES, seed_terms=SEED_TERMS) -> DataFrame:
    """__p (the row as a struct), host, path, hit (struct or null), line, site and decided
    (1 accepted, 0 rejected, null: nothing to read)."""
    d = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("__p"), F.col("url").alias("__url"))
    host, path = host_path(F.col("__url"))
    d = d.withColumn("host", host).withColumn("path", path)
    d = d.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("line", normal(F.col("host"), F.col("path")))
    seeded = F.col("host").rlike("(^|[^a-z])(" + "|".join(seed_terms) + ")([^a-z]|$)") if seed_terms else F.lit(False)
    built = F.col("host").rlike(STRUCTURE[0]) | F.col("path").rlike(STRUCTURE[1])
    decided = F.when(F.col("hit.verdict") == "allow", 1).when(seeded | built | (F.col("hit.verdict") == "block"), 0).when(F.length("line") > 1, 1)
    # hosts that the models can't tell apart are one
    return d.withColumn("decided", decided.cast("long")).withColumn("site", F.translate("host", "123456789", "000000000")).drop("__url")


def count_grams(lines: DataFrame, order: int = ORDER) -> DataFrame:
    """site, gram, its order n, and its weights in accepted (a) and rejected (r) lines of the site; lines are distinct."""
    # the last character of a gram is read after the others; the first mark is never read itself
    pos = F.explode(F.expr("sequence(2, length(line))")).alias("i")
    at = lines.where(F.length("line") > 1).select("site", "line", "a", "r", pos)
    at = at.select("site", "line", "a", "r", "i", F.explode(F.expr(f"sequence(1, least({order}, i))")).alias("n"))
    return at.select("site", "n", F.expr("substring(line, i - n + 1, n)").alias("gram"), "a", "r").groupBy("site", "n", "gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))


def log_ratios(own: DataFrame, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """site, gram, ratio: log p_accepted - log p_rejected of the last character of each longest gram of a site's
    lines, by the longest end of it that the models of all other sites know; 0 where they know none."""
    context = lambda *by: Window.partitionBy(*by, "n", F.expr("substring(gram, 1, n - 1)"))
    own = cut(own.withColumn("ca", F.sum("a").over(context("site"))).withColumn("cr", F.sum("r").over(context("site"))))
    every = cut(own.groupBy("n", "gram").agg(F.sum("a").alias("ta"), F.sum("r").alias("tr"), F.count("*").alias("sites")))
    every = every.withColumn("tca", F.sum("ta").over(context())).withColumn("tcr", F.sum("tr").over(context()))
    # most sites have the most frequent grams
    left = salted_join(own, every.drop("n"), "gram", hot_keys(every, "gram", "sites", own.count()), F.col("site"))
    rest = lambda total, mine: ((F.col(total) - F.col(mine)) / WEIGHT)
    left = left.select("site", "gram", F.struct("n", rest("ta", "a").alias("a"), rest("tr", "r").alias("r"), rest("tca", "ca").alias("ca"), rest("tcr", "cr").alias("cr")).alias("x"))
    longest = own.where((F.col("n") == order) | F.col("gram").startswith("^")).select("site", F.col("gram").alias("whole"), F.explode(F.expr("sequence(1, n)")).alias("n"))
    ends = longest.select("site", "whole", F.expr("substring(whole, length(whole) - n + 1, n)").alias("gram")).join(left, ["site", "gram"])
    smoothed = F.expr(
        f"""aggregate(array_sort(x), named_struct('pa', 1D / 128, 'pr', 1D / 128, 'ratio', 0D),
        (p, y) -> if(y.a + y.r <= 0, p, named_struct(
            'pa', (y.a + {prior}D * p.pa) / (y.ca + {prior}D), 'pr', (y.r + {prior}D * p.pr) / (y.cr + {prior}D),
            'ratio', ln((y.a + {prior}D * p.pa) / (y.ca + {prior}D)) - ln((y.r + {prior}D * p.pr) / (y.cr + {prior}D)))),
        p -> p.ratio)"""
    )
    return ends.groupBy("site", F.col("whole").alias("gram")).agg(F.collect_list("x").alias("x")).select("site", "gram", smoothed.alias("ratio"))


def line_scores(lines: DataFrame, ratios: DataFrame, order: int = ORDER) -> DataFrame:
    """line, score of lines (distinct, with their site): their characters are joined to the whole table of ratios."""
    at = lines.select("line", "site", F.explode(F.expr("sequence(2, length(line))")).alias("i"))
    at = at.select("line", "site", "i", F.expr(f"substring(line, greatest(i - {order}, 0) + 1, least(i, {order}))").alias("gram"))
    values = cut(at.groupBy("site", "gram").agg(F.count("*").alias("c")).join(ratios, ["site", "gram"]))
    # grams of one position in HOT or more: HOT at most, so these may be broadcast; they would be hot keys of the other join
    least = (values.agg(F.sum("c").alias("c")).first().c or 0) / HOT
    often = F.broadcast(values.where(F.col("c") >= least).select("site", "gram", "ratio"))
    seldom = values.where(F.col("c") < least).select("site", "gram", "ratio")
    read = at.join(often, ["site", "gram"]).unionByName(at.join(often, ["site", "gram"], "left_anti").join(seldom, ["site", "gram"]))
    # a line's own characters, in their order, so that the sum is the same in every run
    sums = read.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("i", "ratio"))).alias("x"))
    return sums.select("line", F.expr("aggregate(x, 0D, (acc, y) -> acc + y.ratio) / size(x)").alias("score"))


def calibrate(held: DataFrame) -> DataFrame:
    """One row: the cut with the best balanced accuracy over scored lines (score; a, r: their accepted and rejected URLs), by a histogram of BINS bins."""
    b = F.least(F.greatest(F.floor((F.col("score") + SPAN) / (2 * SPAN) * BINS), F.lit(0)), F.lit(BINS - 1))
    bins = held.groupBy(b.alias("b")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    bins = held.sparkSession.range(BINS + 1).withColumnRenamed("id", "b").join(bins, "b", "left").fillna(0, ["a", "r"])
    w = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # BINS + 1 rows
    whole = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rates = bins.select(
        "b",
        (F.coalesce(F.sum("r").over(w), F.lit(0)) / F.greatest(F.sum("r").over(whole), F.lit(1))).alias("rejected"),
        (1 - F.coalesce(F.sum("a").over(w), F.lit(0)) / F.greatest(F.sum("a").over(whole), F.lit(1))).alias("accepted"),
        F.sum("r").over(whole).alias("n"),
    )
    best = rates.agg(F.max_by(F.struct("b", "n"), F.struct(F.col("rejected") + F.col("accepted"), -F.abs(F.col("b") - BINS // 2))).alias("x"))
    edge = F.col("x.b") * (2 * SPAN / BINS) - SPAN
    return best.select(F.when(F.col("x.n") > 0, edge).otherwise(F.lit(-1e9)).alias("cut"))


def filter_urls(pages: DataFrame, rules=RULES, seed_terms=SEED_TERMS, name: str = "url_filter") -> DataFrame:
    """All columns of pages and a struct `name` of host, path, rule, verdict, score, cut."""
    d = judged(pages, rules, seed_terms)
    free = F.col("hit").isNull()
    # a row per distinct line, and the weight of its URLs that no rule decides
    lines = cut(d.where(F.length("line") > 1).groupBy("site", "line").agg(F.count("*").alias("urls"), F.sum(free.cast("long")).alias("free"), F.max("decided").alias("decided")))
    sites = lines.groupBy("site").agg(F.sum("free").alias("n"), F.count("*").alias("lines"))
    total, n_lines = lines.agg(F.coalesce(F.sum("urls"), F.lit(0)), F.count("*")).first()
    weighed = salted_join(lines, sites, "site", hot_keys(sites, "site", "lines", n_lines), F.col("line"))
    weight = F.col("free") * F.greatest(F.lit(1), F.expr(f"{WEIGHT} div greatest(n, 1)"))
    weighed = cut(weighed.select("site", "line", "urls", "free", (F.col("decided") * weight).alias("a"), ((1 - F.col("decided")) * weight).alias("r")))
    scores = cut(weighed.join(line_scores(weighed.select("site", "line"), log_ratios(count_grams(weighed))), "line"))
    # the cut parts the URLs that no rule decides
    limit = cut(calibrate(scores.where("free > 0").select("score", "a", "r")))
    readable = F.coalesce(F.length("line") > 1, F.lit(False))
    # one URL may hold a third of all rows
    out = salted_join(d.where(readable), scores.select("line", "score"), "line", hot_keys(scores, "line", "urls", total), F.spark_partition_id())
    out = out.select(*d.columns, "score").unionByName(d.where(~readable).withColumn("score", F.lit(0.0))).join(F.broadcast(limit), F.lit(True))
    verdict = F.coalesce(F.col("hit.verdict"), F.when((F.length("line") < 2) | (F.col("score") >= F.col("cut")), "allow").otherwise("block"))
    found = F.struct("host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "score", "cut").alias(name)
    return out.select("__p.*", found)


def op1(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "url_filter.host", "url_filter.path", "url_filter.rule", "url_filter.verdict", F.round("url_filter.score", 6).alias("score"))
