"""URL filters (operator 1): rules first, then a ratio of character language models of accepted and rejected URLs.

Both models are smoothed variable-order Markov models of the URL's characters. They interpolate contexts of every length up to ORDER - 1
(Witten-Bell: a context with n observations of t different next characters trusts itself n / (n + t)), so a context that was never seen
falls back on the shorter one. A string of k characters is part of the models if it makes up at least LEAST_SHARE of all strings of
k characters: the order varies with what there is to learn from, and a model has at most 1 / LEAST_SHARE rows per order, whatever the
number of URLs. That is the proven bound of what is broadcast. A URL's score is the mean over its characters of log P(accepted) -
log P(rejected). The threshold is calibrated on labelled URLs that the models did not see: of all cuts of a histogram of their scores,
the one with the largest sum of the accepted URLs' and rejected URLs' shares on the right sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.base import cut, parts

#: Printable characters that are told apart; code 0 is the start, the code after the last is any other character.
SYMBOLS = "".join(c for c in map(chr, range(33, 127)) if not "A" <= c <= "Z")
BASE = len(SYMBOLS) + 2
ORDER = 4
LEAST_SHARE = 2.0**-18
#: One URL in so many is kept from training and calibrates.
FOLDS = 5
#: Histogram of scores: cuts per nat.
CUTS = 50


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end; else both empty."""
    at = F.coalesce(F.instr(url, F.lit("://")), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def best_rule(host: F.Column, path: F.Column, rules: list[tuple[str, str]]) -> tuple[F.Column, F.Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does. rules: (allow or block, host/path)."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, _, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _codes(urls: DataFrame, keep: list[str]) -> DataFrame:
    """One row per character: gram1 to gramORDER, the codes of the last k characters up to it, each tagged by its length, and their contexts.

    The codes of a URL's characters are made once, so the work grows with its length, however long it is.
    """
    symbol = lambda c: F.when(F.instr(F.lit(SYMBOLS), c) == 0, F.lit(BASE - 1)).otherwise(F.instr(F.lit(SYMBOLS), c)).cast("long")
    codes = urls.select(*keep, F.transform(F.split(F.lower("url"), ""), symbol).alias("codes"))

    def grams(i):
        back = [F.when(i >= k, F.get("codes", i - k)).otherwise(F.lit(0)) for k in range(ORDER)]
        value = lambda size, skip: sum((back[k + skip] * F.lit(BASE**k).cast("long") for k in range(size)), F.lit(BASE**size).cast("long"))
        return F.struct(*[value(size, 0).alias(f"gram{size}") for size in range(1, ORDER + 1)], *[value(size, 1).alias(f"context{size}") for size in range(1, ORDER)])

    places = F.sequence(F.lit(0), F.size("codes") - 1)
    return codes.filter(F.size("codes") > 0).select(*keep, F.inline(F.transform(places, grams)))


def _size(k: int) -> F.Column:
    return F.col("gram").between(BASE**k, 2 * BASE**k - 1)


def train(labelled: DataFrame) -> DataFrame:
    """(gram, ratio, fallback) from (url, accepted boolean).

    gram is a string of up to ORDER characters (its code is tagged by the length, so all orders share one column). ratio: log P of its
    last character after the others, accepted less rejected; fallback: as a context, the log of the weight it leaves to the shorter one.
    Of a string that is kept, its end and its context are kept too, as both are at least as frequent.
    """
    distinct = labelled.filter("url <> ''").select("url", "accepted").distinct()
    grams = _codes(distinct, ["accepted"]).select("accepted", F.explode(F.array(*[F.col(f"gram{k}") for k in range(1, ORDER + 1)])).alias("gram"))
    counted = cut(grams.groupBy("gram").agg(F.count_if("accepted").alias("n1"), F.count_if(~F.col("accepted")).alias("n0")))
    every = counted.filter(_size(1)).agg(F.sum(F.col("n1") + F.col("n0"))).first()[0] or 0
    counted = counted.filter(F.col("n1") + F.col("n0") >= LEAST_SHARE * every)
    model = None
    for k in range(1, ORDER + 1):
        here = counted.filter(_size(k))
        body = F.col("gram") - BASE**k
        # The context drops the last character (the lowest digit), the shorter gram drops the first (the highest).
        here = here.select("gram", "n1", "n0", (F.floor(body / BASE) + BASE ** (k - 1)).cast("long").alias("context"), (F.pmod(body, F.lit(BASE ** (k - 1))) + BASE ** (k - 1)).cast("long").alias("shorter"))
        of = here.groupBy("context").agg(*[f for c in "10" for f in (F.sum(f"n{c}").alias(f"s{c}"), F.count_if(F.col(f"n{c}") > 0).alias(f"t{c}"))])
        here = here.join(of, "context")
        if k == 1:
            here = here.withColumns({f"q{c}": F.lit(1.0 / BASE) for c in "10"})
        else:
            here = here.join(level.select(F.col("gram").alias("shorter"), *[F.col(f"p{c}").alias(f"q{c}") for c in "10"]), "shorter")
        smooth = {f"p{c}": F.when(F.col(f"s{c}") > 0, (F.col(f"n{c}") + F.col(f"t{c}") * F.col(f"q{c}")) / (F.col(f"s{c}") + F.col(f"t{c}"))).otherwise(F.col(f"q{c}")) for c in "10"}
        level = cut(here.withColumns(smooth).select("gram", "context", "p1", "p0", *[f"{x}{c}" for x in "st" for c in "10"]))
        leaves = {c: F.when(F.col(f"s{c}") > 0, F.log(F.col(f"t{c}") / (F.col(f"s{c}") + F.col(f"t{c}")))).otherwise(F.lit(0.0)) for c in "10"}
        contexts = level.groupBy(F.col("context").alias("gram")).agg(F.first(leaves["1"] - leaves["0"]).alias("fallback"))
        ratios = level.select("gram", F.log(F.col("p1") / F.col("p0")).alias("ratio"))
        both = ratios.select("gram", "ratio", F.lit(None).cast("double").alias("fallback")).unionByName(contexts.select("gram", F.lit(None).cast("double").alias("ratio"), "fallback"))
        model = both if model is None else model.unionByName(both)
    return cut(model.groupBy("gram").agg(F.max("ratio").alias("ratio"), F.coalesce(F.max("fallback"), F.lit(0.0)).alias("fallback")))


def score(urls: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """(key, score): the mean log ratio of a URL's characters. Rows of a URL stay in one task, so their sum is all that is shuffled."""
    rows = _codes(urls.filter("url <> ''").select(key, "url"), [key])
    for k in range(1, ORDER + 1):  # at most 1 / LEAST_SHARE rows each
        known = model.filter(_size(k) & F.col("ratio").isNotNull()).select(F.col("gram").alias(f"gram{k}"), F.col("ratio").alias(f"ratio{k}"))
        rows = rows.join(F.broadcast(known), f"gram{k}", "left")
    for k in range(1, ORDER):
        contexts = model.filter(_size(k) & (F.col("fallback") != 0)).select(F.col("gram").alias(f"context{k}"), F.col("fallback").alias(f"fallback{k}"))
        rows = rows.join(F.broadcast(contexts), f"context{k}", "left")
    found = F.lit(0.0)
    for k in range(1, ORDER + 1):  # a longer gram that is known says it all; else its context's fallback is added to the shorter one's
        left = F.coalesce(F.col(f"fallback{k - 1}"), F.lit(0.0)) if k > 1 else F.lit(0.0)
        found = F.coalesce(F.col(f"ratio{k}"), found + left)
    return rows.groupBy(key).agg(F.avg(found).alias("score"))


def threshold(scored: DataFrame) -> float:
    """The calibrated cut from (score, accepted) of held-out URLs: the lowest of the best; 0 unless both kinds are there."""
    bins = scored.groupBy(F.floor(F.col("score") * CUTS).alias("bin")).agg(F.count_if("accepted").alias("n1"), F.count_if(~F.col("accepted")).alias("n0"))
    below, every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    right = bins.select("bin", *[(F.coalesce(F.sum(f"n{c}").over(below), F.lit(0)) / F.nullif(F.sum(f"n{c}").over(every), F.lit(0))).alias(f"b{c}") for c in "10"])
    best = right.orderBy(F.desc(F.col("b0") - F.col("b1")), "bin").filter("b0 is not null and b1 is not null").limit(1).collect()
    return best[0].bin / CUTS if best else 0.0


def judge(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score, threshold.

    The URLs that rules accept and reject train and calibrate the models; the verdict of the others is allow if their score reaches the
    threshold. A null or empty URL has score 0, as nothing speaks for or against it. Pages are judged row by row, so repeated rows get
    the same answer; a repeated URL trains once. A very long URL takes time in proportion to its length. Of rules of equal length the
    later one by name wins. Other columns play no part. Empty input gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    base = pages.select(F.col(key), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    ruled = base.withColumns({"rule": rule, "ruled": verdict})
    held = F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0
    labelled = ruled.filter("ruled is not null").select("url", (F.col("ruled") == "allow").alias("accepted"))
    model = train(labelled.filter(~held))
    # Scoring makes a row per character, so the few bytes of the URLs are spread over all tasks.
    urls = ruled.filter("url <> ''").select("url").distinct().repartition(parts(pages.sparkSession))
    scores = cut(score(urls.withColumn("same", F.col("url")), model, "same"))
    seen = labelled.filter(held).distinct().join(scores, F.col("url") == F.col("same"))
    limit = threshold(seen.select("score", "accepted"))
    own = F.when(F.col("score") >= limit, F.lit("allow")).otherwise(F.lit("block"))
    columns = (F.col(key), F.col("host"), F.col("path"), F.col("rule"), F.coalesce("ruled", own).alias("verdict"), F.col("score"), F.lit(limit).alias("threshold"))
    # Pages without a URL may be many, and need no score from the table.
    scored = ruled.filter("url <> ''").join(scores, F.col("url") == F.col("same"))
    return scored.select(*columns).unionByName(ruled.filter("url = ''").withColumn("score", F.lit(0.0)).select(*columns))
