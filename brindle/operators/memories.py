"""A store of short memories by scope: (scope, id, text, added)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.values import stems

MOST_CHARS, MOST_PER_SCOPE, PROMPT_CHARS = 500, 200, 4000


def added(store: DataFrame, new: DataFrame) -> DataFrame:
    """New (scope, id, text, added) beside the store; white space collapsed; empty, too long and known texts stay out, case aside."""
    tidy = new.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where(F.length("text").between(1, MOST_CHARS))
    key = F.lower("text")
    first = F.row_number().over(Window.partitionBy("scope", key).orderBy("added", "id"))
    fresh = tidy.withColumn("_first", first).where("_first = 1").drop("_first")
    known = store.select("scope", F.lower("text").alias("_key")).distinct()
    fresh = fresh.withColumn("_key", key).join(known, ["scope", "_key"], "left_anti").drop("_key")
    counts = store.groupBy("scope").agg(F.count("*").alias("_have"))
    place = F.row_number().over(Window.partitionBy("scope").orderBy("added", "id"))
    room = fresh.join(counts, "scope", "left").withColumn("_place", place)
    return store.unionByName(room.where(F.col("_place") + F.coalesce("_have", F.lit(0)) <= MOST_PER_SCOPE).select(*store.columns))


def match_score(text: Column, wanted: Column) -> Column:
    """The share of the wanted word stems that a text has."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(stems(text), stems(wanted))), F.size(stems(wanted))), F.lit(0.0))


def _bits(stems_: Column) -> Column:
    """A bit of 64 for each stem: bits that one set lacks of another one's are at most as many as the stems it lacks."""
    return F.aggregate(stems_, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(x), F.lit(64)).cast("int"))))


def _candidates(asked: DataFrame, held: DataFrame, least: Column) -> DataFrame:
    """(request, id, score) of all memories that share `least` stems with a request, and perhaps of others. Of n stems, one of the
    n - least + 1 rarest is among those shared: memories are looked up by these only; bits leave out most of what doesn't share enough."""
    postings = held.select("scope", "id", _bits(F.col("own")).alias("bits"), F.explode("own").alias("stem"))
    n = F.size("wanted")
    looked_up = asked.select("request", "scope", (n - least).alias("lacking"), _bits(F.col("wanted")).alias("asked"), F.explode(F.slice("wanted", F.lit(1), n - least + 1)).alias("stem"))
    lacks = F.bit_count(F.col("asked").bitwiseAND(F.bitwise_not("bits")))
    pairs = looked_up.join(postings, ["scope", "stem"]).where(lacks <= F.col("lacking")).select("request", "scope", "id").distinct()
    both = pairs.join(asked.select("request", "wanted"), "request").join(held, ["scope", "id"])
    return both.select("request", "id", (F.size(F.array_intersect("wanted", "own")) / F.size("wanted")).alias("score"))


def forgetting(store: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (request, scope, wanted) to (request, decision, id): remove, ask (several fit as well), or none.

    The best match goes unless another is within 0.15 while it has under 0.75, two are equal, or it has under 0.5 and isn't the only one.
    What is asked decides how far is searched: memories with all stems settle a request (by its rarest stem); else what has 0.35 of them
    and more decides from a best score of 0.5 on; below, it counts only whether more than one memory shares any stem.
    """
    held = store.select("scope", "id", stems(F.col("text")).alias("own")).groupBy("scope", "id").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("own"))
    common = held.select("scope", "id", F.explode("own").alias("stem")).groupBy("scope", "stem").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    words = requests.select("request", "scope", F.explode(stems(F.col("wanted"))).alias("stem")).join(common, ["scope", "stem"], "left")
    by_rarity = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "stem")))
    asked = words.groupBy("request", "scope").agg(F.transform(by_rarity, lambda x: x["stem"]).alias("wanted"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    whole = _candidates(asked, held, F.size("wanted")).where("score = 1").groupBy("request").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    rest = asked.join(whole, "request", "left_anti")
    order = Window.partitionBy("request").orderBy(F.desc("score"), "id")
    scored = _candidates(rest, held, F.ceil(F.size("wanted") * 0.349).cast("int"))
    best = scored.withColumns({"place": F.row_number().over(order), "rival": F.lead("score").over(order)}).where("place = 1 AND score >= 0.5").drop("place")
    close = (F.col("rival") == F.col("score")) | ((F.col("rival") >= F.col("score") - 0.15) & (F.col("score") < 0.75))
    unsure = F.when(F.col("score").isNotNull(), F.coalesce(close, F.lit(False))).otherwise(F.col("lo") < F.col("hi"))
    others = rest.where("lo IS NOT NULL").join(best, "request", "left").select("request", unsure.alias("unsure"), F.coalesce("id", "lo").alias("id"))
    found = whole.select("request", (F.col("n") > 1).alias("unsure"), "id").unionByName(others)
    decided = found.select("request", F.when(F.col("unsure"), "ask").otherwise("remove").alias("decision"), F.when(~F.col("unsure"), F.col("id")).alias("id"))
    return requests.select("request").join(decided, "request", "left").select("request", F.coalesce("decision", F.lit("none")).alias("decision"), "id")


def prompt_lines(store: DataFrame, most_chars: int = PROMPT_CHARS) -> DataFrame:
    """Per scope the newest memories that fit, oldest first, as one text."""
    back = Window.partitionBy("scope").orderBy(F.desc("added"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    kept = store.withColumn("_used", F.sum(F.length("text") + 3).over(back)).where(F.col("_used") - 1 <= most_chars)  # the last line has no line end
    lines = F.array_sort(F.collect_list(F.struct("added", "id", "text")))
    return kept.groupBy("scope").agg(F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x["text"])), "\n").alias("lines"))


def switches(defaults: dict[str, bool], given: Column) -> Column:
    """A map of switches: defaults, with what is given for known names."""
    base = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.lit(v))])
    known = F.map_filter(given, lambda k, v: F.map_contains_key(base, k) & v.isNotNull())
    return F.transform_values(base, lambda k, v: F.coalesce(F.try_element_at(known, k), v))
