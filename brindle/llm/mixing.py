"""Mixing sources to target weights (operator 8): temperature mixing, realised as budgeted block permutations.

The share p of a source's tokens becomes the weight p^a / sum(p^a). The exponent a in [0, 1] is bisected (in many sections at once, so
that a handful of small jobs settle it) until the weights meet a target entropy or a limit on how often a source repeats. Weights times
the budget give each source its quota. A source's documents lie in blocks, by hash: at least BLOCKS, and as many more as keep a block at
BLOCK_TOKENS, so that a block never outgrows a task. Each pass over a source is a permutation of its blocks, whole passes come first, and
in the last one blocks follow in their order until the quota is met. In the block where it is met, documents follow in an order of
their own, by hash, as far as they fit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.base import cut, few, fresh

BLOCKS = 256
BLOCK_TOKENS = 1 << 24
SECTIONS = 32
STEPS = 6


@dataclass
class Mixture:
    """weights: (source, tokens, share, weight, quota, blocks), one row per source; exponent; budget in tokens; tokens there are."""

    weights: DataFrame
    exponent: float
    budget: float
    total: float


def token_count(text: F.Column) -> F.Column:
    """White-space separated tokens; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(id_col: str, text_col: str) -> F.Column:
    """What deals a document to its block and orders it there: id and text, so that rows without an id are apart."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def slim_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, key, tokens); a null source counts as one source named ''."""
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), _key(id_col, text_col).alias("key"), token_count(F.col(text_col)).alias("tokens"))


def placed(rows: DataFrame, mix: Mixture, source: str = "source", key: str = "key", block: str = "block", seed: int = 17) -> DataFrame:
    """rows, which have a source and a key, with their block."""
    own, n = fresh(rows, "own_source", "n_blocks")
    sizes = few(mix.weights.select(F.col("source").alias(own), F.col("blocks").alias(n)))
    met = rows.join(sizes, F.col(source) == F.col(own))
    return met.withColumn(block, F.pmod(F.xxhash64(key, F.lit(seed)), F.col(n))).drop(own, n)


def _turn(key: F.Column, epoch: F.Column, seed: int) -> F.Column:
    """Place of a document in the order of its block, in one epoch."""
    return F.xxhash64(key, epoch, F.lit(seed + 1))


def _figures(sources: DataFrame, low: float, high: float) -> list:
    """(exponent, entropy of the weights, largest and smallest weight / share) at SECTIONS + 1 exponents, in one aggregation."""
    step = (high - low) / SECTIONS
    tried = sources.filter("share > 0").withColumn("a", F.explode(F.array(*[F.lit(low + step * i) for i in range(SECTIONS + 1)])))
    power, ratio = F.pow("share", "a"), F.pow("share", F.col("a") - 1)
    sums = tried.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("s"), F.max(ratio).alias("most"), F.min(ratio).alias("least"))
    return sorted(tuple(r) for r in sums.select("a", F.log("z") - F.col("a") * F.col("s") / F.col("z"), F.col("most") / F.col("z"), F.col("least") / F.col("z")).collect())


def _edge(sources: DataFrame, holds, below: bool) -> float:
    """Where a condition on (entropy, largest ratio, smallest ratio) ends that holds for all exponents below it, or begins; in [0, 1]."""
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        rows = _figures(sources, low, high)
        good = [a for a, *figures in rows if holds(*figures)]
        if not good:
            return 0.0 if below else 1.0
        points = [a for a, *_ in rows]
        if below:
            low = good[-1]
            if low == points[-1]:
                return low
            high = points[points.index(low) + 1]
        else:
            high = good[0]
            if high == points[0]:
                return high
            low = points[points.index(high) - 1]
    return low if below else high


def mixture(slim: DataFrame, budget: float | None = None, target_entropy: float | None = None, repetition_limit: float | None = None) -> Mixture:
    """Exponent and quotas for the rows of slim_rows().

    A target entropy (in nats) asks for the steepest weights that reach it, a repetition limit for the flattest that keep to it; with
    both, the steeper of the two. Where no exponent in [0, 1] will do, the nearest end is taken. Without a budget, the budget is the
    least that passes over every source at least once. A source without tokens has no weight and no quota.
    """
    if target_entropy is None and repetition_limit is None:
        raise ValueError("a target entropy or a repetition limit is needed")
    sources = cut(slim.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    sources = sources.withColumn("share", F.col("tokens") / F.lit(float(total or 1)))
    exponents = []
    if target_entropy is not None:
        exponents.append(_edge(sources, lambda h, most, least: h >= target_entropy, below=True))
    if repetition_limit is not None:
        per_pass = None if budget is None else budget / (total or 1)
        exponents.append(_edge(sources, lambda h, most, least: (most / least if per_pass is None else most * per_pass) <= repetition_limit, below=False))
    a = max(exponents)
    z, least = sources.filter("share > 0").agg(F.sum(F.pow("share", F.lit(a))), F.min(F.pow("share", F.lit(a - 1)))).first()
    if budget is None:
        budget = total * z / least if z else 0.0
    weight = F.when(F.col("share") > 0, F.pow("share", F.lit(a)) / F.lit(z or 1.0)).otherwise(0.0)
    blocks = F.greatest(F.lit(BLOCKS), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("long")
    weights = sources.withColumns({"weight": weight, "blocks": blocks}).withColumn("quota", F.round(F.col("weight") * F.lit(float(budget))).cast("long"))
    return Mixture(weights, a, budget, total)


def draws(slim: DataFrame, mix: Mixture, seed: int = 17) -> DataFrame:
    """(source, block, epoch, block_rank, last_turn): the blocks of each pass in their order, for placed rows.

    last_turn is null where the whole block is drawn, else the documents up to that turn are. So a source gets its quota, less
    at most what the next document would have had too much.
    """
    passes = F.when(F.col("source_tokens") > 0, F.floor(F.col("quota") / F.col("source_tokens"))).otherwise(0).cast("int")
    quotas = mix.weights.select("source", F.col("tokens").alias("source_tokens"), "quota").withColumn("passes", passes)
    quotas = quotas.withColumn("rest", F.col("quota") - F.col("passes") * F.col("source_tokens")).filter("quota > 0")
    epochs = quotas.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    blocks = slim.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"))
    turn = Window.partitionBy("source", "epoch").orderBy(F.xxhash64("source", "block", "epoch", F.lit(seed + 2)), "block")  # a row per block
    ordered = blocks.join(epochs, "source").withColumns({"block_rank": F.row_number().over(turn), "before": F.sum("block_tokens").over(turn) - F.col("block_tokens")})
    whole = (F.col("epoch") < F.col("passes")) | (F.col("before") + F.col("block_tokens") <= F.col("rest"))
    taken = ordered.filter(whole | (F.col("before") < F.col("rest"))).select("source", "block", "epoch", "block_rank", F.when(~whole, F.col("rest") - F.col("before")).alias("need"))
    taken = cut(taken)
    partly = slim.join(few(taken.filter("need is not null").select("source", "block", "epoch", "need")), ["source", "block"])
    partly = partly.withColumn("turn", _turn(F.col("key"), F.col("epoch"), seed))
    order = Window.partitionBy("source", "block", "epoch").orderBy("turn")
    last = partly.withColumn("sofar", F.sum("tokens").over(order)).filter("sofar <= need").groupBy("source", "block", "epoch").agg(F.max("turn").alias("last_turn"))
    return cut(taken.join(last, ["source", "block", "epoch"], "left").filter("need is null or last_turn is not null").drop("need"))


def mix_all(docs: DataFrame, budget: float | None = None, target_entropy: float | None = None, repetition_limit: float | None = 1.5, seed: int = 17) -> DataFrame:
    """One row per draw: doc_id, source, epoch, block, block_rank, n_tokens, weight, exponent.

    A null text has no tokens, a null source is the source ''. Rows that share id and text are drawn together, and of rows with equal
    turns (the same key) all or none. Texts of any length count whole. Other columns play no part. Empty input gives no rows.
    """
    slim = cut(slim_rows(docs))
    mix = mixture(slim, budget, target_entropy, repetition_limit)
    slim = placed(slim, mix, seed=seed)
    met = slim.join(few(draws(slim, mix, seed)), ["source", "block"]).join(few(mix.weights.select("source", "weight")), "source")
    met = met.filter(F.col("last_turn").isNull() | (_turn(F.col("key"), F.col("epoch"), seed) <= F.col("last_turn")))
    return met.select("doc_id", "source", "epoch", "block", "block_rank", F.col("tokens").alias("n_tokens"), "weight", F.lit(mix.exponent).alias("exponent"))


def resample(docs: DataFrame, budget: float | None = None, target_entropy: float | None = None, repetition_limit: float | None = 1.5, seed: int = 17) -> DataFrame:
    """The documents of the mixture with all their columns, whatever their names: one row per draw. Cases as in mix_all().

    The table of draws has a row per block and pass; up to a checked size it is broadcast and no text is shuffled.
    """
    slim = cut(slim_rows(docs))
    mix = mixture(slim, budget, target_entropy, repetition_limit)
    drawn = draws(placed(slim, mix, seed=seed), mix, seed)
    own_source, key, block, source, number, epoch, last = fresh(docs, "own_source", "key", "block", "draw_source", "draw_block", "draw_epoch", "draw_last")
    marked = docs.withColumns({own_source: F.coalesce(F.col("source").cast("string"), F.lit("")), key: _key("doc_id", "text")})
    marked = placed(marked, mix, own_source, key, block, seed)
    places = few(drawn.select(F.col("source").alias(source), F.col("block").alias(number), F.col("epoch").alias(epoch), F.col("last_turn").alias(last)))
    met = marked.join(places, (F.col(own_source) == F.col(source)) & (F.col(block) == F.col(number)))
    return met.filter(F.col(last).isNull() | (_turn(F.col(key), F.col(epoch), seed) <= F.col(last))).select(*docs.columns)
