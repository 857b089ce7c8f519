"""Best-fit packing (operator 4): a grouping genetic algorithm on islands packs document pieces into sequences of fixed length.

Documents longer than a sequence are cut; their full pieces fill sequences of their own. The shorter pieces are dealt by hash to
shards of a few thousand, and each shard is packed by several islands that run in different tasks. A chromosome is a grouping: a list
of bins. Crossover injects whole well-filled bins of one parent into the other, removes the bins that hold a piece twice, and
best-fits the displaced pieces. After an epoch each island keeps its people and sends its elite to the next one of its shard; the best
of a shard's islands wins. No island ends before a whole epoch of crossover, whether or not its first packing meets the lower bound, as
fewer bins are not all there is to win: of packings with equal bins the one with the more uneven fills wins, which leaves its room in few
bins. What is left in poorly filled bins of all shards is packed once more, so that a shard's last bins don't stay half empty.
"""

from __future__ import annotations

import random
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.base import cut, release, slices, texts_of
from brindle.llm.tokens import SLICE, default_path, token_ids

CAPACITY = 2048
SHARD = 4000
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 6
POPULATION = 4
#: Bins filled less than this are opened for the last round.
POOR = 0.97


# --- one shard ---------------------------------------------------------------


class Bins:
    """Bins under construction, found by the least room that is enough: best fit in constant time for whole lengths."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room, self.mask = capacity, [[] for _ in range(capacity + 1)], 0

    def add(self, room: int, items: list[int]) -> None:
        self.by_room[room].append(items)
        self.mask |= 1 << room

    def best_fit(self, item: int, length: int) -> None:
        enough = self.mask >> length
        if enough:
            room = length + (enough & -enough).bit_length() - 1
            items = self.by_room[room].pop()
            if not self.by_room[room]:
                self.mask &= ~(1 << room)
            items.append(item)
        else:
            room, items = self.capacity, [item]
        self.add(room - length, items)

    def groups(self) -> list[list[int]]:
        return [items for stack in self.by_room for items in stack]


def least_bins(lengths: list[int], capacity: int) -> int:
    """A lower bound (Martello and Toth's L2): no packing of these lengths has fewer bins."""
    if not len(lengths):
        return 0
    x = np.sort(np.asarray(lengths, np.int64))
    total, best = np.append(0, np.cumsum(x)), 0
    for k in np.append(0, np.unique(x[x <= capacity // 2])):
        large, half, small = (np.searchsorted(x, v, side="right") for v in (capacity - k, capacity // 2, k - 1))
        free = (large - half) * capacity - (total[large] - total[half])
        rest = total[half] - total[small]
        best = max(best, len(x) - half + max(0, -(-(rest - free) // capacity)))
    return int(best)


def fitness(groups: list[list[int]], lengths: list[int], capacity: int) -> float:
    """Falkenauer's: the mean squared fill; more when bins are fewer, and when their fills are uneven."""
    return sum((sum(map(lengths.__getitem__, g)) / capacity) ** 2 for g in groups) / max(1, len(groups))


def _rank(groups, lengths, capacity):
    return (len(groups), -fitness(groups, lengths, capacity))


def first_packing(order: list[int], lengths: list[int], capacity: int) -> list[list[int]]:
    bins = Bins(capacity)
    for i in order:
        bins.best_fit(i, lengths[i])
    return bins.groups()


def _rebuild(kept: list[list[int]], displaced: list[int], lengths: list[int], capacity: int) -> list[list[int]]:
    bins = Bins(capacity)
    for g in kept:
        bins.add(capacity - sum(map(lengths.__getitem__, g)), list(g))
    for i in sorted(displaced, key=lambda i: (-lengths[i], i)):
        bins.best_fit(i, lengths[i])
    return bins.groups()


def crossover(mother: list[list[int]], father: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Inject a random half of the father's well-filled bins whole, drop the mother's bins that share a piece, best-fit the rest."""
    full = [g for g in father if sum(map(lengths.__getitem__, g)) >= 0.99 * capacity]
    injected = [g for g in full if rng.random() < 0.5]
    inside = {i for g in injected for i in g}
    kept, displaced = list(injected), []
    for g in mother:
        if inside.isdisjoint(g):
            kept.append(g)
        else:
            displaced += [i for i in g if i not in inside]
    return _rebuild(kept, displaced, lengths, capacity)


def mutate(groups: list[list[int]], lengths: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Open the emptiest bins and a few others, and best-fit their pieces again."""
    by_fill = sorted(groups, key=lambda g: sum(map(lengths.__getitem__, g)))
    opened = min(len(groups), max(2, len(groups) // 50))
    some = set(range(opened)) | {rng.randrange(len(groups)) for _ in range(opened)}
    return _rebuild([g for j, g in enumerate(by_fill) if j not in some], [i for j in some for i in by_fill[j]], lengths, capacity)


@dataclass
class Epoch:
    """people: groupings, the best first; crossovers: children that crossover made; met: whether the best reaches the lower bound, least;
    first: bins of the packing by falling length, if the epoch began with it."""

    people: list[list[list[int]]]
    crossovers: int
    met: bool
    least: int
    first: int | None


def first_people(lengths: list[int], capacity: int, rng: random.Random, size: int = POPULATION) -> list[list[list[int]]]:
    """Best fit by falling length, and by lengths that are off by up to a fifth."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    noisy = lambda: sorted(order, key=lambda i: -lengths[i] * rng.uniform(0.8, 1.0))
    return [first_packing(noisy() if k else order, lengths, capacity) for k in range(size)]


def evolve(lengths: list[int], capacity: int, seed: int, start: list[list[list[int]]] = (), generations: int = GENERATIONS) -> Epoch:
    """One epoch of one island. Each generation crosses two parents both ways and opens bins of the best; the worst of all leave."""
    rng = random.Random(seed)
    if len(lengths) < 2:
        return Epoch([[[0]]] if lengths else [[]], 0, True, len(lengths), len(lengths))
    people = [*start, *first_people(lengths, capacity, rng, max(0, POPULATION - len(start)))]
    first, least = None if start else len(people[0]), least_bins(lengths, capacity)
    ranked, crossovers = sorted(((_rank(p, lengths, capacity), k, p) for k, p in enumerate(people)), key=lambda x: x[:2]), 0
    for g in range(generations):
        a, b = sorted(rng.sample(range(len(ranked)), 2))
        better, worse = ranked[a][2], ranked[b][2]
        children = [crossover(worse, better, lengths, capacity, rng), crossover(better, worse, lengths, capacity, rng), mutate(ranked[0][2], lengths, capacity, rng)]
        crossovers += 2
        ranked += [(_rank(child, lengths, capacity), len(people) + 3 * g + k, child) for k, child in enumerate(children)]
        ranked = sorted(ranked, key=lambda x: x[:2])[:POPULATION]
    return Epoch([p for *_, p in ranked], crossovers, ranked[0][0][0] == least, least, first)


# --- shards and islands ------------------------------------------------------


def _coded(groups: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, "<u4")
    for k, g in enumerate(groups):
        out[g] = k
    return out.tobytes()


def _groups(data: bytes) -> list[list[int]]:
    of = np.frombuffer(data, "<u4")
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)] if len(of) else []


ISLAND = "shard int, island int, people array<binary>, bins int, fitness double, items int, first_bins int, least int, crossovers int"


def islands(items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD, seed: int = 7, epochs: int = EPOCHS, generations: int = GENERATIONS) -> tuple[DataFrame, DataFrame]:
    """Tables of the shards (shard, items, lengths) and of their islands after the last epoch.

    An island has its people, the best first, and tells how it came there: bins, fitness, the number of pieces, first_bins (of the best
    packing it began with), least (no packing has fewer) and crossovers.
    """
    spark = items.sparkSession
    shards = max(1, round(items.count() / shard_items))
    dealt = items.select(F.col("item").cast("long").alias("item"), F.col("length").cast("int").alias("length"), F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(shards)).cast("int").alias("shard"))

    def gather(group: pa.Table) -> pa.Table:
        length, item = group["length"].to_numpy(), group["item"].to_numpy()
        order = np.lexsort((item, -length))
        return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int32()), "items": [item[order].astype("<i8").tobytes()], "lengths": [length[order].astype("<u4").tobytes()]})

    tables = cut(dealt.groupBy("shard").applyInArrow(gather, "shard int, items binary, lengths binary"))

    def island(batches):
        for batch in batches:
            for shard, number, lengths, own, come, first, done in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                sizes = np.frombuffer(lengths, "<u4").tolist()
                start = [_groups(x) for x in [*(own or []), *([come] if come is not None else [])]]
                epoch = evolve(sizes, capacity, hash((shard, number, done)), start, generations)
                best = epoch.people[0]
                figures = (len(best), fitness(best, sizes, capacity), len(sizes), epoch.first if first is None else first, epoch.least, done + epoch.crossovers)
                columns = [[shard], [number], [[_coded(p, len(sizes)) for p in epoch.people]], *([x] for x in figures)]
                kinds = (pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.int32(), pa.float64(), *[pa.int32()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in ISLAND.split(", ")])

    all_islands = tables.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lengths")
    n_tasks = max(1, min(shards * ISLANDS, 4 * spark.sparkContext.defaultParallelism + shards // 8))
    run = lambda df: cut(df.select("shard", "island", "lengths", "own", "come", "first", "done").repartition(n_tasks, "shard", "island").mapInArrow(island, ISLAND))
    none = {"own": F.lit(None).cast("array<binary>"), "come": F.lit(None).cast("binary"), "first": F.lit(None).cast("int"), "done": F.lit(0)}
    found = run(all_islands.withColumns(none))
    for _ in range(epochs - 1):
        moved = found.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.get("people", F.lit(0)).alias("come"))
        own = found.select("shard", "island", F.col("people").alias("own"), F.col("first_bins").alias("first"), F.col("crossovers").alias("done"))
        found = run(all_islands.join(own, ["shard", "island"]).join(moved, ["shard", "island"]))
    return tables, found


def report(found: DataFrame) -> DataFrame:
    """(shard, pieces, first_bins, bins, least, met, crossovers) of the best island of each shard; crossovers of all of them."""
    best = F.min_by(F.struct("bins", "items", "first_bins", "least"), F.struct("bins", -F.col("fitness"), "island"))
    by_shard = found.groupBy("shard").agg(best.alias("x"), F.sum("crossovers").alias("crossovers"))
    return by_shard.select("shard", F.col("x.items").alias("pieces"), "x.first_bins", "x.bins", "x.least", (F.col("x.bins") == F.col("x.least")).alias("met"), "crossovers")


def pack_lengths(items: DataFrame, capacity: int = CAPACITY, shard_items: int = SHARD, seed: int = 7) -> DataFrame:
    """items (item long, unique; length, 1 to capacity) to (item, length, shard, bin, fill, offset): a bin of a shard, its fill, the item's place in it."""
    tables, found = islands(items, capacity, shard_items, seed)
    best = found.groupBy("shard").agg(F.min_by(F.get("people", F.lit(0)), F.struct("bins", -F.col("fitness"), "island")).alias("elite"))

    def place(batches):
        for batch in batches:
            for shard, items, lengths, elite in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                of, sizes = np.frombuffer(elite, "<u4"), np.frombuffer(lengths, "<u4").astype(np.int64)
                order = np.argsort(of, kind="stable")
                of, sizes, item = of[order], sizes[order], np.frombuffer(items, "<i8")[order]
                fill = np.bincount(of, weights=sizes).astype(np.int64)
                offset = np.cumsum(sizes) - sizes - (np.cumsum(fill) - fill)[of]
                columns = (pa.array(item), pa.array(sizes, pa.int32()), pa.array(np.full(len(of), shard), pa.int32()), pa.array(of, pa.int32()), pa.array(fill[of], pa.int32()), pa.array(offset, pa.int64()))
                yield pa.RecordBatch.from_arrays([*columns], ["item", "length", "shard", "bin", "fill", "offset"])

    return tables.join(best, "shard").select("shard", "items", "lengths", "elite").mapInArrow(place, "item long, length int, shard int, bin int, fill int, offset long")


# --- documents ---------------------------------------------------------------


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", at_once: int = SLICE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document: longer ones are cut so that only the first piece may be shorter.

    at_once: bytes of text that a task encodes together; fewer take less memory and more time, and the result is the same.
    """
    vocabulary = tokenizer or default_path()

    @F.arrow_udf("array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>")
    def cut_up(texts: pa.Array) -> pa.Array:
        texts, rows, sizes = texts_of(texts), [], []
        for a, b in slices(texts, at_once):
            ids, lengths = token_ids(texts.slice(a, b - a), vocabulary)
            ids, at = ids.astype("<u4"), 0
            for n in lengths.tolist():
                ends = [*range(n % capacity or capacity, n, capacity), n]
                starts = [0, *ends[:-1]]
                rows += [(k, s, e - s, zlib.crc32(ids[at + s : at + e])) for k, (s, e) in enumerate(zip(starts, ends, strict=True))]
                sizes.append(len(ends))
                at += n
        columns = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        struct = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["piece", "start", "length", "ids_crc32"])
        release()
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), struct)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.inline(cut_up(F.col(text_col))))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", at_once: int = SLICE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document is packed whole (a null text is the end id alone), repeated rows as often as they occur, and null ids like others.
    Very long texts are cut into as many pieces as they need. Pieces of equal length take their places by number. Other columns play no
    part. Empty input gives no rows. at_once is that of pieces().
    """
    found = cut(pieces(docs, capacity, tokenizer, id_col, text_col, at_once).withColumn("item", F.monotonically_increasing_id()))
    packed = cut(pack_lengths(found.filter(F.col("length") < capacity).select("item", "length"), capacity))
    poor = F.col("fill") < POOR * capacity
    again = pack_lengths(packed.filter(poor).select("item", "length"), capacity, seed=11)
    # Names of bins: full pieces, bins of the first round and bins of the last round count in different residues.
    name = lambda kind: (F.col("shard").cast("long") * (1 << 20) + F.col("bin")) * 3 + kind
    bins = packed.filter(~poor).select("item", name(0).alias("sequence_id"), "offset").unionByName(again.select("item", name(1).alias("sequence_id"), "offset"))
    full = found.filter(F.col("length") == capacity).select("*", (F.col("item") * 3 + 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = found.filter(F.col("length") < capacity).join(bins, "item")
    columns = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    return full.select(*columns).unionByName(short.select(*columns))
