"""Texts whose 5-word shingles have a Jaccard similarity of at least LEAST, for the near-dedup stage of the pipeline.

Candidates come from operator 7 (SimHash of the 5-word shingles, positional index, count filter) and, since that index is guaranteed for
3 differing bits only, from MinHash as well: texts of a similarity of 0.8 differ in 9.7 of 64 bits on average and share about 2 of 8
bytes. 20 bands of 5 values hold one that two texts of similarity 0.8 share with a probability of 0.9996. Either kind of candidate only
gathers clusters, by edges that grow with the texts and not with their pairs: in a band's list each text looks at those that nothing
has reached yet, and what the 100 values say may be similar is reached.

Within a cluster links are verified by the exact similarity of the sets of shingle hashes, each set sent once. A large cluster is dealt to
blocks. The cluster's first text goes to all of them, so nearly all of a group of copies links in the first pass; then the texts outside
the cluster's largest component, and only these, meet the other blocks. Each pass emits a tree of the links and not all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.base import cut, few, keep_first, mix, parts, slices, spread, sums, texts_of, tidy
from brindle.llm.components import components
from brindle.llm.minhash import shingle_hashes
from brindle.llm.simhash import BLOCK, fingerprints, links, sha_of

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 20, 5
#: Estimated similarity, of a standard error of 0.04, from which a pair may be similar.
MAYBE = 0.66
#: Texts of one cluster that meet in one task.
TOGETHER = 1024
#: Bytes of text that a task works on at once, and rows of the index that it holds besides a list that reaches further.
SLICE = 1 << 20
HELD = 1 << 15
#: Rows of a batch that become Python objects at once.
ROWS_AT_ONCE = 256

_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def signatures(texts: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """Least hash of each text's shingles under each of the 100 functions, [texts, 100]; the largest number without words."""
    out = np.full((len(texts), len(_FACTORS)), np.uint64(0xFFFFFFFFFFFFFFFF))
    for a, b in slices(texts, SLICE):
        hashes, n = shingle_hashes(texts.slice(a, b - a), size)
        full = np.flatnonzero(n)
        starts = (np.cumsum(n) - n)[full]
        for k, factor in enumerate(_FACTORS):
            if len(full):
                out[a + full, k] = np.minimum.reduceat(hashes * factor, starts)
    return out


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """(node, signature, bands, fingerprint) of (node, text): 16 bits of each value, a key for each band, and the SimHash."""

    def sign(batches):
        for batch in batches:
            values = signatures(texts_of(batch.column(1)), size)
            keys = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(values), axis=0)
            for r in range(ROWS):
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, r::ROWS])
            short = mix(values).astype("<u2")
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).reshape(-1)))
            prints = pa.array(fingerprints(batch.column(1), size))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in short], pa.binary()), bands, prints], ["node", "signature", "bands", "fingerprint"])

    return docs.select("node", "text").mapInArrow(tidy(sign), "node long, signature binary, bands array<long>, fingerprint long")


def _tree(nodes: np.ndarray, values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what may be similar within a list, without all its pairs."""
    edges, left = [], np.arange(len(nodes))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            reached = (values[left] == values[x]).mean(axis=1) >= MAYBE
            hit = left[reached]
            edges.append((np.full(len(hit), nodes[x]), nodes[hit]))
            queue.extend(hit)
            left = left[~reached]
    return edges


def candidates(signed: DataFrame) -> DataFrame:
    """(a, b): edges between nodes of (node, signature, bands) that connect all that may be similar and share a band."""
    index = signed.select("node", F.explode("bands").alias("key"))
    lists = index.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    others = F.filter(F.sequence(F.lit(0), blocks - 1), lambda j: (blocks == 1) | (j != own))
    cells = index.join(lists, "key").select("node", "key", own.alias("own"), F.explode(others).alias("other"))
    cells = cells.select("node", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))
    dealt = cells.join(signed.select("node", "signature"), "node").select("node", "cell", "signature")
    dealt = dealt.repartition(parts(signed.sparkSession), "cell").sortWithinPartitions("cell", "node")

    def find(batches):
        nodes, group, values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, BANDS * ROWS), "<u2")

        def out(n):
            first = [*np.flatnonzero(np.append(True, group[1:n] != group[: n - 1])), n]
            found = [p for a, b in zip(first[:-1], first[1:], strict=True) if b - a > 1 for p in _tree(nodes[a:b], values[a:b])]
            pairs = np.concatenate([np.zeros((0, 2), np.int64), *(np.column_stack(p) for p in found)])
            pairs = np.unique(np.sort(pairs, axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 1]), pa.array(pairs[:, 0])], ["a", "b"])

        for batch in batches:
            nodes = np.concatenate((nodes, batch.column(0).to_numpy(zero_copy_only=False)))
            group = np.concatenate((group, batch.column(1).to_numpy(zero_copy_only=False)))
            values = np.concatenate((values, np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(-1, BANDS * ROWS)))
            if len(group) >= HELD and group[0] != group[-1]:
                whole = int(np.flatnonzero(group != group[-1])[-1]) + 1  # the last list may go on
                yield out(whole)
                nodes, group, values = nodes[whole:], group[whole:], values[whole:]
        if len(group):
            yield out(len(group))

    return dealt.mapInArrow(tidy(find), "a long, b long").distinct()


def linked_prints(signed: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes of (node, fingerprint) that operator 7 links: each with the least node of its fingerprint, and these by the index."""
    least = cut(signed.groupBy("fingerprint").agg(F.min("node").alias("least")))
    same = signed.join(least, "fingerprint").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    x, y = (least.select(F.col("fingerprint").alias(c), F.col("least").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    near = links(least.select("fingerprint")).join(x, "a").join(y, "b")
    return same.unionByName(near.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")))


class Sets:
    """The texts of one cell: nodes, signatures, and sets of shingle hashes, one after another."""

    def __init__(self, nodes: list[int], late: list[bool], signatures: list[bytes], sets: list[bytes]):
        order = np.argsort(~np.array(late), kind="stable")  # late ones first
        self.nodes, self.n_late = np.array(nodes, np.int64)[order], int(np.sum(late))
        self.values = np.frombuffer(b"".join(signatures[i] for i in order), "<u2").reshape(-1, BANDS * ROWS)
        self.length = np.array([len(sets[i]) // 8 for i in order])
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(sets[i] for i in order), "<u8")

    def similar(self, x: int, some: np.ndarray, least: float) -> np.ndarray:
        """Which of some are similar to x; two texts without words are. What the signatures rule out is not compared."""
        out = (self.values[some] == self.values[x]).mean(axis=1) >= MAYBE
        near, own = some[out], self.flat[self.start[x] : self.start[x] + self.length[x]]
        n = self.length[near]
        found = self.flat[spread(self.start[near], n)]
        both = sums(own[np.minimum(np.searchsorted(own, found), len(own) - 1)] == found, n) if len(own) else np.zeros(len(near), np.int64)
        out[out] = both >= least * np.maximum(len(own) + n - both, 1e-9)
        if not len(own):
            out[self.length[some] == 0] = True
        return out

    def tree(self, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Edges that connect all similar pairs, but for pairs of which neither is late if any is."""
        edges, left, stop = [], np.arange(len(self.nodes)), self.n_late or len(self.nodes)
        while len(left) and left[0] < stop:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                reached = self.similar(x, left, least)
                edges.append((np.full(int(reached.sum()), self.nodes[x]), self.nodes[left[reached]]))
                queue.extend(left[reached])
                left = left[~reached]
        return edges


def _verified(cells: DataFrame, least: float) -> DataFrame:
    """(a, b): edges that connect the similar texts of each cell of (cell, node, late, signature, shingles)."""
    dealt = cells.select("cell", "node", "late", "signature", "shingles").repartition(parts(cells.sparkSession), "cell").sortWithinPartitions("cell")

    def find(batches):
        cell, held = None, []

        def out():
            edges = Sets(*map(list, zip(*held, strict=True))).tree(least) if len(held) > 1 else []
            pairs = np.concatenate([np.zeros((0, 2), np.int64), *(np.column_stack(e) for e in edges)])
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                some = batch.slice(at, ROWS_AT_ONCE)
                for own, *row in zip(*(some.column(i).to_pylist() for i in range(5)), strict=True):
                    if own != cell and held:
                        yield out()
                        held = []
                    cell = own
                    held.append(row)
        if held:
            yield out()

    return dealt.mapInArrow(tidy(find), "a long, b long")


def similar_pairs(docs: DataFrame, size: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(a, b): edges that connect the nodes of (node, text) whose shingles have at least that Jaccard similarity."""
    signed = cut(_signed(docs, size).dropDuplicates(["node"]))
    clusters = cut(components(candidates(signed).unionByName(linked_prints(signed))).withColumnRenamed("label", "cluster"))

    def sets(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            for a, b in slices(texts, SLICE):
                hashes, n = shingle_hashes(texts.slice(a, b - a), size)
                own = [np.unique(x).astype("<u8").tobytes() for x in np.split(hashes, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(own, pa.binary())], ["node", "shingles"])

    met = docs.select("node", "text").join(few(clusters), "node", "left_semi")
    shingles = met.mapInArrow(tidy(sets), "node long, shingles binary").dropDuplicates(["node"])
    n = cut(clusters.groupBy("cluster").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("blocks")))
    members = shingles.join(signed.select("node", "signature"), "node").join(clusters, "node").join(few(n), "cluster")
    members = cut(members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    # The cluster's first text is its label.
    to = F.when(F.col("node") == F.col("cluster"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    cells = members.withColumn("block", F.explode(to)).withColumns({"cell": F.xxhash64("cluster", "block"), "late": F.lit(False)})
    edges = cut(_verified(cells, least))
    large = members.filter("blocks > 1")
    if large.isEmpty():
        return edges
    linked = components(edges).select(F.col("node").alias("linked"), "label")
    labelled = cut(large.select("node", "cluster", "block", "blocks").join(linked, F.col("node") == F.col("linked"), "left").withColumn("label", F.coalesce("label", "node")))
    largest = cut(labelled.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("largest")))
    late = labelled.join(few(largest), "cluster").filter("label <> largest").select("node", "cluster", "block", "blocks")
    chunks = few(cut(late.groupBy("cluster").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("chunks"))))
    late = cut(late.join(chunks, "cluster").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int")))
    # Each chunk of late texts meets every block; rows are the cluster's, times the chunks.
    mine = late.select("node", F.col("cluster").alias("of"), F.col("block").alias("own"), "chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"))
    cell = lambda cluster, chunk, block: F.xxhash64(cluster, chunk, block, F.lit(2)).alias("cell")
    first = mine.join(large.select("node", "signature", "shingles"), "node").select(cell("of", "chunk", "to"), "node", F.lit(True).alias("late"), "signature", "shingles")
    chunk = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    others = large.join(chunks, "cluster").join(late.select(F.col("node").alias("x"), F.col("chunk").alias("y")), F.col("node") == F.col("x"), "left")
    others = others.select("cluster", "block", "node", "signature", "shingles", "y", chunk.alias("chunk")).filter("y is null or y <> chunk")
    others = others.select(cell("cluster", "chunk", "block"), "node", F.lit(False).alias("late"), "signature", "shingles")
    return edges.unionByName(cut(_verified(first.unionByName(others), least)))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """One document of each component of similar texts: the one with the smallest id, with all its columns, whatever their names.

    Null ids go after all others. Unrelated rows without an id, or with one id, all stay; of rows that share id and text, one does. Null
    texts and texts without words are alike. Texts of any length are taken whole. Empty input gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("node"))
    labels = components(similar_pairs(base, size, least)).withColumnRenamed("node", "linked")
    labelled = base.select("doc_id", sha_of("text").alias("sha"), "node").join(labels, F.col("node") == F.col("linked"), "left")
    return keep_first(docs, labelled.select("doc_id", "sha", F.coalesce("label", "node").alias("label")), id_col, sha_of(text_col))
