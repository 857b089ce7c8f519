"""SimHash near-dedup (operator 7): a byte-position inverted index with count filtering finds the fingerprints that link.

Fingerprints of 64 bits that differ in at most 3 bits share at least 5 of their 8 positional bytes. The index posts each distinct
fingerprint under 14 sets of 4 positions, those whose numbers cancel out under exclusive or: every 5 of the 8 positions hold exactly one
of these sets, so a pair with 5 bytes in common meets in at least one posting list. A list's key has 32 bits, so that even 10^10
fingerprints make lists of a few rows. Most pairs of a list share its 4 bytes by chance and no fifth one: their shared positional bytes
are tallied, pairs that reach the guaranteed 5 are kept (about one in 64 of the chance meetings), and only these have their bits compared.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.base import cut, keep_first, parts, slices, texts_of, tidy
from brindle.llm.components import components

SEED = 42
LEAST_BYTES = 5
POSITIONS = tuple(c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0)
#: Fingerprints of one posting list that meet in one task; a longer list is split into blocks, and each pair of blocks is a cell.
BLOCK = 8192
#: Rows of the index that a task holds at once, besides a list that reaches further.
HELD = 1 << 19


def fingerprint_bits(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Unsigned fingerprints of runs of 64-bit hashes: a bit is 1 if it is set in over half of a run's hashes; 0 for an empty run."""
    out = np.zeros(len(lengths), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    full = np.flatnonzero(lengths)
    starts = (np.cumsum(lengths) - lengths)[full]
    most = 1 << 16  # hashes at a time
    at = 0
    while at < len(full):
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + most, side="left")))
        run, base = full[at:stop], starts[at]
        end = starts[stop - 1] + lengths[full[stop - 1]]
        set_bits = np.zeros((len(run), 64), np.int64)
        for a in range(base, end, most):  # one run may be longer than what is unpacked at a time
            b = min(end, a + most)
            bits = np.unpackbits(hashes[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            inside = (starts[at:stop] < b) & (starts[at:stop] + lengths[run] > a)
            set_bits[inside] += np.add.reduceat(bits, np.maximum(starts[at:stop][inside] - a, 0), axis=0, dtype=np.int64)
        out[run] = ((set_bits * 2 > lengths[run][:, None]) * weights).sum(axis=1, dtype=np.uint64)
        at = stop
    return out


def _shingle_hashes(text: bytes, size: int) -> list[int]:
    words = text.lower().split()  # of bytes: A-Z only, and white space is 20 and 09 to 0D
    if not words:
        return []
    line, n, digest = b" ".join(words), max(1, len(words) - size + 1), xxhash.xxh64_intdigest
    if n == 1:
        return [digest(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    return [digest(line[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]


def fingerprints(texts: pa.Array, size: int = 3) -> np.ndarray:
    """Signed 64-bit SimHash of each text (null: empty) over its word shingles, repeats included."""
    texts, found = texts_of(texts), []
    for a, b in slices(texts, 1 << 20):
        hashes = [_shingle_hashes(t, size) for t in texts.slice(a, b - a).cast(pa.large_binary()).to_pylist()]
        flat = np.fromiter((h for x in hashes for h in x), np.uint64, sum(map(len, hashes)))
        found.append(fingerprint_bits(flat, np.array([len(x) for x in hashes], np.int64)))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)).view(np.int64)


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint", size: int = 3) -> DataFrame:
    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        return pa.array(fingerprints(texts, size), pa.int64())

    return docs.withColumn(out, simhash(F.col(text_col)))


def shared_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Tally of equal positional bytes, 0 to 8."""
    marks = x ^ y
    for step in (4, 2, 1):
        marks |= marks >> np.uint64(step)
    return 8 - np.bitwise_count(marks & np.uint64(0x0101010101010101))


def _near(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Which pairs reach the guaranteed number of shared bytes and, verified, differ in few enough bits."""
    near = shared_bytes(x, y) >= LEAST_BYTES
    kept = np.flatnonzero(near)
    if len(kept):
        near[kept] = np.bitwise_count(x[kept] ^ (y[kept] if np.ndim(y) else y)) <= most
    return near


def _tree(found: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what links within one posting list, without all its pairs: each fingerprint looks only at those not reached yet."""
    edges, left = [], found
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = _near(left, x, most)
            if hit.any():
                edges.append((np.full(int(hit.sum()), x), left[hit]))
                queue.extend(left[hit])
                left = left[~hit]
    return edges


def _edges(group: np.ndarray, prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges within runs of equal group numbers."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    length = np.diff(np.append(first, len(group)))
    small = np.repeat(length <= 4, length)
    found = []
    for step in (1, 2, 3):
        near = np.flatnonzero(small[:-step] & (group[:-step] == group[step:])) if len(group) > step else np.zeros(0, np.int64)
        near = near[_near(prints[near], prints[near + step], most)]
        found.append((prints[near], prints[near + step]))
    for a, n in zip(first[length > 4], length[length > 4], strict=True):
        found += _tree(prints[a : a + n], most)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def links(distinct: DataFrame, column: str = "fingerprint", most: int = 3) -> DataFrame:
    """(a, b): edges between distinct fingerprints, enough to connect all that link directly or by others; most is 3 or fewer bits."""
    if not 0 <= most <= 3:
        raise ValueError("the count filter is guaranteed for 0 to 3 differing bits")
    byte = lambda i: F.shiftrightunsigned(column, 56 - 8 * i).bitwiseAND(F.lit(255))
    keys = [F.lit(k << 32) + F.shiftleft(byte(w), 24) + F.shiftleft(byte(x), 16) + F.shiftleft(byte(y), 8) + byte(z) for k, (w, x, y, z) in enumerate(POSITIONS)]
    index = distinct.select(F.col(column), F.explode(F.array(*keys)).alias("key"))
    lists = index.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    posted = index.join(lists, "key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(column), blocks).cast("int")
    others = F.filter(F.sequence(F.lit(0), blocks - 1), lambda j: (blocks == 1) | (j != own))
    cells = posted.select(column, "key", own.alias("own"), F.explode(others).alias("other"))
    cells = cells.select(column, F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"))
    dealt = cells.repartition(parts(distinct.sparkSession), "cell").sortWithinPartitions("cell")

    def find(batches):
        group, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(g, p):
            a, b = _edges(g, p, most) if len(g) > 1 else (np.zeros(0, np.uint64),) * 2
            pairs = np.unique(np.stack([np.maximum(a.view(np.int64), b.view(np.int64)), np.minimum(a.view(np.int64), b.view(np.int64))], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            group = np.concatenate((group, batch.column(1).to_numpy(zero_copy_only=False)))
            prints = np.concatenate((prints, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            if len(group) >= HELD and group[0] != group[-1]:
                whole = int(np.searchsorted(group, group[-1]))  # the last list may go on
                yield out(group[:whole], prints[:whole])
                group, prints = group[whole:], prints[whole:]
        if len(group):
            yield out(group, prints)

    return dealt.mapInArrow(tidy(find), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the smallest id that links reach, its own included).

    A null or blank text has fingerprint zero and links like any other. Equal fingerprints are one node, however many documents have
    it. Null ids are kept and never the smallest, unless a component has no other; repeated rows each have a row. Texts of any length
    are taken whole. Columns of other names play no part. Empty input gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    slim = cut(with_fingerprint(base).select("doc_id", "fingerprint"))
    nodes = slim.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    labels = components(links(nodes.select("fingerprint"), most=most))
    labelled = nodes.join(labels, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("label", "fingerprint").alias("label"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labelled.join(least, "label").select("fingerprint", "component_id")
    return slim.join(named, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def sha_of(text_col: str) -> F.Column:
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """One document of each component: the one with the smallest id, with all its columns, whatever their names.

    Null ids go after all others. Unrelated rows without an id, or with one id, all stay; of rows that share id and text, one does.
    Null and blank texts are one component. Empty input gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    slim = cut(with_fingerprint(base, size=size).select("doc_id", sha_of("text").alias("sha"), "fingerprint"))
    labels = components(links(slim.select("fingerprint").distinct()))
    labelled = slim.join(labels, F.col("fingerprint") == F.col("node"), "left").select("doc_id", "sha", F.coalesce("label", "fingerprint").alias("label"))
    return keep_first(docs, labelled, id_col, sha_of(text_col))
