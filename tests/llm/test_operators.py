"""Each operator against a brute-force version, an exact round trip, or held-out accuracy; and the cases that must not crash."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from brindle.llm import elias_fano, exact_dedup, language_id, license_scan, lm_scoring, minhash, mixing, packing, quotient_filter, simhash, similar, token_files, tokens, url_filter
from brindle.llm.components import components

LONG = "the long text of one word after another " * 4000
ODD = [
    (1, "the same text", "en", "a"),
    (2, "the same text", "en", "a"),
    (2, "the same text", "en", "a"),
    (3, "the  same\ttext", None, "a"),
    (4, None, "en", None),
    (5, "", "fr", "b"),
    (6, " \n ", "fr", "b"),
    (None, "no id here", "en", "b"),
    (7, LONG, "en", "c"),
    (8, "12345 67890", "de", "c"),
    (9, "Released under the MIT License. ÉTÉ cc by Cc-By", "fr", ""),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({n: F.lit(1) for n in ("fingerprint", "keep_id", "body", "_stay", "part", "row", "label", "tokens")}).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- exact dedup -------------------------------------------------------------


def brute_dedup(data):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in data]
    groups = {}
    for (i, _), t in zip(data, norm, strict=True):
        groups.setdefault(t, []).append(i)
    out = []
    for (i, _), t in zip(data, norm, strict=True):
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup(spark, odd, none, docs):
    assert sorted(rows(exact_dedup.exact_groups(odd)), key=str) == brute_dedup([(r[0], r[1]) for r in ODD])
    assert rows(exact_dedup.exact_groups(none)) == []
    data = rows(docs.select("doc_id", "text"))
    assert sorted(rows(exact_dedup.exact_groups(docs)), key=str) == brute_dedup(data)
    kept = rows(exact_dedup.drop_copies(odd).select("doc_id"))
    assert sorted(kept, key=str) == sorted([(1,), (4,), (None,), (6,), (7,), (8,), (9,)], key=str)


def test_quotient_filter_is_lossless():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 1000, 20_000):
        values = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        values = np.concatenate((values, values[: n // 3], np.repeat(values[:2], 50)))
        want, counts = np.unique(values, return_counts=True)
        got = quotient_filter.decode(quotient_filter.build(values))
        assert (got[0] == want).all() and (got[1] == counts).all()
    a, b = rng.integers(0, 50, 200, dtype=np.uint64), rng.integers(20, 90, 300, dtype=np.uint64)
    want, counts = np.unique(np.concatenate((a, b)), return_counts=True)
    got = quotient_filter.merge([quotient_filter.build(a), quotient_filter.build(b)])
    assert (got[0] == want).all() and (got[1] == counts).all()


# --- SimHash -----------------------------------------------------------------


def brute_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_labels(prints):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(prints):
            for j in np.flatnonzero(np.bitwise_count(prints ^ x) <= 3):
                low = min(label[i], label[j])
                changed |= label[i] != low or label[j] != low
                label[i] = label[j] = low
    return label


def brute_components(data):
    prints = np.array([brute_print(t) for _, t in data], np.uint64)
    label = brute_labels(prints)
    least = {}
    for (i, _), k in zip(data, label, strict=True):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    return sorted([(i, f"{int(p):016x}", least.get(k)) for (i, _), p, k in zip(data, prints, label, strict=True)], key=str)


def test_simhash(spark, odd, none, docs):
    assert sorted(rows(simhash.near_duplicates(odd)), key=str) == brute_components([(r[0], r[1]) for r in ODD])
    assert rows(simhash.near_duplicates(none)) == []
    some = docs.unionByName(docs.limit(60).withColumns({"doc_id": F.col("doc_id") + 10_000, "text": F.concat("text", F.lit(" end."))}))
    data = rows(some.select("doc_id", "text"))
    got = sorted(rows(simhash.near_duplicates(some)), key=str)
    assert got == brute_components(data)
    assert len({c for _, _, c in got}) < len({p for _, p, _ in got}), "some fingerprints must link"


def test_simhash_links_in_large_lists(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 40)  # lists of over 40 are split into cells
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for seed in [rng.getrandbits(64) for _ in range(4)]:
        now = seed
        for _ in range(120):
            now ^= 1 << rng.randrange(64) if rng.random() < 0.7 else (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            prints.add(now)
    prints = np.array(sorted(prints), np.uint64)
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "fingerprint long")
    got = {r.node: r.label for r in components(simhash.links(df)).collect()}
    label = brute_labels(prints)
    mine = [got.get(int(p), int(p)) for p in prints.view(np.int64)]
    assert len(set(zip(mine, label, strict=True))) == len(set(mine)) == len(set(label)) < len(prints)


def test_positional_index_and_count_filter():
    """Every 5 of 8 positions hold one posting set, so pairs of 3 bits meet; the count filter leaves few of those that meet by chance."""
    assert len(simhash.POSITIONS) == 14
    assert all(sum(set(p) <= set(five) for p in simhash.POSITIONS) == 1 for five in combinations(range(8), 5))
    rng = np.random.default_rng(6)
    x = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    y = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    kept = np.uint64(0xFFFFFFFF00000000)  # a pair that shares 4 bytes by chance
    met = simhash.shared_bytes(x, (x & kept) | (y & ~kept))
    assert 0.008 < (met >= simhash.LEAST_BYTES).mean() < 0.025
    near = x.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64)
    assert (simhash.shared_bytes(x, near) >= simhash.LEAST_BYTES).all() and simhash._near(x, near, 3).all()
    assert (simhash._near(x, y, 3) == (np.bitwise_count(x ^ y) <= 3)).all()


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(300, 301), (301, 300), (5, 5), (None, 1)], "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert {got[i] for i in range(201)} == {0} and got[301] == got[300] == 300
    assert rows(components(edges.limit(0))) == []


# --- tokens, files, packing --------------------------------------------------


def test_words_and_marks_are_encoded_once(monkeypatch):
    """Words go to the model once, whatever stands behind them; the tokenizer's pattern gets no word."""
    path, r = tokens.default_path(), random.Random(3)
    words = ["".join(r.choices("abzÉÿöñÀ", k=r.randint(1, 9))) for _ in range(60)]
    odd = ["it's", "we'll.", "a<|endoftext|>b", "x×y", "ª1", "÷", "µm", "3rd,", "ſt", "日本."]
    texts = [" ".join(w + m for w in words for m in ("", *"!.-_<|>^]", "...", "?!")), " ".join(odd), "\n".join(words + odd), ""]
    given, encode = [], tokens._encode
    monkeypatch.setattr(tokens, "_known", {})
    monkeypatch.setattr(tokens, "_encode", lambda p, t: given.extend(t) or encode(p, t))
    ids, lengths = tokens.token_ids(pa.array(texts, pa.large_string()), path)
    want = [tokens.tokenizer(path).encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert ids.tolist() == [x for w in want for x in w] and lengths.tolist() == list(map(len, want))
    assert sum(map(len, given)) < 200


def test_token_ids_equal_the_tokenizer(docs):
    path, rng = tokens.default_path(), random.Random(1)
    encode = lambda t: tokens.tokenizer(path).encode(t, add_special_tokens=False).ids + [0]
    bits = ["a", "bc", "The", " ", "  ", "\n", "\n\n", "\t", ".", ",", "'s", "é", "1", "23", " ", "日本", "😀", "\x00", "-", "\r\n", "\x85", "<|endoftext|>", "_", " the", " of"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(2000)] + [r.text for r in docs.limit(60).collect()] + [LONG]
    for again in range(2):  # the second time from memory
        ids, lengths = tokens.token_ids(pa.array(texts, pa.large_string()), path)
        ends = np.cumsum(lengths)
        assert all(ids[e - n : e].tolist() == encode(t) for t, e, n in zip(texts, ends, lengths, strict=True))


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 0), (5, 3), (3000, 10), (3000, 1 << 40), (1500, 1 << 14)):
        values = np.sort(rng.integers(0, top + 1, n))
        data = elias_fano.encode(values)
        reader = elias_fano.Reader(data)
        assert (reader.all() == values).all()
        assert all((reader.range(a, b) == values[a:b]).all() for a, b in ((0, n // 2), (n // 3, n), (n // 2, n // 2), (max(0, n - 1), n)))
        assert all(reader.select(i) == values[i] for i in range(0, n, max(1, n // 97)))
        assert len(data) < 40 + n * (3 + max(0, math.log2(top / max(n, 1) + 1))) / 8 + 4 * (n // 512 + 1)


def brute_files(data):
    out, start = [], 0
    encode = tokens.tokenizer(tokens.default_path()).encode
    for i, t in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")):
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files(spark, odd, none, docs, monkeypatch):
    key = lambda r: r[1]
    assert sorted(rows(token_files.round_trip(odd)), key=key) == brute_files([(r[0], r[1]) for r in ODD])
    assert rows(token_files.round_trip(none)) == []
    assert sorted(rows(token_files.round_trip(docs)), key=key) == brute_files(rows(docs.select("doc_id", "text")))
    segment = token_files.Segment(token_files.pack(np.array([5, 6, 0, 7, 0]), np.array([3, 2])))
    assert segment.document(0).tolist() == [5, 6, 0] and segment.document(1).tolist() == [7, 0]


def test_packing(spark, odd, none, docs):
    assert rows(packing.pack(none)) == []
    for source, data in ((odd, [(r[0], r[1]) for r in ODD]), (docs, rows(docs.select("doc_id", "text")))):
        found = packing.pack(source).collect()
        encode = tokens.tokenizer(tokens.default_path()).encode
        want = []
        for i, t in data:
            ids = np.array([*encode(t or "", add_special_tokens=False).ids, 0], "<u4")
            cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)] if len(ids) > 2048 else [0, len(ids)]
            want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        assert sorted([tuple(r)[:5] for r in found], key=str) == sorted(want, key=str)
        places = {}
        for r in found:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in places.values():
            own.sort()
            assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
        total = sum(r.length for r in found)
        assert len(places) <= max(-(-total // 2048) + 1, packing.least_bins([r.length for r in found], 2048) + 1)


def test_pieces_do_not_depend_on_what_is_encoded_at_once(docs):
    whole, small = (sorted(rows(packing.pieces(docs, at_once=n)), key=str) for n in (1 << 22, 1))
    assert whole == small and whole


def test_genetic_packing_beats_best_fit():
    """Where best fit by falling length misses the lower bound, crossover finds fewer bins than any packing it began with."""
    better = 0
    for seed, low, high, n in ((2, 300, 900, 300), (2, 400, 1100, 200), (2, 500, 1023, 150), (2, 600, 1000, 400)):
        rng = random.Random(seed)
        lengths = [rng.randrange(low, high) for _ in range(n)]
        first = packing.first_people(lengths, 2048, random.Random(1))
        found = packing.evolve(lengths, 2048, 1)
        best = found.people[0]
        assert sorted(i for g in best for i in g) == list(range(n)) and max(sum(lengths[i] for i in g) for g in best) <= 2048
        least = packing.least_bins(lengths, 2048)
        assert least < len(first[0]) and least <= len(best) < len(first[0]) and found.crossovers == 2 * packing.GENERATIONS
        better += len(best) < min(map(len, first))
        child = packing.crossover(first[0], best, lengths, 2048, rng)
        assert sorted(i for g in child for i in g) == list(range(n))
    assert better >= 2, "crossover, not the noise of the first people, makes the difference"
    assert packing.least_bins([1500, 1500, 500, 300], 2048) == 2 and packing.least_bins([1500, 1500, 700, 300], 2048) == 3
    assert packing.evolve([], 2048, 1).people == [[]] and packing.evolve([7], 2048, 1).people == [[[0]]]


def test_islands_cross_and_migrate(spark):
    rng = random.Random(9)
    items = spark.createDataFrame([(i, rng.randrange(600, 1000)) for i in range(400)], "item long, length int")
    _, once = packing.islands(items, 2048, epochs=1)
    _, twice = packing.islands(items, 2048, epochs=2)
    (one,), (two,) = packing.report(once).collect(), packing.report(twice).collect()
    assert one.crossovers == 2 * packing.GENERATIONS * packing.ISLANDS and two.crossovers == 2 * one.crossovers
    assert two.least <= two.bins <= one.bins < one.first_bins == two.first_bins and two.met == (two.bins == two.least)
    fills = {}
    for r in packing.pack_lengths(items, 2048).collect():
        fills.setdefault((r.shard, r.bin), []).append((r.offset, r.length, r.fill))
    assert len(fills) == two.bins
    for own in fills.values():
        own.sort()
        assert sum(n for _, n, _ in own) == own[0][2] <= 2048 and [o for o, *_ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))]


# --- fingerprints, language, mixing ------------------------------------------


def test_fingerprints(spark, odd, none, docs):
    assert rows(minhash.fingerprint_all(none)) == []
    for source, data in ((odd, [(r[0], r[1]) for r in ODD]), (docs, rows(docs.select("doc_id", "text")))):
        order = sorted(((i, t or "") for i, t in data), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        want = []
        for k, (i, t) in enumerate(order):
            after, n = order[(k + 1) % len(order)][1], len(t) // 4
            edited = t[: len(t) - n] + after[:n]
            want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, after))
        got = {}
        for r in minhash.fingerprint_all(source).collect():
            got.setdefault((r.doc_id, r.n_chars, r.edited_sha256), []).append(r)
        assert sorted(map(str, [w[:3] for w in want])) == sorted(str(k) for k, v in got.items() for _ in v)
        shingles = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t.split() else set()
        alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        wrong = [abs(got[w[:3]][0].near_edited - alike(shingles(w[3]), shingles(w[4]))) for w in want if len(shingles(w[3])) > 60]
        assert not wrong or np.sqrt(np.mean(np.square(wrong))) < 0.05  # the estimate's error depends on the number of distinct shingles
        assert all(got[w[:3]][0].near_next == float(not w[5].split()) for w in want if not w[3].split())
        by_text = {}
        for w in want:
            by_text.setdefault(w[3], set()).add(got[w[:3]][0].fingerprint)
        assert all(len(v) == 1 for v in by_text.values())


def test_language(spark, odd, none, docs):
    assert rows(language_id.identify_all(none)) == []
    got = {(r.doc_id, r.held_out): r for r in language_id.identify_all(odd).collect()}
    assert len(language_id.identify_all(odd).collect()) == len(ODD)
    by_id = {r.doc_id: r for r in got.values()}
    assert {by_id[i].lang_pred for i in (4, 5, 6, 8)} == {"und"} and by_id[7].lang_pred == "en"
    found = language_id.identify_all(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)
    kept = {r.doc_id for r in language_id.keep_identified(odd).collect()}
    assert kept == {None, 1, 2, 3, 7, 9}


def brute_grams(text):
    out = []
    for word in text.split():
        letters = "".join(c if c.isalpha() else " " for c in word.lower())
        for run in letters.split():
            line = f" {run} "
            for size in (2, 3):
                out += [line[i : i + size] for i in range(len(run))]
            out += [line[i : i + 4] for i in range(len(run) - 1)]
    return out


def test_language_masks_equal_plain_sets(spark):
    """Filters against plain sets of n-grams: which language has which, how often a document's are in them, the rates, and the answer."""
    rng = random.Random(7)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}
    data = [(i, " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randrange(2, 7))) for _ in range(40)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 25)]
    model = language_id.train(spark.createDataFrame(data, "doc_id long, text string, lang string"), least=1e-4)
    counts = {lang: Counter(g for _, t, x in data if x == lang for g in brute_grams(t)) for lang in letters}
    share = {lang: {g: n / c.total() for g, n in c.items() if n / c.total() >= 1e-4} for lang, c in counts.items()}
    most = {g: max(s.get(g, 0) for s in share.values()) for s in share.values() for g in s}
    sets = {lang: {g for g, x in s.items() if x >= 0.2 * most[g]} for lang, s in share.items()}
    assert model.languages == sorted(sets) and model.planes.shape == (1, language_id.SLOTS)
    for k, lang in enumerate(model.languages):
        filled = np.count_nonzero(model.planes[0] & np.uint64(1 << k))
        assert 0.99 * 2 * len(sets[lang]) <= filled <= 2 * len(sets[lang]) and math.isclose(model.rates[k], (filled / language_id.SLOTS) ** 2)
    test = [" ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randrange(2, 7))) for _ in range(20)) for lang in ["aa", "bb", "cc"] * 10] + ["zzz", "12", ""]
    names, scores = language_id.predict(pa.array(test), model)
    for text, name, score in zip(test, names, scores, strict=True):
        own = brute_grams(text)
        hits = [sum(g in sets[lang] for g in own) for lang in model.languages]
        if not own:
            assert (name, score) == ("und", 0.0)
        elif sum(hits):
            assert name == model.languages[int(np.argmax(hits))] and math.isclose(score, max(hits) / sum(hits), rel_tol=0.02)


def brute_draws(slim, mix, seed=17):
    """How often each (source, key) is drawn: passes over whole blocks, then blocks in their order, then documents in theirs."""
    spark, drawn = slim.sparkSession, Counter()
    place = {(r.source, r.key): r.block for r in mixing.placed(slim, mix).collect()}
    data = [tuple(r) for r in slim.select("source", "key", "tokens").collect()]
    for w in mix.weights.collect():
        own = [(k, n) for s, k, n in data if s == w.source]
        total, blocks = sum(n for _, n in own), {}
        for k, n in own:
            blocks.setdefault(place[w.source, k], []).append((k, n))
        passes = w.quota // total if total else 0
        for k, _ in own if w.quota else []:
            drawn[w.source, k] += passes
        orders = spark.createDataFrame([(w.source, b, passes) for b in blocks], "source string, block long, epoch int")
        turns = {r.block: r.x for r in orders.withColumn("x", F.xxhash64("source", "block", "epoch", F.lit(seed + 2))).collect()}
        left = w.quota - passes * total
        for b in sorted(blocks, key=lambda b: (turns[b], b)):
            size = sum(n for _, n in blocks[b])
            if size <= left:
                took = [k for k, _ in blocks[b]]
            elif left > 0:
                keys = spark.createDataFrame([(k, passes) for k, _ in blocks[b]], "key long, epoch int")
                turn = {r.key: r.x for r in keys.withColumn("x", F.xxhash64("key", "epoch", F.lit(seed + 1))).collect()}
                took, sofar = [], 0
                for k, n in sorted(blocks[b], key=lambda x: turn[x[0]]):
                    sofar += n
                    took += [k] if sofar <= left else []
            else:
                took = []
            for k in took:
                drawn[w.source, k] += 1
            left -= size
    return +drawn


def test_mixing_draws_equal_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 4)
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 300)
    slim = mixing.slim_rows(docs).cache()
    for limit in (1.2, 2.5):
        mix = mixing.mixture(slim, repetition_limit=limit)
        assert {r.blocks for r in mix.weights.collect()} != {4}, "large sources have more blocks"
        want = brute_draws(slim, mix)
        got = Counter((r.source, r.doc_id) for r in mixing.mix_all(docs, repetition_limit=limit).collect())
        ids = {(r.source, r.key): r.doc_id for r in slim.collect()}
        assert got == Counter({(s, ids[s, k]): n for (s, k), n in want.items()})
        assert Counter(r.doc_id for r in mixing.resample(docs, repetition_limit=limit).collect()) == Counter({i: n for (_, i), n in got.items()})


def test_mixing(spark, odd, none, docs):
    assert rows(mixing.mix_all(none)) == [] and rows(mixing.resample(none)) == []
    assert mixing.mix_all(odd).count() >= 8
    slim = mixing.slim_rows(docs).cache()
    tokens_of = {r.source: r.n for r in slim.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    longest = {r.source: r.n for r in slim.groupBy("source").agg(F.max("tokens").alias("n")).collect()}
    drawn = mixing.mix_all(docs, repetition_limit=1.5).collect()
    weights = {r.source: r.weight for r in drawn}
    a, p = drawn[0].exponent, {s: n / sum(tokens_of.values()) for s, n in tokens_of.items()}
    z = sum(x**a for x in p.values())
    assert all(math.isclose(weights[s], p[s] ** a / z, rel_tol=1e-6) for s in weights)
    ratio = [weights[s] / p[s] for s in p]
    assert math.isclose(max(ratio) / min(ratio), 1.5, rel_tol=1e-4)
    budget = 1 / min(ratio) * sum(tokens_of.values())
    got = {}
    for r in drawn:
        got[r.source] = got.get(r.source, 0) + r.n_tokens
    assert all(weights[s] * budget - longest[s] - 1 <= got[s] <= weights[s] * budget + 1 for s in p)
    assert {r.doc_id for r in drawn} == {r.doc_id for r in slim.collect()}
    entropy = lambda w: -sum(x * math.log(x) for x in w if x)
    target = (entropy(p.values()) + math.log(len(p))) / 2
    found = mixing.mixture(slim, budget=1000.0, target_entropy=target)
    assert math.isclose(entropy([r.weight for r in found.weights.collect()]), target, rel_tol=1e-4)


# --- URL filter, license scan, LM --------------------------------------------


def test_urls(spark):
    made = ["http://A.Example.ORG/en/5?x", "https://x.example.org/es/1#t", "http://org/", "http://notorg.com/fr/1", "http://s.com/de/2", "http://b.net/en", "ftp://h", "none", None, "", "http://example.org/en/12", "http://org"]
    pages = spark.createDataFrame([(i, u, 1, 1) for i, u in enumerate(made)] + [(1, made[1], 1, 1)], "page_id long, url string, rule int, score int")
    from brindle.llm.queries import URL_RULES

    got = {r.page_id: r for r in url_filter.judge(pages, URL_RULES).collect()}
    assert [got[i].rule for i in range(12)] == ["org/", "example.org/es/", "org/", "com/fr/", "com/de/", None, None, None, None, None, "example.org/en/1", None]
    assert (got[0].host, got[0].path) == ("a.example.org", "/en/5") and (got[6].host, got[6].path) == ("h", "") and (got[7].host, got[8].path) == ("", "")
    assert [got[i].verdict for i in (0, 1, 3, 4, 10)] == ["allow", "block", "allow", "block", "block"]
    assert all(got[i].verdict in ("allow", "block") for i in range(12))
    assert rows(url_filter.judge(pages.limit(0), URL_RULES)) == []


def test_url_verdicts_equal_brute_force(spark):
    """Scores, threshold and verdicts of the whole operator against plain code that follows its description."""
    rng = random.Random(12)
    rules = [("allow", "good.org/"), ("block", "bad.com/")]
    words = {"good.org": ["guide", "paper", "docs?id=", "learn&x"], "bad.com": ["casino", "win%20big", "spam=1", "xxx"], "new.net": ["guide", "casino", "docs?id=", "spam=1"]}
    urls = [f"http://{h}/{rng.choice(words[h])}/{rng.choice(words[h])}{rng.randrange(30)}" for h in words for _ in range(80)] + ["http://new.net/é" + "a" * 3000]
    pages = spark.createDataFrame([*enumerate(urls), (-1, None), (-2, "")], "page_id long, url string")
    base, order, code = url_filter.BASE, url_filter.ORDER, lambda c: url_filter.SYMBOLS.find(c.lower()) + 1 or url_filter.BASE - 1
    held = {r.url: r.x for r in pages.select("url", (F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(5)) == 0).alias("x")).collect()}
    seen = {True: {}, False: {}}
    kind = lambda u: True if "//good.org" in u else False if "//bad.com" in u else None
    for u in {u for u in urls if kind(u) is not None and not held[u]}:
        line = [0] * order + [code(c) for c in u]
        for i in range(order, len(line)):
            for k in range(order):
                own = seen[kind(u)].setdefault(tuple(line[i - k : i]), Counter())
                own[line[i]] += 1
    known = {(c, x) for m in seen.values() for c, own in m.items() for x in own}

    def prob(model, context, x):
        lower = prob(model, context[1:], x) if context else 1.0 / base
        own = seen[model].get(context)
        return (own[x] + len(own) * lower) / (own.total() + len(own)) if own else lower

    def score(u):
        line, out = [0] * order + [code(c) for c in u], 0.0
        for i in range(order, len(line)):
            k = order - 1
            out_here = 0.0
            while k >= 0 and (tuple(line[i - k : i]), line[i]) not in known:  # what neither model has seen falls back
                for model, sign in ((True, 1), (False, -1)):
                    own = seen[model].get(tuple(line[i - k : i])) if k else None
                    out_here += sign * math.log(len(own) / (own.total() + len(own))) if own else 0.0
                k -= 1
            if k >= 0:
                context = tuple(line[i - k : i])
                out_here += math.log(prob(True, context, line[i]) / prob(False, context, line[i]))
            out += out_here
        return out / len(u)

    marked = [(score(u), kind(u)) for u in {u for u in urls if kind(u) is not None and held[u]}]
    cuts = sorted({math.floor(s * url_filter.CUTS) for s, _ in marked})
    n = Counter(a for _, a in marked)
    gain = {c: sum(a and s * url_filter.CUTS >= c for s, a in marked) / n[True] + sum(not a and s * url_filter.CUTS < c for s, a in marked) / n[False] for c in cuts}
    best = max(gain.values())
    limit = min(c for c in cuts if math.isclose(gain[c], best)) / url_filter.CUTS
    got = {r.page_id: r for r in url_filter.judge(pages, rules).collect()}
    assert len(got) == len(urls) + 2 and {r.threshold for r in got.values()} == {limit} and (got[-1].score, got[-2].score) == (0.0, 0.0)
    for i, u in enumerate(urls):
        want = score(u)
        assert math.isclose(got[i].score, want, rel_tol=1e-9, abs_tol=1e-9)
        assert got[i].verdict == (("allow" if kind(u) else "block") if kind(u) is not None else "allow" if want >= limit else "block")


def test_url_model_is_a_distribution(spark):
    """Probabilities of the interpolated model, read back from the ratio against brute force."""
    rng = random.Random(4)
    data = [("".join(rng.choice("abc/") for _ in range(12)), rng.random() < 0.5) for _ in range(60)]
    model = {r.gram: r for r in url_filter.train(spark.createDataFrame(data, "url string, accepted boolean")).collect()}
    base, order = url_filter.BASE, url_filter.ORDER
    code = lambda s: sum((0 if c == "^" else url_filter.SYMBOLS.index(c) + 1) * base**k for k, c in enumerate(reversed(s))) + base ** len(s)
    distinct = set(data)

    def prob(context, char, accepted):
        if context is None:
            return 1.0 / base
        seen = [("^" * order + u)[i - len(context) : i + 1] for u, a in distinct if a == accepted for i in range(order, order + len(u))]
        nexts = [g[-1] for g in seen if g[:-1] == context]
        lower = prob(context[1:] if context else None, char, accepted)
        return (nexts.count(char) + len(set(nexts)) * lower) / (len(nexts) + len(set(nexts))) if nexts else lower

    for gram in ("a", "ab", "abc", "/ab", "^a", "^^a", "^^^a", "c/ab"):
        if code(gram) in model and model[code(gram)].ratio is not None:
            want = math.log(prob(gram[:-1], gram[-1], True) / prob(gram[:-1], gram[-1], False))
            assert math.isclose(model[code(gram)].ratio, want, rel_tol=1e-9, abs_tol=1e-9)


def brute_license(text):
    """Labels and best containment of one text: every block that begins at a word of the template, by plain sets."""
    templates = []
    for label, t in license_scan.TEMPLATES:
        words = re.findall(license_scan.WORD, t.lower())
        templates.append((label, set(words), 2 * len(words), math.ceil(0.8 * len(set(words)) - 1e-9)))
    words = re.findall(license_scan.WORD, text)
    runs = [words[48 * k : 48 * k + 96] for k in range(max(1, -(-len(words) // 48) - 1))]
    labels, best = set(), 0.0
    for run in runs if any(len(set(words) & t) >= need for _, t, _, need in templates) else []:
        held = [x for x in templates if len(set(run) & x[1]) >= x[3]]
        for label, t, most, need in held:
            for i, w in enumerate(run):
                if w in t:
                    block = set(run[i : i + most])
                    mine = t & block
                    covered = any(len(u & block) >= n and mine <= u & block and (len(u & block) > len(mine) or len(u) < len(t)) for _, u, _, n in held)
                    if len(mine) >= need and not covered:
                        labels.add(label)
                        best = max(best, len(mine) / len(t))
    return labels, best


NOTICES = (
    ("Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files", "mit"),
    ("Redistribution and use in source and binary forms,\nwith or without modification, are permitted\nprovided that the following conditions are met:", "bsd"),
    ("prose before it. Licensed under CC BY-SA 4.0 and prose after it", "cc-by,cc-by-sa"),
    ("Licensed under the\r\nApache License, Version 2.0" + " word" * 300 + " Released under the\n\nMIT License", "apache-2.0,mit"),
    ("Released under the MIT License. Licensed under the Apache License, Version 2.0", "apache-2.0,mit"),
    (" filler" * 50 + " This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0", "mpl-2.0"),
    ("licensed to many of us under the weather of the day by 4 people of note and 0 others, with a copy of the software", ""),
)


def test_licenses(spark, odd, none, docs):
    assert rows(license_scan.scan(none)) == []
    assert 48 == max(most for *_, most in license_scan._templates(license_scan.TEMPLATES)), "the runs of brute_license() are as long as the operator's"
    made = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NOTICES)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(made).collect()}
    assert [got[i].labels for i in range(len(NOTICES))] == [x for _, x in NOTICES]
    for source, data in ((odd, [(r[0], r[1]) for r in ODD]), (docs, rows(docs.select("doc_id", "text"))), (made, rows(made))):
        want = []
        for i, t in data:
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
            words, places = re.findall(license_scan.WORD, low), []
            for phrase, label in license_scan.PHRASES:
                p = phrase.split()
                places += [(k, label) for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
            base = {x for _, x in places}
            labels, best = brute_license(low)
            starts = [k for k, _ in places]
            want.append((i, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if places else best))
        assert sorted(rows(license_scan.scan(source)), key=str) == sorted(want, key=str)


def test_lm_scores(spark, odd, none, docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (7, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    assert rows(lm_scoring.score_all(none, labels)) == []
    got = lm_scoring.score_all(odd, labels).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (4, 5, 6)} == {0}
    good = [(i, "alpha beta gamma delta " * 5 + f"x{i}", 1) for i in range(60)]
    bad = [(i, "omega sigma tau rho " * 5 + f"y{i}", 0) for i in range(60, 120)]
    made = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    marks = spark.createDataFrame([(i, q, 0) for i, _, q in good[::2] + bad[::2]], "doc_id long, quality int, toxic int")
    score = {r.doc_id: r.score for r in lm_scoring.score_all(made, marks).collect()}
    assert min(score[i] for i, *_ in good) > max(score[i] for i, *_ in bad)


def test_lm_losses_equal_brute_force(spark, monkeypatch):
    """Every word and every pair has a count of its own, over many slices and ranges."""
    monkeypatch.setattr(lm_scoring, "SLICE", 1 << 13)
    monkeypatch.setattr(lm_scoring, "RANGE", 1 << 15)
    rng = random.Random(8)
    data = [(None if i < 3 else i // 2 if i < 9 else i, " ".join(f"W{int(rng.paretovariate(0.8)) if rng.random() < 0.3 else rng.randrange(300_000)}" for _ in range(rng.randrange(300)))) for i in range(1200)]
    good = {i for i, _ in data if i is not None and i % 3 == 0}
    made = spark.createDataFrame(data, "doc_id long, text string").withColumn("fold", F.xxhash64("text").bitwiseAND(F.lit(1)))
    marks = spark.createDataFrame([(i, 1, 0) for i in sorted(good)] * 2 + [(10**9, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    folded = rows(made)
    words, pairs = {}, {}
    for i, text, f in folded:
        own = text.lower().split()
        for table, keys in ((words, own), (pairs, zip(own[:-1], own[1:], strict=True))):
            for k in keys:
                table[f, i in good, k] = table.get((f, i in good, k), 0) + 1
    size = len({k for _, _, k in words})
    assert size > 1 << 16, "more words than any fixed vocabulary held"
    total = {(f, g): sum(n for (a, b, _), n in words.items() if (a, b) == (f, g)) for f in (0, 1) for g in (False, True)}
    want = []
    for i, text, f in folded:
        own, loss = text.lower().split(), []
        for g in (False, True):
            scale, x = min(total[1 - f, False], total[1 - f, True]) / total[1 - f, g], 0.0
            for k, w in enumerate(own):
                p = (words.get((1 - f, g, w), 0) * scale + 1) / (total[1 - f, g] * scale + size)
                if k:
                    p = min(1.0, (pairs.get((1 - f, g, (own[k - 1], w)), 0) * scale + 64 * p) / (words.get((1 - f, g, own[k - 1]), 0) * scale + 64))
                x -= math.log(p)
            loss.append(x / max(1, len(own)))
        want.append((str(i), len(own), loss[1], loss[0]))
    got = sorted((str(r.doc_id), r.n_tokens, r.target_loss, r.background_loss) for r in lm_scoring.score_all(made.drop("fold"), marks).collect())
    assert [r[:2] for r in got] == [r[:2] for r in sorted(want)]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in sorted(want)], rtol=1e-9)


def test_near_copies_without_an_id_or_with_one_id_stay(spark):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    made = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[3]), (6, texts[2]), (None, texts[2]), (7, None)]
    made = spark.createDataFrame(made, "doc_id long, text string")
    want = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (7, None)]
    assert sorted(rows(simhash.drop_near_copies(made)), key=str) == sorted(want, key=str)


def test_language_stage_without_labels_keeps_texts(odd):
    bare = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in language_id.keep_identified(bare).collect()} == {None, 1, 2, 3, 7, 9}


CLASHING = ("own_id", "own_sha", "OWN_SOURCE", "key", "block", "stay", "n", "sha", "keep_id", "found_language", "_stay", "_epoch", "_last", "_kept_id", "_language", "mark_id", "draw_epoch", "n_blocks", "row", "item", "item_", "bucket", "part", "slice", "fold", "score", "words")


def test_clashing_columns_keep_their_values(spark, odd):
    """The functions that return documents give back every column as it was."""
    marked = odd.select("doc_id", "text", "lang", "source").withColumns({c: F.lit(f"my {c}") for c in CLASHING})
    for stage in (language_id.keep_identified, exact_dedup.drop_copies, simhash.drop_near_copies, similar.drop_similar, mixing.resample):
        found = stage(marked)
        assert found.columns == marked.columns
        got = found.collect()
        assert got and all(r[c] == f"my {c}" for r in got for c in CLASHING)
    for whole in (exact_dedup.exact_groups, simhash.near_duplicates, minhash.fingerprint_all, language_id.identify_all, license_scan.scan, token_files.round_trip, packing.pack, mixing.mix_all):
        assert whole(marked).count() >= 8
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert lm_scoring.score_all(marked, labels).count() == len(ODD)
    assert url_filter.judge(marked.withColumnsRenamed({"doc_id": "page_id", "text": "url"}), [("allow", "org/")]).count() == len(ODD)


def test_texts_without_spaces_have_many_shingles(spark):
    text = "".join(chr(0x4E00 + i * 37 % 5000) for i in range(400))
    made = spark.createDataFrame([(1, text), (2, text[:390] + text[:10])], "doc_id long, text string")
    got = {r.doc_id: r for r in minhash.fingerprint_all(made).collect()}
    assert got[1].near_next > 0.8 and 0.4 < got[1].near_edited < 0.9
