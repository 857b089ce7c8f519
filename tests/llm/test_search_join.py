"""Operators 11 to 13 against brute force: benchmark windows, spelling variants, ranked search; odd and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from brindle.llm import decontamination, lexical_search, spelling

SCHEMA = "DOC_ID2 string, token string, n long, doc_id long, text string, row string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, rows):
    """Documents with columns whose names helper columns might have."""
    return spark.createDataFrame([("x", "y", 7, i, t, "z") for i, t in rows], SCHEMA)


def items_frame(spark, rows):
    return spark.createDataFrame([("x", 1, i, t) for i, t in rows], "window string, offset long, item_id long, text string")


def made(seed, n, words, longest=60, vocabulary=40):
    r = random.Random(seed)
    letters = ["ab", "Be", "cé", "dÉ", "e9", "fß", "ga", "HI", "i", "job"]
    names = [r.choice(letters) + r.choice(letters) + (r.choice(letters) if r.random() < 0.5 else "") for _ in range(vocabulary)]
    return [(i, " ".join(r.choice(names) + r.choice(["", ",", ".\n", " -"]) for _ in range(r.randint(1, longest)))) for i in range(n)], names


def leaked(docs, items, window=10):
    split = [(str(i) if i is not None else "", WORD.findall(small(t))) for i, t in items]
    out = []
    for i, text in docs:
        words, hit, met = WORD.findall(small(text)), set(), set()
        for name, own in split:
            size = min(len(own), window)
            for k in range(max(len(own) - window, 0) + 1 if own else 0):
                for at in range(len(words) - size + 1):
                    if words[at : at + size] == own[k : k + size]:
                        hit |= set(range(at, at + size))
                        met.add(name)
        out.append((i, len(words), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def corpus():
    items, names = made(1, 12, 40)
    items += [(50, "Ein"), (51, "zwei drei"), (52, None), (53, " .,"), (54, items[0][1]), (0, items[1][1]), (None, "vier fünf sechs sieben"), (55, "a " * 30), (56, "É" + " x" * 9)]
    docs, _ = made(2, 30, 40)
    r = random.Random(3)
    for k in range(30):
        words = r.choice(items[:12])[1].split()
        a = r.randrange(len(words))
        docs.append((100 + k, " ".join([*r.choices(names, k=r.randint(0, 5)), *words[a : a + r.randint(5, 40)], r.choice(["ein", "zwei drei", "drei zwei", ""]), *r.choices(names, k=3)])))
    docs += [(None, None), (200, ""), (200, items[0][1]), (200, items[0][1]), (201, "EIN"), (202, "A, a. " * 40), (203, "a " * 9), (204, "É" + " X" * 9), (205, "é" + " X" * 9), (206, "vier FÜNF sechs sieben vier fünf sechs sieben")]
    docs.append((207, " ".join(t or "" for _, t in items) * 20))
    return docs, items


def test_leaks_equal_brute_force(spark):
    docs, items = corpus()
    got = decontamination.judge(frame(spark, docs), items_frame(spark, items)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(tuple, got.collect()), key=repr) == leaked(docs, items)


def test_leaks_with_a_shuffled_index(spark, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(decontamination, "FEW_ROWS", 0)
    monkeypatch.setattr("brindle.llm.base.FEW_ROWS", 0)
    got = decontamination.judge(frame(spark, docs), items_frame(spark, items)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(tuple, got.collect()), key=repr) == leaked(docs, items)


def test_leak_spans(spark):
    words = [f"w{i}" for i in range(30)]
    docs = [(1, " ".join(["q", *words[:12], "q", *words[5:15], *words[15:26], "q"])), (2, " ".join(words[:9]))]
    got = {r.doc_id: r for r in decontamination.leaks(frame(spark, docs), items_frame(spark, [(3, " ".join(words))])).collect()}
    assert [tuple(s) for s in got[1].spans] == [(1, 13), (14, 35)] and got[1]["items"] == ["3"]
    assert not got[2].spans and not got[2]["items"]


def test_leaks_without_items_or_documents(spark):
    docs, items = corpus()
    none = decontamination.judge(frame(spark, docs), items_frame(spark, []))
    assert sorted(map(tuple, none.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr) == leaked(docs, [])
    assert decontamination.judge(frame(spark, []), items_frame(spark, items)).count() == 0


def edits(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    p = next((i for i in range(len(b)) if a[i] != b[i]), len(b))
    return a[p + 1 :] == (b[p + 1 :] if len(a) == len(b) else b[p:])


def grouped(docs, one_in=97, least=5, often=3, times=2):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = small(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % one_in else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= often}
    near = {w: [x for x in n if edits(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=repr)


def variant_docs(seed, bases=25):
    r = random.Random(seed)
    alphabet = "aabcdeeéÉñÿ÷×xyz"
    names = ["".join(r.choice(alphabet) for _ in range(r.randint(4, 9))) for _ in range(bases)]
    names += ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "babababa", "ababababa"]
    out = []
    for i in range(120):
        words = []
        for _ in range(r.randint(5, 60)):
            w = list(r.choice(names[: r.randint(1, len(names))]))
            for _ in range(r.choice((0, 0, 1, 1, 2))):
                p, kind = r.randrange(len(w)), r.random()
                w[p : p + (kind > 0.3)] = [] if kind > 0.7 else [r.choice(alphabet)]
            words.append("".join(w).capitalize() if r.random() < 0.2 else "".join(w))
        out.append((i % 100 if i % 7 else None, r.choice([" ", "-", "1", "_"]).join(words)))
    return [*out, (500, None), (501, ""), (502, "  1 2 3"), (503, "Hund " * 3000 + "Hunde " * 5 + "Hunden " * 3), (504, "nopqrs " * 3 + "nopqrt " * 8 + "nopqxt " * 20)]


@pytest.mark.parametrize("seed", range(3))
def test_variants_equal_brute_force(spark, seed):
    docs = variant_docs(seed)
    got = spelling.variants(frame(spark, docs)).select("word", "form", "root", "n", "n_near", "form_n")
    want = grouped(docs)
    assert len(want) > 50 and any(f and r != f for _, f, r, *_ in want)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_every_near_pair_shares_a_band():
    import pyarrow as pa

    r = random.Random(5)
    words = ["".join(r.choice(spelling.LETTERS) for _ in range(r.randint(5, 12))) for _ in range(300)]
    for w in words:
        p, c = r.randrange(len(w)), r.choice(spelling.LETTERS)
        a, b, x = spelling.parities(pa.array([w, w[:p] + w[p + 1 :], w[:p] + c + w[p + 1 :]]))
        assert (a == b).sum() >= 2 and (a == x).any()


def test_variants_of_nothing(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [(1, None), (2, "abc def")])).count() == 0


def ranked(docs, items, top=10):
    held = [(i, Counter(small(t) for t in TERM.findall(text or ""))) for i, text in docs]
    total, length = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 10 + (90 * c.total() * total) // max(length, 1)
            s = 0
            for t in {small(t) for t in TERM.findall(text or "")} & set(c):
                s += math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_terms", [1 << 18, 25])
def test_search_equals_brute_force(spark, block_terms):
    docs, items = corpus()
    more, _ = made(9, 60, 40, vocabulary=200)
    docs = docs + [(300 + i, t) for i, t in more] + [(300 + i, t) for i, t in more[:15]]
    got = lexical_search.search(frame(spark, docs), items_frame(spark, items), block_terms=block_terms).select("item_id", "rank", "doc_id", "score")
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(docs, items)


def test_pruning_keeps_the_ranking():
    """Skewed terms, a small TOP: terms are pruned, and what is ranked is what all postings give."""
    import numpy as np

    r = np.random.default_rng(4)
    n_terms, n_docs, n_items, top, pruned = 60, 400, 30, 3, 0
    share = 0.9 / (1 + np.arange(n_terms))
    present = r.random((n_docs, n_terms)) < share
    impact = np.where(present, r.integers(1, 1000, (n_docs, n_terms)) * (1 + np.arange(n_terms)), 0)
    asked = r.random((n_items, n_terms)) < 0.3
    kth, best = np.sort(impact, axis=0)[-top], impact.max(axis=0)
    item, term = np.nonzero(asked)
    plan = lexical_search.Plan(item, term, n_items, np.ones(n_terms, np.int64), best, kth)
    pruned += len(plan.pruned_terms)
    doc, held = np.nonzero(present)
    whole = impact @ asked.T
    found = {(d, i): s for docs, items, scores in plan.scores(doc, held, impact[doc, held]) for d, i, s in zip(docs, items, scores, strict=True)}
    assert pruned > 20
    for i in range(n_items):
        want = sorted(whole[:, i][whole[:, i] > 0])[-top:]
        assert sorted(s for (_, k), s in found.items() if k == i)[-top:] == want
        assert all(whole[d, i] == s for (d, k), s in found.items() if k == i)


def test_search_of_nothing(spark):
    docs, items = corpus()
    assert lexical_search.search(frame(spark, docs), items_frame(spark, [])).count() == 0
    assert lexical_search.search(frame(spark, []), items_frame(spark, items)).count() == 0
    assert lexical_search.search(frame(spark, [(1, None)]), items_frame(spark, [(1, None), (2, "word")])).count() == 0
