"""Notes of parts: running sums in ranges, results kept by content, a run that is killed goes on."""

import os

import pytest
from pyspark.sql import functions as F

from brindle.operators import budget


def test_running_sums(spark):
    rows = [(g, p * 3 - 7, (p * 7 + g) % 11) for g in range(3) for p in range(50)]
    got = budget.running(spark.createDataFrame(rows, "g int, p int, c int"), "g", "p", "c", width=16).collect()
    for r in got:
        own = sorted((p, c) for g, p, c in rows if g == r.g)
        assert r.upto == sum(c for p, c in own if p <= r.p) and r.total == sum(c for _, c in own)
    assert len(got) == len(rows)


def test_nothing_is_worked_out_twice(spark, tmp_path):
    calls, switch, cache = (str(tmp_path / n) for n in ("calls", "goes-on", "cache"))
    open(calls, "w").close()

    def note(text):
        if text == victim and not os.path.exists(switch):
            raise OSError("killed")
        with open(calls, "a") as f:
            f.write("note\n")
        return text[:40]

    def combine(text):
        with open(calls, "a") as f:
            f.write("combine\n")
        return text[: len(text) // 2]

    def made():
        return open(calls).read().count("note"), open(calls).read().count("combine")

    parts = spark.createDataFrame([(f"f{i % 3}", i, f"part {i} " + "word " * 30) for i in range(12)] + [("f0", 100, "part 0 " + "word " * 30)], "name string, part int, text string").repartition(4)
    block = F.pmod(F.xxhash64(F.sha2(F.concat_ws("|", F.lit("m|note"), F.lit(50), "text"), 256)), F.lit(3))
    victim = parts.select(F.max_by("text", block)).first()[0]  # of the last block
    plain = budget.summarised(parts, lambda t: t[:40], lambda t: t[: len(t) // 2], 60, 50, 1)
    want = sorted(map(tuple, plain.select("name", "part", "text").collect()))

    def run(**given):
        return sorted(map(tuple, budget.summarised(parts, note, combine, 60, 50, 1, cache=cache, **given).select("name", "part", "text").collect()))

    with pytest.raises(Exception, match="killed"):
        run(model="m", blocks=3)
    kept = spark.read.parquet(*[str(p) for p in (tmp_path / "cache").iterdir() if p.name.startswith("part-") and (p / "_SUCCESS").exists()]).count()
    wasted = made()[0] - kept  # of the block that failed
    assert kept > 0
    open(switch, "w").close()
    assert run(model="m", blocks=3) == want
    assert made()[0] == 12 + wasted  # 13 parts, two of them of one text
    seen = made()
    assert run(model="m", blocks=3) == want and made() == seen
    run(model="other", blocks=1)
    assert made()[0] == seen[0] + 12


def test_a_worker_holds_few_texts_at_once(spark):
    def note(text):
        import tracemalloc  # of the worker; what it held before its first text isn't counted

        if not tracemalloc.is_tracing():
            tracemalloc.start()
        most = tracemalloc.get_traced_memory()[1]
        if text.startswith("5999 "):
            tracemalloc.stop()
        return str(most)

    usual = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    parts = spark.range(0, 6000, 1, 1).select(F.lit("f").alias("name"), F.col("id").alias("part"), F.concat("id", F.lit(" "), F.repeat(F.lit("x"), 16000)).alias("text"))
    most = budget.summarised(parts, note, str, 10**9, 10**9).agg(F.count("*"), F.max(F.col("text").cast("long"))).first()
    assert most[0] == 6000 and most[1] < 16 << 20  # of 96 MB
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == usual


def test_without_parts(spark, tmp_path):
    none = spark.createDataFrame([], "name string, part int, text string")
    assert budget.summarised(none, str, str, 10, 10, cache=str(tmp_path / "c")).where(F.col("text").isNotNull()).count() == 0


def test_rounds_go_on_until_notes_fit(spark):
    """Against plain loops: files that need more than three rounds, one that fits at once, one without a name, a part without a text."""
    limit, together = 40, 60
    rows = [(f, i, None if i == 3 else " ".join(f"sentence {k} of part {i} {'matter ' * (k % 4)}." for k in range(6))) for f, n in (("long", 90), ("short", 4), (None, 40)) for i in range(n)]
    note, combine = (lambda t: budget.gist(t or "", len(t or "") // 4)), (lambda t: budget.gist(t, len(t) // 2))

    def tokens(text):
        digits = sum(c in "0123456789" for c in text)
        return int(((len(text) - digits) / 3.8 + digits / 2.2) * 1.1) + 1 if text else 0

    want, rounds = [], {}
    for f in ("long", "short", None):
        notes = [(i, note(t)) for g, i, t in rows if g == f]
        while sum(tokens(t) for _, t in notes) > limit:
            groups, upto = {}, 0
            for _, t in notes:
                upto += tokens(t)
                groups.setdefault((upto - 1) // together, []).append(t)
            notes = [(g, combine("\n\n".join(texts))) for g, texts in groups.items()]
            rounds[f] = rounds.get(f, 0) + 1
        want += [(f, i, t) for i, t in notes]
    assert rounds["long"] > 3 and "short" not in rounds
    got = budget.summarised(spark.createDataFrame(rows, "name string, part int, text string").repartition(5), note, combine, limit, together)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_rounds_end_where_nothing_gets_shorter(spark):
    parts = spark.createDataFrame([("f", i, f"part {i}") for i in range(9)] + [("g", 0, "brief")], "name string, part int, text string")
    got = budget.summarised(parts, lambda t: t, lambda t: t, 8, 10).collect()
    assert sorted(x for r in got for x in r.text.split("\n\n")) == ["brief", *(f"part {i}" for i in range(9))]  # nothing is cut off


def test_a_note_is_of_the_whole_text(spark, tmp_path):
    """What a text says most of counts wherever it stands, and every file's notes fit in the end."""
    from brindle.plans import budgets

    filler = " ".join(f"The {chr(97 + i % 26)}word{chr(97 + i // 26)} is it." for i in range(300))
    end = "Turbines turn turbines."
    assert end in budget.gist(f"First of all. {filler} {end} {end}", 60)
    assert budget.gist("", 0) == "" and budget.gist("漢" * 500, 100) == "漢" * 200
    docs = [(i, "s" if i % 9 else None, f"Document {i} begins. {filler} {end} {end}" if i else None) for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    files = budgets.notes(spark, str(tmp_path)).groupBy("name").agg(F.sum(budget.estimate(F.col("text"))).alias("n"), F.max(F.contains("text", F.lit("Turbines"))).alias("told")).collect()
    assert {r.name for r in files} == {"s", None} and all(0 < r.n <= 2000 and r.told for r in files)
