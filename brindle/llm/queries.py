"""One query per operator, over the whole intended table with production parameters."""

from __future__ import annotations

from brindle.llm import decontamination, exact_dedup, language_id, lexical_search, license_scan, lm_scoring, minhash, mixing, packing, simhash, spelling, token_files, url_filter
from brindle.llm.base import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query("op1_url_filter")
def op1(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query("op2_lm_scoring")
def op2(spark, sf_dir):
    return lm_scoring.score_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_license_scan")
def op3(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op4_best_fit_packing")
def op4(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op5_document_fingerprints")
def op5(spark, sf_dir):
    return minhash.fingerprint_all(table(spark, sf_dir, "documents"))


@query("op6_language_id")
def op6(spark, sf_dir):
    return language_id.identify_all(table(spark, sf_dir, "documents"))


@query("op7_simhash_near_dedup")
def op7(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_source_mixing")
def op8(spark, sf_dir):
    """Every source at least once, none more than 1.5 times."""
    return mixing.mix_all(table(spark, sf_dir, "documents"), repetition_limit=1.5)


@query("op9_token_files")
def op9(spark, sf_dir):
    return token_files.round_trip(table(spark, sf_dir, "documents"))


@query("op10_exact_dedup", exact_dedup.SQL)
def op10(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op11_decontamination", decontamination.SQL)
def op11(spark, sf_dir):
    return decontamination.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_spelling_variants")
def op12(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op13_lexical_search", lexical_search.SQL)
def op13(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
