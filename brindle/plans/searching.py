"""Queries of the document index: keywords, BM25, vectors, fusion, upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brindle.catalog import table
from brindle.functions import values
from brindle.operators import chunk, corpus, search, stored_index
from brindle.plans.book import Book
from brindle.sources import stores

BOOK = Book()
query = BOOK.query

_STOP = ", ".join(f"'{w}'" for w in values.STOP_WORDS)
_TOKENS = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+')"


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("question"), "text")


def _index(spark, d, *updates) -> str:
    """A new index in the shared folder: of all documents, or made by updates (documents, ids to remove), one after another."""
    path = f"{stores.shared_dir(spark)}/index-{uuid.uuid4().hex}"
    for docs, removed in updates or [(table(spark, d, "documents"), None)]:
        stored_index.update(spark, path, docs, removed, "doc_id")
    return path


_KEYWORDS = rf"""SELECT item_id, CASE WHEN len(kept) > 0 THEN kept ELSE w END AS k FROM (SELECT item_id, w, list_filter(w, lambda x: x NOT IN ({_STOP})) AS kept
    FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') AS w FROM benchmark))"""

_BM25 = rf"""
WITH asked AS (SELECT DISTINCT item_id AS question, unnest(regexp_extract_all(strip_accents(array_to_string(k, ' ')), '[\p{{L}}\p{{N}}]+')) AS term FROM ({_KEYWORDS})),
docs AS (SELECT doc_id AS id, {_TOKENS} AS words FROM documents),
sizes AS (SELECT count(*) AS n_docs, avg(len(words)) AS mean_length FROM docs),
tf AS (SELECT id, term, count(*) AS tf, any_value(len) AS length FROM (SELECT id, len(words) AS len, unnest(words) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (SELECT question, id, round(sum(greatest(ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean_length))), 6) AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term), sizes GROUP BY question, id),
words AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS place FROM scored) WHERE place <= 30)
"""


@query("F38_keywords", f"SELECT item_id, array_to_string(list_distinct_ordered, ' ') AS keywords FROM (SELECT item_id, list_filter(k, lambda x, i: list_position(k, x) = i) AS list_distinct_ordered FROM ({_KEYWORDS}))")
def keywords(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(values.keywords(F.col("text")), " ").alias("keywords"))


@query("T05_bm25", f"{_BM25} SELECT question, id, score, place FROM words")
def bm25(spark, d):
    return stored_index.search(spark, _index(spark, d), _questions(spark, d))


_UPDATED = "(SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN 'revised: ' || coalesce(text, '') ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3)"


@query("T11_index_updates", _BM25.replace("FROM documents", f"FROM {_UPDATED}") + "SELECT question, id, score, place FROM words")
def index_updates(spark, d):
    """The ranking after an add, a replacement of every fifth document, and a removal of every seventh: that of the documents as they are then."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    revised = docs.where("doc_id % 5 = 2").withColumn("text", F.concat(F.lit("revised: "), F.coalesce("text", F.lit(""))))
    gone = docs.where("doc_id % 7 = 3").select(F.col("doc_id").alias("id"))
    path = _index(spark, d, (docs.where("doc_id % 3 = 0"), None), (docs, None), (revised.where("doc_id % 7 <> 3"), gone))
    return stored_index.search(spark, path, _questions(spark, d))


@query(
    "P06_keyword_match",
    rf"""SELECT doc_id FROM documents WHERE len(list_intersect({_TOKENS}, (SELECT {_TOKENS} FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)))) > 0""",
)
def keyword_match(spark, d):
    first = _questions(spark, d).orderBy("question").limit(1).select(search.tokens(F.col("text")).alias("asked"))
    docs = table(spark, d, "documents").select("doc_id", search.tokens(F.col("text")).alias("words"))
    return docs.join(F.broadcast(first), F.arrays_overlap("words", "asked")).select("doc_id")


@query(
    "T06_words_contained",
    """SELECT doc_id AS id, len(list_filter(['tion', 'license', 'éch', 'apache'], lambda w: contains(lower(text), w)))::BIGINT AS contained FROM documents""",
)
def words_contained(spark, d):
    """The words asked for are a question's keywords; the stop word goes."""
    return search.words_contained(table(spark, d, "documents"), F.lit("The tion license éch of Apache"))


@query(
    "T07_stand_in_vectors",
    rf"""SELECT item_id, list_transform(counts, lambda c: round(c / norm, 9)) AS vector FROM (SELECT item_id, counts, sqrt(list_sum(list_transform(counts, lambda c: c * c))) AS norm FROM
    (SELECT item_id, list_transform(range(64), lambda i: len(list_filter(b, lambda x: x = i))::DOUBLE) AS counts FROM
    (SELECT item_id, list_transform({_TOKENS}, lambda w: (('0x' || substr(md5(w), 31, 2))::INT) % 64) AS b FROM benchmark)))""",
)
def stand_in_vectors(spark, d):
    vector = search.stand_in_vector(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", F.transform(vector, lambda x: F.round(x, 9)).alias("vector"))


def _meaning(asked: str) -> str:
    """The nearest 30 of all vectors to each of the rows that are asked."""
    return f"""meaning AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS place FROM
(SELECT q.vec_id AS question, v.vec_id AS id, round(list_sum(list_transform(range(1, 65), lambda i: v.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE)), 6) AS score
FROM embeddings v, ({asked}) q)) WHERE place <= 30)"""


def _vector_questions(spark, d):
    """Every vector whose id is divisible by 100 is a question, against all vectors."""
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("question"), F.col("embedding").alias("vector"))


@query("T08_by_meaning", f"WITH {_meaning('SELECT * FROM embeddings WHERE vec_id % 100 = 0')} SELECT question, id, score, place FROM meaning")
def by_meaning(spark, d):
    return search.by_meaning(table(spark, d, "embeddings"), _vector_questions(spark, d))


@query(
    "T09_rank_fusion",
    f"""{_BM25}, {_meaning("SELECT embeddings.* FROM embeddings JOIN benchmark ON vec_id = item_id")},
    fused AS (SELECT coalesce(w.question, m.question) AS question, coalesce(w.id, m.id) AS id, w.place AS wp, m.place AS mp,
      coalesce(1 / (60 + w.place)::DOUBLE, 0) + coalesce(1 / (60 + m.place)::DOUBLE, 0) AS f
      FROM words w FULL JOIN meaning m ON w.question = m.question AND w.id = m.id)
    SELECT question, id, round(f * 1000, 2) AS score, CASE WHEN wp IS NOT NULL AND mp IS NOT NULL THEN 'both' WHEN wp IS NOT NULL THEN 'words' ELSE 'meaning' END AS matched_by, place
    FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(f, 12) DESC, wp IS NULL, coalesce(wp, mp), id) AS place FROM fused) WHERE place <= 6""",
)
def rank_fusion(spark, d):
    """The BM25 ranking of each benchmark text fused with the ranking by meaning of the vector that has its number."""
    words = stored_index.search(spark, _index(spark, d), _questions(spark, d))
    embeddings = table(spark, d, "embeddings")
    asked = embeddings.join(table(spark, d, "benchmark"), F.col("vec_id") == F.col("item_id")).select(F.col("vec_id").alias("question"), F.col("embedding").alias("vector"))
    meaning = search.by_meaning(embeddings, asked).select("question", "id", "place")
    return search.fuse(words, meaning)


@query("T11_fresh_documents", "SELECT doc_id::VARCHAR AS name, sha256(text) AS sha256 FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents o WHERE o.source < 'src5' AND sha256(o.text) = sha256(d.text) AND o.doc_id = d.doc_id)")
def fresh_documents(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), "text", "source")
    index = docs.where("source < 'src5'").select("name", F.sha2("text", 256).alias("sha256"))
    return corpus.fresh(index, docs.drop("source")).select("name", "sha256")


@query(
    "K07_upsert",
    """SELECT s_name AS name, s_acctbal AS balance FROM supplier WHERE s_name NOT IN (SELECT s_name FROM supplier WHERE s_nationkey < 5)
       UNION ALL SELECT s_name, 0.0::DOUBLE FROM supplier WHERE s_nationkey < 5""",
)
def upsert(spark, d):
    old = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), "s_nationkey")
    new = old.where("s_nationkey < 5").select("name", F.lit(0.0).alias("balance"))
    return corpus.upsert(old.drop("s_nationkey"), new)


@query("K08_set_vectors", "SELECT vec_id AS id, CASE WHEN label < 3 THEN list_transform(embedding, lambda x: 0.0::DOUBLE) ELSE list_transform(embedding, lambda x: x::DOUBLE) END AS vector FROM embeddings")
def set_vectors(spark, d):
    old = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    new = old.where("label < 3").select("id", F.transform("vector", lambda x: F.lit(0.0)).alias("vector"))
    return corpus.with_vectors(old.drop("label"), new)


@query(
    "T13_search_text",
    r"""SELECT conv_id, CASE WHEN len(regexp_extract_all(latest, '\S+')) < 6 AND previous IS NOT NULL THEN previous || ' ' || latest ELSE latest END AS search_text FROM
    (SELECT conv_id, text AS latest, lag(text) OVER w AS previous, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE role = 'user'
     WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE r = 1""",
)
def search_text(spark, d):
    from brindle.plans.relational import latest_questions

    short = F.size(F.regexp_extract_all("latest", F.lit(r"\S+"), F.lit(0))) < 6
    joined = F.when(short & F.col("previous").isNotNull(), F.concat_ws(" ", "previous", "latest")).otherwise(F.col("latest"))
    return latest_questions(spark, d).select("conv_id", joined.alias("search_text"))


@query("T01_chunks")
def chunks(spark, d):
    return chunk.chunks(table(spark, d, "documents").select("doc_id", "text"))


@query("T02_section_chunks")
def section_chunks(spark, d):
    """Conversations as documents whose sections are their turns."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("turn "), F.col("turn")).alias("label"), "text")))
    docs = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("name")).agg(F.transform(ordered, lambda x: F.struct(x["label"].alias("label"), x["text"].alias("text"))).alias("sections"))
    return chunk.section_chunks(docs, 500, 100)


@query("T03_line_chunks")
def line_chunks(spark, d):
    return chunk.line_chunks(table(spark, d, "documents"), "doc_id", size=1000)


@query("T12_reindex", "SELECT item_id, (item_id % 3 = 0)::INT AS had, 64::BIGINT AS dimensions FROM benchmark")
def reindex(spark, d):
    """A third of the passages has a vector; the others get one."""
    base = table(spark, d, "benchmark").select("item_id", "text", F.when(F.col("item_id") % 3 == 0, F.array_repeat(F.lit(0.125), 64)).alias("vector"))
    had = base.select("item_id", F.col("vector").isNotNull().cast("int").alias("had"))
    return corpus.reindexed(base, stale=False).join(had, "item_id").select("item_id", "had", F.size("vector").cast("long").alias("dimensions"))
