"""The registered queries of the reference's operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import rules as R
from docloom.functions import text as T
from docloom.functions import udfs as U
from docloom.operators import cells, chunking, cite, corpus, crawl, dialog, evaluation, search, service, session, stages
from docloom.scratch import Scratch
from docloom.session import ship_code
from docloom.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# DuckDB's form of the character classes
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NWS = "[^" + WS[1:]
STRIP = lambda x: f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"
WORDS = lambda x: f"regexp_extract_all({x}, '{NWS}+')"
TOKENS = lambda x: f"regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's texts as a batch of queries."""
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# ---- sparse, dense and fused retrieval

BM25_CTE = f"""
tok AS (SELECT doc_id, lang, unnest({TOKENS('text')}) AS term FROM documents),
tf AS (SELECT doc_id, lang, term, count(*) AS tf FROM tok GROUP BY ALL),
len AS (SELECT doc_id, len({TOKENS('text')}) AS n FROM documents),
df AS (SELECT term, count(*) AS df, (SELECT count(*) FROM documents) AS n FROM tf GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS r FROM df),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25::DOUBLE * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
ask AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOKENS('text')}) AS term FROM benchmark) x GROUP BY ALL),
hit AS (
  SELECT query_id, tf.doc_id, tf.lang, round(sum(times * idf * tf.tf * 2.5::DOUBLE / (tf.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len.n / (SELECT avg(n) FROM len)))), 6) AS score
  FROM tf JOIN ask USING (term) JOIN idf USING (term) JOIN len ON len.doc_id = tf.doc_id GROUP BY ALL)"""
BM25_TOP = "SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM hit{} QUALIFY rank <= {}"


_INDEXES: dict[tuple, search.Index] = {}


def bm25_index(spark, d) -> search.Index:
    """The inverted index of the documents, written once for an application and the files as they are."""
    docs = documents(spark, d)
    key = (spark.sparkContext.applicationId, d, *files.stamps(spark, docs))
    if key not in _INDEXES:
        _INDEXES[key] = search.build_index(docs)
    return _INDEXES[key]


@query(f"WITH {BM25_CTE} {BM25_TOP.format('', 10)}")
def bm25_topk(spark, d):
    return search.bm25(bm25_index(spark, d), questions(spark, d), 10)


@query(f"""WITH {BM25_CTE}, every AS (SELECT b.item_id AS query_id, d.doc_id, coalesce(h.score, 0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN hit h ON h.query_id = b.item_id AND h.doc_id = d.doc_id WHERE d.lang = 'de')
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM every QUALIFY rank <= 10""")
def bm25_filtered_topk(spark, d):
    return search.bm25(bm25_index(spark, d), questions(spark, d), 10, where=documents(spark, d).where("lang = 'de'"))


@query(f"""WITH tok AS (SELECT doc_id, unnest(list_distinct({TOKENS('text')})) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents),
raw AS (SELECT term, df, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS r FROM (SELECT term, count(*) AS df FROM tok GROUP BY term) x, n), mean AS (SELECT avg(r) AS m FROM raw)
SELECT term, df, round(CASE WHEN r < 0 THEN 0.25::DOUBLE * m ELSE r END, 6) AS idf FROM raw, mean""")
def bm25_idf_stats(spark, d):
    return bm25_index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def vector_questions(spark, d) -> DataFrame:
    """The stated queries: every vector whose id is divisible by 100."""
    return read(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "label")


DENSE_CTE = """
sim AS (SELECT q.vec_id AS query_id, v.vec_id, q.label AS ql, v.label AS vl, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
        FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)"""
DENSE_TOP = "SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM sim{} QUALIFY rank <= {}"


@query(f"WITH {DENSE_CTE} {DENSE_TOP.format('', 10)}")
def dense_topk(spark, d):
    return search.dense(read(spark, d, "embeddings"), vector_questions(spark, d), 10)


@query(f"WITH {DENSE_CTE} {DENSE_TOP.format(' WHERE ql = vl', 10)}")
def dense_filtered_topk(spark, d):
    return search.dense(read(spark, d, "embeddings"), vector_questions(spark, d), 10, same="label")


_CELLS: dict[tuple, cells.Cells] = {}


def vector_index(spark, d) -> cells.Cells:
    """The index of the embeddings, written once for an application and the files as they are."""
    rows = read(spark, d, "embeddings")
    key = (spark.sparkContext.applicationId, d, *files.stamps(spark, rows))
    if key not in _CELLS:
        dimension = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
        _CELLS[key] = cells.build(rows, Scratch(spark, "vector-index").path("index"), dimension, shared=["label"])
    return _CELLS[key]


@query(f"WITH {DENSE_CTE} {DENSE_TOP.format('', 10)}")
def dense_index_topk(spark, d):
    return cells.nearest(vector_index(spark, d), vector_questions(spark, d), 10)


@query(f"WITH {DENSE_CTE} {DENSE_TOP.format(' WHERE ql = vl', 10)}")
def dense_index_filtered_topk(spark, d):
    return cells.nearest(vector_index(spark, d), vector_questions(spark, d), 10, same="label")


@query("""SELECT count(*) AS vectors, count(*) FILTER (WHERE len(embedding) <> 64) AS bad_dimension,
  count(*) FILTER (WHERE sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) NOT BETWEEN 0.99 AND 1.01) AS bad_norm FROM embeddings""")
def dense_norm_check(spark, d):
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return read(spark, d, "embeddings").agg(F.count("*").alias("vectors"), F.count_if(F.size("embedding") != 64).alias("bad_dimension"), F.count_if(~norm.between(0.99, 1.01)).alias("bad_norm"))


def fused_hits(spark, d, k: int = 20) -> DataFrame:
    """Vectors and documents share ids by convention; a query is a vector, and the benchmark text of its id if there is one."""
    asked = vector_questions(spark, d)
    dense = search.dense(read(spark, d, "embeddings"), asked, k).withColumnRenamed("vec_id", "id")
    texts = questions(spark, d).join(asked.select("query_id"), "query_id", "left_semi")
    return search.fused(dense, search.bm25(bm25_index(spark, d), texts, k).withColumnRenamed("doc_id", "id"), k)


FUSED_CTE = f"""{BM25_CTE}, {DENSE_CTE},
dn AS ({DENSE_TOP.format('', 20)}), sp AS ({BM25_TOP.format(' WHERE query_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0)', 20)}),
dd AS (SELECT query_id, vec_id AS id, score, rank, CASE WHEN max(score) OVER q <= 0 THEN 0 ELSE score / max(score) OVER q END AS d FROM dn WINDOW q AS (PARTITION BY query_id)),
ss AS (SELECT query_id, doc_id AS id, score, rank, CASE WHEN max(score) OVER q <= 0 THEN 0 ELSE score / max(score) OVER q END AS s FROM sp WINDOW q AS (PARTITION BY query_id)),
f AS (SELECT coalesce(dd.query_id, ss.query_id) AS query_id, coalesce(dd.id, ss.id) AS id, coalesce(dd.score, 0) AS dense_score, coalesce(ss.score, 0) AS bm25_score,
        round(0.6::DOUBLE * coalesce(d, 0) + 0.4::DOUBLE * coalesce(s, 0), 6) AS hybrid_score, dd.rank AS dr, ss.rank AS sr
      FROM dd FULL JOIN ss ON ss.query_id = dd.query_id AND ss.id = dd.id),
fused AS (SELECT query_id, id, dense_score, bm25_score, hybrid_score,
        row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, dr ASC NULLS LAST, sr ASC NULLS LAST)::INTEGER AS rank FROM f QUALIFY rank <= 20)"""


@query(f"WITH {FUSED_CTE} SELECT * FROM fused")
def hybrid_fusion(spark, d):
    return fused_hits(spark, d)


@query(f"WITH {FUSED_CTE} SELECT query_id, id, round(d, 6) AS normalized FROM dd")
def hybrid_normalize(spark, d):
    hits = search.dense(read(spark, d, "embeddings"), vector_questions(spark, d), 20)
    return search.normalized(hits).select("query_id", F.col("vec_id").alias("id"), F.round("normalized", 6).alias("normalized"))


def hit_texts(spark, d) -> DataFrame:
    """BM25 hits with their texts, queries and source."""
    hits = search.bm25(bm25_index(spark, d), questions(spark, d), 20)
    texts = hits.join(documents(spark, d).select("doc_id", "text", "lang", "source"), "doc_id").join(questions(spark, d), "query_id")
    return Scratch(spark, "hit-texts").keep(texts, "texts")  # some plans read them several times


HIT_CTE = f"""{BM25_CTE}, top AS ({BM25_TOP.format('', 20)}),
hits AS (SELECT t.*, d.text, d.source, b.text AS query, d.lang FROM top t JOIN documents d ON d.doc_id = t.doc_id JOIN benchmark b ON b.item_id = t.query_id),
ov AS (SELECT *, list_distinct({TOKENS('query')}) AS q, list_distinct({TOKENS('text')}) AS t FROM hits),
re AS (SELECT *, CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, t))::DOUBLE / len(q), 6) ELSE 0 END AS final_score FROM ov),
rr AS (SELECT query_id, doc_id, score, rank, final_score, lang, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, rank)::INTEGER AS rank_after FROM re)"""


@query(f"WITH {HIT_CTE} SELECT query_id, doc_id, score, rank, final_score, rank_after FROM rr WHERE rank_after <= 5")
def rerank_overlap_topk(spark, d):
    return search.reranked(hit_texts(spark, d), search.overlap("query", "text"), 5).select("query_id", "doc_id", "score", "rank", "final_score", "rank_after")


@query(f"""WITH {HIT_CTE},
m AS (SELECT query_id, doc_id, rank, contains(lower(text), 'thing') OR contains(lower(text), 'tion of') AS c, contains(lower(query), 'thing') AS q FROM hits),
x AS (SELECT *, NOT q AND c AND max(CASE WHEN rank = 1 THEN c END) OVER (PARTITION BY query_id) AS moved FROM m)
SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY moved, rank)::INTEGER AS new_rank FROM x""")
def component_demotion(spark, d):
    """With words of the test texts as components."""
    hits = hit_texts(spark, d)
    out = search.demoted(hits, T.contains_any(F.lower("text"), ["thing", "tion of"]), T.contains_any(F.lower("query"), ["thing"]))
    return out.select("query_id", "doc_id", "rank", "new_rank")


@query(f"WITH {HIT_CTE}, m AS (SELECT query_id, doc_id, rank, source = 'src' || (query_id % 20) AS m FROM hits) SELECT query_id, doc_id, rank FROM m QUALIFY m OR NOT bool_or(m) OVER (PARTITION BY query_id)")
def filter_with_fallback(spark, d):
    hits = hit_texts(spark, d)
    return search.kept_or_all(hits, F.col("source") == F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))).select("query_id", "doc_id", "rank")


@query(f"""WITH {HIT_CTE} SELECT query_id, count(*) AS passage_count, array_to_string(list_slice(list(score ORDER BY score DESC), 1, 5), ',') AS top_5_before,
  array_to_string(list_slice(list(final_score ORDER BY final_score DESC), 1, 5), ',') AS top_5_after, max(score) AS max_before, max(final_score) AS max_after FROM rr WHERE rank_after <= 10 GROUP BY query_id""")
def retrieval_trace(spark, d):
    hits = search.reranked(hit_texts(spark, d), search.overlap("query", "text"), 10)
    shown = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return search.trace(hits, "score", "final_score").withColumns({c: shown(c) for c in ("top_5_before", "top_5_after")})


@query(f"""WITH {HIT_CTE}, s AS (SELECT query_id, max(final_score) AS m, count(*) FILTER (WHERE final_score > 0.5) AS h FROM rr WHERE rank_after <= 5 GROUP BY query_id)
SELECT b.item_id AS query_id, m IS NULL OR m < 0.6 AS refuse, CASE WHEN m IS NULL THEN 'No passages retrieved' WHEN m < 0.6 THEN 'Low confidence' ELSE '' END AS reason,
  coalesce(h, 0) AS high_count, coalesce(h, 0) < 2 AS refuse_by_count FROM benchmark b LEFT JOIN s ON s.query_id = b.item_id""")
def refusal_gate(spark, d):
    hits = search.reranked(hit_texts(spark, d), search.overlap("query", "text"), 5)
    return search.refusal(questions(spark, d), hits, threshold=0.6)


# ---- evaluation

JUDGED_SQL = f"""{HIT_CTE},
v AS (SELECT *, CASE WHEN query_id % 5 = 0 THEN doc_id <= 300 ELSE lang = 'en' END AS rel FROM rr WHERE query_id % 7 <> 0),
a AS (SELECT query_id, rank, rel FROM v), b AS (SELECT query_id, rank_after AS rank, rel FROM v WHERE rank_after <= 5),
j AS (SELECT 'bm25' AS method, * FROM a UNION ALL SELECT 'reranked', * FROM b),
p AS (SELECT method, query_id, max((rel AND rank <= 5)::INTEGER) AS recall_at_5, max((rel AND rank <= 20)::INTEGER) AS recall_at_20, round(coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE rel), 0), 6) AS reciprocal_rank FROM j GROUP BY ALL)"""


def judged(spark, d) -> DataFrame:
    """Relevance by ids for every fifth query, else by category, the language standing in for it; every
    seventh query counts as unanswerable."""
    q = F.col("query_id")
    ids = F.when(q % 5 == 0, F.sequence(F.lit(0).cast("bigint"), F.lit(300).cast("bigint")))
    items = questions(spark, d).select("query_id", ids.alias("relevant_ids"), F.lit("en").alias("expected_category"), F.when(q % 7 == 0, False).alias("answerable"))
    items = evaluation.evaluable(items)
    hits = hit_texts(spark, d).withColumnRenamed("doc_id", "id").withColumnRenamed("lang", "category")
    after = search.reranked(hits, search.overlap("query", "text"), 5).drop("rank").withColumnRenamed("rank_after", "rank")
    per = lambda h, m: evaluation.metrics(evaluation.relevant(h, items)).withColumn("method", F.lit(m))
    return per(hits, "bm25").unionByName(per(after, "reranked"))


@query(f"WITH {JUDGED_SQL} SELECT * FROM p")
def recall_and_rank(spark, d):
    return judged(spark, d)


@query(f"""WITH {JUDGED_SQL}, m AS (SELECT method, round(avg(recall_at_5), 6) AS r5, round(avg(reciprocal_rank), 6) AS mrr FROM p GROUP BY method)
SELECT max(mrr) FILTER (WHERE method = 'bm25') AS mrr_before, max(mrr) FILTER (WHERE method = 'reranked') AS mrr_after,
  round(max(mrr) FILTER (WHERE method = 'reranked') - max(mrr) FILTER (WHERE method = 'bm25'), 6) AS mrr_lift,
  round(max(r5) FILTER (WHERE method = 'reranked') - max(r5) FILTER (WHERE method = 'bm25'), 6) AS recall_lift FROM m""")
def metric_lift(spark, d):
    m = evaluation.means(judged(spark, d), ["method"])
    of = lambda c, x: F.max(F.when(F.col("method") == x, F.col(c)))
    lift = lambda c: F.round(of(c, "reranked") - of(c, "bm25"), 6)
    return m.agg(of("reciprocal_rank", "bm25").alias("mrr_before"), of("reciprocal_rank", "reranked").alias("mrr_after"), lift("reciprocal_rank").alias("mrr_lift"), lift("recall_at_5").alias("recall_lift"))


@query("WITH e(lang, expected) AS (VALUES ('en', 620::BIGINT), ('fr', 145), ('it', 5)) SELECT e.lang, expected, count(d.doc_id) AS n, count(d.doc_id) = expected AS ok FROM e LEFT JOIN documents d ON d.lang = e.lang GROUP BY e.lang, expected")
def golden_counts(spark, d):
    expected = spark.sql("SELECT * FROM VALUES ('en', 620L), ('fr', 145L), ('it', 5L) AS t(lang, expected)")
    return evaluation.count_check(documents(spark, d).groupBy("lang").agg(F.count("*").alias("n")), expected, "lang")


@query("SELECT sha256(text) AS content_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return evaluation.duplicate_keys(documents(spark, d).select(T.content_hash("text").alias("content_hash")), "content_hash")


@query(f"""WITH i AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'unanswerable' WHEN 1 THEN 'multi_hop' WHEN 2 THEN 'temporal' ELSE 'other' END AS c, CASE WHEN item_id % 3 = 0 THEN 0 ELSE 1 END AS n, CASE WHEN item_id % 5 = 0 THEN 'x' ELSE 'dev' END AS split, len({WORDS('text')}) AS w FROM benchmark)
SELECT item_id, array_to_string(list_filter([CASE WHEN split = 'x' THEN 'invalid split' END, CASE WHEN c = 'other' THEN 'invalid category' END, CASE WHEN n > 0 AND w > 25 THEN 'quote too long' END,
  CASE WHEN c = 'unanswerable' AND n > 0 THEN 'unanswerable with sources' END, CASE WHEN c = 'unanswerable' AND n > 0 THEN 'unanswerable with quotes' END, CASE WHEN c = 'unanswerable' THEN 'unanswerable without searched terms' END,
  CASE WHEN c <> 'unanswerable' AND n = 0 THEN 'answerable without sources' END, CASE WHEN c <> 'unanswerable' AND n = 0 THEN 'answerable without quotes' END,
  CASE WHEN c = 'multi_hop' THEN 'multi-hop with under two sources' END, CASE WHEN c = 'multi_hop' THEN 'multi-hop with under two quotes' END], lambda x: x IS NOT NULL), '; ') AS problems FROM i""")
def item_validation(spark, d):
    """Items made of the benchmark's texts, some of them wrong."""
    i = F.col("item_id")
    category = F.when(i % 4 == 0, "unanswerable").when(i % 4 == 1, "multi_hop").when(i % 4 == 2, "temporal").otherwise("other")
    none = F.array().cast("array<string>")
    rows = read(spark, d, "benchmark").select("item_id", category.alias("category"), F.when(i % 5 == 0, "x").otherwise("dev").alias("split"), none.alias("searched_terms"),
        F.when(i % 3 == 0, none).otherwise(F.array(F.lit("u"))).alias("source_urls"), F.when(i % 3 == 0, none).otherwise(F.array("text")).alias("evidence_quotes"))
    return rows.select("item_id", F.array_join(evaluation.item_problems(), "; ").alias("problems"))


# ---- texts

TEST_SAFETY: R.Rules = [("electrical", ["shand", "etion"]), ("gas", ["erheit", "ingth"])]


def on_text(name: str, value: Callable[[], Column], sql: str) -> None:
    def run(spark, d):
        return documents(spark, d).select("doc_id", value().alias("value"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT doc_id, {sql} AS value FROM documents"


BLANK = "regexp_replace({}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
PLAIN = "replace(replace(replace(replace(replace(replace(replace({}, '‘', ''''), '’', ''''), '“', '\"'), '”', '\"'), '–', '-'), '—', '-'), '…', '...')"
SPACED = "regexp_replace(regexp_replace(replace(replace({}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+', ' ', 'g'), '\\n[ \\t]+', chr(10), 'g')"
on_text("word_count", lambda: F.size(T.words("text")).cast("long"), f"len({WORDS('text')})::BIGINT")
on_text("shingles_count", lambda: F.size(T.shingles("text")).cast("long"), f"(SELECT len(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) FROM (SELECT {WORDS('lower(text)')} AS w) x)::BIGINT")
on_text("content_hash", lambda: T.content_hash("text"), "sha256(text)")
on_text("chunk_ids", lambda: T.chunk_id("source", "lang", "doc_id"), "substr(sha256(source || '|' || lang || '|' || doc_id), 1, 16)")
on_text("normalize_whitespace", lambda: T.plain_space("text"), STRIP(BLANK.format(SPACED.format("text"))))
on_text("punctuation_map", lambda: T.plain_punctuation("text"), PLAIN.format("text"))
on_text("boilerplate_strip", lambda: T.without_boilerplate("text"), STRIP(BLANK.format("array_to_string(list_filter(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'), lambda l: NOT regexp_matches(" + STRIP("l") + ", '^(?i)(was this (article|page) helpful.*|©\\s*\\d{4}.*all rights reserved.*|cookie (settings|policy).*|skip to (main )?content.*)$')), chr(10))")))
on_text("linebreak_repair", lambda: T.joined_lines("text"), f"""(SELECT string_agg(CASE WHEN i = 1 THEN p[i] WHEN p[i - 1] <> '' AND NOT regexp_matches(p[i - 1], '[.:!?|]{WS}*$') AND regexp_matches(p[i], '^\\p{{Ll}}') THEN ' ' || p[i] ELSE chr(10) || p[i] END, '' ORDER BY i)
  FROM (SELECT string_split(text, chr(10)) AS p) x, unnest(range(1, len(p) + 1)) u(i))""")
on_text("line_dedupe", lambda: T.distinct_blocks("text", "\n"), f"""(SELECT coalesce(string_agg(p[i], chr(10) ORDER BY i), '') FROM (SELECT string_split(text, chr(10)) AS p) x, (SELECT list_transform(string_split(text, chr(10)), lambda l: {STRIP('l')}) AS b) y, unnest(range(1, len(p) + 1)) u(i)
  WHERE b[i] LIKE '#%' OR b[i] LIKE '|%' OR length(b[i]) < 3 OR list_position(b, b[i]) = i)""")
on_text("heading_path", lambda: T.heading_path("text"), "array_to_string(list_transform(list_slice(list_filter(string_split(text, chr(10)), lambda l: l LIKE '#%'), 1, 3), lambda h: " + STRIP("regexp_replace(h, '^#+', '')") + "), ' > ')")
on_text("table_flag", lambda: F.contains("text", F.lit("|---")), "contains(text, '|---')")
PAGE_TYPE = lambda: F.when(F.col("doc_id") % 2 == 0, "how_to")
HEADING = lambda: F.when(F.col("doc_id") % 3 == 0, "a > b").otherwise("")
TITLED = lambda x: f"upper({x}[1]) || lower({x}[2:])"
on_text("metadata_prefix", lambda: T.metadata_prefix("source", "lang", PAGE_TYPE(), HEADING(), "text"),
    f"'Brand: ' || {TITLED('source')} || ' | Appliance: ' || {TITLED('lang')} || CASE WHEN doc_id % 2 = 0 THEN ' | Support Type: How To' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN ' | Section: a > b' ELSE '' END || chr(10) || chr(10) || text")
on_text("embed_text_template", lambda: T.embed_text("source", "lang", PAGE_TYPE(), HEADING(), "text"),
    "'Title: ' || coalesce(source, '') || chr(10) || 'Appliance: ' || coalesce(lang, '') || chr(10) || 'Page Type: ' || CASE WHEN doc_id % 2 = 0 THEN 'how_to' ELSE 'general_support' END || chr(10) || 'Heading: ' || CASE WHEN doc_id % 3 = 0 THEN 'a > b' ELSE '' END || chr(10) || 'Content: ' || coalesce(text, '')")
on_text("safety_referral", lambda: R.referral(R.safety("text", TEST_SAFETY)),
    "CASE WHEN contains(lower(text), 'shand') OR contains(lower(text), 'etion') THEN 'Please contact a qualified electrician or our support team.' WHEN contains(lower(text), 'erheit') OR contains(lower(text), 'ingth') THEN 'Please contact a qualified technician or our support team immediately.' ELSE 'Please contact our support team.' END")
on_text("sentence_count", lambda: F.size(cite.sentences("text")).cast("long"), "len(string_split(regexp_replace(text, '([.!?])[ \\t-\\r]+', '\\1' || chr(1), 'g'), chr(1)))::BIGINT")


@query()
def nfkc_normalize(spark, d):
    return documents(spark, d).select("doc_id", U.nfkc(T.plain_punctuation("text")).alias("value"))


@query("SELECT page_id, substr(sha256(url), 1, 16) AS url_hash, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, CASE WHEN regexp_matches(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), 'dishwasher') THEN 'dishwasher' WHEN regexp_matches(lower(url), 'refrigerator|freezer') THEN 'refrigerator' WHEN regexp_matches(lower(url), 'washer|laundry|dryer') THEN 'washer' ELSE '' END AS category, CASE WHEN contains(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/en/') THEN 'english' WHEN contains(url, '/de/') THEN 'german' ELSE '' END AS path_class, string_split(url, '#')[1] AS no_fragment FROM pages")
def url_parts(spark, d):
    """P1, P4 and P5: also the category rule with segments of the test URLs."""
    pages = read(spark, d, "pages")
    return pages.select("page_id", T.url_hash("url").alias("url_hash"), F.parse_url("url", F.lit("HOST")).alias("host"), R.url_category("url").alias("category"), R.url_category("url", [("english", ["/en/"]), ("german", ["/de/"])]).alias("path_class"), F.split_part("url", F.lit("#"), F.lit(1)).alias("no_fragment"))


@query()
def link_filter(spark, d):
    pages = read(spark, d, "pages")
    links = pages.select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.posexplode(U.page_links("html", "url")).alias("pos", "link"))
    kept = links.withColumn("followed", R.followed_link(F.col("host"), F.col("link"), "washer"))
    return kept.groupBy("page_id", "link").agg(F.min("pos").alias("first_seen"), F.max("followed").alias("followed"))


@query()
def crawl_pages(spark, d):
    """A crawl of each host from its first two pages. The table answers; a page links to what its HTML
    does, most of which is not there, and then to the next three pages of its host."""
    pages = read(spark, d, "pages").withColumn("host", crawl.host_of("url"))
    place = F.row_number().over(Window.partitionBy("host").orderBy("page_id"))
    placed = Scratch(spark, "site").keep(pages.select("host", "url", place.alias("n")), "placed")
    seeds = placed.where("n <= 2").select(F.col("host").alias("brand"), F.lit("all").alias("category"), F.col("n").cast("long").alias("turn"), "url")
    nexts = placed.select("url", "host", "n").withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3))))).select(F.col("url").alias("from"), "host", (F.col("n") + F.col("k")).alias("n"), "k")
    nexts = nexts.join(placed.select("host", "n", F.col("url").alias("link")), ["host", "n"]).select("from", F.col("k") + 1_000_000, "link").toDF("from", "pos", "link")

    def follow(rows):
        more = rows.join(nexts, rows["url"] == nexts["from"]).select("brand", "category", "visit", "pos", "link")
        return crawl.links_on()(rows).select("brand", "category", "visit", "pos", "link").unionByName(more)

    return crawl.crawl(seeds, crawl.from_table(pages), follow).drop("content")


TEST_TYPES: R.Rules = [("error_code", ["thess", "ndinhe"]), ("installation", ["tion of", "que le"]), ("parts", ["und der", "edth"])]
TEST_LATE: R.Rules = [("usage", ["re the", "los"])]
CASES = lambda x, rules, other: "CASE " + " ".join("WHEN " + " OR ".join(f"contains({x}, '{k}')" for k in ks) + f" THEN '{label}'" for label, ks in rules) + f" ELSE {other} END"
QUOTED = lambda rules: [(label, [k.replace("'", "''") for k in ks]) for label, ks in rules]


@query(f"""WITH x AS (SELECT doc_id, lower(source) || ' ' || lower(lang) || ' ' || substr(lower(text), 1, 1000) AS t FROM documents)
SELECT doc_id, coalesce({CASES('t', TEST_TYPES, 'NULL')}, CASE WHEN doc_id % 7 = 0 THEN 'manual' END, {CASES('t', TEST_LATE, "'general_support'")}) AS support_type,
  coalesce({CASES('t', QUOTED(R.SUPPORT_TYPES), 'NULL')}, CASE WHEN doc_id % 7 = 0 THEN 'manual' END, {CASES('t', R.SUPPORT_TYPES_LATE, "'general_support'")}) AS default_type FROM x""")
def support_type(spark, d):
    """The rule classifier with words of the test texts, and with the default table."""
    pdf = F.col("doc_id") % 7 == 0
    return documents(spark, d).select("doc_id", R.support_type("source", "lang", "text", pdf, TEST_TYPES, TEST_LATE).alias("support_type"), R.support_type("source", "lang", "text", pdf).alias("default_type"))


SPACED_TEXT = "' ' || regexp_replace(lower(text), '[^\\p{L}\\p{N}]', ' ', 'g') || ' '"


@query(f"""SELECT doc_id, {CASES('lower(text)', TEST_SAFETY, 'NULL')} AS safety, {CASES('lower(text)', R.SAFETY, 'NULL')} AS default_safety, {CASES('lower(text)', R.TEXT_CATEGORIES, 'NULL')} AS category,
  {CASES(SPACED_TEXT, R.BRANDS, 'NULL')} AS brand, CASE WHEN regexp_matches(text, '(?i)\\b(the|of)\\b') THEN 'english' WHEN regexp_matches(text, '(?i)\\b(und|der)\\b') THEN 'german' END AS client_category FROM documents""")
def safety_brand_category(spark, d):
    return documents(spark, d).select("doc_id", R.safety("text", TEST_SAFETY).alias("safety"), R.safety("text").alias("default_safety"), R.category("text").alias("category"), R.brand("text").alias("brand"), R.whole_word_category("text", [("english", ["the", "of"]), ("german", ["und", "der"])]).alias("client_category"))


# ---- chunks

FIXED_CTE = f"""
w AS (SELECT doc_id, source, {WORDS('text')} AS w FROM documents),
c AS (SELECT doc_id, source, w, unnest(range(0, greatest(ceil((len(w) - 300) / 255.0), 0)::BIGINT + 1)) AS k FROM w WHERE len(w) > 0),
fixed AS (SELECT doc_id, k::INTEGER AS chunk_index, array_to_string(w[k * 255 + 1:k * 255 + 300], ' ') AS chunk_text, substr(sha256(source || '|fixed|' || k), 1, 16) AS chunk_id, 'fixed' AS strategy FROM c)"""


@query(f"WITH {FIXED_CTE} SELECT * FROM fixed")
def fixed_chunks(spark, d):
    return chunking.fixed_chunks(documents(spark, d).select("doc_id", "source", "text"), F.col("source")).select("doc_id", "chunk_index", "chunk_text", "chunk_id", "strategy")


@query(f"WITH {FIXED_CTE}, n AS (SELECT len({WORDS('chunk_text')}) AS n FROM fixed) SELECT count(*) AS chunks, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, median(n) AS median, round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.75), 6) AS p75, round(quantile_cont(n, 0.95), 6) AS p95, round(stddev_samp(n), 4) AS sd FROM n")
def chunk_length_stats(spark, d):
    n = fixed_chunks(spark, d).select(F.size(T.words("chunk_text")).cast("long").alias("n"))
    return n.agg(F.count("*").alias("chunks"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), *(F.round(F.percentile("n", F.lit(p / 100)), 6).alias(f"p{p}") for p in (25, 75, 95)), F.round(F.stddev("n"), 4).alias("sd"))


HEADING_LINE = r"'^(#{1,6})\s+(.*)'"


@query(f"""WITH l AS (SELECT doc_id, source, unnest(range(len(p))) AS pos, unnest(p) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS p FROM documents) x),
h AS (SELECT doc_id, pos, [length(regexp_extract(line, {HEADING_LINE}, 1))::VARCHAR, {STRIP(f"regexp_extract(line, {HEADING_LINE}, 2)")}] AS h FROM l WHERE regexp_matches(line, {HEADING_LINE})),
g AS (SELECT doc_id, list(h ORDER BY pos) AS hs, list(pos ORDER BY pos) AS ps FROM h GROUP BY doc_id),
k AS (SELECT doc_id, hs, ps, unnest(range(1, len(hs) + 1)) AS k FROM g),
hp AS (SELECT doc_id, ps[k] AS pos, array_to_string(list_reduce(list_concat([[]::VARCHAR[]], hs[1:k]), lambda acc, y: list_append(acc[1:y[1]::INTEGER - 1], y[2])), ' > ') AS path FROM k),
lp AS (SELECT l.*, coalesce(last_value(hp.path IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.pos ROWS UNBOUNDED PRECEDING), 'Untitled') AS path FROM l LEFT JOIN hp ON hp.doc_id = l.doc_id AND hp.pos = l.pos),
s AS (SELECT doc_id, source, path, min(pos) AS f, {STRIP("string_agg(line, chr(10) ORDER BY pos)")} AS t FROM lp GROUP BY doc_id, source, path),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f) - 1 AS section FROM s),
w AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY section) = 1 OR len({WORDS('t')}) >= 22 THEN 1 ELSE 0 END AS st FROM n WHERE t <> ''),
m AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY section) AS grp FROM w),
q AS (SELECT doc_id, source, min(section) AS section, arg_min(path, section) AS path, string_agg(t, chr(10) ORDER BY section) AS t FROM m GROUP BY doc_id, source, grp),
i AS (SELECT *, substr(sha256(source || '|' || path || '|' || section), 1, 16) AS id, {WORDS('t')} AS words FROM q),
c AS (SELECT *, unnest(range(0, greatest(ceil((len(words) - 300) / 255.0), 0)::BIGINT + 1)) AS k FROM i WHERE len(words) > 384)
SELECT doc_id, id AS chunk_id, path AS heading_path, t AS chunk_text, 'structure_aware' AS strategy FROM i WHERE len(words) <= 384
UNION ALL SELECT doc_id, id || '__sub' || k, path, array_to_string(words[k * 255 + 1:k * 255 + 300], ' '), 'structure_aware' FROM c""")
def structure_chunks(spark, d):
    return chunking.structure_chunks(documents(spark, d), "source").drop("place")


# ---- deduplication, manifests, sets

@query("SELECT doc_id, sha256(text) AS content_hash FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def exact_dedup(spark, d):
    rows = documents(spark, d).select("doc_id", T.content_hash("text").alias("content_hash"))
    return corpus.first_of_each(rows, F.col("content_hash"), F.col("doc_id"))


NEAR_ALL = f"""
w AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, {WORDS('lower(text)')} AS w FROM documents),
s AS (SELECT doc_id, rn, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.rn AS ra, b.rn AS rb, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND b.rn > a.rn GROUP BY ALL),
far AS (SELECT a, b, ra, rb, round(c::DOUBLE / (x.n + y.n - c), 6) AS jaccard FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c))"""


@query(f"WITH {NEAR_ALL.replace('b.rn > a.rn', 'b.rn > a.rn AND b.rn - a.rn <= 50')} SELECT a, b, jaccard FROM far")
def near_dup_pairs(spark, d):
    return corpus.near_pairs(documents(spark, d))


@query(f"""WITH RECURSIVE {NEAR_ALL},
l AS MATERIALIZED (SELECT d.rn, d.doc_id, coalesce(x.near, []) AS near FROM w d LEFT JOIN (SELECT rb, list(ra) AS near FROM far GROUP BY rb) x ON x.rb = d.rn),
st(rn, id, kept) AS (
  SELECT 0::BIGINT, NULL::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT l.rn, l.doc_id, CASE WHEN len(list_intersect(st.kept, l.near)) > 0 THEN st.kept ELSE list_concat(st.kept, [l.rn])[-50:] END FROM st JOIN l ON l.rn = st.rn + 1)
SELECT id, list_contains(kept, rn) AS kept FROM st WHERE rn > 0""")
def near_dup_survivors(spark, d):
    return corpus.near_survivors(documents(spark, d))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def manifest_anti_join(spark, d):
    manifest = read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "ok").otherwise("failed").alias("status"))
    return corpus.not_done(documents(spark, d).select("doc_id", "source"), manifest, "doc_id")


@query("SELECT doc_id, quality, doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') AS has_parent FROM labels")
def orphan_semi_join(spark, d):
    labels, parents = read(spark, d, "labels").select("doc_id", "quality"), documents(spark, d).where("lang = 'en'")
    kept = corpus.with_parent(labels, parents, "doc_id").withColumn("has_parent", F.lit(True))
    return kept.unionByName(corpus.orphans(labels, parents, "doc_id").withColumn("has_parent", F.lit(False)))


@query("SELECT doc_id, lang AS strategy, n_chars FROM documents WHERE lang <> 'fr' UNION ALL SELECT doc_id, 'fr', quality FROM labels")
def strategy_replace(spark, d):
    table = documents(spark, d).select("doc_id", F.col("lang").alias("strategy"), "n_chars")
    new = read(spark, d, "labels").select("doc_id", F.lit("fr").alias("strategy"), F.col("quality").cast("long").alias("n_chars"))
    return corpus.replaced(table, new, "fr")


@query("SELECT source, min(doc_id) AS first_seen FROM documents GROUP BY source")
def first_seen_distinct(spark, d):
    return corpus.first_seen(documents(spark, d), "source", "doc_id")


@query("SELECT doc_id, n_chars AS v FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, quality FROM labels")
def upsert(spark, d):
    return corpus.upserted(documents(spark, d).select("doc_id", F.col("n_chars").alias("v")), read(spark, d, "labels").select("doc_id", F.col("quality").cast("long").alias("v")), "doc_id")


# ---- dialog

HISTORY_CTE = "h AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id)"


def conversation_rows(spark, d) -> DataFrame:
    return dialog.histories(read(spark, d, "conversations"))


@query(f"""WITH {HISTORY_CTE} SELECT conv_id, array_to_string(list_transform(list_filter(m[-6:], lambda x: {STRIP('x.t')} <> ''), lambda x: upper(x.r[1]) || x.r[2:] || ': ' || {STRIP('x.t')}), chr(10)) AS history,
  len(list_filter(m, lambda x: x.r = 'assistant'))::INTEGER AS assistant_turns FROM h""")
def history_format(spark, d):
    return conversation_rows(spark, d).select("conv_id", dialog.history_text(F.col("history")).alias("history"), dialog.assistant_turns(F.col("history")).alias("assistant_turns"))


@query(f"""WITH {HISTORY_CTE}, p AS (SELECT conv_id, m[-1].t AS q, list_transform(list_filter(m[:len(m) - 1], lambda x: x.r IN ('user', 'assistant')), lambda x: CASE WHEN x.r = 'user' THEN 'User: ' || x.t ELSE 'Assistant: ' || CASE WHEN length(x.t) > 100 THEN substr(x.t, 1, 100) || '...' ELSE x.t END END) AS parts FROM h)
SELECT conv_id, CASE WHEN len(parts) > 0 THEN q || '. Context: ' || array_to_string(parts[-3:], ' | ') ELSE q END AS query FROM p""")
def context_rewrite(spark, d):
    h = F.col("history")
    return conversation_rows(spark, d).select("conv_id", dialog.context_query(F.element_at(h, -1)["text"], h).alias("query"))


TEST_TABLES = {"categories": [("a", ["thth", "heit"]), ("b", ["ndre", "que"])], "brands": [("x", ["the", "und"])], "topics": ["tion", "und"], "problems": ["re the", "le la"], "safety": [("s", ["ingth", "eau"])]}
GATE_SQL = f"""{HISTORY_CTE},
q AS (SELECT conv_id, m[-1].t AS q, m[:len(m) - 1] AS hist, len(m) AS n FROM h),
x AS (SELECT *, array_to_string(list_transform(hist, lambda x: x.t), ' ') AS ht, {CASES('lower(q)', TEST_TABLES['categories'], 'NULL')} AS cat,
  len({WORDS('q')}) >= 3 AND (contains(lower(q), 'tion') OR contains(lower(q), 'und') OR contains(lower(q), 're the') OR contains(lower(q), 'le la')) AS words FROM q),
y AS (SELECT *, cat IS NOT NULL AND words AS topic, coalesce(cat <> {CASES('lower(ht)', TEST_TABLES['categories'], 'NULL')}, false) AS changed FROM x),
z AS (SELECT *, CASE WHEN topic AND changed THEN [] ELSE hist END AS hh, CASE WHEN topic AND changed THEN q || ' ' ELSE q || ' ' || ht END AS whole FROM y)"""


@query(f"WITH {GATE_SQL} SELECT conv_id, topic, changed, cat IS NOT NULL AND (contains(lower(q), 're the') OR contains(lower(q), 'le la')) AS issue FROM z")
def topic_gate(spark, d):
    h = F.col("history")
    rows = conversation_rows(spark, d).select("conv_id", F.element_at(h, -1)["text"].alias("q"), dialog.all_text(F.slice(h, 1, F.size(h) - 1)).alias("ht"))
    t = TEST_TABLES
    return rows.select("conv_id", R.new_topic("q", t["categories"], t["topics"], t["problems"]).alias("topic"), R.changes_category("q", "ht", t["categories"]).alias("changed"), R.new_issue("q", t["categories"], t["problems"]).alias("issue"))


@query(f"""WITH {GATE_SQL} SELECT conv_id, CASE WHEN topic AND len(hh) = 0 THEN 'need_specifications'
  WHEN {CASES('lower(whole)', TEST_TABLES['categories'], 'NULL')} IS NOT NULL AND {CASES("' ' || regexp_replace(lower(whole), '[^\\p{L}\\p{N}]', ' ', 'g') || ' '", TEST_TABLES['brands'], 'NULL')} IS NULL THEN 'need_brand'
  WHEN conv_id % 11 = 0 THEN 'no_passages' WHEN contains(lower(q), 'ingth') OR contains(lower(q), 'eau') THEN 'safety'
  WHEN (conv_id % 10) / 10.0 < 0.2 AND len(list_filter(hh, lambda x: x.r = 'assistant')) = 0 THEN 'low_confidence' ELSE 'answer' END AS decision FROM z""")
def answer_decision(spark, d):
    """Passages and scores stand in for a retrieval's."""
    h, c = F.col("history"), F.col("conv_id")
    rows = conversation_rows(spark, d).select("conv_id", F.element_at(h, -1)["text"].alias("query"), F.slice(h, 1, F.size(h) - 1).alias("history"), F.when(c % 11 == 0, 0).otherwise(5).alias("passages"), ((c % 10) / 10.0).alias("best_score"))
    return dialog.decision(rows, TEST_TABLES).select("conv_id", "decision")


# ---- citations

@query(f"""WITH a AS (SELECT conv_id AS query_id, text AS answer FROM conversations WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
s AS (SELECT query_id, unnest(range(len(p))) AS sentence_no, unnest(p) AS claim FROM (SELECT query_id, string_split(regexp_replace(answer, '([.!?])[ \\t-\\r]+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM a) x),
w AS (SELECT *, list_distinct({WORDS('lower(claim)')}) AS w FROM s WHERE len({WORDS('lower(claim)')}) >= 3),
p AS (SELECT conv_id AS query_id, turn AS passage_rank, list_distinct({WORDS('lower(text)')}) AS t FROM conversations),
c AS (SELECT w.query_id, sentence_no, claim, passage_rank, round(len(list_intersect(w, t))::DOUBLE / (len(w) + 1), 6) AS score FROM w JOIN p ON p.query_id = w.query_id)
SELECT query_id, sentence_no::INTEGER AS sentence_no, claim, passage_rank, score FROM c WHERE score > 0.3 QUALIFY row_number() OVER (PARTITION BY query_id, sentence_no ORDER BY score DESC, passage_rank) = 1""")
def citation_match(spark, d):
    """The last assistant turn as the answer, the conversation's turns as passages."""
    return citations_of(spark, d).select("query_id", "sentence_no", "claim", "passage_rank", "score")


def citations_of(spark, d) -> DataFrame:
    turns = read(spark, d, "conversations")
    last = turns.where("role = 'assistant'").groupBy(F.col("conv_id").alias("query_id")).agg(F.max_by("text", "turn").alias("answer"))
    return cite.citations(last, turns.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("passage_rank"), "text"))


@query()
def extract_quote(spark, d):
    return citations_of(spark, d).select("query_id", "sentence_no", "quote")


@query("SELECT conv_id, turn, substr(text, 1, 20) <> '' AND contains(lower(text), lower(substr(text, 1, 20))) AS valid, contains(lower(text), 'the  ') AS invalid FROM conversations")
def quote_validity(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", cite.valid_quote(F.substring("text", 1, 20), "text").alias("valid"), cite.valid_quote(F.lit("the  "), "text").alias("invalid"))


# ---- pages

@query()
def html_extract(spark, d):
    pages = read(spark, d, "pages")
    return pages.select("page_id", U.html_markdown("html", "url").alias("m")).select("page_id", "m.*", F.contains("m.body", F.lit("|---")).alias("has_table"))


@query("SELECT DISTINCT sha256(text) AS content_hash FROM documents")
def incremental_documents(spark, d):
    """New documents by a file stream, each content once across batches."""
    from docloom.streaming.incremental import stream_documents

    return stream_documents(spark, f"{d}/documents.parquet")


# ---- requests and stages

RETRIEVE_CTE = FUSED_CTE.replace("q.vec_id % 100 = 0", "q.vec_id IN (SELECT item_id FROM benchmark)").replace("query_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0)", "true") + f""",
rh AS (SELECT f.*, d.text, d.source, list_distinct({TOKENS('b.text')}) AS q, list_distinct({TOKENS('d.text')}) AS t FROM fused f JOIN documents d ON d.doc_id = f.id JOIN benchmark b ON b.item_id = f.query_id),
rt AS (SELECT query_id, id, text, source, dense_score, bm25_score, hybrid_score, rank, CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, t))::DOUBLE / len(q), 6) ELSE 0 END AS final_score FROM rh),
ra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, rank)::INTEGER AS rank_after FROM rt)"""


def retrieved(spark, d, final_k: int = 5) -> DataFrame:
    """Every benchmark text, with the vector of its id as its embedding."""
    asked = questions(spark, d).join(read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id", "left")
    texts = documents(spark, d).select(F.col("doc_id").alias("id"), "text", F.col("source").alias("url"))
    return service.retrieve(bm25_index(spark, d), read(spark, d, "embeddings"), texts, asked, final_k=final_k)


@query(f"WITH {RETRIEVE_CTE} SELECT * EXCLUDE (text, source) FROM ra WHERE rank_after <= 5")
def retrieve_documents(spark, d):
    return retrieved(spark, d).drop("text", "url")


@query(f"WITH {RETRIEVE_CTE} SELECT query_id, rank_after AS rank, id::VARCHAR AS chunk_id, text, source AS source_url, final_score AS post_rerank_score FROM ra WHERE rank_after <= 3")
def passage_projection(spark, d):
    return service.passages(retrieved(spark, d), 3)


@query()
def extractive_answer(spark, d):
    """The offline answer step on the first passages of each query."""
    return service.extract_answer(service.passages(retrieved(spark, d), 3), questions(spark, d))


@query(f"WITH {DENSE_CTE}, t AS ({DENSE_TOP.format('', 5)}) SELECT query_id, vec_id, round(1 - (1 - score), 6) AS similarity FROM t")
def distance_similarity(spark, d):
    hits = search.dense(read(spark, d, "embeddings"), vector_questions(spark, d), 5)
    return hits.select("query_id", "vec_id", F.round(T.similarity(1 - F.col("score")), 6).alias("similarity"))


def requests(spark, d) -> DataFrame:
    """The last turn of each conversation as a request, the turns before it as its history."""
    h = F.col("history")
    return conversation_rows(spark, d).select("conv_id", F.element_at(h, -1)["text"].alias("query"), F.slice(h, 1, F.size(h) - 1).alias("history"))


@query(f"""WITH {GATE_SQL} SELECT conv_id, topic AND len(hist) = 0 AS needs_clarification, CASE WHEN topic AND len(hist) = 0 THEN 'Which brand and model is it, and what kind of appliance?' ELSE 'The query can be answered.' END AS message,
  CASE WHEN topic AND len(hist) = 0 THEN 'x,y' END AS suggestions FROM z""")
def clarify(spark, d):
    rows = service.clarified(requests(spark, d), TEST_TABLES, ["x", "y"])
    return rows.select("conv_id", "needs_clarification", "message", F.array_join("suggestions", ",").alias("suggestions"))


@query(f"""WITH g AS (SELECT conv_id, decision FROM ({ORACLE_SQL['answer_decision']}) x), {HISTORY_CTE},
r AS (SELECT h.conv_id, decision, m[-1].t AS q FROM h JOIN g ON g.conv_id = h.conv_id)
SELECT conv_id, decision, CASE decision WHEN 'need_specifications' THEN 'Which brand and model is it, and what kind of appliance?' WHEN 'need_brand' THEN 'Please tell me the brand and model of the appliance.'
  WHEN 'no_passages' THEN 'I found nothing on this question.' WHEN 'low_confidence' THEN 'I have no reliable information on this question.' WHEN 'safety' THEN 'Please call.' ELSE 'Draft ' || conv_id END AS answer,
  decision IN ('no_passages', 'low_confidence') AS refusal, CASE decision WHEN 'no_passages' THEN 'No relevant documents found in retrieval' WHEN 'low_confidence' THEN 'Low confidence' END AS refusal_reason,
  decision = 'safety' AS safety_flag, CASE WHEN decision = 'safety' THEN 's' END AS safety_category FROM r""")
def query_response(spark, d):
    rows = requests(spark, d).select("conv_id", "query").join(answer_decision(spark, d), "conv_id").withColumn("drafted", F.concat(F.lit("Draft "), F.col("conv_id").cast("string")))
    return service.answered(rows, {"s": "Please call."}, TEST_TABLES["safety"]).drop("query", "drafted")


@query()
def respond_requests(spark, d):
    """The whole way from each conversation's last turn to its response, over the documents."""
    texts = documents(spark, d).select(F.col("doc_id").alias("id"), "text", F.col("source").alias("url"))
    asked = requests(spark, d).withColumn("history", F.transform("history", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))))
    asked = asked.where(T.strip("query") != "").withColumnRenamed("conv_id", "query_id")
    out = service.respond(asked, bm25_index(spark, d), read(spark, d, "embeddings"), texts, TEST_TABLES, referrals={"s": "Please call."})
    return out.withColumns({"citations": F.size("citations"), "trace": F.col("trace.passage_count")})


@query(f"""WITH {HISTORY_CTE}, x AS (SELECT conv_id, m[-1].t AS q, m[:len(m) - 1] AS b FROM h),
y AS (SELECT conv_id, q, array_to_string(list_transform(list_filter(b[-6:], lambda x: {STRIP('x.t')} <> ''), lambda x: upper(x.r[1]) || x.r[2:] || ': ' || {STRIP('x.t')}), chr(10)) AS told, len(list_filter(b, lambda x: x.r = 'assistant')) AS n FROM x)
SELECT conv_id, 'C: ' || told || ' Q: ' || CASE WHEN told = '' THEN q ELSE 'History:' || chr(10) || told || chr(10) || chr(10) || 'Latest: ' || q || chr(10) || chr(10) || CASE WHEN n >= 2 THEN 'Conclude and name the next action.' ELSE 'Ask one next question or give the next step.' END END || '.' AS prompt FROM y""")
def prompt_render(spark, d):
    return requests(spark, d).select("conv_id", service.prompt(dialog.history_text(F.col("history")), service.question_text(F.col("query"), F.col("history"), 2), "C: {context} Q: {question}.").alias("prompt"))


WHOLE = lambda names: f"regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])({names})([^A-Za-z0-9_]|$)')"


@query(f"""SELECT doc_id, CASE WHEN {WHOLE('whirlpool')} THEN 'Whirlpool' WHEN {WHOLE('ge|ge appliances|general electric')} THEN 'GE Appliances' END AS brand, CASE WHEN {WHOLE('the')} THEN 'a' WHEN {WHOLE('und|le')} THEN 'b' END AS test_brand,
  len(regexp_split_to_array(text, '{WS}+')) >= 3 AND {WHOLE('the|und|le')} AND {WHOLE('of|der|de la')} AS issue FROM documents""")
def client_rules(spark, d):
    return documents(spark, d).select("doc_id", R.whole_word_category("text", R.CLIENT_BRANDS).alias("brand"), R.whole_word_category("text", [("a", ["the"]), ("b", ["und", "le"])]).alias("test_brand"), R.client_issue("text", ["the", "und", "le"], ["of", "der", "de la"]).alias("issue"))


@query("""SELECT doc_id, '{"strategy":"fixed","heading_path":"","url":"' || source || '","brand":"' || lang || '","category":"","title":"","page_type":"general_support","has_table":"' || CASE WHEN contains(text, '|---') THEN 'True' ELSE 'False' END || '"}' AS metadata FROM documents""")
def metadata_maps(spark, d):
    none = F.lit(None).cast("string")
    rows = documents(spark, d).withColumns({"strategy": F.lit("fixed"), "heading_path": none, "url": F.col("source"), "brand": F.col("lang"), "category": F.lit(""), "title": none, "page_type": none, "has_table": F.contains("text", F.lit("|---"))})
    return rows.select("doc_id", F.to_json(T.metadata_map()).alias("metadata"))


@query("""WITH i AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'z' END AS c, CASE WHEN item_id % 2 = 0 THEN 'dev' ELSE 'test' END AS s, item_id % 5 > 0 AS v FROM benchmark),
n AS (SELECT 'total' AS section, 'items' AS name, count(*) AS found, 40::BIGINT AS expected FROM i UNION ALL
  SELECT 'category', e.n, (SELECT count(*) FROM i WHERE c = e.n), e.x FROM (VALUES ('a', 14::BIGINT), ('b', 20)) e(n, x) UNION ALL
  SELECT 'split', e.n, (SELECT count(*) FROM i WHERE s = e.n), e.x FROM (VALUES ('dev', 20::BIGINT), ('test', 20)) e(n, x) UNION ALL
  SELECT 'rules', 'items with problems', count(*) FILTER (WHERE c = 'z'), 0 FROM i UNION ALL SELECT 'rules', 'repeated ids', count(*), 0 FROM (SELECT item_id FROM i GROUP BY 1 HAVING count(*) > 1) x UNION ALL
  SELECT 'review', 'not verified', count(*) FILTER (WHERE NOT v), 0 FROM i)
SELECT *, found = expected AS ok FROM n""")
def golden_report(spark, d):
    i = F.col("item_id")
    items = read(spark, d, "benchmark").select(i.alias("id"), F.when(i % 3 == 0, "a").when(i % 3 == 1, "b").otherwise("z").alias("category"), F.when(i % 2 == 0, "dev").otherwise("test").alias("split"), (i % 5 > 0).alias("human_verified"), F.when(i % 3 == 2, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("problems"))
    return evaluation.report(items, 40, {"a": 14, "b": 20}, {"dev": 20, "test": 20})


@query("""SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'missing fields: human_verified, split' WHEN item_id % 4 = 1 THEN 'human_verified must be true or false; source_urls must be a list' ELSE '' END AS problems FROM benchmark""")
def field_validation(spark, d):
    i = F.col("item_id")
    base = '{"id":"x","query":"q","category":"c","expected_category":"c","gold_answer":"g","evidence_quotes":[],"searched_terms":["a"]'
    item = F.when(i % 4 == 0, base + ',"source_urls":[]}').when(i % 4 == 1, base + ',"source_urls":"u","split":"dev","human_verified":"yes"}').otherwise(base + ',"source_urls":["u"],"split":"dev","human_verified":true}')
    return read(spark, d, "benchmark").select("item_id", F.array_join(evaluation.field_problems(item), "; ").alias("problems"))


@query("""WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT url, count(*) AS n, bool_and(CASE WHEN length(host) % 3 = 0 THEN true WHEN length(host) % 3 = 1 THEN NOT path LIKE '/en/%' OR path LIKE '/en/a%' ELSE false END) AS allowed FROM u GROUP BY url""")
def robots_gate(spark, d):
    """Rules for every host; a host's answer follows from its length."""
    pages = read(spark, d, "pages").select("url")
    hosts = pages.select(F.parse_url("url", F.lit("HOST")).alias("host")).distinct()
    rules = hosts.select("host", F.inline(F.array(*(F.struct(F.lit(p).alias("path"), F.lit(a).alias("allow")) for p, a in (("/en/", False), ("/en/a", True))))))
    answers = hosts.select("host", F.element_at(F.array(F.lit(404), F.lit(200), F.lit(500)), F.length("host") % 3 + 1).alias("status"))
    return stages.robots_gate(pages.distinct(), rules, answers).join(pages.groupBy("url").agg(F.count("*").alias("n")), "url")


# words of the test texts in the client's tables
CLIENT_TABLES = {"categories": [("a", ["the", "that"]), ("b", ["der", "que"]), ("c", ["and", "le"])], "brands": [("X", ["with", "und", "la"]), ("Y", ["of"])], "appliances": ["the", "that", "der", "que", "and", "le"], "questions": ["of", "in", "ist", "un"]}
_FIRST_WHOLE = lambda rules: "CASE " + " ".join(f"WHEN {WHOLE('|'.join(names))} THEN '{label}'" for label, names in rules) + " END"


@query(f"""WITH RECURSIVE u AS (SELECT conv_id, turn, coalesce({STRIP('text')}, '') AS text FROM conversations WHERE role = 'user'),
m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, text) AS k, {_FIRST_WHOLE(CLIENT_TABLES['categories'])} AS cat, {_FIRST_WHOLE(CLIENT_TABLES['brands'])} AS br,
  len(regexp_split_to_array(text, '{WS}+')) >= 3 AND {WHOLE('|'.join(CLIENT_TABLES['appliances']))} AND {WHOLE('|'.join(CLIENT_TABLES['questions']))} AS iss,
  {CASES('lower(text)', TEST_TABLES['categories'], 'NULL')} IS NOT NULL AND len({WORDS('text')}) >= 3 AND (contains(lower(text), 'tion') OR contains(lower(text), 'und') OR contains(lower(text), 're the') OR contains(lower(text), 'le la')) AS unclear FROM u),
e AS (SELECT conv_id, 0::BIGINT AS k, NULL::BIGINT AS turn, 'new' AS phase, 'none' AS action, NULL::VARCHAR AS query, 0 AS history, NULL::VARCHAR AS category, NULL::VARCHAR AS brand, false AS reset, NULL::VARCHAR AS product FROM (SELECT DISTINCT conv_id FROM u) x
  UNION ALL
  SELECT conv_id, k, turn,
    CASE WHEN blank THEN phase WHEN opens THEN CASE WHEN unclear THEN 'product' ELSE 'talk' END WHEN phase = 'product' THEN CASE WHEN br IS NULL THEN 'product' ELSE 'issue' END ELSE 'talk' END,
    CASE WHEN blank THEN 'none' WHEN opens THEN CASE WHEN unclear THEN 'ask_product' ELSE 'query' END WHEN phase = 'product' THEN CASE WHEN br IS NULL THEN 'ask_brand' ELSE 'ask_issue' END ELSE 'query' END,
    CASE WHEN blank OR (opens AND unclear) OR (NOT opens AND phase = 'product') THEN NULL WHEN NOT opens AND phase = 'issue' THEN text || ' (' || product || ')' ELSE text END,
    CASE WHEN blank THEN history WHEN opens THEN CASE WHEN unclear THEN 1 ELSE 2 END WHEN phase = 'product' THEN history + CASE WHEN br IS NULL THEN 0 ELSE 1 END ELSE history + 2 END,
    CASE WHEN opens AND NOT blank THEN cat ELSE category END, CASE WHEN blank THEN brand WHEN opens THEN NULL WHEN phase = 'product' AND br IS NOT NULL THEN br ELSE brand END, opens AND NOT blank AND phase = 'talk',
    CASE WHEN blank THEN product WHEN opens THEN NULL WHEN phase = 'product' AND br IS NOT NULL THEN text ELSE product END
  FROM (SELECT m.*, e.phase, e.history, e.category, e.brand, e.product, m.text = '' AS blank, e.phase = 'new' OR (e.phase = 'talk' AND m.iss AND coalesce(m.cat <> e.category, false)) AS opens FROM e JOIN m ON m.conv_id = e.conv_id AND m.k = e.k + 1) y)
SELECT conv_id, turn, action, query, history::INTEGER AS history, category, brand, reset FROM e WHERE k > 0""")
def session_steps(spark, d):
    """What each message of the conversations' users sets off on the client."""
    said = read(spark, d, "conversations").where("role = 'user'")
    t = TEST_TABLES
    return session.sessions(said, R.new_topic("text", t["categories"], t["topics"], t["problems"]), **CLIENT_TABLES)


@query()
def extract_stage(spark, d):
    """What extraction adds to its manifest, of the pages."""
    none = F.lit(None).cast("string")
    raw = read(spark, d, "pages").select(F.col("url"), none.alias("brand"), none.alias("category"), F.lit(False).alias("is_pdf"), F.lpad(F.col("page_id").cast("string"), 20, "0").alias("scraped_at"), F.lit("ok").alias("status"), F.col("html").alias("content"))
    return stages.extracted(raw).drop("text")


def stage_records(spark, d) -> DataFrame:
    """The documents as extracted pages."""
    none = F.lit(None).cast("string")
    return documents(spark, d).select(none.alias("url"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("source_url"), F.col("source").alias("brand"), F.col("lang").alias("category"), none.alias("title"), F.contains("text", F.lit("|---")).alias("has_table"), none.alias("page_type"), F.lit("ok").alias("status"), "text")


@query()
def clean_stage(spark, d):
    done = read(spark, d, "labels").where("quality = 1").select(F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), F.lit("ok").alias("status"))
    return stages.cleaned(stage_records(spark, d), done)


@query()
def chunk_stage(spark, d):
    """Both strategies on the documents, each content once, no near duplicates of the last 50 kept."""
    return stages.chunked(stage_records(spark, d).withColumn("url", F.col("source_url")))


@query()
def index_rebuild(spark, d):
    """The vector table of the documents' fixed chunks."""
    chunks = stages.fixed_with_metadata(stage_records(spark, d).withColumn("url", F.col("source_url")))
    return stages.rebuild_index(chunks, Scratch(spark, "vectors").path("table"))
