"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe
from docloom.llm.hnsw import nearest
from docloom.llm.html_main import extract_main_text
from docloom.llm.licenses import licenses_sql, scan_licenses
from docloom.llm.line_dedup import dedup_lines
from docloom.llm.minhash import near_duplicates
from docloom.llm.packing import pack_documents
from docloom.llm.preferences import format_preferences, gathered, neighbouring_pairs
from docloom.llm.quality import judge
from docloom.llm.repair import damaged, repaired
from docloom.llm.repeats import remove_repeats
from docloom.llm.sharding import shard_by_bytes
from docloom.llm.whitening import whiten
from docloom.session import ship_code


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS sh
  FROM w WHERE w IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (
  SELECT a AS node, b AS seen FROM link
  UNION
  SELECT r.node, link.b FROM r JOIN link ON link.a = r.seen),
c AS (SELECT node, min(seen) AS m FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(c.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), report=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM w) x),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) x WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, 8)) AS k FROM twice) x GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
         length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         length(w.text) - length(replace(w.text, chr(10), '')) + 1 AS n_lines,
         len(list_filter(range(2, len(w.w) + 1), lambda i: w.w[i] = w.w[i - 1])) AS n_stutters
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN dup ON dup.doc_id = w.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words
            OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines) OR 100 * n_stutters > 30 * n_words) AS kept
FROM b
"""

def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")
    )
    placed = shard_by_bytes(rows, "h", "doc_id", "size", shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    pairs = neighbouring_pairs(turns.select(F.col("conv_id").cast("long").alias("conv_id")).where(F.col("conv_id").isNotNull()))
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat(x["first"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")  # noqa: E731
    rows = format_preferences(pairs, gathered(turns))
    return rows.withColumns({"chosen_spans": shown("chosen_spans"), "rejected_spans": shown("rejected_spans")})


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS m
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
p AS (SELECT DISTINCT conv_id // 2 AS pair_id FROM t),
b AS (SELECT pair_id, coalesce(c.m, []) AS c, coalesce(r.m, []) AS r FROM p LEFT JOIN t c ON c.conv_id = 2 * pair_id LEFT JOIN t r ON r.conv_id = 2 * pair_id + 1),
n AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(c), len(r)) + 1), lambda i: c[i] = r[i]), false) - 1, least(len(c), len(r))) AS n FROM b),
s AS (SELECT pair_id, n, list_slice(c, 1, n) AS p, list_slice(c, n + 1, len(c)) AS c, list_slice(r, n + 1, len(r)) AS r FROM n)
SELECT pair_id, n::INTEGER AS n_common,
       array_to_string(list_transform(p, lambda t: '<|im_start|>' || t.r || chr(10) || t.x || '<|im_end|>' || chr(10)), '') AS prompt,
       array_to_string(list_transform(c, lambda t: '<|im_start|>' || t.r || chr(10) || t.x || '<|im_end|>' || chr(10)), '') AS chosen,
       array_to_string(list_transform(r, lambda t: '<|im_start|>' || t.r || chr(10) || t.x || '<|im_end|>' || chr(10)), '') AS rejected,
       array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: c[i].r = 'assistant'), lambda i:
         (coalesce(list_sum(list_transform(c[:i - 1], lambda t: length(t.r) + length(t.x) + 24)), 0)::BIGINT + 22) || '-' ||
         (coalesce(list_sum(list_transform(c[:i], lambda t: length(t.r) + length(t.x) + 24)), 0)::BIGINT)), ',') AS chosen_spans,
       array_to_string(list_transform(list_filter(range(1, len(r) + 1), lambda i: r[i].r = 'assistant'), lambda i:
         (coalesce(list_sum(list_transform(r[:i - 1], lambda t: length(t.r) + length(t.x) + 24)), 0)::BIGINT + 22) || '-' ||
         (coalesce(list_sum(list_transform(r[:i], lambda t: length(t.r) + length(t.x) + 24)), 0)::BIGINT)), ',') AS rejected_spans,
       len(list_filter(c, lambda t: t.r = 'assistant')) > 0 AND len(list_filter(r, lambda t: t.r = 'assistant')) > 0 AS usable
FROM s
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)


OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents) x),
w AS (
  SELECT doc_id, pos, line, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS w FROM l),
t AS (
  SELECT doc_id, pos, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS tok
  FROM w WHERE len(w) > 0),
d AS (SELECT tok, min(doc_id * 1000000 + pos) AS o, row_number() OVER () AS k FROM t GROUP BY tok),
e AS (SELECT k, o, len(tok) AS n, unnest(tok) AS s FROM d),
p AS (SELECT x.k, x.n + y.n - count(*) AS u, count(*) AS c FROM e x JOIN e y ON x.s = y.s AND y.o < x.o GROUP BY x.k, y.k, x.n, y.n),
gone AS (SELECT DISTINCT k FROM p WHERE 100 * c >= 80 * u),
keep AS (SELECT t.doc_id, t.pos FROM t JOIN d ON t.tok = d.tok AND t.doc_id * 1000000 + t.pos = d.o WHERE d.k NOT IN (SELECT k FROM gone)),
f AS (SELECT w.doc_id, w.pos, w.line, len(w.w) = 0 OR keep.pos IS NOT NULL AS stays FROM w LEFT JOIN keep ON keep.doc_id = w.doc_id AND keep.pos = w.pos)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '') AS text, count(*)::BIGINT AS n_lines,
       count(*) FILTER (WHERE NOT stays)::BIGINT AS n_removed
FROM f GROUP BY doc_id
"""


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repaired(damaged(table(spark, sf_dir, "conversations")), gone=F.col("gone"), digest=True)
    return rows.withColumnRenamed("repaired", "repaired_sha256")


def repair_sql() -> str:
    """The four states, each a struct of cost, audit and repaired lines, step by step through every conversation."""

    def edit(state: str, cost: str, letter: str, line: str = "", when: str = "true") -> str:
        said = f"{state}.r || chr(10) || {line}" if line else f"{state}.r"
        return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {said}}} END"

    def keep(state: str, initial: str) -> str:
        return edit(state, "cut", "K", "role || ':' || text", f"NOT must AND left(role, 1) = '{initial}'")

    def rerole(state: str, role: str) -> str:
        return edit(state, "3 + cut", "R", f"'{role}:' || text", "NOT must")

    asked = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    deleted = {k: edit(f"s{k}", "4", "D") for k in asked}
    users = ", ".join(f"{keep(f's{k}', 'u')}, {rerole(f's{k}', 'user')}" for k in (0, 1, 3))
    step = [deleted[0], f"least({deleted[1]}, {keep('s0', 's')})", f"least({deleted[2]}, {users})", f"least({deleted[3]}, {keep('s2', 'a')}, {rerole('s2', 'assistant')})"]
    insert = lambda k: edit(f"s{k}", "3", "I", f"'{asked[k]}:'")  # noqa: E731
    closing = f"s0, s1, least(s2, {insert(0)}, {insert(1)}, {insert(3)}) AS s2, least(s3, {insert(2)}) AS s3"
    return rf"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
c AS (
  SELECT *, xor(4294967295, list_reduce(list_transform(range(1, length(k) + 1), lambda i: ord(substr(k, i, 1))::BIGINT), lambda s, x:
    list_reduce(range(0, 8), lambda t, j: xor(t >> 1, (t & 1) * 3988292384), xor(s, x)), 4294967295::BIGINT)) % 20 AS way FROM o),
d AS (
  SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN way = 1 THEN '' WHEN way = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(0, CASE WHEN way = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE way <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
f AS (
  SELECT *, NOT regexp_matches(text, '[^ 	-]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
         NOT regexp_matches(text, '[.!?][ 	-]*\z') AS open,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS two FROM n),
t AS (SELECT *, blank OR seen AS must, CASE WHEN open AND NOT blank AND NOT seen THEN 3 ELSE 0 END AS cut FROM f),
ids AS (SELECT DISTINCT conv_id FROM conversations),
first AS (SELECT conv_id, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS s0, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR) AS s1, {{'c': 3::BIGINT, 'a': 'I', 'r': chr(10) || 'user:'}} AS s2,
          {{'c': 6::BIGINT, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3 FROM ids),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, s0, s1, s2, s3 FROM first
  UNION ALL
  SELECT conv_id, i, {closing} FROM (SELECT conv_id, i, {closing} FROM (
    SELECT dp.conv_id, t.i, {", ".join(f"{x} AS s{k}" for k, x in enumerate(step))}
    FROM dp JOIN t ON t.conv_id IS NOT DISTINCT FROM dp.conv_id AND t.i = dp.i + 1) x) y),
e AS (SELECT conv_id, arg_max(least(s0, s3), i) AS z FROM dp GROUP BY conv_id),
a AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE blank)::BIGINT AS blank,
         count(*) FILTER (WHERE seen AND NOT blank)::BIGINT AS duplicate, count(*) FILTER (WHERE cut > 0)::BIGINT AS truncated,
         count(*) FILTER (WHERE two NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal
  FROM t GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, z.c AS cost, z.a AS audit, sha256(substr(z.r, 2)) AS repaired_sha256
FROM e LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(strlen(h) // 2 - 49, 0))) AS i FROM d) x),
m AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, i FROM w JOIN m ON w.s = m.s WHERE m.m < w.doc_id),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM c),
r AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t, b, a FROM spans),
n AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, max(b) AS e,
             list({'f': f, 't': t} ORDER BY a) AS keep FROM gaps GROUP BY doc_id)
SELECT d.doc_id, (strlen(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN keep IS NULL THEN h ELSE array_to_string(list_transform(keep, lambda k: substr(h, 2 * k.f + 1, 2 * (k.t - k.f))), '') || substr(h, 2 * e + 1) END)) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_hnsw_neighbours": op3_hnsw_neighbours,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_license_scan": op5_license_scan,
    "op6_preference_format": op6_preference_format,
    "op7_line_dedup": op7_line_dedup,
    "op8_html_main_text": op8_html_main_text,
    "op9_sharding": op9_sharding,
    "op10_bpe": op10_bpe,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_repeat_removal": op13_repeat_removal,
}

def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": OP1_SQL,
        "op2_quality_rules": OP2_SQL,
        "op5_license_scan": licenses_sql(),
        "op6_preference_format": OP6_SQL,
        "op7_line_dedup": OP7_SQL,
        "op11_conversation_repair": repair_sql(),
        "op13_repeat_removal": OP13_SQL,
    }
