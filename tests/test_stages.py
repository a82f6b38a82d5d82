import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from docloom.functions import rules
from docloom.functions import text as T
from docloom.functions.udfs import hashed_vector
from docloom.operators import dialog, evaluation, search, service, stages
from docloom.scratch import Scratch
from docloom.sources import files
from tests.test_operators import loop_structure

PAGE = "url string, brand string, category string, title string, has_table boolean, page_type string, status string, text string"


def pages(spark, texts, status="ok"):
    return spark.createDataFrame([(f"u{i:02}", "b", "c", "t", False, None, status, t) for i, t in enumerate(texts)], PAGE)


def loop_chunks(texts):
    rows = []
    for i, t in enumerate(texts):
        w = t.split()
        rows += [(f"u{i:02}", "fixed", " ".join(w[k : k + 300])) for k in range(0, max(1, len(w) - 45), 255)] if w else []
        rows += [(f"u{i:02}", "structure_aware", body) for _, body in ordered_structure(t)]
    kept, seen = [], set()
    sets = lambda t: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))}
    for url, strategy, body in rows:
        s = sets(body)
        if body in seen:
            continue
        seen.add(body)
        if not any(100 * len(s & o) >= 85 * len(s | o) for _, _, _, o in kept[-50:]):
            kept.append((url, strategy, body, s))
    return sorted(k[:3] for k in kept)


def ordered_structure(text):
    found = loop_structure(text)
    return sorted(found, key=lambda x: text.find(x[1].split("\n")[0][:20]))


def test_chunk_stage_equals_a_loop(spark):
    plain = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    texts = [plain(0, 40), plain(0, 40), "# A\n" + plain(1, 30) + "\n# B\n" + plain(2, 30), plain(3, 320), plain(0, 39) + " other", ""]
    made = stages.chunked(pages(spark, texts))
    got = made.collect()
    assert sorted((r["url"], r["strategy"], r["text"]) for r in got) == loop_chunks(texts)
    old = spark.createDataFrame(got, made.schema)
    again = stages.chunked(pages(spark, [*texts[:2], "# A\n" + plain(9, 30), *texts[3:]]), old, "structure_aware").collect()
    assert any(plain(9, 30) in r["text"] and r["strategy"] == "structure_aware" for r in again)
    assert {r["text"] for r in again if r["strategy"] == "fixed"} == {r["text"] for r in got if r["strategy"] == "fixed"}
    assert stages.chunked(pages(spark, texts, "failed")).count() == 0


def test_chunks_move_once(spark, monkeypatch):
    """One exchange of pieces by page and one of chunks by order; verdicts come to where the chunks lie."""
    plans, keep = {}, Scratch.keep_bucketed
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(Scratch, "keep_bucketed", lambda self, df, name, *a: plans.update({name: plan(df)}) or keep(self, df, name, *a))
    made = stages.chunked(pages(spark, [f"# A{i}\n" + " ".join(f"w{i}x{k}" for k in range(400)) for i in range(6)]))
    assert plans["sets"].count("Exchange ") == 2 and "Exchange rangepartitioning(order" not in plan(made) and made.count() == 12


def test_orphans_of_the_other_strategy_go_and_copies_of_a_null_url_too(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = pages(spark, [words(0), words(1)])
    made = stages.chunked(rows, None, "fixed")
    assert {r["url"] for r in made.collect()} == {"u00", "u01"}
    old = made.withColumn("url", F.when(F.col("url") == "u01", "gone").otherwise(F.col("url")))
    nulls = rows.withColumn("url", F.when(F.col("url") == "u00", F.lit(None)).otherwise(F.col("url")))
    # the orphan takes part as the first of its text, and goes at the end
    assert stages.chunked(rows, old, "structure_aware").select("url", "strategy").collect() == [("u00", "fixed")]
    assert [tuple(r) for r in stages.chunked(nulls).select("url", "strategy").collect()] == [("u01", "fixed")]


def test_cleaning_skips_what_is_done(spark):
    done = spark.createDataFrame([("u00", "ok"), ("u01", "failed")], "url string, status string")
    rows = pages(spark, ["a", "x \u201cy\u201d  z\u2026\r\n\n\n\ncaf\u0065\u0301"]).withColumn("source_url", F.col("url")).withColumn("url", F.lit(""))
    got = stages.cleaned(rows, done).collect()
    assert [(r["url"], r["text"], r["page_type"]) for r in got] == [("u01", 'x "y" z...\n\ncaf\u00e9', "general_support")]


def test_index_rebuild(spark, tmp_path):
    chunks = stages.fixed_with_metadata(pages(spark, ["one two", "two three", ""]))
    path = str(tmp_path / "vectors")
    rows = stages.rebuild_index(chunks, path, 16).collect()
    assert len(rows) == 2 and all(len(r["embedding"]) == 16 and abs(sum(x * x for x in r["embedding"]) - 1) < 1e-5 for r in rows)
    assert rows[0]["metadata"]["has_table"] == "False" and rows[0]["metadata"]["page_type"] == "general_support"
    with pytest.raises(ValueError):
        stages.rebuild_index(chunks.union(chunks), path, 16)
    with pytest.raises(ValueError):
        stages.rebuild_index(chunks.limit(0), path, 16)
    table = spark.read.parquet(path)  # the old table is still there
    assert table.count() == 2 and files.without_ids(table, table.limit(1)).count() == 1
    assert files.read_chunks(spark, str(tmp_path / "none"), table.schema).count() == 0


def test_retrieval_checks_its_arguments(spark):
    queries = spark.createDataFrame([(1, " aid "), (2, "x")], "query_id long, query string")
    assert [r["query"] for r in service.checked(queries, 5).orderBy("query_id").collect()] == ["aid", "x"]
    for bad in (lambda: service.checked(queries, 0), lambda: service.checked(queries.union(spark.createDataFrame([(3, " ")], queries.schema)), 1)):
        with pytest.raises(ValueError):
            bad()


def test_retrieve_reranks_the_fused_hits(spark):
    docs = spark.createDataFrame([(1, "admissions open in fall"), (2, "financial aid deadlines are in may"), (3, "housing and aid")], "doc_id long, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(7, "financial aid deadlines", [1.0, 0.0]), (8, "fall", None)], "query_id long, query string, query_vector array<float>")
    hits = service.retrieve(search.build_index(docs), vectors, docs.withColumnRenamed("doc_id", "id").withColumn("url", F.lit("u")), asked, 3, 2)
    got = {q: [r["id"] for r in sorted(hits.collect(), key=lambda r: r["rank_after"]) if r["query_id"] == q] for q in (7, 8)}
    assert got == {7: [2, 3], 8: [1, 2]}
    found = service.passages(hits, 1)
    assert [(r["chunk_id"], r["rank"], r["source_url"]) for r in found.where("query_id = 7").collect()] == [("2", 1, "u")]
    told = {r["query_id"]: r["answer"] for r in service.extract_answer(found, asked).collect()}
    assert told == {7: "financial aid deadlines are in may", 8: "admissions open in fall"}


def test_a_hit_text_is_cut_into_tokens_once_for_all_queries(spark, monkeypatch):
    """The default rerank reads tokens of texts, not of hits, and carries no text through the ranking."""
    seen, own = [], search.reranked
    monkeypatch.setattr(search, "reranked", lambda hits, score, k=5: seen.append((hits.columns, str(score))) or own(hits, score, k))
    docs = spark.createDataFrame([(i, f"w{i} w{i % 3} all") for i in range(6)], "id long, text string").withColumn("url", F.lit("u"))
    vectors = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(6)], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(q, f"w{q} all", [1.0, 0.3]) for q in range(4)], "query_id long, query string, query_vector array<float>")
    index = search.build_index(docs, "id")
    got = service.retrieve(index, vectors, docs, asked, 6, 3)
    want = service.retrieve(index, vectors, docs, asked, 6, 3, search.overlap("query", "text"))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "text" not in seen[0][0] and "regexp" not in seen[0][1] and "text" in seen[1][0]


def test_prompt_and_question(spark):
    turns = "array<struct<role:string,text:string>>"
    rows = spark.createDataFrame([("q {context}", [("user", "hi"), ("assistant", "yes?")]), ("q", [])], f"q string, h {turns}")
    got = [tuple(r) for r in rows.select(service.prompt(F.lit("c {question}"), "q", "<{context}|{question}>"), service.question_text(F.col("q"), F.col("h"), 1), dialog.assistant_turns(F.col("h"))).collect()]
    assert got[0][0] == "<c {question}|q {context}>" and got[0][1].endswith("Conclude and name the next action.") and got[1][1:] == ("q", 0)


def test_titles_start_after_hyphens(spark):
    rows = spark.createDataFrame([("front-load o'neil 3d x",)], "t string")
    assert rows.select(T.titled("t")).first()[0] == "front-load o'neil 3d x".title()
    assert rows.select(T.metadata_prefix(F.lit(""), F.lit(None).cast("string"), F.lit(""), F.lit(""), "t")).first()[0] == "front-load o'neil 3d x"


def test_client_rules(spark):
    texts = ["My GE dishwasher is broken", "gerbil washer", "is my fridge ok", "washer help", "whirlpool"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(rules.whole_word_category("t", rules.CLIENT_BRANDS).alias("b"), rules.client_issue("t").alias("i")).collect()
    assert [(r["b"], r["i"]) for r in rows] == [("GE Appliances", True), (None, False), (None, True), (None, False), ("Whirlpool", False)]


def test_golden_set_report(spark):
    item = dict.fromkeys(evaluation.FIELDS, "x") | {"source_urls": [], "evidence_quotes": [], "searched_terms": [], "human_verified": True}
    items = [item, item | {"human_verified": 1}, {k: v for k, v in item.items() if k != "split"}, item | {"source_urls": None}]
    got = [r["p"] for r in spark.createDataFrame([(json.dumps(i),) for i in items], "j string").select(evaluation.field_problems(F.col("j")).alias("p")).collect()]
    assert got == [[], ["human_verified must be true or false"], ["missing fields: split"], ["source_urls must be a list"]]
    rows = lambda flags: spark.createDataFrame([(i, "a", "dev", v, []) for i, v in enumerate(flags)], "id int, category string, split string, human_verified boolean, problems array<string>")
    code = lambda flags, n=2: evaluation.exit_code(evaluation.report(rows(flags), n, {"a": 2}, {"dev": 2}))
    assert [code([True, True]), code([True, None]), code([True, True], 3)] == [0, 2, 1]


def test_robots(spark):
    urls = spark.createDataFrame([(u,) for u in ("http://a.x/p/q", "http://a.x/p/ok", "http://b.x/", "http://c.x/", "http://d.x/z")], "url string")
    table = spark.createDataFrame([("a.x", "/p", False), ("a.x", "/p/ok", True), ("b.x", "/", False)], "host string, path string, allow boolean")
    answers = spark.createDataFrame([("a.x", 200), ("b.x", 404), ("c.x", 500)], "host string, status int")
    got = {r["url"]: r["allowed"] for r in stages.robots_gate(urls, table, answers).collect()}
    assert got == {"http://a.x/p/q": False, "http://a.x/p/ok": True, "http://b.x/": True, "http://c.x/": False, "http://d.x/z": False}
    assert [r[0] for r in spark.createDataFrame([("http://a/x.PDF", None), ("http://a/x", "application/pdf"), ("http://a/x", "text/html")], "u string, c string").select(stages.is_pdf("u", "c")).collect()] == [True, True, False]


def test_json_items_refuse_other_files(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="no array of items"):
        files.json_items(spark, str(tmp_path / "x.json"), StructType([StructField("id", StringType())])).collect()


def test_blobs_are_named_by_address(spark, tmp_path):
    rows = spark.createDataFrame([("http://a/x", b"1", False, "b", "c")], "url string, content binary, is_pdf boolean, brand string, category string")
    files.write_blobs(rows, str(tmp_path / "raw"))
    got = spark.read.parquet(str(tmp_path / "raw")).first()
    assert got["name"].endswith(".html") and len(got["name"]) == 21 and (got["brand"], got["category"]) == ("b", "c")


def test_paths_are_repaired_or_rows_go(spark):
    rows = spark.createDataFrame([("old/b/c/x.md", "b", "c"), ("old/b/c/y.md", "b", "c"), ("new/b/c/z.md", "b", "c")], "path string, brand string, category string")
    listing = spark.createDataFrame([("new/b/c/x.md",), ("new/b/c/z.md",), ("old/other.md",)], "path string")
    assert sorted(r["path"] for r in files.found_paths(rows, listing, "new").collect()) == ["new/b/c/x.md", "new/b/c/z.md"]


def test_items_to_vectors_and_export(spark, tmp_path):
    items = spark.createDataFrame([("1", "a b", {"url": "u", "x": "y"}), ("2", None, {})], "id string, text string, metadata map<string,string>")
    got = {r["id"]: r for r in stages.vectors_of_items(items, ["url"], 8).collect()}
    assert got["1"]["metadata"] == {"url": "u"} and len(got["2"]["embedding"]) == 8
    stages.export_embed_ready(stages.fixed_with_metadata(pages(spark, ["one two"])), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first()["embed_text"] == "Brand: B | Appliance: C\n\none two"
    (tmp_path / "x.json").write_text('{"items": []}')
    with pytest.raises(Exception, match="no array of items"):
        files.json_items(spark, str(tmp_path / "x.json"), StructType([StructField("id", StringType())]), list_only=True).collect()


def written(text):
    if "pump" in text.split("Question:")[1]:
        raise ConnectionError("no model here")
    return "The door seal keeps water inside the drum. Something else entirely."


def test_a_request_to_its_response(spark):
    docs = spark.createDataFrame([(0, "The washer door seal keeps water inside the drum. Wipe it dry.", "u0"), (1, "A pump of the washer moves water out.", "u1"), (2, "Bananas are yellow.", "u2")], "id long, text string, url string")
    index = search.build_index(docs, "id")
    vectors = docs.select(F.col("id").alias("vec_id"), hashed_vector("text", F.lit(64)).alias("embedding"))
    tables = {"categories": [("washer", ["washer"]), ("fridge", ["fridge"])], "brands": [("acme", ["acme"])], "topics": ["how"], "problems": ["broken"], "safety": [("gas", ["gas"])]}
    turn = [("user", "hello"), ("assistant", "yes?")]
    rows = [(1, "how does the washer work", None), (2, "washer seal", turn), (3, "acme washer door seal water drum", turn), (4, "acme washer pump moves water", turn), (5, "gas near the acme washer door seal", turn), (6, "zzz qqq xxx", None), (7, "how does the fridge work", [("user", "my washer is broken"), ("assistant", "oh")])]
    asked = spark.createDataFrame(rows, "query_id long, query string, history array<struct<role: string, text: string>>")
    score = search.overlap("query", "text")
    got = {r["query_id"]: r for r in service.respond(asked, index, vectors, docs, tables, score=score, answer=service.generated(written), referrals={"gas": "Leave the house."}, k=2).collect()}
    assert {q: r["decision"] for q, r in got.items()} == {1: "need_specifications", 2: "need_brand", 3: "answer", 4: "answer", 5: "safety", 6: "low_confidence", 7: "need_specifications"}
    assert got[1]["trace"] is None and not got[1]["refusal"] and got[6]["refusal"] and got[6]["refusal_reason"] == "Low confidence"
    assert got[5]["answer"] == "Leave the house." and got[5]["safety_category"] == "gas" and got[5]["trace"]["passage_count"] == 2
    assert got[3]["answer"].startswith("The door seal") and [(c["sentence_no"], c["passage_rank"]) for c in got[3]["citations"]] == [(0, 1)]
    assert got[4]["answer"] == "[ERROR] Generation failed: no model here"
    plain = {r["query_id"]: r for r in service.respond(asked, index, vectors, docs, tables, score=score, k=2).collect()}
    assert "door seal" in plain[3]["answer"] and plain[6]["answer"] == got[6]["answer"]
    assert service.respond(asked.limit(0), index, vectors, docs, tables).collect() == []
