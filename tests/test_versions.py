import os

import pytest

from docloom.operators import stages
from docloom.sources.versions import Conflict, Versions
from docloom.streaming.pages import extract_stream

RAW = "url string, brand string, category string, is_pdf boolean, scraped_at string, status string, content string"


def items(store, table, at=None):
    return sorted(r["x"] for r in store.read(table, "x long", at).collect())


def test_versions_change_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    store = Versions(spark, str(tmp_path / "v"))
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "x long")
    assert store.current().number == 0 and items(store, "a") == []
    store.change(replace={"a": rows(1, 2)}, append={"log": rows(10)})
    first = store.current()
    held = store.read("a", "x long")  # a reader that keeps its version
    store.change(replace={"a": store.read("a", "x long").where("x > 1")}, append={"log": rows(11, 12)})
    assert items(store, "a") == [2] and items(store, "log") == [10, 11, 12] and sorted(r["x"] for r in held.collect()) == [1, 2]
    assert items(store, "log", first) == [10]

    # a failure after the data is written and before the commit, and one by a check
    def broken(*_):
        raise OSError("lost")

    monkeypatch.setattr(store, "commit", broken)
    with pytest.raises(OSError):
        store.change(replace={"a": rows(5)}, append={"log": rows(13)})
    monkeypatch.undo()
    with pytest.raises(ValueError):
        store.change(replace={"a": rows()}, check=lambda t: (_ for _ in ()).throw(ValueError("empty")) if not t["a"].count() else None)
    assert items(store, "a") == [2] and items(store, "log") == [10, 11, 12]

    # a writer that fell in the middle of its commit file leaves the version before, and its number is not used again
    with open(tmp_path / "v" / "commits" / f"{3:020d}", "w") as out:
        out.write('{"tables": {"a"')
    assert items(store, "a") == [2]
    assert store.change(append={"log": rows(14)}).number == 4 and items(store, "log") == [10, 11, 12, 14]

    # two writers from one version
    base = store.current()
    mine, other = store.write(rows(7)), store.write(rows(8))
    store.commit(base, base.tables | {"a": [mine]})
    with pytest.raises(Conflict):
        store.commit(base, base.tables | {"a": [other]})
    assert items(store, "a") == [7]
    store.expire()
    assert items(store, "a") == [7] and items(store, "log") == [10, 11, 12, 14] and len(store.numbers()) == 1
    assert len([n for n in os.listdir(tmp_path / "v" / "data")]) == 4


def test_many_appends_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("docloom.sources.versions.MOST_FOLDERS", 3)
    store = Versions(spark, str(tmp_path / "v"))
    for i in range(5):
        store.change(append={"log": spark.createDataFrame([(i,)], "x long")}, marks={"batch": i})
    assert items(store, "log") == [0, 1, 2, 3, 4] and len(store.current().tables["log"]) <= 3 and store.current().marks == {"batch": 4}


def page(url, body, at, status="ok", pdf=False):
    return (url, "whirlpool", "washer", pdf, f"2024-01-{at:02d}T00:00:00", status, None if body is None else f"<html><title>T {url}</title><body><h1>Head</h1><p>{body}</p></body></html>")


PAGES = [
    [page("http://a/1", "first text of all", 1), page("http://a/2", "first text of all", 2), page("http://a/3", "another text", 3), page("http://a/x", "gone", 3, "failed")],
    [page("http://a/4", "another text", 4), page("http://a/5", None, 5), page("http://a/6", "pdf", 5, pdf=True), (None, *page("", "z", 5)[1:])],
    [page("http://a/7", "first text of all", 6), page("http://a/8", None, 7), page("http://a/9", "a third text", 8), page("http://a/9", "a third text", 8)],
]


def manifest(store):
    return sorted((r["status"], r["url"] or r["source_url"], r["owner"] or "", r["content_hash"] or "", r["error"] or "", r["text"] or "", r["heading_path"] or "") for r in store.read("extracted", stages.EXTRACTED).collect())


def loop(pages):
    owner, out = {}, []
    for url, _, _, pdf, _, status, content in pages:
        if status == "ok" and url:
            body = content and content.split("<p>")[1].split("</p>")[0]
            out.append(("failed", url, "") if pdf else ("duplicate", url, owner[body]) if body in owner else ("ok", url, ""))
            if not pdf:
                owner.setdefault(body, url)
    return sorted(out)


def test_batches_of_a_stream_equal_one_run(spark, tmp_path):
    whole = Versions(spark, str(tmp_path / "one"))
    stages.run_extraction(whole, spark.createDataFrame([p for b in PAGES for p in b], RAW))
    assert [r[:3] for r in manifest(whole)] == loop([p for b in PAGES for p in b])

    root, arrived = str(tmp_path / "many"), str(tmp_path / "in")
    for batch in PAGES:
        spark.createDataFrame(batch, RAW).coalesce(1).write.mode("append").json(arrived)
        extract_stream(spark.readStream.schema(RAW).json(arrived), root, str(tmp_path / "state")).awaitTermination()
    store = Versions(spark, root)
    assert manifest(store) == manifest(whole) and store.current().marks == {"batch": 2} and store.current().number == 3
    # a batch that is run again adds nothing, and neither does a page that is done
    before = manifest(store)
    extract_stream(spark.readStream.schema(RAW).json(arrived), root, str(tmp_path / "lost state")).awaitTermination()
    assert manifest(store) == before
    stages.run_extraction(store, spark.createDataFrame([page("http://a/1", "first text of all", 9)], RAW))
    assert manifest(store) == before
    normal = store.read("normalized", stages.NORMALIZED).collect()
    assert sorted(r["url"] for r in normal) == [u for s, u, _ in loop([p for b in PAGES for p in b]) if s == "ok"]
    made = stages.run_chunking(store)
    chunks = store.read("chunks", stages.CHUNKS, made)
    n = chunks.count()
    assert n and {r["strategy"] for r in chunks.collect()} <= {"fixed", "structure_aware"}
    assert store.read("chunks", stages.CHUNKS, stages.run_chunking(store, "fixed")).count() == n


def test_owners_expire(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "v"))
    run = lambda *rows: stages.run_extraction(store, spark.createDataFrame(rows, RAW), hold_days=5)
    run(page("http://a/1", "text", 1))
    run(page("http://a/2", "text", 4))
    run(page("http://a/3", "text", 20))
    assert [r[:3] for r in manifest(store)] == [("duplicate", "http://a/2", "http://a/1"), ("ok", "http://a/1", ""), ("ok", "http://a/3", "")]
    run(page("http://a/0", "x", 1))
    assert stages.run_extraction(store, spark.createDataFrame([], RAW)).number == 5
