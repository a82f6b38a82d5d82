import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from docloom.functions import rules as R
from docloom.functions import text as T
from docloom.functions import udfs as U


def one(spark, value, **columns):
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string'}" for k, v in columns.items()))
    return row.select(value.alias("v")).first()["v"]


def test_hashes(spark):
    assert one(spark, T.url_hash("u"), u="http://a/b") == hashlib.sha256(b"http://a/b").hexdigest()[:16]
    assert one(spark, T.content_hash("u"), u="café") == hashlib.sha256("café".encode()).hexdigest()
    assert one(spark, T.content_hash("u"), u="café") != hashlib.sha256("café".encode("latin-1")).hexdigest()
    assert one(spark, T.chunk_id("u", "h", F.lit(3)), u="x", h=None) == hashlib.sha256(b"x||3").hexdigest()[:16]


def test_words_follow_unicode_white_space(spark):
    text = " a b\x1cc　d\n\n"
    assert one(spark, T.words("t"), t=text) == text.split()
    assert one(spark, T.words("t"), t="") == []
    assert one(spark, T.tokens("t"), t="Café_1 don't") == ["café_1", "don", "t"]


def loop_lines(text):
    lines, out = text.split("\n"), []
    for i, line in enumerate(lines):
        before = lines[i - 1] if i else ""
        if i and before and not before.rstrip().endswith((".", ":", "!", "?", "|")) and line[:1].islower():
            out[-1] += " " + line
        else:
            out.append(line)
    return "\n".join(out)


def test_lines_join(spark):
    for text in ("one\ntwo\nThree.\nfour\n\nfive:\nsix", "", "a\nb\nc", "x|\ny"):
        assert one(spark, T.joined_lines("t"), t=text) == loop_lines(text)


def test_blocks_and_space(spark):
    assert one(spark, T.distinct_blocks("t"), t="# A\n\nabc\n\nabc \n\n# A\n\nab\n\nab") == "# A\n\nabc\n\n# A\n\nab\n\nab"
    assert one(spark, T.plain_space("t"), t=" a \t b\r\n  c\r\n\r\n\r\n\r\nd ") == "a b\nc\n\nd"
    assert one(spark, T.without_boilerplate("t"), t="Keep\n Was this page helpful? Yes\n© 2024 X. All rights reserved.\nSkip to content\nEnd") == "Keep\nEnd"
    assert one(spark, T.heading_path("t"), t="# A\nx\n## B\n#C\n# D") == "A > B > C"
    assert one(spark, U.nfkc(T.plain_punctuation("t")), t="“ﬁ” …") == '"fi" ...'


def test_page_types(spark):
    def kind(url="", title="", pdf=False, body=""):
        return one(spark, R.support_type("u", "t", "b", F.col("p")), u=url, t=title, p=pdf, b=body)

    assert kind(body="error code F9") == "error_code"
    assert kind(url="http://x/installation") == "installation"
    assert kind(body="the drum will not turn") == "troubleshooting"
    assert kind(pdf=True) == "manual"
    assert kind() == "general_support"
    assert kind(body="x" * 1000 + "error code") == "general_support"


def test_categories_brands_safety(spark):
    assert one(spark, R.url_category("u"), u="http://x.com/dishwashers/a") == "dishwasher"
    assert one(spark, R.url_category("u"), u="http://freezer.com/") == ""
    assert one(spark, R.category("u"), u="my Fidge is warm") == "refrigerator"
    assert one(spark, R.brand("u"), u="refrigerator") == "ge"
    assert one(spark, R.safety("u"), u="The washer leaks") == "gas"
    assert one(spark, R.whole_word_category("u"), u="dishwasher") == "dishwasher"
    assert one(spark, R.new_topic("u"), u="how do I clean my washer") is True


def test_markdown_of_pages(spark):
    html = "<html><title>T</title><body><nav>n</nav><main><h1>A</h1><p>x <b>y</b></p><ul><li>i</li></ul><table><tr><th>a<th>b</tr><tr><td>1</td><td>2</td></tr></table></main></body></html>"
    row = spark.createDataFrame([(html, "u"), (None, "v")], "html string, url string").select(U.html_markdown("html", "url").alias("m")).select("m.*").collect()
    assert row[0]["title"] == "T" and row[0]["body"].startswith("# A\n\nx y\n\n- i\n\n| a | b |\n|---|---|") and row[0]["status"] == "ok"
    assert row[1]["title"] == "v" and row[1]["body"] == ""


def test_texts_are_taken_a_piece_at_a_time(spark, monkeypatch):
    """A batch of long texts is never all of Python's strings at once; a long text is a piece of its own."""
    monkeypatch.setattr(U, "PIECE_BYTES", 10)
    texts = ["a" * 4, None, "b" * 4, "c" * 30, "d", "", "e" * 9]
    taken = [p.to_pylist() for p in U.pieces(pa.array(texts))]
    assert [x for p in taken for x in p] == texts and all(len(p) == 1 or sum(len(x or "") for x in p) <= 10 for p in taken) and len(taken) == 3
    assert [len(p) for p in U.pieces(pa.array([], pa.string()))] == [0]
    many = spark.createDataFrame([(i, "ﬁ" * (i % 7) if i % 5 else None) for i in range(50)], "i long, t string").repartition(1)
    got = many.select("i", "t", U.nfkc("t").alias("v"), U.html_markdown(F.concat(F.lit("<body><p>"), "t", F.lit("</p>")), F.lit("u")).alias("m")).collect()
    assert all(r["v"] == (None if r["t"] is None else "fi" * len(r["t"])) and r["m"]["body"] == (r["t"] or "") and r["m"]["status"] == "ok" for r in got) and len(got) == 50
