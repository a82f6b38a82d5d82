import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from docloom.llm import bpe, hnsw, html_main, licenses, packing, preferences, quality, queries, sharding
from docloom.llm.html_main import extract_main_text, main_text
from docloom.llm.queries import tokenizer_path

TEXTS = [None, "", "The cat's 3 hats… <|endoftext|> \n\n x  y", "é" * 500, "日本 ’ ½ \x85 z", "word " * 9000, "A b", "A b"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, size long")


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs(spark), path), path).collect()}
    for i, t in enumerate(TEXTS):
        want = model.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == want and got[i]["decoded"] == model.decode(want, skip_special_tokens=False)
    assert bpe.encode(docs(spark, []), path).count() == 0
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in bpe.round_trip(docs(spark), path).collect():
        ids = model.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids, skip_special_tokens=False)))


def test_packing_keeps_all_ids(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs(spark), path, capacity=4096).collect()
    want = {}
    for i, t in enumerate(TEXTS):
        ids = model.encode(t or "", add_special_tokens=False).ids + [1]
        want |= {(i, k // 4096): (k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by.values():
        placed.sort()
        assert [o for o, _ in placed] == [sum(n for _, n in placed[:k]) for k in range(len(placed))] and sum(n for _, n in placed) <= 4096
    assert packing.pack_documents(docs(spark, []), path).count() == 0


def exact_bins(sizes, capacity):
    best = len(sizes)

    def go(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] >= sizes[k] and bins[j] not in bins[:j]:
                go(k + 1, [*bins[:j], bins[j] - sizes[k], *bins[j + 1 :]])
        go(k + 1, [*bins, capacity - sizes[k]])

    sizes.sort(reverse=True)
    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_bin_completion_is_optimal_on_small_cases(seed):
    sizes = [int(x) for x in np.random.default_rng(seed).integers(5, 70, 11)]
    plan = packing.complete_bins(dict(Counter(sizes)), 100)
    used = Counter()
    for pattern, uses in plan:
        assert sum(pattern) <= 100
        for s in pattern:
            used[s] += uses
    assert used == Counter(sizes) and sum(u for _, u in plan) == exact_bins(sizes, 100)


@pytest.mark.parametrize("sizes", [[9] * 20_000, "3 to 11", [1] * 5000, [4096] * 3 + [1]])
def test_short_pieces_reach_the_lower_bound_by_completion(sizes):
    sizes = np.random.default_rng(4).integers(3, 12, 30_000).tolist() if sizes == "3 to 11" else sizes
    count, least = dict(Counter(sizes)), -(-sum(sizes) // 4096)
    plan, _, ended = packing._descend(count, 4096, [], 10**18)
    assert ended and sum(u for _, u in plan) == least == sum(u for _, u in packing.complete_bins(count, 4096))
    used = Counter()
    for pattern, uses in plan:
        assert sum(pattern) <= 4096
        used.update({s: k * uses for s, k in Counter(pattern).items()})
    assert used == Counter(sizes)


def test_quality_features_and_order(spark):
    rows = docs(spark, [None, "", "w " * 30, " ".join(f"w{i}" for i in range(40)), "a b\na b\n a b\n" + " ".join(map(str, range(100, 130))), "#" * 9 + " x" * 30, " ".join(f"w{i}" for i in range(40))])
    got = {r["doc_id"]: r for r in quality.judge(rows, report=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]).collect()}
    assert [got[i]["kept"] for i in range(7)] == [False, False, False, True, True, False, True]
    assert (got[2]["n_words"], got[2]["n_repeat_words"], got[2]["base_failed"]) == (30, 30, True)
    assert got[4]["n_dup_lines"] == 1 and got[5]["n_symbols"] == 9 and got[3]["word_chars"] == 110
    a, b = (quality.keep_good(rows, order).toPandas()["doc_id"].tolist() for order in (quality.default_rules(), quality.default_rules()[::-1]))
    assert sorted(a) == sorted(b) == [3, 4, 6] and quality.keep_good(rows).columns == rows.columns
    assert quality.judge(docs(spark, [])).count() == 0


def test_shards_are_even_and_slots_gapless(spark):
    texts = ["copy " * 20] * 300 + [f"text {i} " * (i % 50) for i in range(600)] + [None, ""]
    rows = sharding.shard_documents(docs(spark, texts)).collect()
    assert len(rows) == len(texts)
    bytes_of, slots = Counter(), {}
    for r in rows:
        bytes_of[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(bytes_of) == set(range(8)) and max(bytes_of.values()) - min(bytes_of.values()) <= 2 * max(r["size"] for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(docs(spark, [])).count() == 0


def test_sharding_query_equals_brute_force(spark, tmp_path):
    import xxhash

    rng = np.random.default_rng(8)
    texts = ["copy " * 20] * 200 + ["word " * int(n) + f"é{i}" for i, n in enumerate(rng.integers(0, 60, 500))] + [None, "", None]
    spark.createDataFrame([(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op9_sharding(spark, str(tmp_path)).collect()
    text_of = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()}
    key = lambda i: (h - 2**64 if (h := xxhash.xxh64_intdigest(text_of[i], 42)) >= 2**63 else h, i)
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))] == sorted(text_of, key=key)
    assert all((r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text_of[r["doc_id"]]) + 1, zlib.crc32(text_of[r["doc_id"]]), "bytes", None) for r in rows)
    size, n = Counter(), Counter(r["shard"] for r in rows)
    for r in rows:
        size[r["shard"]] += r["size"]
        assert 0 <= r["slot"] < n[r["shard"]]
    even = sum(size.values()) / 8
    assert max(abs(x - even) for x in size.values()) <= 2 * max(len(t) + 1 for t in text_of.values())


def test_names_of_carried_columns_may_clash(spark):
    from docloom.llm.line_dedup import dedup_lines
    from docloom.llm.minhash import keep_one_of_each

    names = ["doc_id", "text", "key_", "id_", "h_", "stay", "row", "a_", "p_", "h", "t", "id", "kept", "n", "hash", "doc"]
    rows = spark.createDataFrame([(i, t, *[f"{i}{c}" for c in names[2:]]) for i, t in enumerate(["a b c\nd e f", "d e f\nx", "x"])], ", ".join(["doc_id long", "text string", *(f"`{c}` string" for c in names[2:])]))
    lines = {r["doc_id"]: r for r in dedup_lines(rows).collect()}
    assert [lines[i]["text"] for i in range(3)] == ["a b c\nd e f", "x", ""] and dedup_lines(rows).columns == names
    assert all(r[c] == f"{i}{c}" for i, r in lines.items() for c in names[2:])
    sharded = sharding.shard_documents(rows, 2)
    assert sorted(sharded.columns) == sorted([*names, "size", "slot", "shard"]) and all(r["a_"] == f"{r['doc_id']}a_" for r in sharded.collect())
    assert keep_one_of_each(rows).columns == names and keep_one_of_each(rows).count() == 3


def test_recall_over_many_full_shards(spark):
    rng = np.random.default_rng(12)
    v = (rng.normal(size=(40, 24))[rng.integers(0, 40, 4000)] + 0.6 * rng.normal(size=(4000, 24))).astype(np.float32)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = hnsw.nearest(table, table.where("vec_id % 100 = 0"), k=10, shard_rows=500).collect()
    found, hit = {}, 0
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in range(0, 4000, 100):
        far = ((v.astype(float) - v[q].astype(float)) ** 2).sum(1)
        far[q] = np.inf
        hit += len(set(np.argsort(far, kind="stable")[:10].tolist()) & found[q])
    assert len(found) == 40 and hit / 400 >= 0.95
    assert [hnsw.shard_count(n) for n in (0, 4096, 4097, 10**6, 10**9)] == [1, 1, 2, 245, 3815]


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    v[300:380] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, 2.0]), (904, []), (905, [None] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = hnsw.nearest(table, table.where("vec_id % 100 = 0"), k=10, shard_rows=150).collect()
    hit = total = 0
    for q in range(0, 600, 100):
        far = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(600), far)) if i != q][:10]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(far[m[1]] - m[2]) < 1e-12 for m in mine)
        hit, total = hit + len(set(want) & {m[1] for m in mine}), total + 10
        if q in (0, 300):
            assert [m[1] for m in mine] == want
    assert hit / total >= 0.9
    assert hnsw.nearest(table.limit(0), table.limit(0)).count() == 0


def test_repeated_rows_take_no_place_of_other_ids(spark):
    near, far = [1.0, 0.0], [0.0, 1.0]
    rows = [(7, near)] * 11 + [(8, near)] + [(i, far) for i in range(20, 40) for _ in range(2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(7, near), (100, far)], "vec_id long, embedding array<float>")
    got = hnsw.nearest(table, asked, k=10).collect()
    found = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (7, 100)}
    assert found == {7: [8, *range(20, 29)], 100: list(range(20, 30))}


@pytest.mark.parametrize("n, shard_rows", [(4096, 4096), (5000, 5000)])
def test_recall_of_whole_shards(spark, n, shard_rows):
    rng = np.random.default_rng(n + shard_rows)
    vectors = (rng.normal(size=(40, 24))[rng.integers(0, 40, n)] + 0.4 * rng.normal(size=(n, 24))).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    asked = np.arange(0, n, 100)
    got = hnsw.nearest(rows, rows.where("vec_id % 100 = 0"), k=10, shard_rows=shard_rows).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    gap = np.sqrt(((vectors[asked].astype(float)[:, None] - vectors.astype(float)[None]) ** 2).sum(2))
    gap[np.arange(len(asked)), asked] = np.inf
    best = np.argsort(gap, 1, kind="stable")[:, :10]
    recall = sum(len(found[q] & set(b.tolist())) for q, b in zip(asked.tolist(), best, strict=True)) / best.size
    assert len(found) == len(asked) and recall >= 0.95, recall


def test_main_text():
    page = '<body class="x"><div class="menu">m</div><div id="c"><h1>T</h1><p>' + "Long text. " * 20 + '<p>Short.<p class="notice">n<p>a&nbsp;&lt;b&gt;</div><div class="comments">c</div><footer>f</footer><script>"</p>"</script>'
    assert main_text(page) == "T " + "Long text. " * 20 + "Short. a <b>"
    assert main_text("<article><header><h1>H</h1><p>by</p></header>x<br>y<aside>n</aside></article>") == "H x y"
    assert main_text("") == main_text("<p") == "" and main_text("a &amp; b") == "a & b"


def brute_main_text(page):
    """The same rules on a parsed tree: lines with the path of elements around them, a convolution, and
    the common part of the content lines' paths."""
    names = {"sidebar": 1, "post": 0, "x1": 0, "content has-sidebar": 1 / 3, "post comments": 1 / 2}
    import xml.etree.ElementTree as ET

    lines, parts, tags, numbers = [], [], 0, iter(range(10**6))

    def flush(path):
        nonlocal tags
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            lines.append((text, tags, path))
            tags = 0

    def walk(e, path, out):
        nonlocal tags
        block = e.tag in html_main._BLOCK
        if block:
            flush(path)
        tags += 1
        out = out or e.tag in {"nav", "footer", "aside"}
        own = (*path, (next(numbers), e.tag, names.get(e.get("class"), 0.5 if e.tag == "form" else 0))) if block else path
        if not out:
            parts.append(e.text or "")
        for x in e:
            walk(x, own, out)
            if not out:
                parts.append(x.tail or "")
        if block:
            flush(own)
        tags += 1

    walk(ET.fromstring(page), (), False)
    def weights(rows):
        ratio = np.array([len(t) / max(1, k) for t, k, _ in rows])
        kernel = np.exp(-np.arange(-2, 3) ** 2 / 2)
        level = np.convolve(np.pad(ratio, 2, mode="edge"), kernel / kernel.sum(), "valid")
        good = (level > level.std()) & (ratio >= 0.1 * level.std())
        good = good if good.any() else level == level.max()
        return [len(t) * bool(g) for (t, _, _), g in zip(rows, good, strict=True)]

    part = lambda x, rows, w: sum(v for (_, _, p), v in zip(rows, w, strict=True) if x in p) / sum(w)
    if lines:
        w = weights(lines)
        gone = {x for _, _, p in lines for x in p if x[2] and part(x, lines, w) <= 0.25 + 0.65 * x[2]}
        lines = [row for row in lines if not gone & set(row[2])]
    if not lines:
        return ""
    w = weights(lines)
    elements = sorted({x for _, _, p in lines for x in p})
    region = next((x for tag in ("article", "main") for x in elements if x[1] == tag and part(x, lines, w) > 0.5), None)
    paths = [p for (_, _, p), v in zip(lines, w, strict=True) if v]
    common = [x for k, x in enumerate(min(paths, key=len)) if all(p[k] == x for p in paths)]
    while region is None and common:
        region = common[-1] if common[-1][1] in html_main._REGION else None
        common.pop()
    return " ".join(t for t, _, p in lines if region is None or region in p)


def random_page(rng):
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 99, n))

    def inline():
        return "".join(rng.choice([f"{word(int(rng.integers(1, 60)))} ", f"<b>{word(2)}</b> ", f'<a href="x">{word(1)}</a> '], p=[0.6, 0.2, 0.2]) for _ in range(int(rng.integers(1, 5))))

    def block(depth):
        if depth == 0 or rng.random() < 0.3:
            tag = rng.choice(["p", "h2", "blockquote", "li"])
            return f"<{tag}>{inline() if rng.random() < 0.7 else word(2)}</{tag}>"
        tag = rng.choice(["div", "section", "article", "main", "nav", "footer", "ul", "aside", "form"], p=[0.35, 0.2, 0.12, 0.08, 0.05, 0.05, 0.06, 0.05, 0.04])
        mark = rng.choice(["", "", "", ' class="sidebar"', ' class="post"', ' class="content has-sidebar"', ' class="post comments"']) if tag == "div" else ""
        return f"<{tag}{mark}>{''.join(block(depth - 1) for _ in range(int(rng.integers(1, 5))))}</{tag}>"

    return f"<body>{''.join(block(4) for _ in range(int(rng.integers(1, 5))))}</body>"


def test_main_text_equals_brute_force(monkeypatch):
    pages = [random_page(np.random.default_rng(k)) for k in range(300)]
    got = [main_text(p) for p in pages]
    assert got == [brute_main_text(p) for p in pages]
    for constant in (True, False):  # the scores decide
        monkeypatch.setattr(html_main, "content_lines", lambda ratios, c=constant: [c] * len(ratios))
        assert sum(a != main_text(p) for a, p in zip(got, pages, strict=True)) > 30  # of 300


def site(rng, wrapper, end):
    """A page without any class that is known, or with a wrapper whose names speak against it: links, an article,
    teasers and a notice. Gives the page and the article's text."""
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 999, n))
    paragraphs = [word(int(rng.integers(25, 90))) for _ in range(int(rng.integers(3, 9)))]
    links = "".join(f"<li><a href=/{k}>{word(1)}</a></li>" for k in range(8))
    teasers = "".join(f"<div class=k2><a href=/{k}><b>{word(2)}</b></a><br><i>{word(2)}</i></div>" for k in range(4))
    body = f"<h1>{paragraphs[0][:20]}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<body><div class=k1><ul>{links}</ul></div>{wrapper}<div class=k3>{body}</div>{end}<div class=k4>{teasers}</div><div class=k5><a href=/c>{word(2)}</a></div></body>", " ".join([paragraphs[0][:20].strip(), *paragraphs])


def test_ratios_find_articles_without_known_names(monkeypatch):
    kinds = [("", "")] + [(f"<{tag} {name}>", f"</{tag}>") for tag, name in (("form", "id=aspnetForm"), ("div", "class='content has-sidebar'"), ("div", "class='page with-fixed-header'"), ("div", "class='post comments-open'"), ("div", "class='social science essay'"), ("div", "id=legal-news-story"), ("div", "id=search-article"))]
    made = [site(np.random.default_rng(k), *kinds[k % len(kinds)]) for k in range(200)]
    assert all(main_text(page) == text for page, text in made)
    monkeypatch.setattr(html_main, "content_lines", lambda ratios: [True] * len(ratios))
    assert sum(main_text(page) != text for page, text in made) == 200  # without the scores no page is right


def test_named_parts_beside_and_inside_the_article():
    para = "".join(f"<p>{'Long text of the page, with words. ' * 6}{i}.</p>" for i in range(4))
    want = main_text(f"<body>{para}")
    aside = f"<p>{'comment text is here. ' * 9}</p>"
    for name in ("class=comments", "id=comments", "class=sidebar", "class='ad'", "role=navigation", "class='cookie-notice'", "class='related-posts'"):
        assert main_text(f"<body><div class=c9>{para}</div><div {name}>{aside}</div>") == main_text(f"<body><div class=c9>{para}<div {name}>{aside}</div></div>") == want, name
    assert main_text(f"<body><article>{para}</article><div class=more>{aside}</div>") == want
    assert main_text(f"<body><form><input><p>{'x ' * 9}</form>{para}") == want
    assert main_text(f"<body><div class=comments>{aside * 9}</div>") != "" and main_text("<body><div hidden><p>x</div>") == ""


def test_main_text_is_linear_in_odd_pages():
    import time

    began = time.perf_counter()
    for page in ("<a" * 100_000, "<div>" * 20_000 + "x" + "</section>" * 20_000, "<article>" + "<div class=header><header>" * 5_000 + "<h1>x</h1>" * 5_000, "<div>" * 5_000 + "<p>x</p>" * 5_000):
        main_text(page)
    assert time.perf_counter() - began < 20


def test_main_text_is_where_the_content_lines_are():
    long = "Long text of the page, with words. " * 12
    cards = "".join(f"<article><h3>Card {i}</h3><a href=x>more</a></article>" for i in range(3))
    assert main_text(f"<body><div class=post><p>{long}<p>{long}</div>{cards}") == (long + long).strip()
    assert main_text(f"<body><main><p>{long}<article><p>Card</article><p>{long}</main><p>out") == f"{long}Card {long}".strip()
    assert main_text(f"<body><article><p>{long}<p>short</article><div><p>out</div>") == f"{long}short"


def test_main_text_holds_every_content_line():
    long, part = "Long text of the page, with words. " * 12, "One more part of the text, with words. " * 7
    parts = f"<section><p>{long}<p>{long}</section><section><p>{part}</section>"
    assert main_text(f"<body><div id=content>{parts}</div>") == (long + long + part).strip()
    assert main_text(f"<body><article><p>{long}</article><article><p>Yes.</article><article><p>{long}</article>") == f"{long}Yes. {long}".strip()
    for tag in ("<blockquote>", "<ul><li>", "<table><tr><td>"):
        end = "".join(f"</{t[1:]}" for t in reversed(tag.replace("><", "> <").split()))
        assert main_text(f"<body><div id=c><p>Before.{tag}{long}{long}{end}<p>After.</div>") == f"Before. {long}{long}After."


def test_pages_with_nulls_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, None, "k"), (None, "<p>x</p>", None)], "page_id long, html string, text string")
    assert sorted((r["text"], r["n_chars"]) for r in extract_main_text(rows).collect()) == [("", 0), ("x", 1)]
    assert extract_main_text(rows.limit(0)).count() == 0


def test_licenses(spark):
    assert licenses.model()[0][0] == "unknown" and 0.1 < licenses.model()[3] < 0.95  # set by held-out sentences, off the ends of its grid
    texts = ["x\nReleased under the MIT License.\ny", "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.", "She studied at MIT.", "a license", None, ""]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert [got[i] for i in range(6)] == ["mit", "apache-2.0,cc-by-nc-4.0", "", "", "", ""]
    held = [(f, t) for f, texts in licenses.NOTICES.items() for t in texts]
    found = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(docs(spark, ["zorb " + t + " quix" for _, t in held])).collect()}
    assert sum(found[i] == f for i, (f, _) in enumerate(held)) >= 0.9 * len(held)
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


def test_held_out_licence_sentences(spark):
    told = [(c, t) for c, texts in licenses.sentences(held=True) for t in texts]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(docs(spark, ["A plain line.\n" + t + "\nMore words." for _, t in told])).collect()}
    named = [(c, got[i]) for i, (c, _) in enumerate(told) if c != "unknown"]
    assert sum(c == g for c, g in named) >= 0.9 * len(named) and sum(g not in ("", c) for c, g in named) <= 0.02 * len(named)
    assert all(got[i] == "" for i, (c, _) in enumerate(told) if c == "unknown")
    texts = ["The code is MIT-licensed.", "You can use this under MIT terms.", "Published under the Apache licence v2", "Our tool comes under the Boost Software License 1.0", "MIT students like this.", "An eclipse in public."]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert [got[i] for i in range(6)] == ["mit", "mit", "apache-2.0", "bsl-1.0", "", ""]


def test_versions_neighbours_negations_and_several_families(spark):
    told = [
        ("Licensed under the GNU General Public License version 2", "gpl-2.0"),
        ("Released under the GNU Lesser General Public License, version 2.1", "lgpl-2.1"),
        ("BSD 2-Clause License", ""),
        ("Licensed under the BSD 2-Clause License.", "bsd-2-clause"),
        ("Licensed under the Apache License, Version 1.1", "apache-1.1"),
        ("Licensed under the Mozilla Public License 1.1", "mpl-1.1"),
        ("Licensed under CC BY-ND 4.0", "cc-by-nd-4.0"),
        ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc-sa-4.0"),
        ("Licensed under MIT-0", "mit-0"),
        ("This is not licensed under the MIT License", ""),
        ("The MIT license was invented in Boston", ""),
        ("License: MIT OR Apache-2.0", "apache-2.0,mit"),
        ("Dual licensed under MIT and Apache 2.0", "apache-2.0,mit"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
        ("Licensed under the GNU General Public License, version 3", "gpl-3.0"),
        ("Licensed under the GNU Affero General Public License, version 3", "agpl-3.0"),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl-2.0"),
        ("Stanford or MIT", ""),
        ("The code is no longer licensed under the Apache License, Version 2.0", ""),
        ("Licensed under the MIT license", "mit"),
        ("Released under the Eclipse Public License 2.0", "epl-2.0"),
        ("SPDX-License-Identifier: GPL-2.0-only OR BSD-2-Clause", "bsd-2-clause,gpl-2.0"),
    ]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(docs(spark, ["word " * 5 + "\n" + t for t, _ in told])).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(told)] == told


def test_wrapped_notices(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    comment = lambda t: "\n".join(f" * {x}" for x in t.split("\n"))
    texts = [gpl, bsd, "some words\n" + comment(bsd) + "\nmore words", comment(gpl) + "\n\n" + bsd, "\n".join(bsd.split()), "all\nrights reserved.", "x released under the\nMIT License.", bsd.replace("\n", "\n\n"), "word " * 300 + "\nReleased under the MIT License.\nShe studied at MIT."]
    got = {r["doc_id"]: (r["licenses"], r["n_license_lines"]) for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert [got[i][0] for i in range(9)] == ["gpl-3.0", "bsd-3-clause", "bsd-3-clause", "bsd-3-clause,gpl-3.0", "bsd-3-clause", "proprietary", "mit", "", "mit"]
    assert got[5][1] == got[6][1] == 2 and got[8][1] == 1


def test_preferences(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "good"), (1, 0, "user", "q"), (1, 1, "assistant", "bad"), (1, 2, "user", None), (2, 0, None, "only"), (None, 0, "user", "x")]
    t = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    convs = preferences.gathered(t)
    got = {r["pair_id"]: r for r in preferences.format_preferences(preferences.neighbouring_pairs(convs), convs).collect()}
    r = got[0]
    assert (r["n_common"], r["prompt"]) == (1, "<|im_start|>user\nq<|im_end|>\n")
    for side, said in (("chosen", "good"), ("rejected", "bad")):
        assert [r[side][x["first"] : x["end"]] for x in r[f"{side}_spans"]] == [f"{said}<|im_end|>\n"]
    assert got[1]["rejected"] == "" and got[1]["n_common"] == 0 and (got[0]["usable"], got[1]["usable"]) == (True, False)
    assert preferences.gathered(t.limit(0)).count() == 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_dedup import brute, brute_lines
    from tokenizers import Tokenizer

    rng = np.random.default_rng(6)
    line = lambda k, n=12: " ".join(f"w{k}x{x}" for x in rng.integers(0, 900, n))
    good = lambda k: [line(k) for _ in range(6)]
    base = [good(k) for k in range(8)]
    texts = ["\n".join(b) for b in base] + ["\n".join(base[0]), "too short", "spam " * 100, None, "", "#" * 30 + " x" * 40, "\n".join(["rep a b c"] * 12 + base[1])]
    texts += ["\n".join([*good(20 + k), base[2][k]]) for k in range(3)] + ["\n".join(" ".join([*x.split()[:-1], "new"]) for x in base[3]), "\n".join(base[4]) + " tail", " ".join(base[5]), " ".join([*base[5][:5], "other end"])]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs_.write.parquet(str(tmp_path / "documents.parquet"))

    def passes(t):
        w, parts = (t or "").split(), (t or "").split("\n")
        held = [x for x in parts if x.strip()]
        again = {k for k in range(len(w) - 7) for j in range(len(w) - 7) if k != j and w[k : k + 8] == w[j : j + 8]}
        repeat, dup = len({k + i for k in again for i in range(8)}), len(held) - len(set(held))
        chars, stutter = sum(map(len, w)), sum(a == b for a, b in zip(w, w[1:], strict=False))
        return not (len(w) < 20 or 100 * repeat > 30 * len(w) or 10 * sum((t or "").count(c) for c in "#*$%&|<>") > len(w) or chars < 2 * len(w) or chars > 12 * len(w) or dup >= 3 and 100 * dup > 30 * len(parts) or 100 * stutter > 30 * len(w))

    want = [(i, t) for i, t in enumerate(texts) if passes(t)]
    found, d = docs_, str(tmp_path)
    check = lambda x: sorted((r["doc_id"], r["text"]) for r in x.collect())
    found = corpus_pipeline.quality(spark, found, d)
    assert check(found) == want and 8 < len(want) < len(texts)
    cut = brute_lines(want)
    want = [(i, cut[i]) for i, t in want if cut[i] == t or cut[i].strip()]
    found = corpus_pipeline.lines(spark, found, d)
    assert check(found) == want and all(r["n_chars"] == len(r["text"]) for r in found.collect()) and found.dtypes == docs_.dtypes
    comp = brute(want, 80)
    want = [(i, t) for i, t in want if comp[i] == i]
    found = corpus_pipeline.near_duplicates(spark, found, d)
    assert check(found) == want
    model = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    length = {i: len(model.encode(t, add_special_tokens=False).ids) + 1 for i, t in want}
    packed = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"]: r["length"] for r in packed} == length and len({r["sequence_id"] for r in packed}) == -(-sum(length.values()) // 4096)
