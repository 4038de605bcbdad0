"""Page extraction and the pipeline."""

import html as htmllib
import random
import re

import pytest
from oracle import data

from turnstream.llm import wrappers

pytest.importorskip("public_tokenizers")

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a>One</a></li><li><a>Two</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article class="post"><h1>Big &amp;
 news</h1><p>First <b>bold</b> para&shy;graph<br>goes on<p>Second &lt;one&gt; &#8212; &unknown; x</p><aside>Related</aside><div class="ad">Buy</div>
<ul><li>Item one<li>Item two</ul><form><label>Mail</label><input></form><section class="comments"><p>Nice post</p></section></article></main>
<div id="sidebar"><p>Side</p></div><footer>&copy; Site</footer></body></html>"""


def test_page(spark):
    rows = [(1, "http://a.example/x", PAGE), (2, None, None), (3, "http://a.example/y", ""), (4, "nohost", "<p>plain text only in this page</p>"), (1, "http://a.example/x", PAGE)]
    out = wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = "Big & news\n\nFirst bold para\xadgraph goes on\n\nSecond <one> — &unknown; x\n\nItem one\n\nItem two"
    assert sorted((r.page_id, r.text) for r in out) == sorted([(1, text), (1, text), (2, ""), (3, ""), (4, "plain text only in this page")])
    assert all(r.n_chars == len(r.text) for r in out)


def test_mixed_layouts_copies_and_odd_class_names(spark):
    plain = lambda i: f"<div class='nav'>Top</div><div class='text'><p>Plain text {i} of this page</p></div><div class='strip'>Same line</div>"
    main = "<article><p>Main text</p></article><div class='strip'>Same line</div>"
    pages = [("//a.example/x", main), *(("//a.example/x", plain(i)) for i in range(4)), (None, main), (None, "<div class='text'><p>No host</p></div>")]
    pages += [("//copies.example/", plain(9))] * 3 + [("//odd.example/", f"<div class='{c}'>Odd {k}</div>") for k, c in enumerate(["w-1/2", "md:w-2/3", "a\\b", 'q"r'])]
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)]
    found = {r.page_id: r.text for r in wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    wanted = ["Main text", *(f"Plain text {i} of this page" for i in range(4)), "Main text", "No host", *["Plain text 9 of this page\n\nSame line"] * 3, *(f"Odd {k}" for k in range(4))]
    assert [found[i] for i in range(len(rows))] == wanted


def test_empty_table(spark):
    assert wrappers.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def article(page: str) -> str:
    m = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
    blocks = [" ".join(htmllib.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", m[1] if m else "")]
    return "\n\n".join(b for b in blocks if b)


def test_all_pages(spark):
    pages = spark.read.parquet(data("sf0.01") + "/pages.parquet")
    found = {r.page_id: r.text for r in wrappers.extract_main_text(pages).collect()}
    assert found == {r.page_id: article(r.html) for r in pages.collect()}


def streams(rows) -> dict:
    out: dict = {}
    for r in rows:
        out.setdefault(wrappers.host_of(r.url), []).append(wrappers.with_page(*wrappers.stream_of(list(wrappers.page_tokens(r.html)))))
    return out


def test_wrappers_match_all_pages_of_their_host(spark):
    pages = spark.read.parquet(data("sf0.01") + "/pages.parquet")
    found = {r.host: wrappers.expression_of(r.what) for r in wrappers.infer_wrappers(wrappers._seen(pages)).collect()}
    for host, pages_of_host in streams(pages.collect()).items():
        for s in pages_of_host:
            assert wrappers.matches(found[host], s)


def test_alignment_makes_options_repeats_and_open_slots():
    tokens = lambda names: [f"<{c}" for c in names]
    e = wrappers.align(wrappers.fold(tokens("abxd")), wrappers.fold(tokens("abbbd")))
    assert wrappers.fold(e) == ("<a", ("+", ("<b",)), ("?", ("<x",)), "<d")
    for s in ("abxd", "abbd", "abd"):
        assert wrappers.matches(e, tokens(s))
    assert not wrappers.matches(e, tokens("ad"))
    text = lambda t, page: f"#p={t}=1={page}={page}"
    e = wrappers.align(("<a", text("s", "1"), "<b", text("x", "1")), ("<a", text("s", "2"), "<b", text("y", "2")))
    assert e == ("<a", "#p=s=2=1=2", "<b", "#p")
    assert wrappers.fold(["<a", text("s", "1"), "<a", text("t", "1")]) == (("+", ("<a", "#p")),)


def test_alignment_of_random_streams(monkeypatch):
    r = random.Random(4)
    for cells in (1_000_000, 0):
        monkeypatch.setattr(wrappers, "CELLS", cells)
        for _ in range(150):
            pages = [[f"<{c}" if c < "d" else f"#{c}={r.choice('xy')}=1={k}={k}" for c in r.choices("abcde", k=r.randrange(1, 14))] for k in range(4)]
            e = wrappers.fold(pages[0])
            for p in pages[1:]:
                e = wrappers.align(e, wrappers.fold(p))
            assert all(wrappers.matches(e, p) for p in pages), pages


def common_by_table(a: list, b: list) -> list[tuple]:
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_long_streams_are_aligned_as_short_ones(monkeypatch):
    """However much of the table is held, all that is in common is found: no other way for long streams."""
    r = random.Random(7)
    pairs = [([r.choice("abcdefgh") for _ in range(r.randrange(40))], [r.choice("abcdefgh") for _ in range(r.randrange(40))]) for _ in range(200)]
    whole = [wrappers._in_common(a, b) for a, b in pairs]
    for cells in (0, 100):
        monkeypatch.setattr(wrappers, "CELLS", cells)
        assert [wrappers._in_common(a, b) for a, b in pairs] == whole
    monkeypatch.undo()
    for (a, b), found in zip(pairs, whole, strict=True):
        assert all(a[i] == b[j] for i, j in found) and len(found) == len(common_by_table(a, b))
    a, b = (["<x", *(f"<{c}" for c in r.choices("abc", k=1100)), end] for end in ("<y", "<z"))
    assert len(a) * len(b) > wrappers.CELLS and len(wrappers._in_common(a, b)) == len(common_by_table(a, b))


def extracted(spark, pages: list[tuple]) -> list[str]:
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)]
    found = {r.page_id: r.text for r in wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [found[i] for i in range(len(rows))]


def test_the_expression_tells_template_from_article(spark, monkeypatch):
    """No main part, one class for all: only the alignment of pages says which paragraphs are the template's."""
    page = lambda i: "<div class='c'><p>Welcome to this site</p></div>" + "".join(f"<div class='c'><p>Own text {i} {k}</p></div>" for k in range(1 + i % 3)) + "<div class='c'><p>All rights kept</p></div>"
    pages = [("//a.example/x", page(i)) for i in range(8)]
    own = ["\n\n".join(f"Own text {i} {k}" for k in range(1 + i % 3)) for i in range(8)]
    assert extracted(spark, pages) == own
    one_shape = lambda seen: seen.filter("kind = 'shape'").dropDuplicates(["host"]).select("host", "what", "page", "pages")
    monkeypatch.setattr(wrappers, "infer_wrappers", one_shape)
    monkeypatch.setattr(wrappers, "remove", lambda *tables: None)
    assert extracted(spark, pages) != own


def test_one_fixed_and_one_open_slot_at_the_same_path(spark):
    """The fixed line also is one page's own text elsewhere; the same path holds both."""
    pages = [("//b.example/", f"<body><div><h2>Today</h2><p>Line of all pages</p><p>Story number {i}</p></div></body>") for i in range(5)]
    assert extracted(spark, pages) == [f"Story number {i}" for i in range(5)]
    copies = [("//c.example/", "<body><div><h2>Today</h2><p>Only story</p></div></body>")] * 5
    assert extracted(spark, copies) == ["Today\n\nOnly story"] * 5


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<div class=\"w-1/2\">text</div>", "text"),
        ("<div class='a \"b\" c'>text</div>", "text"),
        ("<article><p>Before <span class=\"ad\">BUY <b>NOW</b></span>after</p></article>", "Before after"),
        ("<article><p>a</p><div hidden>secret</div><p style='display: none'>b</p><p>c <i hidden>d</i>e</p></article>", "a\n\nc e"),
        ("<article><div class='news-alert-story'>Storm</div><div class='alert-box'>Sale</div></article>", "Storm"),
        ("<article><p>Text</p><div class='post-comments'>Nice</div></article>", "Text"),
        ("<article><p data-hidden='x'>kept</p><p class='md:w-2/3'>too</p></article>", "kept\n\ntoo"),
        ("<p>" + "long " * 100_000 + "</p>", ("long " * 100_000).strip()),
    ],
)
def test_places(spark, page, wanted):
    assert extracted(spark, [("//x.example/", page)]) == [wanted]


def test_clashing_columns_and_ties(spark):
    rows = [(1, "//a.example", "<p>x</p>", "t", 9, "s"), (1, "//a.example", "<p>x</p>", "t", 9, "s"), (None, None, "<p>x</p>", None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, page_host string")
    out = wrappers.extract_main_text(df, df.columns)
    assert sorted((r.page_id or 0, r.text, r.n_chars, r.page_host or "") for r in out.collect()) == [(0, "x", 1, ""), (1, "x", 1, "s"), (1, "x", 1, "s")]


def test_pipeline(spark):
    import corpus_pipeline

    from turnstream.llm import decontamination, near_duplicates, personal
    from turnstream.llm.store import materialise

    d = data("sf0.001")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(materialise(stage(spark, seen[-1], d), name))
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    assert [x.columns for x in seen[1:-1]] == [columns] * 4
    assert ids[2] == {r.doc_id for r in near_duplicates.near_duplicates(seen[1], percent=80).filter("kept").collect()}
    leaks = {r.doc_id for r in decontamination.find_leaks(seen[2], spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
    assert ids[3] == ids[2] - leaks
    assert ids[4] == ids[5] == ids[3]
    assert personal.find_personal_data(seen[4]).filter("size(base_spans) > 0").count() == 0
    last = {r.doc_id: r for r in seen[5].collect()}
    assert all(last[r.doc_id].decoded == r.text and last[r.doc_id].round_trip for r in seen[4].collect())
    assert len(ids[1]) > 0.7 * len(ids[0])


def test_stages_with_clashing_columns_nulls_and_copies(spark):
    """Columns named as the stages' own ones pass through; null, empty, long and repeated rows have their place."""
    import corpus_pipeline

    d = data("sf0.001")
    long = " ".join(f"word{k}" for k in range(30_000))
    texts = [None, "", " ", "mail a@b.example.com now", "mail a@b.example.com now", long, long]
    names = ["instances", "row_key", "base_spans", "pii_spans", "kept_id", "kept_copy", "score", "stage_quality_score", "row", "document", "ids"]
    rows = [(i, t, len(t or ""), *[i] * len(names)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, " + ", ".join(f"{n} int" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        found = out.collect()
        assert all(set(r[3:]) == {r.doc_id} for r in found)
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in found) == [0, 1, 2, 3, 5]
        if name == "personal_data":
            assert {r.doc_id: (r.text, r.n_chars) for r in found} == {i: (t and t.replace("a@b.example.com", "[email]"), len(t) - 8 * (i in (3, 4)) if t is not None else None) for i, t in enumerate(texts)}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).filter("round_trip").count() == len(texts)


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline

    d = data("sf0.001")
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
    assert docs.count() == 0


def test_class_words_lose_no_article(spark):
    """Classes that hold an article's or an advert's word among others: dates, teasers, words within sentences, prices."""
    pages = {
        '<div class="entry-meta"><span>12 May</span></div><div class="text"><p>Real article with some words</p></div>': "12 May\n\nReal article with some words",
        '<article class="teaser"><p>Teaser</p></article><div class="text"><p>Real article that is longer</p></div>': "Teaser\n\nReal article that is longer",
        '<div class="post"><p>He said <span class="related">this matter</span> is <b class="hidden-gem">good</b>.</p><p class="share-price">Share price rose</p></div>': "He said this matter is good.\n\nShare price rose",
        '<div class="blog-post"><p>Post <span class="ad">Buy now</span>goes <em hidden>never</em>on</p><p class="share">Share this</p><div class="share-bar"><p>On all sites</p></div></div>': "Post goes on",
        '<article><p>Long main text of this page</p></article><div class="strip"><p>Short</p></div>': "Long main text of this page",
    }
    rows = [(i, f"//{i}.example/", h) for i, h in enumerate(pages)]
    found = {r.page_id: r.text for r in wrappers.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [found[i] for i in range(len(rows))] == list(pages.values())
