"""Main-text extraction: block rules, furniture, wrappers, hosts, and the driver's pages."""

import html as htmllib
import random
import re

import pytest

from factloom.llm import html_extract as he

SCHEMA = "page_id bigint, url string, html string"


def text_of(page):
    return he.infer([page]).read(page)


def own_structure(page):
    return he.structure(*he.tape(he.blocks(page))[:2])


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>a &amp; b&nbsp;c &lt;x&gt; &#233;</p><p> d\t\te </p>", "a & b c <x> é\nd e"),
        ("<body><nav><a>Menu</a></nav><article><h1>T</h1><p>one<p>two <b>bold</b> x</article><footer>f</footer>", "T\none\ntwo bold x"),
        ("<article><p>a<script>var x='<p>no</p>'</script>b</p><style>p{}</style><form><p>name</p></form></article>", "ab"),
        ("<article><div class='sidebar'><p>no</p></div><p>yes</p><div id=comments><p>first!</p></div></article>", "yes"),
        ("<article><p>yes</p><section class='reader-comments'>no</section><div role='complementary'>no</div><div hidden>no</div></article>", "yes"),
        ("<article><p>breaks<br>here<p>off<a href='x", "breaks here\noff"),
        ("<main><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></main><aside>no</aside>", "one\ntwo\na\nb"),
        ("<article>loose <p>para</p> tail</article>", "loose\npara\ntail"),
        ("<article><p>1 < 2 and <3</p></article>", "1 < 2 and <3"),
        ("<article><p>a<!-- <p>no</p> -->b</p><![CDATA[c&d]]></article>", "ab\nc&d"),
        ("<title>no</title><body><header>no</header><div class='ad'>no</div><p>text", "text"),
        ("<article class='post ad-free'><p>kept</p></article>", "kept"),
        ("<p>unknown &notanentity; &amp", "unknown &notanentity; &"),
    ],
)
def test_blocks(page, want):
    if "&notanentity" in page:
        want = htmllib.unescape("unknown &notanentity; &amp")
    assert text_of(page) == want


def test_alignment_infers_options_repeats_and_slots():
    pages = ["<article><h1>A</h1><p>x</p><p>y</p></article><div>Same</div>", "<article><h1>B</h1><h2>sub</h2><p>z</p></article><div>Same</div>"]
    wrapper = he.align(*[own_structure(p) for p in pages])
    assert he.expression(wrapper) == "article/h1 article/h2? article/p+ div"
    assert [n.text is None for n in wrapper] == [True, False, True, False]
    assert he.loaded(he.dumped(wrapper)) == wrapper


def test_folding_of_repeated_pairs():
    page = "<div>" + "".join(f"<dl><dt>k{i}</dt><dd>v{i}</dd></dl>" for i in range(50)) + "</div>"
    assert he.expression(own_structure(page)) == "div/dl/dt+ div/dl/dd+"
    found = he.blocks(page)
    places = he.Matcher(own_structure(page)).match(*he.tape(found)[:2])
    assert places == [0, 1] * 50


def story(rng, n):
    return " ".join(rng.choice("one two three four five six seven eight nine ten".split()) + str(rng.randrange(999)) for _ in range(n))


def neutral_host(rng, pages=30):
    """Pages whose tags and names say nothing: what is furniture shows only in comparison with other pages."""
    made = []
    for n in range(pages):
        paragraphs = [story(rng, rng.randrange(5, 30)) for _ in range(rng.randrange(1, 6))]
        menu = "".join(f"<div class='x1'><a href='/{k}'>{story(rng, 2)}</a></div>" for k in range(rng.randrange(2, 5)))
        notice = "<div>Welcome to our pages</div>" if n % 3 else ""
        body = "".join(f"<div>{p}</div>" for p in paragraphs)
        fixed = "<div>All rights reserved here</div>"
        between = "<div>Read this every day</div>"
        page = f"<body>{menu}{notice}<h2>{(title := story(rng, 4))}</h2>{between}{body}{fixed}<div class='z{n}'><a href='#'>{story(rng, 3)}</a> - </div></body>"
        made.append((page, "\n".join([title, *paragraphs])))
    return made


def test_neutral_pages_need_their_wrapper():
    made = neutral_host(random.Random(1))
    model = he.infer([p for p, _ in made])
    assert [model.read(p) for p, _ in made] == [t for _, t in made]
    # Without the wrapper the same pages keep their menus, notices and fixed lines.
    alone = [he.infer([p]).read(p) for p, _ in made]
    assert all(a != t for a, (_, t) in zip(alone, made, strict=True))
    bare = he.Reader((), [])
    assert all(bare.read(p) != t for p, t in made)


def test_the_same_slot_is_judged_by_its_place():
    """Paragraphs before a fixed line are the story, those behind it link lists, though tag and class agree."""
    rng = random.Random(4)
    made = []
    for _ in range(25):
        own = [story(rng, 12) for _ in range(3)]
        links = "".join(f"<p><a href='x'>{story(rng, 4)}</a></p>" for _ in range(3))
        made.append(("<body>" + "".join(f"<p>{p}</p>" for p in own) + "<p>More of this</p>" + links + "</body>", "\n".join(own)))
    model = he.infer([p for p, _ in made])
    assert [n.anchor for n in model.matcher.wrapper] == [False, True, False]
    assert [model.read(p) for p, _ in made] == [t for _, t in made]


def test_the_order_of_pages_does_not_matter(spark, monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(he, "FAN", 3)
    pages = [p for p, _ in neutral_host(rng, 24)] + [f"<body><p>{story(rng, 5)}</p><ul><li>{story(rng, 2)}</ul></body>" for _ in range(6)]
    made = []
    for _ in range(3):
        rng.shuffle(pages)
        rows = [(n, f"http://h.example/{n}", p) for n, p in enumerate(pages)] + [(99, "http://h.example/copy", pages[0])]
        df = spark.createDataFrame(rows, SCHEMA).repartition(rng.randrange(1, 5))
        got = {p: t for (p, t) in [(r.page, r.text) for r in he.extract_main_text(df).join(df.selectExpr("page_id id", "html page"), "id").collect()]}
        made.append(got)
        assert he.infer_wrappers(he.page_tapes(df, "url", "html")).count() == 1
    assert made[0] == made[1] == made[2]


def test_spark_reads_as_one_process_does(spark):
    rng = random.Random(2)
    made = neutral_host(rng, 20)
    rows = [(n, f"http://a.example/{n}", p) for n, (p, _) in enumerate(made)]
    rows += [(100 + n, f"http://b.example/{n}", f"<main><h1>{story(rng, 3)}</h1><p>Share this</p><p>{story(rng, 9)}</p></main><div>{story(rng, 5)}</div>") for n in range(40)]
    got = {r.id: r.text for r in he.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    for low, high in ((0, 100), (100, 200)):
        own = [r for r in rows if low <= r[0] < high]
        model = he.infer([r[2] for r in own])
        assert {r[0]: model.read(r[2]) for r in own} == {n: t for n, t in got.items() if low <= n < high}
    assert {n: t for n, t in got.items() if n < 100} == {n: t for n, (_, t) in enumerate(made)}
    assert all("Share this" not in t and t.count("\n") == 1 for n, t in got.items() if n >= 100)


@pytest.mark.parametrize("page", ["<a " * 30_000, '<a "' * 30_001 + ">", "<div>" * 40_000 + "x", "<div>" * 20_000 + "</section>" * 20_000 + "x", "<!-- " * 30_000, "<b>" * 20_000 + "</i>" * 20_000 + "x", "<script>" * 20_000])
def test_broken_and_deep_pages_take_linear_time_and_memory(page):
    import time
    import tracemalloc

    tracemalloc.start()
    start = time.perf_counter()
    he.blocks(page)
    assert time.perf_counter() - start < 20
    assert tracemalloc.get_traced_memory()[1] < 600 * len(page)
    tracemalloc.stop()


def test_constant_text_is_furniture_where_nothing_names_the_article(spark):
    rows = [(n, "http://h.example/" + str(n), f"<body><div><span>Welcome to this site</span></div><p>Story number {n}.</p></body>") for n in range(20)]
    got = {r.id: r.text for r in he.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {n: f"Story number {n}." for n in range(20)}


@pytest.mark.parametrize("few", [True, False])
def test_driver_pages(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(he, "BROADCAST_HOSTS", 0)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    got = {r.id: r.text for r in he.extract_main_text(pages).collect()}
    for name, page in source.items():
        body = page[page.index("<article>") + 9 : page.index("</article>")]
        parts = [" ".join(htmllib.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert got[name] == "\n".join(p for p in parts if p)


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://a/", ""), (3, "nonsense", "<"), (None, "HTTP://User@A.example:80/x", "<p>a"), (4, "http://a/", "<p>x" * 3000), (4, "http://a/", "<p>x" * 3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r.id), r.text[:9]) for r in he.extract_main_text(df).collect())
    assert got == [("1", ""), ("2", ""), ("3", "<"), ("4", "x\nx\nx\nx\nx"), ("4", "x\nx\nx\nx\nx"), ("None", "a")]
    assert he.extract_main_text(df.where("false")).count() == 0
    hosts = {r.h for r in df.select(he.host_of(df.url).alias("h")).collect()}
    assert hosts == {"", "a", "a.example"}


def test_random_tag_soup_never_fails():
    rng = random.Random(3)
    bits = ["<p>", "</p>", "<div class='x'>", "</div>", "<b>", "</article>", "<article>", "text ", "&amp;", "<", ">", "<br/>", "<li>", "<!--", "-->", "<script>", "</script>", "'", '"', "<a href="]
    for _ in range(300):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(60)))
        assert isinstance(text_of(page), str)


def test_cut_alignment_is_as_long_as_the_table(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(he, "ALIGN_PIECE", 6)
    for _ in range(200):
        one, two = ([rng.choice("abcd") for _ in range(rng.randrange(30))] for _ in range(2))
        whole, cut = he._matches(one, two, 10**9), he._matches(one, two, 6)
        assert len(whole) == len(cut) == he._common(one, two)[-1]
        assert all(one[i] == two[j] for i, j in cut) and all(a < c and b < d for (a, b), (c, d) in zip(cut, cut[1:], strict=False))


def test_long_structures_keep_their_fixed_texts():
    names = [f"x{i}" for i in range(2300)]
    one = tuple(he.Node(n, text="same" if i % 2 else f"a{i}") for i, n in enumerate(names))
    two = tuple(he.Node(n, text="same" if i % 2 else f"b{i}") for i, n in enumerate(names[:-1]))
    assert len(one) * len(two) > he.ALIGN_CELLS
    wrapper = he.align(one, two)
    assert [n.optional for n in wrapper] == [False] * 2299 + [True] and not any(n.repeated for n in wrapper)
    assert [n.path for n in wrapper if n.text is None] == names[::2]
