import random
from html.parser import HTMLParser

from veilstat.llm import html_extract as he

rng = random.Random(5)


def words(n):
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota".split()) + str(rng.randint(0, 99)) for _ in range(n))


def page(kind, i):
    paragraphs = [words(rng.randint(12, 40)) for _ in range(rng.randint(1, 5))]
    head = words(5)
    body = "".join(f"<p><b>{p}<br>" if rng.random() < 0.3 else f"<p>{p}</p>" for p in paragraphs)
    menu = "<nav><ul>" + "".join(f'<li><a href="/{k}">{words(1)}</a></li>' for k in range(rng.randint(3, 7))) + "</ul></nav>"
    side = f'<div class="side-bar"><p>{words(8)}</p></div>' if rng.random() < 0.5 else ""
    comments = f'<section id="comments"><h3>Comments</h3><p>{words(9)}</p></section>'
    form = "<form><label>Mail</label><input name=x><button>Subscribe</button></form>"
    if kind == "article":
        content = f"<article><h1>{head}</h1>{body}{comments}</article>"
    else:  # no landmark at all: only the wrapper tells the slots from the template
        content = f'<div class="b7"><div class="c{i}"><h1>{head}</h1>{body}</div></div><div class="z">All our offers end soon, so have a look at them now</div>'
    html = f'<!DOCTYPE html><html><head><title>{head}</title><script>var a="<p>no</p>";</script></head><body>{menu}<!-- x --><div class="ad">{words(6)}</div>{content}{side}{form}<footer>&copy; {words(3)}</footer></body></html>'
    return html, "\n".join([head, *paragraphs])


def test_hosts_with_and_without_landmarks(spark):
    rows, want = [], {}
    for i in range(60):
        kind = ("article", "bare")[i % 2]
        html, text = page(kind, i)
        want[i] = text
        rows.append((i, f"https://{kind}.example.org/{i}", html, "x"))
    rows += [(100, None, None, "x"), (101, "https://article.example.org/e", "", "x"), (101, "https://article.example.org/e", "", "x"), (102, "no url", "<article>a &amp; b<br>c", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in he.extract(df).collect()}
    assert he.extract(df).count() == len(rows)
    for i, text in want.items():
        assert got[i].text == text, (i, got[i].text, text)
        assert got[i].n_chars == len(text)
    assert got[100].text == got[101].text == "" and got[102].text == "a & b c"
    assert he.extract(df.limit(0)).count() == 0


def test_wrapper_has_slots_repeats_and_optionals():
    pages = [he.structure(he.tokens(page("bare", i)[0])) for i in range(10)]
    text = str(he.wrapper_of(pages))
    assert "['r', " in text and "['o', " in text and "None" in text


def test_odd_markup_is_linear():
    for html in ("<" * 100_000, "<!--" * 50_000, '<a b="' * 30_000, "<p>" * 50_000, "<div>" * 30_000 + "x", "&" * 100_000, "<script>" * 20_000, "x" * 200_000):
        he.main_text(html, None)


def test_references_and_space():
    assert he.main_text("<main><p> a&nbsp;b\n\t c &lt;x&gt; &#233;</p><p>\n</p>d</main>", None) == "a b c <x> é\nd"


def extracted(spark, pages):
    df = spark.createDataFrame([(i, f"https://one.example.org/{i}", h) for i, h in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    return [r.text for r in he.extract(df).orderBy("page_id").collect()]


def test_wrapper_decides_on_pages_with_landmarks(spark):
    pages, want = [], []
    for i in range(24):
        head, texts = words(4), [words(rng.randint(3, 30)) for _ in range(rng.randint(1, 4))]
        body = "".join(f"<p>{t}</p>" for t in texts)
        pages.append(f"<body><nav><p>{words(3)}</p></nav><article><h1>{head}</h1>{body}<p>Write to us if you know more about this story</p><div>Printed with all rights kept</div></article></body>")
        want.append("\n".join([head, *texts]))
    pages += [pages[0]] * 5  # copies of a page do not make its text a template
    want += [want[0]] * 5
    assert extracted(spark, pages) == want


def test_text_outside_of_a_teaser_article(spark):
    pages, want = [], []
    for _ in range(12):
        head, texts = words(4), [words(30) for _ in range(3)]
        pages.append(f'<body><article><p>{words(5)}</p></article><div class="text"><h2>{head}</h2>{"".join(f"<p>{t}</p>" for t in texts)}</div></body>')
        want.append("\n".join([head, *texts]))
    assert extracted(spark, pages) == want


def test_copies_do_not_make_a_template(spark):
    page = f"<article><h1>{words(3)}</h1><p>{words(9)}</p></article>"
    assert extracted(spark, [page] * 6) == [he.main_text(page, None)] * 6 != [""] * 6


def test_many_templates_and_short_blocks_of_a_host(spark):
    pages, want = [], []
    for i in range(120):  # 40 templates, three pages each, so twelve pages cannot show them all
        name = "".join(chr(97 + int(c)) for c in str(100 + i % 40))
        texts = [words(2), *[words(rng.randint(1, 30)) for _ in range(rng.randint(4, 6))], words(1)]
        cells = [words(1) for _ in range(rng.randint(2, 6))]
        h, b, (r, c) = f"h{1 + i % 5}", ("p", "blockquote", "pre", "address", "section", "figure", "center", "h6")[i % 8], (("ul", "li"), ("ol", "li"), ("table", "td"), ("dl", "dd"))[i % 40 // 10]
        inner = f"<{h}>{texts[0]}</{h}>" + "".join(f"<{b}>{t}</{b}>" for t in texts[1:]) + f"<{r}>" + "".join(f"<{c}>{x}</{c}>" for x in cells) + f"</{r}>"
        pages.append(f'<body><div class="t{name}">{inner}</div><div class="end">All our offers end soon, so have a look at them now</div></body>')
        want.append("\n".join([*texts, *cells]))
    assert extracted(spark, pages) == want


def test_tail_of_long_pages(spark):
    pages, want = [], []
    for _ in range(4):
        rows = [words(2) for _ in range(1500)]
        tail = words(2)
        pages.append('<body><div class="long">' + "".join(f"<h3>{a}</h3><p>{a}</p><hr>" for a in rows) + f"<h5>{tail}</h5></div><div class='end'>The same words on every page of this host</div></body>")
        want.append("\n".join([*[x for a in rows for x in (a, a)], tail]))
    assert extracted(spark, pages) == want


def test_long_attributes_and_names():
    assert he.main_text('<article><p title="' + "x" * 9000 + ' > leaked">a</p><' + "y" * 200 + ">b</article>", None) == "a\nb"
    assert he.main_text("<main><p it's>one</p><p>two \" three</p></main>", None) == 'one\ntwo " three'


def test_class_names_within_the_article():
    inner = '<section class="legal">Law</section><div class="social">Club</div><div class="notice-period">Month</div>'
    out = '<div class="notice">no</div><div class="cookie-banner">no</div><div class="site-menu">no</div><aside>no</aside><section class="comment-list">no</section>'
    assert he.main_text(f"<main><p>Body</p>{inner}{out}</main>", None) == "Body\nLaw\nClub\nMonth"
    assert he.main_text(f"<body>{inner}<article><p>Body of it</p></article></body>", None) == "Body of it"


def test_title_above_the_article():
    assert he.main_text("<body><h1>Title</h1><article><p>a</p><p>b</p></article></body>", None) == "Title\na\nb"
    assert he.main_text("<body><header><h1>Site</h1></header><p>x</p><article><p>a</p><p>b and more</p></article></body>", None) == "a\nb and more"


def test_rows_repeated_many_times(spark):
    """A page 400 times among others gives its whole text each time, short blocks too."""
    once, _ = page("bare", 1)
    pages = [f"<body><div class='x'><h4>{words(1)}</h4><p>{words(12)}</p><p>{words(1)}</p></div><div>Our shop has offers for everyone</div></body>" for _ in range(8)]
    got = extracted(spark, [pages[0]] * 400 + pages[1:])
    assert len(set(got[:400])) == 1 and got[0].count("\n") == 2 and all(t.count("\n") == 2 and "offers" not in t for t in got)


def test_wrapper_decides_where_landmarks_are_stripped(spark):
    """Without class names and landmarks the host's pages tell template from text; one page on its own cannot."""
    pages, want = [], []
    for _ in range(10):
        texts = [words(rng.randint(4, 20)) for _ in range(rng.randint(2, 5))]
        pages.append(f"<body><div><div><p>All about trains and other things that run on rails</p>{''.join(f'<p>{t}</p>' for t in texts)}<p>Copying is allowed if you name this site</p></div></div></body>")
        want.append("\n".join(texts))
    assert extracted(spark, pages) == want
    assert all(he.main_text(p, None) != w for p, w in zip(pages, want, strict=True))


class ArticleText(HTMLParser):
    """A plain reading of the made pages: the blocks of the article, each tag a border but the inline ones."""

    def __init__(self):
        super().__init__()
        self.depth, self.blocks, self.open = 0, [], False

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.open &= tag in he.INLINE
        if tag == "br" and self.open:
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.open &= tag in he.INLINE

    def handle_data(self, data):
        if self.depth > 0 and (data.strip() or self.open):
            if self.open:
                self.blocks[-1] += data
            else:
                self.blocks.append(data)
                self.open = True


def plain_text(html):
    parser = ArticleText()
    parser.feed(html)
    parser.close()
    return "\n".join(t for b in parser.blocks if (t := " ".join(b.split())))


def test_same_as_a_plain_reading_of_every_page(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in he.extract(pages).collect()}
    rows = pages.select("page_id", "html").collect()
    assert len(got) == len(rows) and all(got[r.page_id] == plain_text(r.html or "") for r in rows)


def test_many_skeletons_of_a_host_are_aligned_in_groups(spark):
    """More distinct skeletons than FAN: none is left out, and the invariant text is still found."""
    pages, want = [], []
    for i in range(700):
        kinds = [("h2", "p", "pre", "blockquote")[(i // 4**k) % 4] for k in range(5)]
        texts = [words(rng.randint(3, 9)) for _ in kinds]
        pages.append("<body><div class='text'>" + "".join(f"<{k}>{t}</{k}><hr>" for k, t in zip(kinds, texts, strict=True)) + "</div><div class='low'>The same line stands on every page</div></body>")
        want.append("\n".join(texts))
    assert extracted(spark, pages) == want


def cards(n, rows=9):
    """A page with n cards of 5 * rows + 13 nodes each, which repeat nothing of up to twelve nodes but themselves."""
    one = "".join(f"<div class=card><h3>T{k}</h3><ul>" + "".join(f"<li class=c{j}><p>x{k}-{j}</p></li>" for j in range(rows)) + f"</ul><div><span>q</span><p>z{k}</p></div></div>" for k in range(n))
    return f"<html><body><div class=menu><p>menu</p></div><article><h1>Title {n}</h1><p>Body text of {n} here</p></article>{one}<div class=foot>f</div></body></html>"


def test_repeats_of_any_length_are_groups():
    for rows in (3, 9, 30):
        forms = {n: he.structure(he.tokens(cards(n, rows))) for n in range(2, 10)}
        assert len({he.skeleton(f) for f in forms.values()}) == 1
        assert all(len([x for x in f if x[0] == "r"]) >= 1 for f in forms.values())
    assert he.long_repeat(["<a", "x", "<b", "</b", "<a", "x", "<b", "</b", "<a"], 2) == (0, 4, 2)
    assert he.long_repeat(["<a", "x", "y", "<a", "x", "z"], 2) is None and he.long_repeat([], 2) is None
