import itertools
import random

from haulframe.llm import extract

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style>
<script>var t="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1><p>Welcome to the site, the best one.</p></header>
<div class="cookie-notice"><p>We use cookies. Accept them all please.</p></div>
<nav><ul><li><a href="/">Home</a></li><li><a href="/a">About</a></li></ul></nav><!-- <p>no</p> -->
<article><h1>A  title</h1><p>First <b>bold</b> paragraph, long enough to count. It ends.<p>Short.
<ul><li>one item</li><li>two items</li></ul><p>a &lt;story&gt; &amp; <a href="x">a link</a><br>more
<aside>Not this one at all.</aside><form><label>Name</label><input></form>
<section class="comments"><p>First! I am a comment, a long one indeed.</p></section></article>
<div class="ad">Buy this now, it is the best there is.</div>
<footer>&copy; all of us</footer></body></html>"""


def test_article_without_the_rest():
    assert extract.main_text(PAGE) == "\n\n".join([
        "A title", "First bold paragraph, long enough to count. It ends.", "Short.", "one item",
        "two items", "a <story> & a link more"])


def test_broken_pages():
    assert extract.main_text("") == ""
    assert extract.main_text("<article><p>Left open, with text. And more") == (
        "Left open, with text. And more")
    assert extract.main_text("<article><p>One two three. <script>never closed <p>x") == (
        "One two three.")
    assert extract.main_text("<article><p>5 < 6 and a lot of words follow here.</p>") == (
        "5 < 6 and a lot of words follow here.")
    assert extract.main_text('<article><p title="a>b">Quoted end of tag, no problem.</p>') == (
        "Quoted end of tag, no problem.")


def test_elements_without_text_drop_nothing_else():
    for tag in ('<video-player src="a"></video-player>', "<title-bar>", "<audio-x/>", "<svg class=i/>",
                '<svg d="a>b" class="i"/>', "<math/>", "<video src=a>", "<iframe src=a>", "<noscript>",
                "<object data=a/>", "<script src=a></script >", "<video><svg/>no</video>",
                "<svg><title/><svg>no</svg>no</svg>", "<svg><script>'<svg>'</script>no</svg>",
                "<noscript><!-- no</noscript>", "<video><p>no</p></video>", "<iframe>no</iframe>"):
        page = (f"<article><p>One is first.</p>{tag}<p>Two comes after it.</p></article>"
                "<video>no</video><svg>no</svg></svg><iframe>no</iframe></video>")
        assert extract.main_text(page) == "One is first.\n\nTwo comes after it.", tag
    assert extract.main_text("<article><p>See <svg/> here or <video src=a> there.</p></article>") == (
        "See here or there.")


def test_names_do_not_empty_an_article():
    long = "A sentence of ten words stands here and it ends. " * 4
    text = long.strip()
    for open_tag in ('<article class="post has-sidebar">', '<main class="layout with-sidebar">',
                     '<article class="post category-legal tag-form">', '<article id="legal">',
                     '<div id="search-page-wrapper">', '<div class="widget"><article>',
                     '<div class="layout-with-sidebar">', '<article><div class="social-wrap">'):
        page = f"<body>{open_tag}<p>{long}</p><p>{long}</p></body>"
        assert extract.main_text(page) == f"{text}\n\n{text}", open_tag
    # long sentences outweigh a name, short and linked ones do not
    page = (f'<article><p>{long * 3}</p></article><div class="legal"><p>{long}</p></div>'
            '<div class="legal"><p>Short. And so on.</p></div>'
            f'<div class="related"><p><a href="x">{long}</a></p></div>')
    assert extract.main_text(page) == f"{(long * 3).strip()}\n\n{text}"
    # comments as articles of their own, more of them than of the text
    comments = '<article class="comment"><p>I have to say something. It is this here.</p></article>'
    for end in ("</article>%s", "%s</article>"):
        for section in ("%s", '<section class="comments">%s</section>'):
            if end == "</article>%s" and section == "%s":
                continue  # articles beside the article
            page = f"<article><p>{long}</p>" + end % (section % (comments * 30))
            assert extract.main_text(page) == text
    page = f'<article><p>{long}</p><div class="comments"><article><p>I say so.</p></article></div>'
    assert extract.main_text(page) == text


def energy(label, cost, edges):
    own = sum(c if c > 0 and not x else -c if c < 0 and x else 0 for c, x in zip(cost, label))
    return own + sum(w for (i, j), w in edges.items() if label[i] != label[j])


def test_cut_is_the_minimum():
    random.seed(5)
    for _ in range(300):
        n = random.randint(1, 8)
        cost = [random.uniform(-2, 2) for _ in range(n)]
        edges = {(i, j): random.uniform(0, 1.5) for i in range(n) for j in range(i + 1, n)
                 if random.random() < 0.5}
        least = min(energy(x, cost, edges) for x in itertools.product([False, True], repeat=n))
        assert abs(energy(extract.minimum_cut(cost, edges), cost, edges) - least) < 1e-9


def test_rows_and_columns(spark):
    long_page = "<article>" + "<p>word word word. </p>" * 4000 + "</article>"
    rows = [(1, "u", PAGE, "x", 7), (2, None, None, None, None), (3, "u", "", "x", 7),
            (4, "u", long_page, "x", 7), (1, "u", PAGE, "x", 7), (None, "u", PAGE, "x", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    out = extract.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(r.text)
        assert r.text == extract.main_text({2: "", 3: "", 4: long_page}.get(r.page_id, PAGE))
    assert extract.page_report(pages.where("false")).collect() == []


def test_forms_around_the_text_and_lists_of_links_in_it():
    long = "A sentence of ten words stands here and it ends. " * 4
    text = long.strip()
    menu = '<div class="menu"><a href="/">Home</a></div>'
    for inner in (f"<article><p>{long}</p></article>", f"<main><p>{long}</p></main>",
                  f"<div><p>{long}</p></div>"):
        assert extract.main_text(f'<body><form id="aspnetForm">{menu}{inner}</form></body>') == text
    page = (f"<article><p>{long}</p><form><p>{long}</p><label>Name</label></form>"
            '<ul><li><a href="x">One item</a></li><li><a href="y">Another one</a></li></ul></article>'
            f"<form><p>{long}</p></form>")
    assert extract.main_text(page) == f"{text}\n\nOne item\n\nAnother one"
    assert extract.main_text("<form><label>Name</label><input><button>Send</button></form>") == ""


def generated_page():
    """A page of a random template, and the blocks of the article put into it."""
    def prose(n):
        words = random.choices("river stone cloud autumn letter window silver market".split(), k=n)
        return " ".join(words).capitalize() + "."

    truth, body = [], []
    for _ in range(random.randint(2, 7)):
        kind = random.choice(["p", "p", "p", "h2", "ul", "blockquote", "table", "links"])
        if kind == "ul":
            items = [prose(random.randint(5, 12)) for _ in range(random.randint(2, 4))]
            body.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            truth += items
        elif kind == "links":
            items = [prose(4) for _ in range(3)]
            body.append("<ul>" + "".join(f"<li><a href=x>{x}</a></li>" for x in items) + "</ul>")
            truth += items
        elif kind == "table":
            cells = [prose(3), prose(6)]
            body.append(f"<table><tr><td>{cells[0]}<td>{cells[1]}</tr></table>")
            truth += cells
        else:
            own = prose(5 if kind == "h2" else random.randint(8, 60))
            body.append(f"<{kind}>{own.replace(' stone', ' <b>stone</b>', 1)}</{kind}>")
            truth.append(own)
    lead = prose(30)
    article = f"<p>{lead}</p>" + "".join(body)
    truth.insert(0, lead)
    if random.random() < 0.5:
        article += f'<div class="related-links"><p>{prose(9)}</p></div>'
    article = random.choice(["<article>{}</article>", '<main id="content">{}</main>',
                             '<article class="post has-sidebar">{}</article>',
                             "<main><article>{}</article></main>"]).format(article)
    if random.random() < 0.3:
        article = f"<form action=/>{article}</form>"
    before = ['<nav><a href="/">Home</a> <a href="/n">News</a></nav>',
              f"<header><h1>Site</h1><p>{prose(6)}</p></header>",
              f'<div class="cookie-notice"><p>{prose(9)}</p></div>',
              f'<div class="ad-banner"><a href="x">{prose(5)}</a></div>']
    after = [f'<aside><h3>Latest</h3><p>{prose(12)}</p></aside>',
             f'<section class="comments"><p>{prose(14)}</p><p>{prose(20)}</p></section>',
             '<form><label>Mail</label><input><p>Write to us now.</p></form>',
             f"<footer><p>{prose(8)}</p></footer>", "<script>var x = '<p>no</p>'</script>"]
    page = "".join(random.sample(before, random.randint(1, 4))) + article + "".join(
        random.sample(after, random.randint(1, 5)))
    return f"<html><head><title>T</title></head><body>{page}</body></html>", truth


def test_articles_put_into_templates_come_back():
    random.seed(12)
    for _ in range(400):
        page, truth = generated_page()
        assert extract.main_text(page).split("\n\n") == truth, page
