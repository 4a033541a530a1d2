import math
import random
import time

import pytest

from latticework.llm import html_text as op
from latticework.llm.html_text import extract_pages, main_text, page_lines, smooth

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><h1>Site</h1></header>
<nav><ul><li><a href="/a">a</a></li></ul></nav><div class="ad">Buy now, a long advert text is here.</div>
<div id="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p><b>First
 line.<br><p>Second &eacute;&#x41; <i>in</i>line.</p><script>x<y</script><form>name</form><p></p><ul><li>One</li><li>Two</li></ul>
<!-- note --></article><aside>Side</aside><div class="comments"><p>Reader says a lot of things in a long comment.</p></div>
<footer>&copy; foot</footer></body></html>"""


def test_only_the_article_stays():
    assert main_text(PAGE) == "Title & more\nFirst line.\nSecond éA inline.\nOne\nTwo"


def slow_content(lines):
    """The same decision line by line, from its definition."""
    own = [max(0, len(line[0].replace(" ", "")) - line[2]) for line in lines]
    logs = [math.log(1 + n / max(1, line[1])) for n, line in zip(own, lines, strict=True)]
    wrapper = sum(n for n, line in zip(own, lines, strict=True) if line[5] > 0) > sum(own) / 2
    soft = []
    for i in range(len(logs)):
        near = [(math.exp(-((k - i) ** 2) / 2), logs[k]) for k in range(len(logs)) if abs(k - i) <= 2]
        soft.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    mean = sum(soft) / max(1, len(soft))
    spread = (sum((x - mean) ** 2 for x in soft) / max(1, len(soft))) ** 0.5
    kept = []
    for _, _, _, region, _, _ in lines:
        form = [0.2 if line[5] > 0 and not wrapper else 1.0 for line in lines]
        tops = [x * line[4] * f * (y > 0) for x, y, f, line in zip(soft, logs, form, lines, strict=True)]
        best = max(x for x, line in zip(tops, lines, strict=True) if line[3] == region)
        kept.append(best >= 1 and best >= min(spread, max(tops)) - 1e-12)
    return kept


def random_page(r):
    def block(depth):
        tag = r.choice(["div", "p", "section", "article", "ul", "li", "aside", "div class='related'", "td", "header", "form"])
        inner = "".join(block(depth + 1) if depth < 4 and r.random() < 0.5 else piece() for _ in range(r.randrange(1, 5)))
        return f"<{tag}>{inner}" + (f"</{tag.split()[0]}>" if r.random() < 0.9 else "")

    def piece():
        text = "word " * r.choice([1, 3, 10, 60])
        return r.choice([text, f"<a href=x>{text}</a>", f"<b>{text}</b><br>", f"<span>{text}"])

    return "".join(block(0) for _ in range(r.randrange(1, 6)))


def test_decision_matches_its_slow_definition():
    r = random.Random(3)
    kept = 0
    for _ in range(300):
        lines = page_lines(random_page(r))
        assert op.content(lines) == slow_content(lines)
        kept += sum(op.content(lines))
    assert kept > 300


LONG = " ".join(f"A sentence of some words, number {i}." for i in range(12))
NAV = "<nav><ul>" + "".join(f'<li><a href="/{i}">item {i}</a></li>' for i in range(8)) + "</ul></nav>"


@pytest.mark.parametrize(
    ("body", "wanted"),
    [
        (f'<article><div class="article-header"><h1>Title</h1></div><p>{LONG}</p></article>', ["Title", LONG]),
        (f'<article><p>{LONG}</p><div class="related-work"><p>{LONG} More.</p></div></article>', [LONG, f"{LONG} More."]),
        (f"<article><p>A teaser of a few words.</p></article><div><p>{LONG}</p><p>{LONG}</p></div>", [LONG, LONG]),
        (f"<div><p>{LONG}</p></div><div><p>A short closing paragraph.</p></div>", [LONG, "A short closing paragraph."]),
    ],
)
def test_ratios_decide_not_names(body, wanted):
    text = main_text(f"<html><body>{NAV}{body}<footer>About us, imprint and contact of this site.</footer></body></html>").split("\n")
    assert [x for x in text if x in wanted] == wanted
    assert not any("item" in x or "imprint" in x for x in text)


def test_without_ratios_pages_change(monkeypatch):
    dense = "<div>" + "<p>a<i>b</i><b>c</b>" * 6 + "</div>"
    page = f"<body>{dense}{NAV}<article><h1>Title</h1><p>{LONG}</p></article></body>"
    before = main_text(page)
    monkeypatch.setattr(op, "smooth", lambda values: [2.0] * len(values))
    assert before == f"Title\n{LONG}" != main_text(page)
    monkeypatch.setattr(op, "smooth", lambda values: [0.0] * len(values))
    assert main_text(page) == ""


def test_hidden_and_reader_comments_inside_an_article_go():
    inner = f'<h1>T</h1><p>{LONG}</p><div hidden>{LONG} hid</div><section id="comments"><p>{LONG} said</p></section>'
    assert main_text(f"<article>{inner}</article>") == f"T\n{LONG}"


def test_names_that_only_hold_an_unlikely_word_are_outvoted_by_prose():
    long = " ".join(["word"] * 200) + "."
    inner = (
        f'<h1>T</h1><p>{LONG}</p><section id="social-history"><h2>Social history</h2><p>{"some words of it " * 15}</p></section>'
        f'<p class="subscribe-note">{long}</p><p class="comments-on-aristotle">{long}</p><p class="ad">Buy this now, it is cheap.</p>'
        '<div class="social-share"><p>Share this with all of your friends.</p></div>'
    )
    text = main_text(f"<body>{NAV}<article>{inner}</article><footer>About us, imprint and contact.</footer></body>")
    assert text == f"T\n{LONG}\nSocial history\n{('some words of it ' * 15).strip()}\n{long}\n{long}"


def test_a_form_around_the_page_is_no_form():
    body = f"{NAV}<article><h1>T</h1><p>One short line.</p><p>Another.</p></article><footer>Foot</footer>"
    assert main_text(f"<body><form action=x>{body}</form></body>") == "T\nOne short line.\nAnother."
    form = "<form><label>Your name and your address, please</label></form>"
    assert main_text(f"<body><article><h1>T</h1><p>{LONG}</p>{form}</article></body>") == f"T\n{LONG}"


def test_open_comments_end_the_page_in_linear_time():
    assert main_text(f"<article><p>{LONG}</p><!-- never closed <p>{LONG}</p>") == LONG
    kept = f'<article><script>var a = "<!-- b";</script><p>{LONG}</p></article>'
    assert main_text(kept) == LONG
    assert main_text(f"{kept}<!-- open <p>x</p>") == LONG
    assert main_text(f"<p>{LONG}</p><style>/* <!-- */") == LONG
    took = []
    for n in (20_000, 80_000):
        start = time.perf_counter()
        page_lines(f"<p>{LONG}</p>" + "<!--" * n)
        page_lines("<script>" + "<!--" * n + f"</script><p>{LONG}</p>")
        took.append(time.perf_counter() - start)
    assert took[1] < 1.0 + 12 * took[0]


def test_unclosed_and_stray_elements_take_linear_time():
    for piece in ("<li><i>a", "x</b>", "<div>y", "<p><a href=z>w", "</div>v"):
        took = []
        for n in (10_000, 40_000):
            start = time.perf_counter()
            page_lines(f"<body>{piece * n}")
            took.append(time.perf_counter() - start)
        assert took[1] < 12 * took[0]


def test_clustering_picks_the_region_without_markup_for_it():
    body = "".join(f"<p>{'word ' * 40}{i}.</p>" for i in range(5))
    links = "".join(f'<a href="/{i}">link {i}</a> ' for i in range(12))
    text = main_text(f"<body><div>{links}</div><div>{body}</div></body>")
    assert text.count("\n") == 4 and "link" not in text


def test_awkward_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", PAGE), (4, "u", "plain"), (5, "u", "<p"), (5, "u", "<p")]
    rows.append((6, "u", "<article>" + "<p>x y</p>" * 20000 + "</article>"))
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in extract_pages(df).collect()}
    assert got[(1, "u")] == ("", 0) and got[(2, None)] == ("", 0) and got[(4, "u")] == ("plain", 5)
    assert got[(None, "u")][0].startswith("Title")
    assert got[(6, "u")][0].count("\n") == 19999
    assert extract_pages(df.limit(0)).count() == 0


def test_pieces_do_not_split_references(monkeypatch):
    from latticework.llm import html_text

    whole = main_text(PAGE)
    for size in (1, 3, 7):
        monkeypatch.setattr(html_text, "FEED", size)
        assert main_text(PAGE) == whole


def test_smoothing_keeps_a_constant():
    assert all(abs(x - 3) < 1e-12 for x in smooth([3.0] * 6))
