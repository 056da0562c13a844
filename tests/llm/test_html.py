"""op3: pages put together from a known article and what surrounds it, over a table; time in proportion to the page."""

import random
import time

from tessera.llm import html_text

WORDS = "the of and to in a is that for it river house walked seven morning letter because under light".split()
OUTSIDE = [
    "<nav><a href=/>Home</a><a href=/x>News</a></nav>", "<div class=sidebar><p>See the other of the pages that are in it for you and the rest.</p></div>", "<form><p>Send it to the editor</p><input></form>", "<script>var a = '<p>no</p>';</script>",
    "<style>p { color: red }</style>", "<div id=cookie-notice>It is to be of use that we have the cookies in this.</div>", "<footer><p>All of the rights are with us in the year that it was.</p></footer>", "<!-- <p>comment</p> -->", "<div class='comments'><p>I was there and it was the best of all that I have seen.</p></div>",
]


def sentence(rng):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12, 30))).capitalize() + "."


def test_articles_over_a_table(spark):
    rng = random.Random(4)
    pages, want = [], {}
    for n in range(60):
        blocks = [("h1", f"Title {n} & more")] + [(rng.choice(["p", "p", "blockquote"]), sentence(rng)) for _ in range(rng.randrange(1, 8))]
        shown = []
        for tag, text in blocks:
            words = text.replace("&", "&amp;").split()
            if tag == "p" and len(words) > 4:
                words[1], words[3] = f"<b>{words[1]}</b>", f"<a href='/{n}'>{words[3]}</a>"
            shown.append(f"<{tag} class=x>" + rng.choice([" ", "\n\t "]).join(words) + f"</{tag}>")
        inside = "".join(rng.choice([s, s, s + rng.choice(OUTSIDE)]) for s in shown)
        pages.append((n, None if n == 7 else f"/{n}", f"<html lang=en><head><title>t</title></head><body>{rng.choice(OUTSIDE)}<article>{inside}</article>{rng.choice(OUTSIDE)}</body></html>", "x"))
        want[n] = "\n".join(t for _, t in blocks)
    pages += [(100, "/a", None, "x"), (101, "/b", "", "x"), (101, "/b", "", "x")]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, text string").repartition(3)
    got = html_text.extract(table).collect()
    assert {r.page_id: r.text for r in got} == {**want, 100: "", 101: ""} and len(got) == 63
    assert all(r.n_chars == len(r.text) for r in got) and [r.url for r in got if r.page_id == 7] == [None]
    assert html_text.extract(table.limit(0)).count() == 0


def test_class_names_inside_an_article_yield_to_the_blocks():
    prose = "It was the first of the days that were to be in the house by the river for all of us."
    links = "".join(f"<li><a href=/{k}>Another story {k}</a></li>" for k in range(4))
    assert html_text.main_text(f"<article><div class=header>The title</div><p>{prose}</p></article>") == f"The title\n{prose}"
    assert html_text.main_text(f"<article><p>{prose}</p><section class=related><p>{prose}</p></section></article>") == f"{prose}\n{prose}"
    assert html_text.main_text(f"<article><p>{prose}</p><section class=related><ul>{links}</ul></section><div class=share>Share</div></article>") == prose
    assert html_text.main_text(f"<body><p>{prose} \N{COPYRIGHT SIGN} {prose}</p></body>") == f"{prose} \N{COPYRIGHT SIGN} {prose}"


def test_time_is_in_proportion_to_the_page():
    n = 30_000
    start = time.time()
    for page in ("<div>" * n + "</p>" * n, "<a b=\"x'" * n, "<a " * n, "<a b=\"<a b='" * n, "<script>" * n, '<a "' * n + "<b>" * n, "<!--" * n, "</div>" * n):
        html_text.main_text(page)
    assert time.time() - start < 20
    assert "four" in html_text.main_text("<p>one <b title='>two</b> three <p>four")
