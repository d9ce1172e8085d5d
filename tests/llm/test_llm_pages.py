"""Main text of pages: blocks by landmark, and runs that a host repeats against plain counting."""

import html
import random

import pytest

from panelspark.llm.pages import main_text, page_blocks

SCHEMA = "page_id long, url string, html string"


def extract(spark, rows, **more):
    made = spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 AS host", "2 AS key", "3 AS words", "4 AS body", "5 AS id", "6 AS text")
    return sorted(map(tuple, main_text(made, **more).collect()), key=repr)


def one(body):
    mark, blocks = page_blocks(body)
    return [text for place, text in blocks if place == (mark or "open")]


@pytest.mark.parametrize("body,want", [
    ("", []), ("só texto", ["só texto"]), ("<p>a<p>b<br>c</p>d", ["a", "b c", "d"]),
    ("<article><h1>T&amp;A &copy;</h1><p><b>x\n y.<br><p>z</article><footer>f</footer>", ["T&A ©", "x y.", "z"]),
    ("<nav>n</nav><article>a<aside>s</aside><form>f</form>b</article>c", ["a", "b"]),
    ("<main>m<article>a</article></main>", ["a"]), ("<main>m</main>o", ["m"]), ("<div role=main>m</div>o", ["m"]),
    ("<article></article><p>o</p>", []), ("<article class='post sidebar-left'>a<article class='comment'>c</article></article>", ["a"]),
    ("<article>a<script>var t='</p>';</script><style>p{}</style><!-- <p>x</p> -->b</article>", ["ab"]),
    ("<article>a<div class='ad'>x</div><div id=cookie-notice>y</div><section class=comments>z</section>b", ["a", "b"]),
    ("<head><title>t</title><meta charset=utf-8><p>a</p>", ["a"]), ("<title>t</title><body>a</body>", ["a"]),
    ("<p class='notice'>x<p>y", ["y"]), ("a<textarea>x</textarea>b", ["ab"]), ("a < b & c &lt;d&gt; &am &amp", ["a < b & c <d> &am &"]),
    ("<article>x<span class=ad>y</span>z</article>", ["x", "z"]), ("<!-- never closed <p>a", []), ("<p>a<scr", ["a"]),
    ("<ul><li class=menu>x<li>y</ul>", ["y"]), ("</div></p>a", ["a"]),
])
def test_blocks(body, want):
    assert one(body) == want


def brute(rows, run=4):
    """Texts of pages without landmarks made of paragraphs, by looking for every run in every other page."""
    def words(body):
        return [html.unescape(p).split() for p in (body or "").replace("</p>", "").split("<p>")]

    def host(url):
        return url.split("/")[2].lower() if url and url.count("/") > 2 and "[" not in url else ""

    out = []
    for i, (id, url, body) in enumerate(rows):
        mine = [w for p in words(body) for w in p]
        others = set()
        for j, (other_id, other, text) in enumerate(rows):
            distinct = (url, other) if url or other else ((id, body), (other_id, text))
            if host(other) == host(url) and distinct[0] != distinct[1]:
                flat = [w for p in words(text) for w in p]
                others |= {tuple(flat[k:k + run]) for k in range(len(flat) - run + 1)}
        covered = {k + o for k in range(len(mine) - run + 1) if tuple(mine[k:k + run]) in others for o in range(run)}
        at, kept = 0, []
        for p in words(body):
            text = " ".join(w for k, w in enumerate(p, at) if k not in covered)
            at += len(p)
            if text:
                kept.append(text)
        text = "\n\n".join(kept)
        out.append((id, url, text, len(text), len(covered)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("array_words", [500_000, 200, 40])
def test_repeated_runs_of_hosts(spark, array_words):
    rng = random.Random(array_words)
    stock = [" ".join(rng.choices("acesso cidade mapa dado ano área rio é".split(), k=rng.randint(2, 9))) for _ in range(8)]
    rows = []
    for i in range(60):
        host = "a.example" if i % 3 else rng.choice(["b.example", "c.example"])
        body = "".join(f"<p>{rng.choice(stock) if rng.random() < .5 else f'único {i} ' + str(rng.random())}</p>" for _ in range(rng.randint(0, 5)))
        rows.append((i, f"https://{host}/{i}", body))
    assert extract(spark, rows, array_words=array_words) == brute(rows)


def test_awkward_rows(spark):
    text = "<p>um dois três quatro cinco</p>"
    rows = [(1, "https://x.example/1", None), (2, "https://x.example/2", ""), (3, None, text), (4, None, text), (None, None, "<p>só</p>"),
            (5, "https://x.example/5", text), (5, "https://x.example/5", text), (6, "https://x.example/5", text), (7, "sem host", "<p>nada</p>"),
            (8, "https://y.example/8", "<p>" + "palavra " * 30_000 + "</p>"), (9, "https://[broken", "<p>x &nbsp; y</p>")]
    assert extract(spark, rows) == brute(rows)
    assert extract(spark, []) == []


def test_articles_stay_whole(spark):
    """What the host repeats goes from pages without an article and is counted beside an article."""
    chrome = "<div>menu da cidade inteira aqui</div>"
    rows = [(i, f"http://h.example/{i}", f"{chrome}<article><p>um dois três quatro cinco</p><p>fim</p></article>") for i in range(3)]
    rows.append((3, "http://h.example/3", f"{chrome}<div>texto próprio</div>"))
    got = extract(spark, rows)
    assert [r[2] for r in got] == ["um dois três quatro cinco\n\nfim"] * 3 + ["texto próprio"]
    assert [r[4] for r in got] == [5, 5, 5, 5]
