"""op6: the host suffix array and the blocks it covers, against all pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from loomframe.llm import html_text
from loomframe.llm.common import stored


def test_suffixes_among_many_of_their_own_page(spark):
    """A notice seven times on one page and once on two others: no suffix of it goes unmatched, over any range edges."""
    notice = [f"n{k}" for k in range(10)]
    rows = [(1, "h", [*notice, f"own{k:03}"]) for k in range(7)] + [(2, "h", [*notice, "a"]), (3, "h", [*notice, "z"])]
    rows += [(1, "h", [f"q{k // 40}", f"only{k:03}"]) for k in range(400)] + [(2, "h", ["q4", "zz"]), (4, "other", notice)]
    given = spark.createDataFrame(rows, "page long, host string, suffix array<string>")
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    for r in html_text.suffix_array(given).collect():
        mine = {p for p, h, s in rows if (h, s) == (r.host, r.suffix)}
        want = max((common(r.suffix, s) for p, h, s in rows if h == r.host and mine - {p}), default=0)
        assert r.shared == want, (r.suffix, r.shared, want)


def test_blocks_of_any_length_and_passages_from_inside_a_block(spark):
    r = random.Random(4)
    line = lambda n: " ".join("".join(r.choices("abcdef", k=6)) for _ in range(n))
    notice, legal, tail, short = line(200), line(9), line(12), line(3)
    rows = [(i, "http://h/x", [line(20), notice, f"{line(2)} {legal}", short, line(15), f"{tail} {line(1)}", tail]) for i in range(6)]
    rows += [(7, "http://h/x", [line(4), "few words"]), (8, "http://g/x", [notice, line(9)]), (9, "http://k/x", [line(9)]), (10, "http://k/x", [line(9)])]
    given = stored(spark.createDataFrame(rows, "page long, url string, blocks array<string>"), "blocks")
    got = {x.page: x.blocks for x in html_text.without_repeats(given).collect()}

    def want(page: int, url: str, blocks: list) -> list:
        others = [" ".join(b).split() for p, u, b in rows if u == url and p != page]
        seen = {tuple(w[k : k + 8]) for w in others for k in range(len(w) - 7)}
        mine = " ".join(blocks).split()
        in_ = {q for k in range(len(mine) - 7) if tuple(mine[k : k + 8]) in seen for q in range(k, k + 8)}
        out, at = [], 0
        for b in blocks:
            n = len(b.split())
            if not set(range(at, at + n)) <= in_:
                out.append(b)
            at += n
        return out or blocks

    assert got == {p: want(p, u, b) for p, u, b in rows}
    assert all(len(got[i]) == 4 for i in range(6))  # the notice, the block after the legal text and the last tail go


def page(number: int, *, intro: str, promo: str, marked: bool = True) -> str:
    tag = "article" if marked else "div"
    return (
        f"<nav>Home {number}</nav><div class='promo p{number}'>{promo}</div><div class='intro'>{intro}</div><{tag}>"
        f"<div class='entry-header'><h1>Title {number}</h1></div><p class='ad-hoc'>Body {number}</p>"
        f"<section id='search-for-meaning'>Meaning {number}</section><footer>foot</footer></{tag}><p>tail {number}"
    )


def test_the_array_tells_slots_beside_a_marked_article(spark):
    """Promotions recur on their host, but for one page; introductions are each page's own. Labels that only look like
    those of page furniture drop nothing inside an article."""
    r = random.Random(7)
    line = lambda: " ".join("".join(r.choices("abcdef", k=6)) for _ in range(9))
    shared, lone, own = line(), line(), [line() for _ in range(51)]
    rows = [(i, "http://h/x", page(i, intro=own[i], promo=lone if i == 3 else shared)) for i in range(30)]
    rows += [(50, "http://small/x", page(50, intro=own[50], promo=shared)), (51, None, page(51, intro=own[0], promo=shared, marked=False))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    read = stored(html_text.parsed(frame).withColumn("page", F.monotonically_increasing_id()), "pages")
    got = {x.page_id: x.blocks for x in html_text._text_blocks(read, seen=30).collect()}
    article = lambda i: [f"Title {i}", f"Body {i}", f"Meaning {i}"]
    assert got[51] == [shared, own[0], *article(51), "tail 51"]
    for i in (*range(30), 50):
        assert got[i] == [own[i], *article(i), f"tail {i}"]
    assert {x.page_id: x.text for x in html_text.extract(frame).collect()}[4] == "\n".join(article(4))  # 30 blocks are too few


def test_suffixes_are_words_of_an_article_too(spark):
    """A line that stands in another page's article is a repeat; the article keeps it."""
    line = "one two three four five six seven eight nine"
    rows = [(0, "http://h/0", f"<div>{line}</div><p>own words of this page"), (1, "http://h/1", f"<article><p>{line}<p>more</article>"), (2, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {x.page_id: x.text for x in html_text.extract(frame).collect()} == {0: "own words of this page", 1: f"{line}\nmore", 2: ""}
