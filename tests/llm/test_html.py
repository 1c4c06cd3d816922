"""Page layout: time linear in the page, spans of table cells against a plain grid, what is shown and what is not."""

import random
import time

import pytest
from pyspark.sql import functions as F

from veilwright.llm.html_text import TOKEN, Closings, _tokens, extract, extract_pages


@pytest.mark.parametrize("part", ['<a "x" ', "<a 'x\" ", "<a ", "</a ", "<!-- ", "<script>", "</title ", "<title></title ", '<a b="', "<p", "<![", "&#"])
def test_a_page_of_open_tags_is_read_once(part):
    page = part * (1_000_000 // len(part))
    start = time.process_time()
    assert extract("text " + page).startswith("text")
    assert time.process_time() - start < 5


def test_closings_equal_matching():
    rng = random.Random(5)
    for _ in range(3000):
        page = "".join(rng.choice(["<a", "</b", ">", '"', "'", " x", "="]) for _ in range(rng.randrange(25)))
        closings = Closings(page)
        for at in range(len(page)):
            m = TOKEN.match(page, at)
            if page[at] == "<" and page[at + 1:at + 2].isalpha() or page[at:at + 2] == "</":
                begin = at + (3 if page[at + 1] == "/" else 2)
                assert (closings.of(begin) or at + 1) == m.end(), (page, at)
        assert "".join(t for t, _ in _tokens(page)) == page


def grid(rows):
    """First column of each cell, row by row, by filling a grid."""
    taken, out = set(), []
    for r, cells in enumerate(rows):
        at, line = 0, []
        for _, span, deep in cells:
            while (r, at) in taken:
                at += 1
            line.append(at)
            for i in range(deep):
                taken |= {(r + i, at + k) for k in range(span)} if i else set()
            at += span
        out.append(line)
    return out


def test_cells_stand_in_their_columns():
    rng = random.Random(7)
    for _ in range(300):
        n, rows = 0, []
        for _ in range(rng.randrange(1, 6)):
            cells = []
            for _ in range(rng.randrange(1, 5)):
                n += 1
                cells.append((f"c{n}" + "x" * rng.randrange(6), rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 3])))
            rows.append(cells)
        page = "<table>" + "".join("<tr>" + "".join(
            f"<td colspan={s} rowspan={d}>{t}" for t, s, d in cells) for cells in rows) + "</table>"
        lines = extract(page).split("\n")
        places = {}
        for line, cells, columns in zip(lines, rows, grid(rows), strict=True):
            for (text, _, _), column in zip(cells, columns, strict=True):
                places.setdefault(column, set()).add(line.split(" ").index(text) and line.index(f" {text}") + 1)
        # Leading blanks are cut when the whole text is stripped, so only tables whose first line begins at column 0 are measured.
        if grid(rows)[0][0] == 0:
            assert all(len(p) == 1 for p in places.values()), (page, lines)
            assert sorted(places) == sorted(places, key=lambda c: min(places[c]))


def test_row_spans_and_wide_cells():
    assert extract("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>") == "a  b\n   c"
    assert extract("<table><tr><td rowspan=9>a<td colspan=2>b<tr><td>c<td>d</table>") == "a  b\n   c  d"
    wide = " ".join(["word"] * 30)
    lines = extract(f"<table><tr><td>{wide}<td>next<tr><td>x<td>last</table>").split("\n")
    assert lines[0].index("next") == lines[-1].index("last") and max(map(len, lines)) < 100
    assert " ".join(" ".join(lines).split()).count("word") == 30
    long = "y" * 300
    assert extract(f"<table><tr><td>{long}<td>next<tr><td>x<td>z</table>").split("\n")[0] == long + "  next"
    assert extract("<table><tr><td colspan=2>a long heading<tr><td>b<td>c</table>") == "a long heading\nb  c"


@pytest.mark.parametrize("page,text", [
    ("<details><summary>more</summary>body</details>end", "more\nend"),
    ("<details open><summary>more</summary>body</details>end", "more\nbody\nend"),
    ("<details>no summary</details>end", "end"),
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b>no</div>", "yes"),
    ("<div style='visibility:hidden'>no<ul><li style='visibility: visible'>yes<li>no</ul></div>", "- yes"),
    ("<div style='display:none'>no<b style='display:inline;visibility:visible'>no</b></div>yes", "yes"),
    ("<style>.ad, #x { display : none } p.q{visibility:hidden} em{color:red}</style><div class='big ad'>no</div><b id=x>no</b>"
     "<p class=q>no</p><p class=r>a</p><em>b</em>", "a\n\nb"),
    ("<style>div.k > p, @media x {y{}} b{display:none}</style><b>no</b><div class=k><p>yes", "yes"),
    ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"),
    ("<select><option>no</select><textarea>no</textarea>yes", "yes"),
])
def test_what_is_shown(page, text):
    assert [x.rstrip() for x in extract(page).split("\n")] == text.split("\n")


def test_pages_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (None, None, None), (2, "v", "<a " * 5000)],
                                  "page_id long, url string, html string")
    clashing = pages.withColumns({c: F.lit(1) for c in ("text", "n_chars", "doc_id", "key")})
    got = sorted(((r.page_id, r.text[:2], r.n_chars) for r in extract_pages(clashing).collect()), key=str)
    assert got[:2] == [(1, "a", 1), (1, "a", 1)] and got[-1] == (None, "", 0) and extract_pages(clashing).columns == [
        "page_id", "url", "text", "n_chars"]
