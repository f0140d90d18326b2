"""Tables of pages against grids that were drawn first, and broken markup."""

import random

from folioloom.operators import markup


def one(html):
    return [(r["kind"], r["rows"]) for r in markup.regions(html)]


def test_shapes():
    assert one(None) == one("") == one("<p>no") == []
    assert one("<table><tr><td>a<td> b <br>c<tr><th>&amp;d</table>") == [("table", [["a", "b c"], ["&d"]])]
    assert one("<ul><li>x<li>y <b>z</b></ul><ol></ol>") == [("list", [["x"], ["y z"]]), ("list", [])]
    assert one("<table><tr><td colspan=2>a<td>b<tr><td rowspan=2>c<td>d<tr><td>e</table>") == [("table", [["a", "a", "b"], ["c", "d"], ["c", "e"]])]
    assert one("<table><tr><td>a<table><tr><td>in</table>b</table>") == [("table", [["a b".replace(" ", "")]]), ("table", [["in"]])]
    assert one("<table><tr><td>never closed") == [("table", [])]
    assert one("</table></tr><td>x") == []
    assert one("<table><tr><td><script>var t='<td>';</script>s<td colspan=x>t</table>") == [("table", [["s", "t"]])]
    assert len(one("<table><tr><td colspan=99999>w</table>")[0][1][0]) == markup.MOST_SPAN
    assert one("<table><tr><td rowspan=3>a<td>b</tr><tr></tr><tr><td>c</td></tr></table>") == [("table", [["a", "b"], ["a"], ["a", "c"]])]


def test_random_grids():
    """Rectangles are cut out of a grid and written as spanning cells; reading gives the grid back."""
    rnd = random.Random(4)
    for _ in range(200):
        high, wide = rnd.randint(1, 6), rnd.randint(1, 6)
        grid, html = [[None] * wide for _ in range(high)], ["<table>"]
        for y in range(high):
            html.append("<tr>")
            for x in range(wide):
                if grid[y][x] is None:
                    w = h = 1
                    while x + w < wide and grid[y][x + w] is None and rnd.random() < 0.3:
                        w += 1
                    while y + h < high and rnd.random() < 0.3:
                        h += 1
                    name = f"{y}.{x}"
                    for a in range(y, y + h):
                        for b in range(x, x + w):
                            grid[a][b] = name
                    html.append(f"<td rowspan={h} colspan='{w}'> {name}" + rnd.choice(["</td>", ""]))
            html.append(rnd.choice(["</tr>", ""]))
        assert one("".join([*html, "</table>"])) == [("table", grid)]


def test_long_page_in_spark(spark):
    html = "<table>" + "<tr><td>a<td>b" * 50_000 + "</table>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string")
    got = {r.id: r.regions for r in markup.with_regions(df, "html").collect()}
    assert got[2] == got[3] == [] and len(got[1][0].rows) == 50_000


def test_visible_text(spark):
    df = spark.createDataFrame([("<style>p{}</style><!-- <b>no</b> --><p>a&amp;lt;<SCRIPT>x</script >b</p>",), (None,)], "html string")
    assert [r[0] for r in df.select(markup.visible_text("html")).collect()] == ["a&lt; b", None]
