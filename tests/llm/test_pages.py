"""URL lists and HTML rendering."""
import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from grainline.llm import html_render as H
from grainline.llm import url_lists as U

DAY = dt.datetime(2023, 1, 1)


def at(day):
    return None if day is None else DAY + dt.timedelta(days=day)


RULES = [("bad.com", "block", "spam", 10), ("bad.com", "remove", "spam", 20), ("bad.com", "block", "malware", 40), ("ok.bad.com", "allow", "safe", 0),
         ("site.org/a/b", "block", "path", 5), ("site.org", "allow", "all", 7), ("Up.Com/", "block", "case", 0), ("tie.net", "block", "x", 3), ("tie.net", "allow", "y", 3),
         ("tie2.net", "remove", "x", 3), ("tie2.net", "block", "x", 3), ("bad.com", "block", "spam", 10), (None, "block", "n", 1), ("z.com", None, "n", 1),
         ("z.com", "block", "n", None), ("late.com", "block", "n", 4000), ("early.com", "block", "n", -4000), ("early.com", "remove", "n", -3000), ("old.com", "block", "n", -4000)]
CAPTURES = [(1, "http://bad.com/x", 9), (2, "http://bad.com/x", 10), (3, "https://sub.bad.com:8080", 19), (4, "http://bad.com/", 20), (5, "http://u@bad.com?q", 400),
            (6, "http://ok.bad.com/", 15), (7, "http://site.org/a/b/c", 6), (8, "http://site.org/a/bc", 6), (9, "http://site.org/a/b", 50), (10, "http://site.org/z", 50),
            (11, "http://up.com/q#r", 1), (12, "http://tie.net", 3), (13, "http://tie2.net", 5), (14, None, 3), (15, "no url", 3), (16, "http://bad.com/", None),
            (17, "http://notbad.com/", 15), (None, "http://bad.com/", 15), (18, "http://bad.com/", 15), (18, "http://bad.com/", 15), (19, "http://late.com/", 5),
            (20, "http://early.com/", 5), (21, "http://old.com/", 5), (22, "http://x.site.org/a/b/c", 6), (23, "http:///a", 3)]


def brute(url, day):
    import re
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)(?::[0-9]*)?([^?#]*)", url or "")
    if not m or not m[1] or day is None:
        return "none", None
    host, path = m[1].lower(), m[2].lower().rstrip("/")
    state = {}
    order = {"block": 0, "allow": 1, "remove": 2}
    for rule, action, category, when in sorted((r for r in RULES if None not in r), key=lambda r: (r[3], order[r[1]])):
        if when <= day:
            state[rule.lower().rstrip("/")] = action
    best = None
    for rule, action in state.items():
        h, _, p = rule.partition("/")
        if action != "remove" and (host == h or host.endswith("." + h)) and (not p or (path + "/").startswith("/" + p + "/")):
            key = (rule.count("/"), rule.count("."), len(rule), rule)
            if best is None or key > best[0]:
                best = (key, action, rule)
    return (best[1], best[2]) if best else ("none", None)


@pytest.mark.parametrize("days", [30, 1, 5000])
def test_lists(spark, days):
    entries = spark.createDataFrame([(r, a, c, at(w)) for r, a, c, w in RULES], "rule string, action string, category string, at timestamp")
    caps = spark.createDataFrame([(i, u, at(d), "x", 3) for i, u, d in CAPTURES], "page_id long, url string, fetched_at timestamp, rule string, copies int")
    out = U.judge(caps, entries, bucket_days=days).collect()
    got = sorted((r.page_id or 0, r.url or "", r.verdict, r.rule) for r in out)
    assert got == sorted((i or 0, u or "", *brute(u, d)) for i, u, d in CAPTURES)
    since = {r.page_id: (r.category, r.since) for r in out}
    assert since[5] == ("malware", at(40)) and since[12][0] == "y" and since[1] == (None, None)


def test_lists_empty(spark):
    entries = spark.createDataFrame([("a.com", "block", "c", DAY)], "rule string, action string, category string, at timestamp")
    caps = spark.createDataFrame([(1, "http://a.com/", DAY)], "page_id long, url string, fetched_at timestamp")
    assert [r.verdict for r in U.judge(caps, entries).collect()] == ["block"]
    assert [r.verdict for r in U.judge(caps, entries.limit(0)).collect()] == ["none"]
    assert U.judge(caps.limit(0), entries).collect() == []


CASES = {
    "a <b>b</b>  c<br>d": "a b c\nd",
    "<p>one<p>two": "one\n\ntwo",
    "x<p></p>y": "x\n\ny",
    "x</p>y</nothing>z": "x\n\nyz",
    "<div>a</div><div>b</div>": "a\nb",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e": "* a\n* b\n  * c\n* d\n\ne",
    "<ol start=9><li>x<li value=20>y<li>z</ol>": "9. x\n20. y\n21. z",
    "<li>loose": "* loose",
    "<dl><dt>T<dd>D<dt>U</dl>": "T\n  D\nU",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "<pre>\n a\n  b </pre>c": " a\n  b\n\nc",
    "<table><tr><td>ab<td>c<tr><td>d<td>efg</table>": "ab  c\nd   efg",
    "<table><thead><tr><th>h<tbody><tr><td colspan=2>wide cell<td>z<tr><td>1<td>2<td>3</table>": "h\nwide cell  z\n1  2  3",
    "<table><tr><td>a<br>b<td>c</table>": "a  c\nb",
    "<table><tr><td><table><tr><td>in<td>ner</table><td>o</table>": "in  ner  o",
    "<td>stray</td>": "stray",
    "<head><title>t</title><style>s{}</style></head>body<script>if (a<b) '</p>'</script>!": "body!",
    "<title>t</title>text": "text",
    "<div hidden>a</div><p style='display : none'>b</p><span style='visibility:hidden'>c<i style='visibility:visible'>d</i></span>e": "de",
    "<details><summary>s</summary>x</details><details open><summary>t</summary>y</details>": "s\nt\ny",
    "<select><option>a<option selected>b</select>|<select><option>c<option>d</select>": "b | c",
    "<textarea>a &lt;b>\n c</textarea>": "a <b>\n c",
    "&amp;&nbsp;&#233;&notit;&zz;": "&\xa0é¬it;&zz;",
    "a<!-- <p>x --> b<!doctype html><?pi?>c<!--x": "a bc",
    "1 < 2 <3> & <": "1 < 2 <3> & <",
    "a<b title=\"x>y\" c='>'>d</b><i": "ad",
    "<P>A</P><BR>B": "A\n\n\nB",
    "<noscript>n</noscript><template>t</template><iframe>i</iframe>k": "k",
    "a<hr>b": "a\n\nb",
    "<button>x</button> <label>y</label>": "x y",
    "": "",
    " \n ": "",
}


@pytest.mark.parametrize("html", list(CASES))
def test_render(html):
    assert H.render(html) == CASES[html]


@pytest.mark.parametrize("html, text", [
    ("<a title='it's'>Hello don't go</a>", "Hello don't go"), ("<p data-t=it's>don't</p>x's", "don't\n\nx's"),
    ("<b it's>one</b>", "one"), ("<b a = 'x>y' c=\"p'>q\" d==z>don't</b>", "don't"), ("<b a= >t's</b>", "t's"),
    ('<a href=/s?q="x>don"t</a>', 'don"t'), ('<i a="open>text</i>', "text")])
def test_quotes_only_delimit_values(html, text):
    assert H.render(html) == text


def test_render_keeps_all_words_and_bounds_padding(monkeypatch):
    monkeypatch.setattr(H, "PAD_FREE", 0)
    rows = "".join(f"<tr><td>{'w' * (5000 if i == 3 else 3)}<td>{i}" for i in range(50))
    out = H.render(f"<table>{rows}</table>")
    assert len(out) < (H.PAD_TIMES + 1) * 5300 + 50 * 10 and out.split()[7] == "3"
    assert H.render("<div>" * 30000 + "x" + "<b>y" * 30000).count("y") == 30000
    assert H.render("<a href=\"" * 300 + "t") is not None and H.render(None) is None


def test_extract(spark):
    df = spark.createDataFrame([(1, "<p>a", "u"), (1, "<p>a", "u"), (None, "", "u"), (2, None, "u"), (3, "<p>" + "long " * 300000, "u")], "page_id long, html string, text string")
    out = H.extract_text(df)
    assert out.columns == ["page_id", "text"]
    got = {r.page_id: r.text for r in out.collect()}
    assert got[1] == "a" and got[None] == "" and got[2] is None and len(got[3]) == 5 * 300000 - 1
    assert out.count() == 5 and H.extract_text(df.limit(0)).collect() == []


def test_tables_on_the_grid():
    """Rows and columns that cells span, long cells: every cell starts at its
    column, found by an occupancy grid of its own."""
    rng = random.Random(6)
    for _ in range(300):
        n_rows, html, taken, cells, serial = rng.randrange(1, 7), "<table>", set(), [], 0
        for r in range(n_rows):
            html += "<tr>"
            col = 0
            for _ in range(rng.randrange(0, 5)):
                while (r, col) in taken:
                    col += 1
                down = rng.choice([1, 1, 1, 2, 3, 0])
                name = f"c{serial}" + "x" * rng.choice([0, 3, 70])
                serial += 1
                html += f"<td rowspan={down}>{name}"
                for k in range(r, min(n_rows, r + down) if down else n_rows):
                    taken.add((k, col))
                cells.append((r, col, name))
                col += 1
        wide = {}
        for _, c, name in cells:
            wide[c] = max(wide.get(c, 0), len(name))
        text = H.render(html + "</table>").split("\n")
        # rows without a cell of their own and of one row height have no line
        seen = {}
        for line in text:
            for m in re.finditer(r"c[0-9]+x*", line):
                seen[m[0]] = m.start()
        assert seen == {name: sum(w + 2 for k, w in wide.items() if k < c) for _, c, name in cells}, html


def test_rowspan_lines_and_wide_tables():
    assert H.render("<table><tr><td rowspan=2>A<td>b1<tr><td>b2</table>") == "A  b1\n   b2"
    assert H.render("<table><tr><td rowspan=2>A<br>B<br>C<td>b1<tr><td>b2</table>") == "A  b1\nB  b2\nC"
    assert H.render("<table><tr><td rowspan=0>A<td>b<tr><td>c<tr><td>d</table>") == "A  b\n   c\n   d"
    long = "w" * 300
    assert H.render(f"<table><tr><td>{long}<td>b<tr><td>a<td>c</table>") == f"{long}  b\na{' ' * 301}c"
    # padding is bounded, text is not
    n = 20_000
    out = H.render("<table>" + "<tr><td>a<td>b" * n + f"<tr><td>{'w' * 50_000}<td>z</table>")
    assert len(out) < 10_000_000 and out.count("b") == n and "w" * 50_000 + "  z" in out
