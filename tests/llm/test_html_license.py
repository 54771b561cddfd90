"""HTML rendering and license scans on written-out cases."""

import pytest

from matchloom.llm.html_text import extract_text, render
from matchloom.llm.license_scan import findings, license_scan, words_of
from matchloom.llm.license_texts import TEMPLATES

CASES = [
    ("plain", "plain"),
    ("", ""),
    ("<p>One<p>two", "One\n\ntwo"),
    ("a<div>b</div>c", "a\nb\nc"),
    ("<p>x  y\n z</p>", "x y z"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "- a\n- b\n  - c"),
    ('<ol start="3"><li>x<li value=7>y<li>z</ol>', "3. x\n7. y\n8. z"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple<td>1</table>", "Name   Qty\napple  1"),
    ("<table><tr><td rowspan=2>r<td>s<tr><td>t</table>", "r  s\n   t"),
    ("<table><td>lone cell</table>after", "lone cell\n\nafter"),
    ("<pre> keep\n  this</pre>", " keep\n  this"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<p hidden>no</p><p style='display: none'>no</p><p>yes</p>", "yes"),
    ("<script>var t = '</p>';</script>x<style>p{}</style>", "x"),
    ("a<!-- c <p> -->b", "ab"),
    ("&lt;b&gt; &amp; &copy;", "<b> & ©"),
    ("<details><summary>s</summary>body</details>", "s"),
    ("<details open><summary>s</summary>body</details>", "s\nbody"),
    ("<h1>T</h1>text", "T\n\ntext"),
    ("<b>un<i>closed <p>next", "unclosed\n\nnext"),
    ("<noscript>n</noscript><template>t</template>v", "v"),
    ("x</p></td>y", "xy"),
    ("a<", "a<"),
    ("1 < 2 > 1", "1 < 2 > 1"),
    ("<textarea><b>raw</b></textarea>", "<b>raw</b>"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\nd\nu\ne"),
]


CASES += [
    ("<table><tr>Total<td>5</table>", "Total\n5"),
    ("<table><tr><b>x</b></tr></table>", "x"),
    ("<table><tr><form>Ask<td>Name</td><td>Age</td></form></tr><tr><td>n<td>a</table>", "Ask\nName  Age\nn     a"),
    ("<table><tr>one<td>1</td></tr><tr><i>two</i><td>2</table>", "one\ntwo\n1\n2"),
    ("<table><tr><b hidden>no<td>never</td></b><td>y</table>", "y"),
    ("so <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>x=1/2</annotation></math> holds", "so x= 1 2 holds"),
    ("a<svg><title>t</title><defs><text>d</text></defs><rect/><desc/>z<g><text x=1>b <tspan>c</tspan></text></g></svg>e", "a\nb c\ne"),
    ("<svg><text display=none>no</text><foreignObject><p>html</p></foreignObject></svg>", "html"),
    ("<svg><path d='m0'><p>after an unclosed drawing", "after an unclosed drawing"),
    ("<svg/>a<math/>b", "ab"),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_render(page, want):
    assert render(page)[1].strip("\n") == want.strip("\n")


def test_render_title_and_hostile_pages():
    assert render("<head><title> A\n b </title></head>x") == ("A b", "x")
    assert render(None) == (None, None)
    for page in ("<" * 5000, '<a "' * 3000, "<div>" * 5000 + "x", "<table>" * 300 + "q", "<td>" * 2000, "<!--", "<p", "<b a='", "</" * 999):
        render(page)


@pytest.mark.parametrize("wrap", ["<font>", "<b>", "<div>"])
def test_hidden_parts_and_lists_at_any_depth(wrap):
    for depth in (10, 300, 20000):
        page = wrap * depth + "<p>top<script>var a = '<p>code';</script><style>p{}</style><template>t</template><p hidden>no <i>never</i></p>"
        page += "<div style='display:none'>gone</div></u></section><ul><li>x<li>y</ul><table><tr><td>a<td>b</table>end"
        assert render(page)[1] == "top\n\n- x\n- y\n\na  b\n\nend"
    assert render("<p><button>" + wrap * 20000 + "x")[1] == "x"


def test_extract_text(spark):
    rows = [(1, "u", "<p>a"), (2, None, None), (1, "u", "<p>a"), (3, "u", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "0 AS TEXT")
    got = extract_text(frame)
    assert got.columns == ["page_id", "url", "title", "text"]
    assert sorted((r.page_id, r.text) for r in got.collect() if r.text is not None) == [(1, "a"), (1, "a"), (3, "")]
    assert extract_text(frame.filter("false")).count() == 0


PROSE = "alpha beta gamma delta " * 30


@pytest.mark.parametrize(("license_", "wording"), TEMPLATES)
def test_template_in_prose(license_, wording):
    (found,) = findings(PROSE + wording + " " + PROSE)
    start = len(words_of(PROSE))
    assert found[0] == license_ and found[1:3] == (start, start + len(words_of(wording))) and found[4:] == ([], [])


def test_license_differences():
    mit = TEMPLATES[0][1].replace("free of charge", "at no cost").replace("\n", " ").upper()
    ((name, _, _, saved, missing, added),) = findings(mit)
    assert name == "MIT" and saved > 0 and missing == ["free", "of", "charge"] and added == ["at", "no", "cost"]
    two = findings("Released under the\nMIT License. Then some words. All rights reserved.")
    assert [f[0] for f in two] == ["MIT", "proprietary"]
    assert [f[0] for f in findings("This work is licensed under the GNU General Public License, version 9.")] == [None]
    assert [f[0] for f in findings("You need a licence to fish in this river, he said to us all.")] == [None]


def test_license_scan(spark):
    rows = [(1, None), (2, ""), (3, PROSE), (4, "Licensed under CC BY-NC 4.0."), (4, "Licensed under CC BY-NC 4.0."), (5, PROSE * 300 + "Released under the MIT License.")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS license")
    assert sorted((r.doc_id, r.license) for r in license_scan(frame).collect()) == [(4, "CC-BY-NC-4.0")] * 2 + [(5, "MIT")]
    assert license_scan(frame.filter("false")).count() == 0


@pytest.mark.parametrize("notices", [20, 250, 1000])
def test_findings_grow_with_the_text(notices):
    text = "\n".join(f"file {i} copyright 20{i % 90 + 10} someone all rights reserved" for i in range(notices))
    found = findings(f"{text} {TEMPLATES[0][1]} {text}")
    names = [f[0] for f in found]
    assert names.count("proprietary") == 2 * notices and names.count("MIT") == 1
    assert all(a[2] <= b[1] for a, b in zip(found, found[1:]))


def test_every_template_is_compared():
    """Each text of two templates side by side gives what comparing all templates at all places gives."""
    for i, (name, wording) in enumerate(TEMPLATES):
        other, more = TEMPLATES[(i * 5 + 3) % len(TEMPLATES)]
        text = f"{PROSE}{wording} {PROSE} {more} {PROSE}"
        words, exact = words_of(text), []
        for license_, template in TEMPLATES:
            t = words_of(template)
            exact += [(a, a + len(t), license_) for a in range(len(words) - len(t) + 1) if words[a : a + len(t)] == t]
        longest = [e for e in exact if not any(f[0] <= e[0] and e[1] <= f[1] and f[1] - f[0] > e[1] - e[0] for f in exact)]
        assert {(f[1], f[2], f[0]) for f in findings(text) if f[0]} == set(longest)
