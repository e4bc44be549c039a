import random
from collections import defaultdict

from lexlode.llm import rendering
from lexlode.llm.rendering import furniture_lines, implied_tags, line_tree, main_content, page_lines, render_markup, unseen_lines

# A site whose wordings occur nowhere in the given tables.
TOP = ["This website uses cookies to personalise content and ads.", "I understand", "Open the navigation panel"]
MENU = ["Shop", "Cart", "My account", "Store finder", "Gift cards", "Help centre"]
HEADS = ["Trending now", "More from this author", "Weitere Themen aus dem Ressort"]
MIDDLE = ["Tell a friend", "Rate this text: 1 2 3 4 5", "Jetzt kostenlos testen"]
FOOT = ["Terms and conditions", "Cookie policy", "プライバシーポリシー", "Copyright {y} Quellmar Ltd, all rights kept", "Printed on {y}-03-02"]
NOUNS = [a + b for a in "bar dol fen gim hov jas kel lum mor nip".split() for b in "ak el im on ur ys ep ad".split()]


def _title(r):
    return f"{r.choice(NOUNS).title()} and the {r.choice(NOUNS)} of {r.choice(NOUNS)}"


def _prose(r):
    return " ".join(f"The {r.choice(NOUNS)} of {r.choice(NOUNS)} keeps {r.randrange(900)} {r.choice(NOUNS)}s near the {r.choice(NOUNS)}." for _ in range(r.randrange(1, 4)))


def _page(r):
    """Lines of a page, each with whether it is furniture."""
    out = [(x, True) for x in r.sample(TOP, r.randrange(3))]
    if r.random() < 0.5:
        out.append((" | ".join(r.sample(MENU, r.randrange(3, 6))), True))
    else:
        out += [(x, True) for x in r.sample(MENU, r.randrange(2, 5))]
    if r.random() < 0.4:
        out.append((f"{r.choice(MENU)} > {r.choice(MENU)} > {_title(r)}", True))
    out.append((_title(r), False))
    for _ in range(r.randrange(3, 9)):
        out.append((_prose(r), False))
        if r.random() < 0.15:
            out.append((r.choice(MIDDLE), True))
        if r.random() < 0.15:
            out += [(r.choice(HEADS), True), *((_title(r), True) for _ in range(r.randrange(2, 9)))]
        if r.random() < 0.2:
            out += [("", False), (f"- {r.choice(NOUNS)}: {r.randrange(99)}", False)]
    return out + [(x.format(y=r.randrange(1990, 2030)), True) for x in r.sample(FOOT, r.randrange(2, 5))]


def test_unknown_wordings(spark):
    """Recall and precision on a site with wordings of its own: the figures are in the README."""
    r = random.Random(5)
    pages = {i: _page(r) for i in range(400)}
    copies = {1000 + i: pages[0] for i in range(300)}  # a page stored over and over is no site text
    rows = [(i, "\n".join(x for x, _ in p), "one", "en") for i, p in (pages | copies).items()]
    got = {(x.doc_id, x.line_no) for x in furniture_lines(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    true = {(i, no) for i, p in (pages | copies).items() for no, (_, f) in enumerate(p) if f}
    assert len(got & true) / len(true) > 0.97 and len(got & true) / len(got) > 0.97


def test_counts_against_brute_force(spark):
    r = random.Random(6)
    rows = [(i, "\n".join(x for x, _ in _page(r)), f"s{i % 3}", "EN-x" if i % 2 else None) for i in range(150)]
    seen = {kind: (defaultdict(set), defaultdict(list), defaultdict(set)) for kind in (0, 1)}
    feats = []
    for _, text, source, lang in rows:
        page, lines = page_lines(text)
        names = (source, (lang or "")[:2].lower())
        feats.append((names, lines))
        for kind in (0, 1):
            where, leads, all_ = seen[kind]
            all_[names[kind]].add(page)
            for _, key, shape, lead, parts in lines:
                for k in ([key] if shape != rendering.REST else []) + parts:
                    where[names[kind], k].add(page)
                if shape != rendering.REST:
                    leads[names[kind], key].append(lead)
    want = set()
    for i, (names, lines) in enumerate(feats):
        known = {}
        for kind, rate in ((0, rendering.SOURCE_RATE), (1, rendering.LANG_RATE)):
            where, leads, all_ = seen[kind]
            for _, key, _, _, parts in lines:
                for k in (key, *parts):
                    n, lead = len(where[names[kind], k]), leads[names[kind], k]
                    if n >= rendering.LEAST and n >= rate * len(all_[names[kind]]):
                        known[k] = max(known.get(k, 0), sum(lead) / len(lead) if lead else 0)
        want |= {(i, no) for no, _ in unseen_lines(line_tree(lines, implied_tags(lines, known)))}
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = {(x.doc_id, x.line_no) for x in furniture_lines(df).collect()}
    assert got == want and len(got) > 500
    groups, rendering.GROUPS = rendering.GROUPS, 1  # every source is small: its table comes by a join
    try:
        assert {(x.doc_id, x.line_no) for x in furniture_lines(df).collect()} == want
    finally:
        rendering.GROUPS = groups


def test_tree():
    lines = [(no, 0, 0, False, []) for no in (0, 1, 3, 4, 5, 6, 8, 9)]
    tags = ["nav", "nav", "h", "p", "aside", "h", "p", "dialog"]
    assert unseen_lines(line_tree(lines, tags)) == [(0, "nav"), (1, "nav"), (5, "aside"), (9, "dialog")]
    tags = ["dialog", "h", "aside", "h", "h", "h", "p", "aside"]
    assert [no for no, _ in unseen_lines(line_tree(lines, tags))] == [0, 3, 4, 5, 6, 9]


def test_markup():
    html = ("<html><head><title>x</title><script>no()</script></head><body><nav>Home</nav><h1>T</h1><p>a <b>b</b> c<p>d &amp; e<ul><li>x<li>y<ol><li>z</ol></ul>"
            "<table><tr><th>k<th>value<tr><td>longer<td>1</table><div style='display: none'>no</div><p hidden>no</p><pre>a\n  b</pre><footer>Imprint</footer></body>")
    assert render_markup(html) == "T\n\na b c\n\nd & e\n\n- x\n- y\n1. z\n\nk       value\nlonger  1\n\na\n  b"
    assert "Imprint" in render_markup(html, main_only=False)
    assert render_markup("<p>open <b>never closed <table><tr><td>1</p></i>") == "open never closed\n\n1"


def test_tables(spark):
    pages = [(i, f"Home\nOn {NOUNS[i]}\nThis one of these pages tells of the {NOUNS[i]} alone.\nImprint") for i in range(9)]
    odd = [(20, None), (21, ""), (None, "Home"), (22, "x" * 100_000), (23, " \n\n "), (8, pages[8][1]), (24, "<nav>Go</nav><p>Body text.</p>")]
    df = spark.createDataFrame([*pages, *odd], "doc_id long, text string").selectExpr("*", "0 as line_no", "1 as tag", "2 as hidden")
    got = [(r.doc_id, r.line_no) for r in furniture_lines(df).collect()]
    assert got.count((8, 0)) == 2 and got.count((3, 3)) == 1 and (None, 0) in got
    assert {d for d, _ in got} <= {*range(9), None}
    main = [(r.doc_id, r.main_text) for r in main_content(df).collect()]
    assert len(main) == len(pages) + len(odd) - 1
    assert dict(main)[24] == "Body text." and dict(main)[21] == "" and dict(main)[None] == "" and "tells of" in dict(main)[3] and "Imprint" not in dict(main)[3]
    assert furniture_lines(df.limit(0)).count() == 0 and main_content(df.limit(0)).count() == 0
