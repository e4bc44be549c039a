import pytest
from pyspark.sql import functions as F

from lexlode.functions import text as X


@pytest.fixture
def one(spark):
    def run(values, f, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r.o for r in df.select("i", f("v").alias("o")).orderBy("i").collect()]

    return run


def test_clean(one):
    cases = ["a\0b", "a\n\n\n\nb", "a \t b", "mod-\nel", "A-\nB", "x-\ny-\nz", "  a 　", None]
    assert one(cases, X.clean_text) == ["ab", "a\n\nb", "a b", "model", "A-\nB", "xyz", "a", None]


def test_terms(one):
    got = one(["Élan of-the X_1 a I 3d", "the of", "", None, "ÄÖ naïve \U0001f600 ok"], X.index_terms)
    assert got == [["élan", "of-the", "x_1", "3d"], [], [], None, ["äö", "naïve", "ok"]]


def test_sentences(one):
    assert one(["One. Two! three? Four", "", "No end", "Dr. Smith went."], X.sentences) == [["One.", "Two! three?", "Four"], [], ["No end"], ["Dr.", "Smith went."]]


def test_title_case(one):
    cases = ["o'neil", "o-brien", "x.y", "gpt4all", "élan vital", "ABC", ""]
    assert one(cases, X.title_case) == [c.title() for c in cases]


def test_snaps(spark):
    import random

    def left(t, p):
        while p > 0:
            if t[p] in ".!?\n":
                return p + 1
            p -= 1
        return 0

    def right(t, p):
        while p < len(t):
            if t[p] in ".!?\n":
                return min(p + 1, len(t))
            p += 1
        return len(t)

    r = random.Random(1)
    rows = []
    for i in range(300):
        t = "".join(r.choice("ab.!\n ") for _ in range(r.randint(1, 15)))
        rows.append((i, t, r.randrange(len(t))))
    got = spark.createDataFrame(rows, "i int, t string, p int").select("i", X.snap_left(F.col("t"), F.col("p")).alias("l"), X.snap_right(F.col("t"), F.col("p")).alias("r")).orderBy("i").collect()
    assert [(g.l, g.r) for g in got] == [(left(t, p), right(t, p)) for _, t, p in rows]


def test_small_ones(one):
    assert one(["in/a_b-c.x.pdf", "plain"], X.basename) == ["a_b-c.x.pdf", "plain"]
    assert one(["in/my_old-note.PDF", ".hidden"], X.stem_title) == ["My Old Note", ".Hidden"]
    assert one(["```json\n{1}\n```", " x "], X.fence_strip) == ["{1}", "x"]
    assert one([0.625, 0.0, None], X.number_or_dash, "double") == ["0.62", "—", "—"]
    assert one([-1.0, 0.5, 7.0], X.score_percent, "double") == [0, 50, 100]
    assert one([5, 2048, 3 << 20], X.human_size, "long") == ["5 B", "2.0 KB", "3.0 MB"]
    assert one(['["a","b"]', "bad"], X.strategy_label) in (["A+B", None], ["A+B", ""])
    assert one(["<a href='x'>&"], X.html_escape) == ["&lt;a href=&#39;x&#39;&gt;&amp;"]
    assert one(["x [1] [9] [0] ["], lambda c: X.link_citations(c, F.lit(2))) == ["x [[1]](#cite-1) [9] [0] ["]
    assert one(["", "abc", "a" * 9], X.token_estimate) == [1, 1, 2]
