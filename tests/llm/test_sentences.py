import pytest

from lexlode.llm.sentences import fit, sentence_units, units

MODEL = fit([])
CASES = [
    ("text", "Mr. Tesk vs. the model: who archives it? See Fig. 6 and Sec. 3.9. Open settings.local.yaml now.", ["Mr. Tesk vs. the model: who archives it?", "See Fig. 6 and Sec. 3.9.", "Open settings.local.yaml now."]),
    ("text", '"Stop! The row is old!" read the map. The note says: "It waits." Next came Dr. Orvane.', ['"Stop! The row is old!" read the map.', 'The note says: "It waits."', "Next came Dr. Orvane."]),
    ("text", "J. R. Vantoor left at 9 a.m. and came.It was late. (The map is old.) So be it.", ["J. R. Vantoor left at 9 a.m. and came.", "It was late.", "(The map is old.)", "So be it."]),
    ("text", "Title\n\n- One item. Two parts.\n1. Next\nrun.map(x=50)\nLast line", ["Title", "- One item. Two parts.", "1. Next", "run.map(x=50)", "Last line"]),
    ("pdf", "A title\n\nThe first line goes\non here. The sec-\nond ends.\n \n- item one\n\nend", ["A title", "The first line goes\non here.", "The sec-\nond ends.", "- item one", "end"]),
    ("html", "Manche Stufen, z. B. die alten, warten. Am 2. Mai kam er. „Ist es so?“, fragte sie. Es heißt: „Ja.“ Gut.", ["Manche Stufen, z. B. die alten, warten.", "Am 2. Mai kam er.", "„Ist es so?“, fragte sie.", "Es heißt: „Ja.“", "Gut."]),
    ("html", "文档写道：“旧的提示。”“准备好了吗？”负责人问道。图6.3很短!团队走了。他说“好！”之后就走了。", ["文档写道：“旧的提示。”", "“准备好了吗？”负责人问道。", "图6.3很短!", "团队走了。", "他说“好！”之后就走了。"]),
    ("html", "「札は長いか?」と尋ねた。閾値を3.1に上げる。", ["「札は長いか?」と尋ねた。", "閾値を3.1に上げる。"]),
    ("text", "कतार रुकती है। “क्या यह है?” उसने पूछा। डॉ. Kelpar आए!", ["कतार रुकती है।", "“क्या यह है?” उसने पूछा।", "डॉ. Kelpar आए!"]),
    ("text", "ทีมงานพบว่าคิวงานว่าง ค่าเกณฑ์เพิ่มจาก10.2เป็น3\n- คู่มือ ยาว", ["ทีมงานพบว่าคิวงานว่าง", "ค่าเกณฑ์เพิ่มจาก10.2เป็น3", "- คู่มือ ยาว"]),
    ("text", "", []), ("text", " \n \n", []), (None, "One. Two.", ["One.", "Two."]),
]


@pytest.mark.parametrize("kind, text, want", CASES)
def test_units(kind, text, want):
    got = units(text, kind, MODEL)
    assert [text[s:e] for s, e in got] == want
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_trained_on_evidence():
    key = ("T", ".", "zzz", "l", True, "U", False, False, "latin")
    assert MODEL(key)
    assert not fit([(key, 500, 0)])(key)
    assert fit([(key, 500, 60)])(key)


def test_table(spark):
    rows = [(i, t, k) for i, (k, t, _) in enumerate(CASES)] + [(99, None, "text"), (100, "x. " * 20_000, "pdf"), (101, "One. Two.", "html"), (101, "One. Two.", "html")]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc_type string").selectExpr("*", "1 as h", "2 as id")
    got = sentence_units(df).collect()
    assert sum(r.doc_id == 101 for r in got) == 4 and not any(r.doc_id == 99 for r in got)
    text = dict((i, t) for i, t, _ in rows)
    assert all(text[r.doc_id][r.start_char : r.end_char].strip() == text[r.doc_id][r.start_char : r.end_char] != "" for r in got)
    assert sentence_units(df.limit(0)).count() == 0


def test_held_out_boundaries(spark):
    """Decisions on candidates before wide gaps, which are boundaries, and before lower-case words, which are not."""
    import pyarrow as pa

    from lexlode.llm.sentences import _evidence, candidates, blocks

    train = ["Dr. Orvane came to the map.  The row is old. It costs approx. 5 ms, i.e. nothing."] * 50
    test = ["Mr. Vantoor took the box.  Every map is new, e.g. this one."] * 20
    rows = next(_evidence([pa.RecordBatch.from_pydict({"t": train, "k": ["text"] * len(train)})])).to_pylist()
    from ast import literal_eval

    model = fit([(literal_eval(r["key"]), r["n"], r["sure"]) for r in rows])
    right = [model(key) == (len(gap) > 1 or key[5] == "E") for t in test for s, e in blocks(t, "text") for _, _, key, gap in candidates(t, s, e) if len(gap) > 1 or key[5] in "El"]
    assert sum(right) / len(right) > 0.95
