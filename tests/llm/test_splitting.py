from hypothesis import given, settings
from hypothesis import strategies as st

from lexlode.llm.splitting import _first, cuts, split_oversized, successors

ALPHABET = st.sampled_from(list("ab .!?\n,。字“é́"))


def brute(text, size, overlap):
    """The same cuts one after the other."""
    out, end, start, table = [], _first(text, size), 0, successors(text, size, overlap)
    while True:
        out.append((start, end))
        if end >= len(text):
            return out
        start, end = max(0, end - overlap), int(table[end])


@settings(max_examples=150, deadline=None)
@given(st.text(ALPHABET, max_size=300), st.integers(2, 40), st.integers(0, 20))
def test_pieces(text, size, overlap):
    overlap = min(overlap, size - 1)
    got = cuts(text, size, overlap)
    if len(text) <= size:
        assert got == [(0, len(text))]
        return
    assert got == brute(text, size, overlap)
    assert all(0 < e - s <= size for s, e in got)
    assert text == text[: got[0][1]] + "".join(text[p[1] : n[1]] for p, n in zip(got, got[1:]))
    assert all(n[0] == max(0, p[1] - overlap) for p, n in zip(got, got[1:]))


def test_natural_places():
    text = "One two three. Four five six.\n\nSeven eight nine ten. Eleven twelve."
    got = [text[s:e] for s, e in cuts(text, 40, 0)]
    assert got == ["One two three. Four five six.\n\n", "Seven eight nine ten. Eleven twelve."]


def test_table(spark):
    limits = spark.createDataFrame([("document", "chars", 10, 2), ("box", "tokens", 5, 0)], "item_kind string, unit string, max_size int, overlap int")
    rows = [("document", "1", "short"), ("document", "2", "a" * 25), ("document", "2", "a" * 25), ("document", "3", None), ("document", None, "b" * 30), ("box", "4", "c" * 30), ("other", "5", "d" * 30)]
    items = spark.createDataFrame(rows, "item_kind string, item_id string, text string").selectExpr("*", "1 as max_size", "2 as piece_no")
    got = split_oversized(items, limits).orderBy("piece_no").collect()
    assert [(r.item_id, r.piece_no, r.start_char, r.end_char) for r in got] == [("2", 0, 0, 10), ("2", 1, 8, 18), ("2", 2, 16, 25)]
    assert split_oversized(items.limit(0), limits).count() == 0
