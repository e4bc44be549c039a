"""Main text and title of HTML bytes, with the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa

DROPPED = frozenset("script style nav footer header aside".split())
PREFERRED = ("main", "article", "body")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Reader(HTMLParser):
    """Collects stripped text nodes with the tags they lie in; the first of each preferred tag counts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.nodes: list[tuple[str, frozenset[str]]] = []
        self.seen = dict.fromkeys(PREFERRED, 0)
        self.title: list[str] = []
        self.titles = 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        if tag in self.seen:
            self.seen[tag] += 1
        if tag == "title":
            self.titles += 1
        self.open.append((tag, self.seen.get(tag, 0)))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        tags = {t for t, _ in self.open}
        if "title" in tags and self.titles == 1:
            self.title.append(data)
        text = data.strip()
        if text and not tags & DROPPED:
            self.nodes.append((text, frozenset(t for t, n in self.open if t in self.seen and n == 1)))


def main_text(html: str) -> tuple[str, str]:
    """(text, title): text nodes of the first main, else article, else body, else all, one per line."""
    r = _Reader()
    r.feed(html)
    r.close()
    title = "".join(r.title).strip()
    for tag in PREFERRED:
        if r.seen[tag]:
            return "\n".join(t for t, inside in r.nodes if tag in inside), title
    return "\n".join(t for t, _ in r.nodes), title


def read_html(batches):
    """Arrow pass over (path, content): path, text, title."""
    for b in batches:
        got = [main_text((c or b"").decode("utf-8", "replace")) for c in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in got], pa.string()), pa.array([t for _, t in got], pa.string())], names=["path", "text", "title"])
