"""Layout-aware rendering of pages: markup to visible text, and rendered lines to their main body.

Markup goes through a tree builder that supplies implied tags (an ``li`` ends the
open ``li``, a block ends the open ``p``, cells and rows end each other), applies
visibility rules (hidden elements, scripts, page furniture) and prints the rest
with block spacing, list markers and table cells in aligned columns.

Text that was rendered before has lost its tags. For it the same builder works on
lines, whose tags are implied by layout and by repetition; no wording is known to it:

1. Each line is given its shape (title, running text, list item, code, or the rest of
   a hard-wrapped line) and, if it is a row of short parts with marks between, its parts.
2. Over the whole collection it is counted in how many different pages of a source, and
   of a language, each line and part occurs. Pages count as different if their least
   long line differs, so copies of one page count about once. Digits are alike.
3. A line that recurs in more than ``SOURCE_RATE`` of the pages of its source or
   ``LANG_RATE`` of its language, ``LEAST`` pages at least, is site text. A row of parts is
   a menu or a trail if its first part, or most of its parts, are site text.
4. Site text that elsewhere is mostly followed by two or more titles opens an ``aside``,
   which adopts the title lines after it up to running text, a list, code or site text.
5. The tree of these tags is walked with the visibility rules of markup; the lines of
   invisible nodes are the furniture.

A source (language) has at most its mean number of lines a page times the inverse rate
of site texts, so the tables of those that hold more than 1/``GROUPS`` of all pages are
sent to the workers; pages of smaller ones meet their tables in a join without hot keys.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlode.session import cut, spread

SOURCE_RATE, LANG_RATE, LEAST, LEADS, GROUPS = 0.016, 0.004, 4, 0.6, 500

_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_PARTS = re.compile(r"\s*[|·›»>/•]\s*|\s{2,}|\t")
_ITEM = re.compile(r"\s*(?:[-*•‣◦·–]|\(?\d{1,3}[.)]|\(?[a-zA-Z]\))\s+\S")
_CODE = re.compile(r"(?:[\w.]+\(.*\)|[\w.]+\s*[=:]\s*\S+|```.*|[{}<>$#].*)$")
_END = re.compile(r"[.!?…。！？।؟;:,，、；：]\W{0,2}$")
_WIDE = re.compile("[⺀-\U0003ffff]")
TITLE, RUNNING, ITEM, CODE, REST = range(5)
PART_CHARS, WRAP_CHARS, LONG_CHARS = 60, 40, 40


def line_key(line: str) -> str:
    """What is compared of a line: no white space, no case, each number as one 0."""
    return _DIGITS.sub("0", _SPACE.sub("", line).casefold())


def line_parts(line: str) -> list[str]:
    """Parts of a row of short texts with marks, tabs or wide gaps between; none for running text."""
    parts = [p for p in _PARTS.split(line.strip()) if p]
    return parts if len(parts) > 1 and max(map(len, parts)) <= PART_CHARS and not _END.search(parts[0]) else []


def line_shape(line: str, before: str) -> int:
    """TITLE, RUNNING, ITEM, CODE or REST (of the wrapped line ``before`` it)."""
    text = line.strip()
    if len(before) >= WRAP_CHARS and text[0].islower() and not _END.search(before):
        return REST
    if _ITEM.match(line):
        return ITEM
    if _CODE.match(text):
        return CODE
    wide = len(_WIDE.findall(text[:40])) > 5
    return RUNNING if len(text) > (40 if wide else 100) or _END.search(text) else TITLE


def _hash(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"))


def page_lines(text: str) -> tuple[int, list[tuple[int, int, int, bool, list[int]]]]:
    """Fingerprint of a page, and for each line that is not blank: number, key, shape, whether two titles follow, keys of its parts."""
    rows, before = [], ""
    longest: list[int] = []
    for no, line in enumerate(text.split("\n")):
        stripped = line.strip()
        if stripped:
            shape = line_shape(line, before)
            key = _hash(_SPACE.sub("", line).casefold() if shape == ITEM else line_key(line))
            parts = [] if shape in (REST, ITEM, CODE) or len(stripped) < 3 else [_hash(line_key(p)) for p in line_parts(line)]
            rows.append((no, key, shape, parts))
            if len(stripped) >= LONG_CHARS and not parts:
                longest.append(key)
        before = stripped
    shapes = [r[2] for r in rows] + [TITLE, TITLE]
    leads = [shapes[i + 1] == TITLE and shapes[i + 2] == TITLE and i + 2 < len(rows) for i in range(len(rows))]
    return min(longest or [r[1] for r in rows], default=0), [(no, key, shape, lead, parts) for (no, key, shape, parts), lead in zip(rows, leads)]


def implied_tags(lines: list[tuple[int, int, int, bool, list[int]]], known: dict[int, float]) -> list[str]:
    """Tag of each line: nav, aside (a heading of a list of other pages), dialog (other site text), or li, pre, h, p of the article.

    ``known`` gives the site texts of the page's source and language with the share of
    their occurrences that two titles follow.
    """
    tags = []
    for _, key, shape, _, parts in lines:
        if shape != REST and key in known:
            tags.append("nav" if parts else "aside" if known[key] >= LEADS and shape == TITLE else "dialog")
        elif parts and (parts[0] in known or 2 * sum(p in known for p in parts) > len(parts)):
            tags.append("nav")
        else:
            tags.append(("h", "p", "li", "pre", "p")[shape])
    return tags


# ---- markup -----------------------------------------------------------------

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("address article aside blockquote body details div dl dd dt fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody thead tfoot tr ul".split())
UNSEEN = frozenset("script style template noscript head title svg iframe object select button form".split())
FURNITURE = frozenset("nav footer header aside dialog".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_MARKUP = re.compile(r"<(?:!doctype|html|head|body|div|p|article|main|section|table|ul|ol|h[1-6]|span|br)\b[^>]*>", re.I)


class _Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.kids = tag, attrs, []


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("html", {})
        self.open = [self.root]

    def _close(self, tags: set[str], stop: set[str]) -> None:
        at = 0
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in stop:
                break
            if self.open[i].tag in tags:
                at = i
        if at:
            del self.open[at:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._close({"p"}, {"table", "td", "th", "li", "div", "section", "article"})
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPE.get(tag, set()))
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].kids.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def _seen(n: _Node, main_only: bool) -> bool:
    a = n.attrs
    return not (n.tag in UNSEEN or "hidden" in a or a.get("aria-hidden") == "true" or _STYLE.search(a.get("style", ""))
                or main_only and (n.tag in FURNITURE or a.get("role") in ("navigation", "banner", "contentinfo", "complementary")))


def _cells(row: _Node, main_only: bool) -> list[str]:
    return [_SPACE.sub(" ", render_node(c, main_only)).strip() for c in row.kids if isinstance(c, _Node) and c.tag in ("td", "th")]


def _rows(n: _Node):
    for c in n.kids:
        if isinstance(c, _Node):
            if c.tag == "tr":
                yield c
            elif c.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(c)


def render_node(n: _Node, main_only: bool, depth: int = 0, pre: bool = False) -> str:
    """Visible text of a subtree: blocks on lines of their own, paragraphs apart, lists marked, cells aligned."""
    out: list[str] = []
    number = 0

    def block(s: str, gap: int) -> None:
        body = s.strip("\n") if pre else s.strip()
        if body:
            have = len(out[-1]) - len(out[-1].rstrip("\n")) if out else gap
            out.append("\n" * max(0, gap - have) + body + "\n" * gap)

    for c in n.kids:
        if isinstance(c, str):
            new_line = not out or out[-1].endswith("\n")
            out.append(c if pre else (_SPACE.sub(" ", c).lstrip() if new_line else _SPACE.sub(" ", c)))
        elif not _seen(c, main_only):
            continue
        elif c.tag == "br":
            out.append("\n")
        elif c.tag == "table":
            rows = [_cells(r, main_only) for r in _rows(c)]
            width = [max((len(r[i]) for r in rows if i < len(r)), default=0) for i in range(max(map(len, rows), default=0))]
            block("\n".join("  ".join(x.ljust(width[i]) for i, x in enumerate(r)).rstrip() for r in rows), 2)
        elif c.tag in ("ul", "ol"):
            block(render_node(c, main_only, depth + 1), 2 if depth == 0 else 1)
        elif c.tag == "li":
            number += 1
            mark = f"{number}. " if n.tag == "ol" else "- "
            block("  " * max(0, depth - 1) + mark + render_node(c, main_only, depth).strip(), 1)
            if out:
                out[-1] = "  " * max(0, depth - 1) * (not out[-1].startswith(" ")) + out[-1]
        elif c.tag == "pre":
            block(render_node(c, main_only, depth, True), 2)
        elif c.tag in BLOCK:
            block(render_node(c, main_only, depth, pre), 2 if c.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote") else 1)
        else:
            out.append(render_node(c, main_only, depth, pre))
    return "".join(out)


def _find(n: _Node, tag: str) -> _Node | None:
    stack = [n]
    while stack:
        x = stack.pop()
        if x.tag == tag and x is not n:
            return x
        stack += [k for k in reversed(x.kids) if isinstance(k, _Node)]
    return None


def render_markup(html: str, main_only: bool = True) -> str:
    """Text of a page's markup as a reader sees it; with ``main_only`` without its furniture."""
    b = _Builder()
    b.feed(html)
    b.close()
    top = b.root
    if main_only:
        top = _find(top, "main") or _find(top, "article") or _find(top, "body") or top
    text = re.sub(r"[ \t]+\n", "\n", render_node(top, main_only))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


# ---- rendered lines ---------------------------------------------------------

def line_tree(lines: list[tuple], tags: list[str]) -> _Node:
    """Tree of the lines of a rendered page; its leaves are line numbers.

    Menu lines in a row share a ``nav``. An ``aside`` adopts the titles after it, as
    ``li`` with implied tags, if there are two at least or the page ends with them;
    anything else closes it.
    """
    root = _Node("html", {})
    at = 0
    while at < len(tags):
        tag = tags[at]
        node = _Node(tag, {})
        node.kids.append(lines[at][0])
        at += 1
        if tag == "nav" and root.kids and root.kids[-1].tag == "nav":
            root.kids[-1].kids += node.kids
            continue
        if tag == "aside":
            end = at
            while end < len(tags) and tags[end] == "h":
                end += 1
            if end - at > 1 or end == len(tags):
                for no, *_ in lines[at:end]:
                    item = _Node("li", {})
                    item.kids.append(no)
                    node.kids.append(item)
                at = end
        root.kids.append(node)
    return root


def _leaves(n: _Node):
    for k in n.kids:
        if isinstance(k, _Node):
            yield from _leaves(k)
        else:
            yield k


def unseen_lines(n: _Node) -> list[tuple[int, str]]:
    """Numbers of the lines below invisible nodes of a line tree, with the tag that hides them."""
    out: list[tuple[int, str]] = []
    for k in n.kids:
        if isinstance(k, _Node):
            out += unseen_lines(k) if _seen(k, True) else [(no, k.tag) for no in _leaves(k)]
    return out


# ---- tables -----------------------------------------------------------------

_LINES = "source string, lang string, page long, no array<int>, key array<long>, shape array<byte>, lead array<boolean>, n_parts array<int>, parts array<long>"


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def _lines(batches):
    """Lines of each page as arrays."""
    for b in batches:
        pages, nos, keys, shapes, leads, n_parts, parts, lens, part_lens = [], [], [], [], [], [], [], [], []
        for text in b.column("text").to_pylist():
            page, lines = page_lines(text)
            pages.append(page)
            lens.append(len(lines))
            before = len(parts)
            for no, key, shape, lead, own in lines:
                nos.append(no)
                keys.append(key)
                shapes.append(shape)
                leads.append(lead)
                n_parts.append(len(own))
                parts += own
            part_lens.append(len(parts) - before)
        at, at_parts = (pa.array(np.concatenate([[0], np.cumsum(x)]).astype(np.int32)) for x in (lens, part_lens))
        flat = (pa.array(nos, pa.int32()), pa.array(_signed(keys)), pa.array(shapes, pa.int8()), pa.array(leads, pa.bool_()), pa.array(n_parts, pa.int32()))
        lists = [pa.ListArray.from_arrays(at, x) for x in flat]
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("source"), b.column("lang"), pa.array(_signed(pages)), *lists, pa.ListArray.from_arrays(at_parts, pa.array(_signed(parts)))],
            names=["id", "source", "lang", "page", "no", "key", "shape", "lead", "n_parts", "parts"])


def _site_texts(pages: DataFrame, kind: str, rate: float) -> DataFrame:
    """One row per value of ``kind`` (source or lang): name, n pages, and its site texts (keys and lead shares).

    Keys of lines and parts are counted in different pages, first by page and then
    by key, so that no key, however common, has its pages in one task.
    """
    whole = F.filter(F.arrays_zip("key", "shape", "lead"), lambda x: x["shape"] != REST)
    lines = F.transform(whole, lambda x: F.struct(x["key"].alias("key"), x["lead"].cast("int").alias("lead")))
    parts = F.transform("parts", lambda x: F.struct(x.alias("key"), F.lit(None).cast("int").alias("lead")))
    texts = F.concat(lines, parts)
    each = pages.select(F.col(kind).alias("name"), "page", F.explode(texts).alias("x")).select("name", "page", "x.key", "x.lead")
    counted = each.groupBy("name", "key").agg(F.countDistinct("page").alias("n"), F.avg("lead").alias("lead")).where(F.col("n") >= LEAST)
    sizes = pages.groupBy(F.col(kind).alias("name")).agg(F.countDistinct("page").alias("pages"))
    common = counted.join(sizes, "name").where(F.col("n") >= F.col("pages") * rate)
    return common.groupBy("name").agg(
        F.max("pages").alias("pages"),
        F.collect_list("key").alias("keys"),
        F.collect_list(F.coalesce("lead", F.lit(0.0))).alias("leads"))


def _hide(large: dict[str, dict[str, dict[int, float]]]):
    """Furniture of pages, given the site texts of large sources and languages; those of small ones come with the rows."""
    def run(batches):
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in b.schema.names if n != "id"}
            ids, nos, tags = [], [], []
            for i in range(b.num_rows):
                own = [large[kind].get(c[kind][i]) or dict(zip(c[f"{kind}_keys"][i] or (), c[f"{kind}_leads"][i] or ())) for kind in ("source", "lang")]
                lines, at = [], 0
                for no, key, shape, lead, n in zip(c["no"][i], c["key"][i], c["shape"][i], c["lead"][i], c["n_parts"][i]):
                    lines.append((no, key, shape, lead, c["parts"][i][at : at + n]))
                    at += n
                known = {k: max(o.get(k, 0.0) for o in own) for line in lines for k in (line[1], *line[4]) if k in own[0] or k in own[1]}
                for no, tag in unseen_lines(line_tree(lines, implied_tags(lines, known))):
                    ids.append(i)
                    nos.append(no)
                    tags.append(tag)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(ids, pa.int64())), pa.array(nos, pa.int32()), pa.array(tags, pa.string())], names=["id", "line_no", "tag"])
    return run


def _furniture(src: DataFrame, kind: str) -> DataFrame:
    """id, line_no, tag of the furniture of ``src`` (id, source, lang, text)."""
    pages = cut(spread(src).mapInArrow(_lines, f"id {kind}, {_LINES}"), "pages-lines")
    large, shown = {}, pages
    for by, rate in (("source", SOURCE_RATE), ("lang", LANG_RATE)):
        n = pages.agg(F.countDistinct(by, "page")).first()[0]
        site = cut(_site_texts(pages, by, rate), f"pages-{by}")
        hot = F.col("pages") * GROUPS > n
        # fewer than GROUPS rows, each of at most the mean number of lines a page times the inverse rate
        large[by] = {r.name: dict(zip(r["keys"], r["leads"])) for r in site.where(hot).collect()}
        small = site.where(~hot).select(F.col("name").alias(by), F.col("keys").alias(f"{by}_keys"), F.col("leads").alias(f"{by}_leads"))
        none = {f"{by}_keys": F.lit(None).cast("array<long>"), f"{by}_leads": F.lit(None).cast("array<double>")}
        if small.isEmpty():
            shown = shown.withColumns(none)
        else:
            is_large = F.col(by).isin(list(large[by])) if large[by] else F.lit(False)
            shown = shown.where(is_large).withColumns(none).unionByName(shown.where(~is_large).join(small, by, "left"))
    return shown.mapInArrow(_hide(large), f"id {kind}, line_no int, tag string")


def _source(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str) -> tuple[DataFrame, str]:
    """id, source, lang (two letters), text; a table without these columns is one source, or language."""
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("")) if source_col in docs.columns else F.lit("")
    lang = F.lower(F.substring(F.coalesce(F.col(lang_col).cast("string"), F.lit("")), 1, 2)) if lang_col in docs.columns else F.lit("")
    src = docs.select(F.col(id_col).alias("id"), source.alias("source"), lang.alias("lang"), F.col(text_col).alias("text")).where("text is not null")
    return src, src.schema["id"].dataType.simpleString()


def furniture_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """One row per line of a page that is furniture: id, line_no (from 0), tag (nav, aside or dialog).

    Lines are those of the text as it is, which is taken as rendered. What recurs in
    fewer than LEAST pages of a source and of a language is article, so the menus of a
    collection of a few pages are found only as far as they recur. Null and empty texts
    give no rows, a repeated row gives its lines again (and counts as one page), ids may be null, a null source or language is one of its own, other columns are
    not read, an empty table gives an empty result.
    """
    src, kind = _source(docs, id_col, text_col, source_col, lang_col)
    return _furniture(src, kind).withColumnRenamed("id", id_col)


def _render(batches):
    """Markup becomes the text that a reader sees, without the furniture that its tags tell of."""
    for b in batches:
        texts = [render_markup(t) if _MARKUP.search(t) else t for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(texts, pa.string())], names=b.schema.names)


def _main(batches):
    for b in batches:
        out = []
        for text, hidden in zip(b.column("text").to_pylist(), b.column("hidden").to_pylist()):
            gone = set(hidden or ())
            kept = "\n".join(x for no, x in enumerate(text.split("\n")) if no not in gone)
            out.append(re.sub(r"\n{3,}", "\n\n", kept).strip())
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.string())], names=["id", "main_text"])


def main_content(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """One row per row with a text: id and its main body (empty if there is none).

    Markup is rendered without the furniture that its tags tell of, and then treated like
    other pages. The lines hidden by ``furniture_lines`` meet their page by a digest of its
    source, language and text, so null and repeated ids do no harm and equal pages are decided once.
    """
    src, kind = _source(docs, id_col, text_col, source_col, lang_col)
    src = spread(src).mapInArrow(_render, f"id {kind}, source string, lang string, text string")
    keyed = src.withColumn("digest", F.sha2(F.concat_ws("\x01", "source", "lang", "text"), 256))
    hidden = _furniture(keyed.select(F.col("digest").alias("id"), "source", "lang", "text"), "string").groupBy(F.col("id").alias("digest")).agg(F.collect_set("line_no").alias("hidden"))
    return keyed.join(hidden, "digest", "left").select("id", "text", "hidden").mapInArrow(_main, f"id {kind}, main_text string").withColumnRenamed("id", id_col)
