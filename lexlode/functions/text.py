"""Column functions over text; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: white space as Python understands it, for use inside a character class.
SPACE = r"\t-\r\x{1C}-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Words that the lexical index leaves out.
STOP_WORDS = tuple("""
a an the is are was were be been being have has had do does did will would
could should may might shall can of in on at to for with by from as into
through during before after above below between out off over under again
further then once here there when where why how all both each few more most
other some such no nor not only own same so than too very just because if
or and but i me my we our you your he she it they them their what which who
this that these those am""".split())


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(_col(c), f"^[{SPACE}]+|[{SPACE}]+$", "")


def clean_text(c: Column | str) -> Column:
    """NULs dropped, blank lines and runs of blanks shortened, hyphenated line ends joined, ends stripped."""
    c = F.regexp_replace(_col(c), r"\x00", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"[ \t]{2,}", " ")
    return strip(F.regexp_replace(c, r"(?<=[a-z])-\n(?=[a-z])", ""))


def short_hash(*parts: Column | str, size: int = 16) -> Column:
    """First hex digits of the SHA-256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *(_col(p).cast("string") for p in parts)), 256), 1, size)


def token_estimate(c: Column | str) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(_col(c)) / 4).cast("int"))


def words(c: Column | str) -> Column:
    """Lower-case runs of letters, digits, underscores and hyphens."""
    spaced = F.trim(F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}_-]+", " "))
    return F.filter(F.split(spaced, " "), lambda t: t != "")


def index_terms(c: Column | str) -> Column:
    """Terms of the lexical index: words of two or more characters that are no stop words."""
    return F.filter(words(c), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def sentences(c: Column | str) -> Column:
    """Sentences by a rule: a break after . ! or ? and white space before a capital A-Z."""
    parts = F.split(_col(c), rf"(?<=[.!?])[{SPACE}]+(?=[A-Z])")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def title_case(c: Column | str) -> Column:
    """Every run of letters with a capital first and small letters after it, as Python's title()."""
    runs = F.regexp_extract_all(_col(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def basename(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), "[^/]+$", 0)


def stem_title(path: Column | str, fold: bool = True) -> Column:
    """Title from a file's name: its stem, with _ and - as spaces and in title case if ``fold``."""
    stem = F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")
    return title_case(F.translate(stem, "_-", "  ")) if fold else stem


def snippet(c: Column | str, size: int) -> Column:
    return F.substring(_col(c), 1, size)


def context_text(parent: Column | str, text: Column | str) -> Column:
    """The parent text unless it is null or empty, else the text."""
    return F.coalesce(F.nullif(_col(parent), F.lit("")), _col(text))


def fence_strip(c: Column | str) -> Column:
    """Content of a fenced block: the fence and its language tag removed."""
    c = strip(c)
    return strip(F.regexp_replace(F.regexp_replace(c, r"^```[a-z]*\n?", ""), r"\n?```$", ""))


def snap_left(text: Column, pos: Column) -> Column:
    """Position after the last sentence end at 1..pos, else 0."""
    back = F.reverse(F.substr(text, F.lit(2), F.greatest(pos, F.lit(0))))
    at = F.regexp_instr(back, F.lit(r"[.!?\n]"))
    return F.when((pos > 0) & (at > 0), F.length(back) - at + 2).otherwise(0)


def snap_right(text: Column, pos: Column) -> Column:
    """Position after the first sentence end at or after ``pos``, else the length."""
    at = F.regexp_instr(F.substr(text, pos + 1), F.lit(r"[.!?\n]"))
    return F.when(at > 0, pos + at).otherwise(F.length(text))


def html_escape(c: Column | str) -> Column:
    c = F.replace(_col(c), F.lit("&"), F.lit("&amp;"))
    for mark, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def human_size(n: Column | str) -> Column:
    n = _col(n)
    return (F.when(n < 1024, F.format_string("%d B", n.cast("long")))
            .when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%.1f MB", n / 1048576.0)))


def number_or_dash(c: Column | str, digits: int = 2) -> Column:
    """Fixed decimals; null and zero show as a dash."""
    c = _col(c)
    return F.when(c.isNull() | (c == 0), "—").otherwise(F.format_string(f"%.{digits}f", F.bround(c, digits)))


def score_percent(c: Column | str) -> Column:
    """A score as a whole percentage within 0..100."""
    return F.round(F.least(F.greatest(_col(c), F.lit(0.0)), F.lit(1.0)) * 100).cast("int")


def strategy_label(c: Column | str) -> Column:
    """A JSON list of retrievers as upper-case names joined by +."""
    return F.upper(F.array_join(F.from_json(_col(c), "array<string>"), "+"))


def link_citations(answer: Column | str, count: Column) -> Column:
    """[N] as a link for 1 <= N <= count; other marks stay."""
    answer = _col(answer)
    parts = F.regexp_extract_all(answer, F.lit(r"(\[\d{1,9}\]|[^\[]+|\[)"), F.lit(1))
    number = lambda p: F.try_to_number(F.regexp_extract(p, r"^\[(\d{1,9})\]$", 1), F.lit("999999999")).cast("int")
    return F.array_join(F.transform(parts, lambda p: F.when((number(p) >= 1) & (number(p) <= count), F.concat(F.lit("[["), number(p).cast("string"), F.lit("]](#cite-"), number(p).cast("string"), F.lit(")"))).otherwise(p)), "")
