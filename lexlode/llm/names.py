"""Variant spellings of the names of persons and organisations, linked by entity.

1. Each distinct string is parsed: case and accents folded, titles dropped, known
   short forms of organisation words and given names brought to one form.
2. The telling tokens of the names (surnames, first words of organisations) are
   joined with themselves within one edit (insertion, deletion, substitution or
   transposition): tokens are sharded by a segment that one edit cannot touch, the
   tokens of a shard form a trie, and a Levenshtein automaton of each probing token
   walks it, leaving a branch once every state is beyond the bound.
3. Names whose tokens are near are compared whole, in any order of their tokens:
   equal or near tokens, nicknames, initials, acronyms.
4. Links that leave no doubt make components; a link by an initial, an acronym or
   an ambiguous nickname counts only if it leads to one component.

A shard with more than ``BLOCK`` stored tokens or probes is split into blocks, and each pair of blocks is a task.
A token that occurs with more than ``PARTNERS`` different others (a common name)
tells little alone: names that meet by it or by a token near it must also share a
companion of it (the same, within one edit, or by a formal name) or its initial,
as every pair that ``compare`` accepts does. ``PARTNERS`` changes the work, not the result.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlode.operators.components import connected_components
from lexlode.session import cut

BLOCK, PARTNERS = 2000, 64

# Titles, organisation words with their short forms, nicknames.
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame phd md dphil msc jr sr the dipl ing mme herr frau don dona".split())
SMALL = frozenset("of and for de la und et y".split())
ORG_WORDS = {
    "research": "res", "res": "res", "institute": "inst", "institut": "inst", "inst": "inst", "foundation": "fdn", "fdn": "fdn", "fnd": "fdn", "found": "fdn",
    "medical": "med", "med": "med", "university": "univ", "univ": "univ", "uni": "univ", "technology": "tech", "technologies": "tech", "tech": "tech", "techn": "tech",
    "public": "public", "pub": "public", "library": "libr", "libr": "libr", "lib": "libr", "association": "assn", "assn": "assn", "assoc": "assn",
    "international": "intl", "intl": "intl", "int": "intl", "bank": "bank", "bk": "bank", "energy": "energy", "company": "co", "co": "co",
    "corporation": "corp", "corp": "corp", "incorporated": "inc", "inc": "inc", "limited": "ltd", "ltd": "ltd", "systems": "systems", "sys": "systems", "software": "software",
    "gmbh": "gmbh", "logistics": "logistics", "brothers": "bros", "bros": "bros", "partners": "partners", "ptnrs": "partners", "data": "data",
    "laboratories": "labs", "laboratory": "labs", "labs": "labs", "lab": "labs", "group": "group", "holding": "holding", "holdings": "holding",
    "society": "soc", "soc": "soc", "council": "council", "college": "college", "agency": "agency", "museum": "museum", "hospital": "hospital",
    "llc": "llc", "plc": "plc", "ag": "ag", "sa": "sa", "gesellschaft": "gmbh", "mbh": "gmbh",
}
NICKNAMES = {
    "alexander": "alex sandy al xander", "abigail": "abby gail", "benjamin": "ben benny benji", "christopher": "chris kit topher", "daniel": "dan danny", "dorothea": "dot dora thea dottie dolly",
    "elizabeth": "liz beth betty eliza lizzie lisa", "frederick": "fred freddy freddie rick", "gabriel": "gabe gab", "henrietta": "hattie hetty etta henri", "imogen": "immy immie gen",
    "isabella": "bella izzy isa belle", "jonathan": "jon jonny nathan", "josephine": "josie jo fifi", "katherine": "kate kathy katie kat kit", "leonard": "len leo lenny",
    "margaret": "peggy maggie meg marge greta", "matthew": "matt matty", "nicholas": "nick nicky nico klaus", "oliver": "ollie noll", "patrick": "pat paddy rick", "penelope": "penny nell",
    "rebecca": "becky becca", "rosalind": "roz rosie ros rosa", "samuel": "sam sammy", "susannah": "sue susie suzy anna", "theodora": "thea dora theo teddy", "thomas": "tom tommy",
    "victoria": "vicky vic tori", "vincent": "vince vin", "wilhelmina": "mina willa minnie billie helma", "xavier": "xav zavi", "yolanda": "yoli landa yola", "zachary": "zach zack zak",
    "william": "bill will billy liam", "robert": "bob rob bobby bert", "richard": "dick rick rich", "james": "jim jimmy jamie", "michael": "mike mick", "edward": "ed ted eddie ned",
    "charles": "charlie chuck", "andrew": "andy drew", "anthony": "tony", "joseph": "joe", "john": "jack johnny", "david": "dave", "stephen": "steve", "philip": "phil", "quentin": "quin",
    "jennifer": "jen jenny", "deborah": "deb debbie", "patricia": "pat patty trish", "barbara": "barb", "catherine": "cathy kate", "eleanor": "nell ellie nora", "ursula": "ursa uschi", "samantha": "sam",
}
_FORMAL: dict[str, frozenset[str]] = {}
for _f, _nicks in NICKNAMES.items():
    for _n in _nicks.split():
        _FORMAL[_n] = _FORMAL.get(_n, frozenset()) | {_f}
GIVEN = frozenset(NICKNAMES) | frozenset(_FORMAL)
_LETTERS = str.maketrans({"ł": "l", "Ł": "l", "ø": "o", "Ø": "o", "ß": "ss", "æ": "ae", "đ": "d", "ı": "i"})
_SPLIT = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold().translate(_LETTERS)) if not unicodedata.combining(c))


def distance1(a: str, b: str) -> int:
    """0 if equal, 1 if one edit apart (a transposition is one edit), else 2."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 2
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return 1 if a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :] else 2
    return 1 if (a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]) else 2


_ORG_BY_LENGTH: dict[int, list[str]] = {}
for _o in ORG_WORDS:
    if len(_o) >= 4:
        _ORG_BY_LENGTH.setdefault(len(_o), []).append(_o)


def org_word(token: str, least: int = 6) -> str | None:
    """One form of an organisation word, typing errors of words from ``least`` letters on included."""
    if token in ORG_WORDS:
        return ORG_WORDS[token]
    if len(token) >= least:
        for n in (len(token) - 1, len(token), len(token) + 1):
            for o in _ORG_BY_LENGTH.get(n, ()) if n >= least else ():
                if distance1(token, o) == 1:
                    return ORG_WORDS[o]
    return None


def parse(name: str) -> dict:
    """Parts of a name: kind (org or person), main tokens, initials, organisation words, acronym."""
    raw = _SPLIT.findall(re.sub(r"(?<=[^\W\d_])['’](?=[^\W\d_])", "", name.replace("&", " and ")))
    tokens = [fold(t) for t in raw]
    keep = [(t, r) for t, r in zip(tokens, raw) if t not in TITLES and t]
    words = [(org_word(t), t, r) for t, r in keep]
    if any(w for w, _, _ in words):  # beside an organisation word, and not in front, a short token may be one with an error
        words = words[:1] + [(w or org_word(t, 4), t, r) for w, t, r in words[1:]]
    main = [(t, r) for w, t, r in words if w is None and t not in SMALL]
    orgs: list[str] = []
    for w, _, _ in words:
        if w and w not in orgs:
            orgs.append(w)
    initials = [t for t, _ in main if len(t) == 1]
    main = [(t, r) for t, r in main if len(t) > 1]
    if orgs and main:
        return {"kind": "org", "main": [t for t, _ in main], "initials": [], "words": sorted(orgs), "acronym": "".join(w[0] for w in orgs)}
    if len(main) > 1 and not initials:
        short = [(t, r) for t, r in main if 2 <= len(t) <= 4 and t not in GIVEN and (r.isupper() or name == name.lower())]
        if len(short) == 1 and short[0] == main[-1]:
            return {"kind": "org", "main": [t for t, _ in main if t != short[0][0]], "initials": [], "words": [], "acronym": short[0][0]}
    names = [t for t, _ in main]
    return {"kind": "person", "main": names, "initials": initials, "words": [], "acronym": ""}


def _given(a: str, b: str) -> int:
    """0 if two given names are one, 1 if they may be (a nickname of several), 2 if not."""
    d = distance1(a, b)
    if d == 0 or d == 1 and min(len(a), len(b)) >= 5:
        return 0
    for x, y in ((a, b), (b, a)):
        formal = _FORMAL.get(x)
        if formal and any(distance1(y, f) <= (len(y) >= 6) for f in formal):
            return 1 if len(formal) > 1 else 0
    fa, fb = _FORMAL.get(a), _FORMAL.get(b)
    return 0 if fa and fb and len(fa) == len(fb) == 1 and fa == fb else 1 if fa and fb and fa & fb else 2


def _assigned(x: list[str], y: list[str], fits, edits: int, near: bool) -> bool:
    """Whether each token of ``x`` can take one of ``y`` that fits, at most ``edits`` of them one edit apart; with ``near`` one within an edit at least."""
    stack = [(0, tuple(sorted(y)), edits, near)]
    seen = set(stack)
    while stack:
        i, left, edits, near = stack.pop()
        if i == len(x):
            if not near:
                return True
            continue
        for t in dict.fromkeys(left):
            if fits(x[i], t):
                d, at = distance1(x[i], t), left.index(t)
                state = (i + 1, left[:at] + left[at + 1 :], edits - (d == 1), near and d == 2)
                if state[2] >= 0 and state not in seen:
                    seen.add(state)
                    stack.append(state)
    return False


def compare(a: dict, b: dict) -> int:
    """0: the same entity, 1: the same if nothing else fits, 2: different."""
    if a["kind"] != b["kind"]:
        return 2
    if a["kind"] == "org":
        if len(a["main"]) != len(b["main"]) or not _assigned(a["main"], b["main"], lambda s, t: distance1(s, t) <= (min(len(s), len(t)) >= 5), 1, False):
            return 2
        if a["words"] and b["words"]:
            return 0 if a["words"] == b["words"] else 2
        return 2 if a["acronym"] != b["acronym"] else 0 if not a["words"] and not b["words"] else 1
    x, y = a["main"], b["main"]
    if len(x) == len(y) >= 2:
        for mark in (0, 1):
            if _assigned(x, y, lambda s, t: (0 if distance1(s, t) == 1 and min(len(s), len(t)) >= 5 else _given(s, t)) <= mark, 2, True):
                return mark
        return 2
    few, many = (a, b) if len(x) < len(y) else (b, a)
    if len(few["main"]) == 1 and len(many["main"]) == 1:
        near = distance1(x[0], y[0]) <= (len(x[0]) >= 6)
        return 0 if near and few["initials"] and few["initials"][:1] == many["initials"][:1] else 2
    if len(few["main"]) == 1 and few["initials"] and len(many["main"]) == 2:
        for s, g in (many["main"], many["main"][::-1]):
            if distance1(few["main"][0], s) <= (len(s) >= 6) and g[0] in few["initials"]:
                return 1
    return 2


# ---- trie join --------------------------------------------------------------

def segments(n: int) -> list[tuple[int, int]]:
    """(start, length) of three segments of a token of n characters: one edit leaves one of them whole."""
    base, extra = divmod(n, 3)
    sizes = [base + (i >= 3 - extra) for i in range(3)]
    return [(sum(sizes[:i]), sizes[i]) for i in range(3)]


def shard_keys(token: str) -> tuple[list[str], list[str]]:
    """Keys under which a token is stored, and keys it probes for tokens as long or one shorter."""
    n = len(token)
    stored = [f"{n}:{i}:{token[s : s + k]}" for i, (s, k) in enumerate(segments(n))]
    probed = list(stored)
    if n > 1:
        for i, (s, k) in enumerate(segments(n - 1)):
            probed += [f"{n - 1}:{i}:{token[s + d : s + d + k]}" for d in (0, 1)]
    return stored, sorted(set(probed))


def build_trie(tokens: list[str]) -> dict:
    root: dict = {}
    for t in tokens:
        node = root
        for c in t:
            node = node.setdefault(c, {})
        node[""] = t
    return root


def within(trie: dict, token: str, bound: int = 1) -> list[str]:
    """Tokens of a trie within ``bound`` edits of ``token``, by walking it with the token's Levenshtein automaton.

    A state is (characters of the token used, edits, whether a transposition is
    half done). A branch is left when no state remains; few ever do at a time.
    """
    found: list[str] = []
    n = len(token)
    stack = [(trie, frozenset({(0, 0, False)}))]
    while stack:
        node, states = stack.pop()
        if "" in node and any(not half and n - i + e <= bound for i, e, half in states):
            found.append(node[""])
        for c, kid in node.items():
            if c:
                nxt = set()
                for i, e, half in states:
                    if half:
                        if token[i] == c:
                            nxt.add((i + 2, e, False))
                        continue
                    if i < n and token[i] == c:
                        nxt.add((i + 1, e, False))
                    if e < bound:
                        nxt.add((i, e + 1, False))
                        if i < n:
                            nxt.add((i + 1, e + 1, False))
                        for k in range(1, bound - e + 1):
                            if i + k < n and token[i + k] == c:
                                nxt.add((i + k + 1, e + k, False))
                        if i + 1 < n and token[i + 1] == c:
                            nxt.add((i, e + 1, True))
                if nxt:
                    stack.append((kid, frozenset(nxt)))
    return found


def _shards(batches):
    for b in batches:
        key, side, token = [], [], []
        for t in b.column(0).to_pylist():
            stored, probed = shard_keys(t)
            key += stored + probed
            side += [0] * len(stored) + [1] * len(probed)
            token += [t] * (len(stored) + len(probed))
        yield pa.RecordBatch.from_pydict({"key": key, "side": side, "token": token}, schema=pa.schema([("key", pa.string()), ("side", pa.int32()), ("token", pa.string())]))


def _walk(batches):
    """Near pairs of sorted shards: stored tokens come first and make the trie, then the probes."""
    now, stored, trie = None, [], None
    for b in batches:
        out: list[tuple[str, str]] = []
        for key, block, side, token in zip(*(c.to_pylist() for c in b.columns)):
            if (key, block) != now:
                now, stored, trie = (key, block), [], None
            if side == 0:
                stored.append(token)
            elif stored:
                trie = trie or build_trie(stored)
                out += [(t, token) for t in within(trie, token) if len(t) < len(token) or t < token]
        yield pa.RecordBatch.from_pydict({"x": [a for a, _ in out], "y": [c for _, c in out]}, schema=pa.schema([("x", pa.string()), ("y", pa.string())]))


def near_tokens(tokens: DataFrame, col: str = "token") -> DataFrame:
    """Pairs x, y of different distinct tokens at most one edit apart, each once (shorter or lesser first)."""
    shards = tokens.select(col).where(F.length(col) >= 3).distinct().mapInArrow(_shards, "key string, side int, token string")
    count = lambda side: F.ceil(F.sum((F.col("side") == side).cast("int")) / BLOCK).cast("int")
    sizes = shards.groupBy("key").agg(count(0).alias("nb"), count(1).alias("mb")).where("nb > 0 and mb > 0")
    # stored tokens and probes both are in blocks, and every pair of blocks is a task of its own
    own, others = F.pmod(F.hash("token"), F.when(F.col("side") == 0, F.col("nb")).otherwise(F.col("mb"))), F.when(F.col("side") == 0, F.col("mb")).otherwise(F.col("nb"))
    block = F.when(F.col("side") == 0, F.col("own") * F.col("mb") + F.col("other")).otherwise(F.col("other") * F.col("mb") + F.col("own"))
    placed = shards.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1))).withColumn("block", block)
    return (
        placed.select("key", "block", "side", "token").repartition("key", "block").sortWithinPartitions("key", "block", "side")
        .mapInArrow(_walk, "x string, y string").distinct()
    )


# ---- linking ----------------------------------------------------------------

_PARSED = "name string, kind string, main array<string>, initials array<string>, words array<string>, acronym string"


def _parse(batches):
    for b in batches:
        names = b.column(0).to_pylist()
        got = [parse(n) for n in names]
        yield pa.RecordBatch.from_pydict(
            {"name": names} | {k: [g[k] for g in got] for k in ("kind", "main", "initials", "words", "acronym")},
            schema=pa.schema([("name", pa.string()), ("kind", pa.string()), *((k, pa.list_(pa.string())) for k in ("main", "initials", "words")), ("acronym", pa.string())]))


def companions(token: str, kind: str, main: list[str], initials: list[str], words: list[str], acronym: str) -> list[tuple[int, str, bool]]:
    """Keys (number of tokens, key, whether brief) of which a name shares one with each name it may equal by ``token``.

    Names of as many tokens share a companion of the token or its formal name, give
    or take an edit. Those with number 0 hold for persons of one token with initials
    (brief) and what these may stand for: names alike or of two tokens. Organisations of
    one telling token share their words or their acronym.
    """
    at = main.index(token)
    rest = main[:at] + main[at + 1 :]
    if kind == "org":
        told = [f" {' '.join(words)}"] * bool(words) + [f" {acronym}."] * bool(acronym)
        return [(-len(main), k, False) for k in (sorted(set(rest)) or told)]
    if not rest:
        return [(0, i, True) for i in sorted(set(initials))]
    keys = {k for c in rest for k in (c, *_FORMAL.get(c, ()))}
    return [(len(main), k, False) for k in sorted(keys)] + [(0, c[0], False) for c in rest if len(main) == 2]


def _companions(batches):
    for b in batches:
        rows = [(name, token, *k) for name, token, *parts in zip(*(c.to_pylist() for c in b.columns)) for k in companions(token, *parts)]
        kinds = {"name": pa.string(), "token": pa.string(), "size": pa.int32(), "key": pa.string(), "brief": pa.bool_()}
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def _crowded_pairs(token: DataFrame, common: DataFrame, near: DataFrame) -> DataFrame:
    """Pairs a < b of names that meet by two equal or near tokens, one of them common, and share a companion, its initial, or their other words."""
    both = near.unionByName(near.select(F.col("y").alias("x"), F.col("x").alias("y")))
    by_x, by_y = common.select(F.col("token").alias("x")), common.select(F.col("token").alias("y"))
    links = cut(both.join(by_x, "x", "left_semi").unionByName(both.join(by_y, "y", "left_semi")).unionByName(by_x.withColumn("y", F.col("x"))).distinct(), "names-crowded")
    crowded = token.join(links.select(F.col("x").alias("token")).distinct(), "token", "left_semi")
    rows = cut(crowded.select("name", "token", "kind", "main", "initials", "words", "acronym").distinct().mapInArrow(_companions, "name string, token string, size int, key string, brief boolean"), "names-companions")
    a, b = rows.withColumnsRenamed({"name": "a", "token": "x"}), rows.withColumnsRenamed({"name": "b", "token": "y"})
    # one side takes the near tokens and the other the near companions, so that their numbers add up and do not multiply
    other = both.where("length(x) >= 5 and length(y) >= 5").select(F.col("x").alias("key"), F.col("y").alias("to"))
    full = b.where("size <> 0").select("b", "y", "size", "key")
    full = full.unionByName(full.join(other, "key").select("b", "y", "size", F.col("to").alias("key")))
    long = a.where("size <> 0").join(links.where("x <= y"), "x").select("a", "y", "size", "key").join(full, ["y", "size", "key"])
    brief = a.where("brief").join(links, "x").select("a", "y", "key").join(b.where("size = 0").select("b", "y", "key"), ["y", "key"])
    return long.select("a", "b").unionByName(brief.select("a", "b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _compare(batches):
    for b in batches:
        keep, marks = [], []
        for i, (x, y) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            mark = compare(x, y)
            if mark < 2:
                keep.append(i)
                marks.append(mark)
        left, right = b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([left.field("name"), right.field("name"), pa.array(marks, pa.int32())], names=["a", "b", "mark"])


def entity_names(names: DataFrame, col: str = "name") -> DataFrame:
    """One row per distinct name: name, entity (the least name of its component).

    Null and blank names take no part; repeated rows count once; names of which
    no telling token is left are their own entity; strings of scripts with capital letters that never occur
    with one in any spelling are concepts and are left out. An empty table
    gives an empty result.
    """
    each = names.select(F.col(col).alias("name")).where("name is not null and trim(name) <> ''").distinct()
    parsed = cut(each.mapInArrow(_parse, _PARSED), "names-parsed").where("size(main) > 0")
    rest = F.array_remove(F.col("main"), F.col("token"))
    token = parsed.withColumn("token", F.explode("main"))
    partners = token.groupBy("token").agg(F.countDistinct(F.array_join(F.concat(rest, "initials", "words", F.array("acronym")), " ")).alias("n"))
    common = cut(partners.where(F.col("n") > PARTNERS).select("token", F.lit(True).alias("common")), "names-common")
    marked = token.join(common, "token", "left").withColumn("common", F.coalesce("common", F.lit(False)))
    whole = F.struct("name", "kind", "main", "initials", "words", "acronym")
    anchors = cut(marked.where("not common").select("token", whole.alias("p")).distinct(), "names-anchors")
    formal = names.sparkSession.createDataFrame([(f,) for f in NICKNAMES], "token string")
    near = cut(near_tokens(token.select("token").unionByName(formal)), "names-near")
    same = anchors.select("token").distinct().select(F.col("token").alias("x"), F.col("token").alias("y"))
    links = near.unionByName(same)
    pairs = (
        links.join(anchors.select(F.col("token").alias("x"), F.col("p").alias("p"))  , "x")
        .join(anchors.select(F.col("token").alias("y"), F.col("p").alias("q")), "y").where("x <> y or p.name < q.name")
        .where("p.kind = q.kind").select("p", "q")
    )
    each_whole = parsed.select(whole.alias("p"))
    met = (
        _crowded_pairs(token, common, near).join(each_whole.withColumn("a", F.col("p.name")), "a")
        .join(each_whole.select(F.col("p").alias("q")).withColumn("b", F.col("q.name")), "b").select("p", "q")
    )
    pairs = pairs.unionByName(met)
    edges = cut(pairs.mapInArrow(_compare, "a string, b string, mark int").distinct(), "names-edges")
    sure = edges.where("mark = 0")
    comp = cut(parsed.select("name").join(connected_components(sure).withColumnRenamed("node", "name"), "name", "left")
               .select("name", F.coalesce("component", "name").alias("root")), "names-roots")
    ra, rb = comp.select(F.col("name").alias("a"), F.col("root").alias("ra")), comp.select(F.col("name").alias("b"), F.col("root").alias("rb"))
    weak = edges.where("mark = 1").join(ra, "a").join(rb, "b").where("ra <> rb")
    size = parsed.select("name", (F.size("initials") > 0).alias("brief"), (F.col("acronym") != "").alias("org"), (F.size("words") == 0).alias("bare"))
    brief = size.select("name", (F.col("brief") & ~F.col("org") | F.col("org") & F.col("bare")).alias("brief"))
    ba, bb = brief.select(F.col("name").alias("a"), F.col("brief").alias("brief_a")), brief.select(F.col("name").alias("b"), F.col("brief").alias("brief_b"))
    aimed = weak.join(ba, "a").join(bb, "b").select(
        F.when(F.col("brief_b") & ~F.col("brief_a"), F.col("rb")).otherwise(F.col("ra")).alias("doubtful"),
        F.when(F.col("brief_b") & ~F.col("brief_a"), F.col("ra")).otherwise(F.col("rb")).alias("target"))
    single = aimed.groupBy("doubtful").agg(F.min("target").alias("target"), F.max("target").alias("other")).where("target = other")
    joins = connected_components(single.select(F.col("doubtful").alias("a"), F.col("target").alias("b")))
    final = comp.join(joins.withColumnRenamed("node", "root"), "root", "left").select("name", F.coalesce("component", "root").alias("group"))
    cased = final.groupBy("group").agg(F.min("name").alias("entity"), F.max((F.col("name") != F.lower("name")) | (F.lower("name") == F.upper("name"))).alias("cased")).where("cased")
    return cut(final.join(cased, "group").select("name", "entity"), "names-entities")


def name_pairs(entities: DataFrame) -> DataFrame:
    """All pairs name_a < name_b of different names of one entity."""
    x, y = entities.select("entity", F.col("name").alias("name_a")), entities.select("entity", F.col("name").alias("name_b"))
    return x.join(y, "entity").where("name_a < name_b").select("name_a", "name_b")
