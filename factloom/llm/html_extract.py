"""Main-text extraction with wrappers inferred from same-host pages.

A page is a stream of tag and text tokens, read into blocks; a block's slot is its path of block elements
with their class and id names.  Texts that stand in a slot on most of a host's pages are fixed.  A page's
structure, with runs of equal open slots folded and fixed texts as anchors between them, is aligned with
the structures of the host's other pages: what fails to match becomes an optional group, what repeats a
repeated group, and texts that differ become text slots, so each host ends up with one union-free regular
expression, its wrapper.

Every page is then matched against its host's wrapper, place by place.  What the pages together put into a
place of the wrapper decides about the place: fixed texts are furniture, places that hold links mostly are
menus, and of the rest those inside an article or main element are main text where the wrapper has any,
else all.  Tags, roles and class names that say what they are (nav, footer, ``class="ad"``) are a prior:
such elements never become blocks.
"""

from __future__ import annotations

import functools
import html
import itertools
import json
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sliced

# Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of the left kind ends an open one of the right kinds.
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SCOPE = frozenset("table td th article section main div nav header footer aside form body html ul ol".split())

#: Page furniture by tag, by ARIA role and by words of class and id names.
FURNITURE_TAGS = frozenset("head nav header footer aside form script style noscript template iframe button select option textarea svg menu dialog object embed canvas audio video".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside rail footer header masthead cookie cookies consent gdpr notice notices disclaimer newsletter "
    "subscribe subscription signup login share sharing social related recommended comment comments disqus reply replies respond discussion "
    "popup modal overlay widget toolbar pagination pager".split()
)
MAIN_TAGS = ("article", "main")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
BROKEN_OFF = re.compile(r"<[a-zA-Z/!?]")
SPACE = re.compile(r"\s+")

#: A text is fixed where more than this share of the host's other pages have it too, counted with two more
#: pages that don't; inside an article or main element it takes more to call a text furniture.
FIXED_SHARE, FIXED_SHARE_MAIN = 0.5, 0.9
#: Pages that a fixed text stands on at least; it follows from the share.
FIXED_LEAST = 4
#: A place whose text is links beyond this share is a menu.
LINK_SHARE = 0.5
#: Components of a path that are kept; of deeper ones the middle is named by a digest.
PATH_ENDS = 16
#: Cells of the table that aligns two structures; larger ones are first cut where a longest common subsequence passes, down to pieces.
ALIGN_CELLS = 4_000_000
ALIGN_PIECE = 65_536
#: Structures of a host that one task aligns.
FAN = 64
#: Models of this many hosts and bytes go to every task at once; beyond, pages meet their model in a join.
BROADCAST_HOSTS = 20_000
BROADCAST_BYTES = 32 << 20
#: Different structures that a task counts before it hands them on.
TASK_STRUCTURES = 20_000


def digest(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


@dataclass
class Block:
    """A run of text with one innermost block element; ``linked`` counts its characters inside links."""

    path: tuple[str, ...]
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    @functools.cached_property
    def text(self) -> str:
        return SPACE.sub(" ", html.unescape("".join(self.parts))).strip()

    @property
    def slot(self) -> str:
        return "/".join(self.path)


def _values(attributes: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}


@functools.lru_cache(maxsize=4096)
def _furniture(name: str, attributes: str) -> bool:
    """The prior: whether an element says by its tag, role, style or names that it is no main text."""
    if name in FURNITURE_TAGS:
        return True
    if not attributes:
        return False
    values = _values(attributes)
    if values.get("role", "").lower() in FURNITURE_ROLES or values.get("aria-hidden") == "true":
        return True
    if re.search(r"(?:^|\s)hidden(?:\s|$)", ATTRIBUTE.sub(" ", attributes)) or "display:none" in values.get("style", "").replace(" ", ""):
        return True
    named = re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", values.get("class", "") + " " + values.get("id", "")).lower())
    return name not in MAIN_TAGS and name not in ("html", "body") and not FURNITURE_WORDS.isdisjoint(named)


@functools.lru_cache(maxsize=4096)
def _label(name: str, attributes: str) -> str:
    """An element in a path: its tag with its class and id names, digits left open."""
    if not attributes:
        return name
    values = _values(attributes)
    names = sorted({re.sub(r"\d+", "#", w) for w in (values.get("class", "") + " " + values.get("id", "")).split()})
    label = ".".join([name, *names]).replace("/", "|")
    return label if len(label) <= 64 else f"{name}.{digest(label) & 0xFFFFFFFF:x}"


def _below(path: tuple[str, ...], label: str) -> tuple[str, ...]:
    """A path one element deeper; beyond twice ``PATH_ENDS`` its middle is folded into a digest, so its length is bounded."""
    if len(path) < 2 * PATH_ENDS:
        return (*path, label)
    middle = path[PATH_ENDS : PATH_ENDS + 2]
    return (*path[:PATH_ENDS], f"~{digest('/'.join(middle)) & 0xFFFFFFFF:x}", *path[PATH_ENDS + 2 :], label)


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order, without those in furniture; each knows its path of block elements."""
    found: list[Block] = []
    # open elements: name, hidden below here, inside a link, path
    stack: list[tuple[str, bool, bool, tuple[str, ...]]] = [("", False, False, ())]
    opened: Counter[str] = Counter()
    current: Block | None = None
    at = 0
    size = len(page)
    last = page.rfind(">") + 1  # no tag ends behind it

    def put(text: str) -> None:
        nonlocal current
        _, hidden, linked, path = stack[-1]
        if hidden:
            return
        if current is None:
            current = Block(path)
            found.append(current)
        current.parts.append(text)
        if linked:
            current.linked += len(text)

    def cut(depth: int) -> None:
        for name, *_ in stack[depth:]:
            opened[name] -= 1
        del stack[depth:]

    while at < size:
        match = TOKEN.search(page, at, last) if at < last else None
        if match is None:
            broken = BROKEN_OFF.search(page, max(at, last))  # a tag the page breaks off in
            put(page[at : broken.start()] if broken else page[at:])
            break
        if match.start() > at:
            put(page[at : match.start()])
        at = match.end()
        close, name, attributes = match.group(1), match.group(2), match.group(3)
        if name is None:
            whole = match.group()
            if whole.startswith("<![CDATA["):
                put(html.escape(whole[9:].removesuffix("]]>")))
            elif whole.startswith("<!--") and not whole.endswith("-->"):
                break  # a comment that never ends
            continue
        name = name.lower()
        if close:
            if not opened[name]:
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    if name in BLOCK or any(e[0] in BLOCK for e in stack[depth:]):
                        current = None
                    cut(depth)
                    break
                if stack[depth][0] in SCOPE and name not in SCOPE:
                    break
            continue
        if name == "br":
            put(" ")
            continue
        if name in BLOCK:
            current = None
            ends = CLOSES.get(name, frozenset()) | (frozenset(["p"]) if name in ENDS_P else frozenset())
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in ends:
                    cut(depth)
                    break
                if stack[depth][0] in SCOPE:
                    break
        if name in VOID or (attributes.endswith("/") and name not in BLOCK):
            continue
        _, hidden, linked, path = stack[-1]
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        hidden = hidden or _furniture(name, attributes)
        opened[name] += 1
        stack.append((name, hidden, linked or name == "a", _below(path, _label(name, attributes)) if name in BLOCK and not hidden else path))
    return [b for b in found if b.text]


# ---- wrappers: union-free regular expressions over blocks


@dataclass(frozen=True)
class Node:
    """A place of a wrapper: its slot, whether it may be missing or repeat, and its text where that is fixed.

    An anchor is matched by its text too.
    """

    path: str
    optional: bool = False
    repeated: bool = False
    text: int | str | None = None
    anchor: bool = False

    @property
    def id(self) -> str:
        return f"{self.path}#{self.text}" if self.anchor else self.path


Wrapper = tuple[Node, ...]
Fixed = frozenset[tuple[str, int]]


def tape(found: list[Block]) -> tuple[list[str], list[int], list[int], list[int]]:
    """Slots, digests of texts, characters and linked characters of blocks."""
    return [b.slot for b in found], [digest(b.text) for b in found], [len(b.text) for b in found], [min(b.linked, len(b.text)) for b in found]


def structure(slots: list[str], texts: list[int], fixed: Fixed | None = None) -> Wrapper:
    """A page's own wrapper: fixed texts as anchors, all others open; where none are known, every text as it is."""
    if fixed is None:
        return _folded([Node(p, text=t) for p, t in zip(slots, texts, strict=True)])
    known = [(p, t, (p, t) in fixed) for p, t in zip(slots, texts, strict=True)]
    return _folded([Node(p, text=t if f else None, anchor=f) for p, t, f in known])


def _folded(nodes: list[Node]) -> Wrapper:
    """Fold neighbours of one path, and neighbouring equal pairs, into repeated slots until nothing repeats."""
    out: list[Node] = []
    for node in nodes:
        if out and out[-1].path == node.path and not (node.anchor or out[-1].anchor):
            out[-1] = Node(node.path, out[-1].optional and node.optional, True)
            continue
        out.append(node)
        while len(out) >= 4 and out[-1].path == out[-3].path and out[-2].path == out[-4].path and not any(n.anchor for n in out[-4:]):
            last, first = out.pop(), out.pop()
            out[-1] = Node(last.path, out[-1].optional and last.optional, True)
            out[-2] = Node(first.path, out[-2].optional and first.optional, True)
    return tuple(out)


def _common(one: list[str], two: list[str]) -> list[int]:
    """Lengths of the longest common subsequences of ``one`` and each prefix of ``two``, bit-parallel."""
    masks: dict[str, int] = {}
    for j, path in enumerate(two):
        masks[path] = masks.get(path, 0) | 1 << j
    full = (1 << len(two)) - 1
    row = full
    for path in one:
        met = row & masks.get(path, 0)
        row = ((row + met) | (row - met)) & full
    return [0, *itertools.accumulate(int(bit == "0") for bit in reversed(f"{row:0{len(two)}b}"))] if two else [0]


def _matches(one: list[str], two: list[str], cells: int) -> list[tuple[int, int]]:
    """Pairs of places along a longest common subsequence; beyond ``cells`` in linear space (Hirschberg)."""
    rows, columns = len(one), len(two)
    if rows > 1 and columns > 1 and rows * columns > cells:
        half = rows // 2
        before, after = _common(one[:half], two), _common(one[half:][::-1], two[::-1])
        cut = max(range(columns + 1), key=lambda j: before[j] + after[columns - j])
        rest = _matches(one[half:], two[cut:], ALIGN_PIECE)
        return _matches(one[:half], two[:cut], ALIGN_PIECE) + [(i + half, j + cut) for i, j in rest]
    best = [[0] * (columns + 1) for _ in range(rows + 1)]
    for i in range(rows - 1, -1, -1):
        for j in range(columns - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if one[i] == two[j] else max(best[i + 1][j], best[i][j + 1])
    found = []
    i = j = 0
    while i < rows and j < columns:
        if one[i] == two[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return found


def align(one: Wrapper, two: Wrapper) -> Wrapper:
    """A common wrapper along a longest common subsequence of slots: texts that differ become open slots, the rest optional."""
    if one == two:
        return one
    out: list[Node] = []
    i = j = 0
    for m, n in [*_matches([n.id for n in one], [n.id for n in two], ALIGN_CELLS), (len(one), len(two))]:
        out += [Node(x.path, True, x.repeated, x.text, x.anchor) for x in (*one[i:m], *two[j:n])]
        if m < len(one):
            a, b = one[m], two[n]
            out.append(Node(a.path, a.optional or b.optional, a.repeated or b.repeated, a.text if a.text == b.text else None, a.anchor))
        i, j = m + 1, n + 1
    return _folded(out)


def merged(structures: list[tuple[int, Wrapper]]) -> Wrapper:
    """One wrapper of many, the most frequent first, ties by their text; the same set always gives the same."""
    ordered = sorted(structures, key=lambda x: (-x[0], dumped(x[1])))
    return functools.reduce(align, [w for _, w in ordered])


def dumped(wrapper: Wrapper) -> str:
    return json.dumps([[n.path, n.optional, n.repeated, n.text, n.anchor] for n in wrapper])


def loaded(text: str) -> Wrapper:
    return tuple(Node(*n) for n in json.loads(text))


def expression(wrapper: Wrapper) -> str:
    """The wrapper as one regular expression over slots; anchors stand in quotes."""
    marks = {(0, 0): "", (1, 0): "?", (0, 1): "+", (1, 1): "*"}
    return " ".join(n.path + (f'"{n.text}"' if n.anchor else "") + marks[n.optional, n.repeated] for n in wrapper)


def is_main(slot: str) -> bool:
    return any(label.split(".", 1)[0] in MAIN_TAGS for label in slot.split("/"))


class Matcher:
    """Reads pages by a wrapper: every block goes to the next place that takes it."""

    def __init__(self, wrapper: Wrapper) -> None:
        self.wrapper = wrapper
        self.fixed: Fixed = frozenset((n.path, n.text) for n in wrapper if n.anchor)
        self.places: dict[str, list[int]] = {}
        for at, node in enumerate(wrapper):
            self.places.setdefault(node.id, []).append(at)

    def match(self, slots: list[str], texts: list[int]) -> list[int | None]:
        """The place of each block; None for a block that the wrapper has no place for from there on.

        A block stays in the place of the one before where that repeats and has its slot; else it takes the
        first place further on, which never leaves out one that a page of the wrapper needs.
        """
        out: list[int | None] = []
        at = -1
        for slot, text in zip(slots, texts, strict=True):
            name = f"{slot}#{text}" if (slot, text) in self.fixed else slot
            known = self.places.get(name, ())
            if at >= 0 and self.wrapper[at].repeated and self.wrapper[at].id == name:
                out.append(at)
                continue
            # A repeated pair of slots alternates, so a block may also step back to the other one of the pair.
            if at > 0 and self.wrapper[at].repeated and self.wrapper[at - 1].repeated and self.wrapper[at - 1].id == name:
                at -= 1
                out.append(at)
                continue
            nth = bisect_left(known, at + 1)
            if nth == len(known):
                out.append(None)
                continue
            at = known[nth]
            out.append(at)
        return out


def furniture_free(wrapper: Wrapper, chars: dict[int, int], links: dict[int, int]) -> list[bool]:
    """Which places may hold main text: open ones whose text, over all pages, isn't links mostly."""
    return [not n.anchor and (is_main(n.path) or links.get(k, 0) <= LINK_SHARE * chars.get(k, 0)) for k, n in enumerate(wrapper)]


def chosen(places: list[int | None], slots: list[str], open_places: list[bool]) -> list[bool]:
    """Which blocks of a page are its main text.

    Those in open places inside an article or main element; without any, those in all open places and
    those the wrapper has no place for; without any, nothing.
    """
    inside = [k is None or open_places[k] for k in places]
    main = [ok and is_main(slot) for ok, slot in zip(inside, slots, strict=True)]
    return main if any(main) else inside


def fixed_texts(counts: dict[tuple[str, int], int], pages: int) -> Fixed:
    """The texts of a host that are fixed, from the number of its different pages that have them."""
    return frozenset(k for k, n in counts.items() if n >= FIXED_LEAST and (n - 1) / (pages + 1) > (FIXED_SHARE_MAIN if is_main(k[0]) else FIXED_SHARE))


class Reader:
    """A host's model: its wrapper and the places that may hold main text."""

    def __init__(self, wrapper: Wrapper, open_places: list[bool]) -> None:
        self.matcher = Matcher(wrapper)
        self.open_places = open_places

    def read(self, page: str) -> str:
        found = blocks(page)
        slots, texts = [b.slot for b in found], [digest(b.text) for b in found]
        keep = chosen(self.matcher.match(slots, texts), slots, self.open_places)
        return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def infer(pages: list[str]) -> Reader:
    """The model of one host's pages, in one process: what the Spark operator does for every host."""
    tapes = [tape(blocks(p)) for p in dict.fromkeys(pages)]
    counts = Counter(k for slots, texts, *_ in tapes for k in set(zip(slots, texts, strict=True)))
    fixed = fixed_texts(counts, len(tapes))
    made = Counter(structure(slots, texts, fixed) for slots, texts, *_ in tapes)
    wrapper = merged([(n, w) for w, n in made.items()]) if made else ()
    chars, links = place_sizes(Matcher(wrapper), tapes)
    return Reader(wrapper, furniture_free(wrapper, chars, links))


def place_sizes(matcher: Matcher, tapes) -> tuple[Counter, Counter]:
    """Characters and linked characters that pages put into each place."""
    chars, links = Counter(), Counter()
    for slots, texts, sizes, linked in tapes:
        for place, n, m in zip(matcher.match(slots, texts), sizes, linked, strict=True):
            if place is not None:
                chars[place] += n
                links[place] += m
    return chars, links


# ---- the Spark operator


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


TAPE = "host string, page bigint, slots array<string>, texts array<bigint>, chars array<int>, links array<int>"


def page_tapes(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """The tape of every different page of each host; null urls share the empty host."""

    def run(batches):
        for batch in sliced(batches):
            made = [tape(blocks(p or "")) for p in batch.column(2).to_pylist()]
            kinds = (pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            columns = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["host", "page", "slots", "texts", "chars", "links"])

    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.xxhash64(html_col).alias("page"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, TAPE).dropDuplicates(["host", "page"])


def host_fixed(tapes: DataFrame) -> DataFrame:
    """``host, fixed``: the fixed texts of each host, which are twice as many as a page has blocks at most."""
    sizes = tapes.groupBy("host").agg(F.count("*").alias("pages"))
    seen = tapes.select("host", F.explode(F.array_distinct(F.arrays_zip("slots", "texts"))).alias("x"))
    counted = seen.groupBy("host", "x").agg(F.count("*").alias("n")).where(F.col("n") >= FIXED_LEAST)
    # The larger share, which slots inside an article or main element need, is looked at when the texts are used.
    share = (F.col("n") - 1) / (F.col("pages") + 1)
    found = counted.join(sizes, "host").where(share > FIXED_SHARE).select("host", F.struct("x.slots", "x.texts", share.alias("share")).alias("x"))
    return found.groupBy("host").agg(F.sort_array(F.collect_list("x")).alias("fixed"))


def _fixed_set(rows) -> Fixed:
    return frozenset((r["slots"], r["texts"]) for r in rows or () if not is_main(r["slots"]) or r["share"] > FIXED_SHARE_MAIN)


class Attached:
    """Rows with a column of their host's table: held by every task where that is small, else joined."""

    def __init__(self, rows: DataFrame, table: DataFrame, column: str) -> None:
        size = table.agg(F.count("*").alias("hosts"), F.coalesce(F.sum(F.length(F.to_json(F.struct(column))) + F.length("host")), F.lit(0)).alias("bytes")).first()
        self.held = None
        if size.hosts <= BROADCAST_HOSTS and size.bytes <= BROADCAST_BYTES:
            held = {r.host: r[column] for r in table.select("host", column).toLocalIterator()}
            self.held = rows.sparkSession.sparkContext.broadcast(held)
            self.rows = rows
        else:
            self.rows = rows.join(table.select("host", F.col(column).alias("_attached")), "host", "left").select(*rows.columns, "_attached")

    def values(self):
        """A function that gives a batch's values; batches have the host first."""
        held = self.held
        if held is not None:
            return lambda batch: [held.value.get(h) for h in batch.column(0).to_pylist()]
        return lambda batch: batch.column(batch.num_columns - 1).to_pylist()


def infer_wrappers(tapes: DataFrame) -> DataFrame:
    """``host, wrapper`` (JSON) from the different pages of each host.

    Equal structures are counted first; a host's different ones are dealt by their hash to tasks of about
    ``FAN`` that align them to one each, until the host has one.
    """
    spark = tapes.sparkSession
    attached = Attached(tapes.select("host", "slots", "texts"), materialize(host_fixed(tapes), "fixed"), "fixed")
    values = attached.values()

    def own(batches):
        sets = {}
        held: Counter = Counter()

        def out():
            names, made, counts = zip(*[(h, w, n) for (h, w), n in held.items()], strict=True) if held else ((), (), ())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(made, pa.string()), pa.array(counts, pa.int64())], names=["host", "wrapper", "pages"])

        for batch in sliced(batches):
            columns = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), values(batch)
            for host, slots, texts, fixed in zip(*columns, strict=True):
                if host not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[host] = _fixed_set(fixed)
                held[host, dumped(structure(slots, texts, sets[host]))] += 1
            if len(held) > TASK_STRUCTURES:
                yield out()
        yield out()

    def joined(key, table):
        made = merged([(n, loaded(w)) for n, w in zip(table["pages"].to_pylist(), table["wrapper"].to_pylist(), strict=True)])
        return pa.table({"host": pa.array([key[0].as_py()]), "wrapper": [dumped(made)], "pages": pa.array([sum(table["pages"].to_pylist())], pa.int64())})

    schema = "host string, wrapper string, pages bigint"
    found = attached.rows.mapInArrow(own, schema).groupBy("host", "wrapper").agg(F.sum("pages").alias("pages"))
    found = materialize(found, "structures")
    while True:
        sizes = materialize(found.groupBy("host").agg(F.count("*").alias("n")).where("n > 1"), "structure-counts")
        if sizes.isEmpty():
            return found.select("host", "wrapper")
        several = found.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / FAN)))
        aligned = several.select("host", "part", "wrapper", "pages").groupBy("host", "part").applyInArrow(joined, schema)
        found = materialize(aligned.unionByName(found.join(sizes, "host", "left_anti").select("host", "wrapper", "pages")), "structures")


def host_models(tapes: DataFrame) -> DataFrame:
    """``host, model``: the wrapper and its open places (JSON)."""
    wrappers = materialize(infer_wrappers(tapes), "wrappers")
    attached = Attached(tapes.select("host", "slots", "texts", "chars", "links"), wrappers, "wrapper")
    values = attached.values()

    def sizes(batches):
        matchers: dict[str, Matcher] = {}
        held: dict[str, tuple[Counter, Counter]] = {}

        def out():
            rows = [(h, k, n, links[k]) for h, (chars, links) in held.items() for k, n in chars.items()]
            held.clear()
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "place", "chars", "links"])

        for batch in sliced(batches):
            columns = [batch.column(n).to_pylist() for n in range(5)]
            for (host, *own), wrapper in zip(zip(*columns, strict=True), values(batch), strict=True):
                if host not in matchers:
                    if len(matchers) > 1000:
                        matchers.clear()
                    matchers[host] = Matcher(loaded(wrapper))
                chars, links = held.setdefault(host, (Counter(), Counter()))
                more = place_sizes(matchers[host], [own])
                chars.update(more[0])
                links.update(more[1])
            if len(held) > 1000:
                yield out()
        yield out()

    found = attached.rows.mapInArrow(sizes, "host string, place int, chars bigint, links bigint")
    summed = found.groupBy("host", "place").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    menus = summed.where(F.col("links") > LINK_SHARE * F.col("chars")).groupBy("host").agg(F.sort_array(F.collect_list("place")).alias("menus"))
    return wrappers.join(menus, "host", "left").select("host", F.to_json(F.struct("wrapper", "menus")).alias("model"))


@functools.lru_cache(maxsize=512)
def reader(model: str | None) -> Reader:
    if model is None:
        return Reader((), [])
    made = json.loads(model)
    wrapper = loaded(made["wrapper"])
    menus = set(made.get("menus") or ())
    return Reader(wrapper, furniture_free(wrapper, dict.fromkeys(range(len(wrapper)), 1), dict.fromkeys(menus, 1)))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text`` of every page: its main text, blocks joined by a line feed, empty if there is none.

    Null and empty html gives the empty text; repeated rows give repeated results, and copies of a page count
    once when wrappers are inferred; a host of one page has no fixed text; a host may hold any share of all
    pages, as only counts and different structures meet; a page that breaks off inside an element is read as
    far as it goes; very long and very deep pages are read whole, in time and memory in proportion to their
    length; of equally frequent structures the smaller text goes first; an empty table gives an empty table;
    other columns are left out.
    """
    tapes = materialize(page_tapes(pages, url_col, html_col), "tapes")
    rows = pages.select(
        host_of(F.col(url_col)).alias("host"), F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("page")
    )
    attached = Attached(rows, materialize(host_models(tapes), "models"), "model")
    values = attached.values()

    def run(batches):
        for batch in sliced(batches):
            made = [reader(m).read(p or "") for p, m in zip(batch.column(3).to_pylist(), values(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(made, pa.string())], names=["id", "url", "text"])

    return attached.rows.mapInArrow(run, "id bigint, url string, text string")
