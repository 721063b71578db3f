"""HTML extraction by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of tags and texts. The streams of all of a host's pages are aligned with the host's wrapper one after
another, element by element; tasks do so with the pages that they have, and their wrappers are aligned with one another: what only one side has becomes optional, children of one kind that come
in another number than before become a repeated group, children whose orders contradict each other become a repeated
group of optional members, ``(a? b?)+``, and texts become slots. Every kind of child stands once in the expression of
its parent, so an alignment only merges two orders of distinct names and costs what its page costs.

What the wrapper finds decides what is read:

* A text that stands in the same slot of at least half of the host's pages (three or more, copies of a page counted
  once) is a constant of the template and not part of any article, but for headings between an article's own blocks:
  they head what follows.
* The article is the part of the wrapper whose slots vary and hold the text: an ``article`` or ``main`` if one does, else
  the innermost element with nearly all of it. Children of one kind that come in a fixed number are told apart by their
  place, so that the second of three plain ``div`` can be the article.

A page that lacks this part (or has another number of such children) is read by a wrapper of its own, beside the
constants of the host's; nothing is capped.

All pages of a host take part in its constants and its wrapper. Texts are counted by Spark as hashes of their slots. Two
pages can only be copies of each other if they share one of their rarest texts, those that hold more than ``OWN_SHARE`` of
the page, so only pages with such a text in common are compared. A wrapper is as large as its host's different structures;
a host with many pages is dealt out over several tasks.

Nulls and ties: null or empty html gives the empty text; pages of a null url share one wrapper; rows that repeat are
read alike; empty tables stay empty; other columns aren't read. Of two parts with as much text the first by name is
the article. Where all texts of an article are constants of the template, they stay. Very long and deeply nested pages
take time in proportion to their length: nothing here recurses.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, spread_join

PAGES_PER_TASK = 2000
#: Wrappers that a task holds before it hands them on, and parts that those of a host are dealt over when they are aligned. Both only steer the cost.
HELD_HOSTS, PARTS_OF_HOST = 1000, 32
#: Sequences of children that an element remembers, and how long they may be.
MET = 50
#: Pages that share a text before it counts as the template's, and the share of the host's pages that they must be.
LEAST_PAGES, LEAST_SHARE = 3, 0.5
#: Two pages with no more than this share of their text to themselves are copies of one.
OWN_SHARE = 0.2
#: A part within another one is the article if it holds this share of its text.
MOST = 0.9

# What is never part of an article, and what parts its blocks.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "textarea")
OUTSIDE = frozenset({"head", "title", "nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "object"})
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent footer header menu nav navbar "
    "navigation newsletter notice notices popup promo promoted related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open one, past inline ones; any block ends a paragraph.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
IN_HEAD = frozenset({"title", "meta", "link", "base"})
#: Elements that are parts of an article and never the whole.
PARTS = INLINE | HEADINGS | {"p", "li", "ul", "ol", "dl", "dt", "dd", "pre", "blockquote", "figure", "figcaption", "th", "caption", "option"}
#: A table may hold the article in one of its cells, but isn't it.
GRID = frozenset({"table", "thead", "tbody", "tr"})
MAIN = ("article", "main")
#: What no name puts outside.
NEVER_OUTSIDE = frozenset({"html", "body", *MAIN})
#: They only frame the page: what they hold stands at the root.
FRAME = frozenset({"html", "body"})

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|iframe|svg|textarea)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
#: Attributes of a tag; names in other attributes' values don't count.
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
NAMING = ("class", "id", "role")
WORD = re.compile(r"[a-zA-Z]+")
TEXT = "T"
OUT = "!"


@lru_cache(maxsize=4096)
def start_tag(name: str, rest: str) -> str:
    """The signature of a start tag: its name, the words of its names, and OUT if a whole one is in OUTSIDE_NAMES."""
    words, names = set(), set()
    for attribute, value in ATTRIBUTE.findall(rest):
        if attribute.lower() in NAMING:
            words |= {w.lower() for w in WORD.findall(value)}
            names |= set(value.strip("\"'").lower().split())
    out = [OUT] if name not in NEVER_OUTSIDE and names & OUTSIDE_NAMES else []
    return "<" + " ".join([name, *sorted(words), *out])


def tag_of(signature: str) -> str:
    return signature[1:].partition(" ")[0]


@lru_cache(maxsize=4096)
def is_outside(signature: str) -> bool:
    return tag_of(signature) in OUTSIDE or signature.endswith(" " + OUT)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(signature, name, text): ``<name words``, ``/name``, or T with its text. What is never shown is left out."""
    for m in TOKEN.finditer(page):
        name = m["name"]
        if name:
            name = name.lower()
            if m["end"]:
                yield "/" + name, name, ""
            else:
                yield start_tag(name, m["rest"] if "=" in m["rest"] else ""), name, ""
        elif m["raw"] is None:
            text = m[0]
            if not text.startswith(("<!", "<?")):
                yield TEXT, "", text


OPENED, CLOSED, SAID, BREAK = range(4)


def events(page: str) -> Iterator[tuple[int, str, str]]:
    """What a page does, with the ends that its start tags imply.

    (OPENED, signature, name), (CLOSED, "", name), (SAID, text, signature of the innermost block), (BREAK, "", "")
    where a block of text ends. ``html`` and ``body`` aren't elements here.
    """
    stack: list[tuple[str, str]] = []  # what is open
    outer: list[int] = []  # the places of what isn't inline
    opened: Counter = Counter()

    def closed(place: int) -> Iterator[tuple[int, str, str]]:
        while len(stack) > place:
            name = stack.pop()[1]
            opened[name] -= 1
            if outer and outer[-1] == len(stack):
                outer.pop()
            yield CLOSED, "", name

    for signature, name, text in tokens(page):
        if not name:
            yield SAID, text, stack[outer[-1]][0] if outer else ""
            continue
        if name not in INLINE:
            yield BREAK, "", ""
        if signature[0] == "/":
            if opened[name] > 0:  # one that ends nothing is ignored
                place = len(stack) - 1
                while stack[place][1] != name:
                    place -= 1
                yield from closed(place)
            continue
        if name in VOID:
            if name in ("br", "img"):
                yield SAID, " ", stack[outer[-1]][0] if outer else ""
            continue
        if stack and name not in IN_HEAD and stack[-1][1] == "head":
            yield from closed(len(stack) - 1)
        if name in FRAME:
            continue
        if name not in INLINE:
            while outer and (stack[outer[-1]][1] == "p" or stack[outer[-1]][1] in CLOSES.get(name, ())):
                yield from closed(outer[-1])
            outer.append(len(stack))
        stack.append((signature, name))
        opened[name] += 1
        yield OPENED, signature, name
    yield BREAK, "", ""
    yield from closed(0)


def block(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def digest(signature: str, text: str) -> int:
    """A text in its slot, as one number."""
    return xxhash.xxh3_64_intdigest(f"{signature}\0{text}".encode("utf-8", "surrogatepass"))


# --- inference --------------------------------------------------------------------------------------------------------


class Node:
    """The expression of an element: a sequence of groups of children's names, each of which it has once.

    A name is a signature, for the second and later ones of a fixed number of them followed by ``/`` and its number, or T.
    """

    __slots__ = ("order", "joined", "again", "optional", "kids", "counts", "many", "seen", "own", "met")

    def __init__(self) -> None:
        self.order: list[str] = []
        self.joined: set[str] = set()  # names in one group with the next one
        self.again: set[str] = set()  # names whose group may repeat
        self.optional: set[str] = set()
        self.kids: dict[str, Node] = {}
        self.counts: dict[str, int] = {}  # children of a kind that comes in a fixed number
        self.many: set[str] = {TEXT}  # kinds that don't
        self.seen = 0
        self.own = 0  # characters of varying text right in this element
        self.met: set[tuple[str, ...]] = set()  # some sequences that it accepts, which need no second look

    def name(self, kind: str, n: int) -> str:
        return kind if n == 1 or kind in self.many else f"{kind}/{n}"

    def align(self, names: list[str], counts: dict[str, int]) -> None:
        """Accept one more sequence of children; ``counts`` has how many of each kind it holds."""
        sequence = tuple(names)
        if sequence in self.met:
            self.seen += 1
            return
        todo: list[tuple[Node, Node]] = []
        for kind, n in counts.items():
            if kind not in self.many and self.counts.setdefault(kind, n) != n:
                self.gather(kind, max(n, self.counts[kind]), todo)
        self.place([k if k == TEXT or (kind := k.partition("/")[0]) not in self.many else kind for k in names])
        self.seen += 1
        settle(todo)
        if len(self.met) < MET and len(sequence) <= MET:
            self.met.add(sequence)

    def place(self, names: list[str]) -> dict[str, int]:
        """Put new names behind those that they follow; orders that contradict each other become one repeated group."""
        known, distinct = set(self.order), dict.fromkeys(names)
        if self.seen:
            self.optional |= distinct.keys() ^ known
        follows, before = {}, ""
        for k in distinct:
            if k not in known:
                follows[before] = k
            before = k
        order = []
        for k in ["", *self.order]:
            inside = k in self.joined
            while k is not None:
                order.append(k)
                k = follows.get(k)
                if k is not None and inside:
                    self.joined.add(k)
                    self.again.add(k)
        self.order = order[1:]
        at = {k: i for i, k in enumerate(self.order)}
        high, spans = -1, []
        for k in names:
            if at[k] <= high:
                spans.append((at[k], high))
            else:
                high = at[k]
        self.group(spans)
        return at

    def group(self, spans: list[tuple[int, int]]) -> None:
        """The names of each span (both ends included) become one repeated group."""
        if spans:
            change = [[0, 0] for _ in range(len(self.order) + 1)]
            for a, b in spans:
                change[a][0] += 1
                change[b + 1][0] -= 1
                change[a][1] += 1
                change[b][1] -= 1
            again = joined = 0
            for k, (x, y) in zip(self.order, change, strict=False):
                again, joined = again + x, joined + y
                if again:
                    self.again.add(k)
                if joined:
                    self.joined.add(k)

    def gather(self, kind: str, n: int, todo: list[tuple[Node, Node]]) -> None:
        """Children of a kind that were told apart by their number become one repeated child."""
        names = {kind, *(f"{kind}/{i}" for i in range(2, n + 1))}
        self.many.add(kind)
        self.counts.pop(kind, None)
        todo += [(self.kids[kind], self.kids.pop(k)) for k in sorted(names - {kind}) if k in self.kids]
        at = [i for i, k in enumerate(self.order) if k in names]
        if at:
            tied = [k in self.joined for k in self.order]
            tied[at[0] : at[-1]] = [True] * (at[-1] - at[0])
            self.again |= set(self.order[at[0] : at[-1] + 1]) if len(at) > 1 else set()
            kept = [i for i, k in enumerate(self.order) if k == kind or k not in names]
            broken = [0]
            for t in tied:
                broken.append(broken[-1] + (not t))
            self.joined = {self.order[a] for a, b in zip(kept, kept[1:], strict=False) if broken[b] == broken[a]}
            self.order = [self.order[i] for i in kept]
            self.again &= set(self.order)
            self.optional &= set(self.order)

    def groups(self) -> list[tuple[list[str], bool]]:
        """The groups in order, and whether each may repeat."""
        out: list[tuple[list[str], bool]] = []
        run: list[str] = []
        for k in self.order:
            run.append(k)
            if k not in self.joined:
                out.append((run, not self.again.isdisjoint(run)))
                run = []
        return out

    def accepts(self, names: list[str], counts: dict[str, int]) -> bool:
        """Whether the expression has this sequence of children."""
        if any(kind not in self.many and self.counts.get(kind) != n for kind, n in counts.items()):
            return False
        where = {k: (g, i, more) for g, (run, more) in enumerate(self.groups()) for i, k in enumerate(run)}
        last = (-1, -1)
        for k in names:
            g, i, more = where.get(k, (-1, -1, False))
            if g < last[0] or (g == last[0] and i <= last[1] and not more):
                return False
            last = (g, i)
        return set(self.order) - self.optional <= set(names)


def settle(todo: list[tuple[Node, Node]]) -> None:
    """For each pair the first expression becomes one that accepts what either does."""
    while todo:
        a, b = todo.pop()
        a.own += b.own
        for x, y in ((a, b), (b, a)):
            for kind in y.many - x.many:
                x.gather(kind, x.counts.get(kind, 1), todo)
        for kind in a.counts.keys() & b.counts.keys():
            if a.counts[kind] != b.counts[kind]:
                for x in (a, b):
                    x.gather(kind, x.counts[kind], todo)
        a.counts |= b.counts
        at = a.place(b.order)
        begin, spans = 0, []
        for run, more in b.groups():
            if more:
                places = [at[k] for k in run]
                spans.append((min(places), max(places)))
            begin += len(run)
        a.group(spans)
        a.optional |= b.optional
        a.seen += b.seen
        for k, kid in b.kids.items():
            if k in a.kids:
                todo.append((a.kids[k], kid))
            else:
                a.kids[k] = kid


def walk(root: Node, page: str, at_close: Callable[[Node, list[str], dict[str, int]], None], grow: bool = True, said: Callable[[list], None] | None = None) -> bool:
    """Follow a page through a wrapper; False at a child that it lacks, unless it may grow."""
    stack: list[tuple[Node, list[str], Counter]] = [(root, [], Counter())]
    parts: list[tuple[Node, str, str, int]] = []
    links = 0
    for event, what, name in events(page):
        node, names, counts = stack[-1]
        if event == SAID:
            if what.strip() and names[-1:] != [TEXT]:
                names.append(TEXT)
            parts.append((node, what, name, links))
        elif event == BREAK:
            if said and parts:
                said(parts)
            parts = []
        elif event == OPENED:
            counts[what] += 1
            key = node.name(what, counts[what])
            names.append(key)
            if key not in node.kids:
                if not grow:
                    return False
                node.kids[key] = Node()
            stack.append((node.kids[key], [], Counter()))
            links += name == "a"
        else:
            at_close(*stack.pop())
            links -= name == "a"
    at_close(*stack[0])
    return True


def infer(pages: list[str], constants: frozenset[int] = frozenset(), root: Node | None = None) -> Node:
    """A wrapper for all the pages (and those of ``root``), aligned one after another; the longest comes first, as most has its parts."""
    root = root or Node()

    def said(parts: list[tuple[Node, str, str, int]]) -> None:
        text = block([t for _, t, _, _ in parts])
        if text and digest(parts[0][2], text) not in constants:
            for node, t, _, links in parts:
                node.own += 0 if links else len(t.strip())

    for page in sorted(pages, key=lambda p: (-len(p), p)):
        walk(root, page, Node.align, said=said)
    return root


def accepts(root: Node, page: str) -> bool:
    ok = True

    def check(node: Node, names: list[str], counts: dict[str, int]) -> None:
        nonlocal ok
        ok = ok and node.accepts(names, counts)

    return walk(root, page, check, grow=False) and ok


def expression(root: Node) -> str:
    """The wrapper as a union-free regular expression over signatures."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.kids.values()
    made: dict[int, str] = {}
    for node in reversed(order):
        out = []
        for run, more in node.groups():
            texts = []
            for k in run:
                inner = "#text" if k == TEXT else f"{k.partition('/')[0]}>{made[id(node.kids[k])]}</{tag_of(k.partition('/')[0])}>"
                maybe = k in node.optional or len(run) > 1
                texts.append(f"({inner}){'?' if maybe and len(run) > 1 else '*' if maybe and more else '?' if maybe else '+' if more else ''}")
            out.append(f"({' '.join(texts)})+" if len(run) > 1 else texts[0])
        made[id(node)] = " ".join(out)
    return made[id(root)]


def texts_of(page: str) -> dict[int, int]:
    """The blocks of a whole page, each in its slot, and their lengths; 0 for links and what is outside by its name."""
    found: dict[int, int] = {}
    parts: list[str] = []
    slot, n, without = "", 0, 0
    stack: list[int] = []
    for event, what, name in events(page):
        if event == SAID:
            slot = slot if parts else name
            parts.append(what)
            n += 0 if without else len(what.strip())
        elif event == BREAK:
            if parts:
                text = block(parts)
                if text:
                    found[digest(slot, text)] = n
                parts, n = [], 0
        elif event == OPENED:
            stack.append(name == "a" or is_outside(what))
            without += stack[-1]
        else:
            without -= stack.pop()
    return found


def constant_texts(pages: list[str]) -> frozenset[int]:
    """The texts of the template: those that pages which differ otherwise share in one slot. ``template_texts`` has them for all hosts."""
    different: list[dict[int, int]] = []
    for page in sorted(set(pages), key=lambda p: (-len(p), p)):
        mine = texts_of(page)
        own = lambda a, b: sum(n for k, n in a.items() if k not in b) <= OWN_SHARE * sum(a.values())
        if mine and not any(own(mine, theirs) and own(theirs, mine) for theirs in different):
            different.append(mine)
    shared = Counter(k for texts in different for k in texts)
    least = max(LEAST_PAGES, LEAST_SHARE * len(different))
    return frozenset(k for k, n in shared.items() if n >= least)


def region(root: Node) -> tuple[list[tuple[str, list[int], int]], list[str]]:
    """Where the article is: the steps (kind, numbers, how many there are) to it, and what stays though its name is OUT.

    Links and what is outside by its name count for nothing. What is outside around the article itself doesn't matter if
    nothing else has as much text.
    """
    rows: list[tuple[Node, str, int]] = [(root, "", -1)]
    for i, (node, _, _) in enumerate(rows):
        rows += [(node.kids[k], k, i) for k in sorted(node.kids)]
    kinds = [k.partition("/")[0] for _, k, _ in rows]
    tags = [tag_of(k) for k in kinds]
    cut = [bool(k) and (is_outside(k) or t == "a") for k, t in zip(kinds, tags, strict=True)]
    held, whole = [n.own for n, _, _ in rows], [n.own for n, _, _ in rows]  # without, and with what is outside within
    for i in range(len(rows) - 1, 0, -1):
        whole[rows[i][2]] += whole[i]
        held[rows[i][2]] += 0 if cut[i] else held[i]
    free = [False] * len(rows)
    children: list[list[int]] = [[] for _ in rows]
    for i, (_, _, parent) in enumerate(rows):
        free[i] = not cut[i] and (parent < 0 or free[parent])
        if parent >= 0:
            children[parent].append(i)
    strict = [h if f else 0 for h, f in zip(held, free, strict=True)]

    def article() -> int:
        least = 0
        for counted in (strict, held):
            for name in MAIN:
                found = [i for i, t in enumerate(tags) if t == name and counted[i] > least]
                if found:
                    return max(found, key=lambda i: (counted[i], -i))
            least = strict[0]
        counted = strict if strict[0] else held
        good = [i for i, t in enumerate(tags) if t not in OUTSIDE and t not in PARTS and t not in GRID]
        at = chosen = max(good, key=lambda i: (counted[i], -i))
        while True:
            inner = [i for i in children[at] if not cut[i]]
            best = max(inner, key=lambda i: (held[i], -i), default=-1)
            if best < 0 or tags[best] in PARTS or held[best] < MOST * held[at] or any(tags[i] in HEADINGS and held[i] for i in inner):
                return chosen
            at = best
            chosen = chosen if tags[at] in GRID else at

    at = article()
    steps = []
    i = at
    while i > 0:
        parent = rows[i][2]
        node, kind = rows[parent][0], kinds[i]
        fixed = node.counts.get(kind, 0) if kind not in node.many else 0
        alike = [j for j in children[parent] if kinds[j] == kind and held[j]] if i == at and tags[at] in MAIN else [i]
        steps.append((kind, sorted(int(rows[j][1].partition("/")[2] or 1) for j in alike) if fixed else [], fixed))
        i = parent
    kept: set[str] = set()
    if held[at] < (1 - MOST) * whole[at]:
        below = [at]
        for i in below:
            below += children[i]
        kept = {kinds[i] for i in below[1:] if is_outside(kinds[i]) and tags[i] not in OUTSIDE and 2 * whole[i] >= whole[at]}
    return steps[::-1], sorted(kept)


def wrapper_of(root: Node, constants: frozenset[int]) -> str:
    """Everything that ``extract`` needs for the pages of a host, as JSON."""
    path, kept = region(root)
    return json.dumps({"path": path, "kept": kept, "constants": sorted(constants)})


def infer_wrapper(pages: list[str]) -> str:
    """``wrapper_of`` some pages."""
    constants = constant_texts(pages)
    return wrapper_of(infer(pages, constants), constants)


def to_json(root: Node) -> str:
    """An expression as a list of its elements, each with the place of its parent."""
    rows: list[tuple[Node, int, str]] = [(root, -1, "")]
    for i, (node, _, _) in enumerate(rows):
        rows += [(kid, i, k) for k, kid in sorted(node.kids.items())]
    return json.dumps([[parent, k, n.order, sorted(n.joined), sorted(n.again), sorted(n.optional), n.counts, sorted(n.many), n.seen, n.own] for n, parent, k in rows])


def from_json(text: str) -> Node:
    nodes: list[Node] = []
    for parent, k, order, joined, again, optional, counts, many, seen, own in json.loads(text):
        n = Node()
        n.order, n.joined, n.again, n.optional, n.counts, n.many, n.seen, n.own = order, set(joined), set(again), set(optional), counts, set(many), seen, own
        if parent >= 0:
            nodes[parent].kids[k] = n
        nodes.append(n)
    return nodes[0]


# --- extraction -------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=256)
def _compiled(wrapper: str) -> tuple[list, frozenset[str], frozenset[int]]:
    w = json.loads(wrapper)
    return w["path"], frozenset(w["kept"]), frozenset(w["constants"])


def extract(page: str | None, wrapper: str | None) -> str:
    """The blocks of the article, one a line."""
    page = page or ""
    constants: frozenset[int] = frozenset()
    if wrapper:
        path, kept, constants = _compiled(wrapper)
        found = read(page, path, kept, constants)
        if found:
            return found
    path, kept = region(infer([page], constants))
    return read(page, path, frozenset(kept), constants) or ""


def read(page: str, path: list, kept: frozenset[str], constants: frozenset[int]) -> str | None:
    """The blocks at the end of ``path``; None if the page has no such part or another number of such children."""
    blocks, parts, slot = [], [], ""
    rank: list[int] = []  # of each block: 2 the article's own, 1 a heading that the template has, 0 another constant
    inside, without = int(not path), 0
    last, wrong = len(path), False
    stack = [[0, 0, 0, 0]]  # steps that are done, children of the next one, whether the article begins, what is outside
    for event, what, name in events(page):
        if event == SAID:
            if inside and not without:
                slot = slot if parts else name
                parts.append(what)
        elif event == BREAK:
            if parts:
                text = block(parts)
                if text:
                    blocks.append(text)
                    rank.append(2 if not constants or digest(slot, text) not in constants else int(tag_of(slot) in HEADINGS))
                parts = []
        elif event == OPENED:
            top, done = stack[-1], -1
            if 0 <= top[0] < last and what == path[top[0]][0]:
                top[1] += 1
                if not path[top[0]][1] or top[1] in path[top[0]][1]:
                    done = top[0] + 1
            begins, out = int(done == last), int(inside > 0 and is_outside(what) and what not in kept)
            inside, without = inside + begins, without + out
            stack.append([done, 0, begins, out])
        else:
            done, n, begins, out = stack.pop()
            inside, without = inside - begins, without - out
            wrong |= 0 <= done < last and n > 0 < path[done][2] != n
    wrong |= 0 < last and stack[0][1] > 0 < path[0][2] != stack[0][1]
    if wrong:
        return None
    own = [i for i, n in enumerate(rank) if n == 2]
    if not own:
        return "\n".join(blocks)
    return "\n".join(b for i, (b, n) in enumerate(zip(blocks, rank, strict=True)) if n == 2 or n == 1 and own[0] < i < own[-1])


# --- Spark ------------------------------------------------------------------------------------------------------------


def with_host(pages: DataFrame, html_col: str, url_col: str, id_col: str) -> DataFrame:
    """(page_id, url, html, host); a url without a host has the host ''."""
    url, html = F.col(f"`{url_col}`"), F.col(f"`{html_col}`")
    host = F.lower(F.coalesce(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    return pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), html.alias("html"), host.alias("host"))


def page_texts(rows: DataFrame) -> DataFrame:
    """(host, page, size, total, keys, ns): the texts of each different page of a host in their slots, as hashes, with their lengths."""
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("size", pa.int64()), ("total", pa.int64()), ("keys", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = texts_of(page)
                if found:
                    keys = sorted(found)
                    ns = [found[k] for k in keys]
                    out.append((host, signed(digest("", page)), len(page), sum(ns), [signed(k) for k in keys], ns))
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    found = rows.where(F.col("html").isNotNull()).select("host", "html").mapInArrow(run, "host string, page long, size long, total long, keys array<long>, ns array<long>")
    return found.groupBy("host", "page").agg(F.any_value(F.struct("size", "total", "keys", "ns")).alias("p")).select("host", "page", "p.*")


def signed(n: int) -> int:
    """A hash as Spark has it."""
    return n - (1 << 64) if n >> 63 else n


def page_copies(pages: DataFrame) -> DataFrame:
    """(host, page) of the pages of which no more than OWN_SHARE differs from one before them, the longest first, both ways.

    A copy shares at least one of the rarest texts that together are more than OWN_SHARE of a page, in one order of a host's
    texts: all texts before the first shared one are its own. Pages are compared that have such a text in common.
    """
    texts = pages.select("host", "page", "size", "total", F.explode(F.arrays_zip("keys", "ns")).alias("t")).select("host", "page", "size", "total", F.col("t.keys").alias("key"), F.col("t.ns").alias("n"))
    counts = texts.groupBy("host", "key").agg(F.count("*").alias("df"), F.max("n").alias("most")).where("df > 1")
    mine = spread_join(texts, materialise(counts, "shared"), ["host", "key"], "df", ["page"])
    # of texts about as rare the longest come first, so that few make up a share of the page
    texts = F.array_sort(F.collect_list(F.struct(F.floor(F.log2("df")).alias("rare"), (-F.col("most")).alias("least"), "key", "df", "n")))
    mine = mine.groupBy("host", "page", "size", "total").agg(F.sum("n").alias("common"), texts.alias("texts")).where((F.col("total") - F.col("common")) <= OWN_SHARE * F.col("total"))
    mine = mine.select("host", "page", "size", "total", "common", "texts.key", "texts.df", "texts.n")
    schema = pa.schema([("host", pa.string()), *[(c, pa.int64()) for c in ("key", "df", "page", "size", "total")], ("keys", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64()))])

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, page, size, total, common, keys, dfs, ns in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                before = total - common  # what no other page has
                for key, df, n in zip(keys, dfs, ns, strict=True):
                    if before > OWN_SHARE * total:
                        break
                    out.append((host, key, df, page, size, total, keys, ns))
                    before += n
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    mine = mine.mapInArrow(rarest, "host string, key long, df long, page long, size long, total long, keys array<long>, ns array<long>")
    nothing = pages.where("total = 0").select("host", "page", "size")  # pages of links alone are alike
    # a large group is compared in parts first, and what these leave together
    part = F.pmod(F.xxhash64("page"), F.ceil(F.col("df") / PAGES_PER_TASK)).cast("int")
    first = materialise(_marked(mine.withColumn("part", part)), "marked")
    rest = _marked(first.where("NOT copy").drop("copy").withColumn("part", F.lit(0)))
    none = nothing.withColumn("i", F.struct(-F.col("size"), "page")).groupBy("host").agg(F.min("i").alias("least"))
    zero = nothing.join(none, "host").where(F.struct(-F.col("size"), "page") != F.col("least"))
    return first.where("copy").select("host", "page").unionByName(rest.where("copy").select("host", "page")).unionByName(zero.select("host", "page")).distinct()


def _marked(groups: DataFrame) -> DataFrame:
    """``groups`` with whether a page is a copy of one before it in its group (host, key, part) that is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept = None, []
        for batch in batches:
            names = ("host", "key", "part", "total", "keys", "ns")
            marks = []
            for host, key, part, total, keys, ns in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
                if at != (host, key, part):
                    at, kept = (host, key, part), []
                mine = dict(zip(keys, ns, strict=True))
                copy = any(
                    total - sum(n for k, n in mine.items() if k in theirs) <= OWN_SHARE * total and other - sum(n for k, n in theirs.items() if k in mine) <= OWN_SHARE * other
                    for other, theirs in kept
                )
                marks.append(copy)
                if not copy:
                    kept.append((total, mine))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.bool_())], names=[*batch.schema.names, "copy"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema)
    ordered = groups.repartition("host", "key", "part").sortWithinPartitions("host", "key", "part", F.desc("size"), "page")
    return ordered.mapInArrow(run, f"{schema}, copy boolean")


def template_texts(pages: DataFrame) -> DataFrame:
    """(host, constants): what ``constant_texts`` gives for all pages of each host, as signed hashes; hosts without any are left out."""
    different = materialise(pages.join(page_copies(pages), ["host", "page"], "left_anti").select("host", "keys"), "different")
    least = different.groupBy("host").agg(F.greatest(F.lit(float(LEAST_PAGES)), LEAST_SHARE * F.count("*")).alias("least"))
    counts = different.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    return counts.join(least, "host").where("n >= least").groupBy("host").agg(F.array_sort(F.collect_list("key")).alias("constants"))


def wrappers(rows: DataFrame) -> DataFrame:
    """(host, n, wrapper): a row for each host, inferred from all its pages."""
    sizes = materialise(rows.groupBy("host").agg(F.count("*").alias("n")), "hosts")
    constants = template_texts(materialise(page_texts(rows), "texts"))
    known = materialise(sizes.join(constants, "host", "left").select("host", "n", F.coalesce("constants", F.array().cast("array<bigint>")).alias("constants")), "constants")
    placed = spread_join(rows.where(F.col("html").isNotNull()), known, ["host"], "n", ["url", "page_id"], PAGES_PER_TASK).select("host", "html", "constants")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots: dict[str, Node] = {}

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(roots, pa.string()), pa.array(map(to_json, roots.values()), pa.string())], names=["host", "root"])
            roots.clear()
            return out

        for batch in batches:
            texts: dict[str, list[str]] = {}
            at: dict[str, int] = {}
            for i, (host, page) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                texts.setdefault(host, []).append(page)
                at.setdefault(host, i)
            for host, pages in texts.items():
                roots[host] = infer(pages, frozenset(k % (1 << 64) for k in batch.column(2)[at[host]].as_py()), roots.get(host))
            if len(roots) > HELD_HOSTS:
                yield made()
        if roots:
            yield made()

    def merged(pdf: pd.DataFrame) -> Node:
        texts = sorted(pdf["root"])
        root = from_json(texts[0])
        for text in texts[1:]:
            settle([(root, from_json(text))])
        return root

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "root": [to_json(merged(pdf))]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        constants = frozenset(int(k) % (1 << 64) for k in pdf["constants"].iloc[0])
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [wrapper_of(merged(pdf), constants)]})

    parts = placed.mapInArrow(fit, "host string, root string").withColumn("part", F.pmod(F.xxhash64("root"), F.lit(PARTS_OF_HOST)))
    parts = parts.groupBy("host", "part").applyInPandas(some, "host string, root string")
    return sizes.join(parts.join(known.drop("n"), "host").groupBy("host").applyInPandas(whole, "host string, wrapper string"), "host", "left")


def extract_main_text(pages: DataFrame, html_col: str = "html", url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""
    rows = with_host(small_batches(pages), html_col, url_col, id_col)
    found = materialise(wrappers(rows), "wrappers")
    placed = spread_join(rows, found, ["host"], "n", ["url", "page_id"], PAGES_PER_TASK)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page, wrapper) for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema=schema)

    return placed.select("page_id", "url", "html", "wrapper").mapInArrow(run, "page_id long, url string, text string, n_chars long")
