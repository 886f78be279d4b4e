"""Web pages as flat trees of blocks: reading markup, folding like siblings, and simple tree matching in linear space.

Nothing here recurses, so that pages of any depth can be read.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from dataclasses import dataclass

# Element and attribute names of the HTML standard and common conventions.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title iframe xmp noembed noframes svg math object select".split())
#: Those of RAW that hold plain text up to their own end tag, whatever looks like markup in it.
PLAIN = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
#: Elements that every page has, written or not, and elements without text or place: they make no node.
NO_NODE = frozenset("html head body base link meta param source track col area".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog button fieldset".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BOILERPLATE_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising promo promotion sponsor sponsored banner notice notices cookie cookies consent gdpr alert popup modal overlay comment comments "
    "disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination pager toolbar widget hidden".split()
)
#: An opening of these ends an open element of its kind, up to the elements named.
ENDS_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table tbody thead tfoot", "td": "tr table", "th": "tr table", "option": "select datalist"}
#: Containers that may hold a page's main part, and elements whose running text belongs to the part that holds them.
SECTIONS = frozenset("main article section div center table tbody thead tr td form aside header footer nav details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FLOW = HEADINGS | frozenset("p pre blockquote ul ol dl figure".split())
#: Elements without a meaning of their own: siblings among them are told apart by what they hold.
BARE = frozenset("div section center td".split())

#: Markup as the HTML standard's tokenizer reads it: a quote opens a value only right after the equals sign, a value whose quote
#: never closes runs to the end, and a tag that the end cuts short is no tag and no text.
ATTRIBUTE = r"[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)?+"
TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{ATTRIBUTE})*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)", re.S)
NAMED = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"'][^\s>]*+))?+)?+")
PART = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Page:
    """Nodes in page order, the root first: tag, name (tag and the words of class, id and role), parent, whether lists of names call it boilerplate. texts: (node, text, characters outside links) of each block of text."""

    tags: list[str]
    names: list[str]
    parents: list[int]
    marked: list[bool]
    texts: list[tuple[int, str, int]]


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in NAMED.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def is_boilerplate(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether the lists of names call an element a menu, header, footer, sidebar, notice, advert, form or reader comment."""
    if tag in BOILERPLATE_TAGS:
        return not (tag == "header" and in_article)
    if not attrs:
        return False
    if attrs.get("role", "").lower() in BOILERPLATE_ROLES or attrs.get("aria-hidden") == "true" or "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", ""):
        return True
    found = set(PART.findall((attrs.get("class", "") + " " + attrs.get("id", "")).lower())) & BOILERPLATE_WORDS
    return bool(found - {"header"} if in_article or tag == "main" else found)


def clean(parts: list[str]) -> str:
    return " ".join("".join([html.unescape(x) if "&" in x else x for x in parts]).split())


def _end_of_raw(source: str, tag: str, at: int) -> int:
    """Where the raw element that opens before at ends; one of its kind inside it ends first. The end of the source if it's never closed."""
    if tag in PLAIN:
        end = PLAIN[tag].search(source, at)
        return end.end() if end else len(source)
    depth = 1
    while m := TAG.search(source, at):
        at, name = m.end(), (m[2] or "").lower()
        if m[1] and name == tag:
            depth -= 1
            if not depth:
                return at
        elif name and not m[1] and not m[3].endswith("/"):
            if name == tag:
                depth += 1
            elif name in PLAIN:
                at = _end_of_raw(source, name, at)
    return len(source)


def parse(source: str, lists: bool = True) -> Page:
    """The blocks of a page. Inline elements are part of their block's text; raw elements and comments vanish, and with lists inline elements that are boilerplate."""
    page = Page(["#root"], ["#root"], [-1], [False], [])
    stack, opened = [0], {"article": 0}
    held: list[str] = []
    hidden: list[str] = []
    linked = 0  # characters of held in links
    link = 0  # depth of the block in which a link stands open, from 1
    at = 0

    def flush() -> None:
        nonlocal linked
        if held:
            if text := clean(held):
                page.texts.append((stack[-1], text, max(0, len(text) - linked)))
            held.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal link
        for i in stack[to:]:
            opened[page.tags[i]] -= 1
        del stack[to:]
        if link > len(stack):
            link = 0

    while True:
        m = TAG.search(source, at)
        start = m.start() if m else len(source)
        if start > at and not hidden:
            held.append(source[at:start])
            if link:
                linked += start - at
        if not m:
            break
        at = m.end()
        if not m[2] or source[at - 1] != ">":  # a comment, or the end cuts the tag short
            continue
        tag, closing, raw = m[2].lower(), bool(m[1]), m[3]
        if tag in RAW:
            if not closing and not (raw.endswith("/") and tag not in PLAIN):
                at = _end_of_raw(source, tag, at)
            continue
        if tag in INLINE:
            if tag == "br":
                if not hidden:
                    held.append(" ")
            elif closing:
                if hidden and tag == hidden[-1]:
                    hidden.pop()
                if tag == "a":
                    link = 0
            else:
                if tag == "a":
                    link = len(stack)
                if hidden:
                    if tag == hidden[0]:
                        hidden.append(tag)
                elif lists and tag not in VOID and "=" in raw and is_boilerplate(tag, attributes(raw), opened["article"] > 0):
                    hidden.append(tag)
            continue
        flush()
        hidden.clear()  # a block ends the inline elements left open
        if tag in NO_NODE:
            continue
        if closing:
            if opened.get(tag):
                i = len(stack) - 1
                while page.tags[stack[i]] != tag:
                    i -= 1
                close(i)
            continue
        if page.tags[stack[-1]] == "p":
            close(len(stack) - 1)
        if tag in ENDS_ITSELF and any(opened.get(t) for t in ENDS_ITSELF[tag]):
            stops = STOPS[tag].split()
            for i in range(len(stack) - 1, 0, -1):
                if page.tags[stack[i]] in stops:
                    break
                if page.tags[stack[i]] in ENDS_ITSELF[tag]:
                    close(i)
                    break
        attrs = attributes(raw) if raw else {}
        name = tag
        if attrs and (words := sorted(set(PART.findall((attrs.get("class", "") + " " + attrs.get("id", "") + " " + attrs.get("role", "")).lower())))):
            name = ".".join([tag, *words])
        page.tags.append(tag)
        page.names.append(name)
        page.parents.append(stack[-1])
        page.marked.append(is_boilerplate(tag, attrs, opened["article"] > 0))
        if tag not in VOID:
            stack.append(len(page.tags) - 1)
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    return page


@dataclass(slots=True)
class Tree:
    """A folded page. Of each node the key among its siblings, its tag, its parent, its kids in order of first appearance and its place among its siblings."""

    keys: list[str]
    tags: list[str]
    parents: list[int]
    kids: list[list[int]]
    places: list[int]

    def dump(self) -> str:
        return json.dumps([self.parents, self.keys], separators=(",", ":"))


def tree(parents: list[int], keys: list[str]) -> Tree:
    kids: list[list[int]] = [[] for _ in keys]
    places = [0] * len(keys)
    for i in range(1, len(keys)):
        places[i] = len(kids[parents[i]])
        kids[parents[i]].append(i)
    return Tree(keys, [k.partition("~")[0].partition(".")[0] for k in keys], parents, kids, places)


def load(dumped: str) -> Tree:
    parents, keys = json.loads(dumped)
    return tree(parents, keys)


def fold(page: Page) -> tuple[Tree, list[int]]:
    """The page with like siblings as one node, so that lists and paragraphs of any number align; and the folded node of each node.

    Siblings are alike if their names are equal; of bare containers, which have no name of their own, those that hold
    the same kinds of blocks.
    """
    holds: dict[int, set[str]] = {}
    for i in range(1, len(page.tags)):
        p = page.parents[i]
        if page.names[p] in BARE:
            holds.setdefault(p, set()).add(page.names[i])
    of, parents, keys = [0], [-1], ["#root"]
    known: dict[tuple[int, str], int] = {}
    for i in range(1, len(page.tags)):
        name, up = page.names[i], of[page.parents[i]]
        key = f"{name}~{zlib.crc32('|'.join(sorted(holds[i])).encode()):x}" if i in holds else name
        j = known.get((up, key))
        if j is None:
            j = known[up, key] = len(keys)
            parents.append(up)
            keys.append(key)
        of.append(j)
    return tree(parents, keys), of


def _heaviest_rise(places: list[int], weights: list[int]) -> list[int]:
    """Which of the items to take so that places rise and the weights are the most: a search tree of prefix maxima, n log n."""
    if all(a < b for a, b in zip(places, places[1:], strict=False)):
        return list(range(len(places)))
    rank = {p: r for r, p in enumerate(sorted(set(places)), 1)}
    size = len(rank)
    best = [(0, -1)] * (size + 1)  # weight and last item, by Fenwick ranges
    back = [-1] * len(places)
    top = (0, -1)
    for k, (p, w) in enumerate(zip(places, weights, strict=True)):
        r, found = rank[p] - 1, (0, -1)
        while r > 0:
            if best[r][0] > found[0]:
                found = best[r]
            r &= r - 1
        back[k] = found[1]
        mine = (found[0] + w, k)
        if mine[0] > top[0]:
            top = mine
        r = rank[p]
        while r <= size:
            if mine[0] > best[r][0]:
                best[r] = mine
            r += r & -r
    out, k = [], top[1]
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def align(a: Tree, b: Tree) -> tuple[list[int], int]:
    """Simple tree matching: the partner in b of each node of a, or -1, and how many have one.

    Partners have equal names, partners' parents are partners, and partners of siblings keep their order; of all such
    mappings the one with the most nodes is taken. Folding leaves each key once among siblings, so a node has one
    candidate: the sibling of that key, else, for bare containers, the next of its name that is left. Hence one pass
    down finds candidates, one pass up weighs subtrees, where the heaviest rising row of kids is kept, and one more
    pass down keeps what hangs together.
    """
    n = len(a.keys)
    candidate = [-1] * n
    candidate[0] = 0
    for i in range(n):
        j = candidate[i]
        if j < 0 or not a.kids[i]:
            continue
        free = {b.keys[k]: k for k in b.kids[j]}
        left = []
        for k in a.kids[i]:
            candidate[k] = free.pop(a.keys[k], -1)
            if candidate[k] < 0 and a.keys[k].partition("~")[0] in BARE:
                left.append(k)
        if left and free:
            by: dict[str, list[int]] = {}
            for key, k in free.items():
                by.setdefault(key.partition("~")[0], []).append(k)
            for queue in by.values():
                queue.sort(reverse=True)
            for k in left:
                if queue := by.get(a.keys[k].partition("~")[0]):
                    candidate[k] = queue.pop()
    weight = [0] * n
    taken = [False] * n
    taken[0] = True
    for i in range(n - 1, -1, -1):
        if candidate[i] < 0:
            continue
        met = [k for k in a.kids[i] if candidate[k] >= 0]
        rise = _heaviest_rise([b.places[candidate[k]] for k in met], [weight[k] for k in met])
        weight[i] = 1
        for r in rise:
            taken[met[r]] = True
            weight[i] += weight[met[r]]
    partner = [-1] * n
    partner[0] = 0
    for i in range(1, n):
        if taken[i] and partner[a.parents[i]] >= 0:
            partner[i] = candidate[i]
    return partner, weight[0]


def slots(page: Page, of: list[int], folded: Tree, partner: list[int]) -> list[int]:
    """The template node of each node of the page: its partner, else that of the nearest node above that has one."""
    at = [0] * len(folded.keys)
    for i in range(1, len(at)):
        at[i] = partner[i] if partner[i] >= 0 else at[folded.parents[i]]
    return [at[j] for j in of]


def region(t: Tree, mass: list[int], varies: list[bool], landmarks: bool = False) -> int:
    """The node that holds the main part, from the prose that varies over the pages: at each step down into the container that holds at least half of what is left.

    mass: characters of the different texts of a node, varies: whether they change from page to page. The way down
    stops where something that varies would stay behind and belongs to the part: running text, a heading, or a first
    heading in another container. With landmarks, nothing beside an article or main element that holds half belongs to it.
    """
    n = len(t.keys)
    total, title = list(mass), [t.tags[i] == "h1" and varies[i] for i in range(n)]
    alive = list(varies)
    for i in range(n - 1, 0, -1):
        p = t.parents[i]
        total[p] += total[i]
        title[p] |= title[i]
        alive[p] |= alive[i]
    at = 0
    while t.kids[at]:
        best = max(t.kids[at], key=lambda k: (total[k], -k))
        if t.tags[best] not in SECTIONS or not total[best] or 2 * total[best] < total[at]:
            break
        if landmarks and t.tags[best] in ("article", "main"):
            at = best
            continue
        if 50 * mass[at] > total[at]:
            break
        behind = [k for k in t.kids[at] if k != best]
        if any(title[k] or (alive[k] and t.tags[k] in FLOW and (t.tags[k] in HEADINGS or 50 * total[k] > total[at])) for k in behind):
            break
        at = best
    return at


def below(t: Tree, top: int) -> list[bool]:
    """Which nodes stand in the subtree of top."""
    out = [False] * len(t.keys)
    for i in range(top, len(out)):
        out[i] = i == top or (t.parents[i] >= top and out[t.parents[i]])
    return out
