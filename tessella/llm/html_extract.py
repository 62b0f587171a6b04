"""Main text of web pages by inferred wrappers (operator 4).

A wrapper is a union-free regular expression over the tokens of pages of one
template (tags of blocks, and texts, with inline elements as part of them). It
starts as the first page's token stream with runs of equal groups folded to
repeated groups. Each further page is aligned with it: texts become text
slots, stretches that only one side has become optional, or join the repeated
group beside them that they fit. Where an expression would outgrow ``SIZE``, what
differs becomes a free region: any number of its tokens in any order, which is
a repeated group of options, ``(a? b? c?)+``, written ``("*", tokens)``.

A template is a host with the skeleton of a page: its containers of the two
outermost levels. Null and odd URLs belong to no host; their pages share a
template only if all their block elements stand in the same places.

Three passes over the pages, none of which shuffles them:

1. Every task folds its pages to one wrapper per template; these are merged per
   template, in two rounds.
2. Every page is read by its template's wrapper, which gives each text its place
   in the expression. Texts are counted by template and place (as hashes). A text
   that at least nine in ten of the pages with its place have there, at a
   place that half of the template's pages have, is the template's own (at least
   two pages; pages with the same texts count once).
3. Every page is read again. A page with text under an article or main element
   has it there. On any other page the article is what its places took, but for
   the template's own texts and lists of links (a list goes only when all its words are
   links). Where less than a twentieth would be left (copies with another date), the page keeps all.

Menus, headers, footers, sidebars, notices, adverts, forms and reader comments
are no article, unless such a block (by its class, id or role) holds most of the
text that differs between the template's pages. Reader comments are that block
only where nothing else differs. Formulas, objects' content, labels of
drawings, and noscript inside the article are text.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, materialize

#: Bytes of wrappers that are broadcast; beyond it, pages are joined by host.
BROADCAST = 32 << 20
#: Longest group of tokens that is looked for as a repeat.
GROUP = 64
#: Shares that a host's wrappers are first merged in.
SALT = 16
#: Most tokens of an expression; what differs beyond it becomes free regions.
SIZE = 1024
#: Tokens of a page that are folded as they are; of more, only the outer levels are.
LONG = 4096
#: Nested marked blocks beyond which no text is an article's.
MARKED = 8
#: A template's own text: on this share of the pages with its place, which this share of all its pages have.
OWN, COMMON = 0.9, 0.5
#: Share of a page's text that differs, below which the page is a copy and keeps all.
VARYING = 0.05
#: Wrappers that a worker holds ready at once.
READY = 256

# Element names of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta mprescripts mspace none param source track wbr".split())
RAW = frozenset("script style noscript iframe template textarea svg title".split())
MATH = frozenset(
    "math annotation annotation-xml maction merror mfrac mi mlabeledtr mmultiscripts mn mo mover mpadded mphantom mprescripts "
    "mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
#: Elements whose parts are no one word: 1/2 is not 12.
APART = frozenset("mfrac mlabeledtr mmultiscripts mroot mtable mtr munder munderover mover semantics".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark object q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()) | MATH
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("dir li ol ul".split())
DROP = (frozenset("head nav aside footer form button select option dialog menu".split()) | RAW) - {"noscript"}
# Words in class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs pagination pager header masthead footer sidebar aside widget related notice notices cookie "
    "cookies consent gdpr alert popup modal newsletter subscribe subscription signup login share sharing social form search "
    "searchbox comment comments respond replies disqus complementary contentinfo".split())
# Words that say of what else in the name only how it is set, and words after which a name tells of another block.
PLAIN = frozenset(
    "area bar block body bottom box button buttons center col column container content group holder image images inner item items "
    "label left link links list main module outer panel post posts primary right row secondary section slot small stories text "
    "title top unit wrap wrapper articles news".split())
ABOUT = frozenset("with has no non not without hide hides show is are".split())
#: Marks of what readers wrote.
READERS = frozenset("comment comments respond replies disqus".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
KEEP = frozenset(("article", "main"))
#: Elements of a page's skeleton.
FRAME = frozenset("article center div main section".split())

_PART = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_LABEL = re.compile(r"<(text|foreignObject)(?=[\s/>])[^>]*>(.*?)</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def marks(name: str) -> set[str]:
    """Marking words of a class, id or role that is one: its last word, but for
    those of ``PLAIN``, is a mark (ad-box, site-header; not notice-period)."""
    words = [w.lower() for w in _WORD.findall(name.partition("--")[0])]
    if not ABOUT.isdisjoint(words):
        return set()
    last = next((w for w in reversed(words) if w in MARKS or not (w in PLAIN or w.isdigit() or len(w) == 1)), "")
    return MARKS.intersection(words) if last in MARKS else set()


def element(name: str, attrs: str, heading: bool = False) -> str:
    """An element's token: its name, and the marking words of its attributes. An
    id in a heading is where links lead to, and marks nothing."""
    if not attrs or "=" not in attrs:
        return name
    found: set[str] = set()
    for m in _ATTR.finditer(attrs):
        if not (m[1].lower() == "id" and (heading or name in HEADINGS)):
            for x in (m[2] or m[3] or m[4] or "").split():
                found |= marks(x)
    return ".".join([name, *sorted(found), *(["main"] if name not in KEEP and re.search(r"role\s*=\s*[\"']?main\b", attrs) else [])])


class Level:
    """An open element and what holds for all text in it; each knows its path
    by a hash over its parent's, so deep nesting costs no more than its length."""

    __slots__ = ("bad", "depth", "dropped", "head", "heading", "header", "inline", "link", "main", "marks", "name", "path", "tag")

    def __init__(self, tag: str, up: Level | None, at: int):
        self.tag, self.name = tag, tag.partition(".")[0]
        self.path = _hash(tag, up.path if up else 0)
        self.inline = self.name in INLINE
        out = left_out(tag)
        self.main = is_main(tag) or up is not None and up.main
        self.dropped = self.name in DROP or up is not None and up.dropped
        self.header = self.name == "header" or up is not None and up.header
        self.head = up is not None and up.head or self.name == "header" and not self.main  # a header that holds the article element
        self.heading = self.name in HEADINGS or up is not None and up.heading
        self.link = self.inline and (self.name == "a" or up is not None and up.link)
        self.marks: tuple[int, ...] = up.marks if up else ()
        self.bad = up.bad if up is not None and up.bad >= 0 else at if out else -1
        self.depth = (up.depth if up else 0) + (self.name in FRAME)
        if out and not self.dropped:
            # blocks of readers count below zero
            self.marks += (-self.path if not READERS.isdisjoint(tag.split(".")) else self.path,)
            self.dropped = len(self.marks) > MARKED


def _hash(text: str, seed: int = 0) -> int:
    """A positive 62-bit hash (never 0)."""
    return xxhash.xxh64_intdigest(text, seed) >> 2 | 1


class Page:
    """Token stream of a page, and its texts with where they stand."""

    def __init__(self, source: str):
        self.tokens: list[str] = []
        self.texts: list[tuple[str, int, int, Level]] = []  # text, block number, number of its "#" token, element
        self.lists: list[int | None] = []  # of each text: the outermost list that it stands in
        self.stack: list[Level] = []
        self.opened: dict[str, list[int]] = {}  # where each element stands in the stack
        self.blocks: list[int] = []  # where the elements that are not inline stand in it
        self.frame: set[int] = set()
        self.shape: set[int] = set()
        self.block = self.places = 0
        self._list: tuple[int, int] | None = None  # depth and name
        at, n = 0, len(source)
        while at < n:
            m = _PART.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at:m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                self._close(name)
            else:
                tag = element(name, m[3], self._top().heading)
                if name == "noscript" and self._top().main:
                    self._open(name, tag)
                elif name in RAW and not m[3].endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
                    self.tokens.append(f"<{name}/>")
                    for label in _LABEL.finditer(source, at, end.start()) if name == "svg" else ():
                        words = _TAG.sub(" ", label[2])
                        if not words.isspace() and words:
                            self._text(f" {words} ")
                    at = end.end()
                else:
                    self._open(name, tag)
        self._pop_to(0)

    def _top(self) -> Level:
        return self.stack[-1] if self.stack else _ROOT

    def _text(self, text: str) -> None:
        if text.isspace():
            # white space between words still parts them
            if self.texts and self.texts[-1][1] == self.block and not self.texts[-1][0].endswith(" "):
                self.texts[-1] = (self.texts[-1][0] + " ", *self.texts[-1][1:])
            return
        if not self.tokens or self.tokens[-1] != "#":
            self.tokens.append("#")
            self.places += 1
        self.texts.append((text, self.block, self.places - 1, self._top()))
        self.lists.append(self._list and self._list[1])

    def _pop_to(self, i: int) -> None:
        for level in reversed(self.stack[i:]):  # end tags that were left out are put in
            self.opened[level.name].pop()
            if not level.inline:
                self.blocks.pop()
                self.tokens.append(f"</{level.name}>")
        del self.stack[i:]
        if self._list is not None and self._list[0] >= i:
            self._list = None

    def _last(self, names) -> int:
        return max((self.opened[x][-1] for x in names if self.opened.get(x)), default=-1)

    def _open(self, name: str, tag: str) -> None:
        if name not in INLINE:
            self.block += 1
        elif name == "br" or self._top().name in APART:
            self._text(" ")
        if name in CLOSES_P and self.blocks and self.stack[self.blocks[-1]].name == "p":
            self._pop_to(self.blocks[-1])
        if name in SAME:
            at = self._last(SAME[name])
            if at > self._last(("ul", "ol", "dl", "table", "select")):
                self._pop_to(at)
        if name in KEEP:  # an article does not stand in what is left out: that was never closed
            bad = self._top().bad
            if bad >= 0 and self.stack[bad].name not in ("aside", "footer", "form") and "comment" not in self.stack[bad].tag:
                self._pop_to(bad)
        if name not in INLINE:  # inline elements are part of a text
            self.tokens.append(f"<{tag}>")
        if name in VOID:
            return
        up = self._top()
        level = Level(tag, up, len(self.stack))
        if name in LISTS and self._list is None:  # items without a list are one beside each other
            self._list = len(self.stack), up.path if name == "li" else -self.block
        if not level.inline:
            if level.bad < 0:
                self.shape.add(level.path)
                if name in FRAME and level.depth <= 2 and not up.main:
                    self.frame.add(level.path)
            self.blocks.append(len(self.stack))
        self.opened.setdefault(name, []).append(len(self.stack))
        self.stack.append(level)

    def _close(self, name: str) -> None:
        if self.opened.get(name):
            self._pop_to(self.opened[name][-1])
        if name not in INLINE:
            self.block += 1

    def site(self, host: str) -> str:
        """The template: the host and the page's skeleton, or the places of all
        its blocks where there is no host."""
        found = sorted(self.frame if host else self.shape)
        return f"{host}/{_hash(json.dumps(found)):016x}"

    def links(self) -> set[int]:
        """Lists all of whose words are links."""
        found: dict[int, bool] = {}
        for (text, _, _, level), at in zip(self.texts, self.lists, strict=True):
            if at is not None and found.get(at, True):
                found[at] = level.link or not any(c.isalnum() for c in html.unescape(text))
        return {at for at, only in found.items() if only}


# ---------------------------------------------------------------- wrappers
# Items: a token (str), ("+", items) for a repeated and ("?", items) for an optional group,
# ("*", tokens) for a free region: any number of the tokens in any order.

def _chars(items, codes: dict, back: list) -> str:
    out = []
    for x in items:
        if x not in codes:
            codes[x] = chr(0xF0000 + len(back))
            back.append(x)
        out.append(codes[x])
    return "".join(out)


def fold(items) -> tuple:
    """Runs of equal groups as repeated groups, the shortest first; after each
    step, groups beside a repeated group that begin alike join it."""
    items, size = absorb(items), 1
    while size <= GROUP:
        new = _tandems(items, size)
        if new != items:
            new = absorb(new)
        if len(new) < len(items):
            items, size = new, 1
        else:
            size += 1
    return items


def _tandems(items: tuple, size: int) -> tuple:
    """Groups of ``size`` items that stand twice or more in a row, as one."""
    codes: dict = {}
    back: list = []
    s = _chars(items, codes, back)

    def repeat(m: re.Match) -> str:
        body = tuple(back[ord(c) - 0xF0000] for c in m[1])
        if size == 1 and isinstance(body[0], tuple) and body[0][0] in "+*":
            return m[1]  # such a group is not repeated again
        return _chars([("+", body)], codes, back)

    s = re.sub(rf"(.{{{size}}})\1+", repeat, s, flags=re.S)
    return tuple(back[ord(c) - 0xF0000] for c in s)


def _stretch(items: list, j: int) -> int:
    """End of the group that begins at ``items[j]``: before the next that
    begins alike, or the end of an element that it did not open."""
    head = items[j]
    if isinstance(head, tuple):
        return j + 1
    opened, k = {_name(head)}, j + 1
    while k < len(items) and k - j < GROUP and _head(items[k]) != head:
        x = items[k]
        if isinstance(x, str) and x.startswith("</"):
            if _name(x) not in opened:
                break
        elif isinstance(x, str):
            opened.add(_name(x))
        k += 1
    return k


def _name(token: str) -> str:
    return token.strip("</>").partition(".")[0]


def absorb(items) -> tuple:
    """Groups beside a repeated group that begin with its tag join it, with
    optional parts where they differ."""
    items = list(items)
    i = 0
    while i < len(items):
        x = items[i]
        optional = isinstance(x, tuple) and x[0] == "?" and len(x[1]) == 1 and isinstance(x[1][0], tuple)
        plus = x[1][0] if optional else x
        head = _head(plus)
        if not (isinstance(plus, tuple) and plus[0] == "+" and head[0] == "<" and head[1] != "/"):
            i += 1
            continue

        def joined(lo: int, hi: int):
            """The repeated group with items[lo:hi] as one more turn of it."""
            turn = items[lo:hi]
            while len(turn) == 1 and isinstance(turn[0], tuple) and turn[0][0] != "*":
                turn = list(turn[0][1])
            return ("+", merge(plus[1], tuple(turn)))

        done = False
        if i + 1 < len(items) and _head(items[i + 1]) == head:
            k = _stretch(items, i + 1)
            new = joined(i + 1, k)
            items[i:k] = [new if isinstance(items[i + 1], str) or not optional else ("?", (new,))]
            done = True
        if not done:
            j = next((j for j in range(i - 1, max(-1, i - GROUP), -1) if _head(items[j]) == head), None)
            if j is not None and _stretch(items, j) == i:
                new = joined(j, i)
                items[j:i + 1] = [new if isinstance(items[j], str) or not optional else ("?", (new,))]
                i, done = j, True
        if not done:
            i += 1
    return tuple(items)


def _head(x) -> str:
    while isinstance(x, tuple):
        x = x[1][0]
    return x


def _alike(a, b) -> bool:
    if a == b:
        return True
    if isinstance(a, tuple) and isinstance(b, tuple):
        return a[0] == b[0] == "+" and _head(a) == _head(b) or a[0] == b[0] == "*"
    return False


def _join(a, b):
    if a == b:
        return a
    return _free((a, b)) if a[0] == "*" else ("+", merge(a[1], b[1]))


def _tokens(items) -> Iterator[str]:
    for x in items:
        if isinstance(x, str):
            yield x
        else:
            yield from _tokens(x[1])


def _free(items) -> tuple:
    """The free region of all tokens in ``items``."""
    return "*", tuple(sorted(set(_tokens(items))))


def bounded(items: tuple) -> tuple:
    """``items``, with groups made free regions if they hold more than ``SIZE``
    tokens, and one region of everything if that is not enough."""
    if sum(1 for _ in _tokens(items)) <= SIZE:
        return items
    out: list = []
    for x in items:
        if isinstance(x, str):
            out.append(x)
        elif out and isinstance(out[-1], tuple):
            out[-1] = _free((out[-1], x))
        else:
            out.append(_free((x,)))
    return tuple(out) if sum(1 for _ in _tokens(out)) <= SIZE else (_free(out),)


def expression(tokens: list[str]) -> tuple:
    """A page's own expression. Of a very long page only the outer levels are
    kept apart, as many as there is room for."""
    if len(tokens) <= LONG:
        return bounded(fold(tokens))
    depths, depth = [], 0
    for t in tokens:
        depth -= t.startswith("</")
        depths.append(depth)
        depth += t[0] == "<" and t[1] != "/" and not t.endswith("/>") and _name(t) not in VOID
    room, level = SIZE // 2, -1
    counts: dict[int, int] = {}
    for d in depths:
        counts[d] = counts.get(d, 0) + 1
    while counts.get(level + 1, 0) and counts[level + 1] <= room:
        level += 1
        room -= counts[level]
    out: list = []
    deep: set[str] = set()
    for t, d in zip(tokens, depths, strict=True):
        if d > level:
            deep.add(t)
            continue
        if deep:
            out.append(_free(deep))
            deep = set()
        out.append(t)
    return bounded(fold([*out, _free(deep)] if deep else out))


def _empty(items) -> bool:
    """Whether ``items`` match nothing, too."""
    return all(isinstance(x, tuple) and (x[0] != "+" or _empty(x[1])) for x in items)


def _optional(items: list) -> list:
    if not items:
        return []
    if all(isinstance(x, tuple) and x[0] in "?*" for x in items):
        return list(items)
    return [("?", tuple(items))]


def merge(a: tuple, b: tuple) -> tuple:
    """The wrapper for both: the longest common subsequence of the two stays;
    what only one side has between becomes optional, unless a repeated group
    beside it begins alike and takes it in."""
    if a == b:
        return a
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo:len(a) - hi], b[lo:len(b) - hi]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = 1 + best[i + 1][j + 1] if _alike(x[i], y[j]) else max(best[i + 1][j], best[i][j + 1])
    out, i, j, one, two = list(a[:lo]), 0, 0, [], []

    def settle():
        whole = absorb(one + two) if one and two else None
        if whole is not None and len(whole) == 1 and isinstance(whole[0], tuple):
            # both sides have a turn of one repeated group
            out.extend(_optional([whole[0]]) if _empty(one) or _empty(two) else whole)
        else:
            out.extend(_optional(one))
            out.extend(_optional(two))
        one.clear()
        two.clear()

    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and _alike(x[i], y[j]) and best[i][j] == 1 + best[i + 1][j + 1]:
            settle()
            out.append(_join(x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            one.append(x[i])
            i += 1
        else:
            two.append(y[j])
            j += 1
    settle()
    return bounded(fold(out + list(a[len(a) - hi:])))


class Reader:
    """Reads token streams by an expression: every occurrence of a token in it is
    a state, and sets of states are bits of a number. The sets met are kept,
    so that a step is mostly one look-up; nothing is tried twice."""

    def __init__(self, items: tuple):
        self.at: dict[str, int] = {}  # the states of a token
        self.follow: list[int] = []
        self.first, self.last, self.empty = self._build(items)
        self._clear()

    def _clear(self) -> None:
        self.sets: list[int] = []
        self.number: dict[int, int] = {}
        self.step: dict[tuple[int, str], int] = {}
        self.back: dict[tuple[int, int], int] = {}

    def _states(self, tokens) -> int:
        bits = 0
        for t in tokens:
            bit = 1 << len(self.follow)
            self.follow.append(0)
            self.at[t] = self.at.get(t, 0) | bit
            bits |= bit
        return bits

    def _link(self, bits: int, to: int) -> None:
        while bits:
            low = bits & -bits
            self.follow[low.bit_length() - 1] |= to
            bits ^= low

    def _build(self, items) -> tuple[int, int, bool]:
        """(first states, last states, matches nothing too) of a sequence."""
        first, last, empty = 0, 0, True
        for x in items:
            if isinstance(x, str):
                f = l = self._states((x,))
                e = False
            elif x[0] == "*":
                f = l = self._states(x[1])
                e = True
                self._link(l, f)
            else:
                f, l, e = self._build(x[1])
                if x[0] == "+":
                    self._link(l, f)
                else:
                    e = True
            self._link(last, f)
            first |= f if empty else 0
            last = l | last if e else l
            empty = empty and e
        return first, last, empty

    def _number(self, bits: int) -> int:
        n = self.number.setdefault(bits, len(self.sets))
        if n == len(self.sets):
            self.sets.append(bits)
        return n

    def read(self, tokens: list[str]) -> list[int] | None:
        """The place that each text of the stream takes (a place is a state), or
        None if the expression does not match. Of several ways the one with the
        earliest places, seen from the end, is taken."""
        if not tokens:
            return [] if self.empty else None
        if len(self.step) + len(self.back) > 1 << 16:
            self._clear()
        now = self._number(self.first & self.at.get(tokens[0], 0))
        way = [now]
        for t in tokens[1:]:
            to = self.step.get((now, t))
            if to is None:
                bits, reach, only = self.sets[now], 0, self.at.get(t, 0)
                while bits:
                    low = bits & -bits
                    reach |= self.follow[low.bit_length() - 1]
                    bits ^= low
                to = self.step[now, t] = self._number(reach & only)
            now = to
            way.append(now)
        ends = self.sets[now] & self.last
        if not ends:
            return None
        state = (ends & -ends).bit_length() - 1
        places = [state] if tokens[-1] == "#" else []
        for i in range(len(tokens) - 2, -1, -1):
            key = way[i], state
            found = self.back.get(key)
            if found is None:
                bits = self.sets[way[i]]
                while True:
                    found = (bits & -bits).bit_length() - 1
                    if self.follow[found] >> state & 1:
                        break
                    bits &= bits - 1
                self.back[key] = found
            state = found
            if tokens[i] == "#":
                places.append(state)
        return places[::-1]


class Wrapper:
    """The expression that the pages of a template have in common."""

    def __init__(self, items: tuple = (), pages: int = 0):
        self.items, self.pages = items, pages
        self._reader: Reader | None = None

    def read(self, tokens: list[str]) -> list[int] | None:
        """Place of each text, or None where the expression does not match."""
        if self._reader is None:
            self._reader = Reader(self.items)
        return self._reader.read(tokens)

    def add(self, page: Page) -> None:
        if not (self.pages and self.read(page.tokens) is not None):
            own = expression(page.tokens)
            self.items, self._reader = merge(self.items, own) if self.pages else own, None
        self.pages += 1

    def merge(self, other: Wrapper) -> Wrapper:
        if not self.pages:
            return other
        if self.items != other.items:
            self.items, self._reader = merge(self.items, other.items), None
        self.pages += other.pages
        return self

    def dumps(self) -> str:
        return json.dumps([self.items, self.pages], ensure_ascii=False)

    @classmethod
    def loads(cls, text: str) -> Wrapper:
        def items(x):
            return tuple(y if isinstance(y, str) else (y[0], items(y[1])) for y in x)
        a, pages = json.loads(text)
        return cls(items(a), pages)


def taken(texts, places: list[int] | None) -> dict[tuple[int, tuple[int, ...]], tuple[int, int, int, bool]]:
    """What the places of a page took, by the number of the text's token and the marked
    blocks around it: place (-1: none), hash of the text, characters, whether in the main element."""
    runs: dict[tuple[int, tuple[int, ...]], list] = {}
    for text, _, run, level in texts:
        runs.setdefault((run, level.marks), [level.main, []])[1].append(text)
    out = {}
    for key, (main, parts) in runs.items():
        text = " ".join("".join(parts).split())
        out[key] = places[key[0]] if places else -1, _hash(text), len(text), main
    return out


def article(page: Page, places: list[int] | None, own: frozenset[tuple[int, int]], most: frozenset[int]) -> list:
    """The texts of the page's article, given the texts (place, hash) that are its
    template's own and the marked blocks that hold most of what differs."""
    open_ = [(i, x) for i, x in enumerate(page.texts) if not x[3].dropped and most.issuperset(x[3].marks)]
    inside = [x for _, x in open_ if x[3].main and not x[3].head]
    if inside:
        return inside
    links = page.links()
    free = [x for i, x in open_ if not x[3].header and page.lists[i] not in links]
    took = taken(free, places)
    stay = {key for key, (place, text, _, _) in took.items() if (place, text) not in own}
    if sum(took[key][2] for key in stay) < VARYING * sum(x[2] for x in took.values()):
        return free
    return [x for x in free if (x[2], x[3].marks) in stay]


def left_out(tag: str) -> bool:
    name, *marks = tag.split(".")
    if name in DROP:
        return True
    if name in KEEP or name in ("body", "html") or "main" in marks:
        return False
    return bool(marks)


def is_main(tag: str) -> bool:
    name, *marks = tag.split(".")
    return name in KEEP or "main" in marks


def text_of(texts) -> str:
    """Texts, references decoded; one line per block."""
    out: list[list[str]] = []
    last = None
    for text, block, _, _ in texts:
        if block != last:
            out.append([])
            last = block
        out[-1].append(text)
    lines = (" ".join(html.unescape("".join(x)).split()) for x in out)
    return "\n".join(x for x in lines if x)


#: What holds outside all elements.
_ROOT = Level("", None, 0)


# ------------------------------------------------------------------- Spark

def host_of(url: str):
    """Host of a URL column, lower case; null and odd URLs share the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


_WRAPPERS = pa.schema([("site", pa.string()), ("wrapper", pa.string())])


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to one wrapper per template that the task reads."""
    found: dict[str, Wrapper] = {}
    for rb in batches:
        for host, source in zip(rb.column(0), rb.column(1), strict=True):
            page = Page(source.as_py() or "")
            found.setdefault(page.site(host.as_py()), Wrapper()).add(page)
        if len(found) > 1024:  # many templates: hand on what there is
            yield batch(_WRAPPERS, site=list(found), wrapper=[w.dumps() for w in found.values()])
            found = {}
    if found:
        yield batch(_WRAPPERS, site=list(found), wrapper=[w.dumps() for w in found.values()])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, wrapper) sorted by site to one wrapper per site; one is held at a time."""
    site, now = None, Wrapper()
    for rb in batches:
        for s, w in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
            if s != site:
                if now.pages:
                    yield batch(_WRAPPERS, site=[site], wrapper=[now.dumps()])
                site, now = s, Wrapper()
            now = now.merge(Wrapper.loads(w))
    if now.pages:
        yield batch(_WRAPPERS, site=[site], wrapper=[now.dumps()])


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(site, wrapper) for every template in ``pages``."""
    src = pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    part = src.mapInArrow(_infer, "site string, wrapper string")
    part = part.repartition("site", F.pmod(F.xxhash64("wrapper"), F.lit(SALT))).sortWithinPartitions("site", "wrapper")
    part = part.mapInArrow(_merge, "site string, wrapper string")
    part = part.repartition("site").sortWithinPartitions("site", "wrapper")
    return part.mapInArrow(_merge, "site string, wrapper string")


class _Known:
    """What is known of templates, ready for use; ``known`` is None where every row brings it."""

    def __init__(self, known: dict[str, tuple] | None):
        self.known, self.ready = known, {}

    def get(self, site: str, given: tuple | None) -> tuple[Wrapper, frozenset, frozenset]:
        got = self.ready.get(site)
        if got is None:
            if len(self.ready) >= READY:
                self.ready.clear()
            wrapper, own, most = given or (self.known or {}).get(site) or (None, None, None)
            got = self.ready[site] = (Wrapper.loads(wrapper) if wrapper else Wrapper(),
                                      frozenset((x["place"], x["text"]) for x in own or ()), frozenset(most or ()))
        return got

    def rows(self, rb: pa.RecordBatch) -> Iterator[tuple[Page, str, list[int] | None, frozenset, frozenset]]:
        given = list(zip(*(rb.column(c).to_pylist() for c in ("wrapper", "own", "most")), strict=True)) if self.known is None else None
        for i, (host, source) in enumerate(zip(rb.column("host").to_pylist(), rb.column("html"), strict=True)):
            page = Page(source.as_py() or "")
            site = page.site(host)
            wrapper, own, most = self.get(site, given[i] if given else None)
            yield page, site, wrapper.read(page.tokens) if wrapper.pages else None, own, most


_TAKEN = pa.list_(pa.struct([("place", pa.int32()), ("text", pa.int64()), ("chars", pa.int64()), ("main", pa.bool_()),
                             ("marks", pa.list_(pa.int64())), ("new_place", pa.int32()), ("new_text", pa.int32())]))


def _evidence(batches: Iterator[pa.RecordBatch], known: dict[str, tuple] | None) -> Iterator[pa.RecordBatch]:
    """Rows (host, html, ...) to (site, page, what the places took). Place -1 with text 0 counts the page."""
    at = _Known(known)
    for rb in batches:
        sites, pages, took = [], [], []
        for page, site, places, _, _ in at.rows(rb):
            if places is None:
                continue
            found = taken([x for x in page.texts if not x[3].dropped], places)
            rows = [{"place": -1, "text": 0, "chars": 0, "main": False, "marks": [], "new_place": 1, "new_text": 1}]
            seen: set = set()
            for (_, marks), (place, text, chars, main) in found.items():
                rows.append({"place": place, "text": text, "chars": chars, "main": main, "marks": list(marks),
                             "new_place": int(place not in seen), "new_text": int((place, text) not in seen)})
                seen |= {place, (place, text)}
            sites.append(site)
            pages.append(_hash(json.dumps([(r["place"], r["text"]) for r in rows])))
            took.append(rows)
        yield pa.RecordBatch.from_arrays([pa.array(sites, pa.string()), pa.array(pages, pa.int64()), pa.array(took, _TAKEN)],
                                         names=["site", "page", "took"])


def _sites(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, url, host, html) with their site."""
    for rb in batches:
        sites = [Page(h.as_py() or "").site(x) for x, h in zip(rb.column("host").to_pylist(), rb.column("html"), strict=True)]
        yield rb.append_column("site", pa.array(sites, pa.string()))


def _with_known(src: DataFrame, known: DataFrame, work, shape: str, broadcast_bytes: int) -> DataFrame:
    """``work`` on the pages with what is known of their templates: broadcast up to
    a measured size, else joined by site."""
    size = known.agg(F.coalesce(F.sum(F.octet_length("site") + F.octet_length("wrapper") + 64 * F.size("own") + 32 * F.size("most")),
                                F.lit(0)).alias("n")).first()["n"]
    if size <= broadcast_bytes:
        held = src.sparkSession.sparkContext.broadcast(
            {r["site"]: (r["wrapper"], [x.asDict() for x in r["own"]], r["most"]) for r in known.collect()})
        return src.mapInArrow(lambda it: work(it, held.value), shape)
    kind = src.schema["id"].dataType.simpleString()
    placed = src.mapInArrow(_sites, f"id {kind}, url string, host string, html string, site string")
    return placed.join(known, "site", "left").mapInArrow(lambda it: work(it, None), shape)


def template_texts(src: DataFrame, wrappers: DataFrame, broadcast_bytes: int = BROADCAST) -> DataFrame:
    """(site, wrapper, own, most): each template's own texts, as (place, hash), and its
    marked blocks that hold most of what differs between its pages. Both lists are
    bounded by the length of a page: an own text is on near half of all pages at least."""
    bare = wrappers.select("site", "wrapper", F.array().cast("array<struct<place:int,text:bigint>>").alias("own"),
                           F.array().cast("array<bigint>").alias("most"))
    shape = ("site string, page bigint, took array<struct<place:int,text:bigint,chars:bigint,main:boolean,marks:array<bigint>,"
             "new_place:int,new_text:int>>")
    took = _with_known(src, bare, _evidence, shape, broadcast_bytes).dropDuplicates(["site", "page"])
    took = took.select("site", F.explode("took").alias("t")).select("site", "t.*")
    took = materialize(took.groupBy("site", "place", "text", "main", "marks").agg(
        F.sum("new_place").alias("new_place"), F.sum("new_text").alias("new_text"), F.sum("chars").alias("chars")), "taken")
    pages = took.where("place < 0").select("site", F.col("new_place").alias("pages"))
    places = took.where("place >= 0").groupBy("site", "place").agg(F.sum("new_place").alias("with_place"))
    texts = took.where("place >= 0").groupBy("site", "place", "text").agg(F.sum("new_text").alias("n")).where("n > 1")
    own = materialize(texts.join(places, ["site", "place"]).join(pages, "site").where(
        (F.col("n") >= OWN * F.col("with_place")) & (F.col("with_place") >= COMMON * F.col("pages"))).select("site", "place", "text"), "own")
    differ = (took.where("place >= 0").join(places.where("with_place > 1").select("site", "place"), ["site", "place"], "left_semi")
              .join(own, ["site", "place", "text"], "left_anti").groupBy("site", "main", "marks").agg(F.sum("chars").alias("chars")))
    differ = materialize(differ, "differ")
    whole = differ.groupBy("site", "main").agg(F.sum("chars").alias("whole"), F.bool_or(F.size("marks") == 0).alias("open"))
    most = (differ.select("site", "main", "chars", F.explode("marks").alias("block")).groupBy("site", "main", "block")
            .agg(F.sum("chars").alias("chars")).join(whole, ["site", "main"])
            .where((2 * F.col("chars") > F.col("whole")) & ~((F.col("block") < 0) & F.col("open"))))
    lists = (own.groupBy("site").agg(F.collect_list(F.struct("place", "text")).alias("own")),
             most.groupBy("site").agg(F.collect_set("block").alias("most")))
    out = wrappers.join(lists[0], "site", "left").join(lists[1], "site", "left")
    return out.select("site", "wrapper", F.coalesce("own", F.array().cast("array<struct<place:int,text:bigint>>")).alias("own"),
                      F.coalesce("most", F.array().cast("array<bigint>")).alias("most"))


_TEXT = pa.schema([("text", pa.string()), ("matched", pa.bool_())])


def _extract(batches: Iterator[pa.RecordBatch], known: dict[str, tuple] | None) -> Iterator[pa.RecordBatch]:
    """Rows (id, url, host, html, ...) to (id, url, text, matched)."""
    at = _Known(known)
    for rb in batches:
        texts, matched = [], []
        for page, _, places, own, most in at.rows(rb):
            texts.append(text_of(article(page, places, own, most)))
            matched.append(places is not None)
        yield pa.RecordBatch.from_arrays([rb.column("id"), rb.column("url"), *batch(_TEXT, text=texts, matched=matched).columns],
                                         names=["id", "url", "text", "matched"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            broadcast_bytes: int = BROADCAST) -> DataFrame:
    """One row (id, url, text, n_chars, matched) for each row of ``pages``.

    ``text``: the article's blocks, one line each, character references decoded
    and white space folded; ``n_chars``: its code points; ``matched``: whether the
    template's wrapper matched the page. Null and empty pages have an empty text;
    a null or odd URL puts a page under the empty host; repeated rows each get a
    row; an empty table gives none. Other columns are not read.
    """
    wrappers = materialize(infer_wrappers(pages, url_col, html_col), "wrappers")
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host_of(url_col).alias("host"),
                       F.col(html_col).cast("string").alias("html"))
    known = materialize(template_texts(src, wrappers, broadcast_bytes), "templates")
    kind = src.schema["id"].dataType.simpleString()
    out = _with_known(src, known, _extract, f"id {kind}, url string, text string, matched boolean", broadcast_bytes)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text",
                      F.char_length("text").cast("long").alias("n_chars"), "matched")
