"""Main text of web pages by wrapper inference (after Crescenzi, Mecca and Merialdo, 2001).

The pages of each host are read as token streams and aligned into a union-free expression. Where the
streams agree they stay; texts that differ become slots; where tags disagree,
the mismatch is resolved by the nearest place at which one stream goes on like the other: what lies
between becomes optional, and what repeats what stands before it becomes a repeated group. Matched
elements are aligned again inside, so options and groups nest. A row that grows beyond ``WIDE`` parts, as
the blocks of many articles do, keeps what all pages begin and end with; what lies between becomes a
repeated group of options, one for each kind, which holds them in any order.

Every page of a host is then matched against its host's expression, which tells for each part of it
on how many pages it occurs, whether its text ever differs and how long it is. The article is the
lowest container of all slots outside menus, headers, footers, sidebars, notices, adverts, forms and
comments; tags and class words are features of that choice. Texts that are the same on all pages and
stand before or after all slots of a container that is not marked as an article belong to the layout.
A page gives the slots of the container and what else stands in it. A page that does not fit its
host's expression, or whose host has one page, is read by the expression of the page alone.

All pages of a host take part in both steps. Pages that are alike up to their texts and the lengths of
their repetitions are aligned once; what is left is aligned in rounds, ``TOGETHER`` expressions by a
task. No task gathers the pages of a host, and pages are read where they lie. Where pages have so little
in common that the expression has over ``LARGE`` parts, there is no common form to read them by, and
each is read alone.
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import free_name, written

#: Expressions that one task aligns, parts that a host's expression may have, bytes up to which a table is sent to all executors.
TOGETHER, LARGE, SENT_BYTES = 64, 20_000, 32 << 20
#: Parts of a row beyond which its middle is held in any order.
WIDE = 64
#: Hashes of forms that a task keeps to send each only once.
SEEN = 100_000
#: Longest run of parts that can repeat as a group; elements below this depth count as part of the last above it.
PERIOD, DEEP = 6, 60
#: Share of the varying characters in a container that one inside it has to have to be the article's, if its name says so and if not.
LEAST_NAMED, LEAST = 0.5, 0.6

GROUPS = ("(", "[")

# Fixed values of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "audio", "video", "title"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
NEVER = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "fieldset"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = ("ul", "ol", "dl", "table", "div", "article", "section")
CONTAINERS = {"html", "body", "div", "section", "article", "main", "center", "table", "tbody", "tr", "td"}
HEADINGS = {"h1", "h2", "h3"}
#: Words of classes, ids and roles that mark boilerplate, anywhere and outside an article.
BOILER = set("ad ads advert advertisement adverts advertising sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notification popup modal overlay banner comment comments disqus replies respond share sharing social related recommended newsletter subscribe subscription signup login search pagination pager toolbar widget complementary contentinfo dialog alert skip".split())
BOILER_OUTSIDE = set("header masthead topbar footer bottom copyright".split())
#: Words that may stand beside those in a class or id and leave it a mark; any other word makes it a name of content.
PLAIN = set("area bar block body bottom box button buttons col column container content count desktop footer form full global group header icon icons inline inner item items large left link links list main mobile more outer page panel post posts primary right row secondary section site slot small text title top unit wrap wrapper".split())
MAIN = {"article", "main"}
MAIN_WORDS = {"article", "main", "content", "post", "entry", "story", "body"}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?(?=[\s/>]|$)""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")


def marks(value: str) -> set[str]:
    """Words of a class, id or role, without names of which a word is neither a mark nor plain (``share-price``, ``related-work``)."""
    out: set[str] = set()
    for name in value.split():
        words = [w for w in _WORDS.findall(name) if len(w) > 1]
        if all(w in BOILER or w in BOILER_OUTSIDE or w in PLAIN or w in MAIN_WORDS for w in words):
            out.update(words)
    return out


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", tag, attributes), ("close", tag, "") and ("text", text, "") of a page; comments, declarations and the contents of ``RAW`` elements are left out."""
    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            close = page.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        found = _TAG.match(page, lt)
        if not found:
            if re.match(r"</?[a-zA-Z]", page[lt : lt + 3]):  # a tag that never ends
                close = page.find(">", lt)
                at = end if close < 0 else close + 1
            else:
                yield "text", "<", ""
                at = lt + 1
            continue
        at, tag = found.end(), found[2].lower()
        if found[1]:
            yield "close", tag, ""
        elif tag in RAW and not found[3].endswith("/"):
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
        else:
            yield "open", tag, found[3]


class Element:
    """An open element: whether it is or lies in boilerplate or a main container, and its node (its parent's, if inline or very deep)."""

    __slots__ = ("depth", "drop", "main", "node", "tag")

    def __init__(self, tag: str, attributes: str, parent: Element | None, top: Node):
        words: set[str] = set()
        known: set[str] = set()
        hidden, name = False, ""
        for key, value in _ATTR.findall(attributes) if attributes else ():
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id", "role"):
                words.update(_WORDS.findall(value))
                known.update(marks(value))
                if key == "class":
                    name = "".join(f".{c}" for c in sorted(value.split()) if not any(d.isdigit() for d in c))
            hidden |= key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None)
        inside = parent is not None and parent.main
        self.tag = tag
        self.main = inside or tag in MAIN or "main" in words
        outside = not self.main and (tag == "header" or bool(known & BOILER_OUTSIDE) and not words & MAIN_WORDS)
        boiler = bool(known & BOILER) and tag not in ("html", "body", *MAIN)
        self.drop = (parent is not None and parent.drop) or hidden or tag in NEVER or boiler or outside
        above = parent.node if parent is not None else top
        self.depth = (parent.depth if parent is not None else 0) + (tag not in INLINE)
        if tag in INLINE or self.depth > DEEP:
            self.node = above
        else:
            self.node = Node(f"{tag}{name}", self.drop, self.main)
            above.kids.append(self.node)


class Node:
    """A part of a page or a wrapper: an element (``sig`` is its tag and classes), a text ("#"), or a repeated group of parts, in their order ("(") or in any ("[")."""

    __slots__ = ("drop", "kids", "main", "number", "optional", "repeated", "sig", "text")

    def __init__(self, sig: str, drop: bool = False, main: bool = False, text: str | None = None):
        self.sig, self.drop, self.main, self.text = sig, drop, main, text
        self.kids: list[Node] = []
        self.optional = self.repeated = False
        self.number = -1

    @property
    def names(self) -> list[str]:
        """Signatures of what it stands for: of a group's parts, else its own."""
        return [k.sig for k in self.kids] if self.sig == "(" else [self.sig]


def tree(page: str) -> Node:
    """The blocks of a page as a tree: elements without inline ones, and texts. Linear in the page."""
    top = Node("")
    stack: list[Element] = []
    places: dict[str, list[int]] = {}
    parts: list[tuple[Element | None, str]] = []

    def flush() -> None:
        for keep in (False, True):  # inline boilerplate inside a block stays apart
            own = [(e, t) for e, t in parts if (e is None or not e.drop) == keep]
            text = " ".join(entities.unescape("".join(t for _, t in own)).split()) if own else ""
            if text:
                e = own[0][0]
                (e.node if e else top).kids.append(Node("#", not keep, e.main if e else False, text))
        parts.clear()

    def close(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop().tag].pop()

    last = lambda tags: max((places[t][-1] for t in tags if places.get(t)), default=-1)
    for kind, value, attributes in tokens(page):
        if kind == "text":
            parts.append((stack[-1] if stack else None, value))
            continue
        if value == "br" or value not in INLINE:
            flush()
        if kind == "open":
            if value in VOID:
                continue
            if value not in INLINE:  # what a new block ends by itself
                ended = last(CLOSED_BY.get(value, ("p",) if value not in ("html", "head", "body") else ()))
                if ended >= 0 and last(HOLDS) <= ended:
                    close(ended)
            if not attributes.endswith("/"):
                places.setdefault(value, []).append(len(stack))
                stack.append(Element(value, attributes, stack[-1] if stack else None, top))
        elif places.get(value):
            close(places[value][-1])
    flush()
    _name_kinds(top)
    return top


def _name_kinds(part: Node) -> None:
    """Containers without classes are told apart by what they hold: texts only, lists, or blocks."""
    for kid in part.kids:
        _name_kinds(kid)
        if kid.sig in ("div", "section") and kid.kids:
            inside = {k.sig.partition(".")[0] for k in kid.kids}
            kid.sig += ">text" if inside == {"#"} else ">list" if inside <= {"ul", "ol", "dl", "#"} else ""


def joined(a: Node, b: Node) -> Node:
    """The part that stands for both; ``a`` is changed."""
    if a.text != b.text:
        a.text = None
    a.optional, a.repeated = a.optional or b.optional, a.repeated or b.repeated
    a.drop, a.main = a.drop and b.drop, a.main or b.main
    if a.kids or b.kids:
        a.kids = aligned(a.kids, b.kids)
    return a


def folded(parts: list[Node], deep: bool = False) -> list[Node]:
    """Adjacent runs of equal shape become one repeated part or group."""
    if deep:
        for part in parts:
            part.kids = folded(part.kids, True)
    for period in range(1, min(PERIOD, len(parts) - 1) + 1):
        out: list[Node] = []
        for part in parts:
            out.append(part)
            while True:
                run = out[-period:]
                before = out[-period - 1] if period > 1 and len(out) > period and out[-period - 1].sig == "(" else None
                if before is not None and before.names == [r.sig for r in run]:
                    del out[-period:]
                    for k, r in zip(before.kids, run, strict=True):
                        joined(k, r)
                elif len(out) >= 2 * period and [r.sig for r in out[-2 * period : -period]] == [r.sig for r in run] and "(" not in [r.sig for r in run]:
                    first = out[-2 * period : -period]
                    del out[-2 * period :]
                    for k, r in zip(first, run, strict=True):
                        joined(k, r)
                    group = first[0]
                    if period > 1:
                        group = Node("(")
                        group.kids = first
                    group.repeated = True
                    out.append(group)
                else:
                    break
        parts = out
    return parts


def _places(parts: list[Node]) -> dict[str, list[int]]:
    found: dict[str, list[int]] = {}
    for k, part in enumerate(parts):
        found.setdefault(part.names[0], []).append(k)
    return found


def _next(places: list[int] | None, at: int) -> int | None:
    """The first place from ``at`` on."""
    k = bisect_left(places, at) if places else 0
    return places[k] if places and k < len(places) else None


def in_any_order(*rows: list[Node]) -> Node:
    """A repeated group of options that holds any sequence of the parts of the rows."""
    kinds: dict[str, Node] = {}
    for row in rows:
        seen: set[str] = set()
        for part in row:
            for own in laid_open(part):
                own.optional = True
                own.repeated |= own.sig in seen or part.sig == "("
                seen.add(own.sig)
                kinds[own.sig] = joined(kinds[own.sig], own) if own.sig in kinds else own
    out = Node("[")
    out.kids, out.optional, out.repeated = list(kinds.values()), True, True
    return out


def laid_open(part: Node) -> list[Node]:
    """The parts of a group, or the part."""
    return part.kids if part.sig in GROUPS else [part]


def gathered(left: list[Node], right: list[Node]) -> list[Node]:
    """The parts that stand for two rows, one of which at least has a middle in any order."""
    same = lambda a, b: a.sig == b.sig and a.sig not in GROUPS
    least, head, tail = min(len(left), len(right)), 0, 0
    while head < least and same(left[head], right[head]):
        head += 1
    while tail < least - head and same(left[-1 - tail], right[-1 - tail]):
        tail += 1
    a, b = len(left) - tail, len(right) - tail
    middle = in_any_order(left[head:a], right[head:b])
    return [*map(joined, left[:head], right[:head]), middle, *map(joined, left[a:], right[b:])]


def aligned(left: list[Node], right: list[Node]) -> list[Node]:
    """The parts that stand for both lists."""
    if any(part.sig == "[" for part in (*left, *right)):
        return gathered(left, right)
    in_left, in_right = _places(left), _places(right)
    out: list[Node] = []
    i = j = 0

    def optional(parts: list[Node]) -> None:
        for part in parts:
            part.optional = True
        out.extend(parts)

    while i < len(left) and j < len(right):
        a, b = left[i], right[j]
        if a.sig == b.sig and (a.sig != "(" or a.names == b.names):
            out.append(joined(a, b))
            i, j = i + 1, j + 1
            continue
        for group, run, flip in ((a, right[j : j + len(a.kids)], False), (b, left[i : i + len(b.kids)], True)):
            if group.sig == "(" and group.names == [r.sig for r in run]:  # one round of the group
                for k, r in zip(group.kids, run, strict=True):
                    joined(k, r)
                out.append(group)
                i, j = (i + len(run), j + 1) if flip else (i + 1, j + len(run))
                break
        else:
            ahead, back = _next(in_left.get(b.names[0]), i + 1), _next(in_right.get(a.names[0]), j + 1)
            if ahead is not None and (back is None or ahead - i <= back - j):
                optional(left[i:ahead])
                i = ahead
            elif back is not None:
                optional(right[j:back])
                j = back
            else:
                optional([a, b])
                i, j = i + 1, j + 1
    optional(left[i:] + right[j:])
    out = folded(out)
    if len(out) > WIDE:
        options = [k for k, part in enumerate(out) if part.optional]
        if options:
            out[options[0] : options[-1] + 1] = [in_any_order(out[options[0] : options[-1] + 1])]
    return out


def shape(page: str) -> Node:
    """The expression of one page."""
    top = tree(page)
    top.kids = folded(top.kids, True)
    return top


def merged(parts: list[Node]) -> Node:
    """The expression that stands for several; neighbours are aligned first, so the work is little more than linear in their size."""
    while len(parts) > 1:
        parts = [joined(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else Node("")


def infer(pages: list[str]) -> Node:
    """The union-free expression of some pages."""
    return merged([shape(page) for page in pages])


def expression(part: Node) -> str:
    """A wrapper as a regular expression over the tokens of ``stream``."""
    inside = "".join(map(expression, part.kids))
    if part.sig == "[":  # every token belongs to one option, so nothing is tried twice
        return "(?:" + "".join(f"(?:{expression(k)})?" for k in part.kids) + ")*+"
    if part.sig == "#":
        one = "#"
    elif part.sig in ("(", ""):
        one = f"(?:{inside})"
    else:
        one = f"(?:<{re.escape(part.sig)}>{inside}</>)"
    return one + ("*" if part.optional and part.repeated else "+" if part.repeated else "?" if part.optional else "")


def stream(part: Node) -> str:
    """The tokens of a page's tree."""
    return "#" if part.sig == "#" else "".join(map(stream, part.kids)) if not part.sig else f"<{part.sig}>{''.join(map(stream, part.kids))}</>"


def packed(part: Node) -> list:
    """A wrapper as lists for JSON: signature, flags, parts."""
    return [part.sig, part.optional | part.repeated << 1 | part.drop << 2 | part.main << 3, [packed(k) for k in part.kids]]


def unpacked(data: list) -> Node:
    part = Node(data[0], bool(data[1] & 4), bool(data[1] & 8))
    part.optional, part.repeated = bool(data[1] & 1), bool(data[1] & 2)
    part.kids = [unpacked(k) for k in data[2]]
    return part


class Wrapper:
    """A wrapper ready to match pages: its parts numbered from 0 in order, and where the parts below each end."""

    def __init__(self, top: Node):
        self.top, self.parts, self.ends = top, [], []
        self._number(top)
        self.rows: dict[int, tuple[list[tuple[Node, int, int, bool]], dict[str, list[int]]]] = {}

    def _number(self, part: Node) -> None:
        part.number = len(self.parts)
        self.parts.append(part)
        self.ends.append(0)
        for k in part.kids:
            self._number(k)
        self.ends[part.number] = len(self.parts)

    def _row(self, part: Node) -> tuple[list[tuple[Node, int, int, bool]], dict[str, list[int]]]:
        """The parts of an element in a row, groups laid open, each with the first and last place of its repetition and whether that has no order."""
        if part.number not in self.rows:
            row: list[tuple[Node, int, int, bool]] = []
            for k in part.kids:
                own, at = laid_open(k), len(row)
                row += [(x, at, at + len(own) - 1 if k.repeated else -1, k.sig == "[") for x in own]
            places: dict[str, list[int]] = {}
            for at, (k, _, _, _) in enumerate(row):
                places.setdefault(k.sig, []).append(at)
            self.rows[part.number] = row, places
        return self.rows[part.number]

    def match(self, page: Node) -> list[tuple[Node, int]]:
        """The page's texts in order, each with the number of the part that it is, or else of the innermost element that holds it."""
        out: list[tuple[Node, int]] = []
        self._match(self.top, page, out)
        return out

    def _match(self, part: Node, node: Node, out: list[tuple[Node, int]]) -> None:
        row, places = self._row(part)
        later = _places(node.kids)
        at = 0  # the place that is expected next
        for j, kid in enumerate(node.kids):
            found = None
            own = places.get(kid.sig)
            if own:
                if at < len(row) and row[at][0].sig == kid.sig:
                    found = at
                elif at and row[at - 1][2] >= 0:  # once more round the repetition that the last match was in
                    k = bisect_left(own, row[at - 1][1])
                    found = own[k] if k < len(own) and own[k] < at else None
                if found is None and (skip := _next(own, at)) is not None:
                    back = _next(later.get(row[at][0].sig), j + 1) if at < len(row) else None
                    loose = any(row[k][3] and skip <= row[k][2] for k in (at - 1, at) if 0 <= k < len(row))
                    found = skip if loose or back is None or skip - at <= back - j else None
            if found is not None:
                at = found + 1
            self._assign(row[found][0] if found is not None else None, part, kid, out)

    def _assign(self, part: Node | None, above: Node, node: Node, out: list[tuple[Node, int]]) -> None:
        if node.sig == "#":
            out.append((node, (part or above).number))
        elif part is not None:
            self._match(part, node, out)
        else:
            for kid in node.kids:
                self._assign(None, above, kid, out)


def counted(wrapper: Wrapper, page: Node) -> dict[int, tuple[int, int, int]]:
    """Per part of the wrapper that texts of the page match, boilerplate aside: least and greatest hash, characters."""
    out: dict[int, tuple[int, int, int]] = {}
    for leaf, number in wrapper.match(page):
        if not leaf.drop:
            h = text_hash(leaf.text or "")
            low, high, chars = out.get(number, (h, h, 0))
            out[number] = min(low, h), max(high, h), chars + len(leaf.text or "")
    return out


def choose(wrapper: Wrapper, pages: int, counts: dict[int, tuple[int, int, int, int]]) -> tuple[int, list[list[int]]]:
    """The part that holds the article, and the ranges of parts inside it that belong to the layout.

    ``counts`` has pages, least and greatest hash and characters of each part.
    """
    # a text that is the same wherever it occurs, on three pages at least and on half of them
    fixed = {n for n, (own, low, high, _) in counts.items() if own >= 3 and own * 2 >= pages and low == high and wrapper.parts[n].sig == "#"}
    weight, slots = [0] * len(wrapper.parts), [n for n in counts if n not in fixed]
    for n in slots or counts:
        weight[n] = counts[n][3]
    below = list(weight)
    for part in reversed(wrapper.parts):
        for kid in part.kids:
            below[part.number] += below[kid.number]
    marked = [0] * len(wrapper.parts)  # weight in parts marked as an article
    for part in reversed(wrapper.parts):
        marked[part.number] = below[part.number] if part.main else sum(marked[k.number] for k in part.kids)
    at = wrapper.top
    while True:
        kids = [x for k in at.kids for x in laid_open(k) if below[x.number]]
        into = [k for k in kids if marked[k.number] * 2 >= below[at.number]]
        if at.main:  # only into a further mark: the article of a main part
            into = [k for k in into if _tag(k) in MAIN]
        elif not into and len(kids) == 1 and not weight[at.number]:
            into = [k for k in kids if _tag(k) in CONTAINERS]
        elif not into:
            most = max(kids, key=lambda k: below[k.number], default=None)
            rest = [k for k in kids if k is not most]
            if most is not None and _tag(most) in CONTAINERS and not any(_heading(k) for k in rest):
                named = set(_WORDS.findall(most.sig.partition(".")[2])) & MAIN_WORDS
                # without a name: what holds the heading or several slots, and most of what varies
                if below[most.number] >= (LEAST_NAMED if named else LEAST) * below[at.number] and (named or _heading(most) or _slots(most) > 1):
                    into = [most]
        if len(into) != 1 or into[0].repeated:
            break
        at = into[0]
    cut: list[list[int]] = []
    if not at.main and fixed:
        for kids in (at.kids, at.kids[::-1]):
            for k in kids:
                if below[k.number]:
                    break
                cut.append([k.number, wrapper.ends[k.number]])
    return at.number, cut


def _tag(part: Node) -> str:
    return part.sig.partition(".")[0].partition(">")[0]


def _slots(part: Node) -> int:
    """Texts that a part holds, those of a repeated one as two."""
    return (1 + part.repeated) * (1 if part.sig == "#" else sum(map(_slots, part.kids)))


def _heading(part: Node) -> bool:
    return _tag(part) in HEADINGS or any(map(_heading, part.kids))


def _parts(part: Node) -> int:
    return 1 + sum(map(_parts, part.kids))


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


@lru_cache(maxsize=64)
def loaded(wrapper: str) -> tuple[Wrapper, int, list[list[int]]]:
    """A stored wrapper: the expression, the article's part and the layout's ranges."""
    parts, root, cut = json.loads(wrapper)
    return Wrapper(unpacked(parts)), root, cut


def alone(page: Node) -> list[str]:
    """The article's blocks of a page by its own expression."""
    whole = Wrapper(page)
    root, _ = choose(whole, 1, {n: (1, 0, 0, len(p.text)) for n, p in enumerate(whole.parts) if p.sig == "#" and not p.drop})
    return [p.text for p in whole.parts[root : whole.ends[root]] if p.sig == "#" and not p.drop]


def main_blocks(page: str | None, wrapper: str | None) -> tuple[list[str], bool]:
    """Blocks of a page's main text, and whether its host's wrapper gave them or the page alone."""
    if not page:
        return [], False
    top, kept = tree(page), []
    if wrapper:
        own, root, cut = loaded(wrapper)
        end = own.ends[root]
        kept = [leaf.text for leaf, n in own.match(top) if root <= n < end and not leaf.drop and not any(a <= n < b for a, b in cut)]
    return kept or alone(top), bool(kept)


def main_text(page: str | None, wrapper: str | None) -> str:
    return "\n".join(main_blocks(page, wrapper)[0])


def host_of(url: Column) -> Column:
    """Host of an address in lower case; without one the empty string."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def host_shapes(df: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, h, wrapper): the different expressions of a host's pages, each once, and their hashes."""
    pages = df.select(host_of(F.col(url_col)).alias("host"), F.coalesce(html_col, F.lit("")).alias("html"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            found = []
            for host, html in zip(batch["host"], batch["html"], strict=True):
                wrapper = json.dumps([packed(shape(html)), 0, []])
                h = text_hash(wrapper)
                if (host, h) not in seen:
                    seen.add((host, h))
                    found.append((host, h, wrapper))
            if len(seen) > SEEN:  # a form that comes again is dropped below
                seen.clear()
            yield pd.DataFrame(found, columns=["host", "h", "wrapper"])

    return pages.mapInPandas(read, "host string, h long, wrapper string").dropDuplicates(["host", "h"])


def host_wrappers(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", together: int = TOGETHER) -> DataFrame:
    """(host, wrapper) of every host with several pages: the expression of all of them.

    The different expressions of a host's pages are dealt to groups of about ``together`` by their
    hashes, each group is aligned by one task, and what comes out is dealt again until one is left.
    """
    several = df.groupBy(host_of(F.col(url_col)).alias("host")).agg((F.min(id_col) < F.max(id_col)).alias("several")).where("several").select("host")
    left = written(host_shapes(df, url_col, html_col).join(several, "host"))

    def wrap(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("h")
        found = None
        if group["wrapper"].notna().all():
            top = merged([unpacked(json.loads(w)[0]) for w in group["wrapper"]])
            found = json.dumps([packed(top), 0, []]) if _parts(top) <= LARGE else None
        return pd.DataFrame({"host": [group["host"].iloc[0]], "h": [group["h"].iloc[0]], "wrapper": [found]})

    turn = 0
    while True:
        own = written(left.groupBy("host").agg(F.count("*").alias("n")))
        most = own.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return left.where("wrapper is not null").select("host", "wrapper")
        dealt = left.join(own, "host").withColumn("part", F.pmod(F.xxhash64("h", F.lit(turn)), F.ceil(F.col("n") / together)))
        left = written(dealt.groupBy("host", "part").applyInPandas(wrap, "host string, h long, wrapper string"))
        turn += 1


def _beside(df: DataFrame, wrappers: DataFrame, host: str, wrapper: str) -> DataFrame:
    """``df``, which has ``host``, with the host's wrapper; wrappers are sent along if they are small in all."""
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host") + 64)).first()[0] or 0
    named = wrappers.select(F.col("host").alias(host), F.col("wrapper").alias(wrapper))
    return df.join(F.broadcast(named) if size <= SENT_BYTES else named, host, "left")


def chosen_wrappers(df: DataFrame, wrappers: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper) with the article's part, chosen by counts over all pages of the host.

    Each batch of pages adds up its counts first, so a host sends a few rows a batch.
    """
    pages = df.select(host_of(F.col(url_col)).alias("host"), F.coalesce(html_col, F.lit("")).alias("html"))
    pages = _beside(pages, wrappers, "host", "wrapper").where("wrapper is not null").select("host", "wrapper", "html")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: dict[tuple[str, int], list[int]] = {}
            for host, wrapper, html in zip(batch["host"], batch["wrapper"], batch["html"], strict=True):
                own = counted(loaded(wrapper)[0], tree(html))
                if own:
                    own[-1] = (0, 0, 0)  # the page itself
                for n, (low, high, chars) in own.items():
                    to = held.setdefault((host, n), [0, low, high, 0])
                    to[:] = to[0] + 1, min(to[1], low), max(to[2], high), to[3] + chars
            yield pd.DataFrame([(*k, *v) for k, v in held.items()], columns=["host", "part", "pages", "low", "high", "chars"])

    counts = pages.mapInPandas(count, "host string, part int, pages long, low long, high long, chars long")
    counts = counts.groupBy("host", "part").agg(F.sum("pages").alias("pages"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("chars").alias("chars"))
    # one list a host, as long as its wrapper at most
    counts = counts.groupBy("host").agg(F.collect_list(F.struct("part", "pages", "low", "high", "chars")).alias("counts"))

    @F.pandas_udf("string")
    def pick(rows: pd.Series, counts: pd.Series) -> pd.Series:
        out = []
        for row, own in zip(rows, counts, strict=True):
            by_part = {c["part"]: (c["pages"], c["low"], c["high"], c["chars"]) for c in own}
            pages = by_part.pop(-1, (0,))[0]
            parts = json.loads(row)[0]
            out.append(json.dumps([parts, *choose(Wrapper(unpacked(parts)), pages, by_part)]))
        return pd.Series(out, dtype=object)

    return written(wrappers.join(counts, "host").select("host", pick("wrapper", "counts").alias("wrapper")))


def with_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``df`` without the html, with ``text``, ``n_chars`` (code points), ``n_blocks`` and ``by_host``.

    ``by_host`` tells whether the text is what the host's expression holds as its article; otherwise
    the page was read alone.

    Null and empty pages, and pages without an article, have the empty text. Pages without an
    address or an id are extracted all the same. Repeated rows are extracted alike. An empty table
    stays empty; columns with the new names are replaced.
    """
    wrappers = chosen_wrappers(df, host_wrappers(df, id_col, url_col, html_col), url_col, html_col)
    host, wrapper = free_name(df, "page_host"), free_name(df, "page_wrapper")
    paired = _beside(df.withColumn(host, host_of(F.col(url_col))), wrappers, host, wrapper)

    def extract(pages: pd.Series, rules: pd.Series) -> pd.DataFrame:
        rows = [main_blocks(p, w) for p, w in zip(pages, rules, strict=True)]
        return pd.DataFrame([("\n".join(blocks), len(blocks), by_host) for blocks, by_host in rows], columns=["text", "n_blocks", "by_host"])

    article = free_name(df, "page_article")
    out = paired.withColumn(article, F.pandas_udf(extract, "text string, n_blocks int, by_host boolean")(F.col(html_col), F.col(wrapper)))
    out = out.withColumn(text_col, F.col(article)["text"]).withColumns({"n_chars": F.length(F.col(article)["text"]).cast("long"), "n_blocks": F.col(article)["n_blocks"], "by_host": F.col(article)["by_host"]})
    return out.drop(host, wrapper, html_col, article)
