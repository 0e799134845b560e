"""A small tolerant HTML reader: a page becomes text blocks with the zone each stands in."""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

ARTICLE, OPEN, MARKED, HINTED = 0, 1, 2, 3

# the content of RAW goes even without an end tag, as browsers read it; that of SHUT only with one
_RAW, _SHUT = "script|style|textarea|title", "noscript|template|iframe|svg|object|canvas|select|annotation"
_KEPT_OUT = re.compile(rf"<(?:({_RAW})|({_SHUT}))\b", re.I)
_ENDS = re.compile(rf"</({_RAW}|{_SHUT})\s*>", re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP, _ANGLE, _BEGINS = re.compile(r"""[<>"']"""), re.compile("[<>]"), re.compile("[/!?a-zA-Z]")
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr "
    "svg object canvas iframe select math semantics mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mspace mpadded mphantom".split()
)
OUT = frozenset("nav footer aside form menu head button dialog fieldset".split())
#: Of these, an article inside is not the page's own.
DEEP = frozenset("nav footer aside menu dialog".split())
#: Words in a class, id or role that mark an element as no part of the main text, and words that go with any of them.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "masthead footer cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login share sharing social related "
    "recommended comment comments reply replies disqus discussion respond search toolbar pagination pager widget complementary contentinfo".split()
)
PLAIN = frozenset("area bar block bottom box btn col column container content div group header inner item items left link links list main outer page panel right row section site slot text title top unit wrap wrapper".split())
COMMENTS = frozenset("comment comments reply replies disqus discussion respond".split())


def _marked(attrs: str) -> tuple[bool, bool, bool, bool]:
    """Whether attributes hide an element, mark it as outside the main text, mark it as reader comments, or only hint at one
    of the two: a name with a mark among other words, as in related-work, is a hint."""
    if not attrs or attrs.isspace():
        return False, False, False, False
    hidden = marked = comments = hinted = False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            for token in value.split():
                words = {w for w in _SPLIT.split(token) if w}
                if not words.isdisjoint(MARKS):
                    clear = words <= MARKS | PLAIN
                    marked, hinted = marked or clear, hinted or not clear
                    comments = comments or (clear and not words.isdisjoint(COMMENTS))
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            hidden = True
    return hidden, marked, comments, hinted


class _Scanner:
    """Markup of a page from left to right, in time that grows with the page only: what a search has found is kept until it is passed."""

    def __init__(self, html: str):
        self.html, self.gt, self.known = html, -1, {}
        self.ends: dict[str, list[tuple[int, int]]] = {}
        for m in _ENDS.finditer(html):
            self.ends.setdefault(m[1].lower(), []).append(m.span())
        for spans in self.ends.values():
            spans.reverse()  # the next one is the last of its list
        self.quotes: dict[str, list[int]] = {}

    def _next_gt(self, at: int) -> int:
        if self.gt != len(self.html) and self.gt < at:
            self.gt = self.html.find(">", at)
            self.gt = len(self.html) if self.gt < 0 else self.gt
        return self.gt

    def _end_tag(self, name: str, at: int) -> int:
        spans = self.ends.get(name, [])
        while spans and spans[-1][0] < at:
            spans.pop()
        return spans[-1][1] if spans else -1

    def _closing(self, quote: str, at: int) -> int:
        if quote not in self.quotes:
            self.quotes[quote] = [m.start() for m in re.finditer(quote, self.html)]
        where = self.quotes[quote]
        i = bisect_right(where, at)
        return where[i] if i < len(where) else -1

    def _tag_end(self, at: int) -> int:
        """Place after the > that closes a tag whose attributes begin at ``at``; -1 if a < or the page's end comes first. > and <
        inside quotes don't count. Scans that meet at the same place go on alike, so each place is worked out once."""
        path, end = [], -1
        while m := _STOP.search(self.html, at):
            q = m.start()
            if q in self.known:
                end = self.known[q]
                break
            path.append(q)
            if m[0] in "<>":
                end = q + 1 if m[0] == ">" else -1
                break
            at = self._closing(m[0], q) + 1
            if not at:
                break
        for q in path:
            self.known[q] = end
        return end

    def match(self, at: int) -> tuple[int, str, str, bool] | None:
        """(place after it, name, attributes, whether it ends an element) of the markup at a <; None if it is text. What goes with its
        content has no name."""
        html = self.html
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            return (len(html) if end < 0 else end + 3), "", "", False
        if m := _KEPT_OUT.match(html, at):
            gt, name = self._next_gt(m.end()), (m[1] or m[2]).lower()
            if gt < len(html):
                if name == "svg" and html[gt - 1] == "/" and gt > m.end():
                    return gt + 1, "", "", False
                end = self._end_tag(name, gt + 1)
                if end >= 0 or m[1]:
                    return (len(html) if end < 0 else end), "", "", False
        if m := _TAG.match(html, at):
            end = self._tag_end(m.end())
            if end >= 0:
                return end, m[2].lower(), html[m.end() : end - 1], bool(m[1])
        if _BEGINS.match(html, at + 1):
            m = _ANGLE.search(html, at + 2)
            if not m:
                return len(html), "", "", False
            if m[0] == ">":
                return m.end(), "", "", False
        return None


def blocks(html: str | None) -> list[tuple[int, str]]:
    """``(zone, text)`` of each block in page order: ARTICLE inside an article or main element, MARKED inside an element whose
    name or attributes say it is no main text, HINTED inside an article in an element whose names only hint at that, OPEN
    elsewhere. Character references are decoded, white space is one space."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, int]] = []
    places: dict[str, list[int]] = {}  # of the open elements of a name in the stack
    zone, deep, at = OPEN, 0, 0  # deep: elements around in which even an article is not the page's own
    html = html or ""
    scan, seen = _Scanner(html), html.find("<")

    def push(name: str):
        places.setdefault(name, []).append(len(stack))
        stack.append((name, zone, deep))

    def flush():
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((zone, text))

    while seen >= 0:
        found = scan.match(seen)
        if not found:
            seen = html.find("<", seen + 1)
            continue
        if seen > at:
            parts.append(html[at:seen])
        at, name, attrs, ends = found
        seen = html.find("<", at)
        if not name:
            continue
        hidden, marked, comments, hinted = _marked(attrs) if attrs and not ends else (False, False, False, False)
        if name in INLINE and not (hidden or marked):
            if name in ("br", "img", "wbr"):
                parts.append(" " if name == "br" else "")
            elif places.get(name):  # inside a marked element of the same name: its end is not that one's
                if not ends:
                    push(name)
                    continue
            else:
                continue
            if name in VOID:
                continue
        flush()
        if name in VOID:
            continue
        if ends:
            if places.get(name):
                i = places[name][-1]
                _, zone, deep = stack[i]
                for inner, *_ in stack[i:]:
                    places[inner].pop()
                del stack[i:]
            continue
        push(name)
        marked = marked and name not in ("html", "body")
        deep += hidden or comments or name in DEEP
        if name in ("article", "main") and not deep:
            zone = ARTICLE
        elif deep or name in OUT or (name == "header" and zone not in (ARTICLE, HINTED)) or (marked and name not in ("article", "main")):
            zone = MARKED
        elif hinted and zone == ARTICLE:
            zone = HINTED
    if at < len(html):
        parts.append(html[at:])
    flush()
    return out
