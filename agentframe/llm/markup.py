"""A forgiving reader of HTML pages: elements with generalised paths, and blocks of text, in one pass over the page.

Time and memory are linear in the page's length: end tags without a start are ignored by counts of what is open, inline elements are not kept, and paths are hashes that grow
from their parent's.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import xxhash

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Their content is never a part of an article.
HARD = frozenset("script style textarea title iframe noembed noframes xmp noscript template svg math object audio video canvas nav menu aside footer dialog button select option datalist head map".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p "
    "pre section select summary svg table tbody td template tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD_ONLY = frozenset("meta link title script style base noscript template".split())
#: What a start tag ends if it is open on top, besides a paragraph.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "tbody": {"td", "th", "tr", "tbody", "thead", "caption"},
    "tfoot": {"td", "th", "tr", "tbody", "thead"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
}
#: Words of class and id names that say what an element is, whole or as the beginning of a compound.
WHOLE = frozenset(
    "ad ads adv adbox adslot nav menu navigation breadcrumb sidenav aside rail footer header masthead topbar toolbar banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login comment comments reply replies respond responses disqus discussion share sharing social related recommended recommendations promo promotion sponsor sponsored pagination pager copyright disclaimer privacy".split()
)
BEGINNINGS = ("advert", "sidebar", "comment", "cookie", "footer", "navbar", "navmenu", "menubar", "breadcrumb", "newsletter", "sponsor")
DISCUSSION = frozenset("comment comments reply replies respond responses disqus discussion".split())
UNSAID = frozenset("has with without no not non is hide show".split())
STATES = frozenset("open opened closed active enabled disabled visible fixed on off free less".split())
GOOD = frozenset("article articlebody content post entry story main body maincontent text".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar tooltip".split())

_ATTRIBUTES = r"""(?:[^'">]|"[^"]*"|'[^']*')*+"""
_STRICT = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])([^\s=/"'>]++)\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]++)""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_DIGITS = re.compile(r"\d+")


def _judged(word: str) -> tuple[str, bool]:
    """What a class word says: 'header', 'discussion', 'other' boilerplate or nothing; and whether it names an article."""
    tokens = [t.lower() for t in _WORDS.findall(word)]
    if not tokens or tokens[0] in UNSAID or tokens[-1] in STATES:
        return "", False
    bad = [t for t in tokens if t in WHOLE or t.startswith(BEGINNINGS)] or (tokens[:1] if word.lower() == "hidden" or tokens[0] in ("widget", "widgets") else [])
    if not bad:
        return "", bool(GOOD.intersection(tokens))
    if any(t in DISCUSSION or t.startswith("comment") for t in bad):
        return "discussion", False
    return ("header" if set(bad) <= {"header", "masthead"} else "other"), False


@lru_cache(maxsize=4096)
def described(tag: str, attributes: str) -> tuple[str, str, bool]:
    """(label, boilerplate kind, names an article) of a start tag; the label is the tag with its class words, digits generalised."""
    found = {m[1].lower(): html.unescape(m[2].strip("\"'")) for m in _ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
    classes = found.get("class", "").split()
    label = tag + "".join(f".{w}" for w in sorted({_DIGITS.sub("#", c) for c in classes}))
    kind, good = "", tag in ("article", "main") or found.get("role", "").lower() in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
    for word in [*classes, found.get("id", "")]:
        said, praised = _judged(word)
        if tag in ("html", "body", "main") or (tag == "article" and not (_WORDS.findall(word) or [""])[0].lower().startswith(("ad", "comment", "reply", "related", "promo", "sponsor"))):
            said = ""
        kind, good = kind or said, good or praised
    if tag not in ("html", "body", "main", "article"):
        if found.get("role", "").lower() in ROLES or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "").lower()) or re.search(r"(?:^|\s)hidden(?=[\s=/]|$)", attributes.lower()):
            kind = "other"
        kind = kind or {"header": "header", "form": "other", "fieldset": "other", "legend": "other"}.get(tag, "")
    return label if len(label) <= 200 else f"{tag}.~{xxhash.xxh64_hexdigest(label)}", kind, good and not kind


class Page:
    """A page's elements and blocks in page order.

    tags, labels, parents, paths (64-bit hashes), kinds, good: by element; 0 is the root. blocks: (element, text, characters in links).
    """

    def __init__(self, source: str):
        self.tags, self.labels, self.parents, self.paths, self.kinds, self.good = ["#root"], ["#root"], [-1], [xxhash.xxh64_intdigest("#root")], [""], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._stack, self._open, self._skips = [0], {}, 0
        self._text: list[str] = []
        self._link, self._linked, self._inline = False, 0, None
        self._read(source)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._stack[-1], text, min(self._linked, len(text))))
            self._text.clear()
        self._linked = 0

    def _push(self, tag: str, attributes: str) -> None:
        label, kind, good = described(tag, attributes) if len(attributes) < 2000 else described.__wrapped__(tag, attributes)
        parent = self._stack[-1]
        self._stack.append(len(self.tags))
        self.tags.append(tag)
        self.labels.append(label)
        self.parents.append(parent)
        self.paths.append(xxhash.xxh64_intdigest(label, self.paths[parent]))
        self.kinds.append(kind)
        self.good.append(good)
        self._open[tag] = self._open.get(tag, 0) + 1
        self._skips += tag in HARD

    def _pop(self) -> None:
        tag = self.tags[self._stack.pop()]
        self._open[tag] -= 1
        self._skips -= tag in HARD

    def _start(self, tag: str, attributes: str) -> None:
        if tag not in BLOCKS:
            if tag == "a":
                self._link = True
            elif tag == "br":
                self._text.append(" ")
            elif self._inline and self._inline[0] == tag:
                self._inline[1] += 1
            elif not self._inline and tag not in VOID and ("=" in attributes or "hidden" in attributes) and described(tag, attributes)[1] in ("other", "discussion"):
                self._inline = [tag, 1]
            return
        self._inline, self._link = None, False
        self._flush()
        top = self.tags[self._stack[-1]]
        if top == "head" and tag not in HEAD_ONLY or top == "p" or top in HEADINGS and tag in HEADINGS:
            self._pop()
        ends = ENDS.get(tag, ())
        while self.tags[self._stack[-1]] in ends:
            self._pop()
        if tag != "hr":
            self._push(tag, attributes)

    def _end(self, tag: str) -> None:
        if tag not in BLOCKS:
            if tag == "a":
                self._link = False
            elif self._inline and self._inline[0] == tag:
                self._inline[1] -= 1
                if not self._inline[1]:
                    self._inline = None
            return
        self._flush()
        if self._open.get(tag):
            self._inline, self._link = None, False
            while self.tags[self._stack[-1]] != tag:
                self._pop()
            self._pop()

    def _say(self, text: str) -> None:
        if self._skips or self._inline:
            return
        if "&" in text:
            text = html.unescape(text)
        self._text.append(text)
        if self._link:
            self._linked += len(" ".join(text.split()))

    def _read(self, source: str) -> None:
        at, n, quoted = 0, len(source), True
        while at < n:
            sign = source.find("<", at)
            if sign < 0:
                self._say(source[at:])
                break
            if sign > at:
                self._say(source[at:sign])
            head = source[sign + 1 : sign + 4]
            if head.startswith("!--"):
                end = source.find("-->", sign + 2)
                at = n if end < 0 else end + 3
                continue
            if head[:1] in ("!", "?"):
                end = source.find(">", sign)
                at = n if end < 0 else end + 1
                continue
            name = _NAME.match(source, sign)
            if name is None:
                self._say("<")
                at = sign + 1
                continue
            found = _STRICT.match(source, sign) if quoted else None
            if found is None:  # a quote that nothing closes: from here on a tag ends at the next bracket
                quoted = False
                end = source.find(">", sign)
                if end < 0:
                    break
                close, tag, attributes, at = name[1], name[2].lower(), source[name.end() : end], end + 1
            else:
                close, tag, attributes, at = found[1], found[2].lower(), found[3], found.end()
            if close:
                self._end(tag)
            elif tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(source, at)
                if end is None:
                    break
                shut = source.find(">", end.end())
                at = n if shut < 0 else shut + 1
            elif not (tag in ("svg", "math") and attributes.endswith("/")):
                self._start(tag, attributes)
        self._flush()
