"""Elements of a page in document order, and selectors over them.

A page is read once, front to back, into flat lists: each sign is looked at a bounded number of times and nothing recurses, so that time and memory grow
with the page alone, whatever it holds. An end tag closes the nearest open element of its name and what is open inside it; one without an open
element is ignored. A quotation mark that nothing closes is an ordinary sign of its value. A tag that the page's end cuts off is text, as is the
beginning of a comment, section or instruction without an end (up to the next >). An unknown marked section ends at the next >, as a comment without dashes does.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = ("script", "style", "template")
RAW = {name: re.compile(rf"</\s*+{name}\s*+>", re.I) for name in ("script", "style")}
_NAME = re.compile(r"[a-zA-Z][^\t\n\r\f />\x00]*+")
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>][^\s/=>]*+)(?:\s*+=[\s=]*+(?:'([^']*+)'|"([^"]*+)"|([^>\s]*+)))?+""")
_TAG_END = re.compile(r"[\s/]*+>")
_COMMENT_END = re.compile(r"--\s*+>")
_SECTION = re.compile(r"<!\[\s*+(?:(temp|cdata|ignore|include|rcdata)|if|else|endif)(?![\w.-])", re.I)
_SECTION_END = re.compile(r"\]\s*+\]\s*+>")
_CONDITION_END = re.compile(r"\]\s*+>")
_STEP = re.compile(r"(?:\[[^\]]*\]|[^\s\[])+")
_COMPOUND = re.compile(r"(?P<name>[a-z][a-z0-9]*)?(?P<rest>(?:\.[\w-]+|\[[^\]]+\])*)")
_PART = re.compile(r"\.([\w-]+)|\[([\w-]+)(?:(\*?=)'([^']*)'( i)?)?\]")


class Page:
    """``name``, ``attrs``, ``parent``, ``end`` (one past the last element inside) and ``texts`` (first, one past the last) by element."""

    def __init__(self, html: str):
        self.name: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.parent: list[int] = []
        self.end: list[int] = []
        self.texts: list[list[int]] = []
        self.text: list[str] = []
        self._stack: list[int] = []
        self._open: defaultdict[str, int] = defaultdict(int)
        self._silent = 0  # open elements whose inside is no text
        self._gone: set[re.Pattern] = set()  # ends that the rest of the page no longer holds
        self._read(html)
        while self._stack:
            self._pop()

    def _read(self, html: str) -> None:
        at = start = 0  # start: where the text not yet kept begins
        while (i := html.find("<", at)) >= 0:
            sign = html[i + 1 : i + 2]
            if not (sign.isascii() and (sign.isalpha() or sign in "/!?")) or not sign:
                at = i + 1  # a sign of the text
                continue
            self._keep(html[start:i])
            start = i
            at = self._tag(html, i) if sign.isalpha() else self._end_tag(html, i) if sign == "/" else self._other(html, i)
            if at < 0:  # cut off by the end of the page
                break
            start = at
        self._keep(html[start:])

    def _tag(self, html: str, i: int) -> int:
        """Reads the tag at ``i``; where it ends, or -1."""
        m = _NAME.match(html, i + 1)
        name, at, attrs = m.group().lower(), m.end(), {}
        while html[at : at + 1] != ">" and (m := _ATTRIBUTE.match(html, at)):  # most tags end here
            at = m.end()
            value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
            attrs.setdefault(m[1].lower(), unescape(value))
        m = _TAG_END.match(html, at)
        if not m:
            return -1
        self._start(name, attrs)
        if html[m.end() - 2] == "/" and m.end() - at > 1:
            self._close(name)
        elif name in RAW:  # the inside of a script is never markup, and none of it is text of the page
            m = RAW[name].search(html, m.end())
            self._close(name)
            return m.end() if m else len(html)
        return m.end()

    def _end_tag(self, html: str, i: int) -> int:
        m = _NAME.match(html, i + 2)
        at = html.find(">", m.end() if m else i + 2) + 1
        if m and at:
            self._close(m.group().lower())
        return at or -1

    def _other(self, html: str, i: int) -> int:
        """Comments, sections, declarations and instructions: nothing of them is kept."""
        if html.startswith("<!--", i):
            end, at = _COMMENT_END, i + 4
        elif m := _SECTION.match(html, i):
            end, at = (_SECTION_END if m[1] else _CONDITION_END), i + 3
        else:
            return html.find(">", i) + 1 or -1
        m = None if end in self._gone else end.search(html, at)
        if m:
            return m.end()
        self._gone.add(end)
        at = html.find(">", i) + 1
        if at:
            self._keep(html[i:at])
        return at or -1

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        i = len(self.name)
        self.name.append(tag)
        self.attrs.append(attrs)
        self.parent.append(self._stack[-1] if self._stack else -1)
        self.end.append(i + 1)
        self.texts.append([len(self.text), len(self.text)])
        if tag not in VOID:
            self._stack.append(i)
            self._open[tag] += 1
            self._silent += tag in SILENT

    def _close(self, tag: str) -> None:
        while self._open.get(tag):
            if self._pop() == tag:
                return

    def _pop(self) -> str:
        i = self._stack.pop()
        self.end[i], self.texts[i][1] = len(self.name), len(self.text)
        name = self.name[i]
        self._open[name] -= 1
        self._silent -= name in SILENT
        return name

    def _keep(self, data: str) -> None:
        if data and not self._silent and (data := unescape(data).strip()):
            self.text.append(data)

    def named(self, name: str) -> list[int]:
        """The elements of one name."""
        return [i for i, x in enumerate(self.name) if x == name]

    def text_of(self, i: int) -> str:
        """The pieces of text inside, each trimmed, joined."""
        return "".join(self.text[slice(*self.texts[i])])

    def first_of(self, found: list[int], i: int) -> int | None:
        """The first of the sorted elements that lies inside element ``i``."""
        at = bisect_right(found, i)
        return found[at] if at < len(found) and found[at] < self.end[i] else None


class Selector:
    """A list of alternatives, each a chain of ancestors down to the element: names, ``.class``, ``[attribute]``, ``='..'``, ``*='..'``, the last two also with ``i``."""

    def __init__(self, written: str):
        self.chains = [[self._compound(c) for c in _STEP.findall(alternative)] for alternative in written.split(",") if alternative.strip()]

    @staticmethod
    def _compound(written: str) -> tuple[str | None, list[tuple[str, str | None, str | None, bool]]]:
        m = _COMPOUND.fullmatch(written)
        if not m:
            raise ValueError(f"selector {written!r}")
        return m["name"], [("class", ".", c, False) if c else (a, op or None, v, bool(i)) for c, a, op, v, i in _PART.findall(m["rest"])]

    @staticmethod
    def _fits(page: Page, i: int, compound: tuple) -> bool:
        name, tests = compound
        if name and page.name[i] != name:
            return False
        for attr, op, want, fold in tests:
            have = page.attrs[i].get(attr)
            if have is None:
                return False
            if fold:
                have, want = have.lower(), want.lower()
            if op == "." and want not in have.split() or op == "=" and have != want or op == "*=" and (not want or want not in have):
                return False
        return True

    def all(self, page: Page) -> list[int]:
        """Elements that fit any alternative, in document order; one pass for each alternative, however deep the page is."""
        found: set[int] = set()
        for *above, last in self.chains:
            got = [0] * len(page.name) if above else []  # how many of the ancestors asked for lie on the way down to and with an element
            for i, up in enumerate(page.parent):
                met = got[up] if above and up >= 0 else 0
                if above:
                    got[i] = met + (met < len(above) and self._fits(page, i, above[met]))
                if met == len(above) and self._fits(page, i, last):
                    found.add(i)
        return sorted(found)

    def stems(self) -> list[str]:
        """A text for each alternative without which a page holds no match, in lower case."""
        out = []
        for chain in self.chains:
            name, tests = chain[-1]
            out.append(max([(w or a).lower() for a, _, w, _ in tests] or [f"<{name}"], key=len))
        return out
