"""Pages as sequences of text blocks with their tag paths."""
from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

NAME = re.compile(r"(/?)([A-Za-z][A-Za-z0-9:-]*)")
NAMED = re.compile(r"""(?:\b(?:class|id|role)\s*=\s*)(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HUMP = re.compile("(?<=[a-z0-9])(?=[A-Z])")  # where a name in camel case begins its next word
RAW = frozenset(("script", "style"))  # what they hold is no text; any other element's text is
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
#: A start tag on the left ends an open element on the right.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
SCOPE = frozenset("table ul ol dl div article section aside nav main form body".split())
DEEP = 64  # open elements of a deeper path that count as features: the outer and the inner halves


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    linked: float


def _names(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    return tuple(f".{w}" for m in NAMED.finditer(attributes) for w in re.split(r"[^a-z0-9]+", HUMP.sub(" ", "".join(x or "" for x in m.groups())).lower()) if w)


class _Ends:
    """Where tags end: the first > outside quotes. What follows from each > or quote is kept, so a page costs one scan however many tags have no end."""

    def __init__(self, page: str):
        self.page, self.known, self.at, self.next = page, {}, 0, -2

    def event(self, at: int) -> int:
        """The first > or quote from a place on, -1 without one."""
        if not (self.next == -1 and at >= self.at) and not self.at <= at <= self.next:
            m = EVENT.search(self.page, at)
            self.at, self.next = at, m.start() if m else -1
        return self.next

    def end(self, at: int) -> int:
        """Of the tag whose name ends at a place; -1 if it has none."""
        path, e = [], self.event(at)
        while e >= 0 and e not in self.known and self.page[e] != ">":
            path.append(e)
            close = self.page.find(self.page[e], e + 1)
            e = self.event(close + 1) if close >= 0 else -1
        out = e if e < 0 or self.page[e] == ">" else self.known[e]
        for k in path:
            self.known[k] = out
        return out


EVENT = re.compile("[>\"']")


class _Stack:
    """Open elements, and how many there are of each name."""

    def __init__(self) -> None:
        self.items: list[tuple[str, tuple[str, ...]]] = []
        self.count: Counter[str] = Counter()

    def push(self, name: str, names: tuple[str, ...]) -> None:
        self.items.append((name, names))
        self.count[name] += 1

    def close(self, names: tuple[str, ...], scoped: bool) -> None:
        """The innermost of the names, and what it holds, closes; scoped: not past an element that bounds it."""
        if not any(self.count[n] for n in names):
            return
        for k in range(len(self.items) - 1, -1, -1):
            name = self.items[k][0]
            if name in names:
                for gone, _ in self.items[k:]:
                    self.count[gone] -= 1
                del self.items[k:]
                return
            if scoped and name in SCOPE:
                return

    def path(self) -> tuple[str, ...]:
        s = self.items
        return tuple(x for name, names in (s if len(s) <= DEEP else s[: DEEP // 2] + s[-DEEP // 2 :]) for x in (name, *names))


def blocks(page: str | None) -> list[Block]:
    """Every run of text between block boundaries, references decoded, white space as one space; scripts, styles and comments are not text. A < that begins no tag is text."""
    page = page or ""
    out: list[Block] = []
    stack, ends = _Stack(), _Ends(page)
    held: list[str] = []
    link, path, at, begun = 0, None, 0, 0

    def text_of(raw: str) -> None:
        nonlocal path, link
        if not raw or raw.isspace():
            held.append(" ")
            return
        if path is None:
            path = stack.path()
        held.append(raw)
        if any(s[0] == "a" for s in stack.items[-4:]):
            link += len(raw)

    def flush() -> None:
        nonlocal held, path, link
        if path is not None:
            raw = "".join(held)
            text = " ".join(html.unescape(raw).split())
            if text:
                out.append(Block(path, text, link / max(1, len(raw))))
        held, path, link = [], None, 0

    n, last = len(page), page.rfind(">")
    while True:
        at = page.find("<", at)
        if at < 0:
            text_of(page[begun:])
            break
        tag = NAME.match(page, at + 1)
        if tag:
            end = ends.end(tag.end())
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = end + 2 if end >= 0 else n - 1
        else:
            end = page.find(">", at) if page[at + 1 : at + 2] in ("!", "?") and at < last else -1
        if end < 0:
            at += 1
            continue
        text_of(page[begun:at])
        at = begun = end + 1
        if not tag:
            continue
        name = tag[2].lower()
        if tag[1]:
            if name in BLOCK:
                flush()
            stack.close((name,), False)
        elif name in RAW:
            close = CLOSE[name].search(page, at)
            at = begun = close.end() if close else n
        elif name == "br":
            held.append(" ")
        else:
            if name in BLOCK:
                flush()
                stack.close(("p",), True)
            if name in ENDS:
                stack.close(ENDS[name], True)
            if name not in VOID:
                stack.push(name, _names(page[tag.end() : end]))
    flush()
    return out


CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
