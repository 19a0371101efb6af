"""A scanner of HTML that reads every character a bounded number of times, however broken the page is."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*(?:([^\s/>][^\s/>=]*)(\s*=\s*)?)?")
_BARE = re.compile(r"[^\s>]*")
#: Elements whose content is no markup (fixed values).
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())

TEXT, START, END, CONTENT = "text", "start", "end", "content"


class Scanner:
    def __init__(self, source: str):
        self.source = source
        self.spent: set[str] = set()  # marks that don't occur any more

    def find(self, mark: str, at: int) -> int:
        """Place of a mark from `at` on, -1 if there is none; asked in rising order, a vain search isn't repeated."""
        if mark in self.spent:
            return -1
        found = self.source.find(mark, at)
        if found < 0:
            self.spent.add(mark)
        return found

    def attrs(self, at: int) -> tuple[dict[str, str], int]:
        """(attributes, place after the tag's end) of a tag from behind its name; the place is -1 for a tag that never ends."""
        source, out = self.source, {}
        while True:
            m = _ATTR.match(source, at)
            at = m.end()
            if m[1] is None:
                break
            value = ""
            if m[2] is not None:
                quote = source[at : at + 1]
                # a quote that is never closed ends where the tag does
                if quote in ("'", '"') and quote and (end := self.find(quote, at + 1)) >= 0:
                    value, at = source[at + 1 : end], end + 1
                else:
                    b = _BARE.match(source, at)
                    value, at = b[0], b.end()
            out.setdefault(m[1].lower(), html.unescape(value))
        return (out, at + 1) if source[at : at + 1] == ">" else (out, -1)

    def tokens(self) -> Iterator[tuple[str, str, dict[str, str]]]:
        """(kind, text or tag, attributes). The content of RAW elements comes as one CONTENT between their tags; comments and the like are left out.

        A tag or comment that never ends swallows the rest of the page, as in a browser.
        """
        source, at, done = self.source, 0, 0
        while (lt := source.find("<", at)) >= 0:
            mark = source[lt + 1 : lt + 2]
            closing = mark == "/"
            m = _NAME.match(source, lt + 1 + closing)
            if m is None:
                if mark in ("!", "?") and mark or closing:
                    if source.startswith("<!--", lt):
                        short = next((n for n in (">", "->") if source.startswith(n, lt + 4)), None)
                        end = lt + 4 + len(short) if short else self.find("-->", lt + 4) + 3
                        broken = not short and end == 2
                    else:
                        end = self.find(">", lt + 2) + 1
                        broken = end == 0
                    if lt > done:
                        yield TEXT, source[done:lt], {}
                    if broken:
                        return
                    at = done = end
                else:
                    at = lt + 1
                continue
            if lt > done:
                yield TEXT, source[done:lt], {}
            tag = m[0].lower()
            attrs, end = self.attrs(m.end())
            if end < 0:
                return
            at = done = end
            if closing:
                yield END, tag, {}
                continue
            yield START, tag, attrs
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                inner = source[at : stop.start()] if stop else source[at:]
                if inner:
                    yield CONTENT, inner, {}
                yield END, tag, {}
                if not stop:
                    return
                _, at = self.attrs(stop.end())
                if at < 0:
                    return
                done = at
        if done < len(source):
            yield TEXT, source[done:], {}
