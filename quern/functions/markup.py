"""HTML as plain text with light marks: headings, list items, quotes, code, links."""

from __future__ import annotations

import re
from html.parser import HTMLParser

# Fixed values.
_MARKS = {"title": "# ", "h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "h5": "#### ", "h6": "#### "}
_BREAKS = frozenset("address article aside body br dd details div dl dt fieldset figcaption figure footer form header hr html main nav ol p section summary table tbody thead ul".split())


class _Writer(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip, self.pre, self.links = 0, 0, []

    def put(self, s: str) -> None:
        self.out.append(s)

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in _MARKS:
            self.put("\n\n" + _MARKS[tag])
        elif tag == "li":
            self.put("\n- ")
        elif tag == "pre":
            self.pre += 1
            self.put("\n```\n")
        elif tag == "blockquote":
            self.put("\n> ")
        elif tag == "tr":
            self.put("\n")
        elif tag in ("td", "th"):
            if self.out and not self.out[-1].endswith("\n"):
                self.put(" | ")
        elif tag == "a":
            self.links.append(dict(attrs).get("href"))
        elif tag in _BREAKS:
            self.put("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in _MARKS:
            self.put("\n\n")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.put("\n```\n")
        elif tag == "a" and self.links:
            href = self.links.pop()
            if href and not self.skip:
                self.put(f" ({href})")
        elif tag in _BREAKS or tag in ("blockquote", "li"):
            self.put("\n")

    def handle_data(self, data):
        if self.skip:
            return
        if self.pre:
            self.put(data)
            return
        flat = re.sub(r"\s+", " ", data.replace("\xa0", " "))
        if flat.strip():
            last = self.out[-1][-1:] if self.out else "\n"
            glue = "" if last in (" ", "\n", "") or flat[0] in " .,;:!?)]}" else " "
            self.put(glue + flat)


def to_text(page: str | None) -> str:
    w = _Writer()
    w.feed(page or "")
    w.close()
    text = "\n".join(line.rstrip() for line in "".join(w.out).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip()
