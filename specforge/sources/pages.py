"""Product pages: a name, short paragraphs and pairs of label and value, from the elements of a page once they are closed."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from ..fixed import HTML_SITE

CELLS, TEXTS, HIDDEN = {"td", "th"}, {"h1", "title", "p", "dt", "dd", "td", "th"}, {"script", "style", "noscript"}
#: What an opening tag closes, as page writers may leave the end tags out.
CLOSES = {"tr": {"td", "th", "tr", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "p": {"p"}, "table": {"p"}, "dl": {"p"}, "h1": {"p"}}
#: Elements beyond which nothing is closed.
WALLS = {"table", "dl"}
LABEL_MOST, PARAGRAPH_LEAST, PARAGRAPHS = 60, 40, 3


class Page(HTMLParser):
    """Open elements on a stack, each with the text inside it, that of inner elements too. Rows keep their cells."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list]] = []
        self.hidden = 0
        self.closed: dict[str, list[str]] = {"h1": [], "title": [], "p": []}
        self.pairs: list[tuple[str, str]] = []
        self.term: str | None = None

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in TEXTS or tag == "tr" or tag in WALLS:
            while self.open and self.open[-1][0] in CLOSES.get(tag, ()):
                self._close()
            self.open.append((tag, []))

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
            return
        names = [name for name, _ in self.open]
        reach = max((i for i, name in enumerate(names) if name in WALLS and name != tag), default=-1)
        if tag in names[reach + 1 :]:
            while self._close() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            for name, parts in self.open:
                if name in TEXTS:
                    parts.append(data)

    def close(self) -> None:
        super().close()
        while self.open:
            self._close()

    def _close(self) -> str:
        tag, parts = self.open.pop()
        if tag == "tr":
            if len(parts) == 2:
                self.pairs.append(tuple(parts))
        elif tag in TEXTS:
            text = " ".join("".join(parts).split())
            row = next((own for name, own in reversed(self.open) if name == "tr" or name in WALLS), None)
            if tag in self.closed:
                self.closed[tag].append(text)
            elif tag in CELLS:
                if row is not None:
                    row.append(text)
            elif tag == "dt":
                self.term = text
            elif self.term:
                self.pairs.append((self.term, text))
                self.term = None
        return tag


#: An ampersand that begins no reference with a semicolon at its end.
UNCLOSED = re.compile(r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)")


def page(html: str | None, closed: bool = False) -> dict | None:
    """name, description and attributes of a product page; null without a heading or title.

    References without a semicolon (`&amp` before a tag) are read as browsers do; with closed they stay as they are.
    """
    read = Page()
    read.feed(UNCLOSED.sub("&amp;", html or "") if closed else html or "")
    read.close()
    name = next((t for t in read.closed["h1"] + read.closed["title"] if t), "")
    if not name:
        return None
    for site in HTML_SITE:
        name = re.sub(site, "", name).strip()
    attributes = {k.rstrip(":"): v for k, v in read.pairs if k and v and len(k) < LABEL_MOST}
    return {"name": name, "description": " ".join([t for t in read.closed["p"] if len(t) > PARAGRAPH_LEAST][:PARAGRAPHS]), "attributes": attributes}
