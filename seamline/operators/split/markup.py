"""Landmarks, scripts and styles of HTML files."""

from __future__ import annotations

from html.parser import HTMLParser

from seamline.operators.split.base import Analysis, Region, assemble, collapse

LANDMARKS = frozenset("header main nav section form template article aside footer".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Open:
    def __init__(self, tag: str, attributes: list[tuple[str, str | None]], line: int) -> None:
        self.tag, self.line, self.said, self.heading, self.in_heading = tag, line, "", "", False
        self.attributes = {k: collapse(v or "") for k, v in reversed(attributes)}

    def name(self) -> str:
        """tag#id, tag "label", tag.class, tag "heading", or the tag."""
        get = self.attributes.get
        if get("id"):
            return f"{self.tag}#{get('id')}"
        if get("aria-label"):
            return f'{self.tag} "{get("aria-label")}"'
        if get("class"):
            return f"{self.tag}.{get('class').split(' ')[0]}"
        heading = collapse(self.heading)
        return f'{self.tag} "{heading}"' if heading else self.tag


class _Reader(HTMLParser):
    """Keeps the outermost landmark, and scripts and styles outside landmarks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.stack: list[_Open] = []
        self.regions: list[Region] = []
        self.landmark: _Open | None = None
        self.unclosed = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            return
        here = _Open(tag, attrs, self.getpos()[0])
        self.stack.append(here)
        if self.landmark is None and tag in LANDMARKS:
            self.landmark = here
        elif self.landmark is not None and tag in HEADINGS and not self.landmark.heading:
            self.landmark.in_heading = True

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if self.landmark is None and tag in LANDMARKS:
            line = self.getpos()[0]
            self.regions.append(Region(line, line, "template" if tag == "template" else "section", _Open(tag, attrs, line).name()))

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].tag == tag), None)
        if at is None:
            return
        here, line = self.stack[at], self.getpos()[0]
        if self.landmark in self.stack[at + 1 :]:
            self.unclosed, self.landmark = True, None  # its end never came
        del self.stack[at:]
        if tag in HEADINGS and self.landmark is not None:
            self.landmark.in_heading = False
        if here is self.landmark:
            self.landmark = None
            self.regions.append(Region(here.line, line, "template" if tag == "template" else "section", here.name()))
        elif self.landmark is None and tag in ("script", "style") and here.said.strip():
            self.regions.append(Region(here.line, line, "style" if tag == "style" else "section", here.name()))

    def handle_data(self, data: str) -> None:
        if self.stack:
            self.stack[-1].said += data
        if self.landmark is not None and self.landmark.in_heading:
            self.landmark.heading += f" {data}"


def split_markup(file: str, source: str, language: str = "html") -> Analysis:
    reader = _Reader()
    reader.feed(source)
    reader.close()
    return assemble(file, source, language, reader.regions, reader.unclosed or reader.landmark is not None)
