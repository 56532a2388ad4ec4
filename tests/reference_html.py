"""Paragraph text by way of Python's own HTML parser, as an independent answer."""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}


class _Tree(HTMLParser):
    def __init__(self, wanted):
        super().__init__(convert_charrefs=True)
        self.wanted, self.open, self.parts = wanted, [], []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.open.append(tag)
        if tag in self.wanted:
            self.parts.append("")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if {"script", "style"} & set(self.open):
            return
        if set(self.wanted) & set(self.open):
            self.parts[-1] += data


def paragraphs_text(page: str, wanted=("p",)) -> str:
    tree = _Tree(wanted)
    cut = page[: page.rfind("<")] if page.rfind("<") > page.rfind(">") and re.search(r"<[a-zA-Z/!]", page[page.rfind("<"):]) else page
    tree.feed(cut)
    tree.close()
    return "".join(re.sub("\n+", "\n", p) for p in tree.parts)
