"""HTML to text blocks, with Python's own tokenizer inside Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F, types as T

BLOCKS = frozenset("p div li ul ol h1 h2 h3 h4 h5 h6 table tr td th article section blockquote br".split())
SKIPPED = frozenset(("script", "style", "head"))


class Renderer(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, list[str]]] = [("text", [])]
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in SKIPPED
        if tag in BLOCKS:
            self.blocks.append((tag, []))

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in SKIPPED))
        if tag in BLOCKS:
            self.blocks.append(("text", []))

    def handle_data(self, data):
        if not self.skip:
            self.blocks[-1][1].append(data)


def render(html: str) -> list[dict]:
    """Blocks with text: their tag and the text, white space collapsed, entities decoded."""
    page = Renderer()
    page.feed(html)
    page.close()
    out = [{"kind": tag, "text": " ".join("".join(parts).split())} for tag, parts in page.blocks]
    return [b for b in out if b["text"]]


@F.pandas_udf(T.ArrayType(T.StructType().add("kind", "string").add("text", "string")))
def blocks_of(html: pd.Series) -> pd.Series:
    return html.map(lambda t: render(t or ""))
