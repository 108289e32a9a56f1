"""Leaf blocks of marked-up documents, with struck text, anchors and amendment notes."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.labels import amendment

#: Block elements, elements of struck text.
BLOCKS, STRUCK = frozenset(["p", "td", "li"]), frozenset(["strike", "s", "del"])
#: Pages whose blocks a task holds at a time.
PAGES = 64
#: A start tag of the first kind ends an open block of the second.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "p"}, "tr": {"td", "p"}, "div": {"p"}, "ul": {"p"}, "table": {"p"}}


def clean(text: str) -> str:
    return " ".join(text.split())


class _Collector(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.struck = self.silent = 0
        self.found: list[dict] = []
        self.count = 0

    def _finish(self, depth: int) -> None:
        while len(self.open) > depth:
            block = self.open.pop()
            if not block["outer"]:
                self.found.append(block)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth]["tag"] in ENDS.get(tag, ()):
                if tag == "li" and self.open[depth]["lists"] or tag in ("td", "tr") and self.open[depth]["tables"]:
                    break
                self._finish(depth)
                break
        if tag in BLOCKS:
            for block in self.open:
                block["outer"] = True
            self.open.append({"tag": tag, "at": self.count, "outer": False, "parts": [], "anchors": [], "lists": 0, "tables": 0})
            self.count += 1
        elif tag in STRUCK:
            self.struck += 1
        elif tag in ("script", "style"):
            self.silent += 1
        elif self.open and tag in ("ul", "ol"):
            self.open[-1]["lists"] += 1
        elif self.open and tag == "table":
            self.open[-1]["tables"] += 1
        elif tag == "a":
            name = dict(attrs).get("name")
            for block in self.open if name else ():
                block["anchors"].append(name.lower())

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            for depth in range(len(self.open) - 1, -1, -1):
                if self.open[depth]["tag"] == tag:
                    self._finish(depth)
                    break
        elif tag in STRUCK:
            self.struck = max(0, self.struck - 1)
        elif tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)

    def handle_data(self, data: str) -> None:
        if self.open and not self.silent:
            for block in self.open:
                block["parts"].append((data, self.struck > 0))


def leaf_blocks(page: str) -> list[dict]:
    """Blocks that hold no other block, in document order; empty ones are left out.

    A block whose whole text is struck is a superseded wording and keeps it;
    from others the struck part goes.  The first amendment note is cut out.
    """
    collector = _Collector()
    collector.feed(page)
    collector.close()
    collector._finish(0)
    out = []
    for block in sorted(collector.found, key=lambda b: b["at"]):
        whole = clean("".join(text for text, _ in block["parts"]))
        alive = clean("".join(text for text, struck in block["parts"] if not struck))
        if not whole:
            continue
        text, note, action, year = alive or whole, None, None, None
        if found := amendment(text):
            begin, end, action, year = found
            note, text = text[begin:end], clean(text[:begin] + text[end:])
        out.append({"pos": len(out), "text": text, "struck": not alive, "anchors": block["anchors"], "note": note, "action": action, "year": year})
    return out


def decode(content: bytes, encoding: str | None = None) -> str:
    """A given encoding wins; else UTF-8 if it is valid, else Windows-1252 with replacements."""
    if encoding:
        return content.decode(encoding)
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("cp1252", "replace")


def decoded(content: Column) -> Column:
    """``decode`` as a column; Windows-1252 is not among the encodings that Spark reads by itself."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda c: None if c is None else decode(c))

    return run(content)


def blocks(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """(keys..., pos, text, struck, anchors, note, action, year): a row for each leaf block."""
    kept = pages.select(*keys, F.col(html).alias("_html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (batch.iloc[at : at + PAGES] for batch in batches for at in range(0, len(batch), PAGES)):
            rows = [{**{k: row[k] for k in keys}, **block} for row in part.to_dict("records") for block in leaf_blocks(row["_html"] or "")]
            if rows:
                out = pd.DataFrame(rows)
                out["year"] = out["year"].astype("Int32")
                yield out[[*keys, "pos", "text", "struck", "anchors", "note", "action", "year"]]

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keys)
    return kept.mapInPandas(run, f"{head}, pos int, text string, struck boolean, anchors array<string>, note string, action string, year int")
