"""HTML pages: quality predicate, text of an element, image address; Arrow UDFs over the standard library's parser."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that have no end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_REFERENCE = re.compile(r"&(?:(#[0-9]+;|#[xX][0-9a-fA-F]+;)|([A-Za-z0-9]+;))?")


@dataclass
class _Element:
    tag: str
    attrs: dict
    inner: list = field(default_factory=list)

    def all(self):
        """Elements inside, in the order of their start tags."""
        left = self.inner[::-1]
        while left:
            one = left.pop()
            yield one
            left += one.inner[::-1]

    def first(self, tag: str) -> _Element | None:
        return next((e for e in self.all() if e.tag == tag), None)

    def first_of_class(self, name: str) -> _Element | None:
        return next((e for e in self.all() if name in e.classes()), None)

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()


class _Tree(HTMLParser):
    """The elements of a page; an end tag closes what is open inside its element, or nothing."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = _Element("", {})
        self.open = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        one = _Element(tag, dict(attrs))
        self.open[-1].inner.append(one)
        if tag not in VOID:
            self.open.append(one)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].inner.append(_Element(tag, dict(attrs)))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return


def levels(page: str | None, header_class: str) -> list[int]:
    """The levels in classes `quality<level>` of the first element of header_class; none where there is no such element."""
    if not isinstance(page, str) or header_class not in page:
        return []
    head = _Tree(page).root.first_of_class(header_class)
    names = head.classes() if head else []
    return [int(n[7:]) for n in names if n.startswith("quality") and n[7:].isascii() and n[7:].isdigit()]


def image_source(page: str | None, holder_class: str) -> str | None:
    """The source of the first image in the first span in the first element of holder_class."""
    if not isinstance(page, str) or holder_class not in page:
        return None
    holder = _Tree(page).root.first_of_class(holder_class)
    span = holder.first("span") if holder else None
    image = span.first("img") if span else None
    return image.attrs.get("src") if image else None


def quality_levels(html: Column, header_class: str = "prp-page-qualityheader") -> Column:
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def found(pages: pd.Series) -> pd.Series:
        return pd.Series([levels(p, header_class) for p in pages], dtype="object")

    return found(html)


def proofread(html: Column, level: int = 4, header_class: str = "prp-page-qualityheader") -> Column:
    """Whether the page's header has the level, beside others or not."""
    return F.coalesce(F.array_contains(quality_levels(html, header_class), level), F.lit(False))


def image_url(html: Column, holder_class: str = "prp-page-image") -> Column:
    """https: and the source of the page's image; null where there is none."""

    @F.pandas_udf(T.StringType())
    def found(pages: pd.Series) -> pd.Series:
        return pd.Series([image_source(p, holder_class) for p in pages], dtype="object")

    return F.concat(F.lit("https:"), found(html))


class _Text(HTMLParser):
    """Text of the first element that `wanted` names by its tag and attributes."""

    def __init__(self, wanted):
        super().__init__(convert_charrefs=True)
        self.wanted, self.depth, self.done, self.found, self.parts, self.hidden = wanted, [], False, False, [], 0

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if self.found:
            if tag not in VOID:
                self.depth.append(tag)
        elif self.wanted(tag, dict(attrs)):
            self.found = True
            self.done = tag in VOID
            self.depth = [tag]

    def handle_endtag(self, tag):
        if self.found and not self.done and tag in self.depth:
            while self.depth and self.depth.pop() != tag:
                pass
            self.done = not self.depth

    def handle_data(self, data):
        if self.found and not self.done and not {"script", "style"} & set(self.depth[-1:]) and data.strip():
            self.parts.append(data.strip())


def page_parts(html: Column, level: int = 4, header_class: str = "prp-page-qualityheader", holder_class: str = "prp-page-image", text_class: str = "pagetext") -> Column:
    """struct<proofread,image,text> of a page, as proofread(), image_url() and element_text() give them, in one Arrow UDF.

    A page that isn't proofread isn't parsed for the others, which are null.
    """

    def wanted(name: str, attrs: dict) -> bool:
        return text_class in (attrs.get("class") or "").split()

    @F.pandas_udf(T.StructType([T.StructField("proofread", T.BooleanType()), T.StructField("image", T.StringType()), T.StructField("text", T.StringType())]))
    def found(pages: pd.Series) -> pd.DataFrame:
        good = [level in levels(p, header_class) for p in pages]
        image = [image_source(p, holder_class) if g else None for p, g in zip(pages, good, strict=True)]
        text = [first_text(p, wanted) if i is not None else None for p, i in zip(pages, image, strict=True)]
        return pd.DataFrame({"proofread": good, "image": pd.Series([None if i is None else f"https:{i}" for i in image], dtype="object"), "text": pd.Series(text, dtype="object")})

    return found(html)


def ended_references(page: str) -> str:
    """The page with each & that begins no reference ended by a semicolon as &amp;, so that a parser leaves it."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] or m[2] in html5 else f"&amp;{m[0][1:]}", page)


def first_text(page: str | None, wanted, bare: bool = True) -> str | None:
    """Text nodes, stripped, a line each, of the first element that `wanted` names; null where there is no such element.

    bare: whether references that lack their semicolon count, as in HTML (&amp< is &<); else they are text.
    """
    parser = _Text(wanted)
    if isinstance(page, str):
        parser.feed(page if bare else ended_references(page))
        parser.close()
    return "\n".join(parser.parts) if parser.found else None


def element_text(class_name: str | None = None, tag: str | None = None, bare: bool = True):
    """An Arrow UDF: the first such element's text nodes, stripped, a line each; null where there is no such element. bare: see first_text()."""

    def wanted(name: str, attrs: dict) -> bool:
        return (tag is None or name == tag) and (class_name is None or class_name in (attrs.get("class") or "").split())

    @F.pandas_udf(T.StringType())
    def text(pages: pd.Series) -> pd.Series:
        return pd.Series([first_text(p, wanted, bare) for p in pages], dtype="object")

    return text
