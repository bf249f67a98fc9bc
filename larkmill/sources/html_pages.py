"""List pages of portals: postings by selector tables, over stored HTML."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where portal families keep the parts of a posting.
LIST_SELECTORS = {
    "greenhouse": {"job_container": ".opening", "title": "a", "location": ".location", "department": ".department",
                   "link": "a", "description": ".content"},
    "lever": {"job_container": ".posting", "title": ".posting-name h5", "location": ".posting-categories .location",
              "department": ".posting-categories .department", "job_type": ".posting-categories .commitment",
              "link": "a.posting-btn-submit", "description": ".posting-description"},
    "workday": {"job_container": '[data-automation-id="jobPostingItem"]', "title": '[data-automation-id="jobPostingTitle"]',
                "location": '[data-automation-id="jobPostingLocation"]',
                "link": '[data-automation-id="jobPostingTitle"] a',
                "description": '[data-automation-id="jobPostingDescription"]'},
}
DETAIL_SELECTORS = {
    "greenhouse": {"title": "#header h1", "location": ".location", "department": ".department",
                   "description": "#content .section-wrapper"},
    "lever": {"title": ".posting-headline h2", "location": ".posting-headline .location",
              "department": ".posting-headline .department", "description": ".section-wrapper .posting-description"},
    "workday": {"title": '[data-automation-id="jobPostingHeader"]', "location": '[data-automation-id="locations"]',
                "description": '[data-automation-id="jobPostingDescription"]'},
}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Element:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list = []

    def text(self) -> str:
        return " ".join(" ".join(self._texts()).split())

    def _texts(self) -> Iterator[str]:
        for part in self.parts:
            if isinstance(part, str):
                yield part
            else:
                yield from part._texts()

    def below(self) -> Iterator[Element]:
        for part in self.parts:
            if isinstance(part, Element):
                yield part
                yield from part.below()

    def fits(self, simple: str) -> bool:
        if simple.startswith("["):
            name, _, value = simple[1:-1].partition("=")
            return self.attrs.get(name) == value.strip("\"'")
        head, *classes = simple.split(".")
        tag, _, name = head.partition("#")
        own = self.attrs.get("class", "").split()
        return (not tag or tag == self.tag) and (not name or self.attrs.get("id") == name) and all(c in own for c in classes)

    def select(self, selector: str) -> list[Element]:
        """Descendants that fit a selector of simple parts with blanks between: tag, #id, .class, [attribute=value]."""
        *above, last = selector.split()
        return [x for x in self.below() if x.fits(last) and x._under(above, self)]

    def _under(self, above: list[str], top: Element) -> bool:
        node = self.parent
        for part in reversed(above):
            while node is not None and not node.fits(part):
                node = node.parent if node is not top else None
            if node is None:
                return False
            node = node.parent
        return True


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None:
            self.at = node.parent or self.root

    def handle_data(self, data):
        self.at.parts.append(data)


def tree(html: str | None) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def postings(html: str | None, selectors: dict[str, str]) -> list[dict[str, str | None]]:
    """Fields of each posting; the link is an attribute, the others are texts. Postings without a title are skipped."""
    out = []
    for box in tree(html).select(selectors["job_container"]):
        row = {}
        for name, selector in selectors.items():
            if name != "job_container":
                hit = next(iter(box.select(selector)), None)
                row[name] = None if hit is None else hit.attrs.get("href") if name == "link" else hit.text()
        if row.get("title"):
            out.append(row)
    return out


def read_postings(pages: DataFrame, page_id: str, url: str, html: str, selectors: dict[str, str]) -> DataFrame:
    """(page_id, position, title, location, department, link, description), the link made absolute by the page's own
    address, or by a slug of the title where there is none."""
    fields = ("title", "location", "department", "link", "description")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (key, base, i, *(row.get(f) for f in fields))
                for key, base, body in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for i, row in enumerate(postings(body, selectors))
            ]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64(), pa.string(), pa.int64()] + [pa.string()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "base", "position", *fields]
            )

    from larkmill.functions.text import slug
    from larkmill.functions.urls import absolute

    slim = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("base"), F.col(html).alias("html"))
    found = slim.mapInArrow(
        run, "page_id long, base string, position long, title string, location string, department string, link string, description string"
    )
    made = F.coalesce(
        F.nullif(F.col("link"), F.lit("")), F.concat(F.lit("/"), slug(F.col("title")))
    )
    return found.withColumn("link", absolute(made, F.col("base"))).drop("base")


def within_pages(df: DataFrame, page: str, most: int, total: str | None = None) -> DataFrame:
    """Pages a crawl would take: up to the limit, and up to the listing's own total."""
    kept = df.where(F.col(page) <= most)
    return kept if total is None else kept.where(F.col(page) <= F.col(total))
