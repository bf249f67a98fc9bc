"""Main text of web pages: boosted trees over DOM nodes, decoded so that ancestors and descendants agree.

Every block element and every text run gets the log-odds of being main text from trees over subtree density, attribute
tokens, depth, siblings and ancestors. Decoding chooses for each element whether all of it is main text, none is, or
its children decide, by dynamic programming over the summed log-likelihoods; so no run is kept below a dropped element
or dropped below a kept one. The trees are trained on ``sample_pages``, made by rule, with a fixed seed.

Defined cases: a null or empty page has an empty text; unclosed, misnested and unknown tags are read as browsers
mostly do; scripts, styles, templates, drawings, formulas, media and fields (``dom.HIDDEN``) are left out wherever they
stand, their fallback texts too; comments and these elements, left open, reach to the end of the page; whole pages are read, of any length; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkmill.llm import boosting
from larkmill.llm.batches import bound_batches
from larkmill.llm.dom import Nodes, features, parse
from larkmill.llm.sample_pages import MAIN, OTHER, labelled_pages

PAGES, SEED = 1000, 5
MIXED = -0.7  # what a node pays, in log-likelihood, for leaving the choice to its children
BATCH_CHARS = 4_000_000
_TRAINED: dict[tuple[int, int], boosting.Boosted] = {}


def training_nodes(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of the nodes of labelled pages, and whether most of their text is main text."""
    nodes, cache = Nodes(), {}
    for k, page in enumerate(labelled_pages(count, seed)):
        parse(page, k, nodes, cache)
    main = np.array([t.count(MAIN) > 0 for t in nodes.text])
    nodes.text = [t.replace(MAIN, "").replace(OTHER, "") for t in nodes.text]
    size = np.array([len(t) for t in nodes.text], dtype=np.float64)
    end, at = np.array(nodes.end), np.arange(len(size))
    total = np.r_[0, size.cumsum()]
    own = np.r_[0, (size * main).cumsum()]
    share = (own[end] - own[at]) / np.maximum(total[end] - total[at], 1)
    return features(nodes), (share > 0.5).astype(np.float64)


def trained(count: int = PAGES, seed: int = SEED) -> boosting.Boosted:
    """Trained once per process."""
    if (count, seed) not in _TRAINED:
        _TRAINED[count, seed] = boosting.fit(*training_nodes(count, seed))
    return _TRAINED[count, seed]


def decode(log_odds: np.ndarray, parent: list[int], end: list[int]) -> list[bool]:
    """Whether each node is main text: whole subtrees are kept or dropped, or a node's children decide."""
    keep = -np.logaddexp(0, -log_odds)
    drop = -np.logaddexp(0, log_odds)
    at, ends = np.arange(len(parent)), np.array(end)
    both = []
    for x in (keep, drop):
        total = np.r_[0, x.cumsum()]
        both.append((total[ends] - total[at]).tolist())
    all_keep, all_drop = both
    below = [0.0] * len(parent)
    choice = bytearray(len(parent))
    for k in range(len(parent) - 1, -1, -1):
        best, choice[k] = (all_keep[k], 1) if all_keep[k] >= all_drop[k] else (all_drop[k], 0)
        if end[k] > k + 1 and (own := MIXED + below[k]) > best:
            best, choice[k] = own, 2
        if parent[k] >= 0:
            below[parent[k]] += best
    for k, p in enumerate(parent):
        if p >= 0 and choice[p] != 2:
            choice[k] = choice[p]
    return [c == 1 for c in choice]


def extract(pages: list[str | None], model: boosting.Boosted | None = None) -> list[str]:
    """The main text of each page."""
    model, nodes, cache = model or trained(), Nodes(), {}
    for k, page in enumerate(pages):
        parse(page, k, nodes, cache)
    kept = decode(model.log_odds(features(nodes)), nodes.parent, nodes.end) if pages else []
    out: list[list[str]] = [[] for _ in pages]
    for page, text, main in zip(nodes.page, nodes.text, kept, strict=True):
        if main and text:
            out[page].append(text)
    return [" ".join(parts) for parts in out]


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page. The trees, of fixed size, are broadcast."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            part: list[str | None] = []
            size = 0
            for value in batch.column("html"):
                source = value.as_py()
                part.append(source)
                size += len(source or "")
                if size > BATCH_CHARS:
                    texts += extract(part, shared.value)
                    part, size = [], 0
            texts += extract(part, shared.value) if part else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    slim = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    found = slim.mapInArrow(run, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
