"""Page tokens against the standard library's parser and in time by length; language samples of repeated rows."""

import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkmill.llm.dom import HIDDEN, NESTING, SELF_CLOSED, Nodes, parse, tokens
from larkmill.llm.language import UNDETERMINED, held_out, identify, learn


class Walker(HTMLParser):
    """Tags and texts outside hidden elements, as the slow twin sees them."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.found, self.hidden, self.depth = [], None, 0

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            self.depth += tag == self.hidden and tag in NESTING
        elif tag in HIDDEN:
            self.hidden, self.depth = tag, 1
        else:
            self.found.append(f"<{tag}")

    def handle_startendtag(self, tag, attrs):
        if tag not in SELF_CLOSED:
            self.handle_starttag(tag, attrs)
        elif not self.hidden:
            self.found.append(f"<{tag}")

    def handle_endtag(self, tag):
        if self.hidden:
            self.depth -= tag == self.hidden
            self.hidden = self.hidden if self.depth else None
        else:
            self.found.append(f"</{tag}")

    def handle_data(self, data):
        if not self.hidden:
            self.found.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")


def merged(parts):
    out = []
    for part in parts:
        if out and not part.startswith("<") and not out[-1].startswith("<"):
            out[-1] += part
        elif part:
            out.append(part)
    return out


def mine(source):
    out, at = [], 0
    for start, end, name, closing, _ in tokens(source):
        out.append(source[at:start])
        if name:
            out.append(f"</{name}" if closing else f"<{name}")
        at = end
    return merged([*out, source[at:]])


def test_tokens_match_the_standard_parser():
    rnd = random.Random(11)
    parts = [
        "<p>", "</p>", "<DIV class='a > b'>", "</div>", '<a href="x>y" id=k>', "</a>", "text", " more ", "&amp;", "<!-- a <p> b -->", "<br/>",
        "<svg>", "</svg>", '<svg class="x"/>', "<math>", "</math >", "<math/>", "<script>if (a < b) c();</script>", "<style>p > a</style>", "<b >",
        "<object>", "</object>", "<select>", "</select>", "<canvas>", "</canvas>", "<!doctype html>", "<x-y z>", "</x-y>", "\n",
    ]
    for _ in range(5000):
        source = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        walker = Walker()
        walker.feed(source)
        walker.close()
        assert mine(source) == merged(walker.found), source


def test_self_closed_drawings_hide_nothing():
    for inner in ('<svg class="x"/>', "<math/>", "<svg><svg></svg>no</svg>", "<svg><path/></svg>"):
        nodes = Nodes()
        parse(f"<article><p>one</p>{inner}<p>two</p></article>", 0, nodes, {})
        assert [t for t in nodes.text if t] == ["one", "two"]


@pytest.mark.parametrize("tail", ["", ">", "-->"])
@pytest.mark.parametrize(
    "part", ["<p", "<a ", '<a b="', "<a b='x", "<svg ", "<svg>", "<!", "<!--", "<![CDATA[", "<script ", "</script ", "<script></script ", "<", "</", "<p class='", "<svg/>", "a b=c ", "<p>"]
)
def test_parsing_time_follows_length(part, tail):
    begun = time.perf_counter()
    parse(part * 100_000 + tail, 0, Nodes(), {})
    parse("<p " + part * 100_000 + tail, 0, Nodes(), {})
    assert time.perf_counter() - begun < 15


def test_repeated_rows_change_no_language(spark, small):
    """100,000 copies of a text in every language: the rest still teaches, as on the plain table."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    langs = [r["lang"] for r in docs.select("lang").distinct().collect()]
    first = docs.groupBy("lang").agg(F.min("doc_id").alias("doc_id")).where("lang is not null")
    copies = docs.join(first, ["lang", "doc_id"]).select("doc_id", "text", "lang", "source", "n_chars").crossJoin(spark.range(100_000 // len(langs)).drop("id").select(F.lit(1).alias("k"))).drop("k")
    teach = docs.union(copies).where(~held_out(F.col("doc_id")))
    model = learn(teach)
    assert model.langs == sorted(langs)
    asked = docs.where(held_out(F.col("doc_id")))
    want = {r["doc_id"]: r["lang"] for r in asked.collect()}
    got = {r["doc_id"]: r["lang_pred"] for r in identify(asked, model).collect()}
    assert np.mean([got[i] == want[i] for i in want]) > 0.95
    plain = learn(docs.where(~held_out(F.col("doc_id"))))
    assert plain.langs == model.langs and np.allclose(plain.prob, model.prob, rtol=0.2, atol=1e-4)


def test_every_language_with_a_word_is_drawn(spark):
    rows = [(i, f"word{i} and more", "big") for i in range(3000)] + [(5000, "ein wort", "rare"), (5001, " \n", "blank"), (5002, None, "null")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = learn(docs, sample_docs=1)
    assert model.langs == ["big", "rare"]
    got = {r["doc_id"]: r["lang_pred"] for r in identify(docs, model).collect()}
    assert got[5000] == "rare" and got[0] == "big" and got[5001] == got[5002] == UNDETERMINED
    assert learn(docs.where("doc_id > 5000")) is None
