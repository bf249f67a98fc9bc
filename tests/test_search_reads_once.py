"""A search reads the index once, whatever blocks its bounds leave open; words and packed numbers come back as they were."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from larkmill.operators.text_index import IndexRules, TextIndex, Vocabulary, pack, unpacked, words_of


def test_a_search_reads_the_index_once(spark, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/i", IndexRules(buckets=4, block_docs=8))
    index.append(spark.createDataFrame([(i, f"word{i % 5} text{i} word{i % 7}") for i in range(60)], "doc_id long, text string"))
    asked = spark.createDataFrame([(1, ["word1", "word2"])], "q long, terms array<string>")
    for found in (index.top_k(asked, "q", F.col("terms"), 3, first_blocks=1), index.matches(asked, "q", F.col("terms"))):
        assert "Relation" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_words_and_packed_numbers():
    every = re.compile(r"[^\W_]+")
    rnd = random.Random(4)
    texts = ["a_b C\x1fD\x1c9 \x0bx", "Straße_é İI ²x ΑΣ'Α 日本_語", "", "_"] + ["".join(chr(rnd.randrange(1, 0x3000)) for _ in range(500)) for _ in range(20)]
    assert [words_of(x) for x in texts] == [every.findall(x) for x in texts]
    words = Vocabulary(8)
    assert [words.words[words[w]] for w in ("Ab", "aB", "İ", "ab")] == ["ab", "ab", "İ".lower(), "ab"] and len(words.words) == 2
    lists = [[], [0, 255], [256, 65_535, 3], [65_536]]
    numbers, starts = unpacked(pa.array([pack(np.array(x, np.int64)) for x in lists], pa.binary()))
    assert [numbers[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)] == lists
