"""YAML documents, circles of parents, and a match without candidates."""

import pytest

from larkmill.operators.tables import lineage_depth
from larkmill.sources.readers import parse_flat_yaml


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("name: Eps\nwebsite: e.com\ncareers:\n  url: https://e.com/jobs\n", {"name": "Eps", "website": "e.com", "careers.url": "https://e.com/jobs"}),
        ('a: "one # two" # three\nb: \'it\'\'s # so\' # x\nc: d#e # f\n', {"a": "one # two", "b": "it's # so", "c": "d#e"}),
        ("a:\n  b:\n    c: 1\n  d: 2\ne: 3\n", {"a.b.c": "1", "a.d": "2", "e": "3"}),
        ("items:\n  - one\n  - two\nafter: x\n", {"items.0": "one", "items.1": "two", "after": "x"}),
        ("items:\n- name: a\n  url: u\n- name: b\n", {"items.0.name": "a", "items.0.url": "u", "items.1.name": "b"}),
        ("steps:\n  - id: s\n    with:\n      k: v\n  - id: t\n", {"steps.0.id": "s", "steps.0.with.k": "v", "steps.1.id": "t"}),
        ("# c\n\nempty:\nquoted: \"a\\\"b\"\n---\n", {"quoted": 'a"b'}),
        ("url: http://x/y:z\ntime: 12:30\n", {"url": "http://x/y:z", "time": "12:30"}),
    ],
)
def test_yaml_documents(text, want):
    assert parse_flat_yaml(text) == want


def test_circles_of_parents_have_no_root(spark):
    rows = [("g", 1, None), ("g", 2, 1), ("g", 3, 2), ("h", 1, 3), ("h", 2, 1), ("h", 3, 2), ("h", 4, 3), ("k", 1, 2), ("k", 2, 1), ("k", 9, None)]
    got = {(r["g"], r["n"]): (r["depth"], r["root"]) for r in lineage_depth(spark.createDataFrame(rows, "g string, n int, p int"), "g", "n", "p").collect()}
    want = {("g", 1): (0, 1), ("g", 2): (1, 1), ("g", 3): (2, 1), ("k", 9): (0, 9)}
    assert {k: v for k, v in got.items() if v[0] is not None} == want
    assert {k for k, v in got.items() if v == (None, None)} == {("h", i) for i in (1, 2, 3, 4)} | {("k", 1), ("k", 2)}


def test_a_match_without_candidates_is_empty(spark, small, tmp_path):
    import __spark_entry__ as entry

    for name in ("documents", "benchmark", "supplier", "nation", "embeddings"):
        rows = spark.read.parquet(f"{small}/{name}.parquet")
        (rows.limit(0) if name == "documents" else rows).write.parquet(f"{tmp_path}/{name}.parquet")
    none = entry.queries()["hybrid_match_topk"](spark, str(tmp_path))
    some = entry.queries()["hybrid_match_topk"](spark, small)
    assert none.count() == 0 and none.dtypes == some.dtypes
