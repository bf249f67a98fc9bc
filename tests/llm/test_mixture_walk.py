"""The mix against one over plain lists: the same buckets and draws, rounded document by document."""

import random
import re
from collections import defaultdict

import pytest
import xxhash

from larkmill.llm import mixture

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLOSE = 1e-9


def chained(*values):
    """The hash of several columns: each one's is the seed of the next; nulls are passed over."""
    seed = 42
    for value, width in values:
        if value is not None:
            data = value.encode() if width is None else value.to_bytes(width, "little", signed=True)
            seed = xxhash.xxh64(data, seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def settle(x):
    return 0.0 if x < CLOSE else 1.0 if x > 1 - CLOSE else x


def walk(docs, draw, last):
    """Rounds the fractions of ``docs`` (largest first), dicts with size and part, and gives the one left open."""
    for d in docs:
        d["part"] = settle(d["part"])
    while True:
        todo = [d for d in docs if 0 < d["part"] < 1]
        if len(todo) < 2:
            break
        own, rest = todo[0], todo[1:]
        up = own["part"]
        need = max(up, 1 - up) * own["size"]
        room, pool = 0.0, []
        for d in rest:
            pool.append((d, d["size"] * min(d["part"], 1 - d["part"])))
            room += pool[-1][1]
            if room >= need * (1 - 1e-12):
                break
        if room >= need * (1 - 1e-12):
            rises = draw.random() < up
            words = (1 - up) * own["size"] if rises else -up * own["size"]
            own["part"] = float(rises)
            for d, slack in pool:
                d["part"] = settle(d["part"] - words * slack / room / d["size"])
        else:
            other = rest[0]
            gain = min((1 - up) * own["size"], other["part"] * other["size"])
            loss = min(up * own["size"], (1 - other["part"]) * other["size"])
            words = gain if draw.random() * (gain + loss) < loss else -loss
            own["part"], other["part"] = settle(up + words / own["size"]), settle(other["part"] - words / other["size"])
    left = next((d for d in docs if 0 < d["part"] < 1), None)
    if last and left:
        left["part"], left = float(left["part"] >= 0.5), None
    return left


def mixed(rows, targets, rules):
    """(doc_id, source, size, copies) of (doc_id, source, text) rows, sorted."""
    sources, seen, docs = defaultdict(list), defaultdict(int), []
    for doc, source, text in rows:
        d = {"id": doc, "source": source, "th": chained((text, None)), "size": len(WORD.findall(text or ""))}
        d["same"] = seen[doc, source, d["th"], d["size"]]
        seen[doc, source, d["th"], d["size"]] += 1
        sources[source].append(d)
        docs.append(d)
    count = {s: -(-len(own) // rules.bucket_rows) for s, own in sources.items()}
    nodes = defaultdict(list)
    for s, own in sources.items():
        total = sum(d["size"] for d in own)
        for d in own:
            ratio = targets[s] / total if d["size"] else 0.0
            d["base"] = int(ratio + 1e-9)
            d["part"] = 0.0 if ratio - d["base"] < 1e-9 else ratio - d["base"]
            mixed_hash = chained((d["id"], 8), (d["th"], 8), (d["size"], 8), (d["same"], 8), (rules.seed, 4))
            nodes[s, mixed_hash % count[s]].append(d)
    most, level = max(count.values(), default=1), 0
    while nodes:
        above = defaultdict(list)
        for (s, node), own in nodes.items():
            own.sort(key=lambda d: (-d["size"], d["id"] is None, d["id"] or 0, d["th"], d["part"]))
            left = walk(own, random.Random(f"{rules.seed}|{s!r}|{level}|{node}"), most <= 1)
            if left:
                above[s, node // rules.fan].append(left)
        nodes, level, most = above, level + 1, -(-most // rules.fan)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2], r[3])
    return sorted(((d["id"], d["source"], d["size"], d["base"] + int(d["part"])) for d in docs), key=key)


@pytest.mark.parametrize("rules", [mixture.MixRules(), mixture.MixRules(bucket_rows=7, fan=2), mixture.MixRules(bucket_rows=1, fan=3, seed=11)])
def test_equals_a_walk(spark, small, rules):
    rnd = random.Random(8)
    size = lambda: rnd.choice([0, 1, 2, 3, 5, 8, 40, 200, 3000])
    rows = [(i, rnd.choice(["a", "a", "a", "b", "c", None]), " ".join(["w"] * size())) for i in range(150)]
    rows += [(7, "a", "x y z")] * 12 + [(None, "b", "q q")] * 3 + [(None, None, None), (900, "d", None), (901, "e", "")]
    given = [(r["doc_id"], r["source"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    for table in (rows, given):
        df = spark.createDataFrame(table, "doc_id long, source string, text string").repartition(3)
        found = mixture.mix_sources(df, rules=rules).collect()
        targets = {r["source"]: r["target"] for r in found}
        key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2], r[3])
        got = sorted(((r["doc_id"], r["source"], r["size"], r["copies"]) for r in found), key=key)
        assert got == mixed(table, targets, rules)
