"""Filter audit, license scan and fill-in-middle against brute force, with odd rows, empty tables and clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from larkmill.llm import fill_middle as middle
from larkmill.llm import license_scan as licenses
from larkmill.llm.filter_audit import audit_filters
from larkmill.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("k_none", "k_id", "digest", "part", "own", "n", "mask", "step", "bit", "before", "cells", "good", "toxic", "output", "form")


def make(spark, rows):
    df = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOCS)
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])


def odd_rows():
    rnd = random.Random(4)
    long = " ".join(f"w{i}" for i in range(130))
    texts = [None, "", "  \n", long, long + " $", long.upper(), "A b c", "x | y", "same words " * 80, "ß ñ \U0001f600 日本語", long + " X" * 60]
    rows = [(i, rnd.choice(texts), rnd.choice(["en", "de", "", None])) for i in range(150)]
    rows += [(None, t, "en") for t in texts] + [(7, long, "en")] * 5 + [(7, long, "de"), (7, long + "$", None)]
    return rows


def brute_audit(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        words = WORD.findall(t)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least[t],
        }
        parts[lang or ""].append((fails, i in good, i in toxic))
    out, shares = {}, Counter()
    for part, docs in parts.items():
        for order in permutations("ABCDE"):
            alive = docs
            for k, x in enumerate(order):
                lost = [d for d in alive if d[0][x]]
                gone = [d for d in docs if d[0][x] and any(d[0][y] for y in order[:k])]
                alive = [d for d in alive if not d[0][x]]
                alone = sum(d[0][x] and sum(d[0].values()) == 1 for d in docs)
                out[part, "".join(order), k + 1] = [len(alive), len(lost), len(gone), alone, sum(d[1] for d in lost), sum(d[2] for d in lost)]
                shares[part, x] += len(lost)
    return {(*key, *value, shares[key[0], key[1][key[2] - 1]]) for key, value in out.items()}


def test_audit(spark):
    rows = odd_rows()
    labels = [(i, i % 2, i % 3) for i in range(0, 150, 2)] + [(7, None, 1), (7, 1, None), (None, 1, 1), (9999, 1, 1)]
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({"good": F.lit(5), "n": F.lit("x")})
    docs = make(spark, rows)
    assert {tuple(r) for r in audit_filters(docs, said).collect()} == brute_audit(rows, labels)
    assert audit_filters(docs.where("false"), said).count() == 0
    none = audit_filters(docs, said.where("false")).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count("*")).first()
    assert tuple(none)[:2] == (0, 0) and none[2] == 600 * len({lang or "" for _, _, lang in rows})


def test_audit_with_other_filters(spark):
    docs = make(spark, [(1, "a b", "x"), (2, "a b", "x"), (3, "#", "x")])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = {"H": lambda text, words: text.contains("#")}
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["shapley"]) for r in audit_filters(docs, labels, filters=one).collect()}
    assert got == {("HE", 1): (2, 1, 2), ("HE", 2): (1, 1, 2), ("EH", 1): (2, 1, 2), ("EH", 2): (1, 1, 2)}


def test_audit_has_no_python(spark, small):
    plan = QUERIES["op11_filter_audit"](spark, small)._jdf.queryExecution().toString()
    assert not re.search(r"Python|Arrow|Pandas|CartesianProduct|BroadcastNestedLoop", plan)


# ---------------------------------------------------------------------------------------------- licences

LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_places(text, phrases):
    words = LICENSE_WORD.findall((text or "").translate(LOWERED))
    found = []
    for phrase, label in phrases.items():
        p = phrase.split()
        found += [(k, label, len(p)) for k in range(len(words)) if words[k : k + len(p)] == p]
    return len(words), sorted(found)


def test_license_places_match_brute_force():
    rnd = random.Random(8)
    parts = [
        "MIT", "license", "License", "Apache", "general", "public", "GNU", "lesser", "affero", " ", "-", "\n", "É", "é", "\x85", "\xa0", " ", "İ", "1",
        "creative commons attribution", "sharealike", "bsd", "_", "'", "\x00", "K", "mozilla",
    ]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) + rnd.choice(["", " ", " ", " "]) for _ in range(rnd.randint(0, 40)))
        found = licenses.scanner().scan(text)
        n, base = brute_places(text, licenses.BASE_PHRASES)
        _, more = brute_places(text, licenses.BASE_PHRASES | licenses.MORE_PHRASES)
        within = [p for p in more if any(q != p and q[0] <= p[0] and p[0] + p[2] <= q[0] + q[2] and q[2] > p[2] for q in more)]
        mine = [(x.start, x.label, x.end - x.start) for x in found.notices if x.kind != "tag"]
        assert found.n_words == n
        assert sorted(p for p in mine if p in base) == base, text
        assert sorted(set(mine)) == sorted({p for p in more if p not in within or p in base}), text
        row = licenses.row_of(found)
        assert row[1:5] == (len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({b[1] for b in base})))


def descend(tokens):
    """Recursive descent over the same grammar: (permission, rest)."""

    def term(ts):
        if ts[0] == "(":
            value, rest = either(ts[1:])
            return value, rest[1:]
        value, rest = licenses.FAMILIES.get(licenses.family(ts[0]) or "", 0.0), ts[1:]
        if rest[:1] == ["with"]:
            return (max(value, licenses.WEAK) if value else value), rest[2:]
        return value, rest

    def both(ts):
        value, rest = term(ts)
        while rest[:1] == ["and"]:
            other, rest = term(rest[1:])
            value = min(value, other)
        return value, rest

    def either(ts):
        value, rest = both(ts)
        while rest[:1] == ["or"]:
            other, rest = both(rest[1:])
            value = max(value, other)
        return value, rest

    return either(tokens)


def random_expression(rnd, depth=0):
    x = rnd.random()
    if depth > 4 or x < 0.4:
        plain = rnd.choice(["mit", "gpl-2.0+", "lgpl-2.1-only", "apache-2.0", "agpl-3.0", "licenseref-x", "cc-by-nc-sa-4.0"])
        return plain + (" with some-exception" if rnd.random() < 0.2 else "")
    if x < 0.6:
        return f"({random_expression(rnd, depth + 1)})"
    return f"{random_expression(rnd, depth + 1)} {rnd.choice(['and', 'or'])} {random_expression(rnd, depth + 1)}"


def test_license_expressions_match_recursive_descent():
    rnd = random.Random(2)
    for _ in range(2000):
        text = random_expression(rnd)
        tokens = re.findall(r"[()]|[^\s()]+", text)
        found = licenses.parse_expression(text)
        assert found.permits == descend(tokens)[0] and found.end == len(text), text
        again = licenses.parse_expression(found.text)  # the canonical form says the same
        assert (again.text, again.permits, again.terms) == (found.text, found.permits, found.terms)


def test_license_expressions_that_end_or_fail():
    read = licenses.parse_expression
    assert read("mit this is free").text == "mit" and read("mit. more").text == "mit" and read("mit and").text == "mit"
    for text in ("", "and mit", "(mit", "((", "()", "mit or (", "(mit or apache) with x", "gpl with a with b", "+"):
        assert read(text) is None, text
    deep = read("(" * 50_000 + "mit" + ")" * 50_000)
    assert deep.text == "mit" and deep.permits == 1.0


def test_license_tags():
    row = lambda t: licenses.row_of(licenses.scanner().scan(t))
    found = row("é SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Foo-1.0 -->\nx")
    assert found[5:9] == ("foo-1.0,gpl,mit", 0.0, "(mit or gpl-3.0-only) and foo-1.0", 0)
    assert found[9].split(",")[0] == "tag:mit:2:60"
    assert row("SPDX-License-Identifier: GPL-2.0 OR MIT */")[5:9] == ("gpl,mit", 1.0, "gpl-2.0 or mit", 0)
    assert row("SPDX-License-Identifier: (MIT")[5:9] == ("", 0.0, "", 1)
    assert row('{"license": "Apache-2.0"}')[5:8] == ("apache", 1.0, "apache-2.0")
    assert row("License: see the file")[5:9] == ("", 0.0, "", 0)
    assert row("GNU Lesser General Public License, see COPYING")[4:7] == ("gpl", "gpl,lgpl", 0.5)
    assert row("MIT license. All rights reserved.")[5:7] == ("mit,reserved", 0.0)
    assert row(None) == row("") == (0, 0, None, None, "", "", 0.0, "", 0, "")


@pytest.mark.parametrize("text", ["license:" * 100_000, "license: (" * 100_000, "mit license " * 50_000, "license: mit and " * 50_000, "license:" + " " * 10**6, "a." * 500_000])
def test_license_work_follows_length(text):
    import time

    begun = time.perf_counter()
    licenses.scanner().scan(text)
    assert time.perf_counter() - begun < 10


def test_license_table(spark):
    rows = [*odd_rows(), (900, "the MIT License. " * 3000, "en"), (901, "Apache License\nMIT-license", None)]
    got = licenses.scan_licenses(make(spark, rows)).collect()
    want = Counter()
    for i, t, _ in rows:
        n, base = brute_places(t, licenses.BASE_PHRASES)
        want[i, n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({b[1] for b in base}))] += 1
    assert Counter(tuple(r)[:6] for r in got) == want
    assert all(0 <= r["score"] <= 1 for r in got)
    assert licenses.scan_licenses(make(spark, [])).count() == 0


# ---------------------------------------------------------------------------------------------- fill-in-middle


def test_select_bit():
    rnd = random.Random(6)
    for _ in range(300):
        mask = rnd.getrandbits(rnd.choice([1, 8, 600, 5000])) | 1 << rnd.randint(0, 4000)
        places = [k for k in range(mask.bit_length()) if mask >> k & 1]
        k = rnd.randrange(len(places))
        assert middle.select_bit(mask, k) == places[k]


def test_units_match_expressions():
    rnd = random.Random(7)
    patterns = {"code_points": r"(?s:.)", "words": r"[^ \t-\r]+[ \t-\r]*|[ \t-\r]+", "lines": r"[^\n]*\n|[^\n]+"}
    for _ in range(600):
        text = "".join(rnd.choice("ab é日\U0001f600 \n\t\x85\xa0") for _ in range(rnd.randint(0, 80)))
        data = text.encode()
        for units, pattern in patterns.items():
            want = [len(text[: m.end()].encode()) for m in re.finditer(pattern, text)]
            ends = middle.unit_ends(data, units)
            assert [k + 1 for k in range(len(data)) if ends >> k & 1] == want and ends.bit_count() == len(want), (units, text)


def brute_middle(text, doc_id):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if text == "" or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fill_middle_round_trip(spark):
    rnd = random.Random(9)
    pieces = ["a", "é", "日", "\U0001f600", "<", ">", "<P", "S>", "\n", " ", "M", "<S>", "\r"]
    rows = [*odd_rows(), (5000, "<P" * 10 + "x", "en"), (5001, "x\U0001f600" * 200_000, "en"), (-1, "z" * 50, "en")]
    rows += [(10_000 + i, "".join(rnd.choice(pieces[: 11 if i % 3 else 13]) for _ in range(rnd.randint(1, 12))), "en") for i in range(400)]
    docs = make(spark, rows)
    cut = middle.fill_middle_documents(docs).withColumn("back", middle.restored(F.col("output"), F.col("form")))
    got = Counter(tuple(r)[:6] + (r["back"],) for r in cut.collect())
    want = Counter()
    for i, t, _ in rows:
        *rest, output = brute_middle(t, i)
        want[(i, *rest, output, t or "")] += 1
    assert got == want
    assert len({r[2] for r in got}) == 3
    assert middle.fill_middle_documents(docs.where("false")).count() == 0


def test_fill_middle_by_words_and_other_sentinels(spark):
    marks = middle.Sentinels("<|pre|>", "<|suf|>", "<|mid|>")
    docs = make(spark, [(i, "  one two\nthree  four five ", "en") for i in range(60)])
    cut = middle.fill_middle_documents(docs, units="words", marks=marks)
    rows = cut.withColumn("back", middle.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r["back"] for r in rows} == {"  one two\nthree  four five "} and {r["n"] for r in rows} == {6}
    for wrong in (("<P>", "<P<", "<M>"), ("<P>", "<P>", "<M>")):
        with pytest.raises(ValueError):
            middle.Sentinels(*wrong)
    with pytest.raises(ValueError):
        middle.unit_ends(b"x", "sentences")
