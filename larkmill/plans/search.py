"""Queries over the stored indexes of texts and vectors, each made in two generations."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkmill.functions import text as T
from larkmill.operators import ranking
from larkmill.operators.text_index import TOKEN, TextIndex, search_terms
from larkmill.operators.trigrams import similar_names
from larkmill.operators.vector_index import VectorIndex
from larkmill.plans.registry import Registry
from larkmill.session import cut_lineage, scratch_dir, small_or_not, table

R = Registry()
TERMS_ASKED = 3

_STOP = ", ".join(f"'{w}'" for w in T.FTS_STOP_WORDS)
_TOKENS = f"list_transform(regexp_extract_all(coalesce(text, ''), '{TOKEN}'), lambda x: lower(x))"


def _asked(n: int) -> str:
    return f"""a AS (SELECT item_id AS query_id, list_filter({_TOKENS}, lambda w: length(w) > 2 AND w NOT IN ({_STOP})) AS words FROM benchmark),
    q AS (SELECT query_id, list_filter(words, lambda w, i: list_position(words, w) = i)[1:{n}] AS terms FROM a),
    w AS (SELECT query_id, len(terms) AS n_terms, unnest(range(0, len(terms))) AS slot, unnest(terms) AS term FROM q),
    d AS (SELECT doc_id, {_TOKENS} AS words FROM documents WHERE doc_id IS NOT NULL)"""


def built(spark, d) -> TextIndex:
    """The documents' index, made in two appends; the second brings all again, of which the first half is there."""
    index = TextIndex(spark, scratch_dir(spark, "text-index"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    index.append(docs.where("doc_id % 2 = 0"))
    index.append(docs)
    return index


@R.add(
    f"WITH {_asked(20)},"
    """ t AS (SELECT doc_id, unnest(words) AS term FROM d),
    c AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM w) GROUP BY doc_id, term),
    s AS (SELECT query_id, doc_id, n_terms, count(*) AS n_found, sum(tf / (tf + 1)) AS mass FROM w JOIN c USING (term) GROUP BY query_id, doc_id, n_terms),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(mass, 9) DESC, doc_id) AS rank FROM s)
    SELECT query_id, rank::INTEGER AS rank, doc_id, n_terms::BIGINT AS n_terms, n_found, round(mass / n_terms + 1e-9::DOUBLE, 6) AS fts_score FROM r WHERE rank <= 10"""
)
def fts_index_top_k(spark, d):
    """The ten best documents of each query, of those that hold any of its terms."""
    found = built(spark, d).top_k(table(spark, d, "benchmark"), "item_id", search_terms(F.col("text")), 10)
    return found.withColumn("fts_score", F.round(F.col("fts_score") + 1e-9, 6))


# Every entry with the latest entry of each term up to it; the earliest of these begins the shortest stretch.
_COVERS = f"WITH {_asked(TERMS_ASKED)}," + """
    p AS (SELECT doc_id, unnest(words) AS term, unnest(range(1, len(words) + 1)) AS pos FROM d),
    h AS (SELECT query_id, doc_id, n_terms, slot, pos FROM w JOIN p USING (term)),
    g AS (SELECT query_id, doc_id FROM h GROUP BY query_id, doc_id, n_terms HAVING count(DISTINCT slot) = n_terms),
    e AS (SELECT h.*, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY pos) AS idx FROM h JOIN g USING (query_id, doc_id)),
    l AS (SELECT e.query_id, e.doc_id, e.pos, e.idx, s.slot, max(CASE WHEN e.slot = s.slot THEN e.idx END)
        OVER (PARTITION BY e.query_id, e.doc_id, s.slot ORDER BY e.idx) AS own
      FROM e JOIN w s ON s.query_id = e.query_id),
    m AS (SELECT query_id, doc_id, pos, idx, min(own) AS begun, count(own) = count(*) AS whole FROM l GROUP BY query_id, doc_id, pos, idx),
    b AS (SELECT *, lag(begun) OVER (PARTITION BY query_id, doc_id ORDER BY idx) AS before FROM m WHERE whole),
    v AS (SELECT b.query_id, b.doc_id, e.pos AS first, b.pos AS last, b.idx - b.begun + 1 AS inside
      FROM b JOIN e ON e.query_id = b.query_id AND e.doc_id = b.doc_id AND e.idx = b.begun WHERE before IS NULL OR begun > before)"""


@R.add(
    _COVERS
    + """, cd AS (SELECT query_id, doc_id, count(*) AS n_covers, sum(0.1::DOUBLE / (1 + greatest(last - first + 1 - inside, 0))) AS total FROM v GROUP BY query_id, doc_id),
    near AS (SELECT a.query_id, a.doc_id, 1 - exp(sum(ln(1 - 0.1::DOUBLE * sqrt(1 / (1.005 + 0.05 * exp((b.pos - a.pos) / 1.5 - 2)))))) AS rank
      FROM e a JOIN e b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.slot <> b.slot AND b.pos > a.pos AND b.pos - a.pos <= 100 GROUP BY a.query_id, a.doc_id)
    SELECT query_id, doc_id, n_covers, round(total / (total + 1) + 1e-9::DOUBLE, 6) AS rank_cd, round(coalesce(rank, 0) + 1e-9::DOUBLE, 6) AS rank
    FROM cd LEFT JOIN near USING (query_id, doc_id)"""
)
def fts_cover_density(spark, d):
    """Documents with all of a query's first three terms, ranked by how near these stand to each other."""
    found = built(spark, d).matches(table(spark, d, "benchmark"), "item_id", search_terms(F.col("text"), TERMS_ASKED))
    with_covers = found.withColumn("found", ranking.covers(F.col("entries"), F.col("n_terms")))
    return with_covers.select(
        "query_id", "doc_id", F.size("found").cast("long").alias("n_covers"), F.round(ranking.cover_density(F.col("found")) + 1e-9, 6).alias("rank_cd"),
        F.round(ranking.proximity_rank(F.col("entries"), F.col("n_terms")) + 1e-9, 6).alias("rank"),
    )


@R.add(
    _COVERS
    + """, cd AS (SELECT query_id, doc_id, sum(0.1::DOUBLE / (1 + greatest(last - first + 1 - inside, 0))) AS total FROM v GROUP BY query_id, doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 9) DESC, doc_id) AS rank FROM cd),
    k AS (SELECT v.query_id, v.doc_id, r.rank, min([last - first + 1, first]) AS short FROM v JOIN r USING (query_id, doc_id) WHERE r.rank <= 5 GROUP BY 1, 2, 3),
    f AS (SELECT query_id, doc_id, rank, greatest(short[2] - greatest(35 - short[1], 0) // 2, 1) AS first FROM k),
    x AS (SELECT f.query_id, f.doc_id, f.rank, t.pos, CASE WHEN h.pos IS NULL THEN t.term ELSE '<b>' || t.term || '</b>' END AS word
      FROM f JOIN (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '"""
    + TOKEN
    + """')) AS term, unnest(range(1, len(words) + 1)) AS pos FROM documents JOIN d USING (doc_id)) t ON t.doc_id = f.doc_id AND t.pos BETWEEN f.first AND f.first + 34
      LEFT JOIN h ON h.query_id = f.query_id AND h.doc_id = f.doc_id AND h.pos = t.pos)
    SELECT query_id, rank::INTEGER AS rank, doc_id, string_agg(word, ' ' ORDER BY pos) AS headline FROM x GROUP BY query_id, rank, doc_id"""
)
def fts_headline(spark, d):
    """The five best of each query by cover density, with what they say round the terms."""
    from larkmill.operators.retrieval import top_k

    found = built(spark, d).matches(table(spark, d, "benchmark"), "item_id", search_terms(F.col("text"), TERMS_ASKED))
    ranked = found.withColumn("found", ranking.covers(F.col("entries"), F.col("n_terms"))).withColumn("rank_cd", ranking.cover_density(F.col("found")))
    best = cut_lineage(top_k(ranked, "query_id", 5, F.desc(F.round("rank_cd", 9)), F.asc("doc_id")))
    # Texts are taken in words, and met with places, only where they are shown.
    texts = table(spark, d, "documents").select("doc_id", "text").join(small_or_not(best.select("doc_id").distinct()), "doc_id", "left_semi")
    words = F.regexp_extract_all(T.empty_if_null(F.col("text")), F.lit(TOKEN), F.lit(0))
    shown = ranking.headline(F.col("words"), F.col("entries"), F.col("found"))
    return best.join(texts, "doc_id").withColumn("words", words).select("query_id", "rank", "doc_id", shown.alias("headline"))


@R.add()
def vector_index_top_k(spark, d):
    """The twenty nearest of each fiftieth vector, from an index made of half the rows and given the others later."""
    index = VectorIndex(spark, scratch_dir(spark, "vector-index"))
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    index.add(vectors.where("vec_id % 2 = 0"), "vec_id", "embedding")
    index.add(vectors, "vec_id", "embedding")
    return index.search(vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", 20)


_GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@R.add(
    f"""WITH t AS (SELECT title, bool_or(doc_id % 100 = 0) AS asked, any_value({_GRAMS}) AS g FROM (SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1:5], ' ') AS title FROM documents WHERE text IS NOT NULL) GROUP BY title),
    p AS (SELECT a.title AS a, b.title AS b, len(list_intersect(a.g, b.g)) AS c, len(a.g) + len(b.g) AS n FROM t a JOIN t b ON a.asked AND a.title <> b.title AND len(a.g) > 0 AND len(b.g) > 0)
    SELECT a, b, round(c / (n - c) + 1e-9::DOUBLE, 6) AS similarity FROM p WHERE c >= 0.4 * (n - c) - 1e-9::DOUBLE"""
)
def titles_by_trigrams(spark, d):
    """A search for the titles of each hundredth document: others with two fifths of their trigrams in common."""
    words = F.filter(F.split("text", r"\s+", 7), lambda w: w != "")  # a blank first piece, five words and the rest
    titles = table(spark, d, "documents").select("doc_id", F.array_join(F.slice(words, 1, 5), " ").alias("title"))
    return similar_names(titles, "title", 0.4, F.col("doc_id") % 100 == 0).withColumn("similarity", F.round(F.col("similarity") + 1e-9, 6))
