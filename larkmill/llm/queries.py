"""The registered queries of the corpus operators, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkmill.llm.fill_middle import fill_middle_documents, restored
from larkmill.llm.filter_audit import audit_filters
from larkmill.llm.language import held_out, identify, learn
from larkmill.llm.license_scan import scan_licenses
from larkmill.llm.line_rules import apply_line_rules
from larkmill.llm.line_windows import dedup_lines
from larkmill.llm.main_text import extract_pages
from larkmill.llm.mixture import mix_sources
from larkmill.llm.packing import pack_documents
from larkmill.llm.permutation_index import nearest
from larkmill.llm.secret_scan import scan_secrets
from larkmill.llm.simhash import near_duplicates
from larkmill.llm.url_lists import PATH, filter_captures, url_host
from larkmill.session import table


def op1_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_line_rules(table(spark, sf_dir, "documents", spread=True))


OP1_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
windows AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (
  SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS p FROM twice, (SELECT unnest(range(0, 8)) AS k)) GROUP BY r),
raw_lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM raw_lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
norm AS (
  SELECT r, doc_id, source, trim(unnest(string_split(lower(regexp_replace(t, '[\x20\x09\x0B-\x0D]+', ' ', 'g')), chr(10)))) AS line
  FROM d),
norm_lines AS (SELECT r, doc_id, source, line, len(string_split(line, ' ')) AS n FROM norm WHERE line <> ''),
common AS (
  SELECT source, line FROM norm_lines GROUP BY source, line
  HAVING count(DISTINCT doc_id) + count(DISTINCT r) FILTER (doc_id IS NULL) > 20),
lost AS (
  SELECT l.r, sum(l.n) AS n, count(*) AS lines FROM norm_lines l JOIN common c
  ON l.source IS NOT DISTINCT FROM c.source AND l.line = c.line GROUP BY l.r),
base AS (
  SELECT d.doc_id, len(w) AS n_words,
    len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    coalesce(lost.n, 0) AS lost_words, coalesce(lost.lines, 0) AS lost_lines
  FROM d LEFT JOIN dup USING (r) LEFT JOIN covered USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - lost_words >= 20
    AND 100 * (n_words - lost_words) >= 50 * n_words AS kept,
  CAST(lost_lines AS BIGINT) AS n_common_lines, CAST(n_words - lost_words AS BIGINT) AS n_left_words
FROM base
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents", spread=True))


def op3_line_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents", spread=True))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "text")


# Rows of one id and text are one document, rows without an id several. Different texts of one id would be ordered by a
# hash that DuckDB lacks; the order of the rows stands in for it.
OP3_SQL = r"""
WITH said AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
d AS MATERIALIZED (SELECT *, CASE WHEN doc_id IS NULL THEN r ELSE min(r) OVER (PARTITION BY doc_id, text) END AS k FROM said),
lines AS (
  SELECT k, doc_id, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t, j
  FROM (SELECT k, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS j FROM d WHERE r = k)),
worded AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY j) AS i FROM lines WHERE t <> ''),
three AS (
  SELECT k, doc_id, i, t || chr(10) || lead(t, 1) OVER w || chr(10) || lead(t, 2) OVER w AS g
  FROM worded WINDOW w AS (PARTITION BY k ORDER BY i)),
later AS (
  SELECT k, i FROM three WHERE g IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, k, i) > 1),
gone AS (SELECT DISTINCT k, i + s AS i FROM later, (SELECT unnest([0, 1, 2]) AS s)),
left_lines AS (
  SELECT l.k, l.line, l.j, w.i IS NOT NULL AS has_word, g.i IS NOT NULL AS is_gone FROM lines l
  LEFT JOIN worded w ON l.k = w.k AND l.j = w.j LEFT JOIN gone g ON w.k = g.k AND w.i = g.i),
done AS (
  SELECT k, count(*) FILTER (has_word) AS n_lines, count(*) FILTER (is_gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY j) FILTER (NOT is_gone), '') AS text
  FROM left_lines GROUP BY k)
SELECT d.doc_id, n_lines, n_removed, CASE WHEN d.text IS NOT NULL THEN done.text END AS text FROM d JOIN done USING (k)
"""


def op4_language_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True)
    may_teach = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = identify(docs, learn(may_teach))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "fit")


def op5_pivotal_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix_sources(table(spark, sf_dir, "documents", spread=True))
    return found.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents", spread=True))


def op6_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents", spread=True))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_main_text_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages", spread=True))


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def _digest(value) -> F.Column:
    return F.conv(F.substring(F.md5(value), 1, 4), 16, 10).cast("int")


def dated_entries(pages: DataFrame) -> DataFrame:
    """A dated list over all hosts of the captures: every third host is blocked, half of those are taken off again,
    their first pages are allowed, and one parent domain is blocked late in the year. Every seventh page is blocked by its
    whole path under a host in capitals, and every eleventh is allowed by a path in capitals, which is another path."""
    host = url_host(F.col("url"))
    hosts = pages.select(host.alias("host")).where(F.col("host") != "").distinct()
    h = _digest(F.col("host"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    entry = lambda key, action, at: F.struct(key.alias("key"), action.alias("action"), at.alias("day"))
    made = hosts.where(h % 3 == 0).select(
        F.inline(
            F.array(
                entry(F.col("host"), F.lit("block"), day(h % 200)),
                entry(F.col("host"), F.when(h % 2 == 0, "remove").otherwise("block"), day(h % 200 + 100)),
                entry(F.concat("host", F.lit("/en")), F.lit("allow"), day(h % 200 + 50)),
            )
        )
    )
    parent = hosts.where(h % 5 == 1).select(
        F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("key"), F.lit("block").alias("action"), day(F.lit(330)).alias("day")
    )
    paths = pages.select(host.alias("host"), F.regexp_extract("url", PATH, 1).alias("path"), _digest(F.col("url")).alias("u")).where(
        (F.col("host") != "") & (F.col("path") != "")
    )
    whole = paths.where("u % 7 = 0").select(
        F.concat(F.upper("host"), "path").alias("key"), F.lit("block").alias("action"), day(F.col("u") % 300).alias("day")
    )
    other = paths.where("u % 11 = 0").select(
        F.concat("host", F.upper("path")).alias("key"), F.lit("allow").alias("action"), day(F.col("u") % 100).alias("day")
    )
    return made.union(parent).union(whole).union(other)


def op10_url_list_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch time, so it is made from the id: a day of 2024."""
    pages = table(spark, sf_dir, "pages", spread=True)
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int"))
    captures = pages.select("page_id", "url", fetched.alias("fetched_at"))
    found = filter_captures(captures, dated_entries(pages))
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("fetched_at", "valid_from")})


OP10_SQL = r"""
WITH p AS MATERIALIZED (
  SELECT row_number() OVER () AS r, page_id, url, DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INTEGER) AS seen,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path,
    CAST('0x' || substr(md5(url), 1, 4) AS INTEGER) AS u
  FROM pages),
hosts AS (
  SELECT host, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS h FROM (SELECT DISTINCT host FROM p WHERE host <> '')),
said AS (
  SELECT host AS key, 'block' AS action, DATE '2024-01-01' + h % 200 AS day FROM hosts WHERE h % 3 = 0
  UNION SELECT host, CASE WHEN h % 2 = 0 THEN 'remove' ELSE 'block' END, DATE '2024-01-01' + (h % 200 + 100) FROM hosts WHERE h % 3 = 0
  UNION SELECT host || '/en', 'allow', DATE '2024-01-01' + (h % 200 + 50) FROM hosts WHERE h % 3 = 0
  UNION SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1), 'block', DATE '2024-01-01' + 330 FROM hosts WHERE h % 5 = 1
  UNION SELECT upper(host) || path, 'block', DATE '2024-01-01' + u % 300 FROM p WHERE host <> '' AND path <> '' AND u % 7 = 0
  UNION SELECT host || upper(path), 'allow', DATE '2024-01-01' + u % 100 FROM p WHERE host <> '' AND path <> '' AND u % 11 = 0),
entries AS (
  SELECT lower(regexp_extract(key, '^[^/]*', 0)) || regexp_extract(key, '^[^/]*(.*?)/*$', 1) AS key, action, day FROM said),
held AS (
  SELECT key, action, day AS a, lead(day) OVER (PARTITION BY key ORDER BY day) AS b
  FROM (SELECT key, day, max(action) AS action FROM entries WHERE key <> '' GROUP BY key, day)),
split AS (SELECT r, seen, host, string_split(host, '.') AS labels, string_split(path, '/') AS parts FROM p WHERE host <> ''),
keys AS (
  SELECT DISTINCT r, seen, unnest(list_concat(
    list_transform(range(1, greatest(len(labels), 2)), lambda i: array_to_string(labels[i:], '.')),
    list_transform(list_filter(range(2, len(parts) + 1), lambda j: parts[j] <> ''), lambda j: host || array_to_string(parts[1:j], '/'))
  )) AS key FROM split),
matched AS (
  SELECT k.r, e.key, e.action, e.a, row_number() OVER (PARTITION BY k.r ORDER BY length(e.key) DESC, e.key DESC) AS place
  FROM keys k JOIN held e ON k.key = e.key AND e.action <> 'remove' AND k.seen >= e.a AND (e.b IS NULL OR k.seen < e.b))
SELECT p.page_id, p.url, strftime(p.seen, '%Y-%m-%d') AS fetched_at, p.host, m.key AS matched_key,
  m.action AS matched_action, strftime(m.a, '%Y-%m-%d') AS valid_from, coalesce(m.action, 'allow') <> 'block' AS kept
FROM p LEFT JOIN matched m ON m.r = p.r AND m.place = 1
"""



def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
said AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
      100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
      coalesce(d.doc_id > least, false)] AS f
  FROM d JOIN firsts USING (t) LEFT JOIN said ON d.doc_id = said.doc_id),
counted AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a JOIN letters b ON b.x <> a.x JOIN letters c ON c.x NOT IN (a.x, b.x) JOIN letters d ON d.x NOT IN (a.x, b.x, c.x)
  JOIN letters e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
placed AS (
  SELECT part, filter_order, f, n, good, toxic,
    coalesce(list_position([f[ascii(filter_order[k]) - 64] FOR k IN range(1, 6)], true), 6) AS gone
  FROM counted, orders),
steps AS (SELECT *, ascii(filter_order[step]) - 64 AS own FROM placed, (SELECT unnest(range(1, 6)) AS step)),
found AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone < step AND f[own] THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN f[own] AND len(list_filter(f, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM steps GROUP BY part, filter_order, step, own),
shares AS (SELECT part, own, sum(removed) AS shapley FROM found GROUP BY part, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM found JOIN shares USING (part, own)
"""


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents", spread=True))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle_documents(table(spark, sf_dir, "documents", spread=True))
    return cut.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s
  FROM documents),
drawn AS (
  SELECT *, CAST('0x' || substr(s, 1, 8) AS BIGINT) % (n + 1) AS x, CAST('0x' || substr(s, 9, 8) AS BIGINT) % (n + 1) AS y,
    CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR CAST('0x' || substr(s, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || substr(s, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
cut AS (
  SELECT *, least(x, y) AS a, greatest(x, y) AS b, substr(t, 1, least(x, y)) AS prefix,
    substr(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS middle, substr(t, greatest(x, y) + 1) AS suffix
  FROM drawn),
made AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output
  FROM cut),
parted AS (SELECT *, string_split_regex(output, '<[PSM]>') AS p FROM made)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN p[2] || p[4] || p[3] ELSE p[3] || p[4] || p[2] END) AS restored_sha256
FROM parted
"""

QUERIES = {
    "op1_line_frequency_rules": op1_line_frequency_rules,
    "op2_secret_scan": op2_secret_scan,
    "op3_line_window_dedup": op3_line_window_dedup,
    "op4_language_unigrams": op4_language_unigrams,
    "op5_pivotal_mixture": op5_pivotal_mixture,
    "op6_simhash_blocks": op6_simhash_blocks,
    "op7_main_text_trees": op7_main_text_trees,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_permutation_index": op9_permutation_index,
    "op10_url_list_asof": op10_url_list_asof,
    "op11_filter_audit": op11_filter_audit,
    "op12_license_scan": op12_license_scan,
    "op13_fill_middle": op13_fill_middle,
}
ORACLE_SQL = {
    "op1_line_frequency_rules": OP1_SQL,
    "op3_line_window_dedup": OP3_SQL,
    "op10_url_list_asof": OP10_SQL,
    "op11_filter_audit": OP11_SQL,
    "op13_fill_middle": OP13_SQL,
}
