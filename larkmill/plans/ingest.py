"""Ingest queries: seeds, upserts, de-duplication, sources, crawl bookkeeping and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkmill.functions import text as T
from larkmill.operators import crawl as K
from larkmill.operators import embedding as E
from larkmill.operators import tables as TB
from larkmill.plans import domain as D
from larkmill.plans.registry import Registry
from larkmill.session import table
from larkmill.sources import html_pages as H
from larkmill.sources import readers as S

R = Registry()


@R.add(
    """WITH old AS (SELECT doc_id AS k, substr(sha256(text), 1, 32) AS fp, lang FROM documents WHERE doc_id % 2 = 0),
    new AS (SELECT doc_id AS k, substr(sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END), 1, 32) AS fp, lang FROM documents WHERE doc_id % 3 = 0)
    SELECT coalesce(new.k, old.k) AS k, coalesce(new.fp, old.fp) AS fp, coalesce(new.lang, old.lang) AS lang,
      CASE WHEN new.k IS NULL THEN 'kept' WHEN old.k IS NULL THEN 'created' WHEN old.fp <> new.fp THEN 'updated' ELSE 'duplicate' END AS status,
      CASE WHEN old.fp <> new.fp THEN 1 ELSE 0 END::BIGINT AS change_count
    FROM old FULL JOIN new ON old.k = new.k"""
)
def upsert_jobs_change_detect(spark, d):
    docs = table(spark, d, "documents")
    fp = lambda t: F.substring(F.sha2(t, 256), 1, 32).alias("fp")
    old = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("k"), fp(F.col("text")), "lang", F.lit(0).cast("long").alias("change_count"))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("k"), fp(text), "lang")
    return TB.upsert(old, new, "k", "fp", ["lang"])


@R.add(
    """SELECT status, count(*) AS n FROM (SELECT CASE WHEN o.k IS NULL THEN 'created' ELSE 'duplicate' END AS status
      FROM (SELECT DISTINCT doc_id AS k FROM documents WHERE doc_id % 3 = 0) n LEFT JOIN (SELECT doc_id AS k FROM documents WHERE doc_id % 2 = 0) o USING (k)) GROUP BY status"""
)
def ingest_statistics(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("k"), F.lit("x").alias("fp"))
    old = docs.where("k % 2 = 0").withColumn("change_count", F.lit(0).cast("long"))
    done = TB.upsert(old, docs.where("k % 3 = 0"), "k", "fp", [])
    return done.where("status <> 'kept'").groupBy("status").agg(F.count("*").alias("n"))


@R.add(
    """WITH inc AS (SELECT row_number() OVER (ORDER BY c_custkey) AS position, CASE WHEN c_custkey % 10 = 0 THEN 'Supplier#' || lpad((c_custkey % 50)::VARCHAR, 9, '0') ELSE upper(c_name) END AS name FROM customer),
    fp AS (SELECT *, md5(lower(trim(name))) AS fp FROM inc)
    SELECT position, name, fp, CASE WHEN fp IN (SELECT md5(lower(trim(s_name))) FROM supplier) OR row_number() OVER (PARTITION BY fp ORDER BY position) > 1 THEN 'duplicate' ELSE 'created' END AS status FROM fp"""
)
def seed_idempotent(spark, d):
    c = table(spark, d, "customer")
    made = F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 50).cast("string"), 9, "0"))
    named = c.select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, made).otherwise(F.upper("c_name")).alias("name"))
    inc = TB.global_row_number(named, ["c_custkey"]).select(F.col("row").alias("position"), "name")
    return S.seed_companies(table(spark, d, "supplier").select(F.col("s_name").alias("name")), inc)


@R.add(
    """WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY doc_id) AS p, md5(text) AS u, source || ':' || split_part(text, chr(10), 1) AS t FROM documents),
    step AS (
      SELECT 0::BIGINT AS p, []::VARCHAR[] AS us, []::VARCHAR[] AS ts, false AS keep
      UNION ALL
      SELECT r.p, CASE WHEN NOT list_contains(s.us, r.u) AND NOT list_contains(s.ts, r.t) THEN list_append(s.us, r.u) ELSE s.us END,
        CASE WHEN NOT list_contains(s.us, r.u) AND NOT list_contains(s.ts, r.t) THEN list_append(s.ts, r.t) ELSE s.ts END,
        NOT list_contains(s.us, r.u) AND NOT list_contains(s.ts, r.t)
      FROM step s JOIN r ON r.p = s.p + 1)
    SELECT p FROM step WHERE keep"""
)
def dedupe_first_seen_two_keys(spark, d):
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("u"), F.concat("source", F.lit(":"), first).alias("t"))
    keyed = TB.global_row_number(docs, ["doc_id"]).select(F.col("row").alias("p"), "u", "t")
    return TB.first_seen(keyed, "p", ["u", "t"]).select("p")


@R.add(
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'src-new' ELSE source END AS source, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS lang FROM documents WHERE doc_id % 9 <> 0"""
)
def bulk_update_and_delete(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    changes = docs.where("doc_id % 4 = 0").select("doc_id", F.lit("src-new").alias("source"), F.lit(None).cast("string").alias("lang"))
    updated = TB.update_by_id(docs, changes, "doc_id", ["source", "lang"])
    return TB.delete_by_key(updated, docs.where("doc_id % 9 = 0"), "doc_id")


@R.add(
    """SELECT user_id, count(*) AS attempted, count(*) FILTER (event_type = 'purchase') AS succeeded, count(*) FILTER (event_type = 'error') AS failed,
      count(*) FILTER (event_type = 'click')::BIGINT AS items, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds,
      round(count(*) FILTER (event_type = 'purchase') / count(*), 6) AS success_rate,
      round(count(*) FILTER (event_type = 'click') * 3600.0::DOUBLE / nullif(CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT), 0), 6) AS items_per_hour
    FROM events GROUP BY user_id"""
)
def crawl_session_rollup(spark, d):
    kind = F.col("event_type")
    return K.session_rollup(table(spark, d, "events"), "user_id", "ts", kind == "purchase", kind == "error", (kind == "click").cast("long"))


ERROR_TEXT = "['Connection refused by host', 'network timeout', 'cannot resolve name', 'HTTP 429', 'Forbidden', 'captcha shown', 'UNIQUE failed', 'bad token', 'read timeout', 'odd']"
ERROR_KIND = "['OSError', 'OSError', 'OSError', 'HTTPError', 'HTTPError', 'Page', 'IntegrityError', 'JSONDecodeError', 'Exception', 'Exception']"
ERROR_CLASS = "['connection_refused', 'timeout', 'dns_error', 'rate_limited', 'blocked_by_site', 'captcha_detected', 'duplicate_constraint', 'parsing_error', 'timeout', 'unknown_error']"


def classified(spark, d):
    at = (F.col("event_id") % 10 + 1).cast("int")
    pick = lambda text: F.element_at(F.expr("array" + text.replace("[", "(").replace("]", ")")), at)
    return table(spark, d, "events").select("event_id", K.classify_error(pick(ERROR_TEXT), pick(ERROR_KIND)).alias("error_type"))


@R.add(f"SELECT event_id, {ERROR_CLASS}[event_id % 10 + 1] AS error_type FROM events")
def error_classes(spark, d):
    return classified(spark, d)


@R.add(
    f"""SELECT t AS error_type, coalesce(n, 0) AS n FROM (SELECT unnest({list(K.ERROR_TYPES)}) AS t)
    LEFT JOIN (SELECT {ERROR_CLASS}[event_id % 10 + 1] AS c, count(*) AS n FROM events GROUP BY 1) ON c = t"""
)
def error_histogram(spark, d):
    return K.error_histogram(classified(spark, d), "error_type")


@R.add(
    """WITH api AS (SELECT source, doc_id FROM documents WHERE doc_id % 3 = 0), full_ones AS (SELECT source FROM api GROUP BY source HAVING count(*) >= 18)
    SELECT source, doc_id, 'api' AS origin FROM api UNION ALL SELECT source, doc_id, 'scraped' FROM documents WHERE doc_id % 3 = 1 AND source NOT IN (SELECT source FROM full_ones)"""
)
def acquire_api_first(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id")
    api = docs.where("doc_id % 3 = 0").withColumn("origin", F.lit("api"))
    scraped = docs.where("doc_id % 3 = 1").withColumn("origin", F.lit("scraped"))
    return K.acquire(api, scraped, "source", 18)


@R.add(
    """SELECT 'v' || (label % 3 + 1) || '.0' AS embedding_version, count(*) AS chunks, count(*) FILTER (label % 3 <> 2) AS pending, sum(CASE WHEN vec_id % 4 = 0 THEN 100 ELSE vec_id % 50 END)::BIGINT AS tokens,
      round(sum(CASE WHEN label % 3 <> 2 THEN CASE WHEN vec_id % 4 = 0 THEN 100 ELSE vec_id % 50 END ELSE 0 END) / 1000 * 0.0001::DOUBLE, 9) AS cost
    FROM embeddings GROUP BY 1"""
)
def migration_progress(spark, d):
    e = table(spark, d, "embeddings").select(
        "vec_id", F.concat(F.lit("v"), (F.col("label") % 3 + 1).cast("string"), F.lit(".0")).alias("embedding_version"),
        F.when(F.col("vec_id") % 4 != 0, F.col("vec_id") % 50).alias("token_count"),
    )
    return E.migration_progress(E.mark_legacy(e, "v3.0"))


@R.add(
    """WITH v AS (SELECT label, 'v' || label || '.0' AS version_id, max(len(embedding)) AS dimensions, max(vec_id) AS newest FROM embeddings WHERE label IS NOT NULL GROUP BY label)
    SELECT version_id, dimensions::INTEGER AS dimensions FROM v WHERE label % 3 <> 0 ORDER BY newest DESC, version_id DESC LIMIT 1"""
)
def active_embedding_version(spark, d):
    """A version for each label, made when its last vector was; every third is deprecated."""
    v = table(spark, d, "embeddings").where("label IS NOT NULL").groupBy("label").agg(F.max(F.size("embedding")).alias("dimensions"), F.max("vec_id").alias("newest"))
    at = F.timestamp_seconds("newest").cast("timestamp_ntz")
    return E.active_version(
        v.select(F.concat(F.lit("v"), F.col("label").cast("string"), F.lit(".0")).alias("version_id"), "dimensions", at.alias("created_at"), F.when(F.col("label") % 3 == 0, at).alias("deprecated_at"))
    )


@R.add(
    """SELECT page_id, 0::BIGINT AS position, 'Job ' || page_id AS title, 'City ' || page_id % 5 AS location, NULL::VARCHAR AS department, 'https://boards.greenhouse.io/j/' || page_id AS link, NULL::VARCHAR AS description FROM pages"""
)
def list_page_postings(spark, d):
    n = F.col("page_id").cast("string")
    made = F.concat(
        F.lit('<div class="opening"><a href="/j/'), n, F.lit('">Job '), n, F.lit('</a> <span class="location">City '),
        (F.col("page_id") % 5).cast("string"), F.lit('</span></div><div class="opening"><p>none</p></div>'), F.col("html"),
    )
    pages = table(spark, d, "pages").select("page_id", F.lit("https://boards.greenhouse.io/acme").alias("url"), made.alias("html"))
    return H.read_postings(pages, "page_id", "url", "html", H.LIST_SELECTORS["greenhouse"])


@R.add(
    """SELECT 'remoteok' AS source, doc_id::VARCHAR AS external_id, source AS title, true AS remote FROM documents WHERE doc_id % 2 = 0
    UNION ALL SELECT 'adzuna', doc_id::VARCHAR, source, NULL FROM documents WHERE doc_id % 2 = 1
    UNION ALL SELECT 'indeed', doc_id::VARCHAR, source, doc_id % 6 = 0 FROM documents WHERE doc_id % 3 = 0"""
)
def listings_from_sources(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("t"))
    a = docs.where("doc_id % 3 = 0").select(
        F.to_json(F.struct(F.col("t").alias("jobtitle"), F.col("doc_id").cast("string").alias("jobkey"), F.when(F.col("doc_id") % 6 == 0, "Remote").otherwise("Town").alias("formattedLocation"))).alias("value")
    )
    b = docs.where("doc_id % 2 = 1").select(F.to_json(F.struct(F.col("t").alias("title"), F.col("doc_id").alias("id"))).alias("value"))
    c = docs.where("doc_id % 2 = 0").select(F.concat(F.lit('[{"legal":1},'), F.to_json(F.struct(F.col("t").alias("position"), F.col("doc_id").cast("string").alias("id"))), F.lit("]")).alias("value"))
    both = S.combine_sources(S.paged_listing_a(a), S.paged_listing_b(b), S.dump_listing(c))
    return both.select("source", "external_id", "title", "remote")


@R.add(
    D.with_ctes(D.COMPANIES, D.JOBS)
    + """SELECT company, title, job_id FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY posted_date DESC NULLS LAST, job_id) AS r FROM jobs JOIN companies USING (company_id)) WHERE r <= 3"""
)
def newest_jobs_per_company(spark, d):
    from larkmill.operators.retrieval import top_k

    jobs = D.jobs(spark, d).join(D.companies(spark, d), "company_id")
    return top_k(jobs, "company_id", 3, F.desc_nulls_last("posted_date"), F.asc("job_id")).select("company", "title", "job_id")


@R.add("SELECT page_id, greatest(page_id % 7 + 1, page_id % 4 + 1)::BIGINT AS pages, page_id % 9 <= greatest(page_id % 7 + 1, page_id % 4 + 1) AS wanted FROM pages")
def pagination_total(spark, d):
    from larkmill.functions.urls import page_total

    k = F.col("page_id")
    html = F.concat(F.lit("<a>"), (k % 7 + 1).cast("string"), F.lit("</a><span> "), (k % 4 + 1).cast("string"), F.lit(" </span>"))
    made = table(spark, d, "pages").select("page_id", page_total(html).cast("long").alias("pages"))
    return made.withColumn("wanted", F.col("page_id") % 9 <= F.col("pages"))


@R.add(
    """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'acme' WHEN 1 THEN 'beta' WHEN 2 THEN 'shop' ELSE 'supplier' || lpad(s_suppkey::VARCHAR, 9, '0') END AS tenant,
      CASE s_suppkey % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'custom' END AS scraper, s_suppkey % 4 = 0 OR s_suppkey % 4 = 1 AS allowed FROM supplier"""
)
def tenant_and_scraper(spark, d):
    from larkmill.functions import urls as U

    k = F.col("s_suppkey") % 4
    url = F.when(k == 0, "https://boards.greenhouse.io/acme?x=1").when(k == 1, "https://jobs.lever.co/beta/").otherwise("")
    site = F.when(k == 2, "https://www.shop.example/x")
    return table(spark, d, "supplier").select(
        "s_suppkey", U.tenant(url, site, F.col("s_name")).alias("tenant"), U.scraper_type(url).alias("scraper"), U.allowed_domain(url).alias("allowed")
    )


@R.add(
    """SELECT doc_id, contains(lower(text), 'the') OR contains(lower(text), 'de') OR list_contains([lang], 'de') AS hit, len(string_split(lang || ', ,X', ','))::BIGINT AS raw_items,
      [lang, 'x'] AS items FROM documents"""
)
def tags_and_csv(spark, d):
    csv = F.concat("lang", F.lit(", ,X"))
    wanted = F.array(F.lit("the"), F.lit("de"))
    return table(spark, d, "documents").select(
        "doc_id", T.any_tag(F.col("text"), F.array("lang"), wanted).alias("hit"),
        F.size(T.raw_csv_list(csv)).cast("long").alias("raw_items"), T.csv_list(csv).alias("items"),
    )
