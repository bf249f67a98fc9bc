"""Composite pipelines over stored data: resume and job ingest, company discovery, user sync, bulk plans."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkmill.functions import text as T
from larkmill.functions import urls as U
from larkmill.operators import chunking as C
from larkmill.operators.embedding import embed
from larkmill.operators.retrieval import top_k
from larkmill.operators.tables import upsert
from larkmill.session import cut_lineage


class Ingested:
    """Parents with a status, chunks with text and tokens, and a vector for each chunk; the latter two are made, and the
    chunks stored, when they are first asked for."""

    def __init__(self, parents: DataFrame, fresh: DataFrame, key: str, text: str, cfg: C.ChunkConfig, embedder: str, dimensions: int):
        self.parents = parents
        self._of = (fresh, key, text, cfg)
        self._by = (embedder, dimensions)

    @cached_property
    def chunks(self) -> DataFrame:
        fresh, key, text, cfg = self._of
        made = C.chunk(fresh, key, text, cfg).select(
            F.col("row_id").alias(key), "i", "section", "text", "token_count",
            F.sha2(F.concat_ws("|", "row_id", "i"), 256).alias("chunk_id"),
        )
        return cut_lineage(made)

    @cached_property
    def vectors(self) -> DataFrame:
        return embed(self.chunks, "chunk_id", "text", *self._by)


def ingest_resumes(
    files: DataFrame, stored: DataFrame, cfg: C.ChunkConfig = C.ChunkConfig(), embedder: str = "hash", dimensions: int = 64
) -> Ingested:
    """Parse, drop known contents, chunk and embed.

    files: resume_id, text. stored: content_hash. A resume whose content is stored, or came earlier in the batch, is a
    duplicate and gets no chunks.
    """
    skills = T.found_terms(F.col("text"), T.CONTACT_SKILLS)
    parsed = files.withColumns(
        {
            "skills": skills, "sections": T.sections(F.col("text")), "email": T.first_email(F.col("text")),
            "phone": T.first_phone(F.col("text")), "redacted": T.redact(F.substring("text", 1, 200)),
        }
    )
    hashed = parsed.withColumn("content_hash", T.resume_hash(F.col("text"), skills, F.map_keys("sections"), F.col("email")))
    first = hashed.groupBy("content_hash").agg(F.min("resume_id").alias("_first"))
    known = stored.select("content_hash").distinct().withColumn("_known", F.lit(True))
    marked = hashed.join(first, "content_hash").join(known, "content_hash", "left")
    status = F.when(F.col("_known") | (F.col("_first") != F.col("resume_id")), "duplicate").otherwise("created")
    parents = marked.withColumn("status", status).drop("_known", "_first", "sections")
    return Ingested(parents, parents.where("status = 'created'"), "resume_id", "text", cfg, embedder, dimensions)


def ingest_jobs(
    crawled: DataFrame, stored: DataFrame, cfg: C.ChunkConfig = C.ChunkConfig(strategy="sliding_window"), embedder: str = "hash", dimensions: int = 64
) -> Ingested:
    """Fingerprint, merge by URL, and chunk and embed only what is new or changed.

    crawled: job_id, url, title, location, salary, description. stored: url, fp, change_count and the same columns.
    """
    fp = T.listing_fingerprint(F.col("title"), F.col("description"), F.col("location"), F.col("salary"))
    fresh = crawled.withColumn("url", U.normalize(F.col("url"))).withColumn("fp", fp)
    columns = ["job_id", "title", "location", "salary", "description"]
    parents = cut_lineage(upsert(stored, fresh.select("url", "fp", *columns), "url", "fp", columns))
    changed = parents.where("status IN ('created', 'updated')")
    return Ingested(parents, changed, "job_id", "description", cfg, embedder, dimensions)


def discover_companies(companies: DataFrame, pages: DataFrame) -> DataFrame:
    """(company_id, domain, careers_url, portal): over stored pages only.

    The first candidate domain that has a page is the company's; among its links the best career link over 0.5 is its
    careers page; the portal is read from the page.
    """
    wanted = companies.select("company_id", F.posexplode(T.candidate_domains(F.col("company"))).alias("place", "domain"))
    seen = pages.select(U.domain(F.col("url")).alias("domain"), F.col("url").alias("home"), "html")
    found = wanted.join(seen, "domain").where(~T.contains_any(F.col("html"), T.PARKING_PHRASES))
    first = top_k(found, "company_id", 1, F.asc("place"), F.asc("home")).drop("rank")
    links = first.select("company_id", "home", F.explode(U.hrefs(F.col("html"))).alias("href"))
    full = U.absolute(F.col("href"), F.col("home"))
    scored = links.select("company_id", full.alias("careers_url"), U.career_link_score(F.lower("href"), F.lower(U.path(full)), F.col("href")).alias("score"))
    best = top_k(scored.where("score >= 0.5"), "company_id", 1, F.desc("score"), F.asc("careers_url")).select("company_id", "careers_url")
    return first.join(best, "company_id", "left").select("company_id", "domain", "careers_url", U.detect_portal(F.col("html"))["portal"].alias("portal"))


def sync_users(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Users merged by e-mail in lower case; later values win where they aren't blank."""
    keyed = lambda df: df.withColumn("email", F.lower(F.trim("email")))
    old = keyed(stored).select("email", F.col("full_name").alias("_old"))
    new = keyed(incoming).groupBy("email").agg(F.max(F.nullif(F.trim("full_name"), F.lit(""))).alias("_new"))
    both = old.join(new, "email", "full")
    status = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull() | (F.col("_new") == F.col("_old")), "kept").otherwise("updated")
    return both.select("email", F.coalesce("_new", "_old").alias("full_name"), status.alias("status"))


def bulk_plan(jobs: DataFrame, applications: DataFrame, matches: DataFrame, k: int) -> DataFrame:
    """The best ``k`` jobs without an application, by their best match. A dry run: nothing is submitted."""
    open_jobs = jobs.join(applications.select("job_id").distinct(), "job_id", "left_anti")
    best = matches.groupBy("job_id").agg(F.max("final_score").alias("best"))
    return open_jobs.join(best, "job_id").orderBy(F.desc("best"), "job_id").limit(k).select("job_id", "best")


def sample_two(a: DataFrame, b: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Half of ``n`` rows from each table, drawn by hash, so that reruns agree."""
    draw = lambda df: df.orderBy(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n // 2)
    return draw(a).unionByName(draw(b))
