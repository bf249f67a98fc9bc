"""Files and stores: seeds, documents, paged interfaces and sinks, written to the shared folder and read again.

The tables hold no such files, so each query first writes what it then reads, in tasks. The dump of ``paged_listings``
and its pages are made of a table of fixed length on the driver, as a dump is a single file.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkmill.operators import feedback as FB
from larkmill.plans.registry import Registry
from larkmill.session import scratch_dir, table
from larkmill.sources import readers as S
from larkmill.sources import sinks as K
from larkmill.sources.paged import read_paged

R = Registry()


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The store of a folder, any that Arrow can open, and the folder's path in it."""
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def put(folder: str, name: str, data: bytes) -> None:
    """A file of a folder in any store that Arrow can open."""
    files, path = opened(folder)
    with files.open_output_stream(f"{path}/{name}") as out:
        out.write(data)


def companies(spark, d):
    s = table(spark, d, "supplier")
    even = F.col("s_suppkey") % 2 == 0
    site = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example"))
    return s.select("s_suppkey", F.col("s_name").alias("name"), F.when(even, site).alias("domain"), F.when(~even, site).alias("website"))


SITES = """SELECT s_name AS name, 's' || s_suppkey || '.example' AS domain FROM supplier"""


@R.add(SITES)
def seed_csv(spark, d):
    """Companies as CSV with a header; the domain is in either of two columns."""
    folder = scratch_dir(spark, "seed")
    companies(spark, d).drop("s_suppkey").write.option("header", True).csv(f"{folder}/a.csv")
    return S.read_seeds(spark, f"{folder}/a.csv").select("name", "domain")


def json_lists(df, key: str | None = None):
    """The rows of each partition as one JSON list, below ``key`` if there is one."""

    def listed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [row for part in parts for row in part.to_dict("records")]
        yield pd.DataFrame({"value": [json.dumps({key: rows} if key else rows)] if rows else []}, dtype=object)

    return df.mapInPandas(listed, "value string")


@R.add("SELECT c_name AS name, lower(c_name) || '.example' AS domain FROM customer UNION ALL SELECT s_name, NULL FROM supplier")
def seed_json(spark, d):
    """Objects with a list of companies, and bare lists, a file for each partition of a table."""
    folder = scratch_dir(spark, "seed")
    named = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.concat(F.lower("c_name"), F.lit(".example")).alias("website"))
    json_lists(named.repartition(4), "companies").write.text(f"{folder}/a.json")
    json_lists(table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit(" ").alias("domain")).repartition(2)).write.text(f"{folder}/b.json")
    return S.read_seeds(spark, f"{folder}/a.json").union(S.read_seeds(spark, f"{folder}/b.json")).select("name", "domain")


@R.add("SELECT s_name AS name, CAST(NULL AS VARCHAR) AS domain FROM supplier")
def seed_lines(spark, d):
    """A company a line, among comments and blank lines."""
    folder = scratch_dir(spark, "seed")
    lines = companies(spark, d).select(F.explode(F.array(F.lit("# comment"), F.concat(F.lit("  "), "name"), F.lit(""))).alias("value"))
    lines.write.text(f"{folder}/a.txt")
    return S.read_seeds(spark, f"{folder}/a.txt").select("name", "domain")


@R.add("SELECT n_name AS name, 'n' || n_nationkey || '.example' AS domain FROM nation")
def seed_yaml(spark, d):
    """A YAML document for each company."""
    folder = scratch_dir(spark, "seed")
    site = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(".example"))
    S.write_yaml_records(table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"), site.alias("website")), folder, "n_nationkey")
    return S.read_yaml_records(spark, f"{folder}/records.yaml").select("name", "domain")


@R.add(
    """SELECT suffix, s_name AS name FROM supplier, (VALUES ('csv'), ('json'), ('txt'), ('yaml')) t(suffix) UNION ALL SELECT 'xml', 'unsupported'"""
)
def seed_dispatch(spark, d):
    """Companies written in four forms and read back by their suffix; another suffix is refused."""
    folder, named = scratch_dir(spark, "seed"), companies(spark, d).select("s_suppkey", "name")
    named.select("name").write.option("header", True).csv(f"{folder}/a.csv")
    json_lists(named.select("name")).write.text(f"{folder}/a.json")
    named.select("name").write.text(f"{folder}/a.txt")
    S.write_yaml_records(named, f"{folder}/y", "s_suppkey")
    paths = {"csv": f"{folder}/a.csv", "json": f"{folder}/a.json", "txt": f"{folder}/a.txt", "yaml": f"{folder}/y/records.yaml"}
    found = spark.createDataFrame([], "suffix string, name string")
    for suffix, path in paths.items():
        found = found.union(S.read_seeds(spark, path).select(F.lit(suffix), "name"))
    try:
        S.read_seeds(spark, f"{folder}/a.xml")
    except ValueError:
        found = found.union(spark.createDataFrame([("xml", "unsupported")], "suffix string, name string"))
    return found


@R.add(
    """SELECT n_nationkey::BIGINT AS record, CASE WHEN n_nationkey < 5 THEN 'new ' ELSE '' END || n_name AS name, true AS indexed, n_nationkey < 5 AS written_again
    FROM nation WHERE n_nationkey < 5"""
)
def record_store_guard(spark, d):
    """A store of YAML records is kept from a second writer, unless it overwrites."""
    folder = scratch_dir(spark, "records")
    nations = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    S.write_yaml_records(nations, folder, "n_nationkey")
    later = nations.where("n_nationkey < 5").withColumn("name", F.concat(F.lit("new "), "name"))
    try:
        S.write_yaml_records(later, folder, "n_nationkey")
        guarded = False
    except AnalysisException:
        guarded = True
    S.write_yaml_records(later, folder, "n_nationkey", overwrite=guarded)
    index = spark.read.json(f"{folder}/index").select(F.col("n_nationkey").cast("long").alias("record"), F.lit(True).alias("indexed"))
    raw = S.yaml_documents(spark, f"{folder}/records.yaml")
    name, record = (F.regexp_extract("value", p, 1) for p in (r'name: "([^"]*)"', r'n_nationkey: "([^"]*)"'))
    return raw.select(record.cast("long").alias("record"), name.alias("name")).join(index, "record", "left").select(
        "record", "name", F.coalesce("indexed", F.lit(False)).alias("indexed"), F.lit(guarded).alias("written_again")
    )


@R.add("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS preview FROM nation""")
def record_preview(spark, d):
    return S.preview(table(spark, d, "nation").select("n_nationkey", "n_name"))


def _docx(paragraphs: list[str], cells: list[str]) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    run = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>".format
    row = "".join(f"<w:tc>{run(c)}</w:tc>" for c in cells)
    body = f'<w:document xmlns:w="{w}"><w:body>{"".join(map(run, paragraphs))}<w:tbl><w:tr>{row}</w:tr></w:tbl></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", body)
    return out.getvalue()


def make_pdf(pages: list[list[str]], deflate: bool = True) -> bytes:
    """A small PDF file with a line of text for each string of a page."""
    import zlib

    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    kids = []
    for lines in pages:
        shown = b"".join(b"(" + x.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("latin-1") + b") Tj 0 -14 Td " for x in lines)
        content = b"BT /F1 12 Tf 72 720 Td " + shown + b"ET"
        content = zlib.compress(content) if deflate else content
        kind = b" /Filter /FlateDecode" if deflate else b""
        kids.append(b"%d 0 R" % (len(bodies) + 2))
        bodies.append(b"<< /Length %d%s >>\nstream\n" % (len(content), kind) + content + b"\nendstream")
        bodies.append(b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % len(bodies))
    bodies[1] = b"<< /Type /Pages /Count %d /Kids [ %s ] >>" % (len(kids), b" ".join(kids))
    out = b"%PDF-1.4\n"
    for number, body in enumerate(bodies, 1):
        out += b"%d 0 obj\n" % number + body + b"\nendobj\n"
    return out + b"trailer << /Root 1 0 R >>\n%%EOF\n"


FOLDERS = 256


@R.add(
    """SELECT s_suppkey || k AS file, CASE k WHEN '.txt' THEN s_name || ' in words' WHEN '.docx' THEN s_name || chr(10) || 'one | two' WHEN '.pdf' THEN s_name || ' (page 1)' || chr(10) || 'second line' || chr(10) || 'page 2' END AS text,
      CASE k WHEN '.bin' THEN 'unsupported format: .bin' END AS error
    FROM supplier, (VALUES ('.txt'), ('.docx'), ('.pdf'), ('.bin')) x(k)"""
)
def documents_text(spark, d):
    """Text of plain, DOCX and PDF files; others keep a row with their error. The files lie in folders by their number, which
    Spark lists in tasks."""
    folder = scratch_dir(spark, "documents")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = opened(folder)
        for i in range(FOLDERS):
            files.create_dir(f"{path}/{i}")

        def put_in(k: int, suffix: str, data: bytes) -> None:
            with files.open_output_stream(f"{path}/{k % FOLDERS}/{k}{suffix}", compression=None) as out:
                out.write(data)

        for part in parts:
            for k, name in zip(part["s_suppkey"].tolist(), part["s_name"], strict=True):
                put_in(k, ".txt", f"{name}  in\twords".encode())
                put_in(k, ".docx", _docx([name, ""], ["one", "two"]))
                put_in(k, ".pdf", make_pdf([[f"{name} (page 1)", "second line"], ["page 2"]], deflate=k % 2 == 0))
                put_in(k, ".bin", b"x")
            yield pd.DataFrame({"n": [4 * len(part)]})

    table(spark, d, "supplier", spread=True).select("s_suppkey", "s_name").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    found = S.read_documents(spark, folder)
    return found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "text", "error")


PAGE_ROWS = 10


@R.add(
    f"""WITH r AS (SELECT n_nationkey AS k, n_name AS n, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation),
    t AS (SELECT 'indeed' AS source, p // {PAGE_ROWS} AS page, 'Clerk ' || n AS title, n AS location, 'k' || k AS external_id, CASE WHEN k % 2 = 0 THEN 'full-time' ELSE 'contract' END AS job_type FROM r
      UNION ALL SELECT 'adzuna', p // {PAGE_ROWS}, 'Agent ' || n, 'in ' || n, 'b' || k, NULL FROM r
      UNION ALL SELECT 'remoteok', 0, 'Far ' || n, 'Remote', 'r' || k, NULL FROM r)
    SELECT source, page::BIGINT AS page, title, location, external_id, job_type FROM t"""
)
def paged_listings(spark, d):
    """Two interfaces in pages, of which the ones past the end are missing, and one as a dump that begins with a notice."""
    folder = scratch_dir(spark, "pages")
    rows = table(spark, d, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name").collect()  # of fixed length
    a = [
        {"jobtitle": f"Clerk {r['n_name']}", "formattedLocation": r["n_name"], "jobkey": f"k{r['n_nationkey']}", "jobtype": ("fulltime", "contract")[r["n_nationkey"] % 2]}
        for r in rows
    ]
    b = [{"title": f"Agent {r['n_name']}", "location": {"display_name": f"in {r['n_name']}"}, "id": f"b{r['n_nationkey']}"} for r in rows]
    dump = [{"legal": "notice"}] + [{"position": f"Far {r['n_name']}", "id": f"r{r['n_nationkey']}"} for r in rows]
    for name, items in (("a", a), ("b", b)):
        for page in range(0, len(items), PAGE_ROWS):
            put(folder, f"{name}{page // PAGE_ROWS}.json", json.dumps({"results": items[page : page + PAGE_ROWS]}).encode())
    put(folder, "dump.json", json.dumps(dump).encode())
    shown = ("source", "page", "title", "location", "external_id", "job_type")

    def listed(name: str, normalise):
        raw = read_paged(spark, f"{folder}/{name}{{page}}.json", 5)
        key = {"a": "$.jobkey", "b": "$.id"}[name]
        pages = raw.select(F.try_variant_get(F.try_parse_json("value"), key, "string").alias("external_id"), F.col("page").cast("long").alias("page"))
        return normalise(raw).join(pages, "external_id").select(*shown)

    whole = S.dump_listing(spark.read.text(f"{folder}/dump.json", wholetext=True)).withColumn("page", F.lit(0).cast("long"))
    return listed("a", S.paged_listing_a).union(listed("b", S.paged_listing_b)).union(whole.select(*shown))


@R.add("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def sink_append_batches(spark, d):
    """Events appended in three batches to a store parted by kind."""
    folder = scratch_dir(spark, "store")
    for k in range(3):
        K.append(table(spark, d, "events").where(F.col("event_id") % 3 == k).select("event_type", "value"), folder, "event_type")
    return spark.read.parquet(folder).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@R.add(
    """SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS parents, (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')) AS children"""
)
def sink_parents_and_children(spark, d):
    """Open orders and the lines that belong to one of them."""
    folder = scratch_dir(spark, "store")
    orders = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    K.write_family(orders, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_quantity"), "k", folder)
    parents = spark.read.parquet(f"{folder}/parents").agg(F.count("*").alias("parents"))
    return parents.crossJoin(spark.read.parquet(f"{folder}/children").agg(F.count("*").alias("children")))  # a row each


@R.add("SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey FROM customer")
def sink_csv_load(spark, d):
    """Customers as CSV and loaded back under a schema."""
    folder = scratch_dir(spark, "store")
    kept = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("long").alias("c_nationkey"))
    return spark.read.schema(K.write_csv(kept, f"{folder}/customers")).option("header", True).csv(f"{folder}/customers")


@R.add(
    """SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN 'interview' ELSE 'rejected' END AS outcome, 1 + (o_orderkey % 5 = 0)::BIGINT AS n FROM orders WHERE o_orderkey % 3 = 0"""
)
def sink_flush_outcomes(spark, d):
    """Outcomes that were buffered in batches, some twice, flushed into a store."""
    folder = scratch_dir(spark, "outcomes")
    o = table(spark, d, "orders").where("o_orderkey % 3 = 0")
    said = o.select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderkey") % 2 == 0, "interview").otherwise("rejected").alias("outcome"))
    K.append(said, folder)
    K.append(said.where("job_id % 5 = 0"), folder)
    return spark.read.schema(said.schema).parquet(folder).groupBy("job_id", "outcome").agg(F.count("*").alias("n"))


@R.add(
    """SELECT 'sent' AS status, count(*) FILTER (value IS NOT NULL AND value < 50) AS n FROM events UNION ALL SELECT 'dead', count(*) FILTER (value IS NULL OR value >= 50) FROM events"""
)
def sink_dead_letters(spark, d):
    """Events that may be published, and the others with their content."""
    good, dead = K.split_dead_letters(table(spark, d, "events").select("event_id", "value"), F.col("value") < 50)
    folder = scratch_dir(spark, "outbox")
    K.append(good, f"{folder}/sent")
    K.append(dead, f"{folder}/dead")
    read = lambda name, df: spark.read.schema(StructType(df.schema.fields)).parquet(f"{folder}/{name}")
    sent = read("sent", good).agg(F.lit("sent").alias("status"), F.count("*").alias("n"))
    return sent.union(read("dead", dead).agg(F.lit("dead").alias("status"), F.count_if(F.get_json_object("payload", "$.event_id").isNotNull()).alias("n")))


@R.add("SELECT event_type AS name, round(avg(value), 9) AS weight FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL GROUP BY event_type")
def model_round_trip(spark, d):
    """Weights learned from the events, the mean of each kind, as JSON in a store, and back."""
    folder = scratch_dir(spark, "models")
    mean = table(spark, d, "events").where("event_type IS NOT NULL AND value IS NOT NULL").groupBy("event_type").agg(F.round(F.avg("value"), 9).alias("w"))
    model = FB.WeightModel({r["event_type"]: r["w"] for r in mean.collect()}, "means")  # a weight for each kind
    spark.createDataFrame([(model.to_json(),)], "value string").write.text(f"{folder}/model")
    model = FB.WeightModel.from_json(spark.read.text(f"{folder}/model").first()["value"])
    return spark.createDataFrame(sorted(model.weights.items()), "name string, weight double")
