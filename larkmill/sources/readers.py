"""Readers of seeds, texts, documents and listings, and the sinks that write results."""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkmill.functions.text import company_fingerprint, job_type
from larkmill.functions.text import normalize_space as tidy
from larkmill.session import bound_batches
from larkmill.sources.pdf import pdf_text

SEED = "name string, domain string, careers_url string"


def read_seed_csv(spark: SparkSession, path: str) -> DataFrame:
    """Companies from CSV with a header: name, domain or website, careers_url."""
    raw = spark.read.option("header", True).csv(path)
    have = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in raw.columns else F.lit(None).cast("string")
    return raw.select(
        have("name").alias("name"), F.coalesce(have("domain"), have("website")).alias("domain"),
        have("careers_url").alias("careers_url"),
    )


def read_seed_json(spark: SparkSession, path: str) -> DataFrame:
    """Companies from JSON: a list, or an object with a list under ``companies``."""
    item = "struct<name:string,domain:string,website:string,careers_url:string>"
    text = spark.read.text(path, wholetext=True)
    listed = F.coalesce(
        F.from_json("value", f"struct<companies:array<{item}>>")["companies"], F.from_json("value", f"array<{item}>")
    )
    rows = text.select(F.inline(listed))
    empty = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return rows.select(empty("name").alias("name"), F.coalesce(empty("domain"), empty("website")).alias("domain"), empty("careers_url").alias("careers_url"))


def read_seed_lines(spark: SparkSession, path: str) -> DataFrame:
    """One company a line; blank lines and those that start with # are skipped."""
    rows = spark.read.text(path).select(F.trim("value").alias("name"))
    none = F.lit(None).cast("string")
    return rows.where((F.col("name") != "") & ~F.col("name").startswith("#")).select(
        "name", none.alias("domain"), none.alias("careers_url")
    )


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: .csv, .json, .txt or .yaml/.yml."""
    suffix = path.rsplit(".", 1)[-1].lower()
    readers = {"csv": read_seed_csv, "json": read_seed_json, "txt": read_seed_lines, "yaml": read_yaml_records, "yml": read_yaml_records}
    if suffix not in readers:
        raise ValueError(f"unsupported seed file: {path}")
    return readers[suffix](spark, path)


YAML_LINE = re.compile(r"( *)((?:- +)*)(?:([\w.-]+)\s*:(?=\s|$))?\s*(.*)")
YAML_SCALAR = re.compile(r"""\"(?P<double>(?:[^\"\\]|\\.)*)\"|'(?P<single>(?:[^']|'')*)'|(?P<plain>(?:[^#]|(?<! )#)*)""")


def yaml_scalar(said: str) -> str:
    """What a plain or quoted scalar says; a comment begins with a # after a blank, outside quotes."""
    m = YAML_SCALAR.match(said)
    if m["double"] is not None:
        return json.loads(f'"{m["double"]}"', strict=False)
    if m["single"] is not None:
        return m["single"].replace("''", "'")
    return m["plain"].strip()


def parse_flat_yaml(text: str) -> dict[str, str]:
    """The scalars of a YAML document of mappings and lists in block style, by dotted names; items of lists by number.

    Anchors, tags, flow style and scalars of several lines aren't read; an empty value is left out."""
    out: dict[str, str] = {}
    above: list[list] = []  # [column, name, next number of a list]
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#") or line.strip() == "---":
            continue
        indent, dashes, key, said = YAML_LINE.match(line).groups()
        column = len(indent)
        for _ in re.findall("-", dashes):
            while above and (above[-1][0] > column or (above[-1][0] == column and above[-1][2] < 0 and key is None and not dashes)):
                above.pop()
            if above and above[-1][0] == column and above[-1][2] >= 0:
                above[-1][2] += 1
            else:
                above.append([column, "", 0])
            above[-1][1] = str(above[-1][2])
            column += 2
        if key is not None:
            while above and above[-1][0] >= column:
                above.pop()
            above.append([column, key, -1])
        value = "" if said.startswith("#") else yaml_scalar(said)
        if value:
            out[".".join(name for _, name, _ in above)] = value
    return out


def yaml_documents(spark: SparkSession, path: str) -> DataFrame:
    """Each document (value) of the YAML files at a path; a line of three dashes parts documents."""
    return spark.read.option("lineSep", "---\n").text(path).where(F.trim("value") != "")


def read_yaml_records(spark: SparkSession, path: str) -> DataFrame:
    """One record for each document of the YAML files at a path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [parse_flat_yaml(v) for v in batch["value"]]
            yield pd.DataFrame(
                [(r.get("name"), r.get("domain") or r.get("website"), r.get("careers_url") or r.get("careers.url")) for r in found],
                columns=["name", "domain", "careers_url"],
            )

    return yaml_documents(spark, path).mapInPandas(run, SEED)


def write_records(df: DataFrame, path: str, key: str, overwrite: bool = False) -> None:
    """Records as JSON files by key with an index beside them; an existing store is kept unless overwritten."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(f"{path}/records")
    df.select(key).distinct().write.mode("overwrite").json(f"{path}/index")


def write_yaml_records(df: DataFrame, path: str, key: str, overwrite: bool = False) -> None:
    """Each record as a YAML document of plain scalars, many to a file, with an index of the keys beside them; a store
    that is there is kept unless it is overwritten."""
    said = [F.concat(F.lit(f"{c}: "), F.to_json(F.struct(F.col(c).cast("string").alias("v")))) for c in df.columns]
    plain = [F.regexp_replace(x, r': \{"v":(.*)\}$', ": $1") for x in said]
    rows = df.select(F.concat(F.concat_ws("\n", *plain), F.lit("\n---")).alias("value"))
    rows.write.mode("overwrite" if overwrite else "errorifexists").text(f"{path}/records.yaml")
    df.select(key).distinct().write.mode("overwrite").json(f"{path}/index")


def preview(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("preview"))


def seed_companies(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming companies with status created, duplicate (stored, or earlier in the input) or error (no name)."""
    own = incoming.withColumn("fp", company_fingerprint(F.col("name")))
    known = stored.select(company_fingerprint(F.col("name")).alias("fp")).distinct().withColumn("_known", F.lit(True))
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("fp").orderBy("position"))
    marked = own.withColumn("_turn", turn).join(known, "fp", "left")
    status = (
        F.when(F.col("name").isNull(), "error")
        .when(F.col("_known") | (F.col("_turn") > 1), "duplicate")
        .otherwise("created")
    )
    return marked.select("position", "name", "fp", status.alias("status"))


# -- documents ---------------------------------------------------------------------------------------------------


def _pdf_text(data: bytes) -> str:
    """Pages joined by line breaks, by a package if it is there, else by the plain reader beside this module."""
    try:
        import pypdf
    except ImportError:
        return pdf_text(data)
    return "\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(data)).pages)


def _docx_text(data: bytes) -> str:
    """Paragraphs, then table rows with cells joined by a bar."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{w}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t")).strip()
    rows = [said(p) for p in body.findall(f"{w}p")]
    for row in body.iter(f"{w}tr"):
        rows.append(" | ".join(filter(None, (said(cell) for cell in row.findall(f"{w}tc")))))
    return "\n".join(filter(None, rows))


def document_text(path: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, error) of a .pdf, .docx, .doc or .txt file."""
    suffix = path.rsplit(".", 1)[-1].lower()
    try:
        if not data:
            return None, "empty file"
        if suffix == "pdf":
            text = _pdf_text(data)
        elif suffix in ("docx", "doc"):
            text = _docx_text(data)
        elif suffix == "txt":
            text = data.decode("utf-8", "replace")
        else:
            return None, f"unsupported format: .{suffix}"
        return (text, None) if text.strip() else (None, "no text")
    except (ValueError, KeyError, zlib.error, zipfile.BadZipFile, ElementTree.ParseError) as error:
        return None, str(error) or type(error).__name__


TASK_BYTES, TASK_PARTS = 128 << 20, 32  # of files, and of partitions of their scan, in a task at most


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of every file below a path; a file that can't be read keeps a row with its error.

    Spark counts 4 MB for each file, so that a task of its scan has 32 small ones; some of these tasks are made one."""
    bound_batches(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [document_text(p, bytes(c)) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], "text": [f[0] for f in found], "error": [f[1] for f in found]})

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    plan = raw._jdf.queryExecution()
    size, parts = int(plan.optimizedPlan().stats().sizeInBytes()), plan.toRdd().getNumPartitions()
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES), -(-parts // TASK_PARTS))
    out = raw.coalesce(tasks).mapInPandas(run, "path string, text string, error string")
    return out.withColumn("text", F.when(F.col("text").isNotNull(), tidy(F.col("text"))))


# -- listings of job interfaces ----------------------------------------------------------------------------------

LISTING = (
    "title", "company", "location", "url", "description", "source", "external_id", "posted_date", "job_type",
    "salary_min", "salary_max", "remote", "tags",
)


def _listing(df: DataFrame, **columns: Column) -> DataFrame:
    kinds = {"posted_date": "timestamp", "salary_min": "double", "salary_max": "double", "remote": "boolean", "tags": "array<string>"}
    made = [columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in LISTING]
    return df.select(*made)


def _said(path: str) -> Column:
    return F.coalesce(F.try_variant_get(F.col("v"), path, "string"), F.lit(""))


def paged_listing_a(raw: DataFrame) -> DataFrame:
    """Records (JSON text in ``value``) with jobtitle, formattedLocation, snippet, jobkey and an RFC 822 date."""
    df = raw.select(F.try_parse_json("value").alias("v")).where(F.col("v").isNotNull())
    date = F.regexp_extract(_said("$.date"), r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    return _listing(
        df, title=_said("$.jobtitle"), company=_said("$.company"), location=_said("$.formattedLocation"), url=_said("$.url"),
        description=_said("$.snippet"), source=F.lit("indeed"), external_id=_said("$.jobkey"),
        posted_date=F.try_to_timestamp(date, F.lit("d MMM yyyy HH:mm:ss")), job_type=job_type(_said("$.jobtype")),
        remote=F.lower(_said("$.formattedLocation")).contains("remote"),
    )


def paged_listing_b(raw: DataFrame) -> DataFrame:
    """Records with nested company, location and category, and an ISO date."""
    df = raw.select(F.try_parse_json("value").alias("v")).where(F.col("v").isNotNull())
    tag = F.try_variant_get("v", "$.category.tag", "string")
    return _listing(
        df, title=_said("$.title"), company=_said("$.company.display_name"), location=_said("$.location.display_name"),
        url=_said("$.redirect_url"), description=_said("$.description"), source=F.lit("adzuna"), external_id=_said("$.id"),
        posted_date=F.try_to_timestamp(_said("$.created")), salary_min=F.try_variant_get("v", "$.salary_min", "double"),
        salary_max=F.try_variant_get("v", "$.salary_max", "double"), tags=F.when(tag.isNotNull(), F.split(tag, ",")),
    )


def dump_listing(raw: DataFrame) -> DataFrame:
    """A whole dump as one JSON list in ``value``: its first element is a notice; dates are epoch seconds."""
    rows = raw.select(F.explode(F.slice(F.from_json("value", "array<string>"), 2, 1 << 30)).alias("r"))
    df = rows.select(F.try_parse_json("r").alias("v")).where(F.col("v").isNotNull())
    perks = F.try_variant_get("v", "$.benefits", "string")
    text = F.array_join(
        F.filter(F.array(_said("$.description"), F.when(perks != "", F.concat(F.lit("Benefits: "), perks))), lambda x: x != ""), "\n\n"
    )
    return _listing(
        df, title=_said("$.position"), company=_said("$.company"),
        location=F.coalesce(F.try_variant_get("v", "$.location", "string"), F.lit("Remote")),
        url=F.coalesce(F.try_variant_get("v", "$.apply_url", "string"), _said("$.url")), description=text, source=F.lit("remoteok"),
        external_id=_said("$.id"), posted_date=F.timestamp_seconds(F.try_variant_get("v", "$.date", "long")),
        salary_min=F.try_variant_get("v", "$.salary_min", "double"), salary_max=F.try_variant_get("v", "$.salary_max", "double"),
        remote=F.lit(True), tags=F.try_variant_get("v", "$.tags", "array<string>"),
    )


def combine_sources(*listings: DataFrame) -> DataFrame:
    """All sources in order, each row with its source's place."""
    out = None
    for k, df in enumerate(listings):
        own = df.withColumn("source_order", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return out
