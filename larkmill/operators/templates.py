"""Form and portal templates as nested rows: validation, security audit, lint, substitution and field mapping."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkmill.functions import text as T
from larkmill.functions.urls import allowed_domain

# Fixed values.
ALLOWED_VARIABLES = (
    r"^profile\.(?!password|secret|token)[a-zA-Z_][a-zA-Z0-9_]*$",
    r"^files\.[a-zA-Z_][a-zA-Z0-9_]*$",
    r"^answers\.[a-zA-Z_][a-zA-Z0-9_]*$",
    r"^company_[a-zA-Z_][a-zA-Z0-9_]*$",
)
DANGEROUS_VALUES = (
    r"<script[^>]*>.*?</script>", r"javascript:", r"data:text/html", r"on\w+\s*=", r"expression\s*\(", r"@import",
    r"<iframe[^>]*>", r"<object[^>]*>", r"<embed[^>]*>",
)
DANGEROUS_SCRIPTS = (
    r"eval\s*\(", r"Function\s*\(", r"document\.write", r"innerHTML\s*=", r"outerHTML\s*=", r"window\.", r"location\.",
    r"XMLHttpRequest", r"fetch\s*\(", r"import\s*\(", r"require\s*\(",
)
KNOWN_TRANSFORMS = ("upper", "lower", "title", "strip", "format_phone", "format_date")
MAX_STEPS = 100
STEP = "struct<id:string,action:string,selector:string,value:string,script:string,timeoutMs:int>"
PORTAL_TEMPLATE = f"struct<version:string,meta:struct<description:string,author:string>,start:struct<url:string>,steps:array<{STEP}>>"
FIELD = (
    "struct<field_id:string,field_name:string,field_type:string,css_selector:string,xpath:string,options:array<string>,"
    "rules:array<string>,source_field:string,transform:string,default_value:string,condition:string>"
)
FORM_TEMPLATE = f"struct<template_id:string,portal_name:string,sections:array<struct<section_id:string,fields:array<{FIELD}>>>>"

# Extension point: named transforms of a field value.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "upper": F.upper,
    "lower": F.lower,
    "title": F.initcap,
    "strip": F.trim,
    "format_phone": T.phone_format,
    "format_date": lambda x: x.cast("string"),
}


def _any(text: Column, patterns, flags: str = "") -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(flags + p) for p in patterns])


def variables(text: Column) -> Column:
    """Names in {{ }} without repeats."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\{\{\s*([^}]+)\s*\}\}"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.trim(x)))


def allowed_variable(name: Column) -> Column:
    return _any(name, ALLOWED_VARIABLES)


def dangerous_value(value: Column) -> Column:
    return _any(F.coalesce(value, F.lit("")), DANGEROUS_VALUES, "(?i)")


def sanitize(value: Column, context: str = "text") -> Column:
    """Escaped for text or attributes; encoded for URLs, where the reserved marks stay. Dangerous values become null."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    if context == "url":
        safe = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
        for mark in ":/?#[]@!$&'()*+,;=~":
            code = f"%{ord(mark):02X}"
            safe = F.replace(safe, F.lit(code), F.lit(mark))
    else:
        safe = T.escape_html(text)
    return F.when(~dangerous_value(text), safe)


def substitute(template: Column, values: Column, context: str = "text") -> Column:
    """The template with the values of a map put in, blanks inside the braces or not. Unknown names stay; a disallowed
    name or a dangerous value makes the result null."""
    names = variables(template)
    bad = F.exists(names, lambda n: ~allowed_variable(n) | dangerous_value(F.try_element_at(values, n)))
    tight = F.regexp_replace(template, r"\{\{\s*([^}]+?)\s*\}\}", "{{$1}}")
    known = F.filter(F.map_entries(values), lambda e: F.array_contains(names, e["key"]))
    filled = F.aggregate(
        known, tight,
        lambda acc, e: F.replace(acc, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(sanitize(e["value"], context), F.lit(""))),
    )
    return F.when(~bad, filled)


def security_violations(templates: DataFrame, key: str, body: str) -> DataFrame:
    """(key, violation) of portal templates in JSON: too many steps, foreign start URL, scripts, variables."""
    t = templates.select(key, F.from_json(body, PORTAL_TEMPLATE).alias("t"))
    whole = t.select(
        key,
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.size("t.steps") > MAX_STEPS, F.concat(F.lit("Too many steps: "), F.size("t.steps").cast("string"))),
                    F.when(
                        (F.col("t.start.url") != "") & ~allowed_domain(F.col("t.start.url")),
                        F.concat(F.lit("Start URL not allowed: "), F.col("t.start.url")),
                    ),
                )
            )
        ).alias("violation"),
    )
    steps = t.select(key, F.posexplode("t.steps").alias("i", "s"))
    step = F.concat(F.lit("Step "), F.col("i").cast("string"), F.lit(": "))
    scripts = steps.where((F.col("s.action") == "script") & _any(F.coalesce("s.script", F.lit("")), DANGEROUS_SCRIPTS, "(?i)"))
    rows = [whole, scripts.select(key, F.concat(step, F.lit("Dangerous script")).alias("violation"))]
    for name in ("value", "selector", "script"):
        used = steps.select(key, step.alias("at"), F.explode(variables(F.col(f"s.{name}"))).alias("v"))
        rows.append(
            used.where(~allowed_variable(F.col("v"))).select(key, F.concat("at", F.lit("Disallowed variable "), "v", F.lit(f" in {name}")).alias("violation"))
        )
    return reduce(DataFrame.union, rows)


def lint(templates: DataFrame, key: str, body: str) -> DataFrame:
    """(key, issue): missing description, author, step ids and selectors, long waits, unsafe variables."""
    t = templates.select(key, F.col(body).alias("raw"), F.from_json(body, PORTAL_TEMPLATE).alias("t"))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    meta = t.select(
        key,
        F.explode(
            F.array_compact(
                F.array(
                    F.when(empty("t.meta.description"), F.lit("Missing description")),
                    F.when(empty("t.meta.author"), F.lit("Missing author")),
                )
            )
        ).alias("issue"),
    )
    steps = t.select(key, F.posexplode("t.steps").alias("i", "s"))
    at = F.concat(F.lit("Step "), (F.col("i") + 1).cast("string"), F.lit(": "))
    found = F.array_compact(
        F.array(
            F.when(empty("s.id"), F.concat(at, F.lit("Missing id"))),
            F.when((F.col("s.action") == "wait") & (F.col("s.timeoutMs") > 10000), F.concat(at, F.lit("Long wait"))),
            F.when(F.col("s.action").isin("click", "type", "select", "upload") & empty("s.selector"), F.concat(at, F.lit("Missing selector"))),
        )
    )
    unsafe = t.select(key, F.explode(variables(F.col("raw"))).alias("v")).where(~allowed_variable(F.col("v")))
    return meta.union(steps.select(key, F.explode(found).alias("issue"))).union(
        unsafe.select(key, F.concat(F.lit("Unsafe variable: "), "v").alias("issue"))
    )


def form_errors(templates: DataFrame, key: str, body: str) -> DataFrame:
    """(key, error) of form templates in JSON."""
    t = templates.select(key, F.from_json(body, FORM_TEMPLATE).alias("t"))
    empty = lambda x: F.coalesce(x, F.lit("")) == ""
    whole = F.array_compact(
        F.array(
            F.when(empty(F.col("t.template_id")), F.lit("Template ID is required")),
            F.when(empty(F.col("t.portal_name")), F.lit("Portal name is required")),
            F.when(F.coalesce(F.size("t.sections"), F.lit(0)) <= 0, F.lit("At least one section is required")),
        )
    )
    sections = t.select(key, F.explode("t.sections").alias("s"))
    in_section = F.concat(F.lit("Section "), F.coalesce("s.section_id", F.lit("")), F.lit(": "))
    section_errors = F.array_compact(
        F.array(
            F.when(empty(F.col("s.section_id")), F.concat(in_section, F.lit("Section ID is required"))),
            F.when(F.coalesce(F.size("s.fields"), F.lit(0)) <= 0, F.concat(in_section, F.lit("At least one field is required"))),
        )
    )
    fields = sections.select(key, in_section.alias("at"), F.explode("s.fields").alias("f"))
    at = F.concat("at", F.lit("field "), F.coalesce("f.field_id", F.lit("")), F.lit(": "))
    known = reduce(lambda a, b: a | b, [F.col("f.transform").contains(x) for x in KNOWN_TRANSFORMS])
    field_errors = F.array_compact(
        F.array(
            F.when(empty(F.col("f.field_id")), F.concat(at, F.lit("Field ID is required"))),
            F.when(empty(F.col("f.field_name")), F.concat(at, F.lit("Field name is required"))),
            F.when(
                F.col("f.field_type").isin("select", "radio") & (F.coalesce(F.size("f.options"), F.lit(0)) <= 0),
                F.concat(at, F.col("f.field_type"), F.lit(" needs options")),
            ),
            F.when(empty(F.col("f.css_selector")) & empty(F.col("f.xpath")), F.concat(at, F.lit("Selector or xpath is required"))),
            F.when((F.col("f.transform") != "") & ~known, F.concat(at, F.lit("Invalid transform "), F.col("f.transform"))),
        )
    )
    repeats = (
        fields.groupBy(key, F.col("f.field_id").alias("_field")).agg(F.count("*").alias("n")).where("n > 1")
        .select(key, F.explode(F.array_repeat(F.concat(F.lit("Duplicate field ID: "), "_field"), (F.col("n") - 1).cast("int"))).alias("error"))
    )
    rows = [
        t.select(key, F.explode(whole).alias("error")), sections.select(key, F.explode(section_errors).alias("error")),
        fields.select(key, F.explode(field_errors).alias("error")), repeats,
    ]
    return reduce(DataFrame.union, rows)


def nested(variant: Column, path: Column) -> Column:
    """A dotted path in a variant; null where it leads nowhere."""
    return F.try_variant_get(variant, F.concat(F.lit("$."), path), "string")


def map_fields(templates: DataFrame, key: str, body: str, profiles: DataFrame, profile_id: str, data: str) -> DataFrame:
    """(key, profile_id, field_id, value): each field of a form filled from each profile's JSON data.

    A field whose condition fails has no row. Empty values take the default, then the transform; values that break
    a rule, or fit no option, become null.
    """
    fields = templates.select(key, F.explode(F.from_json(body, FORM_TEMPLATE)["sections"]).alias("s")).select(key, F.explode("s.fields").alias("f"))
    fields = fields.where(F.col("f.source_field").isNotNull())
    people = profiles.select(profile_id, F.try_parse_json(data).alias("v"))
    both = fields.join(people)
    condition = F.coalesce(F.col("f.condition"), F.lit(""))
    has = nested(F.col("v"), F.substring(condition, 5, 1000)).isNotNull()
    left = F.trim(F.split_part(condition, F.lit("=="), F.lit(1)))
    right = F.regexp_replace(F.trim(F.split_part(condition, F.lit("=="), F.lit(2))), "^[\"']|[\"']$", "")
    holds = F.when(condition.startswith("has_"), has).when(condition.contains("=="), nested(F.col("v"), left).eqNullSafe(right)).otherwise(True)
    raw = F.coalesce(F.nullif(nested(F.col("v"), F.col("f.source_field")), F.lit("")), F.nullif("f.default_value", F.lit("")))
    name = F.split_part(F.coalesce("f.transform", F.lit("")), F.lit("("), F.lit(1))
    value = raw
    for label, change in TRANSFORMS.items():
        value = F.when(name == label, change(raw)).otherwise(value)
    rules = F.coalesce("f.rules", F.array().cast("array<string>"))
    breaks = (F.array_contains(rules, "email_format") & ~T.valid_email(F.col("value"))) | (
        F.array_contains(rules, "phone_format") & ~T.valid_phone(F.col("value"))
    )
    options = F.col("f.options")
    chosen = F.when(
        (F.col("f.field_type") == "select") & (F.size(options) > 0) & ~F.array_contains(options, F.col("value")),
        T.closest_option(F.col("value"), options),
    ).otherwise(F.col("value"))
    filled = both.where(holds).withColumn("value", value)
    return filled.select(key, profile_id, "f.field_id", F.when(~F.coalesce(breaks, F.lit(False)), chosen).alias("value"))


class FormBuilder:
    """Builds a form template step by step on the driver."""

    def __init__(self, template_id: str, portal_name: str):
        self.template = {"template_id": template_id, "portal_name": portal_name, "sections": []}

    def section(self, section_id: str) -> FormBuilder:
        self.template["sections"].append({"section_id": section_id, "fields": []})
        return self

    def field(self, field_id: str, source_field: str | None = None, **more) -> FormBuilder:
        self.template["sections"][-1]["fields"].append({"field_id": field_id, "field_name": field_id, "source_field": source_field} | more)
        return self

    def to_json(self) -> str:
        import json

        return json.dumps(self.template)


def plan_applications(jobs: DataFrame, configs: DataFrame, templates: DataFrame) -> DataFrame:
    """The newest active template of each job's company portal: (job_id, template_id, version). Nothing is submitted.

    A portal's newest is found first and a company's among its portals', so a job meets one row and not every template.
    """
    newest = F.min(F.struct(F.col("version").isNull().alias("none"), (-F.col("version")).alias("back"), "template_id", "version")).alias("newest")
    portals = templates.where("is_active").groupBy("portal_id").agg(newest)
    again = F.min("newest").alias("newest")
    companies = configs.join(portals, "portal_id").groupBy("company_id").agg(again)
    return jobs.join(companies, "company_id").groupBy("job_id").agg(again).select("job_id", "newest.template_id", "newest.version")


def markdown_columns(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, column) of the first column of every table row in a Markdown text, headings and rules left out."""
    rows = docs.select(key, F.explode(F.split(text, "\n")).alias("line")).where(F.col("line").rlike(r"^\s*\|"))
    name = F.trim(F.regexp_replace(F.split_part("line", F.lit("|"), F.lit(2)), "`", ""))
    return rows.select(key, name.alias("column")).where((F.col("column") != "") & ~F.lower("column").isin("column", "name", "field") & ~F.col("column").rlike(r"^:?-+:?$"))


def schema_difference(documented: DataFrame, actual: DataFrame) -> DataFrame:
    """(key, column, side) of columns that only one side has."""
    only = lambda a, b, side: a.exceptAll(b).withColumn("side", F.lit(side))
    return only(documented.distinct(), actual.distinct(), "documented").union(only(actual.distinct(), documented.distinct(), "actual"))
