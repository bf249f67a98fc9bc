"""Sections of a text are found in a few searches, each of which is run once."""

from pyspark.sql import functions as F

from larkmill.functions.text import SECTION_PATTERNS, sections


def test_a_section_is_searched_for_once_and_its_end_once(spark):
    df = spark.createDataFrame([("Intro\nExperience at x. Academic honors.\n TECHNICAL SKILLS: a\n\nskills b",), (None,), ("skillset",)], "t string")
    found = df.select(sections(F.col("t")).alias("s"))
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("regexpinstr") + found._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_instr") <= 2 * len(SECTION_PATTERNS)
    assert [r["s"] for r in found.collect()] == [
        {"education": "Academic", "experience": "Experience at x.", "awards": "honors.", "skills": "TECHNICAL SKILLS: a\n\nskills b"}, {}, {},
    ]
