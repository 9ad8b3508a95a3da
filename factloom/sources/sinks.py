"""Gold sets in, reports and JSON tables out."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = "query string, question string, category string, kind string, matchers int"
MATCHERS = "query string, matcher int, field string, wanted array<string>"


def write_json(df: DataFrame, path: str) -> None:
    """One compact JSON object a line, nulls kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", schema).alias("r")).select("r.*")


def read_gold(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, matchers) of a gold set in YAML, or JSON where no YAML reader is installed.

    A case has id, question, category and relevant_any or relevant_all (lists of matchers, each one field with a value or list
    of values), or expect_empty_or_low.
    """
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml

        loaded = yaml.safe_load(text)
    except ImportError:
        loaded = json.loads(text)
    cases, matchers = [], []
    for c in (loaded.get("cases", []) if isinstance(loaded, dict) else loaded) or []:
        kind = "low" if c.get("expect_empty_or_low") else "all" if c.get("relevant_all") else "any"
        wanted = c.get("relevant_all") or c.get("relevant_any") or []
        cases.append((str(c["id"]), c.get("question", ""), c.get("category", ""), kind, len(wanted)))
        for i, m in enumerate(wanted):
            matchers += [(str(c["id"]), i, f, [str(x) for x in (v if isinstance(v, list) else [v])]) for f, v in m.items()]
    return spark.createDataFrame(cases, CASES), spark.createDataFrame(matchers, MATCHERS)


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """A pretty JSON report of small result tables (means and cases), one list of rows each."""
    report = {name: [r.asDict(recursive=True) for r in df.collect()] for name, df in tables.items()}  # report tables are small by nature
    Path(path).write_text(json.dumps(report, indent=2, default=str), encoding="utf-8")
