"""Rule packs over lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratawise.functions.text import glob_match, substitute_captures


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) from 1."""
    return df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def apply_line_rules(rows: DataFrame, rules: list[dict]) -> DataFrame:
    """Findings (all columns of rows, rule, severity, message).

    A rule is name, pattern, message, severity, and negate to report lines that lack the pattern.
    Rules are a literal list, so each row is tested in one projection and no join is needed."""
    tests = []
    for r in rules:
        hit = F.col("line").rlike(r["pattern"])
        message = F.lit(r["message"]) if r.get("negate") else substitute_captures(F.lit(r["message"]), F.col("line"), r["pattern"])
        tests.append(F.when(~hit if r.get("negate") else hit, F.struct(F.lit(r["name"]).alias("rule"), F.lit(r.get("severity", "warning")).alias("severity"), message.alias("message"))))
    return rows.withColumn("__f", F.explode(F.array_compact(F.array(*tests)))).select(*rows.columns, "__f.*")


def apply_block_rules(rows: DataFrame, key: str, start: str, end: str, pattern: str, rule: str) -> DataFrame:
    """Blocks from a start line to the next delimiter line whose joined text matches: (key, line_no, rule, block)."""
    w = Window.partitionBy(key).orderBy("line_no")
    opened = rows.withColumn("__b", F.sum(F.when(F.col("line").rlike(start), 1).otherwise(0)).over(w)).where("__b > 0")
    w2 = Window.partitionBy(key, "__b").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    body = opened.withColumn("__ended", F.coalesce(F.max(F.col("line").rlike(end)).over(w2), F.lit(False))).where("NOT __ended")
    blocks = body.groupBy(key, "__b").agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("block"))
    return blocks.where(F.col("block").rlike(pattern)).select(key, "line_no", F.lit(rule).alias("rule"), "block")


def suppressed(findings: DataFrame, rows: DataFrame, key: str, marker: str = r"lint-disable:\s*([\w-]+)") -> DataFrame:
    """Findings without those disabled on their own or the previous line."""
    named = F.regexp_extract("line", marker, 1)
    off = rows.select(key, F.explode(F.array(F.col("line_no"), F.col("line_no") + 1)).alias("line_no"), named.alias("rule")).where("rule <> ''").distinct()
    return findings.join(off, [key, "line_no", "rule"], "left_anti")


def configured(findings: DataFrame, config: dict) -> DataFrame:
    """Severity overrides by rule ("off" drops) and globs of paths to ignore."""
    severity: Column = F.col("severity")
    for rule, level in config.get("severity", {}).items():
        severity = F.when(F.col("rule") == rule, F.lit(level)).otherwise(severity)
    out = findings.withColumn("severity", severity).where("severity <> 'off'")
    for pattern in config.get("ignore", []):
        out = out.where(~glob_match(F.col("path"), pattern))
    return out
