"""Checks of goal texts, JSON configurations and entries; findings are rows (path, line_no, severity, message)."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratawise.functions.text import is_guid
from stratawise.operators.integrity import unknown_references
from stratawise.operators.lint import lines

#: Sections of a goal text in their order, and goals that always exist.
GOAL_SECTIONS = ("Version", "SubGoalCombiner", "INITSECTION", "KBSECTION", "EXITSECTION", "ENDEXITSECTION")
KNOWN_GOALS = ("Act1", "Act2", "Act3")
FINDINGS = "path string, line_no int, severity string, message string"


def _finding(df: DataFrame, severity: str, message) -> DataFrame:
    return df.select("path", F.col("line_no").cast("int").alias("line_no"), F.lit(severity).alias("severity"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def goals(files: DataFrame) -> DataFrame:
    """Structure of goal texts: sections present once and in order, IF with THEN, closed strings."""
    real = lines(files, "path", "text").withColumn("line", F.trim("line")).where("line <> '' AND NOT startswith(line, '//')")
    section = F.lit(None).cast("int")
    for i, name in enumerate(GOAL_SECTIONS):
        section = F.coalesce(section, F.when(F.col("line").rlike(rf"^{name}\b"), F.lit(i)))
    seen = real.withColumn("section", section).where("section is not null")
    title = F.element_at(F.array(*[F.lit(s) for s in GOAL_SECTIONS]), F.col("section") + 1)
    w = Window.partitionBy("path").orderBy("line_no")
    twice = seen.withColumn("n", F.row_number().over(Window.partitionBy("path", "section").orderBy("line_no"))).where("n > 1")
    back = seen.withColumn("before", F.lag("section").over(w)).where("section < before")
    have = seen.groupBy("path").agg(F.collect_set("section").alias("have"))
    lacking = files.select("path").distinct().join(have, "path", "left").select("path", F.explode(F.array_except(F.array(*[F.lit(i) for i in range(len(GOAL_SECTIONS))]), F.coalesce("have", F.array().cast("array<int>")))).alias("section")).withColumn("line_no", F.lit(1))
    counts = real.groupBy("path").agg(F.count_if(F.col("line").rlike(r"^(IF|PROC|QRY)\b")).alias("heads"), F.count_if(F.col("line").rlike(r"^THEN\b")).alias("thens"), F.max("line_no").alias("line_no"))
    quotes = real.withColumn("q", F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))).where("q % 2 = 1")
    found = [
        _finding(twice, "error", F.concat(F.lit("repeated section "), title)), _finding(back, "error", F.concat(title, F.lit(" is out of order"))),
        _finding(lacking, "error", F.concat(F.lit("no section "), title)), _finding(counts.where("heads <> thens"), "error", F.concat(F.col("heads").cast("string"), F.lit(" rules but "), F.col("thens").cast("string"), F.lit(" THEN"))),
        _finding(quotes, "error", "a string isn't closed"),
    ]
    return reduce(DataFrame.union, found)


def goal_parents(files: DataFrame, name: str = "name") -> DataFrame:
    """Parent goals that neither exist nor are well known, from (name, text)."""
    edges = files.select(name, F.explode(F.regexp_extract_all("text", F.lit(r'(?m)^\s*ParentTargetEdge\s+"([^"]+)"'), 1)).alias("parent"))
    return unknown_references(edges, "parent", files, name, KNOWN_GOALS)


def json_configs(files: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """Whether texts are JSON objects with the required keys."""
    parsed = files.withColumn("v", F.from_json("text", "map<string,string>", {"mode": "PERMISSIVE"})).withColumn("line_no", F.lit(1))
    bad = _finding(parsed.where(F.expr("try_parse_json(text) IS NULL OR NOT startswith(ltrim(text), '{')")), "error", "not a JSON object")
    lacks = parsed.where("v is not null").withColumn("k", F.explode(F.array_except(F.array(*[F.lit(r) for r in required]) if required else F.array().cast("array<string>"), F.map_keys("v"))))
    return bad.union(_finding(lacks.join(bad.select("path"), "path", "left_anti"), "error", F.concat(F.lit("no key "), F.col("k"))))


def _blueprint(text: str) -> list[tuple[int, str, str]]:
    try:
        root = json.loads(text)
    except ValueError as e:
        return [(getattr(e, "lineno", 1), "error", "not JSON")]
    if not isinstance(root, dict):
        return [(1, "error", "not a JSON object")]
    out, ids, asked = [], {}, []
    if not isinstance(root.get("SchemaVersion"), int) or isinstance(root.get("SchemaVersion"), bool):
        out.append((1, "error", "SchemaVersion must be an integer"))
    if not any(isinstance(root.get(k), list) for k in ("Tabs", "Sections", "Settings")):
        return [*out, (1, "error", "no Tabs, Sections or Settings")]
    todo = [root]
    while todo:
        node = todo.pop()
        for k in ("Tabs", "Sections", "Settings"):
            todo += [x for x in node.get(k) or [] if isinstance(x, dict)] if isinstance(node.get(k), list) else []
        for s in (x for x in node.get("Settings") or [] if isinstance(x, dict)) if isinstance(node.get("Settings"), list) else ():
            name = s.get("Id")
            if not name:
                out.append((1, "error", "a setting without Id"))
                continue
            ids[name] = ids.get(name, 0) + 1
            limits = s.get("Options") or {}
            low, high, value = limits.get("Min"), limits.get("Max"), s.get("Default")
            if all(isinstance(x, int | float) for x in (low, high)) and low > high:
                out.append((1, "error", f"{name}: Min is above Max"))
            elif all(isinstance(x, int | float) for x in (low, high, value)) and not low <= value <= high:
                out.append((1, "warning", f"{name}: Default is outside Min and Max"))
            asked += [(name, c.get("SettingId")) for c in (s.get("VisibleIf") or {}).get("Conditions", []) if isinstance(c, dict)]
    out += [(1, "error", f"repeated setting {n}") for n, k in sorted(ids.items()) if k > 1]
    return out + [(1, "error", f"{n} refers to unknown setting {r}") for n, r in asked if r not in ids]


def blueprints(files: DataFrame) -> DataFrame:
    """Settings blueprints: unique ids, bounds, references of visibility conditions.  Nesting is free, so each document is walked in Python."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, *f) for p, t in zip(batch["path"], batch["text"], strict=True) for f in _blueprint(t or "")], columns=["path", "line_no", "severity", "message"])

    return files.select("path", "text").mapInPandas(run, FINDINGS)


def entries(df: DataFrame, key: str, section: str, required: Sequence[str] = ()) -> DataFrame:
    """(key, problem): keys that aren't guids, that come twice in a section or in another one, and empty required fields."""
    own = df.select(F.col(key).alias("key"), F.col(section).alias("section"), *required)
    shape = own.where(~F.coalesce(is_guid(F.col("key")), F.lit(False))).select("key", F.lit("not a guid").alias("problem"))
    counts = own.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("section").alias("s"))
    twice = counts.where("n > s").select("key", F.lit("repeated in its section").alias("problem"))
    other = counts.where("s > 1").select("key", F.lit("also in another section").alias("problem"))
    empty = [own.where(F.coalesce(F.col(c).cast("string"), F.lit("")) == "").select("key", F.lit(f"no {c}").alias("problem")) for c in required]
    return reduce(DataFrame.union, [shape, twice, other, *empty])
