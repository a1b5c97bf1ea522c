"""Stats texts: entries, key lists, equipment, value lists and modifiers.

A text is cut into lines in Spark; each grammar is a carried-header window over line
numbers, so nothing runs outside Catalyst and one long file is the only unit that must
stay together.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The line patterns.
NEW_ENTRY = r'^(?i:new entry) "(.+)"'
TYPE = r'^(?i:type) "(.+)"'
USING = r'^(?i:using) "(.+)"'
DATA = r'^(?i:data) "(.+)" "(.*)"'
EQUIPMENT = r'^new equipment "(.+)"'
VALUE_LIST = r'^valuelist "(.+)"'
VALUE = r'^value "(.+)"\s*(?::\s*(-?[0-9]+))?'
MODIFIER_TYPE = r'^modifier type "(.+)"'
MODIFIER = r'^modifier "(.+)","(.+)"'


def text_lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line_no, line), trimmed."""
    return files.select(F.col(path).alias("path"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line"))


def _carried(rows: DataFrame, pattern: str) -> DataFrame:
    """Adds the last header at or above each line of its file."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("header", F.last(F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")), ignorenulls=True).over(w))


def entries(files: DataFrame) -> DataFrame:
    """(path, entry_no, name, type, using, data): blocks of new entry; a blank line ends one."""
    rows = text_lines(files)
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("line").rlike(NEW_ENTRY)
    marked = rows.withColumn("block", F.sum(F.when(starts, 1).otherwise(0)).over(w)).where("block > 0")
    w2 = Window.partitionBy("path", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    body = marked.withColumn("ended", F.max(F.col("line") == "").over(w2)).where("NOT ended")
    first = lambda p: F.max_by(F.nullif(F.regexp_extract("line", p, 1), F.lit("")), F.when(F.col("line").rlike(p), F.col("line_no")))
    pairs = F.collect_list(F.when(F.col("line").rlike(DATA), F.struct("line_no", F.regexp_extract("line", DATA, 1).alias("k"), F.regexp_extract("line", DATA, 2).alias("v"))))
    # A repeated key keeps its last value.
    last = F.aggregate(F.array_sort(pairs), F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"])))
    return body.groupBy("path", F.col("block").alias("entry_no")).agg(first(NEW_ENTRY).alias("name"), F.coalesce(first(TYPE), F.lit("")).alias("type"), first(USING).alias("using"), last.alias("data"))


def csv_values(value: Column) -> Column:
    """Quoted or bare comma list; blanks between commas stay."""
    parts = F.regexp_extract_all(value, F.lit(r'(?:^|,)\s*("[^"]*"|[^,]*)'), 1)
    return F.transform(parts, lambda x: F.trim(F.regexp_replace(F.trim(x), '^"|"$', "")))


def keyed_entries(files: DataFrame, stem: str = "stem") -> DataFrame:
    """The other grammar: ``key "n","v"`` and ``new kw "n","p1",...`` rows with ``add kw ...`` lines
    joined to the entry above: (path, entry_no, name, type, data)."""
    rows = text_lines(files).where("line <> '' AND NOT startswith(line, '//')")
    opens = r"^(?:key|new\s+\S+)\s+"
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("entry_no", F.sum(F.when(F.col("line").rlike(opens), 1).otherwise(0)).over(w)).where("entry_no > 0")
    values = csv_values(F.regexp_extract("line", r'^(?:key|(?:new|add)\s+\S+)\s+(.*)$', 1))
    word = F.regexp_extract("line", r"^(?:new|add)\s+(\S+)", 1)
    cells = marked.select("path", "entry_no", "line_no", word.alias("word"), values.alias("v"), F.col("line").startswith("key").alias("is_key"), F.col("line").startswith("add").alias("is_add"))
    head = cells.where("NOT is_add").select("path", "entry_no", F.get("v", F.lit(0)).alias("name"), "is_key", F.slice("v", 2, 2**30).alias("params"))
    own = F.when(F.col("is_key"), F.when(F.size("params") > 0, F.create_map(F.lit("Value"), F.col("params")[0]))).otherwise(F.map_from_arrays(F.transform("params", lambda _, i: F.concat(F.lit("Param"), (i + 1).cast("string"))), F.col("params")))
    added = cells.where("is_add").groupBy("path", "entry_no", "word").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.array_join("v", ";").alias("t")))), lambda x: x["t"]), "|").alias("t"))
    extra = added.groupBy("path", "entry_no").agg(F.map_from_entries(F.collect_list(F.struct("word", "t"))).alias("extra"))
    nothing = F.create_map().cast("map<string,string>")
    out = head.withColumn("own", F.coalesce(own, nothing)).join(extra, ["path", "entry_no"], "left")
    stem_of = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return out.select("path", "entry_no", "name", stem_of.alias("type"), F.map_concat("own", F.coalesce("extra", nothing)).alias("data"))


def equipment(files: DataFrame) -> DataFrame:
    """(path, line_no, name)."""
    return text_lines(files).select("path", "line_no", F.regexp_extract("line", EQUIPMENT, 1).alias("name")).where("name <> ''")


def value_lists(files: DataFrame) -> DataFrame:
    """(path, list_key, index, value) rows under their header; an index not given counts on."""
    rows = _carried(text_lines(files), VALUE_LIST).where(F.col("line").rlike(VALUE) & F.col("header").isNotNull())
    n = F.row_number().over(Window.partitionBy("path", "header").orderBy("line_no")) - 1
    given = F.nullif(F.regexp_extract("line", VALUE, 2), F.lit("")).try_cast("int")
    return rows.select("path", F.col("header").alias("list_key"), F.coalesce(given, n).alias("index"), F.regexp_extract("line", VALUE, 1).alias("value"))


def modifiers(files: DataFrame) -> DataFrame:
    """(path, modifier_type, field, field_type)."""
    rows = _carried(text_lines(files), MODIFIER_TYPE).where(F.col("line").rlike(MODIFIER) & F.col("header").isNotNull())
    return rows.select("path", F.col("header").alias("modifier_type"), F.regexp_extract("line", MODIFIER, 1).alias("field"), F.regexp_extract("line", MODIFIER, 2).alias("field_type"))


def sniff(files: DataFrame) -> DataFrame:
    """Adds the grammar that a text's first significant line belongs to."""
    first = F.regexp_extract("text", r"(?m)^\s*(?!//)(\S.*)$", 1)
    kind = F.when(first.rlike(EQUIPMENT), "equipment").when(first.rlike("^valuelist "), "valuelist").when(first.rlike("^modifier type "), "modifier").when(first.rlike(NEW_ENTRY), "entries").when(first.rlike(r"^(key|new|add)\s"), "keyed").otherwise("raw")
    return files.withColumn("grammar", kind)


def ingest(files: DataFrame) -> dict[str, DataFrame]:
    """Every grammar's rows; a text that yields none becomes one raw row."""
    kinds = sniff(files)
    own = lambda k: kinds.where(F.col("grammar") == k)
    return {"entries": entries(own("entries")), "keyed": keyed_entries(own("keyed")), "equipment": equipment(own("equipment")), "valuelists": value_lists(own("valuelist")), "modifiers": modifiers(own("modifier")), "raw": own("raw").select("path", "text")}


def render(df: DataFrame, order: str = "name") -> DataFrame:
    """One row (content): entry blocks in order with data keys ascending, parted by blank lines."""
    data = F.transform(F.array_sort(F.map_entries("data")), lambda e: F.concat(F.lit('data "'), e["key"], F.lit('" "'), e["value"], F.lit('"')))
    lines = F.array_compact(F.concat(F.array(F.concat(F.lit('new entry "'), F.col("name"), F.lit('"')), F.when(F.col("type") != "", F.concat(F.lit('type "'), F.col("type"), F.lit('"'))), F.when(F.col("using").isNotNull(), F.concat(F.lit('using "'), F.col("using"), F.lit('"')))), data))
    blocks = df.select(F.col(order).alias("o"), F.array_join(lines, "\n").alias("b"))
    return blocks.agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "b"))), lambda x: x["b"]), "\n\n"), F.lit("\n")).alias("content"))


def is_loca_column(name: str) -> bool:
    """Whether a stats column holds text handles, by its name."""
    low = name.lower()
    return any(x in low for x in ("displayname", "description", "extradescription", "tooltip", "shortdescription", "title")) and "params" not in low and not re.search("_version$", low)
