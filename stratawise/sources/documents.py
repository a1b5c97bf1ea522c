"""Node tables as YAML: a document a region, or one file a section with entries of many sources."""

from __future__ import annotations

import json
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratawise.functions.labels import section_rank
from stratawise.operators.precedence import first_wins
from stratawise.sources.node_rows import arrow_rows
from stratawise.sources.trees import MOST_DEPTH, NODES

#: Ordinals of nodes that share a part of a document or of a section's file.
PART_NODES = 4096
#: NODES with the source of an entry, which only section files give.
SOURCED_NODES = NODES + ", source string"

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#"'\-\[\]{},][^:#]*?)\s*:(?:\s+(.*))?$""")
_ESCAPE = re.compile(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", re.S)
#: What a letter after a backslash means.
_LETTERS = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}


# --- reading ------------------------------------------------------------------------------------


def _unescaped(m: re.Match) -> str:
    s = m[1]
    if s[0] in "xuU" and len(s) > 1:
        code = int(s[1:], 16)
        return chr(code) if code < 0x110000 else "\ufffd"
    return _LETTERS.get(s, s)


def _pair(s: str) -> tuple[str, str] | None:
    """Key and value of a mapping's line."""
    if s[0].isalpha():  # what the pattern finds, without it
        key, colon, value = s.partition(":")
        return None if not colon or "#" in key or value and not value[0].isspace() else (key.rstrip(), value.lstrip())
    m = _KEY.match(s)
    return (m[1], m[2] or "") if m else None


def _is_item(s: str) -> bool:
    return s[:1] == "-" and (len(s) == 1 or s[1].isspace())


def _scalar(s: str) -> Any:
    if s[:1] == '"':
        if len(s) > 1 and s[-1] == '"' and "\\" not in s and '"' not in s[1:-1]:
            return s[1:-1]
        m = re.match(r'"((?:[^"\\]|\\.)*)"\s*(?:#.*)?$', s, re.S)
        if not m:
            raise ValueError("a quoted text must end in its line")
        try:
            return json.loads(f'"{m[1]}"')  # joins surrogate pairs
        except ValueError:
            return _ESCAPE.sub(_unescaped, m[1])
    if s[:1] == "'":
        m = re.match(r"'((?:[^']|'')*)'\s*(?:#.*)?$", s)
        if not m:
            raise ValueError("a quoted text must end in its line")
        return m[1].replace("''", "'")
    s = re.sub(r"(^|\s)#.*$", "", s).strip()
    if s[:1] in ("[", "{") and s not in ("[]", "{}"):
        raise ValueError("flow collections are not read")
    return [] if s == "[]" else {} if s == "{}" else None if s in ("", "~", "null") else s


def _block(style: str, lines: list[str]) -> str:
    """The text of a literal or folded block."""
    margin = min((len(x) - len(x.lstrip(" ")) for x in lines if x.strip()), default=0)
    body = "\n".join(x[margin:] for x in lines)
    if style[0] == ">":
        body = re.sub(r"(?<!\n)\n(?!\n)", " ", body.rstrip("\n")) + "\n" * (len(body) - len(body.rstrip("\n")))
    if "+" in style:
        return body + "\n"
    body = body.rstrip("\n")
    return body if "-" in style or not body else body + "\n"


def load(text: str) -> Any:
    """The value of a YAML text in block style: mappings, lists, plain, quoted and block texts, empty flow collections.

    Works line by line over a stack of open collections, so nesting has no bound of its own."""
    lines, at, root = text.split("\n"), 0, [None]
    stack: list[tuple[int, Any]] = []  # indent, collection
    slot: tuple[Any, Any, int] | None = (root, 0, -1)  # where the next deeper value belongs

    def begin(indent: int, value: Any) -> None:
        nonlocal slot
        holder, key, _ = slot
        holder[key] = value
        slot = None
        stack.append((indent, value))

    def put(holder: Any, key: Any, s: str, indent: int) -> None:
        nonlocal slot, at
        if s[:1] in ("|", ">") and re.match(r"[|>][0-9+-]{0,2}\s*(?:#.*)?$", s):
            end = at
            while end < len(lines) and (not lines[end].strip() or len(lines[end]) - len(lines[end].lstrip(" ")) > indent):
                end += 1
            holder[key], at = _block(s, lines[at:end]), end
            return
        holder[key] = _scalar(s)
        slot = (holder, key, indent) if holder[key] is None else None

    while at < len(lines):
        raw = lines[at].rstrip("\r")
        at += 1
        rest = raw.lstrip(" ")
        if not rest or rest[0] == "#" or rest.rstrip() in ("---", "..."):
            continue
        indent = len(raw) - len(rest)
        if slot and (slot[2] > indent or (slot[2] == indent and not _is_item(rest))):
            slot = None  # the key had no value
        while stack and stack[-1][0] > indent:
            stack.pop()
        while _is_item(rest):
            if slot and (slot[2] < indent or isinstance(slot[0], dict)):
                begin(indent, [])
            while stack and stack[-1][0] == indent and isinstance(stack[-1][1], dict):
                stack.pop()
            if not stack or stack[-1][0] != indent or not isinstance(stack[-1][1], list):
                raise ValueError(f"line {at}: an item outside a list")
            items = stack[-1][1]
            items.append(None)
            slot = (items, len(items) - 1, indent)
            shorter = rest[1:].lstrip(" ")
            indent, rest = indent + len(rest) - len(shorter), shorter
        if not rest:
            continue
        pair = _pair(rest)
        if pair:
            if slot:
                begin(indent, {})
            while stack and stack[-1][0] == indent and isinstance(stack[-1][1], list):
                stack.pop()
            if not stack or stack[-1][0] != indent or not isinstance(stack[-1][1], dict):
                raise ValueError(f"line {at}: a key outside a mapping")
            put(stack[-1][1], _scalar(pair[0]), pair[1], indent)
        elif slot:
            put(slot[0], slot[1], rest, slot[2])
        else:
            raise ValueError(f"line {at}: neither an item nor a key")
    return root[0]


def parse(text: str) -> list[tuple]:
    """Rows of SOURCED_NODES without path and error, of a document (region_id, nodes) or a section file (section, entries)."""
    doc = load(text)
    kind = next(((r, n) for r, n in (("region_id", "nodes"), ("section", "entries")) if isinstance(doc, dict) and r in doc), None)
    if not kind:
        raise ValueError("neither a document nor a section")
    rows: list[tuple] = []
    stack = [(n, None, None, 0) for n in reversed(doc.get(kind[1]) or [])]
    source = None
    while stack:
        node, parent, top, depth = stack.pop()
        if depth > MOST_DEPTH:
            raise ValueError("nested too deeply")
        if not isinstance(node, dict):
            raise ValueError("a node is a mapping")
        own = len(rows)
        top, source = (own, node.get("source")) if top is None else (top, source)
        word = lambda v: "" if v is None else str(v)
        attrs = {word(a.get("id")): (word(a.get("type")), word(a.get("value")), None, None) for a in node.get("attributes") or [] if isinstance(a, dict) and a.get("id")}
        rows.append((word(doc[kind[0]]), word(node.get("id")), own, parent, top, depth, False, attrs, source))
        stack += [(c, own, top, depth + 1) for c in reversed(node.get("children") or [])]
    return rows


class Reader:
    """A document's nodes; its text is gathered and read as a whole."""

    def __init__(self):
        self.texts: list[str] = []

    def feed(self, text: str) -> list[tuple]:
        self.texts.append(text)
        return []

    def close(self) -> list[tuple]:
        return parse("".join(self.texts))


def read(files: DataFrame) -> DataFrame:
    """SOURCED_NODES from (path, text); a text that can't be read gives one error row."""
    return files.select("path", "text").mapInArrow(arrow_rows(Reader, (ValueError, TypeError, AttributeError), 11), SOURCED_NODES)


# --- writing ------------------------------------------------------------------------------------


def quoted(value: Column) -> Column:
    """A text as a double-quoted scalar."""
    inner = F.to_json(F.array(F.coalesce(value, F.lit(""))))
    inner = F.regexp_replace(inner, r"^\[|\]$", "")
    for c in ("\x7f", "\x85", "\u2028", "\u2029", "\ufeff"):
        inner = F.replace(inner, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return inner


def entry_texts(nodes: DataFrame, source: Column | None = None) -> DataFrame:
    """(path, region, root_ord, source, content, nodes): the YAML of each entry with its whole subtree, comments left out, and its
    number of nodes.

    Nodes in document order are lines in document order, so an entry is rendered by one sort of its own nodes;
    no task holds more than an entry."""
    tag = source if source is not None else F.lit(None).cast("string")
    own = nodes.where("error is null AND root_ord is not null AND NOT commented").select("path", "region", "root_ord", "node_ord", "depth", "node_id", "attrs", tag.alias("source"))
    entry = Window.partitionBy("path", "region", "root_ord").orderBy("node_ord")
    level = F.col("depth") - F.first("depth").over(entry)
    parent = F.coalesce(F.lead("depth").over(entry) > F.col("depth"), F.lit(False))
    pad = F.repeat(F.lit("  "), F.col("level") * 2)
    line = lambda a: F.concat(F.lit("\n"), pad, F.lit("  - id: "), quoted(a["key"]), F.lit("\n"), pad, F.lit("    type: "), quoted(a["value"]["type"]), F.lit("\n"), pad, F.lit("    value: "), quoted(F.coalesce(F.nullif(a["value"]["handle"], F.lit("")), a["value"]["value"])))
    attributes = F.when(F.size("attrs") > 0, F.concat(F.lit("\n"), pad, F.lit("  attributes:"), F.array_join(F.transform(F.map_entries("attrs"), line), ""))).otherwise("")
    head = F.when((F.col("level") == 0) & F.col("source").isNotNull(), F.concat(F.lit("- source: "), quoted(F.col("source")), F.lit("\n  id: "))).otherwise(F.concat(pad, F.lit("- id: ")))
    text = F.concat(head, quoted(F.col("node_id")), attributes, F.when(F.col("parent"), F.concat(F.lit("\n"), pad, F.lit("  children:"))).otherwise(""))
    rows = own.withColumns({"level": level.cast("int"), "parent": parent}).select("path", "region", "root_ord", "source", "node_ord", text.alias("content"))
    parts = F.array_sort(F.collect_list(F.struct(F.col("node_ord").alias("o"), F.col("content").alias("c"))))
    return rows.groupBy("path", "region", "root_ord").agg(F.max("source").alias("source"), F.array_join(F.transform(parts, lambda x: x["c"]), "\n").alias("content"), F.count("*").alias("nodes"))


def _joined(entries: DataFrame, by: list[str], order: list[str], head: Column) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(*order, "content")))
    body = F.array_join(F.transform(parts, lambda x: x["content"]), "\n")
    return entries.groupBy(*by).agg(F.count("*").alias("entries"), body.alias("content")).withColumn("content", F.concat(head, F.col("content"), F.lit("\n")))


def _region_head() -> Column:
    return F.concat(F.lit("region_id: "), quoted(F.col("region")), F.lit("\nnodes:\n"))


def _section_head() -> Column:
    return F.concat(F.lit("section: "), quoted(F.col("section")), F.lit("\nentries:\n"))


def document_texts(nodes: DataFrame) -> DataFrame:
    """(path, region, entries, content): each region of each document as YAML, in one row; see ``document_parts``."""
    return _joined(entry_texts(nodes), ["path", "region"], ["root_ord"], _region_head())


def _parts(entries: DataFrame, by: list[str], head: Column) -> DataFrame:
    """Entries joined to parts of about PART_NODES nodes, each with the head of its file, so that it is a document of its own."""
    dealt = entries.withColumn("part", F.floor(F.col("root_ord") / PART_NODES))
    parts = F.array_sort(F.collect_list(F.struct("root_ord", "content", "nodes")))
    body = F.array_join(F.transform("x", lambda e: e["content"]), "\n")
    size = F.aggregate("x", F.lit(0).cast("long"), lambda n, e: n + e["nodes"])
    rows = dealt.groupBy(*by, "part").agg(parts.alias("x"))
    return rows.select(*by, "part", F.get("x", F.lit(0))["root_ord"].alias("start"), F.size("x").alias("entries"), size.alias("nodes"), F.concat(head, body, F.lit("\n")).alias("content"))


def document_parts(nodes: DataFrame) -> DataFrame:
    """(path, region, part, start, entries, nodes, content): ``document_texts`` in parts of bounded size, which begin with node
    ``start`` and are documents of their own.  The whole text is the first part, then the others without their heads."""
    return _parts(entry_texts(nodes), ["path", "region"], _region_head())


def section_entries(nodes: DataFrame, section: Column, source: Column) -> DataFrame:
    """(section, source, path, root_ord, content): entries of all documents under their sources.

    This is the form to write at scale, a folder a section; ``section_texts`` makes the single files."""
    placed = nodes.withColumns({"region": section, "source": source})
    return entry_texts(placed, F.col("source")).withColumnRenamed("region", "section").select("section", "source", "path", "root_ord", "content", "nodes")


def section_texts(entries: DataFrame, order: list[str] = ["path", "root_ord"]) -> DataFrame:  # noqa: B006
    """(section, entries, content): one YAML file a section.  A file is one row, as large as its section."""
    return _joined(entries, ["section"], order, _section_head())


def section_parts(entries: DataFrame, first: list[str] = []) -> DataFrame:  # noqa: B006
    """(section, first..., path, part, start, entries, nodes, content): a section's file in parts of bounded size, which are
    section files of their own.

    The file is the first part and then the others without their heads, by ``first``, path and part; ``start`` is the number
    of nodes before a part."""
    parts = _parts(entries, ["section", *first, "path"], _section_head())
    order = [*first, "path", "part"]
    before = Window.partitionBy("section").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # Only numbers go through the window.  With the contents held on to, both sides of the join read one shuffle of them.
    places = parts.where(F.length("content") > 0).select("section", *order, F.coalesce(F.sum("nodes").over(before), F.lit(0)).alias("start"))
    same = reduce(Column.__and__, [F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in ("section", *order)])
    return parts.alias("p").join(places.alias("q"), same).select("p.section", *[f"p.{c}" for c in order], "q.start", "p.entries", "p.nodes", "p.content")


def _both(present: DataFrame, new: DataFrame) -> DataFrame:
    return present.withColumn("batch", F.lit(0)).unionByName(new.withColumn("batch", F.lit(1)))


def appended(present: DataFrame, new: DataFrame) -> DataFrame:
    """(section, entries, content): present entries in their order, new ones behind them."""
    return section_texts(_both(present, new), ["batch", "path", "root_ord"])


def appended_parts(present: DataFrame, new: DataFrame) -> DataFrame:
    """``appended`` as ``section_parts``."""
    return section_parts(_both(present, new), ["batch"])


def read_parts(parts: DataFrame) -> DataFrame:
    """SOURCED_NODES from (path, start, text): nodes of a part are numbered on from ``start``, as in the whole file or, for
    parts of a document, with gaps where comments and outer nodes stood."""
    named = parts.select(F.to_json(F.struct(F.col("start").cast("long").alias("s"), F.col("path").cast("string").alias("p"))).alias("path"), "text")
    read_ = read(named).withColumn("at", F.from_json("path", "s long, p string"))
    return read_.withColumns({"path": F.col("at.p"), **{n: F.col(n) + F.col("at.s") for n in ("node_ord", "parent_ord", "root_ord")}}).drop("at")


def key_index(nodes: DataFrame) -> DataFrame:
    """(uuid, section, source, name, node_id) of section files: one row a key, of the last section in output order and its
    last entry.  The key is the last attribute named UUID or MapKey that isn't blank, the name the first of Name,
    DisplayName, EntryName; letters in either case, outer blanks dropped."""
    tops = nodes.where("error is null AND node_ord = root_ord")
    given = F.filter(F.transform(F.map_entries("attrs"), lambda a: F.struct(F.lower(a["key"]).alias("k"), F.trim(a["value"]["value"]).alias("v"))), lambda a: a["v"] != "")
    pick = lambda *names: F.filter(F.col("given"), lambda a: a["k"].isin(*names))
    rows = tops.withColumn("given", given).select(
        F.get(F.reverse(pick("uuid", "mapkey")), F.lit(0))["v"].alias("uuid"),
        F.col("region").alias("section"), "source", F.get(pick("name", "displayname", "entryname"), F.lit(0))["v"].alias("name"), "node_id", "path", "node_ord",
    )
    last = [section_rank(F.col("section")).desc_nulls_last(), F.col("section").desc(), F.col("path").desc(), F.col("node_ord").desc()]
    return first_wins(rows.where("uuid is not null"), ["uuid"], last).drop("path", "node_ord")
