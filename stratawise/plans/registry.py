"""Table schemas, links and references, as plain records kept as JSON."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

from stratawise.functions.values import storage_type

#: Key strategies in the order in which they are tried.
STRATEGIES = ("contentuid", "entry_name", "map_key", "uuid", "id", "row_id")
KEY_COLUMNS = {"contentuid": "contentuid", "entry_name": "_entry_name", "map_key": "MapKey", "uuid": "UUID", "id": "ID", "row_id": "_row_id"}
IDENTIFIER = re.compile(r"[A-Za-z0-9_]+")


def checked_name(name: str) -> str:
    """A table or column name that is safe to put into a path or plan."""
    if not IDENTIFIER.fullmatch(name):
        raise ValueError(f"not a name: {name!r}")
    return name


@dataclass(frozen=True)
class Reference:
    column: str
    table: str
    target: str


@dataclass
class TableSchema:
    name: str
    source_type: str
    region: str | None
    node: str | None
    strategy: str
    columns: dict[str, str] = field(default_factory=dict)  # name → domain type
    references: list[Reference] = field(default_factory=list)
    parents: list[str] = field(default_factory=list)

    @property
    def key(self) -> str:
        return KEY_COLUMNS[self.strategy]

    def struct(self, source: bool = True) -> T.StructType:
        """Columns by name, case-insensitive twins once; the key and the file id come first."""
        kinds = {"bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}
        seen, fields = set(), []
        for name, domain in [(self.key, "string"), ("_file_id", "int64"), *([("_source", "string")] if source else []), *sorted(self.columns.items())]:
            if name.lower() not in seen:
                seen.add(name.lower())
                fields.append(T.StructField(name, kinds[storage_type(domain)]))
        return T.StructType(fields)


@dataclass
class Registry:
    tables: dict[str, TableSchema] = field(default_factory=dict)
    links: dict[tuple[str, str], str] = field(default_factory=dict)  # (parent, child) → link table
    renames: dict[str, str] = field(default_factory=dict)

    def resolve(self, name: str) -> TableSchema | None:
        """A table by its name, an old name, or its two-part short name."""
        name = self.renames.get(name, name)
        short = "__".join(name.split("__")[:2])
        return self.tables.get(name) or self.tables.get(short)

    def by_region(self, region: str) -> TableSchema | None:
        """The region's table: one without parents, then fewest parents, then by name."""
        own = [t for t in self.tables.values() if t.region == region]
        return min(own, key=lambda t: (t.node == "root", len(t.parents), t.name), default=None)

    def children(self, parent: str) -> list[tuple[str, str]]:
        return sorted((child, link) for (p, child), link in self.links.items() if p == parent)

    def count_references(self) -> int:
        return sum(len(t.references) for t in self.tables.values())

    def valid_references(self, table: str) -> list[Reference]:
        """Only references to another table's key by a column that exists."""
        own = self.tables[table]
        return [r for r in own.references if r.column in own.columns and r.table in self.tables and self.tables[r.table].key == r.target]

    def to_json(self) -> str:
        return json.dumps({"tables": [asdict(t) for t in self.tables.values()], "links": [[p, c, n] for (p, c), n in sorted(self.links.items())], "renames": self.renames}, sort_keys=True, indent=1)

    @classmethod
    def from_json(cls, raw: str) -> Registry:
        d = json.loads(raw)
        tables = {t["name"]: TableSchema(**{**t, "references": [Reference(**r) for r in t["references"]]}) for t in d["tables"]}
        return cls(tables, {(p, c): n for p, c, n in d["links"]}, d["renames"])
