from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stratawise.operators import config
from stratawise.sources import documents, effects, manifest, trees

YAML = """# a comment
---
region_id: 'R''s'
nodes:
- id: A
  attributes:
    - id: UUID
      type: guid
      value: k1
    - id: T
      type: LSString
      value: |-
        two
          lines
    - id: Q
      type: LSString
      value: "a: \\"b\\" \\u00e9\\x41 # no"
  children:
  - id: Box
    children:
    - id: Leaf
      attributes:
      - {}
- id: B # the last
"""


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_yaml_subset():
    got = documents.parse(YAML)
    assert [(r[0], r[1], r[2], r[3], r[4], r[5]) for r in got] == [("R's", "A", 0, None, 0, 0), ("R's", "Box", 1, 0, 0, 1), ("R's", "Leaf", 2, 1, 0, 2), ("R's", "B", 3, None, 3, 0)]
    assert {k: v[1] for k, v in got[0][7].items()} == {"UUID": "k1", "T": "two\n  lines", "Q": 'a: "b" éA # no'}
    assert documents.load("a:\n  - - 1\n    - 2\n  - b: >\n      x\n      y\nc: []\nd:\n") == {"a": [["1", "2"], {"b": "x y\n"}], "c": [], "d": None}
    for bad in ("a: [1, 2]", "- x\nb: 1", 'a: "open', "a: 1\n   b c"):
        with pytest.raises(ValueError):
            documents.load(bad)


def test_bad_documents_give_error_rows(spark):
    deep = "region_id: R\nnodes:\n" + "".join(f"{'  ' * 2 * i}- id: n\n{'  ' * 2 * i}  children:\n" for i in range(2100))
    texts = [("ok", YAML), ("null", None), ("empty", ""), ("other", "a: 1"), ("item", "region_id: R\nnodes:\n- x"), ("deep", deep), ("none", "region_id: R\nnodes: []")]
    got = documents.read(spark.createDataFrame(texts, "path string, text string"))
    assert rows(got.where("error is not null"), "path") == [("deep",), ("empty",), ("item",), ("null",), ("other",)]
    assert got.where("error is null").count() == 4
    assert documents.read(spark.createDataFrame([], "path string, text string")).count() == 0


def test_round_trip_keeps_odd_texts(spark):
    odd = ['"', "\\", "a\nb", "\t", "[x]", "- a", "é😀\u2028", "", " x ", "#", "y" * 300_000]
    node = lambda i, v: (f"d{i % 2}", "R", "N", i, None, i, 0, False, {"V": ("LSString", v, None, None), "H": ("TranslatedString", "value", f"h{i}", "1")}, None)
    nodes = spark.createDataFrame([node(i, v) for i, v in enumerate(odd)] + [("d0", "R", "gone", 99, None, 99, 0, True, {}, None), ("bad", *[None] * 8, "broken")], trees.NODES)
    texts = documents.document_texts(nodes)
    assert rows(texts, "path", "region", "entries") == [("d0", "R", 6), ("d1", "R", 5)]
    again = documents.read(texts.select("path", F.col("content").alias("text")))
    assert sorted(r[0] for r in again.select(F.col("attrs")["V"]["value"]).collect()) == sorted(odd)
    assert {r[0] for r in again.select(F.col("attrs")["H"]["value"]).collect()} == {f"h{i}" for i in range(len(odd))}


def test_key_index_takes_the_last_section(spark):
    text = lambda section, source, key, name: f"section: {section}\nentries:\n- source: {source}\n  id: N\n  attributes:\n  - id: uuid\n    type: guid\n    value: {key}\n  - id: Name\n    type: LSString\n    value: {name}\n"
    files = [("a", text("Tags", "Base", "k", "late")), ("b", text("Races", "Mod", "k", "early")), ("c", text("Races", "Mod", "' '", "blank"))]
    got = documents.key_index(documents.read(spark.createDataFrame(files, "path string, text string")))
    assert rows(got, "uuid", "section", "source", "name", "node_id") == [("k", "Tags", "Base", "late", "N")]


def test_manifest_fields_of_any_form(spark):
    text = """region_id: Config
nodes:
- id: Dependencies
  children:
  - id: ModuleShortDesc
    attributes:
    - {id}
- id: ModuleInfo
  attributes:
  - id: UUID
    type: FixedString
    value: u
  - id: Version64
    type: int64
    value: "36028797018963968"
  children:
  - id: TargetModes
    children:
    - id: Target
      attributes:
      - id: Object
        type: FixedString
        value: Story
""".replace("- {id}", "- id: UUID\n      type: FixedString\n      value: d")
    got = manifest.from_nodes(documents.read(spark.createDataFrame([("m", text), ("n", "region_id: R\nnodes:\n- id: X\n")], "path string, text string"))).collect()
    assert [(r.path, r.uuid, r.version, r.publish_version, r.target_mode, [d.uuid for d in r.dependencies], r.name) for r in got] == [("m", "u", "1.0.0.0", "", "Story", ["d"], None)]


def effect(inside: str) -> str:
    return f'<effect id="e"><trackgroups><trackgroup name="G"><track name="T">{inside}</track></trackgroup></trackgroups></effect>'


def test_effect_edges(spark):
    texts = [
        ("bare", "<effect/>"), ("null", None), ("blank", " \n"), ("bad", "<effect"), ("same", "<effect id='e'/>"), ("hollow", effect("<component/>")),
        ("long", effect('<component class="C" end="x"><properties><property id="p"><data/></property><property id="q"><data><datum value="' + "v" * 300_000 + '"/></data></property></properties></component>')),
        ("ramps", effect('<component class="C" end="2.5"><properties><property id="r"><data><datum><rampchanneldata/></datum></data></property></properties></component>')),
    ]
    got = effects.read(spark.createDataFrame(texts, "path string, text string"))
    assert rows(got, "path", "error") == [("bad", "not an effect document"), *[(p, None) for p in ("bare", "hollow", "long", "ramps", "same")]]
    parts = effects.tables(got)
    assert rows(parts["effects"], "path", "id") == [("bare", effects.NO_KEY), ("hollow", "e")]
    assert rows(parts["components"], "path", "class_name", "end") == [("hollow", "", ""), ("long", "C", "x"), ("ramps", "C", "2.5")]
    assert rows(parts["properties"], "path", "property_guid") == [("long", "p"), ("long", "q"), ("ramps", "r")]
    known = spark.createDataFrame([], "class_name string, guid string, name string, type string, full_name string")
    runtime = effects.runtime_texts(got, known)
    durations = runtime.select("path", F.regexp_extract("content", 'id="Duration" type="float" value="([^"]*)"', 1).alias("d"))
    assert rows(durations, "path", "d") == [("bare", "0"), ("hollow", "0"), ("long", "0"), ("ramps", "2.5"), ("same", "0")]
    nodes = trees.read(runtime.select("path", F.col("content").alias("text")))
    assert nodes.where("error is not null").count() == 0
    back = effects.decompiled(nodes, known)
    assert rows(back["properties"].where("place >= 0"), "path", "property_guid", "frames") == [("long", "q", None), ("ramps", "r", [])]


def test_rendered_effects_are_stable(spark):
    texts = [("a", effect('<component class="a&amp;b" start="0" end="1" instancename="&lt;i&gt;"><properties><property id="p"><data><datum platform="x" lod="y" value=" &quot;v&apos; "/></data></property></properties></component>'))]
    once = effects.render(effects.read(spark.createDataFrame(texts, "path string, text string")))
    twice = effects.render(effects.read(once.select("path", F.col("content").alias("text"))))
    assert once.collect() == twice.collect()
    assert effects.data(effects.read(once.select("path", F.col("content").alias("text")))).first()["value"] == " \"v' "


def test_long_sections_are_read_back(spark):
    listed = lambda n, at=0: "".join(f"  - {i}\n" for i in range(at, at + n))
    texts = [("long", "Feats:\n" + listed(60_000) + "Races:\n" + listed(2) + "gap\n" + listed(1)), ("odd", "junk\nTags:\n  - \n  -x\nA b:\n" + listed(1) + "None:\nTags:\n  - a: b\r\n  - last"), ("null", None)]
    got = config.read_yaml(spark.createDataFrame(texts, "path string, text string"))
    assert rows(got.where("path <> 'long'"), "section", "pos", "json") == [("Tags", 0, ""), ("Tags", 0, "a: b\r"), ("Tags", 1, "last")]
    found = got.where("path = 'long'").groupBy("section").agg(F.count("*").alias("n"), F.max("pos").alias("last"), F.sum(F.col("json").cast("long") - F.col("pos")).alias("off"))
    assert rows(found, "section", "n", "last", "off") == [("Feats", 60_000, 59_999, 0), ("Races", 2, 1, 0)]


def test_texts_are_read_as_streams(spark):
    """Many documents share a batch; a document of any size gives many, and none of its rows where its end can't be read."""
    import pyarrow as pa

    from stratawise.sources import node_rows

    entry = '<node id="N"><attribute id="UUID" type="guid" value="{}"/><children><node id="T"/></children></node>'
    head, tail = '<save><region id="R"><node id="root"><children>', "</children></node></region></save>"
    n = 30_000
    big = head + "".join(entry.format(i) for i in range(n)) + tail
    run = lambda texts: list(node_rows.arrow_rows(trees.Reader, (trees.ET.ParseError, ValueError), 10)([pa.RecordBatch.from_pydict({"path": [p for p, _ in texts], "text": [t for _, t in texts]})]))
    assert len(run([(str(i), head + entry.format(i) + tail) for i in range(500)])) == 1
    got = run([("small", head + tail), ("cut", big[:-1]), ("whole", big), ("bad", "<x")])
    assert len(got) > 3 and max(b.num_rows for b in got) < 2 * node_rows.MOST_ROWS
    table = pa.Table.from_batches(got)
    assert table.num_rows == 1 + 1 + (2 * n + 1) + 1
    assert sorted(p for p, e in zip(table["path"].to_pylist(), table["error"].to_pylist(), strict=True) if e) == ["bad", "cut"]
    slices = [("a", 0, head), *[("a", i + 1, entry.format(i)) for i in range(300)], ("a", 301, tail), ("b", 0, head), ("b", 1, "<!-- " + entry.format("c")), ("b", 2, " -->" + tail), ("c", 0, head), ("d", 0, head + tail)]
    nodes = trees.read_slices(spark.createDataFrame(slices, "path string, at int, text string").repartition(5), ["at"])
    assert rows(nodes.where("error is not null"), "path") == [("c",)]
    tops = trees.entries(nodes)
    assert rows(tops.where("path = 'a'"), "uuid", "node_ord") == sorted(((str(i), 2 * i + 1) for i in range(300)), key=str)
    assert rows(tops.where("path <> 'a'"), "path", "uuid", "commented") == [("b", "c", True)]


def test_parts_make_up_the_file(spark, monkeypatch):
    """Parts are bounded, make up the texts that single rows hold, and are read back under the same ordinals."""
    monkeypatch.setattr(documents, "PART_NODES", 6)
    node = lambda p, i, child: (p, "R", "N" if not child else "C", i, i - 1 if child else None, i - 1 if child else i, int(child), i % 14 == 5, {"UUID": ("guid", f"{p}{i}", None, None)}, None)
    nodes = spark.createDataFrame([node(p, i, i % 2) for p in ("a", "b") for i in range(40)], trees.NODES).repartition(3)
    parts, whole = documents.document_parts(nodes), documents.document_texts(nodes)
    assert parts.agg(F.max("nodes")).first()[0] <= 6 and parts.count() == 14
    cells = lambda df: rows(df.where("error is null"), "path", "region", "node_id", "depth", "attrs", "source")
    again = documents.read_parts(parts.select("path", "start", F.col("content").alias("text")))
    assert cells(again) == cells(documents.read(whole.select("path", F.col("content").alias("text"))))
    assert again.select("path", "node_ord").distinct().count() == again.count()
    entries = documents.section_entries(nodes, F.when(F.col("path") == "a", "Races"), F.col("path"))
    more = documents.section_entries(nodes, F.lit("Races"), F.lit("late"))
    for parts, whole in ((documents.section_parts(entries), documents.section_texts(entries)), (documents.appended_parts(more, entries), documents.appended(more, entries))):
        got = documents.read_parts(parts.select(F.col("section").alias("path"), "start", F.col("content").alias("text")))
        want = documents.read(whole.select(F.col("section").alias("path"), F.col("content").alias("text")))
        assert rows(got, *want.columns) == rows(want, *want.columns) and got.count() > 60


def test_effects_are_parsed_once(spark):
    texts = spark.createDataFrame([("a", effect('<component class="C"><properties><property id="p"><data><datum value="v"/></data></property></properties></component>')), ("b", "<effect")], "path string, text string")
    for df, n in ((effects.data(effects.read(texts)), 1), (effects.data(effects.read(effects.render(effects.read(texts)).select("path", F.col("content").alias("text")))), 2)):
        assert rows(df, "path", "value") == [("a", "v")]
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == n
