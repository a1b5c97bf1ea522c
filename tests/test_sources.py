from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from stratawise.plans import discover, registry
from stratawise.sources import archive, export, files, loca, stats_text, trees
from stratawise.streaming import ingest


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


STATS = 'new entry "A"\ntype "Spell"\nusing "Base"\ndata "k" "1"\ndata "k" "2"\ndata "e" ""\n\ndata "stray" "x"\nnew entry "B"\ntype "Spell"\n'


def texts(spark, *pairs):
    return spark.createDataFrame(list(pairs), "path string, text string")


def test_stats_texts(spark):
    found = stats_text.ingest(texts(
        spark, ("d/a.txt", STATS), ("d/XPData.txt", 'key "L1","300"\nkey "L2","900"\n'), ("d/g.txt", 'new group "g","x","y"\nadd item "i1"\nadd item "i2","3"\n'),
        ("d/e.txt", 'new equipment "EQ"\nadd "x"\n'), ("d/v.txt", 'valuelist "V"\nvalue "a" : 0\nvalue "b" : 5\nvaluelist "W"\nvalue "c"\n'), ("d/m.txt", 'modifier type "T"\nmodifier "F","ConstantInt"\n'), ("d/r.txt", "// nothing\nplain"),
    ))
    assert rows(found["entries"], "name", "type", "using", "data") == [("A", "Spell", "Base", {"k": "2", "e": ""}), ("B", "Spell", None, {})]
    assert rows(found["keyed"], "name", "type", "data") == [("L1", "XPData", {"Value": "300"}), ("L2", "XPData", {"Value": "900"}), ("g", "g", {"Param1": "x", "Param2": "y", "item": "i1|i2;3"})]
    assert rows(found["equipment"], "name") == [("EQ",)]
    assert rows(found["valuelists"], "list_key", "index", "value") == [("V", 0, "a"), ("V", 5, "b"), ("W", 0, "c")]
    assert rows(found["modifiers"], "modifier_type", "field", "field_type") == [("T", "F", "ConstantInt")]
    assert rows(found["raw"], "path") == [("d/r.txt",)]
    content = stats_text.render(found["entries"]).first()["content"]
    again = stats_text.entries(texts(spark, ("x", content)))
    assert rows(again, "name", "type", "using", "data") == rows(found["entries"], "name", "type", "using", "data")


def test_localisation(spark):
    entries = [("h1", 1, "Text & more"), ("h2", 7, ""), ("h3", 1, "é")]
    raw = loca.encode(entries)
    assert loca.decode(raw) == entries
    bad = struct.pack("<III", loca.SIGNATURE, 9, 12)
    df = spark.createDataFrame([("a", bytearray(raw)), ("b", bytearray(bad)), ("c", bytearray(b"x"))], "path string, content binary")
    got = loca.read_binary(df)
    assert rows(got.where("error is null"), "contentuid", "version", "text") == sorted(entries) and got.where("error is not null").count() == 2
    xml = loca.render_xml(got.where("error is null")).first()["content"]
    assert rows(loca.read_xml(texts(spark, ("x", xml))), "contentuid", "version", "text") == sorted(entries)
    pos = lambda *r: spark.createDataFrame([(k, 1, t, i) for i, (k, t) in enumerate(r)], "contentuid string, version int, text string, pos int")
    merged = loca.upsert(pos(("b", "1"), ("a", "2")), pos(("z", "9"), ("a", "new")))
    assert [(r["contentuid"], r["text"]) for r in merged.collect()] == [("b", "1"), ("a", "new"), ("z", "9")]


def tree(region, *nodes):
    return f'<save><region id="{region}"><node id="root"><children>{"".join(nodes)}</children></node></region></save>'


def node(kind, attrs, children=""):
    body = "".join(f'<attribute id="{k}" type="{t}" value="{v}"/>' for k, t, v in attrs)
    return f'<node id="{kind}">{body}{"<children>" + children + "</children>" if children else ""}</node>'


def test_trees_and_discovery(spark):
    a = tree("Races", node("Race", [("UUID", "guid", "u1"), ("Level", "int32", "3"), ("TagUUID", "guid", "t1")], node("Tags", [], node("Object", [("Object", "guid", "t1")]))), node("Race", [("UUID", "guid", "u2"), ("Level", "int32", "x")]))
    b = tree("Races", node("Race", [("UUID", "guid", "u1"), ("Level", "int32", "9")], node("Tags", [], node("Object", [("Object", "guid", "t9")]))), "<!-- <node id='Race'><attribute id='UUID' type='guid' value='u9'/></node> -->")
    t = tree("Tags", node("Tag", [("UUID", "guid", "t1"), ("Name", "FixedString", "n")]))
    nodes = trees.read(texts(spark, ("a", a), ("b", b), ("t", t), ("bad", "<x")))
    assert rows(nodes.where("error is not null"), "path") == [("bad",)]
    got = trees.entries(nodes)
    assert rows(got, "path", "uuid", "node_id", "commented") == [("a", "u1", "Race", False), ("a", "u2", "Race", False), ("b", "u1", "Race", False), ("b", "u9", "Race", True), ("t", "t1", "Tag", False)]
    assert rows(trees.child_links(nodes).where("object_guid is not null"), "path", "group_id", "object_guid") == [("a", "Tags", "t1"), ("b", "Tags", "t9")]
    assert rows(trees.region_ids(texts(spark, ("a", a))), "regions") == [(["Races"],)]
    reg = discover.discover(nodes)
    assert set(reg.tables) == {"tree__Races__Race", "tree__Races__Tags", "tree__Races__Object", "tree__Tags"}
    race = reg.tables["tree__Races__Race"]
    assert race.strategy == "uuid" and reg.resolve("tree__Tags__Tag").name == "tree__Tags" and reg.by_region("Races").name == race.name
    assert [(r.column, r.table) for r in race.references] == [("TagUUID", "tree__Tags")] and reg.valid_references(race.name) == race.references
    assert registry.Registry.from_json(reg.to_json()).to_json() == reg.to_json()
    listed = spark.createDataFrame([("a", 1, 10, "M"), ("b", 2, 50, "N"), ("t", 3, 1, "M")], "path string, file_id long, priority int, module string")
    made = discover.materialize(nodes, reg, listed)
    assert rows(made[race.name], "_key", "Level", "_raw_Level", "_source") == [("u1", 9, None, "N"), ("u2", None, "x", "M")]
    # The tag of the race that lost its key is gone with it.
    assert rows(made["tree__Races__Object"], "Object") == [("t9",)]
    assert {m["table_name"]: m["row_count"] for m in discover.metadata(reg, made)}[race.name] == 2
    text = trees.render([{"node_id": "Race", "attributes": {"UUID": ("guid", "u1"), "N": ("TranslatedString", "h1")}, "children": {"Tags": [("Object", "t1")]}}], "Races")
    back = trees.read(texts(spark, ("r", text)))
    assert rows(trees.entries(back), "uuid") == [("u1",)] and rows(trees.child_links(back), "group_id", "object_guid") == [("Tags", "t1")]


def test_names():
    assert registry.checked_name("tree__A_1") == "tree__A_1"
    for bad in ("a;b", "a b", "", "x'"):
        with pytest.raises(ValueError):
            registry.checked_name(bad)


@pytest.mark.parametrize("method", ["none", "zlib", "lz4"])
def test_archives(spark, tmp_path, method):
    content = {f"Public/M/{i}.txt": f"text {i} ".encode() * (i * 50 + 1) for i in range(6)} | {"Mods/M/meta.lsx": b""}
    uri = str(tmp_path / "m.pak")
    assert archive.write(uri, content, method)["files"] == 7
    archive.register(spark)
    df = spark.read.format("package").option("run", "500").load(uri)
    assert {r["path"]: bytes(r["content"]) for r in df.collect()} == content
    assert df.where("path LIKE 'Public/%'").count() == 6 and df.where("path = 'Mods/M/meta.lsx'").count() == 1
    assert spark.read.format("package").option("pattern", r"[0-2]\.txt$").option("content", "false").load(uri).count() == 3
    with pytest.raises(ValueError):
        archive.entries(str(tmp_path.joinpath("bad.pak").write_bytes(b"x" * 60) and tmp_path / "bad.pak"))


def test_lz4_copies():
    # token: 4 literals and a match of 8 at distance 4, then an end of 5 literals
    assert archive.lz4_decode(bytes([0x44]) + b"abcd" + bytes([4, 0, 0x50]) + b"zzzzz", 17) == b"abcdabcdabcdzzzzz"
    for n in (0, 1, 14, 15, 16, 269, 270, 271, 1000):
        assert archive.lz4_decode(archive.lz4_encode(b"q" * n), n) == b"q" * n


def test_files_and_export(spark, tmp_path):
    root = tmp_path / "in"
    for p in ("Public/Hi/Stats/Generated/Data/a.txt", "Public/Low/x.lsx", "Public/Low/e.lsfx", "Public/Low/e.lsfx.lsx", "z.png"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text("t")
    listed = files.ingest_files(files.listing(spark, str(root)), {"Hi": 50})
    assert [(r["path"], r["kind"], r["priority"]) for r in listed.collect()] == [("Public/Hi/Stats/Generated/Data/a.txt", "stats", 50), ("Public/Low/e.lsfx", "effect", 10), ("Public/Low/x.lsx", "lsx", 10)]
    df = spark.createDataFrame([("b", "B", 0), ("a", "A", 0), ("c", "C", 1)], "k string, v string, _is_deleted int")
    e = export.GroupedText(F.lit("out/all.txt"), F.concat_ws("=", "k", "v"), "k", footer="\n")
    present = spark.createDataFrame([("out/old.txt", "x")], "path string, content string")
    assert rows(export.export_plan([(e, df)], present, ".txt"), "path", "entries", "action") == [("out/all.txt", 2, "write"), ("out/old.txt", 0, "delete")]
    target = tmp_path / "mod"
    (target / "out").mkdir(parents=True)
    (target / "out/old.txt").write_text("x")
    assert export.write_delta(e.render(df), present, str(target)) == {"create": 1, "update": 0, "unchanged": 0, "delete": 1}
    assert (target / "out/all.txt").read_text() == "a=A\nb=B\n" and not (target / "out/old.txt").exists() and (target / "out/old.txt.bak").exists()
    with pytest.raises(ValueError):
        export.write_delta(spark.createDataFrame([("../x", "y")], "path string, content string"), present, str(target))
    scripts = files.script_rows(files.text_files(spark, str(root), "*.txt"), spark.createDataFrame([("k", 0, 0)], "key string, _is_modified int, _is_new int"))
    assert rows(scripts, "key", "value") == [("Public/Hi/Stats/Generated/Data/a.txt", "t")]


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(STATS)
    run = lambda: ingest.ingest_stream(ingest.text_stream(spark, str(tmp_path / "in")), stats_text.entries, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert run()
    (tmp_path / "in/b.txt").write_text('new entry "C"\n')
    assert run()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "name") == [("A",), ("B",), ("C",)]
    e = spark.createDataFrame([("2024-01-01 00:01:00", "x"), ("2024-01-01 00:02:00", "x"), ("2024-01-01 00:12:00", "x")], "t string, g string").withColumn("t", F.to_timestamp("t"))
    assert rows(ingest.windowed_counts(e, "t", "g"), "n") == [(1,), (2,)]
    e.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "events"))
    q = ingest.first_seen(stream, ["g"], "t").writeStream.format("memory").queryName("first_seen").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and spark.table("first_seen").count() == 1


def test_reference_rules_of_a_registry():
    tables = {
        "tree__Races__Race": registry.TableSchema("tree__Races__Race", "tree", "Races", "Race", "uuid", {"UUID": "guid", "ParentGuid": "guid", "RaceUUID": "guid", "FooUUID": "guid", "GodUUID": "int32", "SpellList": "guid"}, [], []),
        "tree__Gods": registry.TableSchema("tree__Gods", "tree", "Gods", "God", "uuid", {"UUID": "guid"}, [], []),
        "tree__Races__Gods": registry.TableSchema("tree__Races__Gods", "tree", "Races", "Gods", "row_id", {"Object": "guid"}, [], []),
    }
    reg = registry.Registry(tables, {}, {"tree__Gods__God": "tree__Gods"})
    found = lambda name: [(r.column, r.table, r.target) for r in discover.references(tables[name], reg)]
    # A name that resolves nowhere, a type that holds no key and a target that isn't there give no reference.
    assert found("tree__Races__Race") == [("ParentGuid", "tree__Races__Race", "UUID"), ("RaceUUID", "tree__Races__Race", "UUID")]
    assert found("tree__Races__Gods") == [("Object", "tree__Gods", "UUID")] and found("tree__Gods") == []
