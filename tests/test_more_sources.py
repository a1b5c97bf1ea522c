from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from stratawise.operators import options, packaging, validate
from stratawise.sources import archive, binary_tree, manifest, trees


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


ATTRS = {
    "UUID": ("guid", "0a1b2c3d-0102-0304-0506-0708090a0b0c"), "n": ("int32", "-5"), "u": ("uint64", "18446744073709551615"), "f": ("float", "0.1"), "v": ("fvec3", "1 2.5 -3"), "b": ("bool", "True"),
    "s": ("LSString", "é text"), "t": ("TranslatedString", "h1", "h1", "4"), "x": ("ScratchBuffer", "00ff"), "i": ("int8", "-1"),
}


def test_binary_trees(spark):
    doc = [("Races", [{"id": "Race", "attributes": ATTRS, "children": [{"id": "Tags", "attributes": {}, "children": [{"id": "Object", "attributes": {"Object": ("guid", "00000000-0000-0000-0000-000000000001")}}]}]}, {"id": "Race", "attributes": {"Name": ("FixedString", "two")}}])]
    raw = binary_tree.write(doc)
    got = binary_tree.parse(raw)
    assert [(r[0], r[1], r[3], r[5]) for r in got] == [("Races", "Races", None, 0), ("Races", "Race", 0, 1), ("Races", "Tags", 1, 2), ("Races", "Object", 2, 3), ("Races", "Race", 0, 1)]
    assert {k: v[:2] for k, v in got[1][-1].items()} == {k: v[:2] for k, v in ATTRS.items()} and got[1][-1]["t"][2:] == ("h1", "4")
    df = spark.createDataFrame([("a", bytearray(raw)), ("b", bytearray(b"LSOFxx")), ("c", bytearray(raw[:-3]))], "path string, content binary")
    table = binary_tree.read(df)
    assert table.columns == trees.read(spark.createDataFrame([("x", "<save/>")], "path string, text string")).columns
    assert rows(table.where("error is not null"), "path") == [("b",), ("c",)]
    assert rows(table.where("node_id = 'Object'"), "path", "parent_ord") == [("a", 2)]


def test_compressed_sections():
    raw = binary_tree.write([("R", [{"id": "A", "attributes": {"s": ("string", "x" * 50)}}])])
    head, sizes = raw[:16], list(__import__("struct").unpack_from("<10I", raw, 16))
    at, parts = 16 + 40 + 8, []
    for k in (0, 4, 6, 8):
        parts.append(raw[at : at + sizes[k]])
        at += sizes[k]
    packed = [zlib.compress(p) for p in parts]
    for k, p in zip((0, 4, 6, 8), packed, strict=True):
        sizes[k + 1] = len(p)
    again = head + __import__("struct").pack("<10I", *sizes) + bytes([1, 0, 0, 0, 1, 0, 0, 0]) + b"".join(packed)
    assert binary_tree.parse(again) == binary_tree.parse(raw)
    block = archive.lz4_encode(b"q" * 40)
    frame = b"\x04\x22\x4d\x18\x60\x40\x82" + len(block).to_bytes(4, "little") + block + (0).to_bytes(4, "little")
    assert binary_tree.lz4_frame(frame) == b"q" * 40
    assert [binary_tree.number_text(x) for x in (1.0, 0.1, -2.5, 3)] == ["1", "0.1", "-2.5", "3"]


def test_manifests(spark):
    df = spark.createDataFrame([("u1", "N <1>", "F", "me", "d", "1.2.3.4", [("u2", "Dep", "D", "2.0.0.0")])], "uuid string, name string, folder string, author string, description string, version string, dependencies array<struct<uuid:string,name:string,folder:string,version:string>>")
    content = manifest.render(df).first()["content"]
    got = manifest.manifests(spark.createDataFrame([("meta", content)], "path string, text string")).first()
    assert (got["uuid"], got["folder"], got["version"]) == ("u1", "F", "1.2.3.4")
    assert [(d["uuid"], d["name"], d["version"]) for d in got["dependencies"]] == [("u2", "Dep", "2.0.0.0")]
    xml = '<components><component name="C"><property name="P" guid="g1" type="float"/><property name="Q" guid="g2" type="int"/><propertygroup name="G"><propertyref guid="g2"/><propertyref guid="g1"/></propertygroup></component></components>'
    parts = manifest.components(spark.createDataFrame([("x", xml)], "path string, text string"))
    assert rows(manifest.resolve_members(parts), "group", "property", "sort_order") == [("G", "P", 1), ("G", "Q", 0)]


@pytest.mark.parametrize(("path", "target", "rule"), [
    ("a/b.lsf.lsf", "a/b.lsf", "extension"), ("Public/M/MultiEffectInfos/x/y/z.lsx", "Public/M/MultiEffectInfos/z.lsx", "effects"), ("Public/M/RootTemplates/a.lsf", "Public/M/RootTemplates/_merged.lsf", "templates"),
    ("Public/M/Lists/My.SpellLists.lsx", "Public/M/Lists/SpellLists.lsx", "regions"), ("Public/M/Races/My.Progressions.lsx", "Public/M/Races/My.Progressions.lsx", None),
])
def test_packaging_paths(spark, path, target, rule):
    got = packaging.rewrites(spark.createDataFrame([(path,)], "path string")).first()
    assert (got["target"], got["rule"]) == (target, rule)


def test_packaging_merges(spark):
    base = "Public/M/Stats/Generated/Data/"
    df = spark.createDataFrame([(base + "Cat/b.txt", "B"), (base + "Cat/a.txt", "A"), (base + "One/c.txt", "C"), (base + "d.txt", "D")], "path string, text string")
    assert rows(packaging.merged_stats(df), "category", "text", "parts") == [("Cat", "// a.txt\nA\n\n// b.txt\nB", 2)]
    clash = packaging.rewrites(spark.createDataFrame([("a/MultiEffectInfos/x/f.lsx",), ("a/MultiEffectInfos/y/f.lsx",)], "path string"))
    assert rows(packaging.collisions(clash), "n") == [(2,)]


def test_options(spark):
    make = lambda *r: spark.createDataFrame(list(r), "id string, label string, node_id string")
    got = options.section_options(make(("a", "Éa", "N"), ("", "x", "N")), make(("a", "old", "N"), ("b", "eb", "N"), ("z", "zz", "Other")), [make(("b", "late", "N"), ("c", "", "N"))], ["N"])
    assert [(r["id"], r["label"], r["source"]) for r in got.collect()] == [("a", "Éa", "package"), ("b", "eb", "baseline"), ("c", "Unnamed", "other0")]
    entries = spark.createDataFrame([({"Tags": ["t1", "t2"], "Else": ["t9"]},)], "children map<string,array<string>>")
    assert [r["id"] for r in options.tag_options(make(("t1", "first", "")), entries, ["Tags"]).collect()] == ["t1", "t2"]
    layer = lambda *r: spark.createDataFrame(list(r), "name string, label string, _is_deleted int")
    kept = options.cost_options(layer(("A", "1", 0), ("B", "2", 0)).drop("_is_deleted"), layer(("a", "3", 0), ("b", "x", 1)), layer(("C", "4", 0)))
    assert rows(kept, "name", "label", "layer") == [("C", "4", "group"), ("a", "3", "resource")]
    shown = spark.createDataFrame([("x", "1"), (None, "1")], "k string, v string").select(options.dependent_visible([("k", ["x"])]).alias("s"))
    assert [r["s"] for r in shown.collect()] == [True, False]
    s = options.discovered_sections(spark.createDataFrame([("Known", 1), ("FeatX", 2), ("Zed", 3), ("Empty", 0)], "section string, n_columns int"), ["Known"], [("^Feat", "Feats")])
    assert [(r["section"], r["bucket"]) for r in s.collect()] == [("FeatX", "Feats"), ("Zed", "Other")]


def test_validation(spark):
    good = "Version 1\nSubGoalCombiner SGC_AND\nINITSECTION\nKBSECTION\nIF\nX(\"a\")\nTHEN\nY();\nEXITSECTION\nENDEXITSECTION\nParentTargetEdge \"Act1\""
    bad = "Version 1\nKBSECTION\nINITSECTION\nIF\n\"open\nEXITSECTION\nVersion 2\nParentTargetEdge \"Nope\""
    df = spark.createDataFrame([("good", good), ("bad", bad)], "path string, text string")
    got = {(r["path"], r["message"]) for r in validate.goals(df).collect()}
    assert {m for p, m in got if p == "good"} == set()
    assert {"repeated section Version", "INITSECTION is out of order", "no section SubGoalCombiner", "no section ENDEXITSECTION", "1 rules but 0 THEN", "a string isn't closed"} <= {m for p, m in got if p == "bad"}
    assert rows(validate.goal_parents(df.withColumnRenamed("path", "name")), "name", "parent") == [("bad", "Nope")]
    configs = spark.createDataFrame([("a", '{"x": 1}'), ("b", "[1]"), ("c", "{"), ("d", "{}")], "path string, text string")
    assert rows(validate.json_configs(configs, ["x"]), "path", "message") == [("b", "not a JSON object"), ("c", "not a JSON object"), ("d", "no key x")]
    blue = '{"SchemaVersion": 1, "Tabs": [{"Settings": [{"Id": "a", "Default": 9, "Options": {"Min": 0, "Max": 5}}, {"Id": "a"}, {"Id": "b", "VisibleIf": {"Conditions": [{"SettingId": "zz"}]}}]}]}'
    found = validate.blueprints(spark.createDataFrame([("m", blue), ("n", "[]"), ("o", "{}")], "path string, text string"))
    assert rows(found, "path", "message") == [("m", "a: Default is outside Min and Max"), ("m", "b refers to unknown setting zz"), ("m", "repeated setting a"), ("n", "not a JSON object"), ("o", "SchemaVersion must be an integer"), ("o", "no Tabs, Sections or Settings")]
    g = "0a1b2c3d-0102-0304-0506-0708090a0b0c"
    e = spark.createDataFrame([(g, "s1", "n"), (g, "s2", ""), ("x", "s1", "n"), ("x", "s1", "n")], "k string, s string, name string")
    assert rows(validate.entries(e, "k", "s", ["name"]), "key", "problem") == [(g, "also in another section"), (g, "no name"), ("x", "not a guid"), ("x", "not a guid"), ("x", "repeated in its section")]
    assert e.where(F.lit(True)).count() == 4


def test_deep_comments_unknown_methods_and_long_streams(spark, tmp_path):
    import struct
    import zlib

    from stratawise.sources import archive, trees

    deep = '<node id="a">' * 3000 + "</node>" * 3000
    rows = trees.read(spark.createDataFrame([("d", f'<save><region id="R"><!-- {deep} --><node id="N"/></region></save>')], "path string, text string")).collect()
    assert [(r["node_id"], r["error"]) for r in rows][-1] == ("N", None)
    uri = f"{tmp_path}/p.pak"
    archive.write(uri, {"a.txt": b"aaaa" * 50, "b.txt": b"b"}, "zlib")
    first = archive.entries(uri)[0]
    assert archive.payload(uri, first) == b"aaaa" * 50
    raw = bytearray(open(uri, "rb").read())
    at = struct.unpack_from("<Q", raw, 8)[0] + 8
    place = raw.index(b"a.txt\0", at)
    raw[place + 256 + 7] = 9
    open(uri, "wb").write(raw)
    odd = archive.entries(uri)
    assert [e.path for e in odd] == ["a.txt", "b.txt"] and odd[0].method == "unknown 9" and archive.payload(uri, odd[1]) == b"b"
    for bad in (lambda: archive.payload(uri, odd[0]), lambda: archive.inflate(zlib.compress(b"x" * 100), 10)):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError
    assert archive.lz4_decode(bytes([0x10]) + b"a" + struct.pack("<H", 1) + bytes([0x10]) + b"z", None) == b"aaaaaz"
    assert archive.lz4_decode(bytes([0x31]) + b"abc" + struct.pack("<H", 3) + bytes([0x10]) + b"z", None) == b"abcabcabz"
