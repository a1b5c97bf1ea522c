from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratawise.functions import fuzzy, text, values


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("column", "want"), [
    (lambda: text.split_delimited(F.lit(" a; ;b ;")), ["a", "b"]),
    (lambda: text.split_delimited(F.lit(None).cast("string")), []),
    (lambda: text.sanitize_id(F.lit("a-b.c d")), "a_b_c_d"),
    (lambda: text.strip_prefix_ci(F.lit("PreFix_x"), "prefix_"), "x"),
    (lambda: text.strip_prefix_ci(F.lit("other"), "prefix_"), None),
    (lambda: text.capitalize_first(F.lit("aBC d")), "ABC d"),
    (lambda: text.singularize(F.lit("Tags")), "Tag"),
    (lambda: text.singularize(F.lit("s")), "s"),
    (lambda: text.decode_entities(F.lit("&lt;&amp;lt;&amp;apos;")), "<&lt;'"),
    (lambda: text.escape_xml(F.lit("<a & 'b'>")), "&lt;a &amp; &apos;b&apos;&gt;"),
    (lambda: text.substitute_captures(F.lit("got $2 then $1"), F.lit("k=v"), r"(\w)=(\w)"), "got v then k"),
    (lambda: text.glob_match(F.lit("Mods/X/Stats/a.TXT"), "mods/**/*.txt"), True),
    (lambda: text.glob_match(F.lit("Mods/X/a.txt"), "Mods/*.txt"), False),
    (lambda: text.split_outside_parens(F.lit("F(a;b);G(c) ; ")), ["F(a;b)", "G(c)"]),
    (lambda: text.module_of(F.lit("x/Public/Mod/y.lsx")), "Mod"),
    (lambda: text.module_of(F.lit("Localization/English/y.loca")), "English"),
    (lambda: text.module_of(F.lit("")), "Unknown"),
    (lambda: text.file_kind(F.lit("Public/M/Stats/Generated/Data/a.txt")), "stats"),
    (lambda: text.file_kind(F.lit("a.png")), None),
    (lambda: text.is_content_handle(text.content_handle()), True),
    (lambda: text.handle_version(F.lit("h0123abcdg0123g0123g0123g0123456789ab;3"))["version"], 3),
    (lambda: text.markdown_plain(F.lit("# T\n**b** [l](u) `c`")), "T\nb l c"),
    (lambda: text.markdown_bbcode(F.lit("**b** [l](u)")), "[b]b[/b] [url=u]l[/url]"),
    (lambda: text.bgra_to_rgba(F.lit("#11223344")), "#22334411"),
    (lambda: text.bgra_to_rgba(F.lit("#112233")), None),
    (lambda: text.css_to_argb(F.lit("#112233")), "#ff112233"),
    (lambda: text.argb_to_css(F.lit("#ff112233")), "#112233"),
    (lambda: F.round(text.contrast_ratio(F.lit("#000000"), F.lit("#ffffff")), 3), 21.0),
    (lambda: values.as_integer(F.lit(" 12")), None),
    (lambda: values.as_integer(F.lit("+7")), 7),
    (lambda: values.as_integer(F.lit("99999999999999999999")), None),
    (lambda: values.as_float(F.lit("NaN")), None),
    (lambda: values.as_float(F.lit("1e3")), 1000.0),
    (lambda: values.coerce(F.lit("TRUE"), "bool")[0], 1),
    (lambda: values.coerce(F.lit("x"), "int32")[1], "x"),
    (lambda: values.null_key(F.lit("00000000-0000-0000-0000-000000000000")), None),
    (lambda: values.float_text(F.lit(3.0)), "3"),
    (lambda: values.float_text(F.lit(3.5)), "3.5"),
    (lambda: values.version_text(F.lit(36028797018963968)), "1.0.0.0"),
    (lambda: values.version_text(F.lit(0)), ""),
    (lambda: values.version_number(F.lit("")), 1 << 55),
    (lambda: values.version_number(F.lit("2.x.3")), (2 << 55) | (3 << 47)),
    (lambda: values.vector_to_commas(F.lit(" 1  2 3 ")), "1,2,3"),
    (lambda: values.split_range(F.lit("4"))["high"], "4"),
    (lambda: values.infer_type(F.lit("UUID"), F.lit("x")), "guid"),
    (lambda: values.infer_type(F.lit("a"), F.lit("-3")), "int32"),
    (lambda: values.cost_text(values.parse_costs(F.lit("a:1;b:2:3:4; ;c"))), "a:1;b:2:3:4;c"),
])
def test_scalar(spark, column, want):
    assert one(spark, column()) == want


def test_selectors_and_changes(spark):
    got = one(spark, text.parse_selectors(F.lit("Select(a, b);bad;Add(c)")))
    assert [(s["name"], list(s["params"])) for s in got] == [("Select", ["a", "b"]), ("Add", ["c"])]
    change = F.struct(F.lit("f").alias("field"), F.array(F.lit("x")).alias("added"), F.array(F.lit("y")).alias("removed"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))
    assert one(spark, values.summarize_change(change)) == "f: +x -y"
    assert [(r["action"], list(r["values"])) for r in one(spark, values.insert_and_remove(F.array(change)))] == [("Insert", ["x"]), ("Remove", ["y"])]
    flat = F.create_map(F.lit("S.0.Action"), F.lit("a"), F.lit("S.1.Action"), F.lit("b"), F.lit("S.0.Id"), F.lit("i"), F.lit("other"), F.lit("o"))
    items = one(spark, values.prefixed_index(flat, "S"))
    assert items == [{"Action": "a", "Id": "i"}, {"Action": "b"}]
    assert one(spark, values.flattened_items(values.prefixed_index(flat, "S"), "S")) == {"S.0.Action": "a", "S.0.Id": "i", "S.1.Action": "b"}


def test_fuzzy(spark):
    assert fuzzy.score("fb", "FooBar") > fuzzy.score("fb", "xfxxb") and fuzzy.score("z", "FooBar") is None
    df = spark.createDataFrame([("FooBar",), (None,), ("zz",)], "t string")
    assert [r[0] for r in df.select(fuzzy.fuzzy_score(F.col("t"), "fb")).collect()] == [fuzzy.score("fb", "FooBar"), None, None]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 255), st.integers(0, 255), st.integers(0, 65535), st.integers(0, 2**31 - 1)), min_size=1, max_size=20))
def test_versions_round_trip(spark, parts):
    rows = [(".".join(map(str, p)),) for p in parts if any(p)]
    if rows:
        df = spark.createDataFrame(rows, "v string")
        assert all(r["v"] == r["w"] for r in df.withColumn("w", values.version_text(values.version_number(F.col("v")))).collect())


@pytest.mark.parametrize(("query", "target", "want"), [
    ("", "x", 0), ("ab", "ab", 1 + 10 + 1 + 5 + 20), ("fb", "FooBar", 2 * 11), ("oa", "FooBar", 2), ("b", "foo-bar", 11), ("b", "a_b", 11), ("z", "abc", None), ("AB", "xab", 1 + 1 + 5),
])
def test_fuzzy_points(query, target, want):
    assert fuzzy.score(query, target) == want


def test_bbcode_constructs(spark):
    got = one(spark, text.markdown_bbcode(F.lit("# A\n### B\n***x*** ~~y~~ ![i](u)\n> q\n1. one\n2. two\n```py\ncode\n```\n---")))
    assert got == "[size=5][b]A[/b][/size]\n[size=4][b]B[/b][/size]\n[b][i]x[/i][/b] [s]y[/s] [img]u[/img]\n[quote]q[/quote]\n[list=1]\n[*]one\n[*]two\n[/list]\n[code]code\n[/code]\n[line]"


def test_reference_rules_agree_with_their_column(spark):
    from stratawise.plans import references

    cases = [("T", "N", n, d) for n in [*references._NAMES, "XUUID", "Xuuid", "SomeTemplate", "UUID", "other"] for d in ("guid", "FixedString", "int32")]
    cases += [("T", n, "Object", "guid") for n in references._NODES] + [(t, "N", col, "guid") for t, col in references._TABLES]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(cases)], "i int, t string, n string, c string, d string")
    got = {r["i"]: r["x"] for r in df.select("i", references.target_column(F.col("t"), F.col("n"), F.col("c"), F.col("d")).alias("x")).collect()}
    for i, x in enumerate(cases):
        want = references.target(*x)
        assert got[i] == (None if want is None else f"{want[0]}.{want[1]}" if want[1] else want[0]), x
