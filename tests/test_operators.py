from __future__ import annotations

from pyspark.sql import functions as F

from stratawise.operators import aggregate, diff, hierarchy, integrity, lint, lookup, precedence, staging


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_precedence(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    b = spark.createDataFrame([(2, "B"), (3, "C"), (None, "N")], "k int, v string")
    assert rows(precedence.union_first_wins([("a", a), ("b", b)], ["k"]), "k", "v", "_db") == [(1, "a", "a"), (2, "b", "a"), (3, "C", "b"), (None, "n", "a")]
    assert rows(precedence.last_wins(precedence.ranked_union([("a", a), ("b", b)]), ["k"], ["_rank"]), "k", "v") == [(1, "a"), (2, "B"), (3, "C"), (None, "N")]
    dead = b.withColumn("gone", F.col("k") == 2)
    assert rows(precedence.overlay_tombstones(a, dead, ["k"], "gone"), "k", "v") == [(1, "a"), (3, "C"), (None, "N"), (None, "n")]
    assert precedence.newest(a, F.col("v").desc(), 1).collect()[0]["v"] == "n"
    tables = spark.createDataFrame([("r", "t1", "p__root", 5), ("r", "t2", "", 1), ("r", "t3", "x", 9), ("q", "t4", "p__root", 1), ("q", "t5", "y", 9)], "region_id string, table_name string, parent_tables string, row_count int")
    assert rows(precedence.main_table(tables), "region_id", "table_name") == [("q", "t4"), ("r", "t2")]


def test_lookup(spark):
    df = spark.createDataFrame([("u1", "D;1", "N", 3, None), ("u2", "", "N2", 5, "#11223344"), ("u3", None, "", None, "")], "id string, d string, n string, l int, c string")
    got = lookup.section_entries(df, "id", display="d", name="n", level="l", color="c")
    assert rows(got, "uuid", "display", "color") == [("u1", "D", None), ("u2", "N2 Lv5", "#22334411"), ("u3", "u3", None)]
    page, total = lookup.page_with_total(df, ["id"], 1, 0)
    assert total == 3 and [r["id"] for r in page.collect()] == ["u2", "u3"]
    assert lookup.page_with_total(df, ["id"], 99, 5)[0].count() == 0
    paths = spark.createDataFrame([("a/b/cat.txt",), ("a/dog.txt",), ("cats/x.txt",)], "path string")
    assert {r["node"] for r in lookup.search_tree(paths, "cat").collect()} == {"a", "a/b", "a/b/cat.txt", "cats", "cats/x.txt"}
    left = spark.createDataFrame([(1, "u", "f"), (2, "z", "g"), (3, "z", "z")], "k int, u string, f string")
    known = spark.createDataFrame([("u", "q", 2), ("w", "f", 1), ("v", "g", 3)], "ku string, kf string, ord int")
    assert rows(lookup.first_match_or(left, known, [("u", "ku"), ("f", "kf")], "k", "ord"), "k", "ord") == [(1, 1), (2, 3), (3, None)]
    tables = spark.createDataFrame([("p", 5), ("c", 7), ("lone", 0)], "table_name string, row_count long")
    links = spark.createDataFrame([("p", "c"), ("p", "missing")], "parent string, child string")
    assert rows(lookup.available_sections(tables, links), "table_name", "n_children", "child_rows") == [("lone", 0, 0), ("p", 2, 7)]
    assert lookup.stat_field_names([df]) == ["c", "d", "id", "l", "n"]


def test_diff(spark):
    m = lambda **k: k
    mine = spark.createDataFrame([("n", m(a="1")), ("s", m(a="1", b="2")), ("c", m(a="2", z="9"))], "uuid string, attributes map<string,string>")
    base = spark.createDataFrame([("s", m(a="1", b="2", gone="x")), ("c", m(a="1"))], "uuid string, attributes map<string,string>")
    got = rows(diff.diff_section(mine, base, diff.SECTION_RULES["generic"]), "uuid", "change", "field", "before", "after")
    assert got == [("c", "Modified", "a", "1", "2"), ("c", "Modified", "z", None, "9"), ("n", "New", None, None, None)]
    lists = lambda v: spark.createDataFrame([("k", m(Spells=v))], "uuid string, attributes map<string,string>")
    r = diff.diff_section(lists("a;b;b"), lists("b;c"), diff.SECTION_RULES["list"]).collect()
    assert [(x["field"], x["added"], x["removed"]) for x in r] == [("Spells", ["a"], ["c"])]
    same = diff.diff_maps(mine.withColumnRenamed("attributes", "fields"), base.withColumnRenamed("attributes", "fields"), "uuid")
    assert rows(same, "uuid", "change") == [("c", "Modified"), ("n", "New")]
    over = spark.createDataFrame([("c", m(a="2", z="9"))], "uuid string, fields map<string,string>")
    f = lambda d: d.withColumnRenamed("attributes", "fields")
    assert rows(diff.rediff(f(mine), f(base), over, "uuid"), "uuid") == [("n",)]
    kept = diff.round_trip(spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c")], "s string, e string"), spark.createDataFrame([("s", "a"), ("s", "b")], "s string, e string"), "s", "e")
    assert rows(kept, "s", "lost", "fidelity") == [("s", 1, 67)]


def test_integrity(spark):
    refs = spark.createDataFrame([("a",), ("b",), (None,), ("c",), ("c",)], "r string")
    target = spark.createDataFrame([("a",), (None,)], "k string")
    more = spark.createDataFrame([("b",)], "k string")
    assert rows(integrity.unresolved(refs, "r", target, "k", [more]), "value") == [("c",)]
    assert rows(integrity.reference_report(refs, "r", target, "k", [("base", more)]), "status", "rows") == [("base", 1), ("main", 1), ("unresolved", 2)]
    t = spark.createDataFrame([("a", 3)], "k string, version int")
    assert rows(integrity.backfill(t, "k", [(refs, "r")], more, version=0), "k", "version") == [("a", 3), ("c", 0)]
    assert rows(integrity.integrity_check(spark.createDataFrame([(1,), (1,), (None,)], "k int"), ["k"]), "problem", "n") == [("duplicate key", 1), ("null k", 1)]


def test_aggregate_and_hierarchy(spark):
    df = spark.createDataFrame([("n", {"UUID": "1", "x": "a"}), ("n", {"UUID": "2"}), ("n", {"UUID": "3", "x": ""})], "node string, attrs map<string,string>")
    got = {r["attribute"]: (r["n"], r["frequency"], r["examples"]) for r in aggregate.infer_schema(df, "node", "attrs", 2).collect()}
    assert got == {"UUID": (3, 1.0, ["1", "2"]), "x": (2, 0.666667, ["a"])}
    g = spark.createDataFrame([("same", 1), ("same", 2), ("same", 3), ("odd", 4)], "c string, k int")
    assert rows(aggregate.anchors(g, ["c"], "k", 3), "c", "n", "lines_saved") == [("same", 3, 6)]
    edges = spark.createDataFrame([(i, i - 1 if i else None) for i in range(15)], "n int, p int")
    got = hierarchy.with_ancestors(edges, "n", "p", 10)
    assert got.where("node = 14").count() == 10 and got.where("node = 3").count() == 3
    cycle = spark.createDataFrame([(1, 2), (2, 1)], "n int, p int")
    assert rows(hierarchy.with_ancestors(cycle, "n", "p", 4), "node", "ancestor", "distance") == [(1, 1, 2), (1, 2, 1), (2, 1, 1), (2, 2, 2)]
    t = hierarchy.tree(edges, "n", "p", spark.createDataFrame([(2,)], "n int"), 10)
    assert rows(t, "node", "role") == [(0, "ancestor"), (1, "ancestor"), (2, "seed"), (3, "child")]


def test_lint(spark):
    df = spark.createDataFrame([("f", "a TODO x\n-- lint-disable: todo\nTODO y\nplain")], "path string, text string")
    lines = lint.lines(df, "path", "text")
    found = lint.apply_line_rules(lines, [{"name": "todo", "pattern": r"TODO (\w)", "message": "do $1"}, {"name": "long", "pattern": ".{9,}", "message": "short", "negate": True, "severity": "info"}])
    assert rows(found, "line_no", "rule", "message") == [(1, "long", "short"), (1, "todo", "do x"), (3, "long", "short"), (3, "todo", "do y"), (4, "long", "short")]
    left = lint.suppressed(found, lines, "path")
    assert rows(left.where("rule = 'todo'"), "line_no") == [(1,)]
    assert rows(lint.configured(left, {"severity": {"long": "off"}, "ignore": []}), "rule") == [("todo",)]
    assert lint.configured(left, {"ignore": ["*"]}).count() == 0
    blocks = lint.apply_block_rules(lint.lines(spark.createDataFrame([("f", "IF\nbad\nEND\nIF\ngood\nEND")], "path string, text string"), "path", "text"), "path", "^IF", "^END", "bad", "no bad")
    assert rows(blocks, "line_no", "rule") == [(1, "no bad")]


def operations(spark, *ops):
    return spark.createDataFrame([(i, op, k, r) for i, (op, k, r) in enumerate(ops)], "seq long, op string, key string, row map<string,string>")


def test_workspace_undo_and_redo(spark, tmp_path):
    w = staging.Workspace(spark, str(tmp_path / "w"))
    w.create({"t": (spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, s string"), "id")})
    state = lambda: rows(w.table("t"), "id", "n", "s", "_is_new", "_is_modified", "_is_deleted")
    start = state()
    w.boundary("start")
    assert w.batch({"t": operations(spark, ("upsert", "c", {"n": "3"}), ("upsert", "a", {"s": "z"}), ("delete", "b", None), ("upsert", "d", {"n": "4"}), ("delete", "d", None))})["changed"] == 3
    one = state()
    assert one == [("a", 1, "z", 0, 1, 0), ("b", 2, "y", 0, 0, 1), ("c", 3, None, 1, 0, 0)]
    assert w.summary() == [{"table": "t", "total": 3, "live": 2, "new": 1, "modified": 1, "deleted": 1}]
    w.boundary("second")
    w.batch({"t": operations(spark, ("undelete", "b", None), ("delete", "c", None))})
    two = state()
    assert two == [("a", 1, "z", 0, 1, 0), ("b", 2, "y", 0, 0, 0)]
    assert w.undo() == 2 and state() == one
    assert w.undo() == 3 and state() == start
    assert w.undo() == 0 and state() == start  # the pointer is an explicit 0
    assert w.redo() == 3 and state() == one
    assert w.redo() == 2 and state() == two
    assert w.redo() == 0
    assert w.batch({"t": operations(spark, ("upsert", "a", {"s": "q"}), ("explode", "a", None))}) == {"applied": False, "table": "t", "failed": 1}
    assert state() == two
    w.vacuum()
    assert state() == two and w.row("t", "a")["s"] == "z"
    w.replace("t", spark.createDataFrame([("k", 9, "v")], "id string, n int, s string"))
    assert state() == [("k", 9, "v", 0, 0, 0)]
    w.batch({"t": operations(spark, ("delete", "k", None))})
    assert staging.all_deleted(w.table("t"))
    w.reset_tracking()
    assert state() == [] and not staging.all_deleted(w.table("t")) and not staging.has_changes(w.table("t"))
    w.set_meta("k", "v")
    assert w.get_meta("k") == "v" and w.get_meta("other") is None


def test_baselines_are_not_broadcast(spark):
    """A baseline's maps outgrow the driver long before its files pass the size limit of broadcasts."""
    side = lambda n, v: spark.range(n).select(F.col("id").alias("uuid"), F.create_map(F.lit("Name"), F.lit(v), F.lit("Passives"), F.concat(F.lit("a;"), F.col("id"))).alias("attributes"), F.create_map(F.lit("Tags"), F.array(F.lit(v))).alias("children"))
    mine, base = side(4, "x"), side(3, "y").withColumn("attributes", F.when(F.col("uuid") > 0, F.col("attributes")))
    rules = {"delimited": {"Passives": ";"}, "scalars": ("Name",), "flags": (), "selectors": False, "children": ("Tags",)}
    got = diff.diff_section(mine, base, rules)
    assert sorted((r.uuid, r.change, r.field or "", r.added or [], r.removed or [], r.before, r.after) for r in got.collect()) == [
        (0, "New", "", [], [], None, None), *[x for i in (1, 2) for x in ((i, "Modified", "Name", [], [], "y", "x"), (i, "Modified", "Tags", ["x"], ["y"], None, None))], (3, "New", "", [], [], None, None)
    ]
    maps = lambda df: df.withColumnRenamed("attributes", "fields")
    up = maps(base).withColumnRenamed("uuid", "p")
    for df in (got, diff.diff_maps(maps(mine), maps(base), "uuid"), diff.strip_inherited(maps(mine).withColumn("p", F.col("uuid")), up.withColumnRenamed("p", "uuid"), "uuid", "p")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_common_values_match_once(spark, monkeypatch):
    taken, first_wins = [], lookup.first_wins
    monkeypatch.setattr(lookup, "first_wins", lambda df, *a: taken.append(df) or first_wins(df, *a))
    left = spark.range(200).select(F.col("id").alias("k"), F.lit("n").alias("u"), F.when(F.col("id") < 5, "m").alias("f"))
    known = spark.range(300).select((F.col("id") + 7).alias("ord"), F.when(F.col("id") > 1, "n").alias("ku"), F.when(F.col("id") == 0, "m").alias("kf"))
    got = lookup.first_match_or(left, known, [("u", "ku"), ("f", "kf")], "k", "ord")
    assert rows(got, "k", "ord") == sorted([(i, 7 if i < 5 else 9) for i in range(200)], key=str)
    assert taken[-1].count() == 205
