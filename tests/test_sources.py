import json
import random

import pytest
from pyspark.sql import functions as F

from cutline.functions import objects
from cutline.operators import confirm, embedding, grid, ingest, joins, windows
from cutline.sources import manifest, pages, places, readers, writers


def test_wide_csv_to_good_and_error_rows(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_bytes("﻿,Alpha,Beta,_blank_1\nNorth East,1.5,NQC,9\nSOUTH,abc,12.409,\n,1,1,1\nNowhere,1,-,\n".encode())
    cells = readers.wide_csv(spark, str(path), 2024)
    rows = spark.createDataFrame([("NORTH_EAST", 1), ("SOUTH", 2)], "row_code string, row_id int")
    aliases = spark.createDataFrame([("Alpha", "001A"), ("Beta", "002B")], "label string, code string")
    good, bad = ingest.resolve_cells(cells, rows, aliases)
    assert sorted((r.code, r.row_id, r.value and float(r.value), r.note) for r in good.collect()) == [("001A", 1, 1.5, None), ("002B", 1, None, "NQC")]
    assert sorted(r.problem for r in bad.collect()) == ["OUT_OF_RANGE", "UNKNOWN_ROW", "UNKNOWN_ROW", "UNPARSEABLE"]
    assert ingest.run_status(good, bad).first().status == "partial"


def test_keyed_csv_and_marked_up(spark, tmp_path):
    (tmp_path / "k.csv").write_text("k,v\na,1\nb,2\na,3\n")
    for keep, want in (("first", 1), ("last", 3)):
        assert {r.k: r.v for r in readers.keyed_csv(spark, str(tmp_path / "k.csv"), "k string, v int", "k", keep).collect()} == {"a": want, "b": 2}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "001.md").write_text("# First\ntext")
    (tmp_path / "docs" / "002.md").write_text("no title")
    assert {(r.key, r.title) for r in readers.marked_up(spark, str(tmp_path / "docs")).collect()} == {("001", "First"), ("002", "002")}


def test_artifacts(spark, tmp_path):
    column = {"column_key": "c1", "page_number": 1, "raw_label": "x", "code": None, "markers": [], "repeat_keys": [], "values": {"N": "1.5", "S": "NQC"}}
    (tmp_path / "a.json").write_text(json.dumps({"run_id": "r", "exam_year": 2024, "pages_processed": [1], "warnings": [], "columns": [column]}))
    cells = readers.artifact_cells(readers.json_artifact(spark, str(tmp_path / "a.json"), readers.GRID))
    assert sorted((r.row, r.raw) for r in cells.collect()) == [("N", "1.5"), ("S", "NQC")]
    assert spark.read.json(writers.put_artifact(cells, str(tmp_path / "store"), "r", "grid")).count() == 2


def test_writers(spark, tmp_path):
    cells = spark.createDataFrame([("N", "c2", 1.5), ("S", "c1", 2.0)], "row string, col string, v double")
    order = spark.createDataFrame([("S", 1), ("N", 2), ("W", 3)], "row string, nth int")
    wide = writers.wide_matrix(cells, "row", "col", "v", order, ["c1", "c2"])
    assert [tuple(r) for r in wide.collect()] == [("S", "2.0", ""), ("N", "", "1.5"), ("W", "", "")]
    table = str(tmp_path / "t")
    for rows in ([(2023, "a", 1), (2024, "a", 1)], [(2024, "a", 2), (2024, "b", 3)], [(2024, "a", 2), (2024, "b", 3)]):
        writers.write_upsert(spark.createDataFrame(rows, "year int, k string, v int"), table, ["year", "k"], "year")
    assert sorted((r.year, r.k, r.v) for r in spark.read.parquet(table).collect()) == [(2023, "a", 1), (2024, "a", 2), (2024, "b", 3)]
    assert writers.snapshot({"full": cells, "none": cells.limit(0)}, str(tmp_path / "snap")) == ["full"]
    assert writers.append_audit(cells, str(tmp_path / "audit"), ["row", "col"])
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2


def glyphs_of_grid(rng, page=1, rows=12, columns=6):
    out, values = [], {}
    for r in range(rows):
        for c in range(columns):
            if (r, c) == (3, 2):
                continue
            value = f"{rng.randint(0, 2)}.{rng.randint(0, 9999):04d}"
            values[r, c] = value
            for i, ch in enumerate(value):
                out.append((page, ch, 100.0 + 12 * r, 105.0 + 12 * r, 900.0 - 60 * c - 5 * i, False, 1.0))
    out.append((page, "x", 5.0, 6.0, 5.0, True, 1.0))
    return out, values


def test_grid(spark):
    rows, values = glyphs_of_grid(random.Random(2))
    df = spark.createDataFrame(rows, readers.GLYPHS)
    found = grid.split_grids(grid.cells(df, gap=10.0))
    centres = grid.template(found)
    assert centres.count() == 6
    got = {(r.line - 1, r.nth - 1): r.value for r in grid.assign(found, centres).collect()}
    assert got == values


def test_consolidate_and_section(spark):
    rows = [("k1", "A", {"n": "1"}), ("k2", "A", {"n": "1"}), ("k3", "A", {"n": "2"}), ("k4", "B", {"n": "1"})]
    kept, conflicts = grid.consolidate(spark.createDataFrame(rows, "column_key string, label string, values map<string,string>"))
    assert sorted((r.label, r.column_key, tuple(r.repeats)) for r in kept.collect()) == [("A", "k1", ("k2",)), ("A", "k3", ()), ("B", "k4", ())]
    assert [r.label for r in conflicts.collect()] == ["A"]
    parts = [(1, 10.0, 100.0, "Arts"), (1, 10.0, 104.0, "and Law"), (1, 200.0, 101.0, "North"), (1, 300.0, 102.0, "001A"), (1, 300.0, 130.0, "002B"), (1, 10.0, 131.0, "Physics")]
    got = grid.section_rows(spark.createDataFrame(parts, "page int, x0 double, top double, text string"), (150.0, 250.0)).orderBy("row").collect()
    assert [(r.name, r.place, r.code) for r in got] == [("Arts and Law", "North", "001A"), ("Physics", "", "002B")]


def test_joins_and_windows(spark):
    items = spark.createDataFrame([(1, 1, 10.0), (1, 2, 11.0), (1, 3, 40.0)], "g int, item int, at double")
    targets = spark.createDataFrame([(1, 7, 9.0), (1, 8, 11.0), (1, 9, 12.0)], "g int, target int, spot double")
    got = {r.item: r.target for r in joins.greedy_nearest(items, targets, "g", "item", "at", "target", "spot", 3.0).collect()}
    assert got == {1: 8, 2: 9, 3: None}
    near = {r.item: (r.nearest, r.distance) for r in joins.nearest_row(items, targets, ["g"], "at", "spot", "target", 12.0).collect()}
    assert near == {1: (7, 1.0), 2: (8, 0.0), 3: (None, None)}
    clusters = windows.anchored_clusters(spark.createDataFrame([(1, x) for x in (1.0, 3.0, 4.5, 9.0)], "g int, x double"), ["g"], "x", 3.0).first().clusters
    assert clusters == [[1.0, 3.0], [4.5], [9.0]]
    left = spark.createDataFrame([(1,), (None,)], "a int")
    assert joins.not_in(left, "a", spark.createDataFrame([(2,), (None,)], "b int"), "b").count() == 0
    words = spark.createDataFrame([(1, ["a", "b"]), (1, ["z"])], "p int, w array<string>")
    heads = spark.createDataFrame([(1, ["a", "b", "c"])], "p int, h array<string>")
    assert sorted((r.w[0], r.subset) for r in joins.subset_of_any(words, "w", heads, "h", "p").collect()) == [("a", True), ("z", False)]
    assert windows.number_ranges(spark.createDataFrame([(1, n) for n in (1, 2, 3, 7)], "g int, n int"), ["g"], "n").first().spec == "1-3,7"


def test_pages(spark):
    text = "".join(f"district{i} 1.2345 " for i in range(3))
    rows = [(1, ch, float(i), i + 1.0, 10.0, False, 1.0) for i, ch in enumerate(text)] + [(2, "a", 1.0, 2.0, 3.0, False, 1.0)]
    df = spark.createDataFrame(rows, readers.GLYPHS)
    assert [r.page for r in readers.grid_pages(df, ["district0", "district1"], least_glyphs=20, least_names=2, least_values=3).collect()] == [1]
    assert readers.rotated(df).count() == len(rows)
    assert df.select(F.max("page")).first()[0] == 2


def two_grids(page=7):
    """Glyphs of a page with two grids side by side: mirrored labels of two lines before each, one of them long enough to pass the middle between the grids, and headers of codes."""
    out = []

    def upright(y, right, text):
        for i, ch in enumerate(text):  # mirrored: the first letter stands rightmost
            x = right - 4.0 * (i + 1)
            out.append((page, ch, x, x + 4.0, y, True, x))

    for low in (300.0, 800.0):
        for r in range(12):
            for c in range(16):
                for i, ch in enumerate(f"1.{(r * 16 + c):04d}"):
                    out.append((page, ch, low + 12 * r, low + 12 * r + 5, 900.0 - 50 * c - 5 * i, False, 1.0))
        for c in range(16):
            for i, ch in enumerate(f"{c + int(low) // 100 * 10:03d}{'AB'[c % 2]}"):
                out.append((page, ch, low - 30, low - 25, 900.0 - 50 * c - 5 * i, False, 1.0))
    labels = {}
    for g, low in ((1, 300.0), (2, 800.0)):
        for c in range(3):
            y = 100.0 + 50 * c
            upright(y, low - 60, f"(University {g}{c})")
            upright(y + 7, low - 60, f"COURSE OF THE GRID {g}{c}" if c else "ARTS " + "VERY LONG LABEL " * (5 if g == 2 else 1) + f"{g}")
            labels[g, y + 3.5] = (f"COURSE OF THE GRID {g}{c}" if c else "ARTS " + "VERY LONG LABEL " * (5 if g == 2 else 1) + f"{g}") + f" (University {g}{c})"
    upright(400.0, 240.0, "District")
    upright(450.0, 240.0, "abc")
    return out, {k: v for k, v in labels.items() if not v.startswith("COURSE")}, labels


def test_labels_and_codes_of_two_grids(spark):
    rows, kept, labels = two_grids()
    df = spark.createDataFrame(rows, readers.GLYPHS).repartition(3)
    lines = grid.upright_lines(df)
    found = grid.split_grids(grid.cells(df, gap=10.0))
    of = grid.bands(found)
    assert sorted((r.grid, r.low, r.high) for r in of.collect()) == [(1, 300.0, 432.0), (2, 800.0, 932.0)]
    got = {(r.grid, r["at"]): r.label for r in grid.label_blocks(lines, of).collect()}
    assert got == kept and len(got) == 2
    # by the distance of centres the long label of the second grid would go to the first
    long = next(r for r in lines.collect() if r.text.startswith("ARTS VERY LONG LABEL VERY"))
    assert abs((long.x0 + long.x1) / 2 - 366) < abs((long.x0 + long.x1) / 2 - 866)
    codes = {(r.grid, r.nth): (r.code, r["at"]) for r in grid.code_header(df, of).collect()}
    assert len(codes) == 32
    for g, base in ((1, 30), (2, 80)):
        assert [codes[g, n][0] for n in range(1, 17)] == [f"{c + base:03d}{'AB'[c % 2]}" for c in range(15, -1, -1)]
    assert codes[1, 16][1] == 900.0 - 7.5
    assert grid.code_header(df, of, least=17).count() == 0 and grid.label_blocks(lines.limit(0), of).count() == 0


def run_tables(spark):
    columns = [("k1", 2, "Arts (North)", "001A", "confirmed", None), ("k2", 1, "Law", "002B", "confirmed", []), ("k3", 1, "Trade", "003C", "confirmed", ["S1"]), ("k4", 1, "Trade 2", "003C", "confirmed", ["S2"]), ("k5", 3, "New (Uni)", None, "unmapped_kept", None), ("k6", 3, "junk", None, "ignored", None)]
    grid_rows = [(k, {"north": v, "south": None if k == "k2" else "1.5"}) for k, v in (("k1", "1.0"), ("k2", "2.0"), ("k3", "3.0"), ("k4", "4.0"), ("k5", "5.0"))]
    return {
        "columns": spark.createDataFrame(columns, "column_key string, page int, raw_label string, code string, status string, streams array<string>"),
        "grid": spark.createDataFrame(grid_rows, "column_key string, values map<string,string>"),
        "aliases": spark.createDataFrame([("Law", "002B", "seed", 1.0)], "alias_text string, course_code string, source string, confidence double"),
        "catalog": spark.createDataFrame([("001A", True), ("002B", True), ("009Z", True), ("010X", True)], "code string, is_active boolean"),
        "before": spark.createDataFrame([("001A", "north", 1.0), ("001A", "south", 1.0), ("002B", "north", 2.0)], "code string, row string, value double"),
        "source": "mapping_confirm:2024", "present": spark.createDataFrame([("010X",)], "code string"),
    }


def test_confirm_is_one_commit(spark, tmp_path, monkeypatch):
    root, run = str(tmp_path / "store"), run_tables(spark)
    assert confirm.confirm(root, **run) == 1
    read = lambda name, v=None: manifest.read(spark, root, name, v).collect()
    assert sorted((r.alias_text, r.course_code, r.source) for r in read("aliases")) == [("Arts (North)", "001A", "mapping_confirm:2024"), ("Law", "002B", "seed"), ("Trade", "003C", "mapping_confirm:2024"), ("Trade 2", "003C", "mapping_confirm:2024")]
    cells = {(r.nth, r.code, r.row): r.value for r in read("cells")}
    assert cells == {(1, "002B", "north"): "2.0", (1, "002B", "south"): None, (2, "003C", "north"): None, (2, "003C", "south"): None, (3, "001A", "north"): "1.0", (3, "001A", "south"): "1.5"}
    assert sorted((r.column_key, tuple(r.stream_codes)) for r in read("overrides")) == [("k3", ("S1",)), ("k4", ("S2",))]
    assert [(r.column_key, r.course_name, r.university) for r in read("unmapped")] == [("k5", "New", "Uni")]
    changes = {r.code: (r.kind, r.n_changed) for r in read("changes")}
    assert changes == {"009Z": ("removed", 0), "003C": ("added", 0), "001A": ("changed", 1)}
    # a failure in the middle leaves the old state
    broken = dict(run, before=run["before"].withColumn("value", F.raise_error(F.lit("lost")).cast("double")))
    with pytest.raises(Exception, match="lost"):
        confirm.confirm(root, **broken)
    assert manifest.versions(spark, root) == [1] and len(read("cells")) == 6
    # another writer in the meantime
    real = manifest.state
    monkeypatch.setattr(manifest, "state", lambda s, r, v=None: (0, {}) if v is None else real(s, r, v))
    with pytest.raises(manifest.Conflict):
        manifest.commit(spark, root, {"cells": spark.range(1)})
    monkeypatch.undo()
    # a later commit leaves out what there is no more of; earlier versions stay until they are cleared away
    later = dict(run, columns=run["columns"].where("column_key IN ('k1', 'k2')"))
    assert confirm.confirm(root, **later) == 2
    assert manifest.read(spark, root, "overrides") is None and len(read("overrides", 1)) == 2
    assert len(manifest.vacuum(spark, root)) >= 5 and manifest.versions(spark, root) == [2] and len(read("cells")) == 4


def test_what_blocks_a_confirmation(spark, tmp_path):
    run = run_tables(spark)
    bad = {"pending: k1": F.when(F.col("column_key") == "k1", "pending").otherwise(F.col("status")), "no confirmed or kept": F.lit("ignored")}
    for said, status in bad.items():
        with pytest.raises(confirm.Blocked, match=said):
            confirm.confirm(str(tmp_path / "s"), **dict(run, columns=run["columns"].withColumn("status", status)))
    with pytest.raises(confirm.Blocked, match="one code: 003C"):
        confirm.gate(run["columns"].withColumn("streams", F.when(F.col("column_key") == "k4", F.array(F.lit("S1"))).otherwise(F.col("streams"))), run["grid"])
    with pytest.raises(confirm.Blocked, match="one code: 002B"):
        confirm.gate(run["columns"].withColumn("code", F.when(F.col("column_key") == "k1", "002B").otherwise(F.col("code"))), run["grid"])
    with pytest.raises(confirm.Blocked, match="without values: k2"):
        confirm.gate(run["columns"], run["grid"].where("column_key <> 'k2'"))
    assert not (tmp_path / "s").exists()


def test_glyphs_by_ranges_of_pages(spark, tmp_path):
    rng = random.Random(9)
    rows = [(page, ch, rng.random(), 1.0, float(i), bool(i % 2), 1.0) for page in range(3, 207) if page != 50 for i, ch in enumerate("abc")] + [(None, "x", 0.0, 1.0, 2.0, True, 1.0)]
    df = spark.createDataFrame(rows, readers.GLYPHS)
    path = str(tmp_path / "glyphs")
    df.repartition(3).write.parquet(path)
    read = pages.glyph_pages(spark, path)
    assert read.schema == df.schema and read.rdd.getNumPartitions() == 6
    assert sorted(map(tuple, read.collect())) == sorted(r for r in rows if r[0])
    each = read.groupBy(F.spark_partition_id().alias("p")).agg((F.max("page") - F.min("page")).alias("span")).collect()
    assert len(each) == 6 and max(r.span for r in each) < 40
    few = pages.glyph_pages(spark, path, [4, 50, 180], 10)
    assert few.rdd.getNumPartitions() == 3 and {r.page for r in few.select("page").distinct().collect()} == {4, 180}
    df.limit(0).write.parquet(str(tmp_path / "none"))
    assert pages.glyph_pages(spark, str(tmp_path / "none")).count() == 0


class Fake:
    """Two numbers for each text; writes down what it is asked, and fails once on a text that says so."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, texts):
        import os
        import uuid

        if any("fail" in t for t in texts) and not os.path.exists(f"{self.folder}/failed"):
            open(f"{self.folder}/failed", "w").close()
            raise RuntimeError("no answer")
        with open(f"{self.folder}/{uuid.uuid4().hex}.asked", "w") as f:
            json.dump(texts, f)
        return [[float(len(t)), 1.0] for t in texts]


def test_embedding_asks_once_and_resumes(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    texts = [f"text {i % 40}" for i in range(100)] + ["please fail", None, "", "text 1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, said string").repartition(5)
    asked = lambda: [t for f in calls.glob("*.asked") for t in json.loads(f.read_text())]
    store = f"file://{tmp_path}/store"
    with pytest.raises(Exception, match="no answer"):
        embedding.embed(docs, "id", "said", Fake(str(calls)), store, batch=4, parallel=2)
    before = asked()
    assert before and len(before) == len(set(before)) < 41
    got = embedding.embed(docs, "id", "said", Fake(str(calls)), store, batch=4, parallel=2).collect()
    assert sorted(asked()) == sorted({t for t in texts if t}) and len(got) == len(texts)
    assert all((r.embedding is None) == (not texts[r.id]) and (not r.embedding or r.embedding[0] == len(texts[r.id])) for r in got)
    more = docs.unionByName(spark.createDataFrame([(500, "new one")], docs.schema))
    assert embedding.embed(more, "id", "said", Fake(str(calls)), store, batch=4, parallel=2).where("id = 500").first().embedding == [7.0, 1.0]
    assert len(asked()) == len(set(asked())) == 42
    with pytest.raises(Exception, match="2 texts gave 1 vectors"):
        embedding.embed(spark.createDataFrame([(1, "a"), (2, "b")], docs.schema), "id", "said", lambda t: [[1.0]], f"file://{tmp_path}/other", parallel=1)


def test_json_objects(spark):
    rows = [('{"a": 1, "b": {"c": [1], "d": 2.5}}', '{"b": {"c": null, "e": {"f": "é"}}, "a": "x"}'), (None, '{"a": {"b": null, "c": 1}}'), ("[1]", '{"a": 1}'), ('{"a": 1}', None), ("no json", '{"a": []}'), ('{"a": 1}', "7")]
    df = spark.createDataFrame(rows, "base string, patch string")
    got = [json.loads(r[0]) for r in df.select(objects.merged("base", "patch")).collect()]
    assert got == [{"a": "x", "b": {"d": 2.5, "e": {"f": "é"}}}, {"a": {"c": 1}}, {"a": 1}, {"a": 1}, {"a": []}, 7]
    read = df.select(objects.typed(F.col("base"), "$.a", "bigint").alias("a"), objects.typed(F.col("base"), "$.b.d", "double").alias("d"), objects.kind_of(F.col("base")).alias("kind")).collect()
    assert [(r.a, r.d, r.kind) for r in read[:3]] == [(1, 2.5, "OBJECT"), (None, None, None), (None, None, "ARRAY")]


def test_scope_clears_the_shared_folder(spark):
    kept = places.stash(spark.range(3), "kept")
    with places.scope(spark):
        inside = places.stash(spark.range(5), "inside")
        assert inside.count() == 5
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        inside.collect()
    assert kept.count() == 3
    places.drop(kept)
