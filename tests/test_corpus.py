"""Corpus reconciliation, value overlaps, running folds, whole sheets, sources and streams against plain Python."""

import json
import random
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from tablecheck.functions import formula as fm, replies as rp
from tablecheck.operators import context as cx, corpus as co, matching as mt, profile as pf, reconcile as rc, rownum, scoring as so, sheets as sh, workbook as wb
from tablecheck.session import cut_lineage, scratch_path, scratch_root
from tablecheck.sources import files as fs
from tablecheck.streaming import results as st

CELLS = "case_id string, side string, sheet string, row_idx long, col_idx int, col_name string, value string"


def grid(case, side, sheet, names, rows, start=0):
    cells = [(case, side, sheet, None, c, n, None) for c, n in enumerate(names)]
    return cells + [(case, side, sheet, start + r, c, names[c], v) for r, row in enumerate(rows) for c, v in enumerate(row)]


def small_corpus():
    keyed_s = [[f"k{i}", str(i), "x" if i % 3 else None] for i in range(20)] + [[None, None, " "]]
    keyed_g = [[f"k{i}", str(i * 1.0001 if i % 5 else i + 9), "x" if i % 2 else "filled"] for i in reversed(range(18))] + [["k3", "999", "late"]]
    place_s = [["a", str(i % 4)] for i in range(12)] + [[None, ""], ["b", "7"]]
    place_g = [["a", str(i % 4 + (i == 5))] for i in range(12)] + [["b", "7"], ["c", "8"]]
    return [
        *grid("one", "source", "Keys", ["Id", "Amount", "Note"], keyed_s), *grid("one", "generated", "keys", ["id", "amount", "note"], keyed_g, start=100),
        *grid("one", "source", "Places", ["Kind", "Level"], place_s), *grid("one", "generated", "places", ["kind", "level"], place_g),
        *grid("one", "generated", "keys copy", ["id", "amount", "note"], keyed_g),  # hidden
        *grid("two", "source", "Keys", ["Id", "Amount"], [["z", "1"]]),  # nothing to compare with
        *grid("three", "source", "Empty", ["Id"], []), *grid("three", "generated", "Empty", ["Id"], [["1"]]),
        *grid("four", "source", "Data", ["alpha", "beta"], [["1", "2"]]), *grid("four", "generated", "Data", ["omega", "psi"], [["8", "9"]]),
    ]


def test_corpus_equals_the_single_comparisons(spark):
    cells = spark.createDataFrame(small_corpus(), CELLS).withColumn("sheet_idx", F.lit(0)).repartition(5)
    hidden = spark.createDataFrame([("one", "keys copy", True), ("one", "keys", False)], "case_id string, sheet string, hidden boolean")
    found = co.reconcile_corpus(cells, hidden)
    totals = {(r.case_id, r.source_sheet): r for r in found.summary().collect()}
    assert set(totals) == {("one", "Keys"), ("one", "Places"), ("four", "Data")}
    assert (totals["one", "Keys"].match_method, totals["one", "Keys"].key_column) == ("key_based", "Id")
    assert (totals["one", "Places"].match_method, totals["one", "Places"].key_column) == ("positional", None)
    assert totals["four", "Data"].match_method is None and totals["four", "Data"].comparable_rows == 0
    for name, key in (("Keys", rc.Pair("Id", "id")), ("Places", None)):
        wide = {}
        for side, sheet in (("source", name), ("generated", name.lower())):
            one = [c for c in small_corpus() if c[:3] == ("one", side, sheet)]
            names = [c[5] for c in sorted({(c[4], c[5]) for c in one})] if False else [n for _, n in sorted({(c[4], c[5]) for c in one})]
            rows = defaultdict(dict)
            for c in one:
                if c[3] is not None:
                    rows[c[3]][c[4]] = c[6]
            data = [(i, *(r[k] for k in range(len(names)))) for i, r in rows.items()]
            wide[side] = (spark.createDataFrame(data, ", ".join(["row_idx long", *(f"{n} string" for n in names)])), names)
        pairs = [rc.Pair(a, b) for a, b in zip(wide["source"][1], wide["generated"][1], strict=True)]
        single = rc.reconcile(wide["source"][0], wide["generated"][0], pairs, key)
        want, got = single.summary.first(), totals["one", name]
        for c in ("source_rows", "generated_rows", "comparable_rows", "matched_rows", "expected_fill_cells", "match_pct"):
            assert got[c] == want[c], (name, c)
        diffs = lambda df: Counter((r.row_index, r.column, r.source_value, r.generated_value, r.kind) for r in df.collect())
        mine = found.diffs().where((F.col("case_id") == "one") & (F.col("source_sheet") == name))
        assert diffs(mine) == diffs(single.diffs)
        shares = {r.source_col: r.value_match_pct for r in found.columns().where(F.col("source_sheet") == name).collect()}
        assert shares == {r.source_col: r.value_match_pct for r in single.columns.collect()}


def test_corpus_of_nothing(spark):
    empty = co.reconcile_corpus(spark.createDataFrame([], CELLS))
    assert empty.summary().count() == empty.columns().count() == empty.diffs().count() == 0


def test_value_overlaps_equal_brute_force(spark):
    rnd = random.Random(1)
    cells = [(u, side, s, c, rnd.choice([None, "", "0", *map(str, range(c * 3, c * 3 + 12))])) for u in "ab" for side in ("source", "generated") for s in "xy" for c in range(3) for _ in range(25)]
    df = spark.createDataFrame(cells, "u string, side string, sheet string, col int, value string")
    got = {(r.u, r.s_sheet, r.s_col, r.g_sheet, r.g_col): (r.shared, r.source_values, r.generated_values, r.overlap) for r in mt.value_overlaps(df, ["u"], ["sheet", "col"]).collect()}
    held = defaultdict(set)
    for u, side, s, c, v in cells:
        if v is not None:
            held[u, side, s, c].add(v)
    want = {}
    for u, s, c, t, d in product("ab", "xy", range(3), "xy", range(3)):
        a, b = held[u, "source", s, c], held[u, "generated", t, d]
        if a & b:
            want[u, s, c, t, d] = (len(a & b), len(a), len(b), len(a & b) / len(a | b))
    assert got == want


def test_mapping_counts_all_values(spark):
    """Two columns that differ in their first hundred values and agree in all others belong together."""
    src = spark.createDataFrame([(i, f"v{i}", f"w{i}") for i in range(1500)], "row_idx long, qq string, zz string")
    gen = spark.createDataFrame([(i, f"w{i if i > 100 else -i}", f"v{i if i > 100 else -i}") for i in range(1500)], "row_idx long, xx string, yy string")
    assert {(r.source_col, r.generated_col) for r in mt.map_columns(src, gen).collect()} == {("qq", "yy"), ("zz", "xx")}


@pytest.mark.parametrize("slice_,fan", [(4, 2), (4096, 4096)])
def test_running_folds(spark, monkeypatch, slice_, fan):
    monkeypatch.setattr(rownum, "SLICE", slice_)
    monkeypatch.setattr(rownum, "FAN", fan)
    rnd = random.Random(2)
    rows = [(k, i, rnd.choice([None, 0, 1, 5, 9])) for k, n in (("a", 50), ("b", 1), ("c", 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(3)
    sums = {(r.k, r.i): r.s for r in rownum.running_sum(df, ["k"], "i", "v", "s").collect()}
    tops = {(r.k, r.i): r.s for r in rownum.running_max(df, ["k"], "i", "v", "s").collect()}
    before = {(r.k, r.i): r.s for r in rownum.running_max(df, ["k"], "i", "v", "s", last=-1).collect()}
    for k, i, _ in rows:
        seen = [v for a, j, v in rows if a == k and j < i and v is not None]
        here = [v for a, j, v in rows if a == k and j <= i and v is not None]
        assert (sums[k, i], before[k, i], tops[k, i]) == (sum(seen), max(seen, default=None), max(here, default=None))


def test_positions_spread_rows_without_order(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 100, F.col("id")).alias("i"), F.col("id").alias("v"))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = rownum.positions(df, "i")
        sizes = [r["count"] for r in found.where("i IS NULL").groupBy(F.input_file_name()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert len(sizes) > 3 and max(sizes) < 2000
    assert sorted(r.pos for r in found.collect()) == list(range(4000))
    assert all(r.pos == r.i for r in found.where("i IS NOT NULL").collect())


@pytest.mark.parametrize("part_bytes", [40, 10_000])
def test_sheets_come_whole_in_parts(spark, part_bytes):
    rnd = random.Random(3)
    rows = [(t, i * 3, c, f"h,{c}", rnd.choice([None, "a", 'q"', "x,y", "é" * 9])) for t in "ab" for i in range(700) for c in range(2)]
    rows += [("bare", None, 0, "only", None), ("bare", None, 1, "header", None)]
    df = spark.createDataFrame(rows, "table string, row_idx long, col_idx int, col_name string, value string")
    got = defaultdict(list)
    for r in sh.sheet_texts(df, ["table"], part_bytes).collect():
        got[r.table].append((r.part, r.csv_text, r.n_lines))
    quote = lambda v: "" if v is None else '"' + v.replace('"', '""') + '"' if any(x in v for x in ',"') else v
    for t in "ab":
        lines = ['"h,0","h,1"']
        cells = [r for r in rows if r[0] == t]
        for a, b in zip(cells[::2], cells[1::2], strict=True):
            if (a[4] or "").strip() or (b[4] or "").strip():
                lines.append(f"{quote(a[4])},{quote(b[4])}")
        parts = sorted(got[t])
        assert "".join(p[1] for p in parts) == "\n".join(lines) + "\n"
        assert all(len(p[1].encode()) <= part_bytes for p in parts if p[2] > 1) and sum(p[2] for p in parts) == len(lines)
    assert got["bare"] == [(0, "only,header\n", 1)]
    views = {r.table: r for r in sh.sheet_views(df, ["table"]).collect()}
    assert views["bare"].csv_text == "only,header\n" and views["bare"].row_count == 0 and views["a"].truncated
    sizes = {r.table: r for r in sh.sheet_sizes(sh.sheet_lines(df, ["table"]), ["table"]).collect()}
    assert sizes["bare"].row_count == 0 and sizes["a"].n_bytes == sum(len(p[1].encode()) for p in got["a"])


def test_long_documents_in_slices(spark, monkeypatch):
    """Sections and tables of documents are the same whatever the slices are."""
    rnd = random.Random(4)
    kinds = ["", ', ,""', "Head,Line,x", "1.5,-2,3", "Head,2,3", " "]
    texts = [(i, "h\n" + "\n".join(rnd.choice(kinds) for _ in range(rnd.randint(2, 40))) + "\nz") for i in range(60)]
    tables = [(i, "\n".join(rnd.choice(["[Table 1]", "[Table 2]", "a | b", "1 | 2", "x | 7", "text"]) for _ in range(60))) for i in range(40)]
    found = []
    for size in (4096, 3):
        monkeypatch.setattr(rownum, "SLICE", size)
        monkeypatch.setattr(rownum, "FAN", 2 if size == 3 else 4096)
        sections = cx.sections(spark.createDataFrame(texts, "id int, t string"), "id", "t")
        cells = fs.document_tables(spark.createDataFrame(tables, "id int, t string"), "id", "t")
        found.append([sorted(map(str, df.collect())) for df in (sections, cells)])
    assert found[0] == found[1] and all(found[0])


def test_files_by_their_own_separator(spark, tmp_path):
    (tmp_path / "a b.csv").write_text('id,name\n1,"x\ty"\n2,z\n')
    (tmp_path / "b.csv").write_text("id\tname\n3\tp,q\n")
    (tmp_path / "c.TSV").write_text("id\tname\n4\tr\n")
    (tmp_path / "d.csv").write_text("id,name\n")
    (tmp_path / "e.csv").write_text("")
    got = fs.read_tables(spark, str(tmp_path), "id int, name string")
    assert sorted((r.id, r.name) for r in got.collect()) == [(1, "x\ty"), (2, "z"), (3, "p,q"), (4, "r")]
    assert {r.file_path.rsplit("/", 1)[1]: (r.sep, r.has_rows) for r in fs.dialects(spark, str(tmp_path)).collect()} == {
        "a%20b.csv": (",", True), "b.csv": ("\t", True), "c.TSV": ("\t", True), "d.csv": (",", False)}


def test_inputs_are_read_by_their_loaders(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in (("a.CSV", "h\n1\n"), ("sub/b.json", '{"k":\n1}'), ("c.jsonl", '{"x": 1}\nbroken\n'), ("d.txt", "one\ntwo"), ("e.PNG", "\x89"), ("f.xlsx", "PK")):
        (tmp_path / name).write_text(text)
    got = Counter((r.path.rsplit("/", 1)[1], r.kind, r.ord, r.text) for r in fs.read_inputs(spark, str(tmp_path)).collect())
    assert got == Counter([
        ("a.CSV", "csv", 1, "h"), ("a.CSV", "csv", 2, "1"), ("b.json", "json", 1, '{"k":\n1}'), ("c.jsonl", "jsonl", 1, 'Record 1: {"x": 1}'), ("c.jsonl", "jsonl", 2, "Record 2: broken"),
        ("d.txt", "text", 1, "one"), ("d.txt", "text", 2, "two"), ("e.PNG", "image", 1, "[Image file: e.PNG — visual content not extractable as text]"), ("f.xlsx", "workbook", 1, None)])


def test_stream_keeps_no_state_and_scores_once(spark, tmp_path):
    inbox, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    reply = lambda n: json.dumps({"score": n, "feedback": "f", "evidence": []})
    rows = lambda ids, at, n: spark.createDataFrame([(f"c{i}", "relevance", at, reply(n)) for i in ids], "case_id string, dimension string, arrived string, reply string")
    rows(range(20), "2024-01-01 00:00:02", 1).union(rows(range(5), "2024-01-01 00:00:01", 2)).write.mode("append").json(inbox)
    reports = st.run_available(st.reply_stream(spark, inbox), out, mark)
    rows(range(10, 30), "2024-01-02 00:00:00", 3).write.mode("append").json(inbox)
    reports += st.run_available(st.reply_stream(spark, inbox), out, mark)
    reports += st.run_available(st.reply_stream(spark, inbox), out, mark)  # nothing new
    got = {r.case_id: r.score for r in st.stored(spark, out).collect()}
    assert got == {f"c{i}": 2 if i < 5 else 1 if i < 20 else 3 for i in range(30)}
    assert st.stored(spark, out).count() == 30 and all(not p.get("stateOperators") for p in reports)


def test_a_repeated_batch_does_not_double_rows(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("c", "d", "2024-01-01 00:00:00", "{}")], "case_id string, dimension string, arrived string, reply string").write.json(inbox)
    for n in range(2):  # the second run has lost its checkpoint and repeats batch 0
        st.run_available(st.reply_stream(spark, inbox), out, str(tmp_path / f"mark{n}"))
    assert st.stored(spark, out).count() == 1


def test_areas_and_the_cells_inside(spark):
    rows = [("Data!$A$1:$C$3", [("Data", 1, 1, 3, 3)]), ("'It''s 1'!$AB$10", [("It's 1", 10, 28, 10, 28)]), ("Data!$C$9:$A$2,X.y!B2", [("Data", 2, 1, 9, 3), ("X.y", 2, 2, 2, 2)]),
            ("#REF!$A$1", []), ("$A$1", []), ("", [])]
    df = spark.createDataFrame([("w", f"n{i}", t) for i, (t, _) in enumerate(rows)], "case_id string, name string, attr_text string")
    got = defaultdict(list)
    for r in wb.named_areas(df).collect():
        got[r.name].append((r.sheet, r.top, r.left, r.bottom, r.right))
    assert {f"n{i}": sorted(want) for i, (_, want) in enumerate(rows) if want} == {n: sorted(v) for n, v in got.items()}
    assert [r[0] for r in spark.createDataFrame([("A",), ("Z",), ("AA",), ("XFD",)], "c string").select(fm.column_number(F.col("c"))).collect()] == [1, 26, 27, 16384]
    rnd = random.Random(5)
    cells = [("w", "s", rnd.randint(1, 3000), rnd.randint(1, 6)) for _ in range(400)]
    areas = [("w", f"a{i}", "s", t, lo, t + h, lo + 2) for i, (t, h, lo) in enumerate((rnd.randint(1, 3000), rnd.choice([0, 1, 63, 64, 70, 600, 9000, 10**6]), rnd.randint(1, 4)) for _ in range(40))]
    found = wb.cells_in_areas(spark.createDataFrame(cells, "case_id string, sheet string, row_idx int, col_idx int"),
                              spark.createDataFrame(areas, "case_id string, name string, sheet string, top int, left int, bottom int, right int"))
    want = Counter((r, c, a[1]) for _, _, r, c in cells for a in areas if a[3] <= r <= a[5] and a[4] <= c <= a[6])
    assert Counter((r.row_idx, r.col_idx, r.name) for r in found.collect()) == want


def test_sketches_merge_within_their_bounds(spark):
    cells = spark.range(60_000).select((F.col("id") % 3).alias("day"), F.lit("c").alias("col"), (F.col("id") % 20_000).cast("string").alias("value"))
    merged = pf.merge_sketches(pf.column_sketches(cells, ["day", "col"]), ["col"])
    r = pf.sketch_profile(merged, ["col"]).first()
    assert abs(r.approx_unique - 20_000) < 0.05 * 20_000 and abs(r.median - 10_000) < 0.03 * 20_000
    assert (r.non_null, r.num_min, r.num_max, r.dtype) == (60_000, 0.0, 19_999.0, "numeric")
    empty = pf.sketch_profile(pf.column_sketches(spark.createDataFrame([("c", None)], "col string, value string"), ["col"]), ["col"]).first()
    assert (empty.dtype, empty.approx_unique, empty.median) == ("empty", 0, None)


def test_scratch_is_cleared(spark):
    root = scratch_root(spark)
    kept = cut_lineage(spark.range(3), "gone")
    assert kept.count() == 3 and root in kept.inputFiles()[0]
    # another application's folder, so that results of other tests stay readable
    assert scratch_path(spark, "x").startswith(root + "/x-")


@pytest.mark.parametrize("score,want", [("3", 3), ("3.7", 3), ('"3"', 3), ('" 3 "', 3), ('"3.7"', None), ("true", 1), ("false", 0), ("null", "none"), ("5", None), ('"x"', None), ("[1]", None), ("-0.5", 0), ("2e0", 2)])
def test_scores_are_read_as_whole_numbers(spark, score, want):
    df = spark.createDataFrame([(f'{{"score": {score}, "feedback": "f"}}',)], "reply string")
    r = rp.parse_replies(df).first()
    assert (r.ok, r.score) == ((True, None) if want == "none" else (want is not None, want))


def test_cap_notes_end_the_feedback(spark):
    df = spark.createDataFrame([("a", "data_accuracy", 0, "x"), ("a", "completeness", 4, "y")], "case_id string, dimension string, score int, feedback string")
    got = {r.dimension: (r.score, r.feedback) for r in so.consistency_caps(df).collect()}
    assert got == {"data_accuracy": (0, "x"), "completeness": (2, "y [Consistency adjustment: capped from 4 to 2 because data accuracy is 0]")}
