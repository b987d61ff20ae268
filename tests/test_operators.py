import random
import statistics
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tablecheck.functions.formula import sheet_refs
from tablecheck.operators import context as cx, matching as mt, reconcile as rc, scoring as so, sheets as sh, workbook as wb
from tablecheck.operators.rownum import positions
from tablecheck.operators.skew import key_join, spread_join
from tablecheck.sources import cases as ca, files as fs


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_spread_join_equals_plain_join(spark, how):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 50}") for i in range(3000)]
    left = spark.createDataFrame(rows, "id long, k string")
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 40)], "k string, v int")
    got = spread_join(left, right, "k", F.col("id"), how, sample=4, seen=50)
    if how == "left_anti":
        assert sorted(got.collect()) == sorted(left.join(right, "k", how).select("id", "k").collect())
        return
    want = left.join(right, "k", how).select("id", "k", "v")
    assert sorted(got.select("id", "k", F.col("other.v").alias("v")).collect()) == sorted(want.collect())


def test_spread_join_moves_hot_rows_apart(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}") for i in range(9000)]
    left = spark.createDataFrame(rows, "id long, k string")
    right = spark.range(1).select(F.lit("hot").alias("k"), F.lit(1).alias("v"))
    out = spread_join(left, right, "k", F.col("id"), "left", sample=4, seen=100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 9000 and max(sizes) < 3000


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
@pytest.mark.parametrize("partner", [True, False])
def test_hot_key_is_spread_with_and_without_partner(spark, how, partner):
    rows = [(i, "hot" if i % 20 else f"k{i}") for i in range(20000)]
    left = spark.createDataFrame(rows, "id long, k string")
    right = spark.createDataFrame([("hot" if partner else "other", 1)] + [(f"k{i}", i) for i in range(0, 20000, 40)], "k string, v int")
    out = spread_join(left, right, "k", F.col("id"), how, sample=4, seen=100)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    hot, cold = 19000, 1000
    want = {"inner": hot * partner + cold // 2, "left": hot + cold, "left_anti": hot * (not partner) + cold // 2}[how]
    assert sum(sizes) == want
    if want > hot:
        assert max(sizes) < 2 * want / 8


def test_key_join_keeps_null_keys(spark):
    left = spark.createDataFrame([(1, None, "a"), (2, "x", None), (3, "x", "a")], "id long, p string, q string")
    right = spark.createDataFrame([(None, "a", 10), ("x", None, 20)], "p string, q string, v int")
    got = {r.id: r.v for r in key_join(left, right, ["p", "q"], F.col("id")).collect()}
    assert got == {1: 10, 2: 20, 3: None}


def test_positions_within_keys(spark):
    ids = random.Random(3).sample(range(5000), 700)
    df = spark.createDataFrame([(i, i % 3) for i in ids], "i long, g int")
    for keys in ([], ["g"]):
        got = positions(df, "i", keys).collect()
        groups = {}
        for i in sorted(ids):
            groups.setdefault(i % 3 if keys else 0, []).append(i)
        want = {i: n for g in groups.values() for n, i in enumerate(g)}
        assert {r.i: r.pos for r in got} == want


PAIRS = [rc.Pair("k", "k"), rc.Pair("a", "a"), rc.Pair("b", "b")]


def _tables(spark):
    rows = [(i, i * 7 % 100, f"v{i}", None if i % 5 == 0 else float(i)) for i in range(100)]
    return spark.createDataFrame(rows, "row_idx long, k long, a string, b double")


@pytest.mark.parametrize("key", [None, rc.Pair("k", "k")])
def test_table_equals_itself(spark, key):
    df = _tables(spark)
    r = rc.reconcile(df, df, PAIRS, key).summary.first()
    assert (r.match_pct, r.expected_fill_cells, r.comparable_rows) == (100.0, 0, 100)


def test_keyed_ignores_order_positional_does_not(spark):
    df = _tables(spark)
    shuffled = df.withColumn("row_idx", F.lit(99) - F.col("row_idx"))
    assert rc.reconcile(df, shuffled, PAIRS, rc.Pair("k", "k")).summary.first().matched_rows == 100
    assert rc.reconcile(df, shuffled, PAIRS).summary.first().matched_rows == 0


def test_positional_equals_keyed_on_row_index(spark):
    df = _tables(spark).withColumn("r", F.col("row_idx"))
    gen = df.withColumn("a", F.when(F.col("row_idx") % 4 == 0, "changed").otherwise(F.col("a")))
    a = rc.reconcile(df, gen, PAIRS, rc.Pair("r", "r"))
    b = rc.reconcile(df, gen, PAIRS)
    for one, two in ((a.summary, b.summary),):
        x, y = one.first(), two.first()
        assert (x.matched_rows, x.comparable_rows) == (y.matched_rows, y.comparable_rows) == (75, 100)
    assert sorted(a.diffs.collect()) == sorted(b.diffs.collect())


def test_duplicate_and_null_keys(spark):
    src = spark.createDataFrame([(0, "x", "1"), (1, None, "2"), (2, "y", "3")], "row_idx long, k string, v string")
    gen = spark.createDataFrame([(0, None, "2"), (1, "x", "1"), (2, "x", "9")], "row_idx long, k string, v string")
    r = rc.reconcile(src, gen, [rc.Pair("k", "k"), rc.Pair("v", "v")], rc.Pair("k", "k"))
    s = r.summary.first()
    assert (s.comparable_rows, s.matched_rows, s.source_rows) == (2, 2, 3)
    assert [x.k for x in rc.unmatched(src, gen, "k", "k").collect()] == ["y"]


def test_integral_double_joins_bigint_key(spark):
    src = spark.createDataFrame([(0, 1001, "a")], "row_idx long, k long, v string")
    gen = spark.createDataFrame([(0, 1001.0, "a")], "row_idx long, k double, v string")
    assert rc.reconcile(src, gen, [rc.Pair("v", "v")], rc.Pair("k", "k")).summary.first().matched_rows == 1


@pytest.mark.parametrize("unique,shared,want", [(90, 1.0, True), (89, 1.0, False), (100, 0.5, True), (100, 0.49, False)])
def test_key_thresholds(spark, unique, shared, want):
    vals = [min(i, unique - 1) for i in range(100)]
    src = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "row_idx long, k long")
    cut = int(unique * shared)
    gen = spark.createDataFrame([(i, v if v < cut else v + 1000) for i, v in enumerate(vals)], "row_idx long, k long")
    found = rc.find_key(src, gen, [rc.Pair("k", "k")])
    assert (found is not None) == want


def test_caps(spark):
    rows = [(i, 0, "c", "a", "b" * 200, "diff") for i in range(51)] + [(i, 0, "c", "", "b", "expected_fill") for i in range(11)]
    df = spark.createDataFrame(rows, "row_index long, col_order int, column string, source_value string, generated_value string, kind string")
    out = rc.capped_diffs(df)
    assert {r.kind: r["count"] for r in out.groupBy("kind").count().collect()} == {"diff": 50, "expected_fill": 10}
    assert out.agg(F.max(F.length("generated_value"))).first()[0] == 100


def test_no_python_in_keyed_diff(spark):
    df = _tables(spark)
    plan = rc.reconcile(df, df, PAIRS, rc.Pair("k", "k")).compared._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_compare_corpus(spark):
    a = spark.createDataFrame([("p", i, "x", str(i)) for i in range(10)] + [("q", 0, "x", "")], "pair_id string, pos long, col string, value string")
    b = a.withColumn("value", F.when(F.col("pos") == 3, "bad").when(F.col("pair_id") == "q", "filled").otherwise(F.col("value")))
    got = {r.pair_id: (r.comparable_rows, r.matched_rows, r.expected_fill_cells, r.diff_cells) for r in rc.compare_corpus(a, b).collect()}
    assert got == {"p": (10, 9, 0, 1), "q": (1, 1, 1, 0)}


def _pair_score(a, b, name_weight, set_weight):
    (s, sv), (g, gv) = a, b
    return name_weight * SequenceMatcher(None, s.lower(), g.lower()).ratio() + set_weight * len(sv & gv) / max(len(sv | gv), 1)


def test_no_pair_can_be_bettered():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcde_") for _ in range(rnd.randint(2, 9)))
    for _ in range(200):
        src = [(f"{word()}{i}", set(rnd.sample(range(20), 5))) for i in range(6)]
        gen = [(f"{word()}{i}", set(rnd.sample(range(20), 5))) for i in range(6)]
        share = lambda a, b: len(a[1] & b[1]) / max(len(a[1] | b[1]), 1)
        got = {a[0]: (b[0], s) for a, b, s, _ in mt._greedy(src, gen, lambda t: t[0], share, 0.3, 0.6, 0.4)}
        assert len({b for b, _ in got.values()}) == len(got)
        free = dict(gen)
        for name, values in src:
            scores = {g: _pair_score((name, values), (g, gv), 0.6, 0.4) for g, gv in free.items()}
            if name not in got:
                assert max(scores.values(), default=0) < 0.3
                continue
            target, score = got[name]
            assert abs(scores[target] - score) < 1e-12 and score >= 0.3 and score >= max(scores.values()) - 1e-12
            del free[target]


def test_map_columns_on_renamed_table(spark):
    src = spark.createDataFrame([(i, i, f"n{i}", float(i), i % 7) for i in range(50)], "row_idx long, p_partkey long, p_name string, p_retailprice double, p_size int")
    gen = src.toDF("row_idx", "P_PartKey", "Part Name", "Retail Price", "dims")
    got = {r.source_col: (r.generated_col, r.match_type) for r in mt.map_columns(src, gen).collect()}
    assert got["p_partkey"] == ("P_PartKey", "exact_name")
    assert got["p_name"][0] == "Part Name" and got["p_retailprice"][0] == "Retail Price"
    assert got["p_size"] == ("dims", "value_overlap")


def test_match_exact_spelling_rules(spark):
    s = spark.createDataFrame([("c", 0, "Name"), ("c", 1, "NAME"), ("c", 2, "x")], "case_id string, col_idx int, col_name string")
    g = spark.createDataFrame([("c", 0, "name"), ("c", 1, "nAmE")], "case_id string, col_idx int, col_name string")
    r = mt.match_exact(s, g, ["case_id"]).collect()
    assert [(x.source_col, x.generated_col) for x in r] == [("Name", "nAmE")]


@pytest.mark.parametrize("n,kinds", [(500, {"row": 500}), (501, {"row": 150, "marker": 1})])
def test_truncation(spark, n, kinds):
    rows = [("t", i * 2, c, "h", None if i % 9 == 8 else f"{i}") for i in range(n + n // 8 + 1) for c in (1, 2)]
    filled = [r for r in rows if r[4] is not None][: 2 * n]
    empty = [r for r in rows if r[4] is None]
    df = spark.createDataFrame(filled + empty, "table string, row_idx long, col_idx int, col_name string, value string")
    out = sh.truncate_rows(df, ["table"])
    assert {r.kind: r["count"] for r in out.groupBy("kind").count().collect()} == kinds
    pos = sorted(r.pos for r in out.where("kind = 'row'").collect())
    assert pos == (list(range(500)) if n == 500 else list(range(100)) + list(range(451, 501)))


#: Worked out by hand: text, its sections (first line, last line, label).
SECTIONS = [
    ("Head,Line,x\n1,2,3\n4,5,6", [(1, 3, "Data block")]),
    ("a,b\n1,2\n,\nHead,Line\n3,4", [(1, 2, "Data block"), (4, 5, "Head")]),
    ('a,b\n1,2\n, ,""\n"Quoted title",b\n3,4\n5,6', [(1, 2, "Data block"), (4, 6, "Quoted title")]),
    ("a,b\n1,2\n,\n1.5,-2\n3,4", [(1, 2, "Data block"), (4, 5, "Data block")]),
    ("one\ntwo", []),
]


def test_sections_by_hand(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SECTIONS)], "id int, text string")
    got = {}
    for r in cx.sections(df, "id", "text").collect():
        got.setdefault(r.id, []).append((r.start, r.end, r.label))
    assert {i: sorted(v) for i, v in got.items()} == {i: w for i, (_, w) in enumerate(SECTIONS) if w}


def test_sections_lie_apart_and_hold_no_blank_row(spark):
    rnd = random.Random(11)
    kinds = ["", ', ,""', "Head,Line,x", "1.5,-2,3", "Head,2,3", '"Quoted title",b', " "]
    texts = ["h\n" + "\n".join(rnd.choice(kinds) for _ in range(rnd.randint(2, 12))) + "\nz" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in cx.sections(df, "id", "text").collect():
        got.setdefault(r.id, []).append((r.start, r.end))
    blank = lambda line: all(c.strip() in ("", '""') for c in line.split(","))
    for i, t in enumerate(texts):
        lines, last = t.split("\n"), 0
        for start, end in sorted(got.get(i, [])):
            assert last < start <= end <= len(lines)
            assert not any(blank(x) for x in lines[start:end])
            last = end


def test_median_and_representative(spark):
    rnd = random.Random(2)
    data, rows = {}, []
    for c in range(60):
        runs = [rnd.choice([None, 0, 1, 2, 3, 4]) for _ in range(rnd.randint(1, 6))]
        data[f"c{c}"] = runs
        rows += [(f"c{c}", "relevance", i + 1, s, "success", f"f{i + 1}") for i, s in enumerate(runs)]
    df = spark.createDataFrame(rows, "case_id string, dimension string, run int, score int, status string, feedback string")
    for r in so.merge_runs(df).collect():
        scores = [s for s in data[r.case_id] if s is not None]
        if not scores:
            assert r.score is None and r.representative_run == 1
            continue
        med = int(statistics.median(scores))
        best = min((i for i, s in enumerate(data[r.case_id]) if s is not None), key=lambda i: (abs(data[r.case_id][i] - med), i))
        assert (r.score, r.representative_run) == (med, best + 1)
        if data[r.case_id][best] != med:
            assert f"scores were {sorted(scores)}, median={med}]" in r.feedback
        else:
            assert r.feedback == f"f{best + 1}"


def test_scores_out_of_range_are_errors(spark):
    rows = [("c", "relevance", 1, 5, "success", "a"), ("c", "relevance", 2, 5, "success", "b"), ("d", "relevance", 1, 7, "success", "x"), ("d", "relevance", 2, 3, "success", "y")]
    df = spark.createDataFrame(rows, "case_id string, dimension string, run int, score int, status string, feedback string")
    got = {r.case_id: (r.score, r.representative_run, r.status, r.feedback) for r in so.merge_runs(df).collect()}
    assert got == {"c": (None, 1, "error", "a"), "d": (3, 2, "success", "y")}


def test_positions_keep_rows_without_order_value(spark):
    df = spark.createDataFrame([(5,), (None,), (1,), (None,)], "i long")
    assert sorted((r.pos, r.i) for r in positions(df, "i").collect() if r.i) == [(0, 1), (1, 5)]
    assert sorted(r.pos for r in positions(df, "i").collect()) == [0, 1, 2, 3]


def test_workbook_without_layout_is_kept(spark):
    styles = spark.createDataFrame([("a", False, 500, "X", None, None, "FF", None)], "case_id string, hidden boolean, row_idx int, font_name string, font_scheme string, font_color string, fill_color string, border_style string")
    layout = spark.createDataFrame([], "case_id string, sheet string, kind string, item string, ord int")
    row = wb.formatting(styles, layout).first()
    assert (row.font_count, row.color_count, row.rule_count) == (1, 1, 0)
    assert sorted((r.kind, r.item) for r in wb.format_items(styles, layout).collect()) == [("color", "FF"), ("font", "X")]


def test_caps_follow_each_other(spark):
    rows = [("a", "data_accuracy", 4), ("a", "formula_logic", 0), ("a", "completeness", 4),
            ("b", "data_accuracy", 0), ("b", "formula_logic", 0), ("b", "completeness", 4)]
    df = spark.createDataFrame(rows, "case_id string, dimension string, score int")
    got = {(r.case_id, r.dimension): r.score for r in so.consistency_caps(df).collect()}
    assert got[("a", "data_accuracy")] == 2 and got[("a", "completeness")] == 4
    assert got[("b", "completeness")] == 2 and got[("b", "data_accuracy")] == 0


def test_sheet_names_in_formulas(spark):
    rows = [("='It''s'!A1+Data!B2", ["It's", "Data"]), ("=RawData!B2", ["RawData"]), ("=SUM(A1:B2)", []), ("='Sheet 1'!A1", ["Sheet 1"])]
    df = spark.createDataFrame([(f,) for f, _ in rows], "f string")
    got = {r.f: sorted(r.n) for r in df.select("f", sheet_refs(F.col("f")).alias("n")).collect()}
    assert got == {f: sorted(n) for f, n in rows}


def test_texts_in_two_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\n".encode("utf-8"))
    (tmp_path / "b.txt").write_bytes("é\n".encode("latin-1"))
    got = {r.file_path[-5:]: (r.text, r.is_utf8) for r in fs.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("é\n", True), "b.txt": ("é\n", False)}


def test_lines_numbered_across_blocks(spark, tmp_path):
    (tmp_path / "x.txt").write_text("\n".join(f"line {i}" for i in range(1, 2001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        rows = fs.number_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 2000 and all(r.value == f"line {r.line_no}" for r in rows)


def test_broken_case_is_reported(spark, tmp_path):
    for name, text in (("a", "id: a\nprompt: p\n"), ("b", "prompt: no id\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "case.yaml").write_text(text)
    rows = ca.load_cases(spark, str(tmp_path)).collect()
    assert [(r.id, r.error is None) for r in rows] == [("a", True), (None, False)]


def test_case_files_are_written_by_many_tasks_and_parsed_once(spark, tmp_path, monkeypatch):
    from tablecheck.plans import REGISTRY

    spark.range(0, 2000, 50).selectExpr("id AS p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    seen = tmp_path / "seen"
    seen.mkdir()

    def load(text):
        import uuid

        import yaml

        (seen / uuid.uuid4().hex).touch()
        return yaml.safe_load(text)

    monkeypatch.setattr(ca, "_load", load)
    got = REGISTRY["src_cases"].run(spark, str(tmp_path))
    files = [f.rsplit("/", 1)[1] for f in got.inputFiles()]
    assert len(files) == 40 and len({f.split("-")[1] for f in files}) > 4
    assert sorted(int(r.id.removeprefix("case-")) for r in got.collect()) == list(range(40))
    assert len(list(seen.iterdir())) == 40


def test_bundle_parts_make_the_whole(spark):
    rows = [("c", i, f"f{i}", "", f"text {i}", None) for i in range(20)]
    df = spark.createDataFrame(rows, "case_id string, file_idx long, path string, description string, content string, error string")
    parts = fs.bundle(df, 100).orderBy("part").collect()
    assert len(parts) > 5 and all(len(p.text.encode()) <= 100 for p in parts)
    whole = "\n\n".join(p.text for p in parts)
    assert whole == "\n\n".join(f"--- Input File: f{i} ---\ntext {i}" for i in range(20))


def test_sample_with_no_tail(spark):
    df = spark.createDataFrame([("a\nb\nc",), ("only",)], "t string")
    got = [r.s for r in df.select(cx.sample_lines(F.col("t"), 30, 15).alias("s")).collect()]
    assert got == ["a\n[... 2 rows omitted ...]", "[... 1 rows omitted ...]"]
