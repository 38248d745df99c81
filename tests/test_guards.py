from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from shiftgrid.functions import scalars as X
from shiftgrid.operators import aggregates, filters, joins, matrix
from shiftgrid.operators.filters import GuardError
from shiftgrid.plans import audit, validation, whatif
from shiftgrid.sources import matrices, tables, text


def test_sync_subset(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    with pytest.raises(GuardError):
        joins.sync_subset(a, b, ["k"])
    assert joins.sync_subset(a, b.where("k = 2"), ["k"]).count() == 1


def test_apply_labels(spark):
    cells = spark.createDataFrame([(1,), (2,)], "cluster int")
    with pytest.raises(GuardError):
        joins.apply_labels(cells, spark.createDataFrame([(1, "a"), (2, " ")], "cluster int, label string"), "cluster", "label")
    with pytest.raises(GuardError):
        joins.apply_labels(cells, spark.createDataFrame([(1, "a")], "cluster int, label string"), "cluster", "label")


def test_map_ids_threshold(spark):
    ids = spark.createDataFrame([(f"{i}.1",) for i in range(10)], "id string")

    def mapping(k):
        return spark.createDataFrame([(str(i), f"s{i}") for i in range(k)], "GeneID string, Symbol string")

    assert joins.map_ids(ids, mapping(5), "id", "GeneID", "Symbol").where("is_mapped").count() == 5
    with pytest.raises(GuardError):
        joins.map_ids(ids, mapping(4), "id", "GeneID", "Symbol")


def test_check_difference_needs_both(spark):
    df = spark.createDataFrame([("s", "a", 1.0, 1)], "scope string, check string, v double, o int")
    with pytest.raises(GuardError):
        aggregates.check_difference(df, "scope", "check", "v", ["o"], "a", "b")


def test_split_by_type_needs_peaks(spark):
    counts = spark.createDataFrame([("c", "f", 1.0)], "cell_id string, feature_id string, count double")
    feats = spark.createDataFrame([("f", "Gene Expression")], "feature_id string, feature_type string")
    with pytest.raises(GuardError):
        filters.split_by_type(counts, feats)


def test_regulon_needs_genes(spark):
    e = spark.createDataFrame([("A", "t", "g", 1.0)], "scope string, tf string, target string, weight double")
    x = spark.createDataFrame([("A", "s", "g", 1.0)], "scope string, sample string, gene string, value double")
    with pytest.raises(GuardError):
        matrix.regulon_activity(x, e, ["scope"], "sample", "gene", "value")


def test_self_check_gene(spark):
    counts = spark.createDataFrame([("p_1", "a", 5.0), ("p_1", "b", 5.0), ("q_1", "a", 1.0), ("q_1", "b", 9.0)], "cell_id string, gene string, count double")
    cl = spark.createDataFrame([("p_1", "x"), ("q_1", "x")], "cell_id string, cluster string")
    t, r = validation.pick_cells(cl, "p", ["x"], "target"), validation.pick_cells(cl, "q", ["x"], "reference")
    got = {x["gene"]: x["real_shift"] for x in validation.real_shift(counts, t, r, ["a"]).collect()}
    assert got["a"] > 0.5 > got["b"]
    with pytest.raises(GuardError):
        validation.real_shift(counts, t, r, ["b"])
    with pytest.raises(GuardError):
        validation.real_shift(counts, t, t.withColumn("side", F.lit("reference")))
    with pytest.raises(GuardError):
        validation.pick_cells(cl, "p", ["nope"], "target")


def test_variant_guards(spark):
    expr = spark.createDataFrame([("t", "s", 1.0)], "f string, s string, v double")

    def v(rows):
        return spark.createDataFrame(rows, "variant string, mode string, tfs array<string>")

    whatif.check_variants(v([("ko__t", "ko", ["t"])]), expr, "f")
    for bad in ([("x", "up", ["t"])], [("x", "ko", [])], [("x", "ko", ["u"])], [("x", "ko", ["t"]), ("x", "oe", ["t"])], [("__baseline_mean__", "ko", ["t"])]):
        with pytest.raises(GuardError):
            whatif.check_variants(v(bad), expr, "f")


def test_qc_order(spark):
    # cell m has a high mitochondrial share but still counts towards gene support
    rows = [("s", "m", "mt-1", 90.0, True), ("s", "m", "g1", 5.0, False), ("s", "a", "g1", 5.0, False), ("s", "a", "g2", 5.0, False), ("s", "b", "g2", 5.0, False)]
    c = spark.createDataFrame(rows, "sample_id string, cell_id string, feature_id string, count double, is_mt boolean").withColumn("is_hb", F.lit(False))
    out = filters.qc_rna(c, ["sample_id", "cell_id"], ["sample_id", "feature_id"], min_genes=2, min_cells=2)
    assert sorted((r["cell_id"], r["feature_id"]) for r in out.collect()) == [("a", "g1")]


def test_doublet_thresholds(spark):
    cells = spark.createDataFrame([("m", 0.3), ("a", 0.3), ("f", 0.3), ("n", 0.3)], "sample string, score double")
    thr = spark.createDataFrame([("m", 0.2, 0.9, None), ("a", None, 0.2, 0.1), ("f", None, 0.9, 0.2), ("n", None, 0.9, None)],
                                "sample string, manual double, automatic double, fallback double")
    got = {r["sample"]: (r["threshold_source"], r["is_doublet"]) for r in filters.flag_doublets(cells, "sample", "score", thr).collect()}
    assert got == {"m": ("manual", True), "a": ("automatic", True), "f": ("fallback", True), "n": ("automatic", False)}


def test_pair_cells_keeps_unpaired_samples(spark):
    r = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "s string, c int")
    k = spark.createDataFrame([("a", 2), ("b", 5)], "s string, c int")
    rna, atac, report = joins.pair_cells(r, k, ["c"], ["s"])
    assert sorted(map(tuple, rna.collect())) == [("a", 2), ("b", 1)] and atac.count() == 2
    assert {x["s"]: x["n_shared"] for x in report.collect()} == {"a": 1, "b": 0}


def test_compare_tables_statuses(spark):
    def t(rows):
        return spark.createDataFrame(rows, "id string, r string, c string, v double")

    base = [("x", "r1", "c1", 1.0), ("x", "r2", "c1", None)]
    same = {r["id"]: r["status"] for r in audit.compare_tables(t(base), t(base), ["id"], "r", "c", "v").collect()}
    assert same == {"x": "OK"}
    for other, want in (([("x", "r1", "c1", 1.0)], "SHAPE_MISMATCH"), ([("x", "r1", "c1", 1.0), ("x", "r3", "c1", None)], "LABEL_MISMATCH"),
                        ([("x", "r1", "c1", None), ("x", "r2", "c1", None)], "NAN_POSITION_MISMATCH"), ([("x", "r1", "c1", 1.1), ("x", "r2", "c1", None)], "VALUE_DIFF")):
        assert audit.compare_tables(t(base), t(other), ["id"], "r", "c", "v").first()["status"] == want


def test_name_rules(spark):
    names = {"WT-1": "wt", "P1_WT19_rep2": "p1_wt", "Mut21": "mut", "a_b_c": "a", "A01": "a", "ctrl A B12": "ctrl", "wt_value_counts": "wt",
             "E18.5_Insm1-Het_OHC1": "e18.5_insm1_het_ohc", "abc12": "abc", "": ""}
    df = spark.createDataFrame([(k,) for k in names], "n string")
    assert {r["n"]: r["p"] for r in df.select("n", X.name_prefix(F.col("n")).alias("p")).collect()} == names


def test_regions(spark):
    df = spark.createDataFrame([("chr1:5-9",), ("peak7",), ("1:5-9",)], "r string")
    got = [tuple(r) for r in df.select(X.region_chrom(F.col("r")), X.region_start(F.col("r")), X.region_end(F.col("r"))).collect()]
    assert got == [("chr1", 5, 9), (None, None, None), (None, None, None)]


# ----------------------------------------------------------------------------------------------------------------- files
def test_bed_rows(spark, tmp_path):
    p = tmp_path / "a.bed"
    p.write_text("#h\ntrack x\nbrowser y\nchr1\t1\t2\nchr1 3 x\nchr1\t1\t5\tchr2\t7\t9\nchr1\t1\t6\tname\t0\t+\nchr1\t4\n")
    got = sorted((r["chrom"], r["start"], r["end"]) for r in tables.read_intervals(spark, str(p)).collect())
    assert got == [("chr1", 1, 2), ("chr1", 1, 5), ("chr1", 1, 6), ("chr2", 7, 9)]


def test_sniffed_compression_and_utf16(spark, tmp_path):
    (tmp_path / "plain.tsv.gz").write_text("a\t1\nb\t2\n")
    with gzip.open(tmp_path / "packed.tsv", "wt") as fh:
        fh.write("c\t3\n")
    rows = text.read_text_sniff(spark, [str(tmp_path / "plain.tsv.gz"), str(tmp_path / "packed.tsv")]).collect()
    assert sorted(r["line"] for r in rows) == ["a\t1", "b\t2", "c\t3"]
    (tmp_path / "wide.txt").write_bytes("x\ty\n".encode("utf-16"))
    assert text.read_text_sniff(spark, str(tmp_path / "wide.txt"), "utf-16").first()["line"] == "x\ty"


def write_trio(folder, prefix, dims, entries, cells, genes):
    (folder / f"{prefix}matrix.mtx").write_text("%%MatrixMarket\n%c\n" + dims + "\n" + "".join(e + "\n" for e in entries))
    (folder / f"{prefix}barcodes.tsv").write_text("".join(c + "\n" for c in cells))
    (folder / f"{prefix}features.tsv").write_text("".join(g + "\n" for g in genes))


def test_mtx_trios_and_orientation(spark, tmp_path):
    genes = ["i1\tg1\tGene Expression", "i2\tg2\tGene Expression", "i3\tg3\tPeaks"]
    write_trio(tmp_path, "one_", "3 2 3", ["1 1 5", "3 2 2", "2 1 1"], ["c1", "c2"], genes)
    write_trio(tmp_path, "two_", "2 3 1", ["2 3 7"], ["c1", "c2"], genes)
    counts, features = matrices.read_mtx(spark, str(tmp_path))
    got = sorted((r["prefix"], r["cell_id"], r["feature_id"], r["count"]) for r in counts.collect())
    assert got == [("one_", "c1", "g1", 5.0), ("one_", "c1", "g2", 1.0), ("one_", "c2", "g3", 2.0), ("two_", "c2", "g3", 7.0)]
    assert features.count() == 6
    bulk = {(r["sample"], r["feature_id"]): r["count"] for r in matrices.read_mtx_pseudobulk(spark, str(tmp_path)).collect()}
    assert bulk[("two", "g3")] == 7.0 and len(bulk) == 4


def test_mtx_shape_guard(spark, tmp_path):
    write_trio(tmp_path, "x_", "9 9 1", ["1 1 5"], ["c1"], ["g1"])
    with pytest.raises(GuardError):
        matrices.read_mtx(spark, str(tmp_path))


def test_mtx_feature_lists_must_agree(spark, tmp_path):
    write_trio(tmp_path, "a_", "2 1 1", ["1 1 5"], ["c1"], ["g1", "g2"])
    write_trio(tmp_path, "b_", "2 1 1", ["1 1 5"], ["c1"], ["g2", "g1"])
    with pytest.raises(GuardError):
        matrices.read_mtx_pseudobulk(spark, str(tmp_path))


def test_per_sample_files(spark, tmp_path):
    (tmp_path / "GSM1_wt.txt").write_text("caption\n\nsym\tgene_id\tWT\nA\tg1\t5\nB\tg2\tx\n")
    (tmp_path / "GSM2_ko.txt").write_text("sym\tgene_id\tKO\nAA\tg1\t7\nC\tg3\t1\n")
    (tmp_path / "GSM3_bad.txt").write_text("nothing\n")
    long = matrices.read_per_sample(spark, str(tmp_path / "*.txt"), "gene_id", 1, name=r"GSM\d+_(\w+)\.txt", exclude="bad", symbol="sym")
    got = sorted((r["sample"], r["gene"], r["value"]) for r in long.collect())
    assert got == [("ko", "g1", 7.0), ("ko", "g3", 1.0), ("wt", "g1", 5.0), ("wt", "g2", 0.0)]
    named = joins.map_symbols_first(long, "gene", "symbol", ["file_name", "place"])
    assert {r["final_symbol"] for r in named.where("gene = 'g1'").collect()} == {"A"}
    assert matrices.densify(long.select("gene", "sample", "value")).count() == 6
    with pytest.raises(GuardError):
        matrices.read_per_sample(spark, str(tmp_path / "*.txt"), "gene_id", 1)


def test_wide_matrix_guards(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("id,a,b,note\n" + "".join(f"g{i},{i},{'x' if i == 0 else i},t\n" for i in range(30)))
    long = matrices.read_wide_matrix(spark, str(p), "id")
    assert {r["sample"] for r in long.select("sample").distinct().collect()} == {"a", "b"}
    with pytest.raises(GuardError):
        matrices.read_wide_matrix(spark, str(p), "id", deny=["a"])
    with pytest.raises(GuardError):
        matrices.read_wide_matrix(spark, str(p), "id", pattern="zz")


def test_compare_tables_deals_cells_by_their_number(spark, monkeypatch):
    """Tasks grow with the cells of both tables; statuses do not change, with null labels and undefined values among them."""
    from shiftgrid import session
    from shiftgrid.plans import audit

    rows = [(i, r, c, None if r == "r3" else 1.5) for i in ("x", "y") for r in ("r1", "r2", "r3", None) for c in (1, 2, None)]
    a = spark.createDataFrame([x for x in rows if x[1] is not None and x[2] is not None], "id string, r string, c int, v double")
    b = a.where("id = 'x' OR r <> 'r1'")
    few = sorted(map(str, audit.compare_tables(a, b, ["id"], "r", "c", "v").collect()))
    monkeypatch.setattr(session, "TASK_ROWS", 1)
    out = audit.compare_tables(a, b, ["id"], "r", "c", "v")
    assert sorted(map(str, out.collect())) == few
    assert {r["id"]: r["status"] for r in out.collect()} == {"x": "OK", "y": "SHAPE_MISMATCH"}
    assert "hashpartitioning(id#" in (plan := out._jdf.queryExecution().executedPlan().toString()) and ", 22)" in plan
    whole = spark.createDataFrame(rows, a.schema)
    got = {r["id"]: (r["status"], r["n_unmatched"]) for r in audit.compare_tables(whole, whole, ["id"], "r", "c", "v").collect()}
    assert got == {"x": ("LABEL_MISMATCH", 12), "y": ("LABEL_MISMATCH", 12)}  # a null label meets none
