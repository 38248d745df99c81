"""Files of a round trip are read without looking into every line for the name of its file, and labels are numbered once."""

from __future__ import annotations

from shiftgrid.sources import matrices
from workload import files


def test_names_of_folders_are_no_work_for_a_line(spark, tmp_path):
    rows = [(s, o, f"{s} {o} {i}") for s in ("a b", "01", "1", None) for o in (0, 2) for i in range(3)]
    spark.createDataFrame(rows, "s string, o int, value string").repartition(3).write.partitionBy("s", "o").text(str(tmp_path / "x"))
    lines = files.folder_lines(spark, f"{tmp_path}/x/*/*/", "s", ".txt")
    assert "regexp" not in lines._jdf.queryExecution().executedPlan().toString().lower()
    got = sorted((r["file_name"], r["place"]["folder"], r["line"]) for r in lines.collect())
    assert got == sorted(((s or "__HIVE_DEFAULT_PARTITION__") + ".txt", o, line) for s, o, line in rows)
    assert {r["place"]["part"] for r in lines.collect()} <= {0, 1, 2}
    flat = files.folder_lines(spark, f"{tmp_path}/x/s=01/*/", "o", "").collect()
    assert {r["file_name"] for r in flat} == {"0", "2"} and {r["place"]["folder"] for r in flat} == {None}


def test_labels_of_a_trio_are_numbered_once(spark, tmp_path):
    for name, text in (("x_matrix.mtx", "%%MatrixMarket\n2 3 2\n1 3 5\n2 1 7\n"), ("x_barcodes.tsv", "c1\nc2\nc3\n"), ("x_features.tsv", "i1\tg1\tG\ni2\tg2\tG\n")):
        (tmp_path / name).write_text(text)
    counts, features = matrices.read_mtx(spark, str(tmp_path))
    for df in (counts, features):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in counts.collect()) == [("x_", "c1", "g2", 7.0), ("x_", "c3", "g1", 5.0)]
