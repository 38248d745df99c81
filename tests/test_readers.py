"""Readers of wide tables, sniffed text and matrices, and streaming digests."""

from __future__ import annotations

import gzip
import hashlib

import pytest

from shiftgrid.operators.filters import GuardError
from shiftgrid.sources import matrices, sinks, tables, text


def test_wide_table_of_many_columns(spark, tmp_path):
    """25,000 samples: the plan stays a few nodes of one array column."""
    n = 25_000
    rows = ["gene\t" + "\t".join(f"s{i}" for i in range(n)), "a\t" + "\t".join(str(i) for i in range(n)), "b\t" + "\t".join(["x"] * 3 + ["1"] * (n - 3))]
    (tmp_path / "wide.tsv").write_text("\n".join(rows) + "\n")
    df = matrices.read_wide_matrix(spark, str(tmp_path / "wide.tsv"), "gene")
    plan = df._jdf.queryExecution().optimizedPlan().numberedTreeString()
    assert plan.count("\n") < 12
    found = df.groupBy("gene").agg({"value": "sum", "sample": "count"}).collect()
    # the first three columns have one unreadable cell of two: they are no numbers
    assert {r["gene"]: (r["sum(value)"], r["count(sample)"]) for r in found} == {"a": (float(sum(range(3, n))), n - 3), "b": (float(n - 3), n - 3)}


def test_quotes_short_rows_and_unreadable_cells(spark, tmp_path):
    (tmp_path / "t.csv").write_text('gene,"s,1",s2,note\n"a ""x""",1,2,"p,q"\nb,,nan?,r\nc,5\n')
    wide = matrices.read_table(spark, str(tmp_path / "t.csv"))
    assert wide.names == ["gene", "s,1", "s2", "note"]
    got = sorted((r.gene, r.sample, r.value) for r in matrices.to_long(wide, "gene", ["s,1", "s2"]).collect())
    assert got == [('a "x"', "s,1", 1.0), ('a "x"', "s2", 2.0), ("b", "s,1", 0.0), ("b", "s2", 0.0), ("c", "s,1", 5.0), ("c", "s2", 0.0)]
    assert matrices.matching_columns(wide, "gene", "s") == ["s,1", "s2"]
    with pytest.raises(GuardError):
        matrices.numeric_columns(wide, "gene", max_bad=0.0)
    with pytest.raises(GuardError):
        matrices.matching_columns(wide, "gene", "z")
    with pytest.raises(GuardError):
        matrices.read_wide_matrix(spark, str(tmp_path / "t.csv"), "id")


def test_longer_rows_are_refused(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("gene\ts1\na\t1\t2\n")
    with pytest.raises(Exception, match="more than 2 cells"):
        matrices.read_table(spark, str(tmp_path / "t.tsv")).rows.collect()


def trio(folder, entries, head="2 3 2"):
    (folder / "x_matrix.mtx").write_text("%%MatrixMarket matrix coordinate real general\n" + head + "\n" + "".join(f"{e}\n" for e in entries))
    (folder / "x_barcodes.tsv").write_text("c1\nc2\nc3\n")
    (folder / "x_features.tsv").write_text("f1\tF1\tG\nf2\tF2\tG\n")


def test_truncated_matrix(spark, tmp_path):
    trio(tmp_path, ["1 1 4", "2 3 5"])
    counts, _ = matrices.read_mtx(spark, str(tmp_path))
    assert sorted((r.cell_id, r.feature_id, r["count"]) for r in counts.collect()) == [("c1", "F1", 4.0), ("c3", "F2", 5.0)]
    trio(tmp_path, ["1 1 4"])
    with pytest.raises(GuardError, match="number of entries"):
        matrices.read_mtx(spark, str(tmp_path))


def test_entry_without_a_label(spark, tmp_path):
    trio(tmp_path, ["1 1 4", "2 4 5"])
    with pytest.raises(GuardError, match="no label"):
        matrices.read_mtx(spark, str(tmp_path))


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_sniffed_text_by_byte_range(spark, tmp_path, block):
    lines = [f"line {i} é{'x' * (i % 5)}" for i in range(23)] + ["", "last without end"]
    (tmp_path / "plain.txt.gz").write_bytes("\n".join(lines).encode())
    (tmp_path / "packed.txt").write_bytes(gzip.compress(("\r\n".join(lines) + "\r\n").encode()))
    (tmp_path / "empty.txt").write_bytes(b"")
    df = text.read_text_sniff(spark, str(tmp_path), block=block)
    for name in ("plain.txt.gz", "packed.txt"):
        assert [r.line for r in df.where(df.file_name == name).orderBy("place").collect()] == lines
    assert df.where(df.file_name == "empty.txt").count() == 0
    if block == 7:
        assert df.where(df.file_name == "plain.txt.gz").select("place.block").distinct().count() > 10


def test_digest_is_a_stream(spark, tmp_path):
    data = bytes(range(256)) * 12_000
    (tmp_path / "a b.bin").write_bytes(data)
    (tmp_path / "none").write_bytes(b"")
    df = sinks.file_hashes(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[-1]: r.md5 for r in df.collect()}
    assert got == {"a b.bin": hashlib.md5(data).hexdigest()[:12]}  # an empty file is not listed
    assert "content" not in df._jdf.queryExecution().executedPlan().toString()


def test_gene_set_line_is_split_once(spark, tmp_path):
    (tmp_path / "sets.gmt").write_text("a\tx\tg1\t\tg2\nb\ty\tg1\n")
    df = tables.read_gmt(spark, str(tmp_path / "sets.gmt"), 1, 5)
    assert sorted((r["set_name"], r["gene"]) for r in df.collect()) == [("a", "g1"), ("a", "g2"), ("b", "g1")]
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    # the plan is listed from the top: nothing above an explode splits a line
    for i, line in enumerate(plan):
        if "Generate explode" in line:
            assert "split(" not in plan[i - 1]


def test_provenance_hashes_its_inputs(spark, tmp_path):
    import __spark_entry__ as entry

    for name, rows, schema in (("region", [(1, "B"), (0, "A")], "r_regionkey int, r_name string"), ("nation", [(7, "N")], "n_nationkey int, n_name string"),
                               ("supplier", [(5,)], "s_suppkey bigint")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    row = entry.queries()["snk2_provenance"](spark, str(tmp_path)).first()
    assert row["input_0"] == hashlib.md5(b"0,A\n1,B\n").hexdigest()[:12] and row["input_1"] == hashlib.md5(b"7,N\n").hexdigest()[:12]
    assert row["has_input_hash"] and row["config_hash_length"] == 10
