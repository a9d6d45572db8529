"""Draws and matrices written and read back."""

from dyadflow.sources import readers as R


def test_last_iteration(spark, tmp_path):
    rows = [(n, var, 0, j, float(n + j)) for n in (1, 2, 5) for var in ("eta", "z") for j in range(3)]
    df = spark.createDataFrame(rows, "iter int, var string, i int, j int, value double")
    df.write.partitionBy("iter", "var").parquet(f"{tmp_path}/draws")
    got = lambda *a: {r["iter"] for r in R.read_samples(spark, f"{tmp_path}/draws", ["eta"], *a).collect()}
    assert (got(), got(None, 4), got(1, 5), got(1, 5, 2)) == ({5}, {2}, {1, 2, 5}, {1, 5})


def test_matrix_text(spark, tmp_path):
    cells = spark.createDataFrame([(1, "eta", i, j, i + j / 10) for i in range(4) for j in (1, 0)], "iter int, var string, i int, j int, value double")
    R.write_matrices(cells, f"{tmp_path}/text")
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/text/iter=1/var=eta").collect()]
    assert sorted(lines) == [f"{i}.0 {i}.1" for i in range(4)]
    R.write_vocabulary(spark.createDataFrame([(1, "b"), (0, "a")], "id int, name string"), f"{tmp_path}/names")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/names").collect()) == ["a", "b"]
