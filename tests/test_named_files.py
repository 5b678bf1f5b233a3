"""Files of given names, from tasks that all ended well."""

import gzip

import pytest
from pyspark.sql import functions as F

from genoloom.sources import named_files


def rows(spark, n=60):
    return spark.range(0, n, 1, 6).select(F.concat(F.lit("d"), F.col("id") % 3, F.lit("/f"), F.col("id") % 7, F.lit(".txt")).alias("file"), (-F.col("id")).alias("ord"), F.concat(F.lit("line é "), "id").alias("value"))


def there(at):
    return sorted(str(f.relative_to(at)) for f in at.rglob("*") if f.is_file())


def test_names_and_order(spark, tmp_path):
    named_files.write(rows(spark), str(tmp_path / "out"), "ord")
    want = {}
    for k in range(59, -1, -1):
        want.setdefault(f"d{k % 3}/f{k % 7}.txt", []).append(f"line é {k}")
    assert {f: (tmp_path / "out" / f).read_text().splitlines() for f in there(tmp_path / "out")} == want


def test_append_and_overwrite(spark, tmp_path):
    at = tmp_path / "out"
    one = lambda file, value: spark.createDataFrame([(file, value)], "file string, value string")
    named_files.write(one("a", "1"), f"file://{at}")
    named_files.write(one("b/c.gz", "2"), f"file://{at}")
    assert there(at) == ["a", "b/c.gz"] and gzip.decompress((at / "b/c.gz").read_bytes()) == b"2\n"
    named_files.write(one("a", "3"), str(at))
    assert (at / "a").read_text() == "3\n" and there(at) == ["a", "b/c.gz"]
    named_files.write(one("d", "4"), str(at), mode="overwrite")
    assert there(at) == ["d"]
    named_files.write(one("d", "5").limit(0), str(at), mode="overwrite")
    assert there(at) == []


@pytest.mark.parametrize("bad", ["../x", "/x", None])
def test_a_task_that_fails_leaves_no_file(spark, tmp_path, bad):
    t = rows(spark).unionByName(spark.createDataFrame([(bad, 0, "x")], "file string, ord long, value string"))
    named_files.write(spark.createDataFrame([("kept", "1")], "file string, value string"), str(tmp_path))
    with pytest.raises(Exception, match="not a file's name"):
        named_files.write(t, str(tmp_path), "ord")
    assert there(tmp_path) == ["kept"] and not list(tmp_path.glob("_writing*"))


def test_rows_of_one_file_in_several_tasks_are_refused(spark, tmp_path):
    named_files.register(spark)
    t = spark.range(0, 4, 1, 2).select(F.lit("a").alias("file"), F.col("id").cast("string").alias("value"))
    with pytest.raises(Exception, match="several tasks"):
        t.write.format("named_files").mode("append").save(str(tmp_path))
    assert there(tmp_path) == []
