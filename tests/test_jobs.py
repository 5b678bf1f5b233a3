import ast
import logging
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import queries, settings_of
from jobs.collect_families import collect_families, genes, take
from jobs.group_markers import group_markers, shares

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_job_gives_what_sql_gives(spark, name):
    con = duckdb.connect()
    for t in ("documents", "lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(queries.ORACLE_SQL[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    flat = lambda t: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in t[sorted(got.columns)].itertuples(index=False)), key=str)
    assert flat(got) == flat(want) and len(got)


def parts(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_growing_input_is_taken_once(spark, tmp_path, caplog):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source")
    src, out, at = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    docs.filter("doc_id % 3 > 0").coalesce(1).write.parquet(src)
    collect_families(spark, src, out, at)
    before = parts(f"{tmp_path}/out/members")
    few = docs.filter("doc_id % 3 = 0").orderBy("doc_id").limit(5)
    few.coalesce(1).write.mode("append").parquet(src)
    families_before = parts(f"{tmp_path}/out/families")
    with caplog.at_level(logging.INFO, "genoloom.jobs"):
        second = rows(collect_families(spark, src, out, at))
    assert "read 5 rows" in caplog.text and "epoch 1" in caplog.text
    after = parts(f"{tmp_path}/out/members")
    assert before.items() <= after.items() and len(after) > len(before)
    touched = {r[0] for r in genes(few, settings_of("collect_families")).select("bucket").distinct().collect()}
    kept = {p: t for p, t in families_before.items() if int(p.split("bucket=")[1].split("/")[0]) not in touched}
    assert 0 < len(kept) < len(families_before) and kept.items() <= parts(f"{tmp_path}/out/families").items()
    # a third run finds nothing new, and one run over all gives the same
    assert rows(collect_families(spark, src, out, at)) == second and parts(f"{tmp_path}/out/members") == after
    assert rows(collect_families(spark, src, f"{out}2", f"{at}2")) == second


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    c, out = settings_of("collect_families"), f"file://{tmp_path}/out"
    first = spark.createDataFrame([(1, "a", "AC GT"), (2, "b", "acgt"), (3, "a", "TTT")], "doc_id long, source string, text string")
    more = spark.createDataFrame([(4, "c", "ACGT"), (5, None, "ACGT"), (6, "c", None), (7, "c", " \n")], "doc_id long, source string, text string")
    run = take(spark, out, c)
    run(first, 0)
    run(more, 1)
    want = rows(spark.read.parquet(f"{out}/families"))
    run(more, 1)
    assert rows(spark.read.parquet(f"{out}/families")) == want
    got = {r.n_sequences: r for r in spark.read.parquet(f"{out}/families").collect()}
    assert (got[3].n_isolates, got[3].representative, got[3].min_length, got[3].max_length) == (3, 1, 4, 5)
    assert spark.read.parquet(f"{out}/members").count() == 4


def test_input_without_genes(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    spark.createDataFrame([(1, None, "A"), (2, "a", "")], "doc_id long, source string, text string").write.parquet(src)
    assert collect_families(spark, src, f"file://{tmp_path}/out", f"file://{tmp_path}/c") is None


def test_markers_by_hand(spark):
    samples = spark.createDataFrame([(s, "x" if s < 3 else "y") for s in range(6)], "sample_id long, group string")
    has = {"everywhere": range(6), "only x": range(3), "mostly x": (0, 1, 2, 3), "one y": (5,), "unknown": (99,)}
    members = spark.createDataFrame([(f, s) for f, ss in has.items() for s in ss for _ in range(2)], "family string, sample_id long")
    got = {(r.family, r.group): r for r in shares(members, samples, settings_of("group_markers")).collect()}
    assert set(got) == {("everywhere", "x"), ("everywhere", "y"), ("only x", "x"), ("mostly x", "x"), ("mostly x", "y"), ("one y", "y")}
    assert [k for k, r in got.items() if r.marker] == [("only x", "x")]
    assert (got["mostly x", "x"].elsewhere, got["mostly x", "x"]["class"], got["one y", "y"]["class"], got["everywhere", "y"].elsewhere) == (1 / 3, "core", "shell", 1.0)
    one = shares(members, samples.filter("group = 'x'"), settings_of("group_markers"))
    assert {r.elsewhere for r in one.collect()} == {0.0}


def test_groups_of_another_run_stay(spark, tmp_path):
    at = f"file://{tmp_path}"
    spark.createDataFrame([(f, s) for f in range(4) for s in range(4) if f <= s], "l_partkey long, l_suppkey long").write.parquet(f"{at}/m")
    spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, None)], "s_suppkey long, s_nationkey int").write.parquet(f"{at}/s")
    spark.createDataFrame([(2, 2), (3, 3)], "s_suppkey long, s_nationkey int").write.parquet(f"{at}/t")
    one = rows(group_markers(spark, f"{at}/m", f"{at}/s", f"{at}/out"))
    assert rows(group_markers(spark, f"{at}/m", f"{at}/s", f"{at}/out")) == one
    both = group_markers(spark, f"{at}/m", f"{at}/t", f"{at}/out")
    assert {r.group for r in both.collect()} == {1, 2, 3}
    assert rows(both.filter("group = 1")) == [r for r in one if r[sorted(both.columns).index("group")] == 1]
    assert spark.read.parquet(f"{at}/out/groups").filter("group = 3").select(F.col("n_samples")).first()[0] == 1


def test_settings(tmp_path):
    (tmp_path / "c.toml").write_text("buckets = 8\n")
    assert settings_of("collect_families", str(tmp_path / "c.toml"))["buckets"] == 8
    (tmp_path / "d.toml").write_text("bucket = 8\n")
    with pytest.raises(ValueError, match="bucket"):
        settings_of("collect_families", str(tmp_path / "d.toml"))


def test_command_line(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    spark.createDataFrame([(1, "a", "ACGT"), (2, "b", "ACGT")], "doc_id long, source string, text string").write.parquet(src)
    env = os.environ | {"PYTHONPATH": ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")}
    done = subprocess.run([sys.executable, "-m", "jobs.collect_families", src, f"{tmp_path}/out", f"{tmp_path}/c"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "core has 1 families of 2 genes" in done.stderr
    assert spark.read.parquet(f"file://{tmp_path}/out/families").first().n_isolates == 2


def test_jobs_use_none_of_the_training_data_operators():
    for d in ("jobs",):
        for f in os.listdir(os.path.join(ROOT, d)):
            if f.endswith(".py"):
                for node in ast.walk(ast.parse(open(os.path.join(ROOT, d, f)).read())):
                    names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                    assert not any(n.startswith(("genoloom.llm", "corpus_pipeline")) for n in names), f
