import glob
import os

import pytest
from blobtrail.operators import sinks
from pyspark.sql import functions as F


def read_back(path):
    """{section: lines} of the files in a folder; a section that two files
    share goes on in the second."""
    out = {}
    for name in sorted(glob.glob(f"{path}/part-*")):
        with open(name, encoding="utf-8", newline="") as f:
            for block in f.read().removesuffix("\n").split("\n\n["):
                head, *lines = block.removeprefix("[").split("]\n", 1)
                out.setdefault(head, []).extend(lines[0].split("\n") if lines else [])
    return out


def test_files_read_back_equal_the_table(spark, tmp_path):
    rows = [(f"query {q}", k, f"line {k} of {q} é\t") for q in range(40) for k in range(q % 4 + 1)] + [("list a b 3", r, f"  - commit={r}") for r in range(500)]
    df = spark.createDataFrame(rows, sinks.LINES).repartition(7)
    path = f"{tmp_path}/out"
    sinks.write_lines(df, path)
    want = {}
    for s, _, line in sorted(rows):
        want.setdefault(s, []).append(line)
    assert read_back(path) == want
    success = open(f"{path}/{sinks.SUCCESS}").read()
    assert f"lines={len(rows)}\n" in success and not glob.glob(f"{path}/_staging-*")
    # Appending adds files, overwriting replaces them.
    more = spark.createDataFrame([("new", 0, "x")], sinks.LINES)
    sinks.write_lines(more, path)
    assert read_back(path) == {**want, "new": ["x"]}
    sinks.write_lines(more, path, "overwrite")
    assert read_back(path) == {"new": ["x"]}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/out"
    first = spark.createDataFrame([("kept", 0, "as it was")], sinks.LINES)
    sinks.write_lines(first, path)
    bad = F.when(F.col("id") == 777, F.raise_error(F.lit("broken row"))).otherwise(F.lit("ok"))
    df = spark.range(0, 1000, 1, 5).select(F.lit("s").alias("section"), F.col("id").alias("ord"), bad.alias("line"))
    spark.dataSource.register(sinks.LineFiles)
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken row"):
            df.write.format(sinks.FORMAT).mode(mode).option("path", path).save()
        assert read_back(path) == {"kept": ["as it was"]}
        assert sorted(os.listdir(path)) == sorted([sinks.SUCCESS, *map(os.path.basename, glob.glob(f"{path}/part-*"))])


def test_empty_tables_and_wrong_rows(spark, tmp_path):
    sinks.write_lines(spark.createDataFrame([], sinks.LINES), f"{tmp_path}/none")
    assert os.listdir(f"{tmp_path}/none") == [sinks.SUCCESS]
    spark.dataSource.register(sinks.LineFiles)
    with pytest.raises(Exception, match="rows must be"):
        spark.range(3).write.format(sinks.FORMAT).mode("append").option("path", f"{tmp_path}/x").save()
    with pytest.raises(Exception, match="share"):
        sinks.write_lines(spark.createDataFrame([("a", 0, "b")], sinks.LINES), "s3://bucket/x")


def test_reports_and_env_of_a_cascade(spark, tmp_path):
    from blobtrail.plans import q_match, registry
    from blobtrail.plans import report as R

    registry.load_all()
    repo = registry.repo_for(spark, "/root/testdata/sf0.001")
    summary = q_match.cascade(repo)["summary"]
    report, env = registry.run("match_report", spark, repo.sf_dir), registry.run("match_env", spark, repo.sf_dir)
    lists = registry.run("match_candidates", spark, repo.sf_dir)
    sinks.write_lines(sinks.report_lines(report, summary, lists), f"{tmp_path}/report")
    back = read_back(f"{tmp_path}/report")
    heads = {r.query_id: r.report_head.split("\n") for r in report.collect()}
    for q, head in heads.items():
        got = back[f"query {q}"]
        assert got[:-1] == head[:-1] and got[-1].startswith("candidates:")
        if got[-1] != "candidates:":
            assert got[-1].removeprefix("candidates: ") in back
    want = {}
    for r in sorted(lists.collect(), key=lambda r: r.rank):
        want.setdefault(f"list {r.name or '-'} {r.blob_norm} {r.tier}", []).extend(r.line.split("\n"))
    assert {k: v for k, v in back.items() if k.startswith("list ")} == want
    sinks.write_lines(sinks.env_lines(env, summary), f"{tmp_path}/env")
    back = read_back(f"{tmp_path}/env")
    for r in env.collect():
        assert f"{r.key}={r.value}" in "\n".join(back[f"query {r.query_id}"])
    # Written out for some queries: the ranked commits but the query's own.
    fast = R.candidate_lines(q_match.cascade(repo)["candidates"], None, None)
    commits = sinks.candidate_commits(report, summary, fast, summary.select("query_id")).collect()
    counts = {r.query_id: (r.candidates_count, r.preferred) for r in summary.collect() if r.tier is not None}
    assert {r.query_id for r in commits} == set(counts)
    for r in commits:
        listed = r.value.removeprefix(' -> \n"').removesuffix('"').split("\t\n")
        assert len(listed) == counts[r.query_id][0] and str(counts[r.query_id][1]) in listed
