"""The registered queries of the folder and the pipeline on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tidewatch.llm import jaccard_join, line_rules, weak_pii
from tidewatch.llm.queries import ORACLES, QUERIES, line_rules_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=key)
    assert got == sorted(cursor.fetchall(), key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_covers_every_document(spark, name):
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in QUERIES[name](spark, SF).select("doc_id").collect()} == docs


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        before = {r.doc_id: r for r in docs.collect()}
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == set(before)
            continue
        assert out.columns == columns
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if name == "personal_data":
            assert set(after) == set(before)
            assert all(not weak_pii.base_spans(r.text) for r in after.values())
            assert all(r.n_chars == len(r.text) for r in after.values() if r.text != before[r.doc_id].text)
        else:
            assert all(after[d] == before[d] for d in after)
        if name == "quality_rules":
            kept = {r.doc_id for r in line_rules.judge(docs, ["doc_id"]).where("kept").collect()}
            assert set(after) == kept
        if name == "near_duplicates":
            roots = {r.doc_id: r.component_id for r in jaccard_join.join(docs, words=5, percent=80).collect()}
            assert set(after) == {d for d, c in roots.items() if d == c}
        docs = out
    rows = corpus_pipeline.run(spark, SF).collect()
    assert len(rows) and np.all([r.length > 0 for r in rows])


def test_quality_rules_take_frequent_lines_out(spark):
    def own(i, n):
        return " ".join("".join(chr(97 + (1000 * i + k) // 26**j % 26) for j in range(6)) for k in range(n))

    text = "\tSmall  PRINT of 2024\n\n{}\r\nsmall print of 1999 \n {} \n"
    rows = [(i, text.format(own(i, 60), own(500 + i, 5)), "h") for i in range(60)] * 2
    rows += [(900, "Small print of 2024\n" + own(900, 60), "other"), (901, "Small print of 2024\n" + own(901, 2), "h")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, source string, n_chars long")
    out = corpus_pipeline.quality_rules(spark, docs, SF)
    assert out.schema == docs.schema
    after = out.collect()
    assert len(after) == 121 and 901 not in {r.doc_id for r in after}
    for r in after:
        want = rows[-2][1] if r.doc_id == 900 else f"\n{own(r.doc_id, 60)}\r\n {own(500 + r.doc_id, 5)} \n"
        assert r.text == want and r.n_chars == len(want)


def test_line_rules_match_sql_where_lines_are_removed(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    for limit in (0, 2):
        df = line_rules.judge(spark.read.parquet(path), ["doc_id"], line_limit=limit)
        cursor = con.execute(line_rules_sql(limit))
        names = [d[0] for d in cursor.description]
        got = sorted(tuple(r[c] for c in names) for r in df.collect())
        assert got == sorted(cursor.fetchall())
        assert any(r[names.index("n_frequent_lines")] > 0 for r in got)
        if limit == 0:  # all lines count as frequent: whole texts are depleted
            assert any(not r[names.index("kept")] and not r[names.index("base_failed")] for r in got)
