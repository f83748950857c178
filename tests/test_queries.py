from __future__ import annotations

import glob
import os
import re

import pytest

import storyloom
from storyloom.plans import queries as Q

duckdb = pytest.importorskip("duckdb")


def cell(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, data, name):
    df = Q.QUERIES[name](spark, data)
    got = rows(df.columns, df.collect())
    assert got
    if name in Q.SQL:
        con = duckdb.connect()
        for path in glob.glob(f"{data}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        result = con.execute(Q.SQL[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert got == rows(columns, result.fetchall())


def test_documents_have_tables_and_rosters_in_words(spark, tmp_path):
    table = "Before.\n| Name | Age |\n|---|---|\n| Anna | 412 |\nAfter."
    roster = "No. Name Pos Age Int Wage [CA PA] CA +/-\n1. Marek Masarik GK 38 SVK 30000 [152 165] 11\n\nProse."
    spark.createDataFrame([(1, table), (2, roster), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["spoken"] for r in Q.QUERIES["normalize_documents"](spark, str(tmp_path)).collect()}
    assert got[1] == "Before.\nName: Anna, Age: four hundred twelve.\nAfter."
    assert got[2] == "Number 1, Marek Masarik, goalkeeper, age 38, Slovakia, wage thirty thousand pounds. P. A. one hundred sixty-five, C. A. one hundred fifty-two, up 11.\n\nProse."
    assert got[3] is None


def test_nothing_imports_the_optional_subpackage():
    root = os.path.dirname(storyloom.__file__)
    for path in glob.glob(f"{root}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            with open(path, encoding="utf-8") as f:
                assert not re.search(r"(?:from|import)\s+[\w.]*\bllm\b", f.read()), path
