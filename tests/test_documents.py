"""Queries over documents with texts that the smallest tables lack, against their SQL."""

import duckdb

from jobmill.plans import queries as core


def test_document_fields_of_folded_texts_equal_sql(spark, tmp_path):
    texts = ["x C# y", "c++ and C++17", "a .NET b", "ASP.NET", "csharp dotnet cpp", "Node.js, REST API", "Sr. lead v Praze, Plzeň", "next  js\nhead\tof", "", "#", None]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(path)
    name = "f13_f16_document_fields"
    con = duckdb.connect()
    con.execute(f"create view documents as select doc_id, coalesce(text, '') as text from read_parquet('{path}/*.parquet')")
    theirs = {r[0]: r[1:] for r in con.execute(core.ORACLES[name]).fetchall()}
    mine = {r[0]: tuple(r)[1:] for r in core.QUERIES[name](spark, str(tmp_path)).collect()}
    assert len(mine) == len(texts) and mine == theirs
    assert mine[4][2] == "C#,.NET,C++" and mine[5][2] == "Node.js,REST"
