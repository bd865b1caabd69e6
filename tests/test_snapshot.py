import json

import pytest
from pyspark.sql import functions as F

from headwater.operators import snapshot as S
from headwater.sources.feeds import embedded_snapshot

ITEMS = "id string, column string, rank int, source string, title string, url string, date timestamp"


def tables(spark):
    items = spark.sql(
        "select * from values ('a','x',1,'s1','</script><b> ','https://e/1',timestamp'2024-01-01 00:00:00'), ('b','x',2,'s2',null,'https://e/2',null), ('c','y',1,'s1','t','https://e/3',timestamp'2024-01-02 00:00:00'), ('d',null,1,'s3','t','u',null) as t(id,column,rank,source,title,url,date)"
    )
    columns = spark.createDataFrame([("y", "Y"), ("x", "X")], "id string, name string")
    sources = spark.createDataFrame([("s1", "One"), ("s2", None), ("s3", "Three")], "id string, name string")
    trends = spark.createDataFrame([(1, "t1", 2.5, "x"), (2, "t2", 1.0, "y")], "rank long, term string, score double, column string")
    of = spark.createDataFrame([(1, "t1", "b"), (1, "t1", "a"), (1, "t1", "gone")], "rank long, term string, id string")
    return items, columns, sources, trends, of


def test_round_trip(spark, tmp_path):
    items, columns, sources, trends, of = tables(spark)
    built, path = S.build(items, columns, sources, trends, of, "v1"), f"file://{tmp_path}/page"
    assert S.publish(built, path, least=3) == "written"
    html = next(f for f in (tmp_path / "page").iterdir() if f.suffix == ".txt").read_text()
    assert html.count("</script>") == 1 and " " not in html
    told = json.loads(html.split('id="page-data">')[1].split("</script>")[0])
    assert [c["id"] for c in told["columns"]] == ["x", "y"] and [s["id"] for s in told["sources"]] == ["s1", "s2"]
    back = S.read(spark, path)
    want = [("a", "x", 1, "s1", "</script><b> ", "https://e/1"), ("b", "x", 2, "s2", None, "https://e/2"), ("c", "y", 1, "s1", "t", "https://e/3")]
    assert [tuple(r)[:6] for r in S.part(back, "items").collect()] == want
    assert [(r.term, r.ids) for r in S.part(back, "trends").collect()] == [("t1", ["a", "b"]), ("t2", [])]
    less = S.reproject(back, columns.where("id = 'x'").withColumn("name", F.lit("New")))
    assert [r.id for r in S.part(less, "items").collect()] == ["a", "b"] and [r.term for r in S.part(less, "trends").collect()] == ["t1"]
    assert [tuple(r) for r in S.part(less, "columns").collect()] == [("x", "New")]


def test_gate_and_version(spark, tmp_path):
    items, *rest = tables(spark)
    path = f"file://{tmp_path}/page"
    assert S.publish(S.build(items, *rest, "v1"), path, least=3) == "written"
    assert S.publish(S.build(items.where("id = 'a'"), *rest, "v1"), path, least=1) == "unchanged"
    with pytest.raises(ValueError):
        S.publish(S.build(items.where("id = 'a'"), *rest, "v2"), path, least=3)
    assert S.part(S.read(spark, path), "items").count() == 3
    assert S.publish(S.build(items.where("id = 'a'"), *rest, "v2"), path, least=1) == "written"
    assert S.part(S.read(spark, path), "items").count() == 1
    assert [p.name for p in tmp_path.iterdir() if "crc" not in p.name] == ["page"]


def test_empty_tables_and_broken_pages(spark, tmp_path):
    path = f"file://{tmp_path}/page"
    empty = [t.where("false") for t in tables(spark)]
    assert S.publish(S.build(*empty, "v1"), path, least=0) == "written"
    back = S.read(spark, path)
    assert back.count() == 1 and all(S.part(back, name).count() == 0 for name in ("items", "columns", "sources", "trends"))
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "a.txt").write_text('<script id="page-data">{"generatedAt": </script>')
    (tmp_path / "odd" / "b.txt").write_text("<p>")
    assert S.read(spark, f"file://{tmp_path}/odd").count() == 0
    assert spark.range(1).select(embedded_snapshot(F.lit("<p>"), S.SCHEMA).alias("s")).first().s is None
