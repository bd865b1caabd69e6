from collections import Counter

import duckdb

from headwater.llm import line_dedup

SCHEMA = "doc_id long, text string, source string, bp_host int"


def rows():
    out = [(i, f"Menu\nbody {i}\nMenu\n\nfoot {i % 7}", "a", 1) for i in range(40)]
    out += [(100 + i, f"Menu\nline {i}", "b", 2) for i in range(2)] + [(200 + i, "All gone", None, 3) for i in range(5)]
    return out + [(300, None, "a", 4), (300, None, "a", 4), (301, "", "a", 5), (None, "Menu\r", "a", 6), (302, "x\n" * 20000, "c", 7)]


def brute(rows, ratio=0.1, least=3):
    n, total = Counter(), Counter()
    for _, t, h, _ in rows:
        total[h or ""] += 1
        for line in set((t or "").split("\n")):
            if line.strip(" \t\r"):
                n[h or "", line] += 1
    drop = {k for k, c in n.items() if c >= least and c / total[k[0]] > ratio}
    out = []
    for d, t, h, x in rows:
        lines = t.split("\n") if t is not None else []
        keep = [line for line in lines if ((h or ""), line) not in drop]
        out.append((d, "\n".join(keep) if t is not None else None, h, x, len(lines), len(lines) - len(keep)))
    return out


def test_brute_force(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = [tuple(r) for r in line_dedup.drop_boilerplate(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows()), key=str)


def test_shuffled_way_is_the_same(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST", 0)
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = [tuple(r) for r in line_dedup.drop_boilerplate(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows()), key=str)


def test_sql(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = line_dedup.drop_boilerplate(docs).select("doc_id", "text", "n_lines", "n_dropped").collect()
    con = duckdb.connect()
    documents = docs.toArrow()  # noqa: F841
    want = con.sql(line_dedup.SQL).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty(spark):
    assert line_dedup.drop_boilerplate(spark.createDataFrame([], SCHEMA)).count() == 0
