import math
import random
import re
from collections import Counter

from headwater.llm import license_scan as ls

WORDS = "river stone the under license version public is free all mit general software notice copy".split()


def brute_own(text, least=ls.LEAST):
    rows = [(n, k, Counter(ls._words(t))) for k, g in (("header", ls.HEADERS), ("file", ls.FILES)) for n, ts in g.items() for t in ts]
    df = Counter(w for *_, c in rows for w in c)
    idf = lambda w: math.log((1 + len(rows)) / (1 + df[w])) + 1
    best = []
    text = (text or "").lower()
    units = [("header", u) for u in re.split(ls.UNIT_END, text) + re.split(ls.PARAGRAPH_END, text)] + [("file", text)]
    for kind, u in units:
        c = Counter(ls._words(u))
        norm = math.sqrt(sum((k * idf(w)) ** 2 if w in df else k * idf(w) ** 2 for w, k in c.items()))
        for name, own, t in rows:
            if own == kind and norm:
                dot = sum(c[w] * idf(w) * t[w] * idf(w) for w in t)
                score = round(dot / norm / math.sqrt(sum((k * idf(w)) ** 2 for w, k in t.items())), 9)
                if score >= least:
                    best.append((name in ls.RESERVED, -score, name))
    return (min(best)[2], -min(best)[1]) if best else (None, None)


def brute(rows):
    own = [brute_own(t) for _, _, t in rows]
    folders = {}
    for (i, p, t), (name, score) in zip(rows, own):
        if p is not None and name and re.match(ls.LICENCE_NAME, p.rsplit("/", 1)[-1]):
            d = p.rsplit("/", 1)[0] if "/" in p else ""
            folders[d] = min(folders.get(d, (9, "", "")), (-score, name, p))
    out = []
    for (i, p, t), (name, score) in zip(rows, own):
        near = None
        if p is not None and not name:
            d = p.rsplit("/", 1)[0] if "/" in p else ""
            while True:
                if d in folders:
                    near = folders[d]
                    break
                if not d:
                    break
                d = d.rsplit("/", 1)[0] if "/" in d else ""
        out.append((i, p, name, score, name or (near and near[1]), near and near[2]))
    return out


def fixture():
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    notices = [t for g in ls.HEADERS.values() for t in g]
    rows = [(1, "LICENSE", ls.FILES["MIT"][0]), (2, "a.txt", None), (3, "x/y/z/b.txt", ""), (4, None, "Released under the MIT License."), (5, "x/COPYING", "Released under the MIT licence"), (6, "x/License.md", "Licensed under CC BY 4.0."), (7, "x/y/c.txt", say(3)), (8, "deep/er/d.txt", say(9000)), (8, "deep/er/d.txt", "Licensed under the Apache License, Version 2.0. And more")]
    for k in range(120):
        text = say(rng.randint(0, 12)) + rng.choice(["\n", ". ", " "]) + rng.choice(notices + [say(6)] * 8) + rng.choice(["\n", " "]) + say(rng.randint(0, 6))
        rows.append((20 + k, f"p{k % 4}/q{k % 3}/{'LICENSE' if k % 11 == 0 else k}.txt", text))
    return rows


def test_brute_force(spark):
    rows = fixture()
    files = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, path string, text string, licence string")
    got = ls.scan(files)
    assert got.columns == ["doc_id", "path", "licence", "own_licence", "own_score", "_licence", "inherited_from"] or "_licence" in got.columns
    found = [(r.doc_id, r.path, r.own_licence, r.own_score, r["_licence"], r.inherited_from) for r in got.collect()]
    assert sorted(found, key=str) == sorted(brute(rows), key=str)
    assert sum(r[2] is not None for r in found) > 20 and sum(r[5] is not None for r in found) > 20


def test_empty_and_native(spark):
    files = spark.createDataFrame([], "doc_id long, path string, text string")
    got = ls.scan(files)
    assert got.count() == 0
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())


def test_whole_licences_and_usual_notices(spark):
    head = "Copyright (c) 2020, Some Body\nAll rights reserved.\n\n"
    gpl = """/*
 * tool - does things
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful.
 */
int main;"""
    gpl_file = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy.\n\n" + "\n\n".join(f"Section {k}. Terms and conditions of the work apply." for k in range(300))
    apache = "#!/bin/sh\n#\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#     http://www.apache.org/licenses/LICENSE-2.0\n\nexec x"
    texts = {"BSD-3-Clause": head + ls._BSD.replace("2. ", "\n2. ") + "\n\n" + ls._BSD_THIRD + "\n\n" + ls._BSD_AS_IS, "GPL-3.0": gpl, "Apache-2.0": apache, "Proprietary": head + "No part may be used."}
    texts |= {name: f"{head}{group[0]}" for name, group in ls.FILES.items() if name != "BSD-3-Clause"}
    rows = [(f"{name}/src/{k}", t) for k, (name, t) in enumerate(texts.items())] + [("GPL-3.0/COPYING", gpl_file), ("BSD-2-Clause/head", head + ls._BSD[:300])]
    got = {r.path: r.own_licence for r in ls.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {p: n for p, n in got.items() if p != "BSD-2-Clause/head"} == {p: p.split("/")[0] for p, _ in rows if p != "BSD-2-Clause/head"}
    assert got["BSD-2-Clause/head"] in ("Proprietary", "BSD-2-Clause")


def test_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(ls, "MOST_BROADCAST", 0)
    test_brute_force(spark)
