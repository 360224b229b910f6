import math

from tidemark.llm import licenses


def brute(rows):
    texts = [t or "" for _, t, _ in rows]
    df = {v: sum(v in licenses.terms_of(t) for t in texts) for v in licenses.VOCABULARY}
    idf = lambda t: math.log((1 + len(rows)) / (1 + df.get(t, 0))) + 1
    vec = lambda ts: {t: ts.count(t) * idf(t) for t in set(ts)}

    def cos(a, b):
        size = math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))
        return round(sum(w * b.get(t, 0) for t, w in a.items()) / size, 6)

    own, given = {}, {}
    for k, (_, t, p) in enumerate(rows):
        found, n = [], 0
        for line in (t or "").split("\n"):
            ts = licenses.terms_of(line)
            if ts:
                best = max((cos(vec(ts), vec(licenses.terms_of(x))), name) for name, x in licenses.TEMPLATES)
                if best[0] >= licenses.LEAST:
                    found.append(best)
                    n += len(ts)
        own[k] = max(found, default=None)
        if found and p is not None and n >= licenses.FILE_SHARE * len(licenses.terms_of(t)):
            d = p.rpartition("/")[0]
            given[d] = max(given.get(d, found[0]), own[k])
    out = []
    for k, (i, _, p) in enumerate(rows):
        d, by = None, None
        if p is not None and own[k] is None:
            steps = p.split("/")[:-1]
            for n in range(len(steps), -1, -1):
                if "/".join(steps[:n]) in given:
                    by = "/".join(steps[:n])
                    d = given[by]
                    break
        got = own[k] or d
        out.append((i, p, got and got[1], got and got[0], "own" if own[k] else "inherited" if d else "none", by))
    return sorted(out, key=repr)


def test_rows_equal_brute_force(spark):
    filler = "lorem ipsum dolor sit amet " * 40
    rows = [
        (1, "Released under the MIT License.", "a/LICENSE"),
        (2, filler, "a/b/c.txt"),
        (3, filler + "\nLicensed under the Apache License, Version 2.0.", "a/b/d.txt"),
        (4, "This work is licensed under the GNU General Public License, version 3.\nsee above", "a/b/e/LICENSE"),
        (5, filler, "a/b/e/f/g"),
        (6, filler + " license plate renewal office", "x/y"),
        (7, None, "a/z"),
        (8, "", None),
        (None, "Licensed under CC BY-NC 4.0.", "LICENSE"),
        (9, filler, "q/r/s"),
        (9, filler, "q/r/s"),
        (10, "license " * 50_000, "top"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p string").withColumn("path", licenses.F.lit(0)).withColumn("own", licenses.F.lit(1))
    found = [tuple(r) for r in licenses.scan_licenses(docs, licenses.F.col("p")).collect()]
    assert sorted(found, key=repr) == brute(rows)
    assert {r[0]: r[2] for r in found}[5] == "GPL-3.0" and {r[0]: r[2] for r in found}[2] == "MIT"
    assert licenses.scan_licenses(docs.limit(0), licenses.F.col("p")).count() == 0


def test_licence_files_wrapped_and_long_lines(spark):
    filler = "lorem ipsum dolor sit amet " * 40
    texts = dict(licenses.TEXTS)
    header = "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n"
    paragraphs = "\n\n".join(" ".join(p.split()) for p in texts["MIT"].split("\n\n"))
    rows = [("wrapped/LICENSE", "Copyright (c) 2020 Some One\n\n" + texts["MIT"], "MIT"), ("wrapped/a.py", filler, "MIT"), ("paragraphs/LICENSE", paragraphs, "MIT"), ("paragraphs/a.py", filler, "MIT"), ("gpl/COPYING", header, "GPL-3.0"), ("gpl/a/b.c", filler, "GPL-3.0")]
    rows += [("long/a", filler + "Licensed under the Apache License, Version 2.0. " + filler, "Apache-2.0"), ("long/b", filler, None), ("gpl2/a", header.replace("version 3", "version 2").replace(":", ";"), "GPL-2.0")]
    rows += [(f"full-{name}/{f}", t, name) for name, text in licenses.TEXTS for f, t in (("LICENSE", text), ("x", filler))]
    docs = spark.createDataFrame([(k, t, p) for k, (p, t, _) in enumerate(rows)], "doc_id long, text string, p string")
    found = {r.path: r.license for r in licenses.scan_licenses(docs, licenses.F.col("p")).collect()}
    assert found == {p: want for p, _, want in rows}


def test_ties_and_lines_without_any_cue(spark):
    filler = "lorem ipsum dolor sit amet " * 40
    part = "modification, are permitted provided that the following conditions are met"
    rows = [(1, f"{filler}\n{part}\n{filler}", "a/x"), (2, "Released under the MIT License.", "b/LICENSE"), (3, "Released under the MIT License.", "b/COPYING"), (4, filler, "b/y")]
    common = "and lorem use in ipsum source binary dolor forms with or sit without amet " + filler  # words that tell little
    rows += [(100 + k, common, f"c/{k}") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p string")
    found = {r.doc_id: r for r in licenses.scan_licenses(docs, licenses.F.col("p")).collect()}
    assert found[1].license == "BSD-3-Clause" and found[1].origin == "own"
    assert found[4].license == "MIT" and found[4].licensed_by == "b"
