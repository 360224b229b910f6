"""License scans: sparse TF-IDF cosine to templates, then inheritance from directories. DataFrame functions only.

Only the templates' terms (a fixed, short list) have weights of their own, so the weights travel
inside the expressions. Document frequencies of these terms are counted over all documents. Lines, windows
of a template's length (across line ends, inside long lines) and whole texts are scored within their
row. Directories' verdicts reach documents by joins on ancestor paths.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, written

#: Headers and first lines of licence files, by licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: More headers as published, compared with windows only.
HEADERS = (
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
)
#: Licence texts in full, compared with whole documents.
TEXTS = tuple((p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))
LEAST = 0.6
#: A document is a licence file if its licence passages have this share of its terms.
FILE_SHARE = 0.5


def terms_of(text: str) -> list[str]:
    return [x for x in re.split("[^a-z0-9]+", text.lower()) if x]


VOCABULARY = sorted({t for _, text in TEMPLATES for t in terms_of(text)})
PASSAGE_TERMS = sorted({t for _, text in TEMPLATES + HEADERS for t in terms_of(text)})
ALL_TERMS = sorted({t for _, text in TEMPLATES + HEADERS + TEXTS for t in terms_of(text)})


def terms(text) -> "F.Column":
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def known(passage_terms) -> "F.Column":
    """The template terms among others, each once."""
    return F.array_distinct(F.filter(passage_terms, lambda x: x.isin(ALL_TERMS)))


def document_frequencies(docs: DataFrame, text) -> tuple[int, dict[str, int]]:
    """The number of documents, and in how many of them each template term occurs: all are counted."""
    found = docs.select(F.explode(F.concat(F.array(F.lit("")), known(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+")))).alias("t"))
    counts = {t: n for t, n in found.groupBy("t").count().collect()}  # at most a row for each template term
    return counts.pop("", 0), counts


def weights(total: int, counts: dict[str, int]) -> tuple[dict[str, float], float]:
    """Inverse document frequencies of the template terms, and that of any other term."""
    import math

    idf = lambda n: math.log((1 + total) / (1 + n)) + 1
    return {t: idf(counts.get(t, 0)) for t in ALL_TERMS}, idf(0)


def unit(text: str, idf: dict[str, float]) -> dict[str, float]:
    """A template's vector, of length 1."""
    own = terms_of(text)
    vector = {t: own.count(t) * idf[t] for t in sorted(set(own))}
    size = sum(w * w for w in vector.values()) ** 0.5
    return {t: w / size for t, w in vector.items()}


def literal_terms(values) -> "F.Column":
    """An array of terms; one literal, which is split once, where the plan is made."""
    return F.split(F.lit(" ".join(values)), " ")


def literal_map(values: dict[str, float]) -> "F.Column":
    return F.map_from_arrays(literal_terms(values), literal_terms(map(repr, values.values())).cast("array<double>"))


def bound(value, fn) -> "F.Column":
    """fn(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


#: A text whose terms in common with a template have less than this of its squared length is less similar than LEAST
#: (Cauchy-Schwarz; the rest is for the rounding of similarities).
MASS = LEAST * LEAST - 1e-5


def anchors(vector: dict[str, float], idf: dict[str, float]) -> list[str]:
    """Terms of which a text has one at least if it is similar by LEAST: what the commonest others lack of MASS."""
    mass, out = 0.0, []
    for t in sorted(vector, key=lambda t: (idf[t], t)):
        mass += vector[t] ** 2
        if mass >= MASS:
            out.append(t)
    return out


def possible(present, vector: dict[str, float]) -> "F.Column":
    """Whether a text with these distinct terms can be similar by LEAST."""
    squares = literal_map({t: w * w for t, w in vector.items()})
    return F.aggregate(present, F.lit(0.0), lambda s, x: s + F.coalesce(F.element_at(squares, x), F.lit(0.0))) >= MASS


def cosine(passage_terms, vector: dict[str, float], weight, other: float) -> "F.Column":
    """Of an array of terms to a template, rounded. Terms are counted along their sorted array."""

    def of(s):
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        runs = lambda b: F.transform(b, lambda i, k: F.struct(F.element_at(s, i).alias("t"), (F.coalesce(F.get(b, k + 1), F.size(s) + 1) - i).alias("n")))
        each = bound(starts, lambda b: F.transform(runs(b), lambda x: F.struct(x["t"].alias("t"), (x["n"] * F.coalesce(F.element_at(weight, x["t"]), F.lit(other))).alias("w"))))
        return bound(each, lambda v: F.round(product(v, literal_map(vector)) / F.sqrt(F.aggregate(v, F.lit(0.0), lambda q, x: q + x["w"] * x["w"])), 6))

    return bound(F.array_sort(passage_terms), of)


def windows(a, vector: dict[str, float], name: str, length: int, idf: dict[str, float], weight, other: float) -> "F.Column":
    """Windows of a template's length in an array of terms that are similar by LEAST, as
    array<struct<similarity, license, at, to>>: at and to are the first and last place of a template term.

    Only windows with an anchor are scored, and of these only what `possible` leaves: others are not similar.
    """
    rare, own = literal_terms(anchors(vector, idf)), literal_terms(vector)
    last = F.greatest(F.size(a) - length + 1, F.lit(1))
    places = F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: F.array_contains(rare, F.element_at(a, i)))
    starts = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(F.least(last, F.greatest(p - length + 1, F.lit(1))), F.least(p, last)))))

    def score(i):
        def of(w):
            inside = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda j: F.array_contains(own, F.get(w, j)))
            row = lambda x: F.struct(cosine(w, vector, weight, other).alias("similarity"), F.lit(name).alias("license"), (i + F.get(x, F.lit(0))).alias("at"), (i + F.element_at(x, -1)).alias("to"))
            return F.when(possible(F.array_distinct(w), vector), bound(inside, row))

        return bound(F.slice(a, i, F.lit(length)), of)

    return F.filter(F.transform(starts, score), lambda x: x["similarity"] >= LEAST)


def best_of(found) -> "F.Column":
    return F.array_max(F.transform(found, lambda x: F.struct(x["similarity"].alias("similarity"), x["license"].alias("license"))))


def verdict(text, idf: dict[str, float], other: float) -> "F.Column":
    """struct<own, file> of a text, or null: own is its licence as struct<similarity, license>."""
    units = [(name, unit(t, idf), len(terms_of(t))) for name, t in TEMPLATES + HEADERS]
    wholes = [(name, unit(t, idf), len(terms_of(t))) for name, t in TEXTS]
    rare = sorted({t for _, v, _ in units + wholes for t in anchors(v, idf)})
    rare_in_lines = sorted({t for _, v, _ in units[: len(TEMPLATES)] for t in anchors(v, idf)})
    passage_weight, whole_weight = literal_map({t: idf[t] for t in PASSAGE_TERMS}), literal_map(idf)

    def of_lines():
        # a line without an anchor is not similar to any template
        lines = F.filter(F.transform(F.split(text, "\n"), lambda x: terms(x)), lambda p: F.exists(p, lambda x: x.isin(rare_in_lines)))
        scored = F.transform(lines, lambda p: F.struct(cosines(p, idf, other).alias("c"), F.size(p).alias("n")))
        return F.transform(F.filter(scored, lambda x: x["c"]["similarity"] >= LEAST), lambda x: F.struct(x["c"]["similarity"].alias("similarity"), x["c"]["license"].alias("license"), x["n"].alias("n")))

    def of(a):
        def with_present(p):
            n = F.size(a)
            none = F.array().cast("array<struct<similarity:double,license:string,at:int,to:int>>")
            inside = F.flatten(F.array(*(F.when(possible(p, v), windows(a, v, name, length, idf, passage_weight, other)).otherwise(none) for name, v, length in units)))
            # neither the document nor the licence text is FILE_SHARE of the other or less
            fits = lambda v, length: n.between(FILE_SHARE * length, length / FILE_SHARE) & F.arrays_overlap(p, literal_terms(anchors(v, idf))) & possible(p, v)
            whole = F.array(*(F.when(fits(v, length), F.struct(cosine(a, v, whole_weight, other).alias("similarity"), F.lit(name).alias("license"))) for name, v, length in wholes))
            lines = F.when(F.greatest(*(possible(p, v) for _, v, _ in units[: len(TEMPLATES)])), of_lines())

            def decide(w, x, y):
                top = F.array_max(F.filter(w, lambda z: z["similarity"] >= LEAST))
                covered = F.size(F.array_distinct(F.flatten(F.transform(x, lambda z: F.sequence(z["at"], z["to"])))))
                share = F.greatest(F.coalesce(F.aggregate(y, F.lit(0), lambda q, z: q + z["n"]), F.lit(0)), covered)
                return F.struct(F.coalesce(top, F.greatest(best_of(x), best_of(y))).alias("own"), (top.isNotNull() | (share >= FILE_SHARE * n)).alias("file"))

            return bound(whole, lambda w: bound(inside, lambda x: bound(lines, lambda y: decide(w, x, y))))

        return bound(known(a), lambda p: F.when(F.exists(p, lambda x: x.isin(rare)), with_present(p)))

    return bound(terms(text), of)


def product(vector, other) -> "F.Column":
    """Of an array of (t, w) and a map from t to w."""
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x["w"] * F.coalesce(F.element_at(other, x["t"]), F.lit(0.0)))


def cosines(passage_terms, idf: dict[str, float], other: float) -> "F.Column":
    """For an array column of terms, its best template as struct<similarity, license>."""
    weight = literal_map({t: idf[t] for t in VOCABULARY})
    times = lambda t: F.size(F.filter(passage_terms, lambda x: x == t))
    each = F.transform(F.array_distinct(passage_terms), lambda t: F.struct(t.alias("t"), (times(t) * F.coalesce(F.element_at(weight, t), F.lit(other))).alias("w")))
    norm = F.sqrt(F.aggregate(each, F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    best = [F.struct(F.round(product(each, literal_map(unit(text, idf))) / norm, 6).alias("similarity"), F.lit(name).alias("license")) for name, text in TEMPLATES]
    return F.array_max(F.array(*best))


def parent(path) -> "F.Column":
    """The directory of a path; '' at the top."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def scan_licenses(docs: DataFrame, path, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, path, license, similarity, origin, licensed_by), one row for each row of `docs`, whole texts.

    Lines, and windows of a template's length, are compared with the templates, all that can be similar
    enough; whole documents with the licence texts. The document's own licence (`own`) is the licence text it is like by
    LEAST, or else that of its best line or window, if similar by LEAST. A document like a licence text, or
    with FILE_SHARE of its terms in licence lines or windows, is a licence file. Others take the licence of
    the nearest directory above them with a licence file (`inherited`, licensed_by is that directory), or
    have none. Among equals the greatest similarity, then the last licence by name, decides. `path` is a
    column; a null path belongs to no directory. Null and empty texts have no licence of their own; a null
    id stays null; repeated rows are each answered; an empty table gives an empty table; other columns are
    not read.
    """
    text = F.col(text_col)
    total, counts = document_frequencies(docs, text)
    idf, other = weights(total, counts)
    scored = docs.select(F.col(id_col).alias("id"), path.cast("string").alias("path"), verdict(text, idf, other).alias("v")).select("id", "path", "v.own", "v.file")
    own = written(scored.withColumn("dir", parent(F.col("path"))), "licenses")

    licensed = own.where("file and own is not null and dir is not null").groupBy("dir").agg(F.max("own").alias("own"))
    # the directories of all documents, each once; then their ancestors, themselves included
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, F.lit(1), k), "/").alias("up")))
    ups = own.where("dir is not null").select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("a")).select("dir", "a.depth", "a.up")
    nearest = ups.join(licensed.select(F.col("dir").alias("up"), F.col("own").alias("given")), "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "given")).alias("near"))
    nearest = written(nearest, "directories")  # apart from the aggregation's partitions, so that a hot directory's documents are split over tasks
    out = own.join(nearest, "dir", "left")
    origin = F.when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return out.select(
        F.col("id").alias(id_col),
        "path",
        F.coalesce("own.license", "near.given.license").alias("license"),
        F.coalesce("own.similarity", "near.given.similarity").alias("similarity"),
        origin.alias("origin"),
        F.when(F.col("own").isNull(), F.col("near.up")).alias("licensed_by"),
    )


#: `documents` has no paths: a tree of source, thousand and ten by id stands in for them.
def document_path() -> "F.Column":
    step = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    return F.concat_ws("/", F.coalesce("source", F.lit("")), step(1000), step(10), F.col("doc_id").cast("string"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`scan_licenses` of all of `documents` under stand-in paths; cases as stated there."""
    return scan_licenses(table(spark, sf_dir, "documents"), document_path())


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP3_SQL = rf"""
with tpl(k, license, text) as (values {", ".join(f"({k}, {quoted(n)}, {quoted(t)})" for k, (n, t) in enumerate(TEMPLATES))}),
tt as (select k, license, t, count(*) as c from (select k, license, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from tpl) group by all),
vocab as (select distinct t from tt),
d as (select doc_id, coalesce(text, '') as text, concat_ws('/', coalesce(source, ''), doc_id // 1000, doc_id // 10, doc_id) as path, concat_ws('/', coalesce(source, ''), doc_id // 1000, doc_id // 10) as dir from documents),
total as (select count(*) as n from d),
df as (select t, count(*) as n from (select distinct doc_id, t from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as t from d) where t in (select t from vocab)) group by 1),
idf as (select t, ln((1 + total.n) / (1 + coalesce(df.n, 0))) + 1 as w from vocab left join df using (t), total),
other as (select ln(1 + n) + 1 as w from total),
tv as (select k, license, t, c * w as w from tt join idf using (t)),
tn as (select k, sqrt(sum(w * w)) as size from tv group by 1),
lines as (select doc_id, i, ln from (select doc_id, unnest(string_split(text, chr(10))) as ln, generate_subscripts(string_split(text, chr(10)), 1) as i from d)),
lt as (select doc_id, i, t, count(*) as c from (select doc_id, i, unnest(regexp_extract_all(lower(ln), '[a-z0-9]+')) as t from lines) group by all),
lv as (select doc_id, i, lt.t, c, c * coalesce(idf.w, other.w) as w from lt left join idf on idf.t = lt.t, other),
lnorm as (select doc_id, i, sqrt(sum(w * w)) as size, sum(c) as n from lv group by 1, 2),
cos as (select lv.doc_id, lv.i, tv.license, round(sum(lv.w * tv.w / tn.size) / any_value(lnorm.size), 6) as similarity, any_value(lnorm.n) as n
  from lv join tv on tv.t = lv.t join tn on tn.k = tv.k join lnorm on lnorm.doc_id = lv.doc_id and lnorm.i = lv.i group by lv.doc_id, lv.i, tv.k, tv.license),
best as (select doc_id, i, n, similarity, license from cos where similarity >= {LEAST} qualify row_number() over (partition by doc_id, i order by similarity desc, license desc) = 1),
own as (select doc_id, any_value(own_n) as n, arg_max(license, (similarity, license)) as license, max(similarity) as similarity from (select *, sum(n) over (partition by doc_id) as own_n from best) group by 1),
rows as (select d.doc_id, path, dir, own.license, own.similarity, own.n >= {FILE_SHARE} * len(regexp_extract_all(lower(text), '[a-z0-9]+')) as file from d left join own using (doc_id)),
licensed as (select dir, arg_max(license, (similarity, license)) as license, max(similarity) as similarity from rows where file and license is not null group by 1),
ups as (select dir, k as depth, array_to_string(string_split(dir, '/')[1:k], '/') as up from (select distinct dir from rows), range(0, 4) as t(k)),
near as (select ups.dir, up, license, similarity from ups join licensed on licensed.dir = up qualify row_number() over (partition by ups.dir order by depth desc) = 1)
select doc_id, path, coalesce(rows.license, near.license) as license, coalesce(rows.similarity, near.similarity) as similarity,
  case when rows.license is not null then 'own' when near.up is not null then 'inherited' else 'none' end as origin, case when rows.license is null then near.up end as licensed_by
from rows left join near on near.dir = rows.dir
"""
