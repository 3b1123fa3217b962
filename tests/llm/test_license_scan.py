import re
import time

import numpy as np
import regex

from marlow.llm import license_scan as ls
from marlow.llm import queries


def model():
    return ls.fit(["some other words of a corpus", "more plain prose without any cue"] * 20)


def test_families_unknown_and_defined_cases(spark):
    rows = [
        (1, "Text before.\nReleased under the MIT License.\nafter"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0"), (4, "Licensed under CC BY-NC 4.0."),
        (5, "A driver's license is required for the permission."), (6, None), (7, ""), (8, "no cue at all\n\n \t"), (1, "Text before.\nReleased under the MIT License.\nafter"), (9, "word " * 20_000 + "under the terms of the GNU Lesser General Public License version 2.1 " + "word " * 20_000), (None, "SPDX-License-Identifier: MPL-2.0"),
    ]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, family int")
    found = ls.scan(df, model()).collect()
    got = {r.doc_id: r for r in found}
    assert {d: r.family for d, r in got.items()} == {1: "mit", 2: "gpl", 3: "apache", 4: "cc-nc", 9: "lgpl", None: "mpl"} and len(found) == 7
    assert got[1].paragraph == 1 and all(0 <= r.probability <= 1 for r in got.values())
    assert ls.scan(df.limit(0), model()).count() == 0 and ls.sample(df.limit(0)) == []


def test_every_paragraph_is_scored(spark):
    lines = {
        "Text available under CC BY-SA 4.0.": "cc", "This work is under a Creative Commons Attribution 4.0 International deed": "cc", "Released under MIT": "mit", "Apache-2.0": "apache", "GPLv3 or later": "gpl",
        "Distributed under the terms of the GPL, version 3": "gpl", "Code: MPL-2.0": "mpl", "Distributed under the terms of the GNU GPLv3": "gpl",
    }
    texts = [*lines, "under the sun by the sea", "a file for any person", "the version of the software that was released"]
    rows = ls.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model()).collect()
    assert {texts[r.doc_id]: r.family for r in rows if r.family != ls.UNKNOWN} == lines and all(r.family == ls.UNKNOWN or texts[r.doc_id] in lines for r in rows)


def test_words_of_a_statement_in_another_order_confirm_nothing(spark):
    texts = ["The professor at MIT described, in the 1994 lecture on surgery, how the state licensed the hospital", "the CC report says 4.0 percent of apache helicopters are licensed by 2.0 agencies", "MIT licensed", "under MIT it was released"]
    rows = ls.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model()).collect()
    assert {r.doc_id: r.family for r in rows if r.family != ls.UNKNOWN} == {2: "mit"}


def plain(docs, m):
    """The whole query in plain Python: paragraphs, scores, the best statement."""
    out = []
    for i, text in docs:
        for n, p in enumerate(regex.sub(ls.WRAP.replace(r"\A", "^"), " ", text).split("\n") if text is not None else []):
            z = m.bias + sum((m.weights[m.features.index(f)] for f in ls.features_of(p) if f in m.features), np.zeros(len(m.bias)))
            prob = ls._softmax((z / m.temperature)[None])[0]
            k = int(z.argmax())
            if m.families[k] != ls.UNKNOWN:
                covered, statement = max((ls.cover(p, s), s) for s in ls.STATEMENTS[m.families[k]])
                out.append((i, n, m.families[k] if covered >= ls.COVERED else ls.UNKNOWN, round(float(prob.max()), 4), m.families[k], statement, round(covered, 4)))
    return sorted(out)


def test_query_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], ls.fit(ls.sample(docs)))
    got = sorted((r.doc_id, r.paragraph, r.family, round(r.probability, 4), r.predicted, r.statement, round(r.covered, 4)) for r in queries.op7_license_scan(spark, sf).collect())
    assert want and len(got) == len(want)
    for a, b in zip(got, want):
        assert (*a[:3], *a[4:6]) == (*b[:3], *b[4:6]) and abs(a[3] - b[3]) < 2e-4 and abs(a[6] - b[6]) < 2e-4


def test_wrapped_notices_are_one_paragraph(spark):
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    text = "A title\n\n" + isc + "\nThe next sentence is a paragraph of its own, as the line before it ends one."
    (r,) = ls.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), model()).collect()
    assert (r.paragraph, r.family, r.text) == (2, "isc", isc.replace("\n", " "))


def test_sample_is_bounded(spark):
    df = spark.range(2000).selectExpr("5L as doc_id", "repeat('word of a text ', 5000) as text")
    found = ls.sample(df, 30)
    assert len(found) == 30 and max(map(len, found)) <= ls.PARAGRAPH_CHARS


def test_time_grows_with_the_length(spark):
    m, took = model(), []
    for n in (40_000, 160_000):
        df = spark.createDataFrame([(1, " ".join(f"w{i} the" for i in range(n // 2)) + " released under the ISC license")], "doc_id long, text string")
        ls.scan(df, m).count()
        began = time.perf_counter()
        assert ls.scan(df, m).first().family == "isc"
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 2


def test_scores_against_plain_python(spark):
    m = ls.fit(["plain prose"] * 10)
    text = "The software is released under the ISC License with permission, see below."
    r = ls.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), m).first()
    z = m.bias + sum(m.weights[m.features.index(f)] for f in ls.features_of(text) if f in m.features)
    p = ls._softmax((z / m.temperature)[None])[0]
    assert r.predicted == m.families[p.argmax()] and abs(r.probability - p.max()) < 1e-5


def test_native_plan(spark, sf):
    df = queries.op7_license_scan(spark, sf)
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


def test_query_finds_the_planted_lines(spark, sf):
    want = {"GNU General": "gpl", "CC BY-NC": "cc-nc", "MIT License": "mit", "Apache License": "apache"}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    planted = {(d.doc_id, f) for d in docs for k, f in want.items() if k in d.text}
    rows = queries.op7_license_scan(spark, sf).collect()
    assert planted and {(r.doc_id, r.family) for r in rows if r.family != "unknown"} == planted
