import re

import pytest

from tests.conftest import SF_SMALL
from xgspark.llm import license_scan as L
from xgspark.sources.tables import read_table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def base(text):
    """(n_words, sorted (start, label)) of the base phrases, word by word."""
    w = WORD.findall((text or "").translate(LOWER))
    hits = []
    for phrase, label in L.BASE_PHRASES.items():
        p = phrase.split(" ")
        hits += [(i, label) for i in range(len(w)) if w[i:i + len(p)] == p]
    return len(w), sorted(hits)


def expected(text):
    n, hits = base(text)
    starts = [h[0] for h in hits]
    return (n, len(hits), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({h[1] for h in hits})))


TEXTS = [None, "", " \t\n", "MIT License", "mit-license mit license, MIT\nLICENSE", "limit license permit licenses",
         "GNU General Public License. GNU Lesser General Public License!", "Apache License, Version 2.0",
         "Été MIT License ü APACHE license", "mit mit license license", "general public general public license",
         "mit license " * 5000, "K mit license", "x" * 100000 + " mit license"]


def test_base_columns_equal_brute_force(spark):
    docs = [r.text for r in read_table(spark, SF_SMALL, "documents").select("text").collect()]
    automaton = L.build_automaton()
    found = 0
    for t in TEXTS + docs:
        n, places, _ = L.scan(t, automaton)
        starts = [p[1] for p in places if p[0] == L.BASE]
        got = (n, len(starts), min(starts, default=None), max(starts, default=None),
               ",".join(sorted({p[5] for p in places if p[0] == L.BASE})))
        assert got == expected(t)
        found += len(starts)
    assert found > 5000


def test_query_equals_brute_force_on_the_whole_table(spark):
    texts = {r.doc_id: r.text for r in read_table(spark, SF_SMALL, "documents").collect()}
    rows = L.op13_license(spark, SF_SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == expected(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert any("cc-by-nc" in r.labels for r in rows)


@pytest.mark.parametrize("line,labels,obligation", [
    ("MIT", ["mit"], 0),
    ("GPL-2.0-or-later", ["gpl"], 2),
    ("GPL-2.0+ WITH Classpath-exception-2.0", ["gpl"], 1),
    ("MIT OR GPL-3.0-only", ["gpl", "mit"], 0),
    ("MIT AND GPL-3.0-only", ["gpl", "mit"], 2),
    ("MIT OR GPL-3.0-only AND LGPL-2.1", ["gpl", "lgpl", "mit"], 0),          # and binds closer
    ("(MIT OR GPL-3.0-only) AND LGPL-2.1", ["gpl", "lgpl", "mit"], 1),
    ("mit and gpl-2.0 with GCC-exception-3.1 or AGPL-3.0 */", ["agpl", "gpl", "mit"], 1),
    ("((BSD-3-Clause))", ["bsd"], 0),
    ("LicenseRef-Acme or MIT", ["licenseref-acme", "mit"], 0),
    ("MIT AND LicenseRef-Acme", ["licenseref-acme", "mit"], 3),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa"], 3),
    ("MIT AND", ["mit"], None), ("(MIT", ["mit"], None), ("OR MIT", [], None), ("", [], None),
    ("some words", ["some"], 3),                                               # reading stops at the second word
    ("MIT) AND GPL-2.0", ["mit"], 0), ("MIT WITH a WITH b", ["mit"], 0), ("(MIT) WITH a", ["mit"], 0),
])
def test_expressions(line, labels, obligation):
    assert L.evaluate(line)[1:] == (labels, obligation)


def test_obligation_equals_evaluating_by_substitution():
    import itertools
    ids = {"MIT": 0, "MPL-2.0": 1, "GPL-2.0": 2}
    for a, b, c, d in itertools.product(ids, repeat=4):
        for x, y, z in itertools.product(("and", "or"), repeat=3):
            for form in ("{a} {x} {b} {y} {c} {z} {d}", "({a} {x} {b}) {y} ({c} {z} {d})", "{a} {x} ({b} {y} {c}) {z} {d}"):
                text = form.format(a=a, b=b, c=c, d=d, x=x, y=y, z=z)
                # In Python, & binds closer than |: all licences as permissive ...: min / max by level.
                levels = [eval(re.sub(r"[A-Z][A-Z0-9.-]+", lambda m: str(ids[m.group()] <= k), text)) for k in range(3)]
                assert L.evaluate(text)[2] == levels.index(True)


def test_spans_and_expressions_point_into_the_text(spark):
    text = "é\n// SPDX-License-Identifier: (MIT OR Apache-2.0) -->\nü Licensed under the Apache License, Version 2.0.\n" \
           "License-Expression: \nAll Rights Reserved"
    _, places, expressions = L.scan(text, L.build_automaton())
    assert [text[s:e] for _, _, _, s, e, _ in places] == [
        "Apache License", "Licensed under the Apache License, Version 2.0", "All Rights Reserved",
        "SPDX-License-Identifier", "License-Expression"]
    assert [(e[2], e[3], e[4]) for e in expressions] == [("(MIT OR Apache-2.0)", ["apache", "mit"], 0)]


def test_inner_notices_give_way_to_longer_ones():
    a = L.build_automaton()
    labels = {p[5] for p in L.scan("GNU Lesser General Public License", a)[1]}
    assert labels == {"gpl", "lgpl"}           # a base phrase always counts
    assert {p[5] for p in L.scan("licensed under CC BY-NC-SA 4.0, not CC BY", a)[1]} == {"cc-by-nc-sa"}


def test_odd_tables(spark, odd_docs, no_docs):
    got = L.license_scan(odd_docs.withColumnRenamed("k", "licenses"))
    assert got.columns[-1] == "licenses_" and got.count() == odd_docs.count()
    for r in got.collect():
        assert (r.licenses_.n_words, r.licenses_.score) == (expected(r.text)[0], 0.0)
    assert L.license_scan(no_docs).count() == 0
