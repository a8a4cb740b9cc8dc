"""License scans: one Aho-Corasick pass finds identifier tags and notice
phrases; a shunting-yard parser evaluates the licence expressions of the tags.

Normalising lower-cases A-Z and takes words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
A phrase is found wherever its words stand consecutively.  *Base* phrases each
have a label and every place counts.  *Notice* phrases add labels of their own;
a notice inside a longer notice gives way to it (a base phrase never does).
*Tags* (``SPDX-License-Identifier``, ``License-Expression``) open an expression
that runs to the end of the line, in the original spelling:

    expression  ids, ``and`` / ``or`` / ``with`` in any case, brackets;
                ``with`` binds closest, then ``and``, then ``or``
    labels      the families of all licences named (the id itself, lower-cased,
                when its family is unknown); an exception is no licence
    obligation  0 permissive, 1 weak copyleft, 2 copyleft, 3 unknown or closed:
                ``and`` takes the larger, ``or`` (a choice) the smaller, ``with``
                turns 2 into 1

Reading stops at the first character or token that cannot go on; the expression
is valid when what was read is complete.  An invalid one still gives the labels
of the known families it names, but no obligation.

Score: the strength of the best evidence, 1 for a valid tag, 0.5 for an invalid
one with a known family, ``1 - 2 ** -k`` for a phrase of ``k`` words, else 0.

Scale: a map over the documents where they are read, no shuffle; the phrase
table is fixed.  Work and memory are linear in a text.

Edge cases: a null text is an empty one; without words there are no places, no
labels and score 0; equal or repeated rows are each scanned on their own; whole
texts of any length are scanned; the other columns stay, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xgspark.llm._frame import free_name
from xgspark.llm.decontaminate import blanked

# FIXED VALUES: base phrases and their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# FIXED VALUES: notice phrases and their labels.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "apache software license": "apache",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "european union public licence": "eupl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "zlib license": "zlib",
    "the unlicense": "unlicense",
    "free and unencumbered software released into the public domain": "unlicense",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "all rights reserved": "reserved",
}
# Creative Commons marks by rule: "cc by nc sa 4 0" -> cc-by-nc-sa.
for _parts in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"):
    for _version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
        NOTICE_PHRASES[f"cc {_parts} {_version}"] = "cc " + _parts
NOTICE_PHRASES = {k: v.replace(" ", "-") for k, v in NOTICE_PHRASES.items()}

TAG_PHRASES = ("spdx license identifier", "license expression")

# FIXED VALUES: obligation of a licence family.
FAMILIES = {
    "mit": 0, "apache": 0, "bsd": 0, "isc": 0, "zlib": 0, "bsl": 0, "unlicense": 0, "cc0": 0, "cc-by": 0,
    "lgpl": 1, "mpl": 1, "epl": 1, "eupl": 1, "cc-by-sa": 1,
    "gpl": 2, "agpl": 2,
    "cc-by-nc": 3, "cc-by-nd": 3, "cc-by-nc-sa": 3, "cc-by-nc-nd": 3,
}
UNKNOWN = 3
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")

BASE, NOTICE, TAG = 0, 1, 2


def family(licence: str) -> tuple[str, int]:
    """(label, obligation) of a licence id: the longest known family that is
    the id or a prefix of it before a ``-``; else the id itself."""
    name = licence.lower().rstrip("+")
    parts = name.split("-")
    for k in range(len(parts), 0, -1):
        head = "-".join(parts[:k])
        if head in FAMILIES:
            return head, FAMILIES[head]
    return name, UNKNOWN


def _apply(operator: str, left, right):
    if operator == "with":       # right: the exception's name only
        return left[0], min(left[1], 1) if left[1] == 2 else left[1]
    pick = max if operator == "and" else min
    return left[0] | right[0], pick(left[1], right[1])


def evaluate(line: str) -> tuple[int, list[str], int | None]:
    """Shunting-yard evaluation of the expression at the start of ``line``:
    (characters read, sorted labels, obligation or None when invalid)."""
    values, operators, known = [], [], set()
    at, operand, depth = 0, True, 0           # operand: an operand is due

    def reduce(least: int) -> None:
        while operators and operators[-1] != "(" and _PRECEDENCE[operators[-1]] >= least:
            right, left = values.pop(), values.pop()
            values.append(_apply(operators.pop(), left, right))

    while True:
        m = _TOKEN.match(line, at)
        if not m:
            break
        token, word = m.group(1), m.group(1).lower()
        if operand:
            if token == "(":
                operators.append("(")
                depth += 1
            elif token == ")" or word in _PRECEDENCE:
                break
            else:
                exception = bool(operators) and operators[-1] == "with"
                label, rank = ("", 0) if exception else family(token)
                if not exception and label in FAMILIES:
                    known.add(label)
                values.append((frozenset([label]) if label else frozenset(), rank))
                operand = False
        elif token == ")":
            if not depth:
                break
            reduce(0)
            operators.pop()
            depth -= 1
        elif word in _PRECEDENCE:
            # "with" takes one licence, not a bracket or a licence with an exception.
            if word == "with" and (line[:at].rstrip().endswith(")") or (operators and operators[-1] == "with")):
                break
            reduce(_PRECEDENCE[word])
            operators.append(word)
            operand = True
        else:
            break
        at = m.end()
    if operand or depth:
        return at, sorted(known), None
    reduce(0)
    labels, rank = values[0]
    return at, sorted(labels), rank


def build_automaton():
    """The automaton of all phrases; a value is ``(words, [(kind, label), ...])``."""
    import ahocorasick

    owners: dict[str, list[tuple[int, str]]] = {}
    for kind, phrases in ((BASE, BASE_PHRASES), (NOTICE, NOTICE_PHRASES), (TAG, dict.fromkeys(TAG_PHRASES, ""))):
        for phrase, label in phrases.items():
            owners.setdefault(phrase, []).append((kind, label))
    a = ahocorasick.Automaton()
    for phrase, kinds in owners.items():
        a.add_word(f" {phrase} ", (phrase.count(" ") + 1, kinds))
    a.make_automaton()
    return a


def _outer(hits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The hits ``(first, last, label)`` that lie inside no longer one."""
    out, reach = [], -1
    for h in sorted(hits, key=lambda h: (h[0], -h[1])):
        if h[1] > reach:
            out.append(h)
            reach = h[1]
    return out


def scan(text: str | None, automaton) -> tuple[int, list, list]:
    """``(n_words, places, expressions)`` of one text.

    A place is ``(kind, first word, words, start, end, label)`` and an
    expression ``(start, end, text, labels, obligation)``; ``start`` and ``end``
    are code points of the original text.
    """
    blank = blanked(text)
    words = blank.split()
    if not words:
        return 0, [], []
    norm = (b" " + b" ".join(words) + b" ").decode("utf-8")
    base, notices, tags = [], [], []
    word, counted = 0, 1                       # words that end before position `counted`
    for end, (size, kinds) in automaton.iter(norm):
        word += norm.count(" ", counted, end)
        counted = end
        for kind, label in kinds:              # `word` is the phrase's last word
            (base, notices, tags)[kind].append((word - size + 1, word, label))
    if not (base or notices or tags):
        return len(words), [], []
    places = [(BASE, *p) for p in base] + [(NOTICE, *p) for p in _outer(notices)] + [(TAG, *p) for p in _outer(tags)]
    places.sort()
    # Words back to the original: bytes of the blanked text, then code points.
    raw = text.encode("utf-8")
    wanted = sorted({p[1] for p in places} | {p[2] for p in places})
    edges, code, seen, want = {}, 0, 0, iter(wanted)
    target = next(want)
    for i, m in enumerate(re.finditer(rb"[^ ]+", blank)):
        if i == target:
            code += len(raw[seen:m.start()].decode("utf-8"))
            width = len(m.group().decode("utf-8"))
            edges[i] = (code, code + width)
            code, seen = code + width, m.end()
            target = next(want, None)
            if target is None:
                break
    out, expressions = [], []
    for kind, first, last, label in places:
        start, end = edges[first][0], edges[last][1]
        out.append((kind, first, last - first + 1, start, end, label))
        if kind == TAG:
            stop = text.find("\n", end)
            line = text[end:stop if stop >= 0 else len(text)]
            skip = len(line) - len(line.lstrip(" \t:=\"'"))
            read, labels, obligation = evaluate(line[skip:])
            if labels or obligation is not None:
                a = end + skip
                expressions.append((a, a + read, text[a:a + read], labels, obligation))
    return len(words), out, expressions


PLACE = "struct<kind:int,word:long,words:int,start:long,end:long,label:string>"
EXPRESSION = "struct<start:long,end:long,text:string,labels:array<string>,obligation:int>"
SCAN_TYPE = f"n_words long, places array<{PLACE}>, expressions array<{EXPRESSION}>"


def scanned(text: Column) -> Column:
    """Column ``struct<n_words, places, expressions>`` of a text column."""
    def scan_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = build_automaton()
        for texts in batches:
            yield pd.DataFrame([scan(t, automaton) for t in texts], columns=["n_words", "places", "expressions"])

    return F.pandas_udf(scan_batches, SCAN_TYPE)(text)


def license_scan(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """All columns of the documents plus one struct column ``licenses`` (a
    longer name if taken): ``n_words``, ``places``, ``expressions``, ``labels``
    (distinct, sorted), ``base_labels``, ``score``, ``obligation`` (the largest
    of the valid expressions; null: none)."""
    name = free_name(docs, "scan")
    s = F.col(name)
    expressions = s["expressions"]
    kept = F.filter(s["places"], lambda p: p["kind"] != TAG)
    base = F.filter(s["places"], lambda p: p["kind"] == BASE)
    labels = F.array_union(F.transform(kept, lambda p: p["label"]),
                           F.flatten(F.transform(expressions, lambda e: e["labels"])))
    strength = F.concat(
        F.array(F.lit(0.0)), F.transform(kept, lambda p: F.lit(1.0) - F.pow(F.lit(2.0), -p["words"])),
        F.transform(expressions, lambda e: F.when(e["obligation"].isNotNull(), 1.0).otherwise(0.5)))
    return docs.withColumn(name, scanned(F.col(text))).withColumn(free_name(docs, "licenses"), F.struct(
        s["n_words"].alias("n_words"), s["places"].alias("places"), expressions.alias("expressions"),
        F.array_sort(F.array_distinct(labels)).alias("labels"),
        F.array_sort(F.array_distinct(F.transform(base, lambda p: p["label"]))).alias("base_labels"),
        F.array_max(strength).alias("score"),
        F.array_max(F.transform(expressions, lambda e: e["obligation"])).alias("obligation"))).drop(name)


def op13_license(spark, sf_dir) -> DataFrame:
    """Contract digest: one row per document."""
    from xgspark.sources.tables import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lic = F.col("licenses")
    starts = F.transform(F.filter(lic["places"], lambda p: p["kind"] == BASE), lambda p: p["word"])
    return license_scan(docs).select(
        "doc_id", lic["n_words"].alias("n_words"), F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(lic["base_labels"], ",").alias("base_labels"),
        F.array_join(lic["labels"], ",").alias("labels"), lic["score"].alias("score"),
        F.size(lic["expressions"]).cast("long").alias("n_expressions"), lic["obligation"].alias("obligation"))
