import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF_SMALL
from xgspark.llm import tokenizer_alignment as T
from xgspark.sources.tables import read_table


def vocabularies():
    with open(T.VOCABULARY_A, "rb") as a, open(T.VOCABULARY_B, "rb") as b:
        return T.Vocabularies(a.read(), b.read())


def brute(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, sha), token by token."""
    v = vocabularies()
    docs = []
    for t in texts:
        a = v.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = v.b.encode(t) if t else []
        raw = (" " + (t or "")).encode()
        if b"".join(v.bytes_a[i] for i in a) != raw or b"".join(v.bytes_b[i] for i in b) != raw:
            a, b = [], []
        spans = []
        for ids, raws in ((a, v.bytes_a), (b, v.bytes_b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(raws[i]), i))
                at += len(raws[i])
            spans.append(out)
        links, j0 = [], 0
        for s, e, i in spans[0]:
            while j0 < len(spans[1]) and spans[1][j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((i, spans[1][j][2]))
                j += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = []
        for lo, hi in zip([0, *cuts], cuts):
            side = [",".join(str(i) for s, e, i in x if lo <= s and e <= hi) for x in spans] if len(a) < 3000 else None
            groups.append(side and "|".join(side))
        docs.append((len(a), len(b), len(cuts), links, ";".join(groups) if cuts and groups[0] else ("" if not cuts else None)))
    count, most = Counter(p for d in docs for p in d[3]), defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(na, nb, g, len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links),
             None if text is None else hashlib.sha256(text.encode()).hexdigest() if text else "")
            for na, nb, g, links, text in docs]


ends = st.lists(st.integers(1, 4), min_size=1, max_size=60)


@settings(max_examples=200, deadline=None, derandomize=True)
@given(ends, ends)
def test_cuts_equal_the_common_ends(a, b):
    a, b = np.cumsum(a), np.cumsum(b)
    end = max(a[-1], b[-1]) + 1
    a, b = np.append(a, end), np.append(b, end)
    assert T.shared_cuts(a, b).tolist() == [i for i, x in enumerate(a) if x in set(b)]


def test_long_interval_without_any_cut():
    a, b = np.append(np.arange(1, 400_000, 2), 400_000), np.append(np.arange(2, 399_999, 2), 400_000)
    assert T.shared_cuts(a, b).tolist() == [len(a) - 1]


ODD = ["", None, " ", "a", "  two  spaces", "▁ is no space", "<|endoftext|> and <s> and <0x0A>", "日本語のテキスト 🙂", "é 　​",
       "tab\tand\r\nlines\n\n\n", "a" * 3000, "1234567890" * 50, "\x00 nul \x01", "the cat sat", "the cat sat", "unbelievably antidisestablishmentarianism"]


def rows(df):
    return sorted(((r.doc_id, r.alignment.n_a, r.alignment.n_b, r.alignment.n_groups, r.alignment.n_links,
                    r.alignment.n_best, r.alignment.count_sum, r.alignment.groups_sha256) for r in df.collect()), key=str)


def test_equals_brute_force_on_odd_texts(spark):
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice("abcé 1.\n日") for _ in range(rnd.randrange(1, 80))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sorted(((i, *x) for i, x in enumerate(brute(texts))), key=str)
    assert rows(T.align_documents(docs)) == want
    assert rows(T.align_documents(docs, frequent=0)) == want        # every pair by the join
    assert rows(T.align_documents(docs, frequent=40)) == want       # some of them
    groups = {r.doc_id: r.alignment.groups for r in T.align_documents(docs).collect()}
    assert all((hashlib.sha256(groups[w[0]].encode()).hexdigest() if groups[w[0]] else "") == w[-1] for w in want)


def test_query_equals_brute_force_on_the_whole_table(spark):
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()
    want = {d.doc_id: x for d, x in zip(docs, brute([d.text for d in docs]))}
    got = T.op12_alignment(spark, SF_SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    for r in got:
        w = want[r.doc_id]
        assert tuple(r)[1:7] == w[:6] and (w[6] is None or r.groups_sha256 == w[6])


def test_odd_tables(spark, odd_docs, no_docs):
    named = odd_docs.withColumnRenamed("k", "alignment").withColumnRenamed("size", "row")
    got = T.align_documents(named)
    assert got.columns == [*named.columns, "alignment_"] and got.count() == odd_docs.count()
    want = brute([r.text for r in odd_docs.collect()])
    assert sorted(r.alignment_.count_sum for r in got.collect()) == sorted(w[5] for w in want)
    assert T.align_documents(no_docs).count() == 0
