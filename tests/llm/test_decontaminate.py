import hashlib
import re

from tests.conftest import SF_SMALL
from xgspark.llm import decontaminate
from xgspark.sources.tables import read_table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = WORD.findall(low(t))
        for a in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[a:a + n]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w = WORD.findall(low(t))
        hit, ids = set(), set()
        for size in sizes:
            for a in range(len(w) - size + 1):
                found = windows.get(tuple(w[a:a + size]))
                if found:
                    hit.update(range(a, a + size))
                    ids |= found
        joined = ",".join(sorted(map(str, ids)))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return out


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in read_table(spark, SF_SMALL, "documents").collect()]
    items = [(r.item_id, r.text) for r in read_table(spark, SF_SMALL, "benchmark").collect()]
    got = [tuple(r) for r in decontaminate.op7_decontaminate(spark, SF_SMALL).collect()]
    assert sorted(got) == sorted(brute(docs, items)) and any(r[5] for r in got)


def make(spark, items, texts):
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, h string")
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, h string")
    return d, b


def test_short_overlapping_and_odd_items(spark):
    items = [(1, "Alpha-beta GAMMA"), (2, " ".join(f"q{i}" for i in range(14))), (3, None), (4, "!!"), (5, "alpha beta gamma"),
             (10, "über straße"), (None, "omega one")]
    texts = [None, "", "--", "alpha... BETA\n\ngamma", "alphabeta gamma", "x " + " ".join(f"Q{i}" for i in range(3, 14)) + " y",
             "Alpha beta gamma alpha beta gamma", "zu über, Straße", "ÜBER straße", "omega  one", "q1 q2"]
    d, b = make(spark, items, texts)
    for limit in (decontaminate.MAX_WINDOWS, 2):                      # one automaton, several
        check_odd_items(d, b, texts, items, limit)


def check_odd_items(d, b, texts, items, limit):
    marked = decontaminate.mark_hits(d, b, max_windows=limit)
    hit = marked.withColumnRenamed("hits", "r").orderBy("doc_id").collect()
    want = brute([(i, t) for i, t in enumerate(texts)], [(i if i is not None else "", t) for i, t in items])
    assert [(r.r.n_words, r.r.n_hit, len(r.r.item_ids)) for r in hit] == [(w[1], w[2], w[3]) for w in want]
    assert hit[3].r.item_ids == ["1", "5"]
    # spans point into the original text
    assert [hit[3].text[s.start:s.end] for s in hit[3].r.spans] == ["alpha... BETA\n\ngamma"]
    assert [hit[7].text[s.start:s.end] for s in hit[7].r.spans] == ["über, Straße"]
    clean = decontaminate.decontaminate(d, b, max_windows=limit)
    assert clean.columns == d.columns and sorted(r.doc_id for r in clean.collect()) == [0, 1, 2, 4, 8, 10]


def test_empty_and_odd_tables(spark, odd_docs, no_docs):
    _, none = make(spark, [], [])
    _, one = make(spark, [(1, "w1 w2")], [])
    assert decontaminate.decontaminate(odd_docs, none).count() == odd_docs.count()
    assert decontaminate.decontaminate(no_docs, one).count() == 0
    named = odd_docs.withColumnRenamed("k", "hits").withColumnRenamed("size", "row")
    for limit in (decontaminate.MAX_WINDOWS, 1):
        _, two = make(spark, [(1, "w1 w2"), (2, "w3")], [])
        marked = decontaminate.mark_hits(named, two, max_windows=limit)
        assert marked.columns == [*named.columns, "hits_"] and marked.count() == odd_docs.count()
        want = brute([(0, r.text) for r in odd_docs.collect()], [(1, "w1 w2"), (2, "w3")])
        assert sorted((r.hits_.n_words, r.hits_.n_hit) for r in marked.collect()) == sorted((w[1], w[2]) for w in want)
        assert any(r.hits_.n_hit for r in marked.collect())


def test_an_automaton_is_bounded_and_the_result_the_same(spark, monkeypatch):
    """However large the benchmark, no automaton has more windows than the bound."""
    docs, items = read_table(spark, SF_SMALL, "documents").select("doc_id", "text"), read_table(spark, SF_SMALL, "benchmark")
    built = []
    share = decontaminate._shared
    monkeypatch.setattr(decontaminate, "_shared", lambda spark, w: built.append(w.count()) or share(spark, w))
    one = sorted(map(str, decontaminate.mark_hits(docs, items).collect()))
    n = built.pop()
    many = sorted(map(str, decontaminate.mark_hits(docs, items, max_windows=n // 4).collect()))
    assert many == one and len(built) > 4 and max(built) <= n // 4 and sum(built) == n


def test_a_node_is_a_word():
    windows = [(" ".join(f"word{i + k:07d}" for k in range(10)), ["1"]) for i in range(2000)]
    matcher = decontaminate.Matcher(windows)
    assert matcher.automaton.get_stats()["nodes_count"] <= 10 * len(windows) + 1


def test_very_long_text(spark):
    d, b = make(spark, [(1, "needle in the hay")], ["hay " * 300_000 + "needle in the hay " + "é" * 5])
    r = decontaminate.mark_hits(d, b).withColumnRenamed("hits", "r").first()
    assert (r.r.n_words, r.r.n_hit) == (300_005, 4) and r.text[r.r.spans[0].start:r.r.spans[0].end] == "needle in the hay"
