import random

from pyspark.sql import functions as F

from xgspark.llm import _frame, quotes, revisits

CAPTURES = "record_id long, url string, ts long, status int, headers map<string,string>, payload string, outcome string"


def test_as_of_equals_brute_force(spark):
    rnd = random.Random(3)
    bases = [(rnd.choice("aab"), rnd.randrange(60), i * 2) for i in range(80)]
    probes = [(rnd.choice("aabc"), rnd.randrange(-5, 70), i * 2 + 1) for i in range(80)]
    b = spark.createDataFrame(bases, "k string, at long, id long")
    p = spark.createDataFrame(probes, "k string, at long, id long")
    want = {i: max(((t, j) for key, t, j in bases if key == k and (t, j) < (at, i)), default=(None, None))[1]
            for k, at, i in probes}
    for ranges in (1, 7, 4096):
        assert {r.id: r.base_id for r in _frame.as_of(p, b, ["k"], ranges).collect()} == want
    assert _frame.as_of(p.limit(0), b.limit(0), ["k"]).count() == 0


def test_position_equals_row_number(spark):
    rows = [(i % 3 if i % 5 else 0, (i * 37) % 50, i) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, at long, id long")
    for ranges in (1, 9):
        got = _frame.position(df, "k", "at", "id", ranges).collect()
        for key in (0, 1, 2):
            mine = sorted((r.at, r.id, r.position) for r in got if r.k == key)
            assert [m[2] for m in mine] == list(range(len(mine)))


def test_canonical_urls(spark):
    urls = {"HTTP://WWW.Example.com:80/A/?utm_source=x#top": "example.com/A", "https://example.com/A": "example.com/A",
            "http://a.com:443/x": "a.com:443/x", "https://a.com:80/x": "a.com:80/x", "https://a.com:443/x": "a.com/x",
            "http://a.com:80": "a.com", "http://a.com/%7Eme/a%2db%5fc%2E": "a.com/~me/a-b_c.",
            "example.com/a?b=1&utm_x=2&c=3": "example.com/a?b=1&c=3", "": "", None: None}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.c for r in df.select("url", revisits.canonical(F.col("url")).alias("c")).collect()} == urls


def test_revisit_outcomes(spark):
    h = {"ETag": '"1"', "Content-Type": "text/html", "Last-Modified": "mon"}
    rows = [
        (1, "http://x.org/a", 10, 200, h, "one", ""), (2, "https://x.org/a/", 20, 200, {**h, "ETag": '"2"'}, "two", ""),
        (3, "http://x.org/a", 15, 304, {"etag": 'W/"1"', "Cache-Control": "no", "Content-Type": "no"}, None, ""),
        (4, "http://x.org/a#f", 25, 304, {"ETAG": '"1"'}, None, ""),          # latest is "2": mismatch
        (5, "http://x.org/a", 5, 304, {"ETag": '"1"'}, None, ""),             # nothing earlier
        (6, "http://x.org/a", 30, 304, None, None, ""),                        # no validator
        (7, "http://x.org/a", 31, 304, {"Last-Modified": "tue"}, None, ""),
        (8, None, 40, 304, None, None, ""), (9, "http://x.org/a", None, 304, None, None, ""),
        (10, "http://x.org/b", 1, 200, None, None, ""), (11, "http://x.org/b", 2, 304, {"ETag": "q"}, None, ""),
        (2, "https://x.org/a/", 20, 200, {**h, "ETag": '"2"'}, "two", ""),    # a repeated record
    ]
    got = {r.record_id: r for r in revisits.resolve_revisits(spark.createDataFrame(rows, CAPTURES)).collect()}
    assert {k: (r.outcome, r.response_id, r.payload) for k, r in got.items()} == {
        3: ("resolved", 1, "one"), 4: ("validator_mismatch", 2, None), 5: ("no_earlier_response", None, None),
        6: ("resolved", 2, "two"), 7: ("validator_mismatch", 2, None), 8: ("no_earlier_response", None, None),
        9: ("no_earlier_response", None, None), 11: ("no_earlier_response", None, None)}
    assert got[3].headers == {"etag": 'W/"1"', "cache-control": "no", "content-type": "text/html", "last-modified": "mon"}
    assert got[6].headers == {"etag": '"2"', "content-type": "text/html", "last-modified": "mon"}
    assert revisits.resolve_revisits(spark.createDataFrame([], CAPTURES)).count() == 0


def test_repeated_ids_have_defined_winners(spark):
    rows = [(1, "http://x.org/b", 1, 200, {"A": "1"}, "late url", ""), (1, "http://x.org/a", 5, 200, None, "z", ""),
            (1, "http://x.org/a", 3, 200, {"A": "2"}, "y", ""), (1, "http://x.org/a", 3, 200, {"A": "1"}, "x", ""),
            (2, "http://x.org/a", 9, 304, None, None, ""), (2, "http://x.org/b", 9, 304, None, None, ""),
            (2, "http://x.org/a", 2, 304, None, None, ""), (3, "http://x.org/a", 9, 304, {"clash": "1"}, None, "")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, CAPTURES).withColumns({"id": F.lit(1), "base_id": F.lit(2), "at": F.lit("x")})
        got = {(r.record_id, r.canonical_url, r.ts): (r.outcome, r.payload) for r in revisits.resolve_revisits(df.repartition(3)).collect()}
        assert got == {(2, "x.org/a", 9): ("resolved", "x"), (2, "x.org/b", 9): ("no_earlier_response", None),
                       (2, "x.org/a", 2): ("no_earlier_response", None), (3, "x.org/a", 9): ("resolved", "x")}


def test_very_long_payloads_and_urls(spark):
    url, text = "http://x.org/" + "a" * 200_000, "b" * 2_000_000
    df = spark.createDataFrame([(1, url, 1, 200, None, text, ""), (2, url, 2, 304, None, None, "")], CAPTURES)
    r = revisits.resolve_revisits(df).first()
    assert (r.outcome, r.payload, len(r.canonical_url)) == ("resolved", text, 200_006)


def test_far_off_times_stretch_no_range(spark):
    df = spark.createDataFrame([(-(1 << 62),)] * 5 + [(i,) for i in range(1000)], "at long")
    sizes = [r["count"] for r in df.groupBy(_frame.cut_ranges(df, "at", 16).alias("r")).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 100
    cut = df.select("at", _frame.cut_ranges(df, "at", 16).alias("r")).distinct().orderBy("at").collect()
    assert [c.r for c in cut] == sorted(c.r for c in cut)


def mails(spark, bodies, sent=None):
    rows = [(i, sent[i] if sent else i * 10, b, "x") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "message_id long, sent long, body string, text string")


def test_nested_quotes_and_levels(spark):
    body = "On Monday A wrote:\n> > deep\n> first  LINE\n> second\nmy answer\n\n>> two\n> three\nend\n"
    r = spark.createDataFrame([(body,), (None,), ("",)], "b string").select(quotes.passages(F.col("b")).alias("p")).collect()
    assert [(x.level, x.text) for x in r[0].p] == [(0, ""), (2, "deep"), (1, "first  LINE\nsecond"), (0, "my answer\n"),
                                                   (2, "two"), (1, "three"), (0, "end\n")]
    assert [(x.level, x.text) for x in r[1].p] == [(0, "")] == [(x.level, x.text) for x in r[2].p]


def test_conversations_in_reply_order(spark):
    bodies = ["Hello\nall", "> hello ALL\nHi back", "> Hi back\n\nThird", "> > hello all\n> Hi back\nAside",
              "unrelated", "> nobody said this\nlost", None, "", "> Third\nfourth", "Hello all", "> hello all\nlate"]
    got = {r.message_id: r for r in quotes.conversations(mails(spark, bodies)).collect()}
    assert {k: (r.parent_id, r.conversation_id, r.depth) for k, r in got.items()} == {
        0: (None, 0, 0), 1: (0, 0, 1), 2: (1, 0, 2), 3: (1, 0, 2), 4: (None, 4, 0), 5: (None, 5, 0), 6: (None, 6, 0),
        7: (None, 7, 0), 8: (2, 0, 3), 9: (None, 9, 0), 10: (9, 9, 1)}     # the latest earlier of equal texts
    assert [got[k].position for k in (0, 1, 2, 3, 8)] == [0, 1, 2, 3, 4]
    assert got[3].text == "Aside" and got[2].text == "Third" and got[6].text == ""
    assert all(">" not in r.text for r in got.values())


def test_equal_times_long_chains_and_repeats(spark):
    bodies = ["m0"] + [f"> m{i}\nm{i + 1}" for i in range(40)]
    df = mails(spark, bodies)
    got = quotes.conversations(df.unionByName(df)).collect()
    assert len(got) == 41 and all((r.conversation_id, r.depth, r.position) == (0, r.message_id, r.message_id) for r in got)
    same = quotes.conversations(mails(spark, ["a b", "> a b\nc", "> c\nd"], [5, 5, 5])).collect()
    assert sorted((r.message_id, r.parent_id) for r in same if r.parent_id is not None) == [(1, 0), (2, 1)]
    assert quotes.conversations(df.limit(0)).count() == 0


def test_common_passage_makes_no_pairs(spark):
    bodies = ["hello"] * 300 + ["> hello\nyes"] * 300
    got = quotes.conversations(mails(spark, bodies)).collect()
    assert len(got) == 600 and {r.parent_id for r in got if r.message_id >= 300} == {299}


def test_very_long_bodies(spark):
    lines = [("> " * (i // 7 % 3)) + f"line {i}" for i in range(30_000)]
    got = quotes.conversations(mails(spark, ["\n".join(lines), "short"])).collect()
    assert len(got) == 2 and max(len(r.text) for r in got) > 50_000


TURNS = "conv_id long, turn long, role string, text string"


def test_conversations_of_thousands_of_turns_lose_no_mail(spark):
    rows = [(c, t, "user", f"mail {c} {t}") for c, n in ((0, 3000), (1, 40), (2, 2100), (-1, 3)) for t in range(n)]
    view = quotes.mail_view(spark.createDataFrame(rows, TURNS))
    assert view.select("message_id").distinct().count() == len(rows)
    got = {r.text: r for r in quotes.conversations(view).collect()}
    assert len(got) == len(rows)
    for c, t, _, text in rows:
        r = got[text]
        assert r.depth == r.position == t and r.conversation_id == got[f"mail {c} 0"].message_id
        assert r.parent_id == (got[f"mail {c} {t - 1}"].message_id if t else None)


def test_mail_view_keeps_every_distinct_row(spark):
    rows = [(0, 0, "user", "a"), (0, 0, "user", "b"), (0, 0, "bot", "b"), (0, 0, "user", "b"), (0, 1, "bot", "c"),
            (0, 1, "bot", None), (None, 0, "user", "d"), (0, None, "user", "e"), (None, None, None, None)]
    got = quotes.conversations(quotes.mail_view(spark.createDataFrame(rows, TURNS))).collect()
    assert sorted(r.text for r in got) == ["", "", "a", "b", "b", "c", "d", "e"]
    by = {r.message_id: r for r in got}
    first = by[min(k for k in by if k.startswith("0.0."))].text           # of one turn, the smallest id is quoted
    assert {r.text: by[r.parent_id].text for r in got if r.parent_id is not None} == {"c": first, "": first}


def test_unrelated_rows_change_no_id_and_no_link(spark):
    rows = [(0, 1024, "user", "a"), (0, 1025, "bot", "b"), (1, 0, "user", "c"), (1, 1, "bot", "d"), (None, 3, None, "e")]
    more = [(9, 1024, "user", "x"), (2, 0, None, "y"), (2, 0, "", "y"), (1 << 60, 5, "user", "z"), (None, None, "user", None)]

    def of(t):
        return {r.text: (r.message_id, r.conversation_id, r.parent_id, r.depth)
                for r in quotes.conversations(quotes.mail_view(spark.createDataFrame(t, TURNS))).collect()}

    alone, among = of(rows), of(rows + more)
    assert alone == {k: v for k, v in among.items() if k in alone} and len(alone) == 5
    assert quotes.mail_view(spark.createDataFrame(rows + more, TURNS)).select("message_id").distinct().count() == 10
    assert quotes.mail_view(spark.createDataFrame([], TURNS)).count() == 0


def test_extra_columns_with_clashing_names(spark):
    names = ("hash", "at", "id", "text", "level", "quoted", "parts", "base_id", "parent_id", "root_id", "position", "depth")
    df = mails(spark, ["hello there\nall", "> hello there\n> all\nyes", None]).drop("text")
    plain = sorted(map(str, quotes.conversations(df).collect()))
    assert sorted(map(str, quotes.conversations(df.withColumns({n: F.lit("x") for n in names})).collect())) == plain


def test_quotes_in_part_between_lines_and_of_absent_parents(spark):
    first = "Dear all,\nthe pump is broken\nand the valve leaks\n\nShall we order a new one?\n\nRegards"
    bodies = [first, "Dear all,\nlunch is at noon", "> Shall we order  a new one?\nYes",                 # a paragraph
              "> Dear all,\n> the pump is broken\nsince when?\n> and the valve leaks\nno",              # between lines
              "> > the valve was fine\n> It was never seen here\nnew",                                   # nothing known
              "> a mail that is not here\n> > Yes\n> > > Dear all,\nso",                                # the grandparent
              "> since when?\n> \n> no\nyesterday", "> > since when?\nlate", "> unknown\n> Dear all,\nhm"]
    got = {r.message_id: r for r in quotes.conversations(mails(spark, bodies)).collect()}
    assert {k: r.parent_id for k, r in got.items()} == {
        0: None, 1: None, 2: 0, 3: 0, 4: None, 5: 2, 6: 3, 7: 3, 8: 1}
    assert {k: r.conversation_id for k, r in got.items()} == {0: 0, 1: 1, 2: 0, 3: 0, 4: 4, 5: 0, 6: 0, 7: 0, 8: 1}
