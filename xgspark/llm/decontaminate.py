"""Benchmark decontamination: one Aho-Corasick automaton over the normalised
benchmark items, each document scanned once, hits mapped to the original text.

Normalising lower-cases A-Z and takes words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
(digits, letters, everything beyond ASCII).  A window is ``n`` consecutive
words of an item; an item of fewer words (but not none) is one window.  Every
distinct window is one pattern of the automaton.  It works on word numbers: a
node is a word, not a letter, and a pattern can only match whole words.

Scale: documents are scanned where they are read; no shuffle of texts.  The
distinct windows are made and counted in Spark.  Up to ``MAX_WINDOWS`` of them
(``n`` nodes each at most) make the automaton, which every worker process builds
once.  A larger benchmark is dealt by a hash of the window to as many automata
as that bound asks for; each is built, used for one pass over the documents and
given up, and the marks of the passes are put together by document.  So a worker
never holds more than one bounded automaton, and the result does not depend on
their number.

Edge cases: a null item id counts as the empty string; null and empty texts, or texts without a word, have no words and
no hits; items without a word have no window; repeated items each count;
very long texts are scanned whole; documents keep any extra columns, whatever
their names.
"""

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from xgspark.llm._frame import free_name, once_a_worker
from xgspark.session import materialize, materialize_counted

WINDOW_WORDS = 10
# Windows of one automaton: at most ten nodes each, about 160 MB a worker.
MAX_WINDOWS = 300_000
# (window, item) pairs of one automaton.
MAX_OWNERS = 4_000_000

MARKS = "array<struct<word:int,words:int>>"
HIT_TYPE = ("n_words long, n_hit long, item_ids array<string>, "
            "spans array<struct<start:int,end:int>>")

_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes(b if b in _KEEP else 0x20 for b in range(256))


def blanked(text: str | None) -> bytes:
    """The text as UTF-8 of the same length: A-Z lowered, non-word bytes blank."""
    return b"" if text is None else text.encode("utf-8").lower().translate(_TABLE)


def text_words(text: str | None) -> list[bytes]:
    return blanked(text).split()


def item_windows(text: str | None, n: int) -> set[str]:
    """The windows of one benchmark item, each as its words joined by blanks."""
    words = text_words(text)
    if not words:
        return set()
    return {b" ".join(words[i:i + n]).decode("utf-8") for i in range(max(1, len(words) - n + 1))}


def windows_of(benchmark: DataFrame, *, item_id: str, item_text: str, n: int) -> DataFrame:
    """``(window, item_ids)``: the distinct windows of all items."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            pairs = [(w, i) for i, t in zip(rows["i"], rows["t"]) for w in item_windows(t, n)]
            yield pd.DataFrame(pairs, columns=["window", "item_id"])

    return items.mapInPandas(cut, "window string, item_id string") \
                .groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))


class Matcher:
    """Word numbers and the automaton of a set of windows."""

    def __init__(self, windows: list[tuple[str, list[str]]]):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, item_ids in windows:
            words = window.encode("utf-8").split(b" ")
            key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words)
            self.automaton.add_word(key, (len(words), item_ids))
        self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """((first word, words) of every occurrence, sorted ids of the items)."""
        number = self.numbers.get
        marks, ids = [], set()
        for last, (size, owners) in self.automaton.iter(tuple([number(w, 0) for w in words])):
            marks.append((last - size + 1, size))
            ids.update(owners)
        return marks, sorted(ids)


def worker_matcher(shared) -> Matcher | None:
    """The matcher of a broadcast, built once in a worker process."""
    windows = shared.value
    return once_a_worker("matcher", windows["key"],
                         lambda: Matcher(windows["windows"]) if windows["windows"] else None)


def spans_of(text: str | None, words: list[bytes], marks) -> tuple[int, list[tuple[int, int]]]:
    """(hit words, their runs as code points ``[start, end)`` of the original text)."""
    step = [0] * (len(words) + 1)
    for first, size in marks:
        step[first] += 1
        step[first + size] -= 1
    depth, hit, runs = 0, 0, []
    for i in range(len(words)):
        depth += step[i]
        if depth:
            hit += 1
            if runs and runs[-1][1] == i:
                runs[-1][1] = i + 1
            else:
                runs.append([i, i + 1])
    # Words back to the original: bytes of the blanked text, then code points.
    blank, raw, edges, at, run = blanked(text), text.encode("utf-8"), [], 0, 0
    for i, w in enumerate(words):
        if run == len(runs):
            break
        at = blank.index(w, at)
        if i == runs[run][0]:
            start = at
        at += len(w)
        if i == runs[run][1] - 1:
            edges.append((start, at))
            run += 1
    spans, seen, code = [], 0, 0
    for s, e in edges:
        code += len(raw[seen:s].decode("utf-8"))
        width = len(raw[s:e].decode("utf-8"))
        spans.append((code, code + width))
        code, seen = code + width, e
    return hit, spans


def _shared(spark, windows: DataFrame):
    """A broadcast of one automaton's windows (bounded by the caller)."""
    rows = windows.collect()
    return spark.sparkContext.broadcast({"key": uuid.uuid4().hex, "windows": [(r["window"], list(r["item_ids"])) for r in rows]})


def _one_pass(docs: DataFrame, text: str, name: str, shared) -> DataFrame:
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        matcher = worker_matcher(shared)
        for texts in batches:
            rows = []
            for t in texts:
                words = text_words(t)
                marks, ids = matcher.find(words) if matcher else ([], [])
                hit, spans = spans_of(t, words, marks) if marks else (0, [])
                rows.append((len(words), hit, ids, spans))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "item_ids", "spans"])

    return docs.withColumn(name, F.pandas_udf(scan, HIT_TYPE)(F.col(text)))


def _passes(docs: DataFrame, text: str, name: str, windows: DataFrame, shards: int) -> DataFrame:
    """One pass an automaton; the marks of all passes, put together by row."""
    spark, key = docs.sparkSession, free_name(docs, "row")
    table = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "documents")
    dealt = materialize(windows.withColumn("shard", F.pmod(F.xxhash64("window"), F.lit(shards))), "windows")
    found = None
    for shard in range(shards):
        shared = _shared(spark, dealt.filter(F.col("shard") == shard))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            matcher = worker_matcher(shared)
            for rows in batches:
                out = []
                for k, t in zip(rows["k"], rows["t"]):
                    marks, ids = matcher.find(text_words(t)) if matcher else ([], [])
                    if marks:
                        out.append((k, [{"word": a, "words": b} for a, b in marks], ids))
                yield pd.DataFrame(out, columns=["k", "marks", "ids"])

        part = materialize(table.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(
            scan, f"k long, marks {MARKS}, ids array<string>"), "marks")
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    marks, ids, again = (free_name(table, n) for n in ("marks", "ids", "row_again"))
    merged = found.groupBy(F.col("k").alias(again)).agg(F.flatten(F.collect_list("marks")).alias(marks),
                                                        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias(ids))

    def finish(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, marks, ids in batches:
            rows = []
            for t, m, i in zip(texts, marks, ids):
                words = text_words(t)
                hit, spans = (0, []) if m is None else spans_of(t, words, [(x["word"], x["words"]) for x in m])
                rows.append((len(words), hit, [] if i is None else list(i), spans))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "item_ids", "spans"])

    out = table.join(merged, F.col(key) == F.col(again), "left")
    return out.withColumn(name, F.pandas_udf(finish, HIT_TYPE)(F.col(text), F.col(marks), F.col(ids))) \
              .select(*docs.columns, name)


def mark_hits(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id",
              item_text: str = "text", n: int = WINDOW_WORDS, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """All columns of the documents plus one struct column ``hits`` (a longer
    name if taken): ``n_words, n_hit, item_ids, spans``; ``spans`` are
    code-point offsets ``[start, end)`` in the original text."""
    name = free_name(docs, "hits")
    windows, count = materialize_counted(windows_of(benchmark, item_id=item_id, item_text=item_text, n=n), "windows")
    owners = windows.agg(F.sum(F.size("item_ids"))).first()[0] or 0
    shards = max(1, -(-count // max_windows), -(-owners // MAX_OWNERS))
    if shards == 1:
        return _one_pass(docs, text, name, _shared(docs.sparkSession, windows))
    # A hash deals unevenly by a little: a few automata more keep each within the bound.
    return _passes(docs, text, name, windows, shards + shards // 8 + 1)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any occurrence of a benchmark window; all columns kept."""
    marked = mark_hits(docs, benchmark, **options)
    return marked.filter(F.col(marked.columns[-1])["n_hit"] == 0).select(*docs.columns)


def op7_decontaminate(spark, sf_dir) -> DataFrame:
    """Contract digest: one row per document."""
    from xgspark.sources.tables import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.col("hits")
    return mark_hits(docs, read_table(spark, sf_dir, "benchmark")).select(
        "doc_id", h["n_words"].alias("n_words"), h["n_hit"].alias("n_hit"),
        F.size(h["item_ids"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(h["item_ids"], ","), 256).alias("items_sha256"),
        (h["n_hit"] > 0).alias("contaminated"))


def oracle_sql() -> str:
    """DuckDB SQL of the query's rows: windows of words joined by content."""
    def words(table: str, key: str) -> str:
        lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return rf"""SELECT {key}, regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}"""

    n = WINDOW_WORDS
    return rf"""
WITH items AS ({words('benchmark', 'item_id')}),
docs AS (SELECT *, row_number() OVER () AS row FROM ({words('documents', 'doc_id')})),
patterns AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, least({n}, len(w)) AS size,
         array_to_string(w[a:a + least({n}, len(w)) - 1], ' ') AS body
  FROM items, unnest(range(1, greatest(1, len(w) - {n - 1}) + 1)) AS u(a) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM patterns),
windows AS (
  SELECT row, a, size, array_to_string(w[a:a + size - 1], ' ') AS body
  FROM docs JOIN sizes ON len(w) >= size, unnest(range(1, len(w) - size + 2)) AS u(a)),
found AS (SELECT row, a, size, item FROM windows JOIN patterns USING (size, body)),
hit AS (SELECT row, count(DISTINCT i) AS n FROM found, unnest(range(a, a + size)) AS u(i) GROUP BY row),
owners AS (SELECT row, string_agg(item, ',' ORDER BY item) AS ids, count(*) AS n
           FROM (SELECT DISTINCT row, item FROM found) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(o.n, 0) AS n_items,
       sha256(coalesce(o.ids, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit h USING (row) LEFT JOIN owners o USING (row)"""
