"""Quotation linking: nested quote levels are parsed, quoted passages hashed in
a normal form and joined to the messages they come from, and conversations are
built in reply order, without quotes.

Messages have ``message_id`` (unique, of any type with an order), ``sent`` (long) and ``body``.  A
line's quote level is the number of ``>`` it starts with; neighbouring lines
of one level are a passage.  The normal form is lower case with runs of white
space as one blank.  A message offers its own words (level 0) as a whole,
each own passage, and their paragraphs and lines.  A quoted passage comes from
the latest earlier message that offers it as a whole (own words or passage);
else from the latest that offers it in any form; else its paragraphs, and the
lines of those that nobody offers, are looked up in the same way.  A message
replies to the message that most of its first-level quotes come from, by
characters (the latest of those alike); if none of them is found, the next
deeper level decides.
Following replies to the first message gives the conversation; a message's
position in it is its rank by ``sent``, so every reply follows its parent.

DataFrame and SQL functions only.  Scale: bodies are parsed where they are
read; only hashes, ids and times are shuffled, those of paragraphs, lines and
deeper levels only for messages with a first-level passage (or, without any, a
deeper one) that no message offers as a whole.  A passage that very many
messages quote and offer makes no pairs and no single task (:func:`as_of`),
nor does a conversation that holds much of the table (:func:`position`).  Roots
are found by pointer doubling, one join a round, each round written to the
shared folder.

Edge cases: a null body is empty: it quotes nothing and offers nothing;
passages of white space only are neither quoted nor offered; a null time sorts
first; equal texts are told apart by time, then id; messages quoting themselves
or later ones are not linked to them; repeated rows of one id count once; an
empty table gives an empty table; extra columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from xgspark.llm._frame import as_of, position
from xgspark.session import materialize, materialize_counted

QUOTE = r"^((?:[ \t]?>)*)"
ATTRIBUTION = r"(?i)^on .{1,200} wrote:[ \t]*$"
PARAGRAPH = r"\n[\x20\x09-\x0D]*\n"
MAX_ROUNDS = 64
# FIXED VALUE: the time between the first mails of two neighbouring conversations.
TURNS = 1024


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, not once an element."""
    return F.transform(F.array(value), body)[0]


def passages(body: Column) -> Column:
    """``array<struct<level, text>>``: runs of lines of one quote level, the
    quote marks and one blank behind them removed."""
    lines = F.transform(F.split(F.coalesce(body, F.lit("")), "\r?\n"), lambda line: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 1), "[ \t]", "")).alias("level"),
        F.regexp_replace(line, r"^(?:(?:[ \t]?>)+ ?)?", "").alias("text")))

    def mark(all_: Column) -> Column:
        # An attribution line right before a quote belongs to neither side.
        return F.transform(all_, lambda x, i: F.struct(
            x["level"].alias("level"), x["text"].alias("text"),
            (F.coalesce(F.get(all_, i + 1)["level"] > x["level"], F.lit(False))
             & x["text"].rlike(ATTRIBUTION)).alias("intro")))

    def runs(all_: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(all_) - 1), lambda i: (i == 0) | (
            F.get(all_, i)["level"] != F.get(all_, i - 1)["level"]))
        return _let(heads, lambda heads: F.transform(heads, lambda i, j: F.struct(
            F.get(all_, i)["level"].alias("level"),
            F.array_join(F.transform(
                F.filter(F.slice(all_, i + 1, F.coalesce(F.get(heads, j + 1), F.size(all_)) - i), lambda x: ~x["intro"]),
                lambda x: x["text"]), "\n").alias("text"))))

    return _let(_let(lines, mark), runs)


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def own_text(parts: Column) -> Column:
    """The level-0 passages, white space trimmed, joined by an empty line."""
    own = F.transform(F.filter(parts, lambda x: x["level"] == 0),
                      lambda x: F.regexp_replace(x["text"], r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    return F.array_join(F.filter(own, lambda t: t != ""), "\n\n")


def _hashes(texts: Column) -> Column:
    """Distinct ``hash, chars`` of the normal forms that hold anything."""
    return F.array_distinct(F.transform(F.filter(F.transform(texts, normal), lambda t: t != ""), lambda t: F.struct(
        F.md5(t.cast("binary")).alias("hash"), F.length(t).alias("chars"))))


def _texts(parts: Column, at_level) -> Column:
    return F.transform(F.filter(parts, lambda x: at_level(x["level"])), lambda x: x["text"])


def _pieces(quoted: DataFrame) -> DataFrame:
    """``quoted(..., run, text)`` -> the passage, its paragraphs and its lines:
    ``..., run, par, kind (0, 1, 2), hash, chars``."""
    keep = [c for c in quoted.columns if c != "text"]
    pars = quoted.select(*keep, "text", F.posexplode(F.split("text", PARAGRAPH)).alias("par", "p"))
    every = F.concat(
        F.when(F.col("par") == 0, F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")))).otherwise(F.array()),
        F.array(F.struct(F.lit(1).alias("kind"), F.col("p").alias("t"))),
        F.transform(F.split("p", "\n"), lambda x: F.struct(F.lit(2).alias("kind"), x.alias("t"))))
    units = pars.select(*keep, "par", F.explode(every).alias("u")).select(*keep, "par", "u.kind", normal(F.col("u.t")).alias("t"))
    return units.filter("t <> ''").select(*keep, "par", "kind", F.md5(F.col("t").cast("binary")).alias("hash"),
                                          F.length("t").alias("chars"))


def _partly_quoted(messages: DataFrame, rows: DataFrame, offers: DataFrame, found: DataFrame) -> DataFrame | None:
    """``id, level, chars, base_id`` of what messages quote in part or at
    deeper levels; None when every message is linked by whole passages."""
    hits = found.groupBy(F.col("id").alias("message_id")).agg(F.collect_set(F.when(F.col("base_id").isNotNull(), F.col("passage"))).alias("known"))
    left = rows.select("message_id", F.col("sent").alias("at"), "body_key", "quoted", "deep").join(hits, "message_id", "left")
    known = F.coalesce("known", F.array().cast("array<string>"))
    left = left.filter((F.size("quoted") > F.size(known)) | ((F.size("quoted") == 0) & F.col("deep"))) \
               .select("message_id", "at", "body_key", known.alias("known"))
    left, count = materialize_counted(left, "partly-quoted")
    if not count:
        return None
    bodies = messages.select("message_id", _body_key().alias("body_key"), "body").join(left, ["message_id", "body_key"]) \
                     .dropDuplicates(["message_id"])
    runs = bodies.select(F.col("message_id").alias("id"), "at", "known", F.posexplode(passages(F.col("body"))).alias("run", "part")) \
                 .select("id", "at", "run", F.col("part.level").alias("level"), F.col("part.text").alias("text"),
                         F.array_contains("known", F.md5(normal(F.col("part.text")).cast("binary"))).alias("done"))
    units = _pieces(runs.filter("level > 1 or level = 1 and not done").drop("done"))
    own = rows.select(F.col("sent").alias("at"), F.col("message_id").alias("id"), F.lit(0).alias("run"), "text")
    offered = offers.unionByName(_pieces(own).select("hash", "at", "id")).distinct() \
                    .join(units.select("hash").distinct(), "hash", "left_semi")
    got = as_of(units, offered, ["hash"])
    # A piece counts when nothing larger around it was found.
    run, par = Window.partitionBy("id", "run"), Window.partitionBy("id", "run", "par")
    found_at = F.when(F.col("base_id").isNotNull(), F.col("kind"))
    return got.withColumn("in_run", F.min(found_at).over(run)).withColumn("in_par", F.min(found_at).over(par)) \
              .filter("base_id is not null and if(in_run = 0, kind = 0, kind = in_par)").select("id", "level", "chars", "base_id")


def _body_key() -> Column:
    return F.xxhash64("sent", "body")


def reply_links(messages: DataFrame) -> DataFrame:
    """``message_id, sent, text, parent_id`` of every message; ``text`` without
    quotes."""
    # An array of one, exploded: the parse is done once, whatever is read from it.
    parsed = (messages.dropDuplicates(["message_id"])
              .select("message_id", F.coalesce("sent", F.lit(-1 << 62)).alias("sent"), _body_key().alias("body_key"),
                      F.explode(F.array(passages(F.col("body")))).alias("parts")))
    own, parts = own_text(F.col("parts")), F.col("parts")
    rows = materialize(parsed.select(
        "message_id", "sent", "body_key", own.alias("text"), _hashes(_texts(parts, lambda n: n == 1)).alias("quoted"),
        F.exists("parts", lambda x: (x["level"] > 1) & x["text"].rlike(r"[^\x20\x09-\x0D]")).alias("deep"),
        F.transform(_hashes(F.concat(F.array(own), _texts(parts, lambda n: n == 0))), lambda x: x["hash"]).alias("offered")),
        "messages")
    offers = rows.select(F.explode("offered").alias("hash"), F.col("sent").alias("at"), F.col("message_id").alias("id"))
    quotes = rows.select(F.explode("quoted").alias("q"), F.col("sent").alias("at"), F.col("message_id").alias("id")) \
                 .select("q.hash", "at", "id", "q.chars", F.col("q.hash").alias("passage"))
    found = materialize(as_of(quotes, offers, ["hash"]), "quoted")
    links = found.filter("base_id is not null").select("id", F.lit(1).alias("level"), "chars", "base_id")
    parts_of = _partly_quoted(messages, rows, offers, found)
    if parts_of is not None:
        links = links.unionByName(parts_of)
        least = links.groupBy("id").agg(F.min("level").alias("level"))
        links = links.join(least, ["id", "level"])
    order = rows.select(F.col("message_id").alias("base_id"), F.col("sent").alias("base_at"))
    parents = links.groupBy("id", "base_id").agg(F.sum("chars").alias("chars")).join(order, "base_id") \
                   .groupBy(F.col("id").alias("message_id")).agg(F.max(F.struct("chars", "base_at", "base_id")).alias("p")) \
                   .select("message_id", F.col("p.base_id").alias("parent_id"))
    return rows.select("message_id", "sent", "text").join(parents, "message_id", "left")


def _roots(links: DataFrame) -> DataFrame:
    """``message_id, root_id, depth`` by pointer doubling.  Only messages whose
    pointer has not reached a first message yet are joined again."""
    start = links.select("message_id", F.coalesce("parent_id", "message_id").alias("root_id"),
                         F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    start = materialize(start, "roots")
    done = start.filter("root_id = message_id")
    climbing = start.filter("root_id <> message_id")
    arrived = climbing.limit(0)                   # replies whose first message is known
    for _ in range(MAX_ROUNDS):
        above = arrived.unionByName(climbing).select(F.col("message_id").alias("root_id"),
                                                     F.col("root_id").alias("next"), F.col("depth").alias("more"))
        seen = materialize(climbing.join(above, "root_id", "left"), "roots-climbed")
        arrived = arrived.unionByName(seen.filter("next is null").select("message_id", "root_id", "depth"))
        climbing = seen.filter("next is not null").select(
            "message_id", F.col("next").alias("root_id"), (F.col("depth") + F.col("more")).alias("depth"))
        if climbing.isEmpty():
            return done.unionByName(arrived)
    raise RuntimeError("reply chains did not settle")


def conversations(messages: DataFrame) -> DataFrame:
    """``conversation_id`` (its first message), ``position, message_id,
    parent_id, depth, sent, text`` of every message."""
    links = materialize(reply_links(messages), "replies")
    rows = links.join(_roots(links), "message_id").withColumnRenamed("root_id", "conversation_id")
    ranked = position(rows, "conversation_id", "sent", "message_id")
    return ranked.select("conversation_id", "position", "message_id", "parent_id", "depth", "sent", "text")


def mail_id(conv_id: Column, turn: Column, role: Column, text: Column) -> Column:
    """``conversation.turn.hash of role and text``: of the row alone, whatever
    else the table holds."""
    said = F.md5(F.concat(F.coalesce(F.concat(F.lit("1"), role), F.lit("0")), F.lit("|"), text).cast("binary"))
    return F.concat_ws(".", F.coalesce(conv_id.cast("string"), F.lit("-")), F.coalesce(turn.cast("string"), F.lit("-")),
                       F.substring(said, 1, 16))


def mail_view(turns: DataFrame) -> DataFrame:
    """Mails derived from ``conversations``: every distinct row is a mail that
    quotes the turn before it, and the turn before that one level deeper.  Of
    several rows of one turn, the one with the smallest id is quoted; a row
    without a conversation or turn quotes nothing."""
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).distinct()
    rows = rows.withColumn("number", mail_id(*[F.col(c) for c in ("conv_id", "turn", "role", "text")])) \
               .withColumn("sent", F.try_add(F.try_multiply(F.col("conv_id").cast("long"), F.lit(TURNS)), F.col("turn")))
    first = rows.filter("conv_id is not null and turn is not null").groupBy("conv_id", "turn") \
                .agg(F.min_by("text", "number").alias("text"))

    def earlier(n: int) -> DataFrame:
        return first.select("conv_id", (F.col("turn") + n).alias("turn"), F.col("text").alias(f"back{n}"))

    def quoted(name: str, mark: str) -> Column:
        return F.concat(F.lit(mark), F.regexp_replace(name, "\n", "\n" + mark), F.lit("\n"))

    both = rows.join(earlier(1), ["conv_id", "turn"], "left").join(earlier(2), ["conv_id", "turn"], "left")
    body = F.concat(
        F.when(F.col("back1").isNotNull(), F.lit("On an earlier day, someone wrote:\n")).otherwise(""),
        F.when(F.col("back1").isNotNull() & F.col("back2").isNotNull(), quoted("back2", "> > ")).otherwise(""),
        F.when(F.col("back1").isNotNull(), quoted("back1", "> ")).otherwise(""), F.col("text"))
    return both.select(F.col("number").alias("message_id"), "sent", body.alias("body"))


def op8_quotes(spark, sf_dir) -> DataFrame:
    """One row per mail derived from ``conversations``."""
    from xgspark.sources.tables import read_table

    got = conversations(mail_view(read_table(spark, sf_dir, "conversations")))
    return got.select("conversation_id", "position", "message_id", "parent_id", "depth",
                      F.md5(normal(F.col("text")).cast("binary")).alias("text_md5"))


def oracle_sql() -> str:
    """DuckDB SQL of the query's rows."""
    return r"""
WITH RECURSIVE rows AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
mails AS (
  SELECT *, concat_ws('.', coalesce(CAST(conv_id AS VARCHAR), '-'), coalesce(CAST(turn AS VARCHAR), '-'),
              substr(md5(coalesce('1' || role, '0') || '|' || text), 1, 16)) AS id,
         coalesce(TRY_CAST(CAST(conv_id AS HUGEINT) * 1024 + turn AS BIGINT), -4611686018427387904) AS sent FROM rows),
normal AS (SELECT *, trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g')) AS own FROM mails),
firsts AS (SELECT conv_id, turn, arg_min(own, id) AS own FROM normal
           WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
quotes AS (
  SELECT m.id, m.sent, p.own AS quoted FROM normal m JOIN firsts p ON p.conv_id = m.conv_id AND p.turn + 1 = m.turn
  WHERE p.own <> ''),
events AS (
  SELECT own AS h, sent, id, id AS base, 0 AS probe FROM normal WHERE own <> ''
  UNION ALL SELECT quoted, sent, id, NULL, 1 FROM quotes),
links AS (
  SELECT id, probe, last_value(base IGNORE NULLS) OVER (PARTITION BY h ORDER BY sent, id, probe DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM events),
parents AS (SELECT n.id, n.sent, n.own, l.parent FROM normal n LEFT JOIN (SELECT * FROM links WHERE probe = 1) l USING (id)),
walk AS (
  SELECT id, id AS root, CAST(0 AS BIGINT) AS depth FROM parents WHERE parent IS NULL
  UNION ALL SELECT p.id, w.root, w.depth + 1 FROM parents p JOIN walk w ON p.parent = w.id)
SELECT w.root AS conversation_id,
       CAST(row_number() OVER (PARTITION BY w.root ORDER BY p.sent, w.id) - 1 AS BIGINT) AS position,
       w.id AS message_id, p.parent AS parent_id, w.depth, md5(p.own) AS text_md5
FROM walk w JOIN parents p USING (id)"""
