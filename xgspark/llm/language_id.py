"""Language identification by compression: one zstandard raw-content
dictionary per language; a text belongs to the language whose dictionary
compresses it smallest, and is rejected when the margin is narrow.

Learning takes, per language, a bounded sample of labelled documents (about
``SAMPLE_DOCS``, chosen by hash, at most ``SAMPLE_CHARS`` characters of each)
and fills a dictionary of at most ``DICT_BYTES`` bytes.  Prediction reads the
whole text, in pieces of ``PIECE_BYTES`` so that the dictionary stays in reach
of every part of a long text; the sizes of the pieces are added up.

Both sides are lower-cased and keep letters and blanks only, so case,
digits, markup and punctuation say nothing about the language.

Scale: prediction is a map over the documents, no shuffle.  The dictionaries
are broadcast: ``DICT_BYTES`` per language, ``MAX_LANGUAGES`` checked.

Edge cases: null texts and texts without a letter are ``und`` with score 0 and
rejected; equal sizes go to the language with more learned documents (then by
code point) and are rejected;
null labels teach nothing; without any labelled document every text is
``und``; repeated rows teach once a row and are each judged alike; texts of any
length are judged whole; documents keep extra columns, whatever their names.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from xgspark.llm._frame import free_name

UNDETERMINED = "und"
SAMPLE_DOCS = 400
SAMPLE_CHARS = 4_000
DICT_BYTES = 96 * 1024
PIECE_BYTES = 8 * 1024
# One level for texts of every length.
LEVEL = 12
# Put before every piece: a stretch that compresses, so that a short piece is
# not stored as it is (which would hide the difference between dictionaries).
PRIMER = bytes(64)
MAX_LANGUAGES = 500
MIN_MARGIN = 0.01        # of the smallest size
HELD_OUT = 2             # crc32(doc_id) modulo 4 of the documents never learned from

PREDICTION_TYPE = "lang_pred string, score double, rejected boolean"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def learn(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          sample_docs: int = SAMPLE_DOCS) -> dict[str, bytes]:
    """Language -> raw-content dictionary, from labelled rows not held out."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body"), F.col(lang).alias("lang")) \
               .filter(F.col("lang").isNotNull() & F.col("body").isNotNull() & ~held_out(F.col("id")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
              .limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, sample_docs / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("id", F.lit("lang")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.withColumn("draw", draw).filter(F.col("draw") < share) \
                 .select("lang", "draw", F.substring("body", 1, SAMPLE_CHARS).alias("body")).collect()
    out: dict[str, bytes] = {}
    for name in sorted(counts, key=lambda c: (-counts[c], c)):   # most frequent first
        texts = sorted((r["draw"], r["body"]) for r in sample if r["lang"] == name)
        out[name] = b" ".join(normalised(t) for _, t in texts)[-DICT_BYTES:]
    return out


_LETTERS = set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes(b if b in _LETTERS else 0x20 for b in range(256))


def normalised(text: str) -> bytes:
    """Lower case, runs of ASCII characters that are no letters as one blank:
    the form that dictionaries and texts are compared in."""
    return b" ".join(text.lower().encode("utf-8").translate(_TABLE).split())


class Classifier:
    """Compressors of all languages; made once per task."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import regex
        import zstandard as z

        self.letter = regex.compile(r"\p{L}")
        self.names = list(dictionaries)
        self.compressors = []
        for name in self.names:
            # A raw dictionary must not be empty; one blank carries no language.
            d = z.ZstdCompressionDict(dictionaries[name] or b" " * 8, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False,
                                                     write_content_size=False, write_dict_id=False))

    def sizes(self, text: bytes) -> list[int]:
        pieces = [text[i:i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)]
        return [sum(len(c.compress(PRIMER + p)) for p in pieces) for c in self.compressors]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.names or not self.letter.search(text):
            return UNDETERMINED, 0.0, True
        sizes = self.sizes(normalised(text))
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = order[0]
        if len(order) == 1:
            return self.names[best], 1.0, False
        margin = (sizes[order[1]] - sizes[best]) / sizes[best]
        return self.names[best], min(1.0, margin), margin < MIN_MARGIN


def prediction(text: Column, dictionaries: dict[str, bytes], spark) -> Column:
    """Struct ``lang_pred, score, rejected``; score is the relative margin to
    the second language, at most 1."""
    shared = spark.sparkContext.broadcast(dictionaries)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(shared.value)
        for texts in batches:
            yield pd.DataFrame([classifier.predict(t) for t in texts],
                               columns=["lang_pred", "score", "rejected"])

    return F.pandas_udf(predict, PREDICTION_TYPE)(text)


def keep_identified(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents whose language is not rejected; all columns kept."""
    model = learn(docs, doc_id=doc_id, text=text, lang=lang)
    name = free_name(docs, "prediction")
    return docs.withColumn(name, prediction(F.col(text), model, docs.sparkSession)) \
               .filter(~F.col(name)["rejected"]).drop(name)


def op1_language_id(spark, sf_dir) -> DataFrame:
    """Contract digest: one row per document."""
    from xgspark.sources.tables import read_table

    docs = read_table(spark, sf_dir, "documents")
    model = learn(docs)
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                        prediction(F.col("text"), model, spark).alias("p"))
                .select("doc_id", "held_out", "p.*"))
