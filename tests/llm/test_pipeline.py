import corpus_pipeline
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from xgspark.llm import decontaminate, language_id, mixing, sharding, simhash
from xgspark.llm.queries import ORACLE, QUERIES
from xgspark.sources.tables import read_table


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_are_the_dealt_ones_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash", "decontaminate", "mixing", "sharding"]


def test_every_stage_takes_effect_on_its_own_input(spark, tmp_path):
    docs = read_table(spark, SF_SMALL, "documents")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        if name != "sharding":
            assert out.columns == columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        seen.append(docs.count())
        if name == "language_id":
            p = language_id.prediction(F.col("text"), language_id.learn(before), spark)
            assert ids(docs) == ids(before.withColumn("p", p).filter("not p.rejected"))
            assert len(ids(docs)) > 0.95 * before.count()
        elif name == "simhash":
            groups = simhash.near_groups(before)
            assert ids(docs) == sorted({r.component_id for r in groups.collect()})
        elif name == "decontaminate":
            marked = decontaminate.mark_hits(before, read_table(spark, SF_SMALL, "benchmark"))
            assert ids(docs) == ids(marked.filter("hits.n_hit = 0"))
        elif name == "mixing":
            copies = mixing.mix(before).filter("shard is not null and 2 * words >= size")   # whole documents only
            assert ids(docs) == ids(copies)
            words = docs.agg(F.sum(mixing.word_count(F.col("text")))).first()[0]
            assert words == copies.agg(F.sum("size")).first()[0]
        else:
            assert ids(docs) == ids(before)
            assert docs.filter(F.col("shard") != sharding.shard_of(F.col("doc_id"), sharding.layout())).count() == 0
    assert seen[1] < seen[0] and seen[2] < seen[1]
    run = corpus_pipeline.run(spark, SF_SMALL)
    assert sorted(run.columns) == sorted([*columns, "shard"]) and run.count() == seen[-1]


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs.drop("shard"), no_docs.drop("shard")):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_SMALL)
            assert set(docs.columns) <= set(out.columns)
            out.count()


def test_registration():
    import __spark_entry__ as entry

    q = entry.queries()
    assert set(QUERIES) <= set(q) and "pipeline" in q and set(ORACLE) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_oracles_at_small_scale(spark):
    from tests import oracle_check

    con = oracle_check.duck(SF_SMALL)
    for name, sql in ORACLE.items():
        message, ok = oracle_check.compare(spark, con, name, QUERIES[name], sql, SF_SMALL)
        assert ok, message
