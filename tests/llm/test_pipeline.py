import duckdb

import corpus_pipeline
from freshet.llm import decontam, neardup, quality, registry, sharding
from freshet.llm.common import shared_dir
from tests.llm import brute
from tests.llm.test_neardup import brute as near_brute


def test_stages_take_effect_and_keep_columns(spark, data, docs):
    at = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = shared_dir(spark)
        before = at
        stage(spark, at, data).write.parquet(path)
        at = spark.read.parquet(path)
        sizes.append(at.count())
        if k < 4:
            assert at.columns == docs.columns
        if k == 0:
            assert {r.doc_id for r in at.collect()} == {r.doc_id for r in quality.report(before).filter("kept").collect()}
        if k == 1:
            assert {r.doc_id for r in at.collect()} == {r.doc_id for r in neardup.report(before, shingle=5).filter("kept").collect()}
        if k == 2:
            bench = spark.read.parquet(f"{data}/benchmark.parquet")
            assert at.count() == before.count() - decontam.report(before, bench).filter("contaminated").count()
    assert docs.count() > sizes[0] > sizes[1] >= sizes[2] and sizes[3] == sizes[4]
    assert set(at.columns) == {*docs.columns, "shard", "slot"}
    assert corpus_pipeline.run(spark, data).count() == sizes[4]


def test_an_empty_corpus_passes(spark, data, docs):
    at = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, data)
        assert at.count() == 0


def test_run_against_brute_force(spark, data, docs):
    """Each stage's plain version on what the one before it kept: SQL, all pairs, all items, SQL, and the rounds one by one."""
    con = duckdb.connect()
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    con.execute(f"create view documents as select * from '{data}/documents.parquet'")
    res = con.execute(registry.ORACLE["op1_quality_rules"])
    names = [x[0] for x in res.description]
    ids = sorted(r[names.index("doc_id")] for r in res.fetchall() if r[names.index("kept")])
    near = near_brute([(i, text[i]) for i in ids], 5)
    ids = [i for i in ids if near[i][1] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    held = brute.leaks([(i, text[i]) for i in ids], items)
    ids = [i for i in ids if not held[i]]
    con.execute("drop view documents")
    con.execute(f"create view documents as select * from '{data}/documents.parquet' where doc_id in ({', '.join(map(str, ids))})")
    res = con.execute(registry.ORACLE["op7_mix_sources"])
    names = [x[0] for x in res.description]
    mixed = [r[names.index("doc_id")] for r in res.fetchall() for _ in range(r[names.index("times")])]
    want = sorted(brute.shards([(i, text[i]) for i in mixed], sharding.SHARDS, sharding.ROUNDS))
    assert sorted((r.doc_id, r.shard, r.slot) for r in corpus_pipeline.run(spark, data).collect()) == want


def test_odd_rows_pass_the_stages(spark, data, odd):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing names: rows and columns stay what they were."""
    at = odd
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, at, data)
        if k < 4:
            assert got.schema == odd.schema, name
        at = got
    assert set(at.columns) == {*odd.columns, "shard_2", "slot"}
    assert at.count() == at.select("doc_id", "shard_2", "slot").distinct().count()
