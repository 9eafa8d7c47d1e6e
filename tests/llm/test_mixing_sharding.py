import collections
import zlib

import pytest

from freshet.llm import common, mixing, sharding
from tests.llm import brute


def filled(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    """Budgets by repeated resharing of the excess."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    out, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > most * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check_mix(rows):
    size, target, taken = collections.Counter(), {}, collections.Counter()
    largest = collections.Counter()
    for r in rows:
        size[r.source] += r.size
        target[r.source] = r.target
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken in (0, r.size, 2 * r.size)
    want = filled(size)
    for s in size:
        assert target[s] == pytest.approx(want[s]) and all(r.source_size == size[s] for r in rows if r.source == s)
    return taken, target, largest


def test_mix_meets_its_targets(docs):
    rows = mixing.mix_report(docs).collect()
    taken, target, largest = check_mix(rows)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_report(docs.repartition(7)).collect()))


def test_mix_writes_documents_as_often_as_taken(docs):
    times = {r.doc_id: r.times for r in mixing.mix_report(docs).collect()}
    got = collections.Counter(r.doc_id for r in mixing.mix(docs).select("doc_id").collect())
    assert got == {k: v for k, v in times.items() if v} and mixing.mix(docs).columns == docs.columns


def test_mix_of_odd_rows(odd, empty, spark):
    rows = mixing.mix_report(odd).collect()
    check_mix(rows)
    assert len(rows) == odd.count() and {r.source for r in rows} == {None, "s0", "s1", "s2"}
    assert mixing.mix(odd).schema == odd.schema
    assert mixing.mix_report(empty).count() == 0 and mixing.mix(empty).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix_report(none).collect()] == [0, 0]


def check_shards(rows, texts, shards=sharding.SHARDS):
    n = collections.Counter(r.shard for r in rows)
    counts = [n[s] for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(n) <= set(range(shards))
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    for r in rows:
        want = {(None if t is None else zlib.crc32(t.encode()), len((t or "").encode()) + 16) for t in texts[r.doc_id]}
        assert (r.text_crc32, r.size) in want and r.law == "rows" and r.grown_shard is None


def test_shards_are_even_and_keep_copies_together(docs):
    texts = collections.defaultdict(set)
    for r in docs.collect():
        texts[r.doc_id].add(r.text)
    rows = sharding.shard_report(docs, shards=10).collect()
    check_shards(rows, texts, 10)
    groups = collections.defaultdict(set)
    for r in rows:
        groups[r.text_crc32, r.size].add(r.shard)
    assert sum(len(v) == 1 for v in groups.values()) >= 0.95 * len(groups)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.shard_report(docs.repartition(5), shards=10).collect()))


def test_a_group_beyond_a_shard_is_spread(spark):
    rows = [(k, "same" if k < 120 else f"t{k}") for k in range(400)]
    got = sharding.shard_report(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    check_shards(got, {k: {t} for k, t in rows}, 8)
    at = collections.Counter(r.shard for r in got if r.doc_id < 120)
    assert max(at.values()) >= 35  # most of the room of one shard (50), where chance alone gives 15


def test_shards_of_odd_rows(odd, empty):
    texts = collections.defaultdict(set)
    for r in odd.collect():
        texts[r.doc_id].add(r.text)
    rows = sharding.shard_report(odd).collect()
    check_shards(rows, texts)
    assert len(rows) == odd.count()
    assert sharding.shard_report(empty).count() == 0
    whole = sharding.shard(odd)
    assert whole.count() == odd.count() and whole.columns == [*odd.columns, "shard_2", "slot"]
    assert sharding.shard(empty).count() == 0


def test_running_sums_over_ranges_of_ranges(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("key"), (F.col("id") % 7).alias("n"))
    got = {(r.g, r.key): r.at for r in common.running(df, ["g"], [], "key", 6, "n", "at").collect()}
    at = collections.Counter()
    for r in sorted(df.collect(), key=lambda r: r.key):
        assert got[r.g, r.key] == at[r.g]
        at[r.g] += r.n


@pytest.mark.parametrize("shards", [7, 40])
def test_shards_against_brute_force(docs, shards):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute.shards(rows, shards, sharding.ROUNDS)
    assert sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard_report(docs, shards=shards).collect()) == sorted(want)


def test_large_groups_against_brute_force(spark):
    rows = [(k, f"group {k % 3}" if k % 4 else f"t{k}") for k in range(600)]
    got = sharding.shard_report(spark.createDataFrame(rows, "doc_id long, text string"), shards=9).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in got) == sorted(brute.shards(rows, 9, sharding.ROUNDS))
