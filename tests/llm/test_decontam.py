import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from freshet.llm import decontam
from tests.llm import brute as plain


def brute(item, text):
    """Fewest edits between the item and any stretch of the text."""
    prev = [0] * (len(text) + 1)
    for i in range(1, len(item) + 1):
        cur = [i]
        for j in range(1, len(text) + 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (item[i - 1] != text[j - 1])))
        prev = cur
    return min(prev)


def test_nearest_against_dynamic_programming():
    r = random.Random(3)
    for _ in range(300):
        a = np.array([r.randrange(6) for _ in range(r.randrange(1, 80))])
        b = np.array([r.randrange(6) for _ in range(r.randrange(0, 25))], int)
        assert decontam.nearest(a, b) == brute(a.tolist(), b.tolist())


def edited(r, words, share, vocab):
    w = list(words)
    for _ in range(int(share * len(w))):
        k, o = r.randrange(len(w)), r.random()
        if o < 0.5:
            w[k] = r.choice(vocab)
        elif o < 0.75:
            del w[k]
        else:
            w.insert(k, r.choice(vocab))
    return w


@pytest.fixture(scope="module")
def case():
    r = random.Random(8)
    vocab = [f"w{k}" for k in range(500)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.randrange(8, 150)))) for k in range(150)]
    texts, want = [], []
    for share in (0.0, 0.1, 0.18):
        for k, t in items:
            texts.append(" ".join(r.choices(vocab, k=40) + edited(r, t.split(), share, vocab) + r.choices(vocab, k=40)))
            want.append(k)
    return items, texts, want, vocab


def test_recall_and_precision_against_brute_force(case):
    items, texts, want, vocab = case
    found = decontam._hits(decontam.Index(items), pa.array(texts))
    short = [n for n in range(len(texts)) if len(items[want[n]][1].split()) <= decontam.SEGMENT]
    assert sum(want[n] in found.get(n, {}) for n in short) >= 0.98 * len(short)
    assert sum(want[n] in found.get(n, {}) for n in range(len(texts))) >= 0.97 * len(texts)
    for n, hits in list(found.items())[:60]:
        for item, (edits, size) in hits.items():
            whole = dict(items)[item].split()
            if len(whole) <= decontam.SEGMENT:
                assert brute(whole, texts[n].split()) <= decontam.edits_allowed(len(whole)) and size == len(whole) and edits <= decontam.edits_allowed(size)
    r = random.Random(2)
    assert not decontam._hits(decontam.Index(items), pa.array([" ".join(r.choices(vocab, k=300)) for _ in range(200)]))


def test_blocks_of_the_benchmark_change_nothing(spark, case, monkeypatch):
    items, texts, want, _ = case
    docs = spark.createDataFrame(list(enumerate(texts[:60])), "doc_id long, text string")
    bench = spark.createDataFrame([*items, (999, None)], "item_id long, text string")
    whole = {r.id: sorted(x.item_id for x in r["items"]) for r in decontam.find(docs, bench).collect()}
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 40)
    parts = {}
    for r in decontam.find(docs, bench).collect():
        parts.setdefault(r.id, []).extend(x.item_id for x in r["items"])
    assert {k: sorted(v) for k, v in parts.items()} == whole
    assert decontam.keep(docs, bench).count() == sum(not v for v in whole.values())


def test_report_gives_one_row_a_document_over_many_blocks(spark, case, monkeypatch):
    items, texts, _, _ = case
    docs = spark.createDataFrame([*enumerate(texts[:40]), (40, items[0][1] + " . " + items[99][1]), (41, None)], "doc_id long, text string")
    bench = spark.createDataFrame([*items, (None, items[3][1])], "item_id long, text string")
    whole = sorted(decontam.report(docs, bench).collect())
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 40)
    parts = sorted(decontam.report(docs, bench).collect())
    assert len(parts) == 42 and parts == whole
    assert parts[40].contaminated and parts[40].n_items == 2 and parts[40].item_ids == [0, 99] and not parts[41].contaminated
    assert None in parts[3].item_ids


def test_odd_rows_and_empty_tables(spark, odd, empty):
    text = odd.filter("doc_id = 9").first().text
    bench = spark.createDataFrame([(1, text), (1, text), (2, None), (3, "too short"), (None, "")], "item_id long, text string")
    got = decontam.report(odd, bench).collect()
    assert len(got) == odd.count()
    assert {r.doc_id for r in got if r.contaminated} == {9}
    kept = decontam.keep(odd, bench)
    assert kept.schema == odd.schema and kept.count() == odd.count() - 3
    assert decontam.report(empty, bench).count() == 0
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontam.keep(odd, nothing).count() == odd.count() and decontam.report(odd, nothing).filter("contaminated").count() == 0


def test_punctuation_and_case_do_not_hide_a_leak():
    item = "The quick brown fox jumps over the lazy dog near the river bank today"
    text = "junk " + " ".join(w.upper() + "%%%" for w in item.split()) + " junk"
    assert decontam._hits(decontam.Index([(5, item)]), pa.array([text, "nothing here", None])).keys() == {0}


def test_short_items_are_found_exactly():
    r = random.Random(5)
    vocab = [f"v{k}" for k in range(12)]
    items = [(k, " ".join(r.choices(vocab, k=r.randrange(1, 8)))) for k in range(60)]
    texts = [" ".join(r.choices(vocab, k=r.randrange(0, 30))) for _ in range(120)]
    found = decontam._hits(decontam.Index(items), pa.array(texts))
    for n, text in enumerate(texts):
        edits = {k: (brute(t.split(), text.split()), len(t.split())) for k, t in items}
        assert found.get(n, {}) == {k: (d, m) for k, (d, m) in edits.items() if d <= decontam.edits_allowed(m)}


def test_long_items_are_held_as_a_whole():
    r = random.Random(6)
    vocab = [f"w{k}" for k in range(500)]
    long = r.choices(vocab, k=600)
    pad = r.choices(vocab, k=50)
    passage = " ".join(pad + long[200:320] + pad)
    leaked = [" ".join(pad + edited(r, long, 0.15, vocab) + pad) for _ in range(5)]
    found = decontam._hits(decontam.Index([(1, " ".join(long))]), pa.array([passage, *leaked, " ".join(long[60:540])]))
    assert found.keys() == {1, 2, 3, 4, 5, 6}
    for n, text in enumerate(leaked, 1):
        assert found[n] == {1: (brute(long, text.split()), 600)}
    assert found[6] == {1: (120, 600)}


def test_a_chance_candidate_hides_nothing_in_the_next_row():
    item = [f"k{n}" for n in range(10)]
    index = decontam.Index([(1, " ".join(item))])
    everywhere = SimpleNamespace(repeat=0, steps=[], tables=[], keys=np.zeros(1, np.uint64), items=np.array([0]))
    index.classes = [(*index.classes[0][:4], [everywhere])]
    # The last word of the first row and the first of the second fall into one bucket.
    found = decontam._hits(index, pa.array(["a b c k0", " ".join(item[:8] + ["x", "y"])]))
    assert found == {1: {1: (2, 10)}}


def test_the_benchmark_s_leaks_against_all_pairs(spark, data, docs):
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = {(d, i) for d, held in plain.leaks(rows, [(r.item_id, r.text) for r in bench.collect()]).items() for i in held}
    got = {(r.doc_id, i) for r in decontam.report(docs, bench).collect() for i in r.item_ids}
    assert want and got <= want and len(got) >= 0.98 * len(want)


def test_blocks_give_the_same_report(spark, data, docs, monkeypatch):
    bench = spark.read.parquet(f"{data}/benchmark.parquet").limit(12)
    whole = sorted(map(repr, decontam.report(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 5)
    assert sorted(map(repr, decontam.report(docs, bench).collect())) == whole and len(whole) == docs.count()


def test_keys_of_any_type(spark):
    item = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([("a1", f"x {item} y"), (None, "z"), ("a1", None)], "doc_id string, text string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = decontam.report(docs, bench)
    assert got.schema["doc_id"].dataType.simpleString() == "string" and sorted((str(r.doc_id), r.contaminated) for r in got.collect()) == [("None", False), ("a1", False), ("a1", True)]
