import collections
import random
import re

import numpy as np
import pytest

from freshet.llm import common, neardup, vec

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t, k):
    w = WORD.findall((t or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute(rows, k):
    """doc_id -> (shingles, smallest id reachable)."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = collections.defaultdict(list)
    for i, s in sorted(sets.items()):
        both = collections.Counter(j for x in s for j in where[x])
        for j, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in s:
            where[x].append(i)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(df, rows, k):
    want = brute(rows, k)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


@pytest.mark.parametrize("k", [2, 5])
def test_documents_against_brute_force(docs, k):
    check(neardup.report(docs, shingle=k), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], k)


def copies(seed, n):
    """A group of near copies around one text, many of them too far from most others, and some short texts."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    base = [r.choice(words) for _ in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(n + i, " ".join(r.choice(words[:6]) for _ in range(r.randrange(0, 7)))) for i in range(40)]
    return rows


@pytest.mark.parametrize("crowd, listed, block", [(16, 1_000_000, 2048), (2, 0, 7), (10_000, 0, 50)])
def test_crowds_and_blocks_lose_no_link(spark, monkeypatch, crowd, listed, block):
    monkeypatch.setattr(neardup, "CROWD", crowd)
    monkeypatch.setattr(common, "BROADCAST_ROWS", listed)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = copies(crowd, 150)
    check(neardup.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), rows, 2)


def test_odd_rows(odd):
    rows = odd.filter("doc_id is not null")
    got = neardup.report(rows)
    assert got.count() == rows.count()
    check(got, [(r.doc_id, r.text) for r in rows.select("doc_id", "text").distinct().collect()], 2)
    kept = neardup.keep(odd, shingle=2)
    assert kept.schema == odd.schema
    assert kept.filter("doc_id is null").count() == 1 and kept.filter("doc_id in (7, 8)").count() == 0


def test_empty(empty):
    assert neardup.report(empty).count() == 0 and neardup.keep(empty).count() == 0


def test_estimate_is_corrected_for_chance():
    r = np.random.default_rng(5)
    for j in (0.0, 0.5, 0.9):
        e = []
        for _ in range(20):
            both = r.integers(0, 2**64, int(2000 * j), dtype=np.uint64)
            rest = (2000 - len(both)) // 2
            a, b = (np.concatenate([both, r.integers(0, 2**64, rest, dtype=np.uint64)]) for _ in range(2))
            e.append(neardup.estimate(neardup.registers(a)[None], neardup.registers(b)[None], np.array([len(a)]), np.array([len(b)]))[0])
        assert abs(np.mean(e) - j) < 0.02


def test_words_and_shingles_match_the_plain_definition():
    import pyarrow as pa

    texts = ["A b\x0bC  a B", "", None, "É é\tÉ", "one", "x y z x y"]
    for _, data, offsets in vec.chunks(pa.array(texts)):
        got = vec.shingles(*vec.words(data, offsets), 2, len(texts))
        assert [len(s) for s in got] == [len(shingles(t, 2)) for t in texts]
