import collections
import re

from freshet.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for x in t.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    n = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    cov = {p for k in range(len(w) - 4) if n[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cov)


def test_measurements_on_odd_rows(odd):
    texts = collections.defaultdict(set)
    for r in odd.collect():
        texts[r.doc_id].add(r.text)
    got = quality.report(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in {brute(t) for t in texts[r.doc_id]}
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)


def test_keep_returns_the_documents_own_columns(odd):
    kept = quality.keep(odd)
    assert kept.schema == odd.schema
    assert kept.filter("text is null or text = ''").count() == 0 and kept.count() > 0


def test_policies_share_one_ledger(docs):
    led = quality.ledger(docs)
    kept = [quality.verdict(led, p).filter("kept").count() for p in quality.POLICIES]
    assert kept == sorted(kept, reverse=True)
    for r in quality.ablation(led).collect():
        names = [n for n in quality.POLICIES[quality.CURRENT] if n != r.rule]
        m = sum(quality.BIT[n] for n in names)
        assert r.n_kept_without == sum(1 for x in led.select("fail_bits").collect() if not x.fail_bits & m)


def test_empty_table(empty):
    assert quality.report(empty).count() == 0 and quality.keep(empty).count() == 0
