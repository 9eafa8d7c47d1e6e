import collections
import hashlib
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from freshet.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        t += n - 9 if n > 9 else n
    return t % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def brute(t):
    return [f"{k}:{m.start()}:{m.end()}" for k in RULES for m in re.finditer(RULES[k], t or "") if valid(k, m[0])]


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.report(df).collect():
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (texts[r.doc_id], want, r.spans)
        assert set(want) <= set(r.spans.split(",")) | {""} and len(r.spans.split(",") if r.spans else []) == len(want) + r.n_added
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in RULES]


def test_strict_spans_by_hand(spark):
    check(
        spark,
        ["a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 9" * 3, "+1 (017) 555-7713 +1+2 345 678 901", None, "", "é𝒳 a.b@c.d 10.0.0.1", "12345678901234567890 4242424242424242", "9" * 3000 + " " + "1 " * 3000],
    )


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10**6))
def test_strict_spans_of_random_text(spark, seed):
    r = random.Random(seed)
    check(spark, ["".join(r.choices("0123456789. -+()@a_é", k=60)) for _ in range(150)])


def test_very_long_runs_cost_linear_time(spark):
    df = spark.createDataFrame([(1, "a" * 300_000 + "@"), (2, "1" * 300_000), (3, "1." * 100_000), (4, "+1" * 100_000), (5, "1 " * 100_000)], "doc_id long, text string")
    assert pii.report(df).filter("spans = ''").count() >= 3


def test_loose_spans_and_redaction(spark):
    texts = ["Please call 555-123-4567 now", "part number A555-123-4567B", "mail: bob (at) example (dot) com", "order 1234-5678-9012-3456", "x a@b.cd y 10.0.0.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    assert got[0].spans == "phone:12:24" and got[1].spans == "" and got[3].spans == "" and got[2].n_added == 1
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[0] == "Please call [phone] now" and clean[4] == "x [email] y [ip]" and clean[1] == texts[1]


def test_odd_rows(odd, empty):
    assert pii.report(odd).count() == odd.count() and pii.report(empty).count() == 0
    again = pii.redact(odd)
    assert again.columns == odd.columns and again.filter("text is null").count() == odd.filter("text is null").count()


def test_a_text_full_of_matches(spark):
    """Positions, overlaps and redaction of tens of thousands of matches: near proportion to their number."""
    text = "a@b.cd (030) 1234567 x " * 10_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    r = pii.report(df).first()
    assert r.n_email == 10_000 and time.time() - start < 60
    assert r.base_sha256 == hashlib.sha256(",".join(f"email:{k * 23}:{k * 23 + 6}" for k in range(10_000)).encode()).hexdigest()
    clean = pii.redact(df).first().text
    assert clean.count("[email]") == 10_000 and "@" not in clean


def test_precision_on_held_out_texts(spark):
    """All true values and all look-alikes of fresh texts, through generators, features, trees and thresholds."""
    texts = pii.made_up(1200, 99)
    got = pii.spans(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id long, text string"))
    hit, right, found = collections.Counter(), collections.Counter(), collections.Counter()
    planted = collections.Counter(k for _, spots in texts for _, _, k in spots)
    for r in got.select("__row.doc_id", "base", "added").collect():
        true = texts[r.doc_id][1]
        for x in r.added:
            hit[x.kind] += 1
            right[x.kind] += any(k == x.kind and min(x.e, e) - max(x.s, s) >= 0.8 * max(x.e - x.s, e - s) for s, e, k in true)
        for s, e, k in true:
            found[k] += any(x.kind == k and min(x.e, e) - max(x.s, s) >= 0.8 * max(x.e - x.s, e - s) for x in [*r.base, *r.added])
    assert set(hit) == set(pii.ALL_KINDS)
    for kind in pii.ALL_KINDS:
        print(kind, hit[kind], right[kind] / hit[kind], found[kind] / planted[kind])
        assert hit[kind] > 50 and right[kind] >= 0.93 * hit[kind]
        assert found[kind] >= 0.75 * planted[kind]


def test_scores_are_those_of_the_trees(spark):
    texts = pii.made_up(60, 5)
    want = pii.cut_candidates(spark, texts)
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "i long, t string")
    for kind in pii.ALL_KINDS:
        trees, _ = pii.model(spark)[kind]
        one = F.transform(pii._candidates(kind, F.col("t")), lambda x: pii.score(trees, x["x"]))  # noqa: B023
        got = [s for r in df.orderBy("i").select(one.alias("s")).collect() for s in r.s]
        assert got == pii.total(trees, want[kind][0]).tolist()


def test_generators_propose_overlapping_spans(spark):
    texts = {
        "number 4111.1111.1111.1112 to 2001:db8::8a2e:370:7334": {"card", "phone", "ip"},
        "write to bob at example dot org, abcd:abcd:abcd:abcd:abcd:abcd:abcd:abcd": {"email", "ip"},
        "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff": {"secret"},
    }
    for text, kinds in texts.items():
        df = spark.createDataFrame([(text,)], "t string")
        row = df.select(*[pii._candidates(k, F.col("t")).alias(k) for k in pii.ALL_KINDS]).first()
        assert {k for k in pii.ALL_KINDS if row[k]} == kinds
    r = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert "ip:30:53" in r[0].spans and "ip:33:72" in r[1].spans and "email:9:31" in r[1].spans and r[2].spans == "secret:8:48"


def test_the_method_finds_more_than_the_formats(spark, data):
    docs = spark.read.parquet(f"{data}/../sf0.01/documents.parquet")
    added = pii.report(docs).agg(F.sum("n_added"), F.sum("n_secret")).first()
    assert added[0] > 0 and added[1] > 0
