import pytest

from freshet.llm import registry, tokens
from freshet.llm.common import shared_dir


def counts(texts, name="byte_bpe_50k.json"):
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary(name))
        return [len(x) for x in sp.encode(texts)]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary(name))
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


TEXTS = ["", "hello  world", "<|endoftext|>x<|endoftext|>", "é𝒳😀\n\n\t  \r\n", "don't 123,456.7890 ...", "a" * 5000, " " * 3000, "<|endoftext|", "  x\u0000y"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_library_s_own(name):
    count = tokens.counter(name)
    assert [count(t) for t in TEXTS] == counts(TEXTS, name)


def test_documents(spark, docs):
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    got = tokens.count_tokens(docs, shared_dir(spark)).collect()
    want = dict(zip(rows, counts(list(rows.values())), strict=True))
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(rows[r.doc_id].encode()), want[r.doc_id], want[r.doc_id] > 512)


def test_the_query_hits_a_lasting_cache(spark, data, docs, monkeypatch):
    spark.conf.set(registry.TOKEN_CACHE, shared_dir(spark))
    try:
        first = sorted(map(tuple, registry.op8_token_counts(spark, data).collect()))
        cache = spark.conf.get(registry.TOKEN_CACHE)
        files = sorted(tokens.read_cache(spark, cache).inputFiles())
        monkeypatch.setattr(tokens, "_encode", lambda name: pytest.fail("a stored text is encoded again"))
        assert sorted(map(tuple, registry.op8_token_counts(spark, data).collect())) == first and len(first) == docs.count()
        assert sorted(tokens.read_cache(spark, cache).inputFiles()) == files
    finally:
        spark.conf.unset(registry.TOKEN_CACHE)


def test_only_distinct_misses_are_encoded(spark, odd, empty, monkeypatch):
    cache = shared_dir(spark)
    assert tokens.count_tokens(empty, cache).count() == 0
    n = odd.select("text").na.fill("", ["text"]).distinct().count()
    assert tokens.count_tokens(odd, cache).filter("n_tokens is not null").count() == odd.count()
    assert tokens.read_cache(spark, cache).count() == n
    tokens.fill(odd, cache, "byte_bpe_50k.json")
    assert tokens.read_cache(spark, cache).count() == n  # nothing was missing
    monkeypatch.setattr(tokens, "BROADCAST_COPIES", 0)  # the way beyond the bound
    other = shared_dir(spark)
    a = sorted(map(tuple, tokens.count_tokens(odd, other).collect()), key=repr)
    assert a == sorted(map(tuple, tokens.count_tokens(odd, cache).collect()), key=repr)
    assert tokens.read_cache(spark, other).count() == n
    tokens.fill(odd, cache, "piece_bpe_32k.model")
    assert tokens.read_cache(spark, cache).count() == 2 * n  # another tokenizer has counts of its own
