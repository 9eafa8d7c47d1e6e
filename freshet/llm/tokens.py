"""Token counts through a digest cache.

A text's content digest and the tokenizer's digest (of its vocabulary file and settings) together name a stored count.
Counting joins the distinct digests of the corpus with the cache, encodes one copy of each miss, appends the new counts
and joins them back to all rows. Digests are written once; texts are read for them and, where any count is missing, once
more to encode it, and, while the list of further copies is within its size bound,
never shuffled; beyond the bound they are joined by id, in a shuffle on unique keys, so no hot copy meets in one task.

Null texts count as empty (0 tokens). Repeated rows get one count each. An empty table appends nothing.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import cut

#: Rows of (id, digest) that are broadcast at most, about 60 bytes each: 60 MB.
BROADCAST_COPIES = 1_000_000
CACHE_SCHEMA = "tokenizer string, content string, n_tokens long"


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file (read where the code runs, never copied into the repository)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(name: str) -> str:
    with open(vocabulary(name), "rb") as f:
        return hashlib.sha256(f.read() + b"|whole text, no added special tokens|1").hexdigest()


_LOADED: dict = {}


def counter(name: str):
    """A function from a text to its number of tokens, as the file's own library gives it; kept for each worker.

    A byte-level vocabulary with the usual split pattern is run by the faster library over the same ranks, with the
    file's special strings recognised inside texts as its own library does by default.
    """
    if name in _LOADED:
        return _LOADED[name]
    path = vocabulary(name)
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(sp.encode(t))
    else:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks = _as_ranks(name, spec)
        if ranks is not None:
            import public_tokenizers
            import tiktoken

            special = {x["content"]: x["id"] for x in spec["added_tokens"]}
            enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
            count = lambda t: len(enc.encode(t, allowed_special="all"))
        else:
            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    _LOADED[name] = count
    return count


def _as_ranks(name: str, spec: dict):
    """The same vocabulary as byte ranks, if there is such a file and nothing in the settings stands against it."""
    pre = spec.get("pre_tokenizer") or {}
    plain = (
        spec.get("normalizer") is None
        and spec.get("post_processor") is None
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex")
        and all(not (x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"]) for x in spec["added_tokens"])
    )
    if not plain:
        return None
    try:
        with open(vocabulary(name.removesuffix(".json") + ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    except (OSError, KeyError):
        return None
    return ranks if len(ranks) + len(spec["added_tokens"]) == len(spec["model"]["vocab"]) else None


def _encode(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(name)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(x.as_py() or "") for x in b.column(1)], pa.int64())], ["content", "n_tokens"])

    return run


def content_digest(text):
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; none if nothing has been stored yet."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(CACHE_SCHEMA).parquet(path) if there else spark.createDataFrame([], CACHE_SCHEMA)


def _digests(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A slim row for each document, written once: id, content digest and bytes."""
    t = F.coalesce(docs[f"`{text}`"], F.lit(""))
    return cut(docs.select(docs[f"`{key}`"].alias("id"), content_digest(t).alias("content"), F.octet_length(t).cast("long").alias("n_bytes")))


def fill(docs: DataFrame, cache: str, name: str, key: str = "doc_id", text: str = "text", slim: DataFrame | None = None) -> None:
    """Encode the texts that the cache lacks, one copy of each, and append their counts; nothing is written if none is missing."""
    spark = docs.sparkSession
    tok = tokenizer_digest(name)
    slim = _digests(docs, key, text) if slim is None else slim
    ids = slim.groupBy("content", "id").agg(F.lit(1).alias("one")).select("content", "id")
    known = read_cache(spark, cache).filter(F.col("tokenizer") == tok).select("content").distinct()
    found = cut(ids.groupBy("content").agg(F.min("id").alias("first"), F.count("*").alias("n")).join(known.withColumn("known", F.lit(True)), "content", "left"), slim.count(), 96)
    if found.filter("known is null").isEmpty():
        return
    # What must not be encoded: known texts, and copies of a text other than its first. Usually few, so they are listed.
    out = cut(ids.join(found.filter("n > 1 or known"), "content").filter(F.col("known") | ~F.col("id").eqNullSafe(F.col("first"))).select(F.col("id").alias("__i"), F.col("content").alias("__c")))
    n = out.count()
    rows = docs.select(docs[f"`{key}`"].alias("id"), F.coalesce(docs[f"`{text}`"], F.lit("")).alias("text")).withColumn("content", content_digest(F.col("text")))
    if n:
        out = F.broadcast(out) if n <= BROADCAST_COPIES else out
        rows = rows.join(out, (F.col("content") == F.col("__c")) & F.col("id").eqNullSafe(F.col("__i")), "left_anti")
    fresh = rows.select("content", "text").mapInArrow(_encode(name), "content string, n_tokens long")
    # Rows repeated as a whole (same id, same text) are encoded alike; one of them is stored.
    fresh = fresh.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    fresh.select(F.lit(tok).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, cache: str, name: str = "byte_bpe_50k.json", key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """One row for each document: key, n_bytes, n_tokens, over_limit."""
    slim = _digests(docs, key, text)
    fill(docs, cache, name, key, text, slim)
    stored = read_cache(docs.sparkSession, cache).filter(F.col("tokenizer") == tokenizer_digest(name))
    # Only this corpus's counts, written: both sides of the join are then dealt anew and a hot text's rows can be split.
    stored = stored.join(slim.select("content").distinct(), "content", "left_semi").groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    got = slim.join(cut(stored, slim.count(), 80), "content", "left")
    return got.select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
