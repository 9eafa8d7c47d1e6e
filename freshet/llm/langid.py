"""Language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence are combined for every page: (1) the likelihood of its text under byte-trigram models; (2) the language
its markup declares; (3) the suffix of its address; (4) its host. The trigram models are fitted on labelled documents, a
sample of about TRAIN_ROWS for each language drawn by a digest of the id, each text whole. The rest is learnt from all
pages by grouped aggregation of the text posteriors: how often each language declares what, and host priors
smoothed towards their address suffix's, which are smoothed towards the whole corpus'. A page's own share is taken
out of its host's before it is used.

Posteriors are counted in millionths, so sums and results don't depend on the order of rows. A hot host is
pre-aggregated in each task before its rows meet. Null or empty pages have no text evidence and get their prior; a null or
broken address counts as one host ''; repeated rows get the same answer each; an empty table gives no rows. Labels without
any text, or an empty label table, are refused, since there is nothing to tell apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.llm import htmltext, vec
from freshet.llm.common import cut, spread

TRAIN_ROWS = 2000
BITS = 15
#: The share of a trigram's evidence that counts, as neighbours overlap, and the most trigrams that are believed.
TEMPER = 0.2
MOST_GRAMS = 400
#: Pages that the next wider group weighs for, in a host's or suffix's prior.
PRIOR_PAGES = 5.0
MILLION = 1_000_000

_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})\b", re.I)


def grams(data: np.ndarray) -> np.ndarray:
    """Bucket of each byte trigram of a text, A-Z lowered, any white space alike."""
    x = data.copy()
    upper = (x >= 65) & (x <= 90)
    x[upper] += 32
    x[(x >= 9) & (x <= 13)] = 32
    if len(x) < 3:
        return np.zeros(0, np.int64)
    y = x.astype(np.uint64)
    return (vec.mix(y[:-2] << np.uint64(16) | y[1:-1] << np.uint64(8) | y[2:]) >> np.uint64(64 - BITS)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got = total.setdefault(lang, np.zeros(1 << BITS, np.int64))
            got += np.bincount(grams(np.frombuffer(text.encode(), np.uint8)), minlength=1 << BITS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "gram", "n"])


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [language, gram]): 2**BITS numbers for each language, whatever the corpus."""
    rows = docs.select(docs[f"`{key}`"].alias("id"), docs[f"`{lang}`"].alias("lang"), docs[f"`{text}`"].alias("text")).filter("lang is not null and text is not null")
    have = rows.groupBy("lang").count()
    share = F.least(F.lit(1.0), F.lit(float(TRAIN_ROWS)) / F.col("count"))
    draw = F.conv(F.substring(spread(F.col("id"), "lang"), 1, 8), 16, 10).cast("double") / float(1 << 32)
    # A row for each language.
    part = rows.join(F.broadcast(have), "lang").filter(draw < share).select("lang", "text")
    found = part.mapInArrow(_counts, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found.lang.unique())
    if not langs:
        raise ValueError("no labelled text to fit languages on")
    table = np.full((len(langs), 1 << BITS), 0.5)
    table[[langs.index(x) for x in found.lang], found.gram.to_numpy()] += found.n.to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def posterior(logp: np.ndarray, text: str) -> np.ndarray:
    """Of each language given the text alone and even priors, in millionths."""
    n_langs = len(logp)
    g = grams(np.frombuffer(text.encode(), np.uint8))
    if not len(g):
        return np.full(n_langs, MILLION // n_langs)
    score = logp[:, g].mean(axis=1) * min(len(g), MOST_GRAMS) * TEMPER
    p = np.exp(score - score.max())
    return np.floor(p / p.sum() * MILLION + 0.5).astype(np.int64)


def _read(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = shared.value
        for b in batches:
            pages = [x or "" for x in b.column(2).to_pylist()]
            declared = [m[1].lower()[:2] if (m := _LANG.search(x)) else None for x in pages]
            text = [posterior(logp, htmltext.main_text(x)).tolist() for x in pages]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(declared, pa.string()), pa.array(text, pa.list_(pa.int64()))], ["id", "url", "declared", "text"])

    return run


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _sums(df: DataFrame, by: str, n: int) -> DataFrame:
    """For each value of a column, the posteriors of its pages added up."""
    sums = [F.sum(F.col("text")[k]).alias(f"s{k}") for k in range(n)]
    return df.groupBy(by).agg(*sums).select(F.col(by).alias(f"{by}_"), F.array(*[f"s{k}" for k in range(n)]).alias(f"of_{by}"))


def identify(pages: DataFrame, model: tuple[list[str], np.ndarray], key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row for each page: key, lang, confidence, text_lang, declared, host."""
    langs, logp = model
    n = len(langs)
    sc = pages.sparkSession.sparkContext
    rows = pages.select(pages[f"`{key}`"].alias("id"), pages[f"`{url}`"].cast("string").alias("url"), pages[f"`{html}`"].cast("string").alias("html"))
    kind = T.StructType([rows.schema["id"], rows.schema["url"], T.StructField("declared", T.StringType()), T.StructField("text", T.ArrayType(T.LongType()))])
    read = rows.mapInArrow(_read(sc.broadcast(logp)), kind)
    read = read.withColumn("host", host(F.col("url")))
    read = cut(read.select("id", "declared", "text", "host", F.substring_index("host", ".", -1).alias("suffix")))
    by_host, by_suffix = cut(_sums(read, "host", n)), cut(_sums(read, "suffix", n))
    by_declared = cut(_sums(read.filter("declared is not null"), "declared", n))
    whole = by_suffix.agg(*[F.sum(F.col("of_suffix")[k]) for k in range(n)]).first()
    total = sum(x or 0 for x in whole)
    everyone = F.array(*[F.lit(((x or 0) + MILLION) / (total + n * MILLION)) for x in whole])
    n_declared = by_declared.count()

    def smoothed(own: Column, wider: Column) -> Column:
        pages_ = F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.zip_with(own, wider, lambda x, w: (x + PRIOR_PAGES * MILLION * w) / (pages_ + PRIOR_PAGES * MILLION))

    got = read.join(by_host, F.col("host") == F.col("host_"), "left").join(by_suffix, F.col("suffix") == F.col("suffix_"), "left")
    got = got.join(by_declared, F.col("declared") == F.col("declared_"), "left")
    less = lambda c: F.zip_with(c, F.col("text"), lambda a, b: F.greatest(a - b, F.lit(0).cast("long")))
    got = got.withColumn("suffix_prior", smoothed(less(F.col("of_suffix")), everyone))
    got = got.withColumn("host_prior", smoothed(less(F.col("of_host")), F.col("suffix_prior")))
    # P(declared | language), one page of each declared value given beforehand; nothing declared says nothing.
    others = F.transform(F.array(*[F.lit(float(x or 0)) for x in whole]), lambda x: x + MILLION * max(1, n_declared))
    says = F.when(F.col("declared_").isNull(), F.array(*[F.lit(1.0)] * n)).otherwise(
        F.zip_with(less(F.col("of_declared")), others, lambda a, b: (a + F.lit(float(MILLION))) / b)
    )
    got = got.withColumn("says", says)
    one = lambda k: F.greatest(F.col("text")[k], F.lit(1)) * F.col("host_prior")[k] * F.col("says")[k]
    got = got.withColumn("weight", F.array(*[one(k) for k in range(n)]))
    best = F.array_position("weight", F.array_max("weight")).cast("int")
    names = F.array(*[F.lit(x) for x in langs])
    return got.select(
        F.col("id").alias(key),
        F.element_at(names, best).alias("lang"),
        F.round(F.array_max("weight") / F.aggregate("weight", F.lit(0.0), lambda a, x: a + x), 6).alias("confidence"),
        F.element_at(names, F.array_position("text", F.array_max("text")).cast("int")).alias("text_lang"),
        "declared",
        "host",
    )
