"""Mixing sources to target weights.

Every document gets a random key (a digest of its id), which orders its source at random but always alike. The running
word count along that order, made from sums over key ranges and a running sum inside each range, shows where a source's
budget ends: documents before the cut are taken once more than those behind it. Whole epochs come first.

Only (id, source, size, key) is shuffled, never a text; a source with a third of all rows is spread over its key ranges.
Sizes are word counts, null texts have none. Repeated rows share a key, stay together and are taken alike. A null source
is a source of its own, last in order. An empty table gives an empty mix; a source without words is never taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freshet.llm.common import WORD, cut, hex_digits, pack, running, small, spread

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row for each source: its size and its budget.

    Budgets are weight * level, but at most ``most`` times the size, with the level at which they add up to ``share``
    of everything: what repeated resharing of the excess by weight comes to. Sources are ordered by how soon they reach
    their limit; the level is found with one running sum over the sources (one row each).
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = len(weights)
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % n + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    soon = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    up_to = soon.rowsBetween(Window.unboundedPreceding, -1)
    from_here = soon.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    by = by.withColumns(
        {
            "below": F.coalesce(F.sum("limit").over(up_to), F.lit(0.0)),
            "open_weight": F.sum("weight").over(from_here),
            "want": F.sum("source_size").over(everything) * F.lit(float(share)),
        }
    )
    by = by.withColumn("level", (F.col("want") - F.col("below")) / F.col("open_weight"))
    fits = F.col("level") <= F.col("limit") / F.col("weight")
    by = by.withColumn("level", F.coalesce(F.min(F.when(fits, F.struct(F.col("limit") / F.col("weight"), F.col("level").alias("level"))))
                                           .over(everything)["level"], F.lit(float("inf"))))
    return by.select("source", "source_size", F.least(F.col("limit"), F.col("weight") * F.col("level")).alias("target"))


def plan(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", salt: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(rows, budgets): a slim row for each document with its place in its source, and a row for each source."""
    slim = docs.select(
        docs[f"`{key}`"].alias("id"),
        docs[f"`{source}`"].cast("string").alias("source"),
        n_words(docs[f"`{text}`"]).alias("size"),
        spread(docs[f"`{key}`"], salt).alias("key"),
    )
    slim = cut(slim)
    # A row for each source.
    budgets = cut(targets(slim).withColumns({"epochs": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")}), 1)
    # Repeated rows share a key: they count as one entry of the order, with their sizes together.
    entries = slim.groupBy("source", "key").agg(F.sum("size").alias("entry"))
    placed = running(entries, ["source"], [], "key", hex_digits(slim.count()), "entry", "before")
    budget = budgets.select(F.col("source").alias("__s"), "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))
    # The cut of a source: the last key whose middle lies within what is left of the budget after whole epochs.
    inside = placed.join(budget, F.col("source").eqNullSafe(F.col("__s"))).filter(F.col("before") * 2 + F.col("entry") <= F.col("rest") * 2)
    last = inside.groupBy("__s").agg(F.max("key").alias("cut_key"))
    budgets = budgets.join(last, budgets["source"].eqNullSafe(last["__s"]), "left").drop("__s")
    return slim, cut(budgets, 1)


def _times(key: Column) -> Column:
    once = F.coalesce(key <= F.col("cut_key"), F.lit(False)).cast("long")
    return F.coalesce(F.col("epochs") + once, F.lit(0))


def mix_report(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", salt: str = "mix") -> DataFrame:
    """One row for each document: key, size, source_size, target and the words that the mix takes of it."""
    slim, budgets = plan(docs, key, source, text, salt)
    b = budgets.withColumnRenamed("source", "__s")
    got = slim.join(b, slim["source"].eqNullSafe(b["__s"]), "left")
    return got.select(
        F.col("id").alias(key), "size", "source_size", "target", (F.col("size") * _times(F.col("key"))).alias("taken"), _times(F.col("key")).alias("times"), "source"
    )


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", salt: str = "mix") -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns. Texts are not shuffled by key:
    a row is decided by its own key and the cut of its source."""
    _, budgets = plan(docs, key, source, text, salt)
    rows = pack(docs, __source=docs[f"`{source}`"].cast("string"), __key=spread(docs[f"`{key}`"], salt))
    b = small(budgets)
    got = rows.join(b, F.col("__source").eqNullSafe(b["source"]))
    times = _times(F.col("__key")).cast("int")
    return got.select("__row", F.explode(F.array_repeat(F.lit(1), times))).select("__row.*")

