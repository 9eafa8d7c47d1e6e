"""Balanced label propagation: shards of even size that keep linked documents together.

Documents with equal texts are linked. Each starts at a random shard; the state is how many members of a group sit at
each shard (at most one row for each group and starting shard, however large the group), and every round joins each
row with its group's strongest shard and moves it there, as far as the shard's quota allows. Which requests get in is
settled by running sums over key ranges of the requests of a shard. A group beyond a shard's quota stays spread.
Documents without links then fill what is left of every shard exactly, so the law ``rows`` holds: counts differ by one
at most.

Only slim rows (id, size, digest, key) are shuffled, never texts. Null texts have no bytes and are linked with each
other; repeated rows are documents of their own. An empty table gives no rows. Reruns agree but for which of
several fully equal rows gets which slot.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freshet.llm.common import cut, hex_digits, pack, running, spread

SHARDS = 40
OVERHEAD = 16
ROUNDS = 4


def _start(key: Column, shards: int) -> Column:
    return (F.conv(F.substring(key, 9, 7), 16, 10).cast("long") % shards).cast("int")


def slim_rows(docs: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    t = docs[f"`{text}`"]
    return docs.select(
        docs[f"`{key}`"].alias("id"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(t, "UTF-8")).cast("long").alias("text_crc32"),
        F.sha2(F.encode(F.coalesce(t, F.lit("\u0000null")), "UTF-8"), 256).alias("group"),
        spread(docs[f"`{key}`"], "shard").alias("key"),
    ).withColumn("start", _start(F.col("key"), shards))


def propagate(state: DataFrame, quota: int, rounds: int = ROUNDS) -> DataFrame:
    """state: (group, start, label, n). Moves rows to their group's strongest shard while shards have room.

    A round: (1) a group's strongest shard is the one with most members, then the lowest number; (2) rows elsewhere ask to move
    there; (3) in the order of a random key, requests enter while their running count fits into the shard's room.
    Room counts what stays at the shard, so no round can push a shard past its quota.
    """
    most = state.count()
    for r in range(rounds):
        held = state.groupBy("group", "label").agg(F.sum("n").alias("held"))
        best = held.groupBy("group").agg(F.max(F.struct(F.col("held"), (-F.col("label")).alias("neg"))).alias("b")).select("group", (-F.col("b.neg")).alias("to"))
        asked = state.join(best, "group").withColumn("key", F.md5(F.concat_ws(":", F.lit(str(r)), "group", "start")))
        load = asked.groupBy("label").agg(F.sum("n").alias("load"))
        asking = asked.filter("label <> to")
        n = asking.count()
        if not n:
            break
        placed = running(asking, ["to"], ["group", "start"], "key", hex_digits(n), "n", "ahead")
        # A row for each shard: small enough to broadcast, whatever the corpus.
        room = load.select(F.col("label").alias("__l"), (F.lit(quota) - F.col("load")).alias("room"))
        enters = F.col("ahead") + F.col("n") <= F.coalesce(F.col("room"), F.lit(quota))
        moved = placed.join(F.broadcast(room), F.col("to") == F.col("__l"), "left").select(
            "group", "start", F.when(enters, F.col("to")).otherwise(F.col("label")).alias("label"), "n"
        )
        state = cut(asked.filter("label = to").select("group", "start", "label", "n").unionByName(moved), most, 64)
    return state


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One slim row for each document: id, size, text_crc32, shard, slot."""
    rows = cut(slim_rows(docs, key, text, shards))
    total = rows.count()
    quota = total // shards
    # Written first: both sides of the join are then dealt anew, and Spark can split a large group's partition.
    groups = cut(rows.groupBy("group").agg(F.count("*").alias("members")).filter("members > 1"), total // 2, 72)
    marked = cut(rows.join(groups, "group", "left"))
    linked = marked.filter("members is not null")
    state = linked.groupBy("group", "start").agg(F.count("*").alias("n")).withColumn("label", F.col("start"))
    # Random starts alone could overfill a shard; what doesn't fit at first is treated like a document without links.
    state = state.withColumn("key", F.md5(F.concat_ws(":", "group", "start")))
    state = running(state, ["label"], ["group", "start"], "key", hex_digits(total), "n", "ahead")
    state = cut(state.filter(F.col("ahead") + F.col("n") <= quota).select("group", "start", "label", "n"), total, 64)
    state = propagate(state, quota, rounds)
    placed = marked.join(state.select("group", "start", "label"), ["group", "start"], "left")
    placed = cut(placed.select("id", "size", "text_crc32", "key", "label"), total, 64)
    # What is left of every shard, as intervals of the order of all documents without a place: one number a shard.
    load = {r["label"]: r["n"] for r in placed.filter("label is not null").groupBy("label").agg(F.count("*").alias("n")).collect()}
    bounds, at = [], 0
    for s in range(shards):
        at += quota + (s < total % shards) - load.get(s, 0)
        bounds.append(at)
    free = placed.filter("label is null").withColumns({"one": F.lit(1), "all": F.lit(0)})
    free = running(free, ["all"], ["id", "size", "text_crc32"], "key", hex_digits(total), "one", "rank")
    ends = F.array(*[F.lit(b).cast("long") for b in bounds])
    free = free.withColumn("label", F.size(F.filter(ends, lambda e: e <= F.col("rank"))).cast("int"))
    whole = free.select("id", "size", "text_crc32", "key", "label").unionByName(placed.filter("label is not null"))
    # A fresh key: documents without links came to their shard by intervals of the old one.
    whole = whole.withColumns({"one": F.lit(1), "__again": F.md5("key")})
    per_shard = hex_digits(max(1, total // shards))
    slots = running(whole, ["label"], ["id", "size", "text_crc32"], "__again", per_shard, "one", "slot")
    return slots.select("id", "size", "text_crc32", F.col("label").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), "key")


def shard_report(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    got = assign(docs, key, text, shards)
    return got.select(
        F.col("id").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """The documents with ``shard`` and ``slot`` beside their own columns; where a column of theirs has that name, the new one
    gets the next free number at its end (shard_2).

    Repeated rows (same id and text) share their places in a list and take one each. Texts are shuffled once.
    """
    t = docs[f"`{text}`"]
    rows = pack(
        docs,
        __key=spread(docs[f"`{key}`"], "shard"),
        __crc=F.crc32(F.encode(t, "UTF-8")).cast("long"),
        __size=(F.coalesce(F.octet_length(t), F.lit(0)) + OVERHEAD).cast("long"),
    )
    at = assign(docs, key, text, shards).groupBy("key", "text_crc32", "size").agg(F.sort_array(F.collect_list(F.struct("shard", "slot"))).alias("places"))
    on = (F.col("__key") == F.col("key")) & F.col("__crc").eqNullSafe(F.col("text_crc32")) & (F.col("__size") == F.col("size"))
    copy = F.row_number().over(Window.partitionBy("__key", "__crc", "__size").orderBy("__key"))
    got = rows.join(at, on).withColumn("__at", F.element_at("places", copy))
    taken = {c.lower() for c in docs.columns}
    name = lambda c: next(x for x in itertools.chain([c], (f"{c}_{k}" for k in itertools.count(2))) if x not in taken)
    return got.select("__row.*", *[F.col(f"__at.{c}").alias(name(c)) for c in ("shard", "slot")])


def cut_edges(shards: DataFrame) -> DataFrame:
    """Per text: in how many shards its copies sit, as a distribution (the quantity that propagation brings down)."""
    spreads = shards.groupBy("text_crc32", "size").agg(F.count("*").alias("copies"), F.countDistinct("shard").alias("n_shards"))
    return spreads.filter("copies > 1").groupBy("n_shards").agg(F.count("*").alias("groups"), F.sum("copies").alias("documents"))
