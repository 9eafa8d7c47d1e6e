"""Benchmark decontamination by CGK embedding and bit sampling, with exact edit verification.

Texts and benchmark items are words (letters and digits of any script, A-Z lowered; punctuation only parts words). A document
holds an item if some stretch of it is within ``floor((1 - similarity) * words)`` word edits of the item.

The random walk of Chakraborty, Goldenberg and Koucky copies a word sequence step by step, going on to the next word or
staying by a random bit of (step, word). Sequences a few edits apart fall into step again after each edit, so edit distance
becomes Hamming distance of what the walks write. Each repetition draws a walk and a few of its steps; items are filed
under what they write there. Windows of an item's length begin at every word of every text, and one is a candidate if it
writes the same at all of them; it leaves the walk at the first sampled step where no item agrees. Windows with too few
words of any item of that length to be near one are never walked, which loses nothing. Items longer than SEGMENT words are
searched as segments of about that length: a text near the whole is near one of them at least. A segment only proposes a
place; the whole item is compared there. Items of fewer than MIN_WORDS words are searched exactly, under all ways to edit them.

Benchmarks are searched in blocks of bounded size (BLOCK_ITEMS, BLOCK_BYTES), each sent to the executors once, so the
benchmark may have any size. Documents are never shuffled. Null texts and empty tables have no leaks; a null item or one without
words is no item; repeated rows get the same answer each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import vec
from freshet.llm.common import short_batches

SIMILARITY = 0.8
#: How often a sampled step agrees between an item and a stretch at the allowed distance (measured in tests), and the
#: recall wanted there. A class of more items samples more steps, so that chance agreement stays rare, and repeats more.
AGREE = 0.59
RECALL = 0.995
MIN_WORDS = 8
SEGMENT = 60
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20
CHUNK = 2 << 20

_PAD = np.uint64(0)
_PUNCTUATION = np.zeros(256, bool)
for _b in range(33, 127):
    _PUNCTUATION[_b] = not chr(_b).isalnum()


def words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return vec.words(data, np.array([0, len(data)]), _PUNCTUATION)[0]


def edits_allowed(n: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * n + 1e-9)


def nearest(item: np.ndarray, text: np.ndarray) -> int:
    """Fewest edits between the item and any stretch of the text (bit-parallel dynamic programming)."""
    m = len(item)
    at: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, m
    for w in text.tolist():
        eq = at.get(w, 0)
        x = eq | down
        d = ((((x & up) + up) ^ up) | x) & full
        rise = down | (~(d | up) & full)
        fall = up & d
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        best = min(best, score)
        rise = (rise << 1) & full
        fall = (fall << 1) & full
        up = fall | (~(d | rise) & full)
        down = rise & d
    return best


def nearer(a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether (edits, words) of one hit is a smaller share than another's; at equal shares, fewer edits."""
    return (a[0] * b[1], a[0]) < (b[0] * a[1], b[0])


def plan(n_items: int, recall: float = RECALL) -> tuple[int, int]:
    """(sampled steps, repetitions) for a class of so many items."""
    k = 2 if n_items <= 100 else 3 if n_items <= 2000 else 4
    return k, math.ceil(math.log(1 - recall) / math.log(1 - AGREE**k))


class Walk:
    """One repetition for one class of lengths: which steps are sampled, and what each item writes there."""

    def __init__(self, items: list[np.ndarray], which: list[int], steps: int, repeat: int, sampled: int):
        rng = np.random.default_rng([991, repeat, steps])
        self.repeat = repeat
        self.steps = np.sort(rng.choice(steps, min(sampled, steps), replace=False))
        h = np.concatenate([x for i in which for x in (items[i], [_PAD])]).astype(np.uint64)
        starts = np.cumsum([0, *(len(items[i]) + 1 for i in which[:-1])])
        self.tables = []
        key = np.zeros(len(which), np.uint64)
        x, j, bits = starts.astype(np.int64), 0, {}
        for s in self.steps:
            while j < s:
                x = x + step_bits(h, repeat, j, bits)[x]
                j += 1
            key = vec.mix(key * np.uint64(3) + h[x])
            self.tables.append(np.unique(key))
        order = np.argsort(key, kind="stable")
        self.keys, self.items = key[order], np.array(which)[order]


def step_bits(h: np.ndarray, repeat: int, j: int, kept: dict) -> np.ndarray:
    """The random bit of step j for each word; a pad never moves on."""
    block = (repeat, j // 64)
    if block not in kept:
        r = vec.mix(h + np.uint64((repeat * 1_000_003 + j // 64 * 7919 + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        r[h == _PAD] = 0
        kept[block] = r
    return ((kept[block] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)


def _walk_on(h, x, repeat, a, b, kept):
    for j in range(a, b):
        block = (repeat, j // 64)
        if block not in kept:
            step_bits(h, repeat, j, kept)
        x = x + ((kept[block][x] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
    return x


def ways(item: tuple, edits: int) -> dict[tuple, int]:
    """Every sequence that so many edits make of the item, with its fewest edits; None stands for any word."""
    found = {item: 0}
    front = [item]
    for n in range(1, edits + 1):
        made = []
        for x in front:
            for k in range(len(x)):
                made += [x[:k] + x[k + 1 :], x[:k] + (None,) + x[k + 1 :]]
            made += [x[:k] + (None,) + x[k:] for k in range(1, len(x))]
        front = []
        for x in made:
            # Any word at an end costs as much as none there, and asks more of the text.
            while x and x[0] is None:
                x = x[1:]
            while x and x[-1] is None:
                x = x[:-1]
            if x and x not in found:
                found[x] = n
                front.append(x)
    return found


class Short:
    """Items of a few words, found exactly: whatever their edits make of them is looked up at every word of a text."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], similarity: float):
        shapes: dict[tuple, list] = {}
        for i, h in items:
            for x, d in ways(tuple(h.tolist()), edits_allowed(len(h), similarity)).items():
                shapes.setdefault(tuple(w is not None for w in x), []).append(([w or 0 for w in x], d, i, len(h)))
        self.shapes = []
        for shape, rows in shapes.items():
            made = np.array([r[0] for r in rows], np.uint64)
            key, tables = np.zeros(len(rows), np.uint64), []
            for j, fixed in enumerate(shape):
                if fixed:
                    key = vec.mix(key * np.uint64(3) + made[:, j])
                    tables.append(np.unique(key))
            order = np.argsort(key, kind="stable")
            self.shapes.append((shape, tables, key[order], [rows[k][1:] for k in order.tolist()]))

    def search(self, h: np.ndarray, row_of: np.ndarray, found: dict) -> None:
        every = np.flatnonzero(h != _PAD)
        for shape, tables, keys, hits in self.shapes:
            p, key, t = every, np.zeros(len(every), np.uint64), 0
            for j, fixed in enumerate(shape):
                w = h[np.minimum(p + j, len(h) - 1)]  # the last is a pad
                if fixed:
                    key = vec.mix(key * np.uint64(3) + w)
                    k = np.searchsorted(tables[t], key)
                    k[k == len(tables[t])] = 0
                    on = (tables[t][k] == key) & (w != _PAD)
                    t += 1
                else:
                    on = w != _PAD
                p, key = p[on], key[on]
                if not len(p):
                    break
            if not len(p):
                continue
            at = np.unique(np.stack([row_of[p], np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")]), axis=1)
            for r, a, b in at.T.tolist():
                for d, i, n in hits[a:b]:
                    _hold(found, r, i, (d, n))


def _hold(found: dict, r: int, i: int | None, hit: tuple[int, int]) -> None:
    held = found.setdefault(r, {})
    if i not in held or nearer(hit, held[i]):
        held[i] = hit


class Index:
    """Items by classes of length, ready to search texts."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, recall: float = RECALL):
        self.similarity = similarity
        self.ids, self.items, self.wholes = [], [], []
        short = []
        for i, text in sorted(items, key=lambda x: (x[0] is None, x[0])):
            h = words(text or "")
            if len(h) < MIN_WORDS:
                if len(h):
                    short.append((i, h))
                continue
            parts = max(1, round(len(h) / SEGMENT)) if len(h) > SEGMENT * 1.3 else 1
            at, first = 0, len(self.items)
            for p in np.array_split(h, parts):
                self.ids.append(i)
                self.items.append(p)
                self.wholes.append((first, at, h) if parts > 1 else None)
                at += len(p)
        self.short = Short(short, similarity)
        self.vocab = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.items]))
        self.classes = []
        lengths = np.array([len(x) for x in self.items])
        lo = MIN_WORDS
        while len(lengths) and lo <= lengths.max():
            hi = max(lo, int(lo * 1.12))
            which = np.flatnonzero((lengths >= lo) & (lengths <= hi)).tolist()
            if which:
                member = np.zeros(len(self.vocab) + 1, bool)
                for i in which:
                    member[np.searchsorted(self.vocab, self.items[i])] = True
                sampled, repeats = plan(len(which), recall)
                walks = [Walk(self.items, which, int(1.7 * lo), r, sampled) for r in range(repeats)]
                self.classes.append((lo, hi, lo - edits_allowed(lo, similarity), member, walks))
            lo = hi + 1

    def search(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, dict[int, tuple[int, int]]]:
        """row -> item id -> (edits, words of the item), for every item that the row's text holds."""
        w, row = vec.words(data, offsets, _PUNCTUATION)
        if not len(w) or not (self.classes or self.short.shapes):
            return {}
        n_rows = len(offsets) - 1
        h = np.full(len(w) + n_rows, _PAD)
        at = np.arange(len(w)) + row
        h[at] = w
        row_of = np.zeros(len(h), np.int64)
        row_of[at] = row
        ends = np.searchsorted(row, np.arange(n_rows), "right") + np.arange(n_rows)  # the pad of each row
        row_of[ends] = np.arange(n_rows)
        starts = np.concatenate([[0], ends[:-1] + 1])
        found: dict[int, dict[int, tuple[int, int]]] = {}
        self.short.search(h, row_of, found)
        if not self.classes:
            return found
        vid = np.searchsorted(self.vocab, h)
        vid[vid == len(self.vocab)] = 0
        vid[self.vocab[vid] != h] = len(self.vocab)
        tried: set[tuple[int, int, int]] = set()
        settled: set[tuple[int, int, int]] = set()
        bits: dict = {}
        for _lo, hi, need, member, walks in self.classes:
            known = np.concatenate([[0], np.cumsum(member[vid])])
            here = np.flatnonzero(known[np.minimum(np.arange(len(h)) + hi, ends[row_of])] - known[:-1] >= need)
            here = here[h[here] != _PAD]
            if not len(here):
                continue
            for walk in walks:
                p, x, key, j = here, here, np.zeros(len(here), np.uint64), 0
                for s, table in zip(walk.steps, walk.tables, strict=True):
                    x = _walk_on(h, x, walk.repeat, j, s, bits)
                    j = s
                    key = vec.mix(key * np.uint64(3) + h[x])
                    k = np.searchsorted(table, key)
                    k[k == len(table)] = 0
                    on = table[k] == key
                    p, x, key = p[on], x[on], key[on]
                    if not len(p):
                        break
                if not len(p):
                    continue
                a, b = np.searchsorted(walk.keys, key, "left"), np.searchsorted(walk.keys, key, "right")
                for q, u, v in zip(p.tolist(), a.tolist(), b.tolist(), strict=True):
                    r = int(row_of[q])
                    for i in walk.items[u:v].tolist():
                        item = self.items[i]
                        spare = edits_allowed(len(item), self.similarity)
                        # One look settles all starts nearby: the stretch reaches as far again as the edits allow.
                        if (r, i, q // (spare + 1)) in tried:
                            continue
                        tried.add((r, i, q // (spare + 1)))
                        text = h[max(starts[r], q - 2 * spare - 1) : min(ends[r], q + len(item) + 2 * spare + 1)]
                        d = nearest(item, text)
                        if d > spare:
                            continue
                        if self.wholes[i]:
                            first, offset, item = self.wholes[i]
                            more = edits_allowed(len(item), self.similarity)
                            start = q - offset
                            if (r, first, start // (more + 1)) in settled:
                                continue
                            settled.add((r, first, start // (more + 1)))
                            slack = 2 * (more + spare) + 1
                            d, spare = nearest(item, h[max(starts[r], start - slack) : min(ends[r], start + len(item) + slack)]), more
                        if d <= spare:
                            _hold(found, r, self.ids[i], (d, len(item)))
        return found


def blocks(bench: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items, gathered in blocks whose size is bounded."""
    rows = bench.select(bench[f"`{key}`"].cast("long").alias("id"), bench[f"`{text}`"].alias("text")).filter("text is not null").distinct()
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for b in range(parts):
        part = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == b)
        yield [(r.id, r.text) for r in part.toLocalIterator()]


def _hits(index, column: pa.Array) -> dict:
    found = {}
    for at, data, offsets in vec.chunks(column, CHUNK):
        found |= {at + r: x for r, x in index.search(data, offsets).items()}
    return found


ITEMS = "array<struct<item_id: long, edits: int, words: int>>"


def _report(shared):
    """One pass over the rows: the block's hits join those that earlier blocks left in the row."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _hits(shared.value, b.column(1))
            items = []
            for r, before in enumerate(b.column(2).to_pylist()):
                held = {x["item_id"]: (x["edits"], x["words"]) for x in before}
                for i, hit in found.get(r, {}).items():
                    if i not in held or nearer(hit, held[i]):
                        held[i] = hit
                items.append([{"item_id": i, "edits": d, "words": n} for i, (d, n) in sorted(held.items(), key=lambda x: (x[0] is None, x[0]))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(items, kind)], ["id", "text", "items"])

    return run


def find(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, items): one row for each document, with the items that it holds; each block is one more pass over the rows.

    Documents' keys may be of any type; items' keys are whole numbers.
    """
    sc = docs.sparkSession.sparkContext
    short_batches(docs.sparkSession)
    none = F.array().cast(ITEMS).alias("items")
    rows = docs.select(docs[f"`{key}`"].alias("id"), docs[f"`{text}`"].cast("string").alias("text"), none)
    for block in blocks(bench, item_key, item_text):
        rows = rows.mapInArrow(_report(sc.broadcast(Index(block))), rows.schema)
    return rows.select("id", "items")


def report(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id") -> DataFrame:
    """One row for each document: key, contaminated, n_items, item_ids, least edits and the words of that item."""
    got = find(docs, bench, key, text, item_key)
    best = F.array_min(F.transform("items", lambda x: F.struct((x["edits"] / x["words"]).alias("share"), x["edits"].alias("edits"), x["words"].alias("words"))))
    got = got.withColumn("best", best)
    return got.select(
        F.col("id").alias(key),
        (F.size("items") > 0).alias("contaminated"),
        F.size("items").cast("long").alias("n_items"),
        F.transform("items", lambda x: x["item_id"]).alias("item_ids"),
        F.col("best.edits").alias("edits"),
        F.col("best.words").alias("item_words"),
    )


def keep(docs: DataFrame, bench: DataFrame, text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The documents that hold no item, as they came; each block of the benchmark is one more pass over the rows."""
    sc = docs.sparkSession.sparkContext
    short_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def clean(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = _hits(shared.value, b.column(at))
                yield b.filter(pa.array([r not in found for r in range(len(b))], pa.bool_()))

        return run

    for block in blocks(bench, item_key, "text"):
        docs = docs.mapInArrow(clean(sc.broadcast(Index(block))), docs.schema)
    return docs
