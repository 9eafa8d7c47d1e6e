"""Near-duplicates by HyperMinHash.

Every text's word shingles become a sketch: for each of BUCKETS hash functions the smallest hash is stored as its count
of leading zeros and MANTISSA further bits, two bytes in all. (Each bucket has a hash function of its own rather than a
share of one function's range, so that texts of a few words fill every bucket as well.) Texts with the same shingle
set are one class from here on, so copies cost nothing. Bands of compressed registers name the buckets in which classes
meet:

1. Star: in every band bucket each class is paired with the bucket's smallest; pairs that meet in two bands or more go on.
2. Pairs pass the collision-corrected Jaccard estimate of their sketches (five standard deviations below the threshold
   are let through) and then the exact test on their full shingle sets. Confirmed links give components.
3. Only in buckets whose members are still in several components, members of different components are compared, inside
   blocks of bounded size (every pair of blocks meets once; a pair counts in the first band that its texts share). What
   leaves a task are, from crowded buckets, whose members bring their sets, confirmed links that join components (fewer
   than members), and from small ones likely pairs, which go through step 2.

So no link is lost to the choice of stars, and a bucket full of near copies is never written out as all its pairs. Two texts at
exactly the threshold share no band with probability (1 - 0.8**6)**54, about 7e-8.

Null, empty and blank texts have no shingles and are linked with nothing, nor are rows with a null key, which no link could
name; all of them are kept. Keys are whole numbers, since the smallest names a component, and expected to be unique; rows repeated as a whole share their result. An empty table gives no rows. Sketching is vectorised Python (free style); joins and aggregations are
Spark's, on slim rows; full sets are rebuilt from the texts of candidates only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import vec
from freshet.llm.common import cut, drop_cut, short_batches, small

BANDS = 54
ROWS = 6
BUCKETS = BANDS * ROWS
MANTISSA = 10
#: Members of a block, when a bucket is compared inside, and bytes of their sketches and sets.
BLOCK = 2048
BLOCK_BYTES = 4 << 20
#: Buckets of so many members or more are compared on full sets inside their blocks, smaller ones on sketches first.
CROWD = 16

_rng = np.random.default_rng(977)
_FLIP = _rng.integers(0, 1 << 32, BUCKETS, dtype=np.uint64).astype(np.uint32)[:, None]
_TIMES = (_rng.integers(0, 1 << 31, BUCKETS, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_BAND = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(shingles: np.ndarray) -> np.ndarray:
    """uint16 for each bucket: leading zeros of the smallest 32-bit hash, then the bits after its first one."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BUCKETS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 2048):
        np.minimum(least, ((x[None, a : a + 2048] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    exponent = np.frexp(least.astype(np.float64))[1]  # 0 for 0, else bits used
    zeros = (32 - exponent).astype(np.uint64)
    rest = ((least.astype(np.uint64) << (zeros + np.uint64(1))) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | rest).astype(np.uint16)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The probability that independent minima of n and of m hashes give the same register."""
    edges = 2.0 ** -np.arange(34)
    edges[-1] = 0.0

    def within(k: np.ndarray) -> np.ndarray:
        over = (1.0 - edges[None, :]) ** k[:, None].astype(float)  # smallest above the edge
        return over[:, 1:] - over[:, :-1]

    return (within(n) * within(m)).sum(axis=1) / 2**MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of sketches (rows of a and b) of sets of n and m shingles, corrected for chance collisions."""
    c = chance(n, m)
    return ((a == b).mean(axis=1) - c) / (1.0 - c)


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            for at, data, offsets in vec.chunks(text):
                rows = len(offsets) - 1
                sets = vec.shingles(*vec.words(data, offsets), k, rows)
                digest = []
                for s in sets:  # two sums of remixed elements: the set's identity in 128 bits
                    digest.append(vec.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).tobytes() + vec.mix(s + np.uint64(0x1234567F)).sum(dtype=np.uint64).tobytes())
                regs = [registers(s).tobytes() if len(s) else None for s in sets]
                n = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(at, rows), n, pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], ["id", "n", "digest", "regs"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in vec.chunks(batch.column(1)):
                rows = len(offsets) - 1
                sets = [s.tobytes() for s in vec.shingles(*vec.words(data, offsets), k, rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, rows), pa.array(sets, pa.binary())], ["id", "set"])

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, len(batch), 2000):
            part = batch.slice(a, 2000)
            regs = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            keys = vec.mix((regs * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), *(pa.array(np.repeat(part.column(i).to_numpy(zero_copy_only=False), BANDS)) for i in (0, 1))], ["key", "id", "n"]
            )


def _likely(threshold: float):
    least = threshold - 5 * (threshold * (1 - threshold) / BUCKETS) ** 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 5000):
                part = batch.slice(at, 5000)
                a, b = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint16).reshape(-1, BUCKETS) for i in (4, 5))
                ok = estimate(a, b, part.column(2).to_numpy(), part.column(3).to_numpy()) >= least
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(ok))

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows with one of the ids. While the list is small, the rows (sketches or whole texts) aren't shuffled for it."""
    return rows.join(small(ids), "id", "left_semi")


def confirm(pairs: DataFrame, classes: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) that pass the estimate and then the exact test. texts: (id, text)."""
    n = pairs.count()
    named = lambda df: cut(df.select(F.explode(F.array("a", "b")).alias("id")).distinct(), 2 * n, 16)
    sketches = _only(classes.select("id", "n", "regs"), named(pairs))
    one = lambda s: sketches.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("regs").alias(f"r_{s}"))
    sketched = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")
    likely = cut(sketched.mapInArrow(_likely(threshold), "a long, b long"), n, 32 * BUCKETS)  # a pair costs far more than its row
    sets = cut(_only(texts, named(likely)).mapInArrow(_sets(k), "id long, set binary"))
    # Rows repeated as a whole would double a pair; links are made distinct below.
    s = lambda x: sets.select(F.col("id").alias(x), F.col("set").alias(f"s_{x}"))
    full = likely.join(s("a"), "a").join(s("b"), "b").select("a", "b", "s_a", "s_b")
    links = cut(full.mapInArrow(_confirm(round(100 * threshold)), "a long, b long").distinct(), n)
    drop_cut(sets)
    drop_cut(likely)
    return links


def components(links: DataFrame) -> DataFrame:
    """(id, component): each linked id's smallest reachable id, by alternating stars; ids without links are absent.

    Large star: every larger neighbour of u is linked to the smallest of u and its neighbours. Small star: u and its smaller
    neighbours are linked to the smallest of them. Both keep components; the edges end as stars. Minima are aggregated and
    written before they are joined back, by broadcast while they are few, else as two shuffled sides, so that a hub with a
    third of all edges is a skewed partition that Spark can split.
    """
    n = links.count()  # neither star adds edges
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), n)
    seen = None
    while True:
        sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * n)
        large = sym.join(small(low), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, 2 * n)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), 2 * n)
        joined = large.join(small(least), "u")
        stars = joined.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select("e.u", F.col("e.m").alias("v")).filter("u <> v").distinct()
        new = cut(stars, 2 * n)
        for x in (edges, low, large, least):
            drop_cut(x)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        seen = now


def _open(members: DataFrame, known: DataFrame) -> DataFrame:
    """(key, id, n, comp): the members of buckets that hold more than one component."""
    at = cut(members.join(small(known), "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("comp")))
    several = cut(at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key"), at.count() // 2, 16)
    return cut(at.join(small(several), "key"))


def _band_keys(regs: np.ndarray) -> np.ndarray:
    return vec.mix((regs.reshape(-1, BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _compare(threshold: float):
    percent = round(100 * threshold)
    least = threshold - 5 * (threshold * (1 - threshold) / BUCKETS) ** 0.5

    def run(table: pa.Table) -> pa.Table:
        """Pairs of a bucket's two blocks (or of one block with itself) from different components: near ones where the sets
        are there, else likely ones."""
        key, first, second = (table.column(c)[0].as_py() for c in ("key", "i", "j"))
        ids, n, comp, own = (table.column(c).to_numpy() for c in ("id", "n", "comp", "own"))
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        keys = _band_keys(regs)
        band = int(np.argmax(keys[0] == key))
        sets = None
        if table.column("set").null_count == 0:
            flat, ends = np.frombuffer(b"".join(table.column("set").to_pylist()), np.uint64), np.cumsum(n)
            vocab, flat = np.unique(flat, return_inverse=True)
            sets = np.split(flat, ends[:-1])
            mark = np.zeros(len(vocab), bool)
        right = np.flatnonzero(own == second)
        got_a, got_b = [], []
        root = {c: c for c in comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for x in np.flatnonzero(own == first).tolist():
            y = right[(ids[right] > ids[x]) if first == second else (ids[right] != ids[x])]
            y = y[(comp[y] != comp[x]) & (100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x]))]
            y = y[~(keys[y, :band] == keys[x, :band]).any(axis=1)]
            y = y[(regs[y] == regs[x]).mean(axis=1) >= least]  # before the correction for chance, so never too strict
            if len(y) and sets is not None:
                mark[sets[x]] = True
                both = np.add.reduceat(mark[np.concatenate([sets[k] for k in y])], np.cumsum([0, *n[y[:-1]]]), dtype=np.int64)
                mark[sets[x]] = False
                joins = []
                for z in y[100 * both >= percent * (n[y] + n[x] - both)].tolist():
                    a, b = find(int(comp[x])), find(int(comp[z]))
                    if a != b:  # a link inside a component of this block adds nothing
                        root[max(a, b)] = min(a, b)
                        joins.append(z)
                y = np.array(joins, np.int64)
            if len(y):
                got_a.append(np.minimum(ids[y], ids[x]))
                got_b.append(np.maximum(ids[y], ids[x]))
        cat = lambda v: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64())
        return pa.table({"a": cat(got_a), "b": cat(got_b), "sure": pa.array(np.full(sum(map(len, got_a)), sets is not None))})

    return run


def _in_blocks(open_: DataFrame, classes: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """(a, b, sure): links or likely pairs between components of the open buckets. A bucket of m members is dealt into blocks of
    about BLOCK members or BLOCK_BYTES, whichever is less, by a hash of the id, and each pair of blocks is one group, so no
    group grows with the bucket or with its texts (a text beyond BLOCK_BYTES is most of a block of its own)."""
    m, size = F.count("*"), F.sum(2 * BUCKETS + F.when(F.col("n") > 0, F.col("n") * 8))
    blocks = F.greatest(F.ceil(m / BLOCK), F.when(m >= CROWD, F.least(F.ceil(size / BLOCK_BYTES), m)).otherwise(1)).cast("int")
    n = open_.count()
    size = small(cut(open_.groupBy("key").agg(blocks.alias("blocks"), (m >= CROWD).alias("crowded")), n // 2))
    rows = cut(open_.join(size, "key"))
    ids = lambda df: cut(df.select("id").distinct(), n, 16)
    crowd = ids(rows.filter("crowded"))
    width = 8 * (rows.filter("crowded").agg(F.avg("n")).first()[0] or 1)
    crowd = cut(_only(texts, crowd).mapInArrow(_sets(k), "id long, set binary").dropDuplicates(["id"]), crowd.count(), int(width) + 16)
    rows = rows.join(_only(classes.select("id", "regs"), ids(rows)), "id")
    rows = rows.filter("not crowded").withColumn("set", F.lit(None).cast("binary")).unionByName(rows.filter("crowded").join(crowd, "id"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "n", "comp", "own", "regs", "set")
    got = cut(rows.groupBy("key", "i", "j").applyInArrow(_compare(threshold), "a long, b long, sure boolean").distinct(), n)
    drop_cut(crowd)
    return got


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row for each document: id, n_shingles, class (smallest id with the same set), component, kept."""
    short_batches(docs.sparkSession)
    texts = docs.select(docs[f"`{key}`"].cast("long").alias("id"), docs[f"`{text}`"].alias("text"))
    sketches = cut(texts.mapInArrow(_sketch(shingle), "id long, n long, digest binary, regs binary"))
    some = sketches.filter("n > 0 and id is not null")
    classes = cut(some.groupBy("digest").agg(F.min(F.struct("id", "n", "regs")).alias("c")).select("digest", "c.*"), sketches.count(), 2 * BUCKETS + 32)

    def sized(a: str, b: str):
        """Sets of these sizes can reach the threshold."""
        percent = round(100 * threshold)
        return (100 * F.least(F.col(a), F.col(b))) >= percent * F.greatest(F.col(a), F.col(b))

    # A set of s shingles can only be near one that shares a shingle; single-shingle sets are settled by their class.
    bands = cut(classes.filter(F.lit(threshold) * (F.col("n") + 1) <= F.col("n")).select("id", "n", "regs").mapInArrow(_bands, "key long, id long, n long"))
    hubs = bands.groupBy("key").agg(F.min(F.struct("id", "n")).alias("h"), F.count("*").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    # A bucket of two whose sizes can't reach the threshold is no meeting.
    hubs = cut(hubs.filter((F.col("c") > 2) | (F.col("c") == 2) & sized("lo", "hi")).select("key", "h"), bands.count() // 2)
    met = cut(bands.join(small(hubs), "key"))  # rows of buckets with company
    drop_cut(bands)
    star = met.filter(F.col("id") != F.col("h.id")).filter(sized("n", "h.n")).select(F.col("h.id").alias("a"), F.col("id").alias("b"))
    star = cut(star.groupBy("a", "b").agg(F.count("*").alias("m")).filter("m > 1").select("a", "b"), met.count() // 2, 16)
    links = confirm(star, classes, texts, shingle, threshold)
    known = cut(components(links), 2 * links.count())
    open_ = _open(met.select("key", "id", "n"), known)
    if not open_.isEmpty():
        got = _in_blocks(open_, classes, texts, shingle, threshold)
        more = got.filter("sure").select("a", "b")
        likely = got.filter("not sure").select("a", "b")
        if not likely.isEmpty():
            more = more.unionByName(confirm(likely, classes, texts, shingle, threshold))
        if not more.isEmpty():
            links = links.unionByName(more)
            known = cut(components(links), 2 * links.count())
    final = small(known.select(F.col("id").alias("class"), "component"))
    mine = sketches.select("id", "n", "digest").join(classes.select("digest", F.col("id").alias("class")), "digest", "left")
    mine = mine.withColumn("class", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("class")).otherwise(F.col("id")))
    got = mine.join(final, "class", "left").withColumn("component", F.coalesce("component", "class"))
    return got.select("id", F.col("n").alias("n_shingles"), "class", "component", F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 2, threshold: float = 0.8) -> DataFrame:
    got = find(docs, key, text, shingle, threshold)
    return got.select(F.col("id").alias(key), "n_shingles", F.col("component").alias("component_id"), "kept", F.col("class").alias("class_id"))


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents without those that have a smaller one in their component; columns as they came."""
    gone = find(docs, key, text, shingle, threshold).filter(~F.col("kept")).select(F.col("id").alias("__gone")).distinct()
    gone = cut(gone)
    return docs.join(small(gone), docs[f"`{key}`"] == F.col("__gone"), "left_anti")
