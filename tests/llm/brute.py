"""Plain versions of what the corpus operators compute, for small inputs."""

import collections
import hashlib
import math
import zlib

from freshet.llm import decontam


def shards(rows, n_shards, rounds):
    """rows (id, text) -> (id, shard, slot) in the order of the rows; fully equal rows take their places in turn."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    docs = []
    for i, t in rows:
        key = md5("shard:" + ("" if i is None else str(i)))
        group = hashlib.sha256(("\0null" if t is None else t).encode()).hexdigest()
        docs.append({"id": i, "size": len((t or "").encode()) + 16, "crc": -1 if t is None else zlib.crc32(t.encode()), "key": key, "group": group, "start": int(key[8:15], 16) % n_shards})
    quota = len(docs) // n_shards
    members = collections.Counter(d["group"] for d in docs)
    state = collections.Counter((d["group"], d["start"]) for d in docs if members[d["group"]] > 1)
    label, ahead = {}, collections.Counter()
    for g, s in sorted(state, key=lambda x: (md5(f"{x[0]}:{x[1]}"), x)):
        if ahead[s] + state[g, s] <= quota:
            label[g, s] = s
        ahead[s] += state[g, s]
    for r in range(rounds):
        held = collections.Counter()
        for (g, s), at in label.items():
            held[g, at] += state[g, s]
        best = {}
        for (g, at), n in held.items():
            best[g] = max(best.get(g, (0, 1)), (n, -at))
        load = collections.Counter()
        for k, at in label.items():
            load[at] += state[k]
        asking = sorted((k for k, at in label.items() if at != -best[k[0]][1]), key=lambda x: (md5(f"{r}:{x[0]}:{x[1]}"), x))
        if not asking:
            break
        moved, ahead = {}, collections.Counter()
        for k in asking:
            to = -best[k[0]][1]
            if ahead[to] + state[k] <= quota - load[to]:
                moved[k] = to
            ahead[to] += state[k]
        label |= moved
    for d in docs:
        d["shard"] = label.get((d["group"], d["start"])) if members[d["group"]] > 1 else None
    load = collections.Counter(d["shard"] for d in docs if d["shard"] is not None)
    bounds, at = [], 0
    for s in range(n_shards):
        at += quota + (s < len(docs) % n_shards) - load[s]
        bounds.append(at)
    order = lambda k: lambda d: (k(d), (d["id"] is not None, d["id"] or 0), d["size"], d["crc"])
    for rank, d in enumerate(sorted((d for d in docs if d["shard"] is None), key=order(lambda d: d["key"]))):
        d["shard"] = sum(b <= rank for b in bounds)
    slot = collections.Counter()
    for d in sorted(docs, key=order(lambda d: md5(d["key"]))):
        d["slot"] = slot[d["shard"]]
        slot[d["shard"]] += 1
    return [(d["id"], d["shard"], d["slot"]) for d in docs]


def leaks(rows, items):
    """id -> the items that its text holds, by looking at every pair: a pair is only passed over where the text lacks more of the
    item's words than edits are allowed."""
    found = {}
    want = {i: decontam.words(t) for i, t in items if t and len(decontam.words(t))}
    for d, t in rows:
        h = decontam.words(t or "")
        have, held = set(h.tolist()), set()
        for i, w in want.items():
            spare = decontam.edits_allowed(len(w))
            if sum(x not in have for x in w.tolist()) <= spare and decontam.nearest(w, h) <= spare:
                held.add(i)
        found[d] = held
    return found


def language(pages, langs, prior_pages, million):
    """id -> (language, confidence) from (id, host, suffix, declared, text posteriors): Bayes over priors that leave the page itself out."""
    n = len(langs)
    sums = [collections.defaultdict(lambda: [0] * n) for _ in range(3)]
    for _, host, suffix, declared, text in pages:
        for table, key in zip(sums, (host, suffix, declared), strict=True):
            if key is not None:
                table[key] = [a + b for a, b in zip(table[key], text, strict=True)]
    by_host, by_suffix, by_declared = sums
    whole = [sum(v[k] for v in by_suffix.values()) for k in range(n)]
    everyone = [(x + million) / (sum(whole) + n * million) for x in whole]

    def prior(own, wider):
        return [(x + prior_pages * million * w) / (sum(own) + prior_pages * million) for x, w in zip(own, wider, strict=True)]

    out = {}
    for i, host, suffix, declared, text in pages:
        less = lambda v, text=text: [max(0, a - b) for a, b in zip(v, text, strict=True)]
        p = prior(less(by_host[host]), prior(less(by_suffix[suffix]), everyone))
        says = [1.0] * n if declared is None else [(a + million) / (w + million * max(1, len(by_declared))) for a, w in zip(less(by_declared[declared]), whole, strict=True)]
        weight = [max(t, 1) * a * b for t, a, b in zip(text, p, says, strict=True)]
        top = max(weight)
        out[i] = (langs[weight.index(top)], top / math.fsum(weight))
    return out
