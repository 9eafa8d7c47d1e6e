"""Personal data: overlapping candidates, boosted trees, calibrated thresholds.

Generators propose spans in every whole text: the strict formats of four kinds, whose valid matches always stand, and far looser
ones that overlap them and each other (written-out addresses, IPv6 in full and shortened, digit groups with any separators,
card-like numbers whatever their check sum, and, as a fifth kind, secrets: long runs of letters and digits). Each candidate
gets features of its format and of the words around it; gradient-boosted trees score it. A loose candidate becomes a span
if its score reaches the threshold of its kind and if it overlaps neither a strict span nor a better loose one.

The trees are fitted on candidates that these same generators and feature expressions cut from TRAIN_TEXTS made-up texts, in which
true and misleading values are planted by rule (the corpus has no labels for spans); each kind's threshold is the lowest
that holds TARGET_PRECISION on further HELD_TEXTS texts. Both are bounded samples that don't depend on the corpus.

All of it is one projection of built-in functions: the trees are compiled to CASE expressions, positions come from the lengths
of what lies between matches, gathered by sweeps whose cost stays near proportion to their number. Nothing is
shuffled and no Python runs on the executors. Every pattern advances with possessive or bounded repetition, so a very long run of
one character costs linear time and no stack. Positions are code points, ends exclusive. A null text is empty and has no spans;
repeated rows get the same spans each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import random
import threading

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm.common import let, pack, sweep

#: Kinds with strict formats, then the one that only the method finds.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")

#: A start inside a run of the same characters can't match where the run's own start doesn't, unless the last match ended there.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HEX = r"[0-9A-Fa-f]{1,4}"
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[(\[{]\x20?at\x20?[)\]}]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[{]\x20?dot\x20?[)\]}]\x20?)[A-Za-z0-9-]++)++"
    r"|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)",
    "ip": rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[\x20._/-]?[0-9]){12,18}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.@-])\+?\(?[0-9]{1,5}\)?(?:[\x20./-]?\(?[0-9]{2,8}\)?){1,5}(?![0-9A-Za-z@])",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,}+={0,2}+(?![A-Za-z0-9])",
}
#: What a text must hold for a kind to be worth a look: a literal, or a pattern.
GATES = {
    "email": r"@|[(\[{]\x20?(?:at|dot)\x20?[)\]}]|\x20dot\x20",
    "ip": r"[0-9]\.[0-9]|::|:[0-9A-Fa-f]{1,4}:",
    "card": "[0-9]",
    "phone": "[0-9]",
    "secret": "[A-Za-z0-9_+/=-]{16}",
}
#: Words that speak for a kind, and words that speak against any, when they stand in the CONTEXT characters before a candidate (and behind the one before it).
CUES = {
    "email": "mail|contact|write|address|reach|contacto|kontakt|correo|courriel",
    "ip": r"\bip|host|server|addr|login|client|network",
    "card": "card|visa|master|credit|debit|payment|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax|cell|whatsapp|anruf|llama|appel",
    "secret": "token|secret|passw|api|key|bearer|auth|credential",
}
AGAINST = r"order|\bref|\bids?\b|isbn|version|commit|checksum|sha|md5|date|page|total|\bno\b|number|uuid|file|image|part|invoice|release|std|rev"
CONTEXT = 32
FEATURES = ("digits", "letters", "separators", "groups", "luhn", "cue", "against", "length", "distinct", "assigned", "digits_near", "repeated", "bracketed")

TRAIN_TEXTS = 1500
HELD_TEXTS = 1500
TARGET_PRECISION = 0.95
ROUNDS = 14
RATE = 0.4
DEPTH = 3

FOUND = "ARRAY<STRUCT<s: INT, e: INT, v: STRING>>"
NEAR = "ARRAY<STRUCT<s: INT, e: INT, v: STRING, pre: STRING, post: STRING>>"
SPAN = "ARRAY<STRUCT<s: INT, e: INT, kind: STRING>>"
#: Spans in the order of a sweep: o is 0 for a strict one, which comes first among those that begin together.
MIXED = "ARRAY<STRUCT<s: INT, o: INT, e: INT, kind: STRING, score: DOUBLE>>"


def positions(text: Column, pattern: str, around: int = 0) -> Column:
    """array<struct<s, e, v>> of the leftmost non-overlapping matches: code points, end exclusive.

    around: how many characters before and after each match come along (``pre``, ``post``), cut from what lies between it and its
    neighbours, so that no text is searched from its start for each match.
    """

    def piece(found: Column, between: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            gap, rest = F.get(between, i), F.get(between, i + 1)
            more = [F.right(gap, F.lit(around)).alias("pre"), F.left(rest, F.lit(around)).alias("post")] if around else []
            return F.struct(F.length(gap).alias("gap"), v.alias("v"), *more)

        return F.transform(found, one)

    def step(at: Column, x: Column) -> Column:
        s = at + x["gap"]
        e = s + F.length(x["v"])
        more = [x[c].alias(c) for c in ("pre", "post")] if around else []
        return F.struct(e.alias("state"), F.array(F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v"), *more)).alias("emit"))

    pairs = let(F.split(text, pattern, -1), lambda between: piece(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), between))
    return sweep(pairs, F.lit(0), step, NEAR if around else FOUND)["out"]


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    each = F.split(F.reverse(digits), "(?!^)(?!$)")
    total = F.aggregate(
        F.transform(
            each,
            lambda d, i: let(F.try_to_number(d, F.lit("9")).cast("int") * (1 + i % 2), lambda n: F.when(n > 9, n - 9).otherwise(n)),
        ),
        F.lit(0),
        lambda a, n: a + n,
    )
    return total % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda q: (F.length(q) <= 3) & (F.lpad(q, 3, "0") <= "255")))
    if kind == "card":
        return luhn(_digits(v))
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return F.lit(True)


def _features(kind: str, x: Column) -> Column:
    """The candidate's features, in the order of FEATURES, as doubles."""
    digits = _digits(x["v"])
    before, after = F.lower(x["pre"]), x["post"]
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    values = {
        "digits": number(F.length(digits)),
        "letters": number(F.length(F.regexp_replace(x["v"], "[^A-Za-z]", ""))),
        "separators": number(F.length(F.regexp_replace(x["v"], "[A-Za-z0-9]", ""))),
        "groups": number(F.size(F.filter(F.split(x["v"], "[^A-Za-z0-9]+"), lambda g: g != ""))),
        "luhn": flag(F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)),
        "cue": flag(before.rlike(CUES[kind])),
        "against": flag(before.rlike(AGAINST)),
        "length": number(x["e"] - x["s"]),
        "distinct": number(F.size(F.array_distinct(F.split(F.substring(x["v"], 1, 64), "")))),
        "assigned": flag(before.rlike("[=:]\\s*[\"']?$")),
        "digits_near": flag(before.rlike("[0-9][\\x20.:/,-]{0,2}$") | after.rlike("^[\\x20.:/,-]?[0-9]")),
        "repeated": flag(digits.rlike(r"([0-9])\1{6}")),
        "bracketed": flag(x["v"].rlike(r"[(\[{]")),
    }
    return F.array(*[values[f] for f in FEATURES])


def _candidates(kind: str, text: Column) -> Column:
    """array<struct<s, e, x>>: what the loose generator of a kind proposes, with features."""
    one = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _features(kind, x).alias("x"))
    return F.transform(positions(text, LOOSE[kind], CONTEXT), one)


# --- the model -----------------------------------------------------------------------------------------------------


def _check_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        n = int(c) * (2 - i % 2)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


class _Writer:
    """Texts with planted values: true ones of each kind, and ones that only look like them."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def some(self, alphabet: str, low: int, high: int | None = None) -> str:
        return "".join(self.r.choices(alphabet, k=self.r.randint(low, high or low)))

    def word(self) -> str:
        return self.some("aeiourstlnmdchp", 2, 9)

    def number(self, low: int, high: int | None = None) -> str:
        return self.some("0123456789", low, high)

    def hexes(self, n: int) -> str:
        return self.some("0123456789abcdef", n)

    def true(self, kind: str) -> tuple[list[str], str]:
        """(words that may lead to it, value)."""
        r, w, n = self.r, self.word, self.number
        if kind == "email":
            a, d = r.choice([(" (at) ", " (dot) "), ("(at)", "."), ("[at]", "."), ("{at}", "{dot}"), (" [at] ", " [dot] "), (" at ", " dot ")])
            return ["email", "mail me at", "contact", "write to", "correo", "kontakt"], f"{w()}{r.choice(['', '.' + w(), n(2)])}{a}{w()}{d}{r.choice(['com', 'org', 'example', 'de'])}"
        if kind == "ip":
            full = [self.some("0123456789abcdef", 1, 4) for _ in range(8)]
            value = ":".join(full) if r.random() < 0.5 else ":".join(full[: r.randint(1, 4)]) + "::" + ":".join(full[: r.randint(1, 3)])
            return ["ip", "host", "server", "login from", "client address", "network"], value
        if kind == "card":
            body = r.choice("3456") + n(r.choice((12, 13, 14, 14, 14, 15)))
            digits = body + _check_digit(body) if r.random() < 0.85 else body + n(1)
            sep = r.choice(["", " ", "-", ".", "."])
            return ["card", "visa", "credit card:", "payment", "karte", "tarjeta"], sep.join(digits[k : k + 4] for k in range(0, len(digits), 4)) if sep else digits
        if kind == "phone":
            sep = r.choice([" ", "-", "."])
            form = r.randrange(4)
            value = [f"({n(3)}) {n(3)}{sep}{n(4)}", f"{n(3)}{sep}{n(3)}{sep}{n(4)}", f"0{n(3)}{r.choice([' ', '/'])}{n(6, 8)}", f"0{n(2)}{sep}{n(2)}{sep}{n(2)}{sep}{n(2)}{sep}{n(2)}"][form]
            return ["phone", "call", "tel", "mobile:", "fax", "whatsapp", "appel", "anruf"], value
        big = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        value = r.choice([self.hexes(r.choice((32, 40, 64))), self.some(big, 20, 44) + n(1), f"sk_{self.some(big, 24)}{n(1)}", "AK" + self.some("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 17) + n(1)])
        lead = r.choice(["token", "secret", "password", "api_key", "auth", "bearer", "access key"]) + r.choice([" = ", "=", ": ", " "])
        return [lead], r.choice(["", "\""]) + value

    def false(self, kind: str) -> tuple[list[str], str]:
        r, w, n = self.r, self.word, self.number
        if kind == "email":
            return ["we", "look", ""], f"{w()}{r.choice([' at ', ' (at) '])}{w()}{r.choice([' dot ', '.'])}{w()} {w()}"
        if kind == "ip":
            return ["std", "rev", "", "see", "id"], r.choice(["::", f"{self.hexes(2)}::", f"::{self.hexes(1)}", ":".join(self.hexes(2) for _ in range(8))])
        if kind == "card":
            return ["order", "ref", "isbn", "number", "date", "id", "total", ""], r.choice([n(16), n(13), n(14), f"{n(4)} {n(4)} {n(4)} {n(4)}", f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", f"20{n(2)}.{n(4)}.{n(4)}.{n(4)}"])
        if kind == "phone":
            day = f"{r.randint(10, 28)}"
            return ["date", "page", "order", "ref", "version", "total", "id", "part", ""], r.choice(
                [f"20{n(2)}-0{n(1)}-{day}", f"{day}.0{n(1)}.20{n(2)}", f"19{n(2)}-20{n(2)}", f"{n(1)} {n(3)} {n(3)}", f"{n(2)}/{n(2)}/{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", n(7, 10), n(4, 6), f"{n(3)}.{n(2)}.{n(3)}"]
            )
        u = [self.hexes(k) for k in (8, 4, 4, 4, 12)]
        return ["commit", "checksum", "uuid", "file", "image", "see", "version", "id", ""], r.choice(
            ["-".join(u), self.hexes(40), self.hexes(32), f"{w()}_{w()}_20{n(2)}_{w()}", f"{w()}-{w()}-{w()}-{n(3)}", f"{w()}/{w()}/{w()}{n(2)}", f"{w()}{w()}{n(4)}{w()}{w()}"]
        )

    def text(self) -> tuple[str, list[tuple[int, int, str]]]:
        r, out, size, planted = self.r, [], 0, []

        def put(t: str) -> None:
            nonlocal size
            out.append(t)
            size += len(t)

        for _ in range(r.randint(3, 7)):
            put(" ".join(self.word() for _ in range(r.randint(2, 8))) + r.choice([" ", ". ", ", "]))
            kind = r.choice(ALL_KINDS)
            real = r.random() < 0.5
            lead, value = self.true(kind) if real else self.false(kind)
            if r.random() < (0.8 if real else 0.6) or kind == "secret" and real:
                t = r.choice(lead)
                put(t + ("" if t[-1:] in " =" else r.choice([" ", ": "])))
            quote = value[:1] == '"'
            at = size + quote
            put(value + '"' * quote)
            if real:
                planted.append((at, size - quote, kind))
            put(r.choice([" ", ", ", ". ", "\n"]))
        put(self.word())
        return "".join(out), planted


def made_up(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with the places and kinds of their true values."""
    writer = _Writer(seed)
    return [writer.text() for _ in range(n)]


def cut_candidates(spark: SparkSession, texts: list[tuple[str, list[tuple[int, int, str]]]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """kind -> (features, labels) of all that the generators propose in the texts: a candidate is true if its place and that of a
    planted value of its kind overlap by four fifths of both."""
    one = F.split(F.lit("\x1e".join(t for t, _ in texts)), "\x1e")
    df = spark.range(1).select(F.posexplode(one).alias("i", "t")).select("i", *[_candidates(k, F.col("t")).alias(k) for k in ALL_KINDS])
    rows: dict[str, tuple[list, list]] = {k: ([], []) for k in ALL_KINDS}
    for row in df.collect():  # a bounded sample
        true = texts[row.i][1]
        for kind in ALL_KINDS:
            for c in row[kind]:
                both = max((min(c.e, e) - max(c.s, s) for s, e, k in true if k == kind and 5 * min(c.e - c.s, e - s) >= 4 * max(c.e - c.s, e - s)), default=0)
                rows[kind][0].append(c.x)
                rows[kind][1].append(5 * both >= 4 * (c.e - c.s))
    return {k: (np.array(x, float).reshape(-1, len(FEATURES)), np.array(y, float)) for k, (x, y) in rows.items()}


def _tree(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, depth: int):
    """A regression tree: a number, or (feature, threshold, below, above)."""
    g, w = residual.sum(), weight.sum()
    leaf = float(g / (w + 1.0))
    if depth == 0 or len(x) < 20:
        return leaf
    best = (1e-6, 0, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, gs, ws = x[order, f], np.cumsum(residual[order]), np.cumsum(weight[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        if len(at):
            gain = gs[at] ** 2 / (ws[at] + 1.0) + (g - gs[at]) ** 2 / (w - ws[at] + 1.0) - g * g / (w + 1.0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float(v[at[k]] + v[at[k] + 1]) / 2)
    if best[0] <= 1e-6:
        return leaf
    _, f, cut = best
    low = x[:, f] <= cut
    return (f, cut, _tree(x[low], residual[low], weight[low], depth - 1), _tree(x[~low], residual[~low], weight[~low], depth - 1))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    return np.where(x[:, f] <= cut, _apply(low, x), _apply(high, x))


def total(trees: list, x: np.ndarray) -> np.ndarray:
    """The score as the CASE expressions add it up, in the same order."""
    s = np.zeros(len(x))
    for t in trees:
        s = s + RATE * _apply(t, x)
    return s


def boost(x: np.ndarray, y: np.ndarray) -> list:
    """Logistic boosting."""
    trees, s = [], np.zeros(len(x))
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-s))
        trees.append(_tree(x, y - p, p * (1 - p), DEPTH))
        s = s + RATE * _apply(trees[-1], x)
    return trees


def calibrate(s: np.ndarray, y: np.ndarray) -> float:
    """The lowest score at which TARGET_PRECISION holds; all rows of a score pass or none."""
    order = np.argsort(-s, kind="stable")
    s, right = s[order], np.cumsum(y[order])
    last = np.append(s[1:] < s[:-1], True) if len(s) else np.zeros(0, bool)
    ok = np.flatnonzero(last & (right >= TARGET_PRECISION * np.arange(1, len(s) + 1)))
    return float(s[ok[-1]]) if len(ok) else math.inf


_FITTED: dict[str, tuple[list, float]] = {}
_LOCK = threading.Lock()


def model(spark: SparkSession) -> dict[str, tuple[list, float]]:
    """kind -> (trees, threshold); fitted once a process, the same in every one."""
    with _LOCK:
        if not _FITTED:
            fit, held = cut_candidates(spark, made_up(TRAIN_TEXTS, 11)), cut_candidates(spark, made_up(HELD_TEXTS, 12))
            for kind in ALL_KINDS:
                trees = boost(*fit[kind])
                _FITTED[kind] = (trees, calibrate(total(trees, held[kind][0]), held[kind][1]))
    return _FITTED


def _compiled(tree, x: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, cut, low, high = tree
    return F.when(F.get(x, F.lit(f)) <= cut, _compiled(low, x)).otherwise(_compiled(high, x))


def score(trees: list, features: Column) -> Column:
    got = F.lit(0.0)
    for tree in trees:
        got = got + RATE * _compiled(tree, features)
    return got


# --- spans ---------------------------------------------------------------------------------------------------------


def _valid_of(kind: str):
    return lambda x: _valid(kind, x["v"])


def _named(kind: str):
    return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind"))


def _scored(kind: str, trees: list):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(1).alias("o"), x["e"].alias("e"), F.lit(kind).alias("kind"), score(trees, x["x"]).alias("score"))


def _reaches(threshold: float):
    return lambda x: x["score"] >= threshold


def _is(kind: str):
    return lambda x: x["kind"] == kind


def _none(kind: str) -> Column:
    return F.expr(f"CAST(array() AS {kind})")


def _apart(base: Column, loose: Column) -> Column:
    """The loose spans that overlap no strict one: one sweep for strict spans that begin before, one for those that begin after."""
    as_mixed = F.transform(base, lambda x: F.struct(x["s"].alias("s"), F.lit(0).alias("o"), x["e"].alias("e"), x["kind"].alias("kind"), F.lit(0.0).alias("score")))

    def forward(end: Column, x: Column) -> Column:
        strict = x["o"] == 0
        keep = strict | (x["s"] >= end)
        return F.struct(F.when(strict, F.greatest(end, x["e"])).otherwise(end).alias("state"), F.when(keep, F.array(x)).otherwise(_none(MIXED)).alias("emit"))

    def backward(begin: Column, x: Column) -> Column:
        strict = x["o"] == 0
        keep = ~strict & (x["e"] <= begin)
        return F.struct(F.when(strict, F.least(begin, x["s"])).otherwise(begin).alias("state"), F.when(keep, F.array(x)).otherwise(_none(MIXED)).alias("emit"))

    first = sweep(F.sort_array(F.concat(as_mixed, loose)), F.lit(-1), forward, MIXED)["out"]
    return F.reverse(sweep(F.reverse(first), F.lit(2**31 - 1), backward, MIXED)["out"])


def _best(loose: Column) -> Column:
    """In the order of their begins, the better of each two that overlap; the earlier one on ties."""

    def step(held: Column, x: Column) -> Column:
        over = held.isNotNull() & (x["s"] < held["e"])
        emit = F.when(held.isNotNull() & ~over, F.array(held)).otherwise(_none(MIXED))
        return F.struct(F.when(over & (held["score"] >= x["score"]), held).otherwise(x).alias("state"), emit.alias("emit"))

    end = sweep(loose, F.expr(f"CAST(NULL AS {MIXED[6:-1]})"), step, MIXED)
    kept = let(end, lambda r: F.concat(r["out"], F.when(r["state"].isNotNull(), F.array(r["state"])).otherwise(_none(MIXED))))
    return F.transform(kept, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``__row`` with base and added: arrays of struct(s, e, kind), by kind as listed, then by start."""
    fitted = model(docs.sparkSession)
    df = pack(docs, __text=F.coalesce(docs[f"`{text}`"], F.lit("")))
    t = F.col("__text")
    df = df.withColumns({f"__g_{kind}": t.rlike(GATES[kind]) for kind in ALL_KINDS})
    strict = {f"__b_{k}": F.when(F.col(f"__g_{k}"), F.filter(positions(t, STRICT[k]), _valid_of(k))).otherwise(_none(FOUND)) for k in KINDS}
    df = df.withColumns(strict)
    df = df.withColumn("base", F.concat(*[F.transform(F.col(f"__b_{k}"), _named(k)) for k in KINDS]))
    loose = []
    for kind in ALL_KINDS:
        trees, threshold = fitted[kind]
        found = F.filter(F.transform(_candidates(kind, t), _scored(kind, trees)), _reaches(threshold))
        loose.append(F.when(F.col(f"__g_{kind}"), found).otherwise(_none(MIXED)))
    df = df.withColumn("__loose", F.concat(*loose))

    added = F.when(F.size("__loose") == 0, _none(SPAN)).otherwise(_best(_apart(F.col("base"), F.col("__loose"))))
    return df.withColumn("added", added).select("__row", "__text", "base", "added")


def _ordered(found: Column) -> Column:
    """By kind as listed, then start."""
    rank = lambda x: F.array_position(F.array(*[F.lit(k) for k in ALL_KINDS]), x["kind"])
    keyed = F.transform(found, lambda x: F.struct(rank(x).alias("r"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    return F.sort_array(keyed)


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(_ordered(found), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: counts and digest of the strict spans, all spans as a string, number of added ones."""
    got = spans(docs, text)
    count = {f"n_{k}": F.size(F.filter("base", _is(k))).cast("long") for k in KINDS}
    return got.select(
        F.col(f"__row.`{key}`").alias(key),
        *[c.alias(n) for n, c in count.items()],
        F.sha2(F.encode(_listed(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        _listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        F.size(F.filter("added", _is("secret"))).cast("long").alias("n_secret"),
        (F.size("base") + F.size("added") > 0).alias("has_personal"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span's characters replaced by its kind in brackets; overlapping spans by the first's."""
    got = spans(docs, text)
    t = F.col("__text")

    def step(at: Column, x: Column) -> Column:
        gap = F.substring(t, at + 1, F.greatest(x["s"] - at, F.lit(0)))
        piece = F.array(gap, F.concat(F.lit("["), x["kind"], F.lit("]")))
        return F.struct(F.greatest(at, x["e"]).alias("state"), F.when(x["s"] >= at, piece).otherwise(_none("ARRAY<STRING>")).alias("emit"))

    end = sweep(F.sort_array(F.concat("base", "added")), F.lit(0), step, "ARRAY<STRING>")
    clean = let(end, lambda r: F.concat(F.array_join(r["out"], ""), F.substring(t, r["state"] + 1, F.length(t))))
    new = F.when(F.size("base") + F.size("added") == 0, t).otherwise(clean)
    return got.select(F.col("__row").withField(f"`{text}`", F.when(F.col(f"__row.`{text}`").isNotNull(), new)).alias("__row")).select("__row.*")
