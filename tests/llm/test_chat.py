import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from freshet.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, valid string"


def digests(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t, _ in rows)
    loss = "".join(t or "" for _, _, r, t, _ in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


PIECES = ["<", "</s>", "\\", "[INST]", "[/INST]", "<<SYS>>", "[OUT]", "<s>", "s>", "a", "é", "\n", "<<ROLE>>", "<</ROLE>>", "<\\/s>", " "]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), min_size=30, max_size=30))
def test_round_trip(spark, texts):
    roles = ["user", "assistant", "system", "tool", "</s>", None]
    rows = [(k // 5, k % 5, roles[k % 6], t, "x") for k, t in enumerate(texts)]
    chats = chat.format_chats(spark.createDataFrame(rows, SCHEMA))
    for r in chat.digest(chats).collect():
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digests([x for x in rows if x[0] == r.conv_id])
    for r in chats.select("formatted", F.col("segments.text").alias("s"), F.col("segments.loss").alias("l")).collect():
        assert "".join(r.s) == r.formatted and len(r.l) % 3 == 0


def test_machine(spark):
    rows = [(1, k, x, "t", None) for k, x in enumerate(["system", "user", "assistant"])]
    rows += [(2, k, x, "t", None) for k, x in enumerate(["user", "user", "assistant"])]
    rows += [(3, 0, "user", None, None), (4, None, None, None, None), (4, None, None, None, None), (None, 0, "user", "x", None)]
    got = {r.conv_id: r for r in chat.digest(chat.format_chats(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got[1].valid and got[1].first_bad_turn is None
    assert not got[2].valid and got[2].first_bad_turn == 1
    assert not got[3].valid and got[3].first_bad_turn is None  # it ends with the user
    assert got[4].n_turns == 2 and got[None].n_turns == 1


def test_empty_and_very_long(spark):
    assert chat.digest(chat.format_chats(spark.createDataFrame([], SCHEMA))).count() == 0
    rows = [(1, 0, "user", "x" * 500_000, None), (1, 1, "assistant", "</s>" * 20_000, None)]
    r = chat.digest(chat.format_chats(spark.createDataFrame(rows, SCHEMA))).first()
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digests(rows)
