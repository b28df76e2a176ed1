import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.llm import catalog, chat

EVENTS = "conv_id long, turn int, seq int, kind string, role string, text string, formatted string"
SCRAPS = ["<|im_start|>", "<|im_end|>\n", "</s>", "[INST]", "[/INST]", "\\", "<", "|", "<\\|", "\n", "é", "𝄞", "$1", "user", ""]


def events(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], EVENTS)


def test_fold_takes_deltas_edits_and_regenerations_by_sequence(spark):
    log = events(
        spark,
        [
            (1, 0, 1, "delta", "user", "What "),
            (1, 0, 2, "delta", None, "is it?"),
            (1, 1, 5, "delta", None, " two"),
            (1, 1, 3, "delta", "assistant", "wrong"),
            (1, 1, 4, "regenerate", None, None),
            (1, 1, 6, "delta", None, " three"),
            (1, 0, 7, "edit", None, "What was it?"),
            (2, None, None, None, None, None),
        ],
    )
    got = {r["conv_id"]: [tuple(m) for m in r["messages"]] for r in chat.fold_messages(log).collect()}
    assert got == {1: [("user", "What was it?"), ("assistant", " two three")], 2: [("", "")]}


def test_empty_log_gives_no_rows(spark):
    assert chat.digests(chat.format_chats(events(spark, []))).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a%\n<|", ""]), st.lists(st.sampled_from(SCRAPS), max_size=6)), min_size=1, max_size=5), min_size=1, max_size=12))
def test_read_back_gives_every_text_and_role(spark, chats):
    rows = [(c, t, t, "delta", role, "".join(text)) for c, turns in enumerate(chats) for t, (role, text) in enumerate(turns)]
    got = chat.format_chats(events(spark, rows)).select("*", chat.read_back(F.col("formatted")).alias("read")).collect()
    for r in got:
        want = [(role, "".join(text)) for role, text in chats[r["conv_id"]]]
        assert [tuple(m) for m in r["read"]] == want
        spans = "".join(r["formatted"][s["start"] : s["start"] + s["size"]] for s in r["loss_spans"])
        assert r["formatted"].count("<|im_start|>") == len(want)
        assert len(spans) >= sum(len(t) for role, t in want if role == "assistant")


def test_query_matches_a_plain_count(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in turns:
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = catalog.QUERIES["op1_chat_formatting"](spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        loss = "".join(t for role, t in want[r["conv_id"]] if role == "assistant")
        assert r["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for role, t in want[r["conv_id"]]))
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(want[r["conv_id"]]), len(loss), sha(loss))


@pytest.mark.parametrize("text", ["<|x", "a</s>[INST] ok [/INST]", "\\<\\|", "[\\/INST]"])
def test_escape_hides_control_strings_and_can_be_undone(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).first()
    assert row["u"] == text
    assert not any(c in row["e"] for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


def test_turns_with_the_same_number_stay_apart_as_in_the_twin(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "x"), (1, 1, "user", "y"), (1, None, "assistant", "last"), (1, None, None, None), (2, 5, "user", "é")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(catalog.SQL["op1_chat_formatting"])
    names = [c[0] for c in want.description]
    got = catalog.QUERIES["op1_chat_formatting"](spark, str(tmp_path)).select(names).collect()
    assert sorted(tuple(r) for r in got) == sorted(want.fetchall())
