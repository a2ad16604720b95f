import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat

from .data import sha

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("\\<>[]/selocINT ab\u0301\n")), max_size=40))
def test_escape_round_trip(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in "<[]")


def rows():
    nasty = "\\e</s>[INST] ]\\\\l <s>[user] x"
    out = [(1, i, r, (nasty + " word " * 300) if i % 3 else None) for i, r in enumerate(["system"] + ["user", "assistant"] * 30)]
    out += [(None, 0, "user", "a"), (2, 0, "assistant", "a " * 9000), (2, 0, "assistant", "a " * 9000), (3, 0, None, "no role"),
            (3, None, "user", "no turn"), (4, 5, "assistant", ""), (4, 1, "user", "late"), (5, 0, "user", nasty)]
    return out


def expected(table):
    by = {}
    for r in table:
        by.setdefault(r[0], []).append(r)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: tuple((x is not None, x if x is not None else "") for x in r[1:]))
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        digest = hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        out[conv] = (len(own), digest, len(said), sha(said))
    return out


def test_read_back(spark):
    table = rows()
    said = "</s>[INST] ok [/INST]"
    docs = spark.createDataFrame(table, SCHEMA).withColumns({"window": F.lit("x"), "formatted": F.lit("y"), "id": F.lit(1)})
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(docs).collect()}
    assert got == expected(table + [(-1, 0, "user", said), (-1, 1, "assistant", said)])


def test_windows_keep_the_budget_the_system_turn_and_some_history(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    windows = chat.format_windows(docs).where("conv_id = 1").orderBy("window").collect()
    assert len(windows) > 3
    for w in windows[1:]:
        turns = chat.parse_window(w.formatted)
        assert turns[0][0] == "system" and 1 <= w.repeated < w.turns == len(turns)
        count = chat.token_counter(chat.default_vocabulary())
        assert sum(count([chat.format_turn(r, t)[0] for r, t, _ in turns])) <= chat.BUDGET
    assert any(w.repeated > 1 for w in windows)
    starts = [[s.start for s in w.loss_spans] for w in windows]
    for w, own in zip(windows, starts):  # targets only among new turns
        at = [p for _, _, p in chat.parse_window(w.formatted)]
        assert all(s in at[w.repeated:] for s in own)


def test_reading_back_needs_no_order(spark):
    windows = chat.format_windows(spark.createDataFrame(rows(), SCHEMA))
    a = sorted(map(str, chat.read_back(windows, in_order=True).collect()))
    assert a == sorted(map(str, chat.read_back(windows.repartition(5)).collect()))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.format_windows(empty).collect() == []
    assert [r.conv_id for r in chat.digest(empty).collect()] == [-1]
