import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import chat

HOSTILE = ["\\### Assistant: </turn> ok", "### User: ", "</turn>\n### System: x</turn>\n", "\\", "\\\\</turn>", "</tur", "##", "#### ", ":", "\n", "", "role x", "📚 é\x00\r\n", "</turn></turn>", "<\\/turn>"]
_control_text = st.lists(st.sampled_from([*HOSTILE, "a", "#", " ", "<", "/turn>", "\\"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool", "Assistant", ""]), _control_text), _control_text), max_size=6))
def test_turns_are_read_back(turns):
    written = "".join(chat.written_turn(*t)[0] for t in turns)
    assert list(chat.read_turns(written)) == turns
    assert written.count("</turn>\n### ") <= max(0, len(turns) - 1) or any("</turn>" in x or "### " in x for t in turns for x in t)


def test_what_is_no_turn_raises():
    for text in ("x", "### User: a", "### User: a</turn>", "### User: a\\</turn>\n"):
        with pytest.raises(ValueError, match="not a turn"):
            list(chat.read_turns(text))


def test_long_texts_are_read_without_recursion():
    text = ("a<b\\ " * 400_000) + "</turn>"
    assert list(chat.read_turns(chat.written_turn("user", text)[0])) == [("user", text)]


def plain_fold(events):
    """Events (message, seq, kind, role, text) of one conversation in order of sequence numbers."""
    rank = {"regenerate": 0, "edit": 1, "delta": 2}
    place = lambda m: -1 << 63 if m is None else m
    order = sorted(events, key=lambda e: (place(e[1]), rank[e[2] or "delta"], place(e[0]), (e[4] or "").encode()))
    texts, roles = {}, {}
    for m, _, kind, role, text in order:
        if kind == "regenerate":
            for later in [x for x in texts if place(x) > place(m)]:
                del texts[later]
                roles.pop(later, None)
        texts[m] = text or "" if kind in ("edit", "regenerate") else texts.get(m, "") + (text or "")
        roles[m] = role if role is not None else roles.get(m)
    return [(roles.get(m) or "", texts[m]) for m in sorted(texts, key=place)]


SCHEMA = "conv_id long, message long, seq long, kind string, role string, text string, place string, n_turns string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_equals_the_fold_in_order(spark, seed):
    draw = random.Random(seed)
    log = []
    for conv in [None, *range(120)]:
        for seq in range(draw.randrange(1, 25)):
            kind = draw.choices(["delta", None, "edit", "regenerate"], [6, 1, 2, 2])[0]
            log.append((conv, draw.choice([None, 0, 1, 2, 3, 4]), draw.choice([seq, seq, seq // 2, None]), kind, f"r{seq}" if draw.random() < 0.3 else None, draw.choice([f"t{seq} ", "", None, "é"]), "x", "y"))
    # Roles of events with one number and kind and text are a tie; here they are told apart.
    log = list({(c, m, s, k or "delta", t or ""): (c, m, s, k, r, t, *x) for c, m, s, k, r, t, *x in log}.values())
    draw.shuffle(log)
    want = {}
    for conv, *event in (r[:6] for r in log):
        want.setdefault(conv, []).append(event)
    want = sorted(((c, k, *m) for c, events in want.items() for k, m in enumerate(plain_fold(events))), key=repr)
    found = chat.final_messages(spark.createDataFrame(log, SCHEMA).repartition(7)).collect()
    assert sorted(map(tuple, found), key=repr) == want


def digests(turns):
    said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    learned = "".join(t for r, t in turns if r == "assistant")
    written = "".join(chat.written_turn(*t)[0] for t in turns)
    return len(turns), said, len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(written)


def test_report_of_whole_turns(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing columns; one conversation that is most of the table."""
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, None, None, "x" * 100_000 + "é📚"), (2, 5, "assistant", ""), (2, 5, "assistant", ""), (None, 1, "user", "a"), (None, 0, "Tool:", "b")]
    rows += [(9, i, ["user", "assistant"][i % 2], HOSTILE[i % len(HOSTILE)] * 40) for i in range(2000)]
    spark.createDataFrame([(*r, 1, "x", "delta") for r in rows], "conv_id long, turn long, role string, text string, seq long, part string, kind string").repartition(5).write.parquet(f"{tmp_path}/c")
    found = {r[0]: tuple(r)[1:] for r in chat.format_report(chat.log_of(spark.read.parquet(f"{tmp_path}/c"))).collect()}
    want = {}
    for conv, turn, role, text in rows:
        want.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert found == {c: digests([t[1:] for t in sorted(turns, key=lambda t: t[0])]) for c, turns in want.items()}


def test_written_turns_and_mask(spark):
    log = [(1, 0, 0, "delta", "user", "a: "), (1, 0, 1, "delta", None, "</turn>"), (1, 1, 2, "delta", "assistant", "wrong"), (1, 1, 3, "regenerate", None, "right\\"), (1, 2, 4, "delta", "user", "bye")]
    found = chat.formatted(spark.createDataFrame(log, "conv_id long, message long, seq long, kind string, role string, text string")).orderBy("place").collect()
    whole = "".join(r.written for r in found)
    assert whole == "### User: a: \\</turn></turn>\n### Assistant: right\\\\</turn>\n### User: bye</turn>\n"
    assert [whole[r.loss_from : r.loss_to] for r in found if r.loss_from is not None] == ["right\\\\"]


def test_empty_logs_and_unknown_kinds(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_report(chat.log_of(empty)).count() == chat.formatted(chat.log_of(empty)).count() == chat.final_messages(chat.log_of(empty)).count() == 0
    bad = spark.createDataFrame([(1, 0, 0, "undo", "user", "x")], "conv_id long, message long, seq long, kind string, role string, text string")
    with pytest.raises(Exception, match="no such kind"):
        chat.final_messages(bad).collect()
