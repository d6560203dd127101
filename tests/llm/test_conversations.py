"""Conversations by hand."""

from datetime import datetime, timedelta, timezone

from threadloom.llm.conversations import conversations

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = (
    "row_id long, message_id string, conversation_id string, external_id string, sender_external_id string, sent_at timestamp, imported_at timestamp, "
    "reply_to_external_id string, message_type string, text string, turn string, sender string, _slice int"
)


def rows():
    out = []

    def add(c, e, who, minutes, reply=None, text="hi", kind="message", imported=0):
        at = None if minutes is None else T0 + timedelta(minutes=minutes)
        out.append((len(out) + 1, f"m-{c}-{e}", c, e, who, at, T0 + timedelta(days=imported), reply, kind, text, "x", "y", 1))

    add("ok", "10", "b", 5), add("ok", "9", "a", 5), add("ok", "2", "a", 200, "9"), add("ok", "3", None, 201), add("ok", "4", "c", 202, ""), add("ok", "5", "a", 203, text=" \t ​\n")
    add("ok", "6", "b", 204, kind="service"), add("ok", "2", "a", 200, "9", text="edited", imported=3)
    add("emptied", "1", "a", 1), add("emptied", "2", "b", 2), add("emptied", "2", "b", 2, text="", imported=1)  # one speaker left
    add("empty", "1", "a", 1, text=None), add("empty", "2", "b", 2, text="")
    add("broken", "1", "a", 1), add("broken", "2", "b", 2, "77")
    add("circle", "1", "a", 1, "2"), add("circle", "2", "b", 2, "1")
    add("self", "1", "a", 1, "1"), add("self", "2", "b", 2)
    add("alone", "1", "a", 1), add("alone", "2", "a", 2), add("alone", "3", None, 3)
    add("service-broken", "1", "a", 1), add("service-broken", "2", "b", 1), add("service-broken", "3", None, 1, "x", kind="service")
    add(None, "1", "a", 1), add(None, "2", "b", 1)
    add("late", "1", "a", None), add("late", "2", "b", 1)
    return out


def test_conversations_by_hand(spark):
    got = {(x.conversation_id, x.turn_no): (x.message_id, x.speaker_no) for x in conversations(spark.createDataFrame(rows(), SCHEMA)).collect()}
    assert got == {
        ("ok", 1): ("m-ok-9", 1), ("ok", 2): ("m-ok-10", 2), ("ok", 3): ("m-ok-2", 1), ("ok", 4): ("m-ok-3", 0), ("ok", 5): ("m-ok-4", 3),
        ("late", 1): ("m-late-1", 1), ("late", 2): ("m-late-2", 2),
    }


def test_no_rows(spark):
    assert conversations(spark.createDataFrame(rows(), SCHEMA).limit(0)).count() == 0
