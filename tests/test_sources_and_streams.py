"""Chat readers on small exports, and streams."""

import json
from datetime import datetime, timedelta, timezone

from threadloom.operators.sessions import sessionize
from threadloom.sources.chats import generated, read_html, read_json, read_txt, roster
from threadloom.streaming.live import append_once, closed_sessions, split_late

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_json(spark, tmp_path):
    chat = {
        "id": 7, "name": "x",
        "messages": [
            {"id": 1, "type": "message", "date": "2024-01-01T10:00:00", "date_unixtime": "1704103200", "from": "A", "from_id": "u1", "text": "[plain] text"},
            {"id": 2, "type": "message", "date": "2024-01-01T10:01:00", "from": "B", "from_id": "u2", "text": ["see ", {"type": "link", "text": "this"}, "!"], "reply_to_message_id": 1},
            {"id": 3, "type": "service", "date": "2024-01-01T10:02:00+03:00", "actor": "A", "actor_id": "u1", "text": ""},
            {"id": 4, "type": "message", "text": "no time", "from_id": "u1"},
        ],
    }
    (tmp_path / "r.json").write_text(json.dumps(chat))
    got = {x.external_id: x for x in read_json(spark, str(tmp_path)).collect()}
    assert [got[i].text for i in "1234"] == ["[plain] text", "see this!", "", "no time"]
    assert [got[i].resolution_confidence for i in "1234"] == [1.0, 0.5, 1.0, 0.0]
    assert got["2"].reply_to_external_id == "1" and got["3"].message_type == "service" and got["3"].sender_external_id == "u1"


def test_txt(spark, tmp_path):
    (tmp_path / "chat.txt").write_text("preamble\n[01.02.2024, 10:00:05] Ann: hello\nsecond line\n02/02/24, 11:00 - Bob: time: 5\n")
    got = sorted(read_txt(spark, str(tmp_path)).collect(), key=lambda x: int(x.external_id))
    assert [(x.sender_name, x.text) for x in got] == [("Ann", "hello\nsecond line"), ("Bob", "time: 5")]
    assert [x.sent_at for x in got] == [datetime(2024, 2, 1, 10, 0, 5), datetime(2024, 2, 2, 11, 0)]


PAGE = """<div class="history"><div class="message service" id="message-1"><div class="body details">1 May 2024</div></div>
<div class="message default clearfix" id="message5"><div class="body"><div class="pull_right date details" title="01.05.2024 10:00:00 UTC+03:00">10:00</div>
<div class="from_name"> Ann </div><div class="text">one<br>two &amp; three</div></div></div>
<div class="message default clearfix joined" id="message6"><div class="body"><div class="pull_right date details" title="01.05.2024 10:00:09 UTC+03:00">10:00</div>
<div class="reply_to details">In reply to <a href="#go_to_message5">this message</a></div><div class="text">and more</div></div></div></div>"""


def test_html(spark, tmp_path):
    folder = tmp_path / "chat1"
    folder.mkdir()
    (folder / "messages.html").write_text(PAGE)
    (folder / "messages2.html").write_text(PAGE.replace("message5", "message15").replace("message6", "message16").replace("Ann", "Bob"))
    got = {x.external_id: x for x in read_html(spark, str(folder) + "/*.html").collect()}
    assert got["5"].text == "one\ntwo & three" and got["5"].sender_name == "Ann" and got["5"].sent_at == datetime(2024, 5, 1, 7)
    assert got["6"].sender_name == "Ann" and got["6"].reply_to_external_id == "5" and got["16"].sender_name == "Bob"
    assert got["-1"].message_type == "service"


def test_roster_and_generator(spark):
    df = spark.createDataFrame([("1: Ann\n2: Bob\n3: Ann",), ("4: Cid\n5: Dan",)], "text string")
    assert {(x.name, x.sender_external_id) for x in roster(df).collect()} == {("Bob", "2")}
    rows = generated(spark, 30)
    assert rows.count() == 30 and rows.where("reply_to_external_id is not null").count() == 20


def test_streamed_sessions_are_the_closed_batch_sessions(spark, tmp_path):
    rows = [("a", T0 + timedelta(hours=h)) for h in (0, 1, 9, 30, 31)] + [("b", T0 + timedelta(hours=h)) for h in (2, 60)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "who string, at timestamp").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("who string, at timestamp").parquet(source)
    q = append_once(closed_sessions(stream, "who", "at"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = {(x.who, x.start_at, x.n_events) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(x.who, datetime(1970, 1, 1) + timedelta(microseconds=x.start_us), x.n_events) for x in sessionize(spark.createDataFrame(rows, "who string, at timestamp"), "who", "at").collect()}
    assert got <= batch and ("a", datetime(2024, 1, 1), 3) in got and len(got) == len(batch) - 1


def test_late_rows_are_told_apart(spark):
    held = spark.createDataFrame([("a", T0)], "who string, last_at timestamp")
    batch = spark.createDataFrame([("a", T0 - timedelta(1)), ("a", T0), ("b", T0 - timedelta(9))], "who string, at timestamp")
    on_time, late = split_late(batch, held, "who", "at")
    assert (on_time.count(), late.count()) == (2, 1)


def test_large_json_is_split_by_lines(spark, tmp_path):
    from threadloom.sources.chats import read_large_json

    messages = [{"id": i, "type": "message", "date": "2024-01-01T00:00:00Z", "from": "A", "from_id": "u1", "text": ["a\n{", {"type": "bold", "text": f"{i}"}], "note": {"deep": [1]}} for i in range(500)]
    (tmp_path / "result.json").write_text(json.dumps({"name": "c", "id": 77, "messages": messages}, indent=1, ensure_ascii=False))
    whole = sorted(tuple(x) for x in read_json(spark, str(tmp_path)).collect())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        parts = read_large_json(spark, str(tmp_path))
        assert sorted(tuple(x) for x in parts.collect()) == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_text_export_over_several_blocks(spark, tmp_path):
    lines = [f"[01.02.2024, 10:{i // 60 % 60:02}:{i % 60:02}] U{i % 5}: text {i}\nmore {i}" for i in range(900)]
    (tmp_path / "chat.txt").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = sorted((int(x.external_id), x.text) for x in read_txt(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i + 1, f"text {i}\nmore {i}") for i in range(900)]
