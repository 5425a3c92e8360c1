import json
import zipfile

from quillspark.operators import process, replay
from quillspark.sources import documents as ds
from quillspark.sources import reports as rs

LINES = """Revision History report
Student: Ada Blank
Document title: On islands
Writing time
1 h 12 min
Sessions 2
Total edits: 1,284
Session 1: Sep 22, 2026 at 9:22 AM 45 min
Pasted content
Sep 22, 2026 at 9:40 AM 180 characters
"The island changes the boys because nobody is there to tell them what is right."
9:55 AM 40 words
“Another block of words that was put in later on.”
Word count: 812"""


def test_durations_and_dates():
    assert [rs.minutes(x) for x in ("2h 5m", "1 hour and 5 minutes", "45 min", "3 min 30 sec", "90 s", "01:23:30", "soon")] == [125, 65, 45, 3.5, 1.5, 83.5, None]
    day = lambda x, last=None: (s := rs.find_stamp(x, last)) and s.day
    assert [day(x) for x in ("Sept 3, 2026", "3 March 2025 10:00", "2026-09-22T09:22:10Z", "22/09/2026", "9/22/26 9:22 PM", "12:30")] == [(2026, 9, 3), (2025, 3, 3), (2026, 9, 22), (2026, 9, 22), (2026, 9, 22), None]
    assert rs.find_stamp("at 9:30 pm", (2026, 1, 2)).t - rs.find_stamp("2026-01-02 09:30").t == 12 * 3_600_000


def test_report_layouts():
    r = rs.parse_report(LINES)
    assert r["tool"] == "Revision History" and r["student"] == "Ada Blank" and r["title"] == "On islands"
    assert r["metrics"] == {"writingMinutes": 72, "sessions": 2, "edits": 1284, "totalWords": 812}
    assert [(p["chars"], p["words"], p["excerpt"][:11]) for p in r["pastes"]] == [(180, None, "The island "), (None, 40, "Another blo")]
    table = rs.parse_report("Draftback\nActive time   Sessions   Edits   Pastes\n1h 12m 3 1,284 2")
    assert table["metrics"] == {"writingMinutes": 72, "sessions": 3, "edits": 1284, "pasteCount": 2} and table["tool"] == "Draftback"


def test_durations_and_dates():
    for text, expected in (("2 hours and 5 min", 125), ("1.5 h", 90), ("10m 30s", 10.5), ("45 sec", 0.75), ("1:02:30", 62.5), ("a day", None), ("3 h, then 20 min", 180)):
        assert rs.minutes(text) == expected, text
    at = lambda line, last=None: (s := rs.find_stamp(line, last)) and (s.day, s.timed, s.t and s.t // 60_000 % 1440)
    assert at("on March 3rd, 2024 at 1:05 pm") == ((2024, 3, 3), True, 785) and at("3 Sept 2024") == ((2024, 9, 3), False, 0)
    assert at("2024-02-30T10:00") == ((2024, 2, 30), False, None) and at("25/12/24 12:30 AM") == ((2024, 12, 25), True, 30)
    assert at("13/14/2024") is None and at("9:15 am", (2024, 1, 2)) == ((2024, 1, 2), True, 555) and at("ratio 9:15", (2024, 1, 2)) is None


def test_figures_by_line_and_reversed():
    figures = lambda *lines: rs.parse_report("\n".join(lines))["metrics"]
    assert figures("Word count", "1,204") == {"totalWords": 1204} and figures("Edits: 85%") == {}
    assert figures("There were 4 pastes", "and 3 sessions") == {"pasteCount": 4, "sessions": 3}


def test_locate():
    text = "First. “The Island changes the boys, because nobody came.” Last."
    a, b = rs.locate(text, '"the island changes the boys because nobody came at all"')
    assert text[a:b] == "The Island changes the boys, because nobody came" and rs.locate(text, "something that is not there at all") is None


def test_dispatch():
    kind = lambda x: rs.dispatch(x if isinstance(x, str) else json.dumps(x))["kind"]
    assert kind("\ufeff" + json.dumps({"events": [{"t": 1, "type": "insert", "pos": 0, "text": "a"}]})) == "submission"
    got = rs.dispatch(json.dumps({"title": "T", "revisions": [{"time": "2024-01-01", "content": "a"}, {"time": "2024-01-02", "content": "ab"}]}))
    assert got["kind"] == "submission" and got["title"] == "T" and [e["type"] for e in got["events"]] == ["snapshot"] * 2
    got = rs.dispatch(json.dumps({"student": "B", "typingTime": "30 min", "sessions": 2, "pastes": [{"time": 0, "chars": 90, "text": "a block of text from elsewhere"}]}))
    assert got["kind"] == "report" and got["report"]["metrics"]["sessions"] == 2 and got["report"]["pastes"][0]["chars"] == 90
    assert kind("{bad") == kind({"a": 1}) == kind("3") == "error" and "a" in rs.dispatch('{"a": 1}')["note"] and kind({"samples": [1]}) == "bundle"


def test_imports_and_reports_as_tables(spark):
    log = {"events": [{"time": "2024-01-01T00:00:00", "type": "insert", "pos": None, "text": "one two"}, {"t": 1704067201000, "type": "insert", "pos": 7, "text": " three"}, {"t": 5, "type": "zap"}]}
    files = spark.createDataFrame([("a.json", json.dumps(log)), ("b.json", json.dumps({"typingTime": "30 min", "totalPastes": 1})), ("c.json", "{")], "path string, raw string")
    kinds, events = rs.imported(files)
    assert {r.path: r.kind for r in kinds.collect()} == {"a.json": "submission", "b.json": "report", "c.json": "error"}
    good, bad = replay.normalized(events)
    assert bad.count() == 1 and replay.replayed(good).where("final_text is not null").first().final_text == "one two three"
    found = rs.parsed(spark.createDataFrame([("s", LINES, "x " * 50 + "The island changes the boys because nobody is there to tell them what is right.")], "sample_id string, raw string, text string"))
    r = process.report_features(found.join(spark.createDataFrame([("s", "word " * 100)], "sample_id string, text string"), "sample_id")).first()
    assert r.pastedShare == 55 and r.largestInsertion == 40 and r.sessions == 2 and r.activeMinutes == 72


def test_docx(spark, tmp_path):
    xml = '<w:document><w:body><w:p><w:r><w:t xml:space="preserve">Fish &amp; chips &#233;</w:t><w:tab/><w:t>x</w:t></w:r></w:p><w:footnote><w:t>no</w:t></w:footnote><w:p/><w:p></w:p></w:p></w:p><w:p><w:r><w:t>Second</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "Ada_Blank essay.docx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "old.doc").write_bytes(b"x")
    (tmp_path / "broken.docx").write_bytes(b"x")
    good, bad = ds.read_docx(spark, str(tmp_path))
    r = good.first()
    assert r.title == "Ada Blank essay" and r.text == "Fish & chips é\tx\n\nSecond" and bad.count() == 2


def test_text_and_pages(spark, tmp_path):
    (tmp_path / "My_essay.txt").write_bytes(b"  line one\r\nline two \n")
    r = ds.read_text(spark, str(tmp_path)).first()
    assert r.title == "My essay" and r.text == "line one\nline two"
    items = [("f", 1, 0, 10.0, 700.0, 20.0, 10.0, "It was"), ("f", 1, 1, 40.0, 701.0, 20.0, 10.0, "late"), ("f", 1, 2, 10.0, 680.0, 5.0, 10.0, "and dark."), ("f", 1, 3, 10.0, 660.0, 5.0, 10.0, "New one")]
    lines = ds.page_lines(spark.createDataFrame(items, "path string, page int, seq int, x double, y double, width double, height double, text string"))
    assert [x.text for x in lines.orderBy("line").collect()] == ["It was late", "and dark.", "New one"]
    assert ds.rejoined(lines).first().text == "It was late and dark.\n\nNew one"


