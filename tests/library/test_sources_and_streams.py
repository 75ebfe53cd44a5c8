import io
import json
import zipfile

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from docquarry.sources import files, stages
from docquarry.streaming import ingest


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


DOCX = office({"word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>First </w:t><w:t>line</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>A</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
XLSX = office({"xl/sharedStrings.xml": '<sst xmlns="s"><si><t>Year</t></si><si><t>Sales</t></si></sst>', "xl/worksheets/sheet1.xml": '<worksheet xmlns="s"><sheetData><row/><row><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row><c r="A3"><v>2024</v></c><c r="C3"><v>7</v></c></row></sheetData></worksheet>'})


def test_layouts(spark, tmp_path):
    for name, content in {"a.docx": DOCX, "b.xlsx": XLSX, "c.txt": b"one\ftwo", "d.docx": b"broken", "e.exe": b"MZ"}.items():
        (tmp_path / name).write_bytes(content)
    found = files.scan(spark, str(tmp_path))
    got = files.layouts(found).collect()
    by = {}
    for r in got:
        by.setdefault(r["path"][-6:], []).append(r)
    assert by["a.docx"][0]["text"] == "First line" and by["a.docx"][1]["headers"] == ["A", ""] and by["a.docx"][1]["rows"] == [["1", "2"]]
    assert by["b.xlsx"][0]["headers"] == ["Year", "", "Sales"] and by["b.xlsx"][0]["rows"] == [["2024", "", "7"]]
    assert [r["text"] for r in by["/c.txt"]] == ["one", "two"]
    assert by["d.docx"][0]["error"].startswith("BadZipFile") and "unsupported" in by["/e.exe"][0]["error"]
    ok = {r["path"][-6:]: r["ok"] for r in found.select("path", files.valid(F.col("content"), F.col("extension")).alias("ok")).collect()}
    assert ok == {"a.docx": True, "b.xlsx": True, "/c.txt": True, "d.docx": False, "/e.exe": False}
    known = found.where("extension = 'txt'").select("sha256")
    assert files.unseen(found, known).count() == 4
    assert files.zip_ratio(found.where("extension = 'docx'")).where("entries = 1").count() == 1


def test_stages(spark, tmp_path):
    root = str(tmp_path)
    stages.put(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, text string"), root, stages.STAGES[0])
    stages.put(spark.createDataFrame([(2, "c")], "doc_id int, text string"), root, stages.STAGES[0])
    got = stages.get(spark, root, stages.STAGES[0])
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == {(1, "a"), (2, "c")}
    assert [r["doc_id"] for r in stages.pending(spark.createDataFrame([(1,), (9,)], "doc_id int"), got).collect()] == [9]
    want = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])
    assert stages.differences(got, want) == ["doc_id: int instead of bigint"]
    assert stages.checked_counts(got, spark.createDataFrame([(1, 1), (2, 5)], "doc_id int, count long")).count() == 1


def test_stream_of_files(spark, tmp_path):
    land, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    land.mkdir()
    (land / "1.json").write_text("\n".join(json.dumps(x) for x in [{"id": 1, "v": "a"}, {"id": 2, "v": "b"}, {"id": 2, "v": "b"}]))
    run = lambda: ingest.upsert_sink(ingest.arrivals(spark, str(land), "id int, v string"), out, check, ["id"]).awaitTermination(60)
    run()
    (land / "2.json").write_text(json.dumps({"id": 2, "v": "new"}))
    run()
    run()  # nothing new
    assert {(r["id"], r["v"]) for r in ingest.current(spark, out, ["id"]).collect()} == {(1, "a"), (2, "new")}


def test_windows_drop_what_is_too_late(spark, tmp_path):
    land = tmp_path / "in"
    land.mkdir()
    rows = lambda *ts: "\n".join(json.dumps({"ts": f"2024-01-01T{t}:00", "event_type": "x", "value": 1.0, "user_id": 1}) for t in ts)
    schema = "ts timestamp, event_type string, value double, user_id int"
    (land / "1.json").write_text(rows("00:01", "00:02", "02:30"))
    stream = ingest.windowed(ingest.arrivals(spark, str(land), schema, files_a_batch=1), "1 hour", "10 minutes")
    q = stream.writeStream.format("memory").queryName("w1").outputMode("append").start()
    try:
        q.processAllAvailable()
        (land / "2.json").write_text(rows("00:59", "05:00"))
        q.processAllAvailable()
        (land / "3.json").write_text(rows("09:00"))
        q.processAllAvailable()
        got = {r["start"].hour: r["events"] for r in spark.sql("SELECT * FROM w1").collect()}
    finally:
        q.stop()
    assert got == {0: 2, 2: 1, 5: 1}  # 00:59 came after the watermark had passed its window


def test_first_arrivals_and_sessions(spark, tmp_path):
    land = tmp_path / "in"
    land.mkdir()
    (land / "1.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T00:{m:02d}:00", "user_id": u}) for m, u in [(0, 1), (0, 1), (5, 1), (50, 1), (1, 2)]))
    s = ingest.arrivals(spark, str(land), "ts timestamp, user_id int")
    q = ingest.first_arrivals(s, ["user_id", "ts"], "ts", "1 hour").writeStream.format("memory").queryName("w2").outputMode("append").start()
    try:
        q.processAllAvailable()
        assert spark.sql("SELECT * FROM w2").count() == 4
    finally:
        q.stop()
    batch = ingest.sessions(spark.read.schema("ts timestamp, user_id int").json(str(land)), "10 minutes", "1 hour")
    assert {(r["user_id"], r["events"]) for r in batch.collect()} == {(1, 3), (1, 1), (2, 1)}
