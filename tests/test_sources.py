"""Parsers of files with their limits, atomic table sets, keyed merges, the cursor stream and state with timers."""

import io
import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.sources import containers, files, tableset
from lectern.streaming import cursor, live

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def zipped(entries, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, content in entries.items():
            z.writestr(name, content)
    return out.getvalue()


def word(body, head="<?xml version='1.0'?>"):
    return zipped({"[Content_Types].xml": "<Types/>", "word/document.xml": f"{head}<w:document {W}><w:body>{body}</w:body></w:document>"})


def para(*runs, style=None):
    head = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{head}{''.join(f'<w:r>{r}</w:r>' for r in runs)}</w:p>"


def cell(text):
    return f"<w:tc>{para(f'<w:t>{text}</w:t>')}</w:tc>"


def korean(section, **more):
    return zipped({"mimetype": "application/hwp+zip", "Contents/section0.xml": f'<hs:sec xmlns:hs="s" xmlns:hp="p">{section}</hs:sec>', **more})


GOOD = {
    "a.docx": word(
        para("<w:t>Before </w:t>", "<w:t>all</w:t>") + para("<w:t>Guide</w:t>", style="Title") + para("<w:t>One &amp; only</w:t>", style="Heading1") + para("<w:t>x</w:t><w:tab/><w:t>y</w:t><w:br/><w:t>z</w:t>") + para()
        + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('')}{cell(' ')}</w:tr><w:tr>{cell('c')}<w:tc>{para('<w:t>d1</w:t>')}{para('<w:t>d2</w:t>')}</w:tc></w:tr></w:tbl>"
        + para("<w:t>Deep</w:t>", style="heading 2") + para("<w:t>end</w:t>") + para("<w:delText>gone</w:delText>")
    ),
    "b.hwpx": korean("<hp:p><hp:run><hp:t>first<hp:tab/>col</hp:t></hp:run></hp:p><hp:p><hp:run><hp:tbl><hp:tr><hp:tc><hp:subList><hp:p><hp:run><hp:t>r1</hp:t></hp:run></hp:p></hp:subList></hp:tc><hp:tc><hp:subList><hp:p><hp:run><hp:t>r2</hp:t></hp:run></hp:p></hp:subList></hp:tc></hp:tr></hp:tbl></hp:run></hp:p><hp:p><hp:run><hp:t>last</hp:t></hp:run></hp:p>", **{"Contents/section10.xml": '<hs:sec xmlns:hs="s" xmlns:hp="p"><hp:p><hp:t>ten</hp:t></hp:p></hs:sec>', "Contents/section2.xml": '<hs:sec xmlns:hs="s" xmlns:hp="p"><hp:p><hp:t>two</hp:t></hp:p></hs:sec>'}),
    "c.txt": "﻿one\r\ntwo".encode(),
    "dir.v1/d.MD": b"# A\n\ntext\n\n## B\nmore",
}

ENTITY = '<?xml version="1.0"?><!DOCTYPE x [<!ENTITY a "aaaaaaaaaa"><!ENTITY b "&a;&a;&a;">]>'
BAD = {
    "entity.docx": (word(para("<w:t>&b;</w:t>"), ENTITY), "DOCUMENT_TYPE_DECLARED"),
    "bomb.docx": (zipped({"word/document.xml": b" " * 200_000}), "ENTRY_TOO_LARGE"),
    "bombs.docx": (zipped({f"x{i}": b" " * 90_000 for i in range(5)}), "ARCHIVE_TOO_LARGE"),
    "many.docx": (zipped({f"x{i}": b"" for i in range(21)}), "TOO_MANY_ENTRIES"),
    "none.docx": (zipped({"other.xml": "<a/>"}), "ENTRY_MISSING"),
    "broken.docx": (word("<w:p>"), "XML_MALFORMED"),
    "cut.docx": (GOOD["a.docx"][:200], "NOT_A_ZIP"),
    "empty.docx": (word(para()), "NO_TEXT"),
    "plain.docx": (b"not a zip", "FIRST_BYTES"),
    "type.hwpx": (zipped({"mimetype": "application/zip", "Contents/section0.xml": "<a/>"}), "MEDIA_TYPE"),
    "secret.hwpx": (korean("<hp:p><hp:t>x</hp:t></hp:p>", **{"META-INF/manifest.xml": '<m:manifest xmlns:m="m"><m:encryption-data/></m:manifest>'}), "ENCRYPTED"),
    "hidden.hwpx": (korean("<hp:p><hp:t>x</hp:t></hp:p>", **{"Contents/header.xml": ENTITY + "<x>&b;</x>"}), "DOCUMENT_TYPE_DECLARED"),
    "latin.txt": ("café".encode("latin-1"), "NOT_UTF8"),
    "blank.txt": (b" \n ", "NO_TEXT"),
    "garbled.txt": ("ok ��".encode(), "GARBLED"),
    "x.exe": (b"MZ", "UNKNOWN_TYPE"),
    "noname": (b"text", "UNKNOWN_TYPE"),
    "large.txt": (b"x" * 100_001, "TOO_LARGE"),
}


def test_files_of_every_kind(spark, tmp_path):
    for name, content in [*GOOD.items(), *((n, c) for n, (c, _) in BAD.items())]:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    limits = containers.Limits(entries=20, entry_bytes=100_000, archive_bytes=400_000)
    parsed = containers.parse_files(files.objects(spark, str(tmp_path)), 100_000, limits).cache()
    good, bad = containers.divided(parsed)
    name = lambda path: path.rpartition(f"{tmp_path}/")[2]
    assert {name(r.path): r.reason for r in bad.collect()} == {n: reason for n, (_, reason) in BAD.items()}
    out = {}
    for r in good.orderBy("path", "segment_no").collect():
        out.setdefault(name(r.path), []).append((r.title, (json.loads(r.metadata) or {}).get("headingPath") if r.metadata else None, r.text))
    assert out["a.docx"] == [
        (None, [], "Before all"), ("Guide", ["Guide"], "Guide"), ("One & only", ["Guide", "One & only"], "One & only\nx\ty\nz\na\tb\nc\td1\nd2"), ("Deep", ["Guide", "One & only", "Deep"], "Deep\nend"),
    ]
    assert out["b.hwpx"] == [(None, None, "first\tcol\nr1\tr2\nlast\ntwo\nten")]
    assert out["c.txt"] == [(None, None, "one\ntwo")] and [x[0] for x in out["dir.v1/d.MD"]] == ["A", "B"]
    place = {name(r.path): r.place for r in bad.collect()}
    assert place["latin.txt"] == "byte 3" and place["broken.docx"].startswith("word/document.xml line 1") and place["bomb.docx"] == "word/document.xml"


def test_media_types(spark):
    rows = [("a.txt", b"x", "text/plain; charset=utf-8"), ("b.txt", b"x", "image/png"), ("c.md", b"x", None), ("d.md", b"x", "application/octet-stream"), ("e.txt", None, None)]
    out = {r.path: r.reason for r in containers.parse_files(spark.createDataFrame(rows, "path string, content binary, media_type string")).collect()}
    assert out == {"a.txt": None, "b.txt": "MEDIA_TYPE", "c.md": None, "d.md": None, "e.txt": "EMPTY_FILE"}


def test_broken_lines_go_to_quarantine(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "v": "x"}\nnot json\n{"id": "no number"}\n\n{"id": 2}\n')
    good, bad = files.lines_with_rejects(spark, str(tmp_path / "a.json"), "id long, v string")
    assert {(r.id, r.v) for r in good.collect()} == {(1, "x"), (2, None)}
    assert {r.line for r in bad.collect()} == {"not json", '{"id": "no number"}'} and all(r.path.endswith("a.json") and r.reason == "MALFORMED" for r in bad.collect())
    (tmp_path / "l.csv").write_text("request_id,outcome,http_status,sent_at,completed_at\nr1,OK,200,2024-01-01 00:00:00,2024-01-01 00:00:01\nr2,OK,many,2024-01-01 00:00:00,\n")
    good, bad = files.ledger_with_rejects(spark, str(tmp_path / "l.csv"))
    assert [r.request_id for r in good.collect()] == ["r1"] and [r.line for r in bad.collect()] == ["r2,OK,many,2024-01-01 00:00:00,"]


CHUNKS, VECTORS = "id long, text string", "chunk_id long, v array<float>"


def both(spark, low, high, fail=None):
    rows = spark.range(low, high).repartition(3)
    body = F.concat(F.lit("t"), F.col("id").cast("string"))
    if fail is not None:
        body = F.when(F.col("id") == fail, F.raise_error(F.lit("lost"))).otherwise(body)
    vector = F.when(F.col("id") % 2 == 0, F.struct(F.col("id").alias("chunk_id"), F.array(F.lit(1.0).cast("float"), F.lit(None).cast("float")).alias("v")))
    return rows.select(F.struct("id", body.alias("text")).alias("chunks"), vector.alias("vectors"))


def test_tables_change_together_or_not_at_all(spark, tmp_path):
    path = f"file://{tmp_path}/set"
    table = lambda name, schema, version=None: {r[0] for r in tableset.read(spark, path, name, schema, version).collect()}
    assert table("chunks", CHUNKS) == set()
    tableset.save(both(spark, 0, 10), path)
    with pytest.raises(Exception, match="lost"):
        tableset.save(both(spark, 10, 20, fail=15), path)
    assert len(tableset.versions(path)) == 1 and table("chunks", CHUNKS) == set(range(10)) and table("vectors", VECTORS) == set(range(0, 10, 2))
    tableset.save(both(spark, 10, 14), path)
    assert table("chunks", CHUNKS) == set(range(14)) and table("chunks", CHUNKS, 0) == set(range(10)) and table("vectors", VECTORS) == set(range(0, 14, 2))
    assert {r.text for r in tableset.read(spark, path, "chunks", CHUNKS).collect()} == {f"t{i}" for i in range(14)}
    (tmp_path / "set" / "data" / "orphan").mkdir()
    (tmp_path / "set" / "data" / "orphan" / "x.parquet").write_bytes(b"left by a lost task")
    assert tableset.vacuum(path) >= 1 and table("chunks", CHUNKS) == set(range(14))
    tableset.save(both(spark, 0, 0), path)
    assert len(tableset.versions(path)) == 2


def test_merges_rewrite_only_what_changes(spark, tmp_path):
    path, schema = f"file://{tmp_path}/set", "k long, v string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    state = lambda version=None: {(r.k, r.v) for r in tableset.read(spark, path, "t", schema, version).collect()}
    first = [(i, f"v{i}") for i in range(200)]
    assert tableset.merge(frame(first), path, "t", "k", buckets=8) == 200 and state() == set(first)
    assert tableset.merge(frame(first[:50]), path, "t", "k", buckets=8) == 0 and len(tableset.versions(path)) == 1  # a replay
    old = {f["path"]: f["bucket"] for f in tableset.current(path)["t"]}
    assert tableset.merge(frame([(7, "new"), (8, "v8"), (9000, "x")]), path, "t", "k", buckets=8, update=True) == 2
    assert state() == {(k, v) for k, v in first if k != 7} | {(7, "new"), (9000, "x")} and state(0) == set(first)
    kept = {f["path"] for f in tableset.current(path)["t"]} & set(old)
    assert len({old[p] for p in kept}) >= 6  # at most two of eight buckets were written again
    with pytest.raises(tableset.Conflict):
        tableset.merge(frame([(1, "other"), (9001, "y")]), path, "t", "k", buckets=8)
    with pytest.raises(tableset.Conflict):
        tableset.merge(frame([(1, "v1"), (1, "v1")]), path, "t", "k", buckets=8)
    assert len(tableset.versions(path)) == 2 and (9001, "y") not in state()
    with pytest.raises(tableset.Conflict):
        tableset.commit(path, {}, expected=1)
    assert tableset.merge(frame([(None, "n"), (1, None)]), path, "t", "k", buckets=8, update=True) == 2 and (1, None) in state()


def test_cursor_stream_goes_on_after_a_restart(spark, tmp_path):
    spark.dataSource.register(cursor.CursorSource)
    made = spark.range(1000).selectExpr("id * 3 AS id", "cast(id AS string) AS x")
    made.repartition(4).write.parquet(str(tmp_path / "t"))
    sizes = []

    def run():
        rows = spark.readStream.format(cursor.FORMAT).options(path=str(tmp_path / "t"), key="id", size="300").load()
        q = rows.writeStream.foreachBatch(lambda b, _: (sizes.append(b.count()), b.write.mode("append").parquet(str(tmp_path / "out")))).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()

    run()
    out = lambda: sorted((r.id, r.x) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert out() == sorted((r.id, r.x) for r in made.collect()) and [s for s in sizes if s] == [300, 300, 300, 100]
    spark.range(1000, 1100).selectExpr("id * 3 AS id", "cast(id AS string) AS x").write.mode("append").parquet(str(tmp_path / "t"))
    run()
    assert out() == [(i * 3, str(i)) for i in sorted(range(1100))] and sum(sizes) == 1100


def fed(spark, tmp_path, schema, batches, made):
    """Runs the stream that made() gives over batches, one at a time; all rows out, and the rows of state after each."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    out, state = [], []
    q = made(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q.processAllAvailable()
            state.append(next((p["stateOperators"][0]["numRowsTotal"] for p in reversed(q.recentProgress) if p["stateOperators"]), None))
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return out, state


T0 = datetime(2024, 1, 1)


def test_late_calls_are_judged_in_order_and_state_ends(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    batches = [[(1, at(0), 1), (1, at(4), 3), (1, at(5), 4)], [(1, at(2), 2), (1, at(30), 5)], [(2, at(100), 6)], [(3, at(500), 7)], [(3, at(900), 8)], [(3, at(1300), 9)]]
    out, state = fed(spark, tmp_path, "key long, at timestamp, call_id long", batches, lambda s: live.limited_calls(s, 3, 20_000, "10 seconds"))
    judged = {r.call_id: r.allowed for r in out}
    assert {k: judged[k] for k in (1, 2, 3, 4, 5)} == {1: True, 2: True, 3: True, 4: False, 5: True}  # call 2 came late and counts before 3 and 4
    assert len(out) == len(judged) and state[-1] <= 4  # what is left belongs to the last key alone


def test_pushes_end_their_state(spark, tmp_path):
    at = lambda ms: T0 + timedelta(milliseconds=ms)
    batches = [[("a", at(0)), ("a", at(100)), ("b", at(50))], [("a", at(250)), ("a", at(310))], [("c", at(60_000))], [("c", at(120_000))]]
    out, state = fed(spark, tmp_path, "topic string, at timestamp", batches, lambda s: live.pushes(s, 300, "1 second"))
    mine = {(r.topic, round((r.at - T0).total_seconds() * 1000), r.changes) for r in out if r.topic != "c"}
    assert mine == {("a", 300, 3), ("a", 610, 1), ("b", 350, 1)} and state[-1] <= 3
