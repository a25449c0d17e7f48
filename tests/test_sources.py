import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from winlens.functions.text import mask_addresses
from winlens.sources import lines, logs, tables


def csv_line(label="DDoS-SYN_Flood", first="1.5"):
    return ",".join([first, "", *["0.25"] * 37, label])


def test_labelled_csv_is_audited(spark, tmp_path):
    head = ",".join([*tables.COLUMNS, "Label"])
    (tmp_path / "a.csv").write_text("\n".join([head, csv_line(), "", csv_line("XSS"), csv_line(first="x"), "1,2,3", csv_line("cut off")]))
    (tmp_path / "b.csv").write_text("\n".join(["wrong,header", csv_line(), ""]))
    rows, bad = tables.read_labelled(spark, str(tmp_path), strict_end=True)
    got = rows.orderBy("line").collect()
    assert [(r["Label"], r["Header_Length"], r["Protocol Type"]) for r in got] == [("DDoS-SYN_Flood", 1.5, None), ("XSS", 1.5, None)]
    assert sorted((r["file"], r["reason"]) for r in bad.collect()) == [("a.csv", "columns"), ("a.csv", "number"), ("a.csv", "unterminated"), ("b.csv", "header")]


def test_labelled_csv_of_other_systems(spark, tmp_path):
    head = ",".join([*tables.COLUMNS, "Label"])
    (tmp_path / "dos.csv").write_text("\ufeff" + "\r\n".join([head, csv_line(), "", csv_line("XSS"), ""]), newline="")
    (tmp_path / "open.csv").write_text("\n".join([head, csv_line("benign"), csv_line("NotALabel"), csv_line("XSS")]))
    (tmp_path / "broken.csv").write_text("\n".join([head, csv_line("xss"), "1,2"]))
    rows, bad = tables.read_labelled(spark, str(tmp_path))
    got = sorted((r["file"], r["line"], r["Label"], r["Header_Length"]) for r in rows.collect())
    assert got == [("broken.csv", 1, "xss", 1.5), ("dos.csv", 1, "DDoS-SYN_Flood", 1.5), ("dos.csv", 3, "XSS", 1.5), ("open.csv", 1, "benign", 1.5), ("open.csv", 3, "XSS", 1.5)]
    assert sorted((r["file"], r["line"], r["reason"]) for r in bad.collect()) == [("broken.csv", 2, "unterminated"), ("open.csv", 2, "label")]
    rows, files = tables.read_complete(spark, str(tmp_path))
    assert sorted((r["file"], r["line"]) for r in rows.collect()) == [("broken.csv", 1), ("dos.csv", 1), ("dos.csv", 3), ("open.csv", 1)]
    assert {r["file"]: (r["truncated"], r["sha256"]) for r in files.collect()} == {f.name: (f.name != "dos.csv", hashlib.sha256(f.read_bytes()).hexdigest()) for f in tmp_path.iterdir()}


def test_feature_csv_with_other_columns(spark, tmp_path):
    names = [*tables.COLUMNS[::-1], "source"]
    (tmp_path / "f.csv").write_text("\ufeff" + ",".join(names) + "\n" + ",".join(["inf", "", *["2.5"] * 37, "here"]) + "\n")
    row = tables.read_features(spark, str(tmp_path), "XSS").collect()[0]
    assert (row["Variance"], row["Number"], row["Header_Length"], row["source"], row["Label"]) == (float("inf"), None, 2.5, "here", "XSS")
    with pytest.raises(ValueError, match="Label"):
        tables.read_features(spark, str(tmp_path))


def test_official_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("\n".join([",".join(["extra", *tables.COLUMNS]), *(",".join(["x", str(i), "", *["1"] * 37]) for i in range(3)), ""]))
    rows = tables.read_official(spark, str(tmp_path)).orderBy("row").collect()
    assert [(r["file"], r["row"], r["Header_Length"], r["Protocol Type"], r["Variance"]) for r in rows] == [("c.csv", i, float(i), None, 1.0) for i in range(3)]
    (tmp_path / "c.csv").write_text("a,b\n1,2\n")
    with pytest.raises(Exception, match="missing"):
        tables.read_official(spark, str(tmp_path)).collect()


def test_window_stream_is_written(spark, tmp_path):
    value = F.when(F.col("value") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 3)
    rows = spark.range(6).withColumnRenamed("id", "value").select(*(value.alias(c) for c in tables.COLUMNS))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = tables.stream_windows(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    text = [x for f in (tmp_path / "out").glob("*.csv") for x in f.read_text().splitlines()]
    body = sorted(x for x in text if not x.startswith("Header"))
    assert len(body) == 6 and body[0] == "," * 38 and body[-1].split(",")[0] == repr(5 / 3)


def test_live_tail(spark, tmp_path):
    """Half lines that are appended to one file, a second file, and a stream that stops and goes on."""
    log, other = tmp_path / "in" / "a.jsonl", tmp_path / "in" / "b.jsonl"
    log.parent.mkdir()
    seen = {}

    def rows():
        def keep(df, batch):
            seen.setdefault(batch, [(r["log"], r["at"], r["id"], r["tipo"], r["complete"]) for r in df.collect()])

        q = logs.tail_event_log(spark, str(tmp_path / "in")).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).start()
        return q

    q = rows()
    log.write_text('{"id": "1", "tipo": "x"}\n{"id": "2", "ti')
    q.processAllAvailable()
    first = [x for b in seen.values() for x in b]
    assert first == [("a.jsonl", 0, "1", "x", True)]
    with log.open("a") as f:
        f.write('po": "')
    q.processAllAvailable()
    with log.open("a") as f:
        f.write('é"}\nnot json\n\n{"id"')
    other.write_text('{"id": "9", "tipo": "z"}\n')
    q.processAllAvailable()
    q.stop()
    with log.open("a") as f:
        f.write(': "3", "tipo": "w"}\n')
    q = rows()
    q.processAllAvailable()
    q.stop()
    got = sorted((log, at, id_ or "", tipo or "", ok) for b in seen.values() for log, at, id_, tipo, ok in b)
    assert got == [("a.jsonl", 0, "1", "x", True), ("a.jsonl", 25, "2", "é", True), ("a.jsonl", 51, "", "", False), ("a.jsonl", 61, "3", "w", True), ("b.jsonl", 0, "9", "z", True)]


@pytest.mark.parametrize("size", [1, 3, 7, 64, 1000])
def test_lines_of_ranges(spark, tmp_path, size, monkeypatch):
    """Any cut of a file gives the same lines with the same numbers."""
    texts = {"a.txt": b"\xef\xbb\xbfone\r\n\r\ntwo\n\n" + b"x" * 50 + "\nä\u2028b\nlast".encode(), "b.txt": b"", "c.txt": b"\n\n", "d.txt": b"only", "e.txt.gz": gzip.compress(b"p\nq\nr")}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    want = {}
    for name, data in texts.items():
        data = (gzip.decompress(data) if name.endswith("gz") else data).removeprefix(b"\xef\xbb\xbf")
        parts = data.split(b"\n")
        for n, raw in enumerate(parts if parts[-1] else parts[:-1]):
            want[name, n] = (raw.decode().removesuffix("\r") if n < len(parts) - 1 else raw.decode(), n == len(parts) - 1, parts[0].decode().removesuffix("\r"))
    got = lines.numbered_lines(spark, str(tmp_path), size).collect()
    assert {(r["path"].rsplit("/", 1)[1], r["line"]): (r["raw"], r["open"], r["head"]) for r in got} == want and len(got) == len(want)
    for block in (1, 4, 1 << 20):
        cut = [x for at in range(0, len(texts["a.txt"]), size) for x in lines.lines_within(f"file://{tmp_path}/a.txt", at, at + size, at + size >= len(texts["a.txt"]), block)]
        assert [x[0] for x in cut] == sorted({x[0] for x in cut}) and [x[1].removeprefix(b"\xef\xbb\xbf").decode() for x in cut] == [want["a.txt", n][0] for n in range(len(cut))]


def test_windows_written_and_read(spark, tmp_path):
    rows = spark.createDataFrame([tuple([None if i == 34 else i / 3 for i in range(39)])], tables.FEATURES)
    tables.write_windows(rows, str(tmp_path / "w"))
    back = tables.read_features(spark, str(tmp_path / "w"), "XSS").collect()[0]
    assert back["Label"] == "XSS" and back["Std"] is None and back["Variance"] == 38 / 3
    facts = tables.with_file_facts(spark, str(tmp_path / "w" / "*.csv")).collect()
    assert facts and all(len(r["sha256"]) == 64 for r in facts)


def test_event_log(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "1", "instante": "t", "tipo": "a", "dados": {"k": 1}}\nnot json\n\n{"id": "2"')
    got = logs.read_event_log(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r["line"], r["id"]) for r in got][0] == (1, "1") and [r["line"] for r in got] == [1, 2, 4]
    assert got[1]["id"] is None and got[0]["dados"] == '{"k": 1}'.replace(" ", "") or got[0]["dados"] == '{"k":1}'


def test_results_of_runs(spark, tmp_path):
    one = '{"capture": "%s", "incidents": [{"n": 1, "windows_with_attacker": 3, "windows_in_test": 0}, {"n": 2, "windows_with_attacker": 0, "windows_in_test": 5}]}'
    (tmp_path / "a.json").write_text(one % "a")
    (tmp_path / "b.json").write_text('{"capture": "b",\n "incidents": []}')
    runs = logs.read_runs(spark, str(tmp_path), "capture string, incidents array<struct<n:int,windows_with_attacker:int,windows_in_test:int>>")
    got = sorted((r["capture"], r["n"], r["is_true"], r["in_test"]) for r in logs.incident_rows(runs, ["capture"]).collect())
    assert runs.count() == 2 and got == [("a", 1, True, False), ("a", 2, False, True)]
    (tmp_path / "c.json").write_text("not json")
    with pytest.raises(Exception, match="(?i)malformed"):
        logs.read_runs(spark, str(tmp_path), "capture string, incidents array<struct<n:int>>").collect()


def test_training_layout(spark, tmp_path):
    rows = spark.createDataFrame([(10, "train", "XSS", 1.0), (10, "test", "XSS", 2.0), (100, "train", "Benign", 3.0)], "window_size int, side string, label string, x double")
    tables.write_training(rows, str(tmp_path / "t"))
    tables.write_training(rows.filter("side = 'test'").withColumn("x", F.lit(9.0)), str(tmp_path / "t"))  # only its own partitions are written anew
    assert sorted((r["window_size"], r["side"], r["label"], r["x"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(10, "test", "XSS", 9.0), (10, "train", "XSS", 1.0), (100, "train", "Benign", 3.0)]


def test_masking(spark):
    cases = {
        "to 10.0.0.1.": "to [address].", "10[.]0[.]0[.]1": "[address]", "１０.0.0.1": "[address]", "aa:bb:cc:dd:ee:ff on": "[address] on", "fe80::1%eth0 x": "[address] x",
        "2001:db8:0:0:0:0:0:1": "[address]", "12:30:45": "12:30:45", "v1.2.3": "v1.2.3", "300.1.1.1": "300.1.1.1"}
    rows = spark.createDataFrame(list(cases.items()), "t string, want string").select("t", "want", mask_addresses(F.col("t")).alias("got")).collect()
    assert [(r["t"], r["got"]) for r in rows if r["got"] != r["want"]] == []
