"""Untidy files, archives, saved parameters and streams."""

import zipfile

from pyspark.sql import functions as F

from tabsmith.plans.auto_clean import auto_clean
from tabsmith.plans.params import apply_params, load_params, save_params
from tabsmith.sources import readers, writers
from tabsmith.streaming.flows import apply_params_stream, ingest_stream


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_types_and_tokens(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,amount,when,note\n1,1.5,2023-01-02,"a, ""b"""\n2,N/A,2023-02-03,?\n3,7,--,x\n')
    df = readers.read_csv(spark, path)
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "timestamp", "string"]
    assert [r["note"] for r in df.orderBy("id").collect()] == ['a, "b"', None, "x"]


def test_bad_lines_do_not_stop(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b\n1,2\n1,2,3\n4\n")
    df = readers.read_csv_text(spark, path)
    assert df.count() == 3 and df.cache().filter(F.col(readers.CORRUPT).isNotNull()).count() == 2
    kept, used = readers.read_csv_robust(spark, path)
    assert sorted(map(tuple, kept.collect()), key=str) == [("1", "2"), ("4", None)] and used == 1


def test_delimiters(spark, tmp_path):
    for name, text in {"c": "a,b\n1,2\n", "s": "a;b;c\n1,5;2;3\n", "t": "a\tb\n1\t2\n", "p": "a|b\n1|2\n", "n": "one\ntwo\n"}.items():
        write(tmp_path / f"{name}.csv", text)
    got = {r["file"][-5]: r["delimiter"] for r in readers.detect_delimiter(spark, str(tmp_path)).collect()}
    assert got == {"c": ",", "s": ";", "t": "\t", "p": "|", "n": ","}


def test_delimiter_looks_at_ten_lines(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b\n" * 10 + "x;x;x;x;x\n" * 50)
    assert readers.detect_delimiter(spark, path).first()["delimiter"] == ","


def test_repair(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a|b|c\n1|2|3|4\n\n5\n6||8\n   \n")
    got = sorted(tuple(r) for r in readers.repair_lines(spark, path, "|").collect())
    assert got == [("1", "2", "3"), ("5", "", ""), ("6", "", "8")]
    assert len(readers.repair_lines(spark, path, "|", 4).columns) == 4


def test_encodings(spark, tmp_path):
    write(tmp_path / "utf.txt", "café €\n")
    write(tmp_path / "sig.txt", "café\n", "utf-8-sig")
    write(tmp_path / "win.txt", "café €\nplain\n", "cp1252")
    (tmp_path / "lat.txt").write_bytes(b"caf\xe9 \x81\n")
    write(tmp_path / "asc.txt", "plain\n")
    got = {}
    for r in readers.normalise_encoding(spark, str(tmp_path)).orderBy("place").collect():
        got.setdefault(r["file"][-7:-4], (r["encoding"], []))[1].append(r["value"])
    assert got == {
        "utf": ("utf-8", ["café €"]),
        "sig": ("utf-8", ["café"]),
        "win": ("windows-1252", ["café €", "plain"]),
        "lat": ("iso-8859-1", ["café \x81"]),
        "asc": ("ascii", ["plain"]),
    }


def test_tidy_names():
    assert readers.tidy_names([" a ", "b", "a"]) == ["a_0", "b", "a_2"]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("d/one.csv", "h\n" + "\n".join(map(str, range(25_000))))
        z.writestr(".hidden.csv", "no")
        z.writestr("__MACOSX/two.csv", "no")
        z.writestr("pic.png", "no")
    write(tmp_path / "y.zip", "not an archive")
    rows = readers.read_archives(spark, str(tmp_path))
    found = {r["member"]: r["count"] for r in rows.groupBy("member").count().collect()}
    assert found == {"d/one.csv": 25_001, None: 1}


def test_many_files(spark, tmp_path):
    write(tmp_path / "a.csv", "k,v\n1,x\n2,\n")
    write(tmp_path / "b.csv", "k,v\n3,y\n")
    write(tmp_path / "c.csv", "k,v\nbroken\n")
    report = {r["file"][-5]: (r["rows"], r["bad_rows"], r["status"]) for r in readers.read_many(spark, str(tmp_path))[1].collect()}
    assert report == {"a": (2, 0, "ok"), "b": (1, 0, "ok"), "c": (1, 1, "failed")}


def test_a_junk_file_does_not_lend_its_header(spark, tmp_path):
    write(tmp_path / "a.csv", "no table here\n" + "just a line\n" * 50)
    write(tmp_path / "b.csv", "id,v\n1,2\n")
    rows, report = readers.read_many(spark, str(tmp_path))
    assert {r["file"][-5]: r["status"] for r in report.collect()} == {"a": "failed", "b": "ok"}
    assert [tuple(r) for r in rows.collect()] == [("1", "2")]


def test_columns_are_aligned_by_name(spark, tmp_path):
    write(tmp_path / "a.csv", "id,v\n1,x\n")
    write(tmp_path / "b.csv", "v,id\ny,2\n")
    rows, report = readers.read_many(spark, str(tmp_path))
    assert sorted((r["id"], r["v"]) for r in rows.collect()) == [("1", "x"), ("2", "y")]
    assert {r["status"] for r in report.collect()} == {"ok"}


def test_files_keep_their_delimiter(spark, tmp_path):
    write(tmp_path / "a.csv", "id,v\n1,x\n2,y\n")
    write(tmp_path / "b.csv", "id;v\n3;z\n4;w\n")
    rows, _ = readers.read_csv_robust(spark, str(tmp_path))
    assert sorted((r["id"], r["v"]) for r in rows.collect()) == [("1", "x"), ("2", "y"), ("3", "z"), ("4", "w")]


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", twice', 1.5), (2, None, None)], "a int, b string, c double")
    writers.write_csv(df, str(tmp_path / "c"))
    back = spark.read.options(header=True, escape='"').schema(df.schema).csv(str(tmp_path / "c"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    writers.write_parquet(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    params = {"fill": {"a b": 1.5, "ü": "x\ny"}, "dates": []}
    save_params(spark, params, str(tmp_path / "params"))
    assert load_params(spark, str(tmp_path / "params")) == params


def test_sample_is_repeatable(spark):
    df = spark.range(1000)
    a = [r["id"] for r in readers.sample_rows(df, "id", 50, 1).collect()]
    assert a == [r["id"] for r in readers.sample_rows(df.repartition(7), "id", 50, 1).collect()]
    assert a != [r["id"] for r in readers.sample_rows(df, "id", 50, 2).collect()] and len(set(a)) == 50


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"c{i % 4}" if i % 6 else "N/A", float(i) if i % 5 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, kind string, v double")
    params = auto_clean(df, numeric="median").params
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    apply_params_stream(stream, params, str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = apply_params(df, params)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(batch.collect())


def test_ingest_takes_only_new_files(spark, tmp_path):
    schema = "id int, v double"
    df = spark.createDataFrame([(i, float(i)) for i in range(20)], schema)
    params = auto_clean(df, numeric="median").params
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.csv", "id,v\n1,2\n2,\n")
    paths = [str(tmp_path / p) for p in ("in", "out", "rep", "cp")]
    run = lambda: ingest_stream(spark, paths[0], schema, params, *paths[1:])
    run()
    write(tmp_path / "in" / "b.csv", "id,v\nx,y\n")
    write(tmp_path / "in" / "c.csv", "v,id\n4,3\n")
    run()
    assert sorted(r["id"] for r in spark.read.parquet(paths[1]).collect()) == [1, 2, 3]
    report = spark.read.json(paths[2])
    assert {(r["file"][-5], r["status"]) for r in report.collect()} == {("a", "ok"), ("b", "failed"), ("c", "ok")}
