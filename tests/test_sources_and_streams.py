import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from loamwork.sources import crawl, files
from loamwork.streaming import ingest

SCHEMA = StructType([StructField("id", LongType()), StructField("v", StringType())])


def write(path, rows):
    with open(path, "w") as out:
        out.writelines(r if isinstance(r, str) else json.dumps(r) + "\n" for r in rows)


def test_json_lines_modes(spark, tmp_path):
    path = str(tmp_path / "a.jsonl")
    write(path, [{"id": 1, "v": "x"}, "{bad\n", {"id": 2}])
    assert files.read_jsonl(spark, path, SCHEMA, "skip").count() == 2
    kept = files.read_jsonl(spark, path, SCHEMA, "keep").cache()
    assert kept.where("_corrupt_record IS NOT NULL").count() == 1
    with pytest.raises(Exception):
        files.read_jsonl(spark, path, SCHEMA).collect()


def test_precedence_by_file(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("b_theses.jsonl", "master.jsonl")]
    for p, v in zip(paths, "xy"):
        write(p, [{"id": 1, "v": v}])
    got = {r.v: r.precedence for r in files.read_with_precedence(spark, paths, SCHEMA).collect()}
    assert got == {"x": 0, "y": 1}


def test_seal_and_page_extraction(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.pdf").write_bytes(b"%PDF-1.5 /Font /Font")
    (tmp_path / "r" / "b.pdf").write_bytes(b"broken")
    root = str(tmp_path / "r")
    assert {r.path for r in files.sealed(spark, root).collect()} == {"a.pdf", "b.pdf"}
    audit = {os.path.basename(r.path): r.fonts for r in files.audited(files.read_files(spark, root)).collect()}
    assert audit == {"a.pdf": 2, "b.pdf": 0}

    def extract(content):
        if not content.startswith(b"%PDF"):
            raise ValueError("no pdf")
        return ["one", "two"]

    pages = files.pages_of(files.read_files(spark, root), extract).collect()
    assert sorted((p.page_index, p.text) for p in pages if p.error is None) == [(0, "one"), (1, "two")]
    assert [p.error for p in pages if p.error] == ["ValueError: no pdf"]


def test_split_sink_never_overwrites(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "dev")], "id long, split string")
    files.write_splits(df, str(tmp_path / "out"))
    assert {d for d in os.listdir(tmp_path / "out") if "=" in d} == {"split=train", "split=dev"}
    with pytest.raises(Exception):
        files.write_splits(df, str(tmp_path / "out"))


def test_catalogue_source(spark):
    def fetch(page):
        if page == 2:
            raise OSError("down")
        return [(f"{page}-{i}", f"http://x/{page}/{i}", "body") for i in range(2)]

    crawl.CATALOGUES["test"] = fetch
    reader = crawl.CatalogueReader(fetch, pages=4, parts=2, delay=0, retries=2, wait=0)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == 7 and [r[3] for r in rows if r[3]] == ["down"]


def test_ingest_resumes_and_adds_each_key_once(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.mkdir(source)
    write(f"{source}/1.json", [{"id": 1, "v": "a"}, {"id": 2, "v": "b"}, {"id": 1, "v": "a"}])
    run = lambda check: ingest.append_new(ingest.jsonl_stream(spark, source, SCHEMA), sink, ["id"], check, lambda df: df.withColumn("done", F.lit(True))).awaitTermination()
    run(state)
    write(f"{source}/2.json", [{"id": 2, "v": "again"}, {"id": 3, "v": "c"}])
    run(state)
    run(f"{state}-lost")  # without its checkpoint everything is read again, and nothing is added
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == [1, 2, 3]


def test_running_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    os.mkdir(source)
    write(f"{source}/1.json", [{"id": 1, "v": "2024-01-01T00:10:00"}, {"id": 1, "v": "2024-01-01T00:50:00"}, {"id": 2, "v": "2024-01-01T01:10:00"}])
    stream = ingest.jsonl_stream(spark, source, SCHEMA).withColumn("ts", F.to_timestamp("v"))
    q = ingest.running_counts(ingest.each_once(stream, "v"), "ts", "id").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.id, r.n) for r in spark.sql("SELECT * FROM counts").collect()) == [(1, 2), (2, 1)]
