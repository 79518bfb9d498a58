import gzip
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nivo.llm import warc
from nivo.llm.shared import Scratch


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


LONG = "<html>" + "é" * 100
ROWS = [
    (5, "http://a.example/x y", LONG),
    (3, None, LONG),
    (9, "http://b.example/\r\nX: 1", LONG),
    (1, "u", "short"),
    (2, "u", "short"),
    (4, "u", None),
    (6, "u", ""),
    (7, "u", "z" * 400_000),
    (3, None, LONG),
    (None, "u", LONG),
    (None, "u", "only here " * 20),
]


@pytest.mark.parametrize("split", [64, 1_000, 1 << 22])
def test_round_trip_at_any_split(spark, split):
    scratch = Scratch(spark, "warc-test")
    files = warc.write(pages(spark, ROWS).repartition(3), scratch)
    records = warc.read(files, split).collect()
    assert len(records) == len(ROWS) == sum(r.records for r in files.collect())
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in records)
    assert kinds == sorted(
        [("3", "response", None)] * 2
        + [("5", "revisit", 3), ("9", "revisit", 3), ("None", "revisit", 3), ("None", "response", None)]
        + [(str(n), "response", None) for n in (1, 2, 4, 6, 7)]
    )
    bodies = {r.page_id: bytes(r.payload) for r in records if r.record_type == "response" and r.page_id}
    assert bodies == {i: (h or "").encode() for i, _, h in ROWS if i in (1, 2, 3, 4, 6, 7)}
    resolved = warc.resolve(warc.read(files, split)).collect()
    assert sorted(r.payload_bytes for r in resolved) == sorted(len((h or "").encode()) for _, _, h in ROWS)


def test_archives_are_plain_gzip(spark):
    files = warc.write(pages(spark, ROWS), Scratch(spark, "warc-test")).collect()
    whole = b"".join(open(f.file.removeprefix("file:").replace("//", "/"), "rb").read() for f in files)
    text = gzip.GzipFile(fileobj=io.BytesIO(whole)).read()
    assert text.count(b"WARC/1.1\r\n") == len(ROWS)


def test_damage_and_false_magic_are_passed_over():
    good = [warc.record(i, "u", random.Random(i).randbytes(300), "d", None) for i in range(4)]
    other = zlib.compressobj(6, zlib.DEFLATED, 31)
    other = other.compress(b"not a record" * 9) + other.flush()
    data = good[0] + warc.MAGIC + b"junk" + good[1] + other + good[2][:-20] + good[3]
    fetch = lambda at, n: data[at : at + n]
    found = [warc.parse(content)["page_id"] for _, content in warc.members(fetch, 0, len(data))]
    assert found == [0, 1, 3]
    owned = [o for start in range(0, len(data), 97) for o, _ in warc.members(fetch, start, min(len(data), start + 97))]
    assert owned == [o for o, _ in warc.members(fetch, 0, len(data))]


def test_no_pages(spark):
    files = warc.write(pages(spark, []), Scratch(spark, "warc-test"))
    assert files.count() == 0 and warc.resolve(warc.read(files)).count() == 0


# --- Pipeline ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))
    item = prose(15)
    base = prose(80)
    rows = [(i, prose(60), "en", f"s{i % 3}") for i in range(40)]
    rows += [(100 + i, base if i % 2 else base + f" w{i}", "en", "s0") for i in range(20)]
    rows += [(200, f"{prose(20)} {item}", "en", "s1"), (201, "12345 !!", "en", "s1"), (202, None, "en", None)]
    rows += [(203, "", "en", "s1"), (204, prose(30_000), None, None), (205, rows[0][1], "en", "s2")]
    rows += [rows[1]]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_take_effect(spark, tables):
    names = [name for name, _ in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        if name != names[-1]:
            assert out.dtypes == docs.dtypes
        docs = out
        seen[name] = sorted(r.doc_id for r in out.select("doc_id").collect())
    everything = {*range(40), *range(100, 120), *range(200, 206)}
    assert set(seen["language_id"]) == everything - {201, 202, 203}
    unique = {*range(40), 100, 200, 204}
    assert set(seen["near_dedup"]) == unique
    assert set(seen["decontamination"]) == unique - {200}
    assert set(seen["mixing"]) <= unique - {200}
    assert seen["sharding"] == seen["mixing"]


def test_run_is_the_stages_in_order(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    rows = out.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    assert max(r.n for r in rows) - min(r.n for r in rows) <= 1 and all(r.n == r.last + 1 for r in rows)
    again = corpus_pipeline.run(spark, tables)
    view = lambda df: sorted(map(tuple, df.select("doc_id", "shard", "slot").collect()))
    assert view(out) == view(again)


def test_pipeline_of_an_empty_table(spark, tables, tmp_path):
    empty = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_ranges_are_read_by_many_tasks(spark):
    pages = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "repeat(sha2(string(id), 512), 40) AS html")
    files = warc.write(pages.repartition(3), Scratch(spark, "t"))
    records = warc.read(files, split=2_000)
    tasks = records.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == 400 and len(tasks) > 10
