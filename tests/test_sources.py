import json

import pytest
from pyspark.sql import functions as F

from textloom.operators.cleaning import SiteProfile
from textloom.session import latest_rows
from textloom.sources import readers, writers
from textloom.streaming.incremental import clean_new_pages

ARTICLE = {"url": "https://a.example/x", "lemmas": ["a", "b"], "text": "t", "h1": "h"}


def _write(folder, records):
    folder.mkdir(parents=True, exist_ok=True)
    for name, record in records.items():
        (folder / name).write_text(json.dumps(record, ensure_ascii=False, indent=4), encoding="utf-8")
    return str(folder)


def test_articles(spark, tmp_path):
    path = _write(tmp_path / "a", {"1.json": ARTICLE, "2.json": ARTICLE | {"url": "https://b.example/y"}})
    rows = {r.file: r for r in readers.read_articles(spark, path, {"a.example": "a"}).collect()}
    assert rows["1.json"].source == "a" and rows["2.json"].source == "other" and rows["1.json"].lemmas == ["a", "b"]
    path = _write(tmp_path / "b", {"1.json": {"url": "u"}})
    with pytest.raises(Exception, match="no lemmas"):
        readers.read_articles(spark, path).collect()


def test_pages_and_files(spark, tmp_path):
    path = _write(tmp_path / "p" / "deep", {"1.json": {"url": "u", "html_content": "<p>ä", "time_crawled": "t"}})
    assert readers.read_pages(spark, str(tmp_path / "p")).first().html_content == "<p>ä"
    totals = readers.file_totals(readers.files(spark, path, "*.json")).first()
    assert totals.n_files == 1 and totals.n_bytes > 20 and totals["size"].endswith(" B")


def test_wordlists(spark, tmp_path):
    path = tmp_path / "w.txt"
    path.write_text("Roboter\n('künstlich', 'Intelligenz')\n\n'x y'\n")
    assert [r.term for r in readers.read_wordlist(spark, str(path)).orderBy("ord").collect()] == [["Roboter"], ["künstlich", "Intelligenz"], ["x y"]]
    assert readers.read_patterns(spark, str(path)).startswith("Roboter|(")
    out = str(tmp_path / "out")
    writers.write_wordlist(readers.read_wordlist(spark, str(path)), out)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["Roboter", "künstlich Intelligenz", "x y"]


def test_sample(spark):
    df = spark.createDataFrame([(k,) for k in range(20)], "id long")
    a = [r.id for r in readers.reference_sample(df, "id", 5, 1).collect()]
    assert a == [r.id for r in readers.reference_sample(df.repartition(7), "id", 5, 1).collect()] and len(set(a)) == 5
    assert readers.reference_sample(df, "id", 0).count() == 20
    with pytest.raises(ValueError):
        readers.reference_sample(df, "id", 21)


def test_batch_output(spark, tmp_path):
    path = tmp_path / "o.jsonl"
    good = {"custom_id": "1", "result": {"type": "succeeded", "message": {"content": [{"input": {"topic_ai": True}}], "usage": {"input_tokens": 5, "output_tokens": 2}}}}
    path.write_text(json.dumps(good) + "\n" + json.dumps({"custom_id": "2", "result": {"type": "expired"}}) + "\n")
    rows = {r.custom_id: (r.result_type, r.topic_ai, r.input_tokens) for r in readers.read_batch_output(spark, str(path)).collect()}
    assert rows == {"1": ("succeeded", True, 5), "2": ("expired", None, None)}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", "x"), ("a", 'q "u"\nz'), ("deduped_1", "y")], "id string, text string")
    path = str(tmp_path / "j")
    writers.write_json(df, path)
    with pytest.raises(Exception):
        writers.write_json(df, path)
    writers.write_json(df, path, overwrite=True)
    assert spark.read.json(path).count() == 3
    writers.copy_corpus(df, str(tmp_path / "c"), ["id"], existing=df.where("id = 'a'"))
    assert {tuple(r) for r in spark.read.json(str(tmp_path / "c")).collect()} == {("b",), ("deduped_1",)}
    names = {r.id: r.name for r in writers.with_padded_index(df, "id", prefix="d", file="id").collect()}
    assert names == {"a": "d1", "b": "d2", "deduped_1": None}
    many = writers.with_padded_index(spark.range(0, 120).repartition(5), "id").collect()
    assert {r.id: r.name for r in many} == {k: f"{k + 1:03d}" for k in range(120)}
    table = writers.table_rows(spark.createDataFrame([("u", "f")], "url string, filename string"))
    assert table.columns[:3] == ["url", "id", "date"] and table.first().id == "f" and table.first().label is None
    writers.write_table(df, str(tmp_path / "t"), sep="\t")
    assert {tuple(r) for r in readers.read_table(spark, str(tmp_path / "t"), "\t").collect()} == {tuple(r) for r in df.collect()}
    writers.write_sheets(df, str(tmp_path / "s"), "id", "text")
    assert spark.read.text(str(tmp_path / "s"), wholetext=True).count() == 3


def test_latest_rows(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", None, "z"), ("b", 1, "p"), ("b", 1, "q"), (None, 5, "n"), ("c", 1, "s"), ("c", 1, "s")], "id string, at int, v string")
    got = latest_rows(rows, "id", "at").collect()
    assert {r.id: r.v for r in got if r.id != "b"} == {"a": "y", "c": "s"} and len(got) == 3
    again = latest_rows(rows.repartition(5), "id", "at").collect()
    assert {r.id: r.v for r in got} == {r.id: r.v for r in again}


def test_incremental_cleaning(spark, tmp_path):
    page = "<h1>T</h1><p>Some text of an article.</p>"
    pages, out = str(tmp_path / "pages"), str(tmp_path / "out")
    schema = "page_id long, url string, html_content string"

    def arrive(*ids):
        spark.createDataFrame([(k, f"u/{k}", page) for k in ids], schema).coalesce(1).write.mode("append").parquet(pages)
        clean_new_pages(spark, pages, schema, out, str(tmp_path / "state"), SiteProfile()).awaitTermination()
        return sorted(r.page_id for r in spark.read.parquet(out).collect())

    assert arrive(1, 2) == [1, 2]
    assert arrive(3) == [1, 2, 3]
