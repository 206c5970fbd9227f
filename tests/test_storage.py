"""Archives written by hand, and documents that must parse as a whole."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringContains, StringStartsWith

from offerlake.sources import archives, exports

NAMES = ["b/page10.jpg", "b/page2.JPG", "a/page1.png", "page2a.jpg", "__MACOSX/page3.jpg", "b/__MACOSX/page4.jpg", "b/.hidden.jpg", "._page5.jpg", "b/notes.txt", "b/.DS_Store", "03.webp", "b/"]


@pytest.fixture
def folder(tmp_path):
    os.makedirs(f"{tmp_path}/in/deep")
    for archive in ("one.zip", "deep/two.ZIP", ".zip"):
        with zipfile.ZipFile(f"{tmp_path}/in/{archive}", "w") as z:
            for name in NAMES:
                z.writestr(name, f"{archive}:{name}")
    with zipfile.ZipFile(f"{tmp_path}/in/empty.zip", "w"):
        pass
    with open(f"{tmp_path}/in/readme.txt", "w") as f:
        f.write("no archive")
    return f"{tmp_path}/in"


ORDER = ["03.webp", "a/page1.png", "b/page2.JPG", "page2a.jpg", "b/page10.jpg"]


def test_pages_in_natural_order(spark, folder):
    found = archives.pages(spark, folder).collect()
    for archive, path in (("one.zip", "one.zip"), ("two.ZIP", "deep/two.ZIP")):
        own = sorted((r for r in found if r.archive == archive), key=lambda r: r.page)
        assert [r.name for r in own] == ORDER and [r.page for r in own] == [1, 2, 3, 4, 5]
        assert all(bytes(r.data).decode() == f"{path}:{r.name}" and r.size == len(r.data) for r in own)
    assert len(found) == 10
    assert [r.name for r in archives.pages(spark, f"file:{folder}/one.zip", images=False).orderBy("page").collect()] == ["03.webp", "b/notes.txt", *ORDER[1:]]
    assert archives.pages(spark, f"{folder}/empty.zip").collect() == []


def test_filters_reach_the_reader(spark, folder):
    found = archives.pages(spark, folder).where(F.col("name").startswith("b/") & (F.col("archive") == "one.zip") & (F.col("page") > 3))
    assert [(r.name, r.page) for r in found.collect()] == [("b/page10.jpg", 5)]
    reader = archives._Reader({"path": folder})
    left = list(reader.pushFilters([StringStartsWith(("name",), "b/"), EqualTo(("archive",), "one.zip"), StringContains(("name",), "x")]))
    assert left == [StringContains(("name",), "x")]
    (only,) = reader.partitions()
    assert only.path.endswith("/one.zip") and [n for b in reader.read(only) for n in b.column("name").to_pylist()] == ["b/page2.JPG", "b/page10.jpg"]


def test_a_file_that_is_no_archive_fails(spark, tmp_path):
    with open(f"{tmp_path}/bad.zip", "w") as f:
        f.write("no archive")
    with pytest.raises(Exception, match="not a zip file"):
        archives.pages(spark, f"{tmp_path}/bad.zip").collect()


def test_written_archives_are_read_again(spark, tmp_path):
    rows = [(f"{k % 3}.zip", f"page{k}.jpg", bytes([k] * k)) for k in range(40)]
    made = archives.write_archives(spark.createDataFrame(rows, "archive string, name string, data binary"), f"{tmp_path}/out").collect()
    assert sorted(made) == [("0.zip", 14), ("1.zip", 13), ("2.zip", 13)]
    assert sorted((r.archive, r.name, bytes(r.data)) for r in archives.pages(spark, f"{tmp_path}/out").collect()) == sorted(rows)


def test_one_document_from_many_tasks(spark, tmp_path):
    items = spark.range(1000, numPartitions=7).select(F.to_json(F.struct("id", F.lit('with "quotes", commas\nand é').alias("text"))).alias("json"))
    path = f"{tmp_path}/whole.json"
    exports.write_document(items, {"total": 1000, "note": "}"}, path)
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    assert whole["total"] == 1000 and whole["note"] == "}" and [x["id"] for x in whole["products"]] == list(range(1000))
    assert not os.path.exists(f"{path}.parts")
    assert exports.read_items(spark, path, "id long, text string").agg(F.sum("id")).first()[0] == 499_500
    exports.write_document(items.limit(0), {}, path, "rows")  # nothing but an empty list, over the file that was there
    with open(path) as f:
        assert json.load(f) == {"rows": []}


def test_a_failed_write_leaves_no_document(spark, tmp_path):
    items = spark.range(10).select(F.when(F.col("id") < 9, F.lit("{}")).otherwise(F.raise_error(F.lit("broken"))).alias("json"))
    with pytest.raises(Exception, match="broken"):
        exports.write_document(items, {}, f"{tmp_path}/none.json")
    assert os.listdir(tmp_path) == []


def test_bulk_export_goes_on_after_an_error(spark, tmp_path):
    products = spark.createDataFrame(
        [(1, 1, "a", "b", None, "milk", 1, "l", 2.0, None, None, "EUR", "c", 0.5, "A", True), (1, 2, "b", None, None, "bread", 1, "kg", 3.0, 2.0, 33.3, None, "c", 1.0, "N", False)],
        "leaflet_id long, page_number long, id string, brand string, product_code string, product_name string, quantity long, units string, regular_price double, discounted_price double, discount_percentage double, currency string, category string, confidence double, state string, validation_passed boolean",
    )
    leaflets = spark.createDataFrame([(1, "L1", None, None, None, None, 2, "completed", None, None, 10, 0.5), (2, "L2", "shop", None, None, None, 1, "failed", None, None, 0, 0.0)], "leaflet_id long, human_id string, retailer string, country string, language string, currency string, page_count long, status string, started_at date, completed_at date, tokens long, cost double")
    wanted = spark.createDataFrame([(1,), (3,), (2,), (1,)], "leaflet_id long")
    answers = {r.leaflet_id: (r.products, r.error) for r in exports.bulk_export(products, leaflets, wanted, f"{tmp_path}/out").collect()}
    assert answers == {1: (2, None), 2: (0, None), 3: (0, "Leaflet not found: 3")}
    (line,) = spark.read.text(f"{tmp_path}/out/leaflet_id=1").collect()
    document = json.loads(line.value)
    assert list(document) == ["leaflet_id", "total_pages", "total_products", "retailer", "country", "language", "currency", "products", "metadata", "quality_metrics"]
    assert document["quality_metrics"] == {"overall_confidence": 0.75, "auto_approved_count": 1, "review_required_count": 1, "api_tokens_used": 10, "processing_cost": 0.5}
    assert [p["product_name"] for p in document["products"]] == ["milk", "bread"] and document["products"][0]["discounted_price"] is None


def test_a_part_goes_when_it_is_in_the_document(tmp_path, monkeypatch):
    writer, done = exports._Writer({"path": f"{tmp_path}/all.json"}), []
    (tmp_path / "all.json.parts").mkdir()
    parts = [exports._Part(i, f"{tmp_path}/all.json.parts/{i}", 1) for i in range(3)]
    for p in parts:
        open(p.path, "w").write('{"id":%d}' % p.number)
    system, path = exports.file_system(writer.path)

    class Noting:
        def __getattr__(self, name):
            done.append((name, len(list((tmp_path / "all.json.parts").iterdir()))))
            return getattr(system, name)

    monkeypatch.setattr(exports, "file_system", lambda _: (Noting(), path))
    writer.commit(parts)
    assert [n for name, n in done if name == "open_input_stream"] == [3, 2, 1]
    assert '{"id":0},\n{"id":1},\n{"id":2}' in open(tmp_path / "all.json").read()
