import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vistaforge.sources import cache, catalog, extract
from vistaforge.streaming import ingest


@pytest.fixture()
def folder(tmp_path):
    for name in ("b/x.JPG", "a/y.png", "a/z.txt", "a/deep/w.gif", "b/none"):
        p = tmp_path / "img" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"\xff\xd8\xff" + name.encode())
    return str(tmp_path / "img")


def test_scan_append_and_describe(spark, folder):
    c = catalog.scan_folder(spark, folder)
    got = {r["path"].split("/img/")[1]: r["image_id"] for r in c.collect()}
    assert got == {"a/deep/w.gif": 0, "a/y.png": 1, "b/x.JPG": 2}
    more = catalog.append_to_catalog(c, spark.createDataFrame([("/0.png",), (folder + "/a/y.png",)], "path string"))
    assert {r["path"]: r["image_id"] for r in more.collect()}["/0.png"] == 3 and more.count() == 4
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content").join(c, "path")
    g = extract.global_descriptors(files, "t", lambda: extract.HashExtractor(8), batch=2).collect()
    assert len(g) == 3 and all(len(r["embedding"]) == 8 for r in g)
    assert extract.local_features(files, "t", lambda: extract.HashExtractor(8, 5)).count() == 15
    extract.unload("t")


def test_cached_is_made_again_only_when_something_changed(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3).toDF("x")

    images, path = spark.createDataFrame([("a",), ("b",)], "path string"), str(tmp_path / "t")
    for settings, imgs, force in (({"k": 1}, images, False), ({"k": 1}, images, False), ({"k": 2}, images, False), ({"k": 2}, images.limit(1), False), ({"k": 2}, images.limit(1), True)):
        assert cache.cached(spark, path, imgs, settings, make, force).count() == 3
    assert len(made) == 4


def test_local_feature_store_reads_only_the_shortlist(spark, tmp_path):
    path = str(tmp_path / "lf")
    f = spark.range(200).select((F.col("id") % 20).alias("image_id"), F.col("id").cast("int").alias("kp_idx"), F.array(F.lit(1.0)).alias("desc"))
    cache.write_local_features(f, path, 8)
    got = cache.read_local_features(spark, path, spark.createDataFrame([(3,), (3,), (99,)], "image_id long"), 8)
    assert got.count() == 10


def test_header_of_broken_files():
    for data in (b"", b"\xff\xd8", b"\xff\xd8\xff\xe0", b"GIF8", b"\x89PNG\r\n\x1a\n", b"BM12"):
        assert catalog.header_size(data) == (None, None)


def test_stream_describes_every_image_once(spark, tmp_path):
    src, sink, chk = (str(tmp_path / n) for n in ("src", "sink", "chk"))
    (tmp_path / "src").mkdir()
    schema = "image_id long, path string"
    for n, ids in enumerate(([1, 2, 2, None], [2, 3])):
        pq.write_table(pa.table({"image_id": pa.array(ids, pa.int64()), "path": [str(i) for i in ids]}), f"{src}/{n}.parquet")
        q = ingest.ingest(spark, src, schema, sink, chk, lambda df: df.withColumn("size", F.length("path")))
        q.awaitTermination(120)
    assert sorted(r["image_id"] for r in spark.read.parquet(sink).collect()) == [1, 2, 3]


def test_windowed_counts(spark, tmp_path):
    (tmp_path / "s").mkdir()
    spark.sql("select timestamp'2024-01-01 10:00:00' as taken_at, 'a' as album union all select timestamp'2024-01-01 11:00:00', 'a'").write.mode("overwrite").parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("taken_at timestamp, album string").parquet(str(tmp_path / "s"))
    q = ingest.album_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["n"] for r in spark.sql("select n from counts").collect()] == [2]
