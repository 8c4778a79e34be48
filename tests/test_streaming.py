"""The row-wise steps are plain projections: the same result on a stream as in batch."""

from segrules.functions.paths import clean_path
from segrules.session import shared_path
from segrules.sources.tables import read_table

from conftest import SF_SMALL


def test_clean_path_on_a_stream(spark):
    pages = read_table(spark, SF_SMALL, "pages", ["page_id", "url"])
    src = shared_path(spark, "pages-stream-src")
    pages.write.parquet(src)
    stream = spark.readStream.schema(pages.schema).parquet(src)
    query = (
        stream.select("page_id", clean_path("url").alias("cleaned"))
        .writeStream.format("memory")
        .queryName("segrules_clean_stream")
        .option("checkpointLocation", shared_path(spark, "pages-stream-ckpt"))
        .start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted(tuple(r) for r in spark.table("segrules_clean_stream").collect())
    want = sorted(tuple(r) for r in pages.select("page_id", clean_path("url").alias("cleaned")).collect())
    assert got == want and len(got) == pages.count()
