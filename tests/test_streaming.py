"""A suite over the batches of a stream, and the settings tables."""

from dataplumb import config
from dataplumb.streaming.batches import check_stream


def test_stream(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    found = []
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    suite = [{"check_name": "rows", "check_type": "volume", "table_name": "stream_rows", "lower_threshold": 9}]
    query = check_stream(stream, "stream_rows", suite, lambda rows, n: found.extend((n, r.value, r.status) for r in rows.collect()), str(tmp_path / "check"))
    query.processAllAvailable()
    query.stop()
    assert found == [(0, 5.0, "fail")]


def test_settings(spark):
    assert config.contract_version() == "1"
    assert dict(config.email_config().collect())["email_smtp_port"] == "25"
    assert config.ner_status().first().status == "NOT_AVAILABLE"
