import pytest

from hearsay.sources import jsonl


def test_reviews_and_drop_counts(spark, tmp_path):
    lines = [
        '{"recommendationid": "9", "language": "english", "review": "fine", "timestamp_created": 1577836800, "voted_up": true}', "",
        '{"recommendationid": "10", "language": "english", "review": "\\u200b \\n", "timestamp_created": 1577836801, "voted_up": false}',
        '{"recommendationid": "11", "language": "german", "review": "gut", "timestamp_created": 1577836802, "voted_up": true}',
        '{"recommendationid": "12", "language": "english", "review": null, "timestamp_created": 1577836803, "voted_up": true}',
    ]
    (tmp_path / "42_reviews.jsonl").write_text("\n".join(lines))
    got = jsonl.read_reviews(spark, str(tmp_path / "42_reviews.jsonl"))
    assert {r.app_id for r in got.collect()} == {42}
    assert tuple(jsonl.drop_counts(got).first()) == (42, 4, 1, 2, 1)
    (tmp_path / "43_reviews.jsonl").write_text('{"recommendationid": ')
    with pytest.raises(Exception, match="not a review record"):
        jsonl.read_reviews(spark, str(tmp_path / "43_reviews.jsonl")).collect()


def test_written_lines_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b\n", None), (1, None, 0.5), (3, "é\"", 1.0)], "i long, t string, x double")
    jsonl.write_lines(rows, str(tmp_path / "out"), "i")
    back = spark.read.schema(rows.schema).json(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert jsonl.fingerprint(back).first() == jsonl.fingerprint(rows.repartition(3)).first()
