import datetime
import json
import random

import pytest

from tidemark.functions import decoding
from tidemark.sources.catalog import Catalog
from tidemark.sources.jdbc import decoded_table, jdbc_table


def of(spark, kind, *texts):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    out = df.select("n", decoding.decoded(F.col("t"), kind).alias("v"))
    if not kind.endswith("[]"):
        assert out.schema["v"].dataType.simpleString() == decoding.spark_type(kind)
    return [r.v for r in out.orderBy("n").collect()]


def test_plain_values(spark):
    assert of(spark, "int8", "9007199254740993", "-1", "x", None) == [9007199254740993, -1, None, None]
    assert of(spark, "float8", "1.5", "-2e3", "") == [1.5, -2000.0, None]
    assert of(spark, "numeric", "12.25") == [12.25]
    assert of(spark, "bool", "t", "f", "true", None) == [True, False, True, None]
    assert of(spark, "uuid", "a-b", None) == ["a-b", None]


def test_times(spark):
    ms = lambda *a: datetime.datetime(*a, tzinfo=datetime.UTC).timestamp() * 1000
    assert of(spark, "date", "2024-02-29", "1970-01-01", "0001-01-01", "infinity", "2024-13-01", "0001-12-31 BC") == [ms(2024, 2, 29), 0.0, ms(1, 1, 1), None, None, ms(1, 1, 1) - 86_400_000]
    stamps = ["2024-05-06 07:08:09.123456", "2024-05-06T07:08:09+02", "2024-05-06 07:08:09-03:30", "1999-12-31 24:00:00", "2024-05-06", "junk", None]
    day = ms(2024, 5, 6, 7, 8, 9)
    assert of(spark, "timestamptz", *stamps) == [day + 123.456, day - 7_200_000, day + 12_600_000, ms(2000, 1, 1), None, None, None]
    assert of(spark, "time", "00:00:01.5", "23:59:59", "25:00:00") == [1500.0, 86_399_000.0, None]
    assert of(spark, "timetz", "01:00:00+01") == [0.0]
    draw, days = random.Random(1), []
    for _ in range(200):
        days.append(datetime.date(1, 1, 1) + datetime.timedelta(days=draw.randrange(3_600_000)))
    assert of(spark, "date", *map(str, days)) == [(d - datetime.date(1970, 1, 1)).days * 86_400_000.0 for d in days]


def test_arrays(spark):
    texts = ["{1,2,NULL}", "{{1,2},{3,4}}", "{}", "[0:1]={5,6}", "1,2", "{1", None]
    assert [x and json.loads(x) for x in of(spark, "int4[]", *texts)] == [[1, 2, None], [[1, 2], [3, 4]], [], [5, 6], None, None, None]
    words = ['{a,"b c","d\\"e","f\\\\g",NULL,"NULL",""}', '{"{x}","a,b","é\nz"}']
    assert [json.loads(x) for x in of(spark, "text[]", *words)] == [["a", "b c", 'd"e', "f\\g", None, "NULL", ""], ["{x}", "a,b", "é\nz"]]
    assert [json.loads(x) for x in of(spark, "bool[]", "{t,f}")] == [[True, False]]
    assert [json.loads(x) for x in of(spark, "date[]", "{1970-01-02}")] == [[86_400_000]]


def test_a_database_table(spark, tmp_path):
    """The database that comes with Spark."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    try:
        spark.createDataFrame([(k, f"t{k}", "2024-01-01") for k in range(50)], "ID long, NAME string, DAY string").write.format("jdbc").options(url=url, dbtable="THINGS").save()
    except Exception as e:
        if "No suitable driver" in str(e) or "ClassNotFound" in str(e):
            pytest.skip("no database driver")
        raise
    df = jdbc_table(spark, url, "THINGS", split_by="ID", splits=4)
    assert df.rdd.getNumPartitions() == 4 and sorted(r.ID for r in df.collect()) == list(range(50))
    assert jdbc_table(spark, url, "THINGS", ["NAME"], where="ID < 3").count() == 3
    assert jdbc_table(spark, url, "THINGS", split_by="ID", where="ID < 0").count() == 0
    assert decoded_table(df, {"DAY": "date"}).where("DAY = 1704067200000").count() == 50


def test_schema_for_clients(spark):
    from tidemark.plans.builder import hop

    c = Catalog()
    c.declare(spark, "post", "id long not null, title string, tags array<string>, at timestamp, ok boolean", "id").relate("author", hop("title", "user", "id", one=True))
    with pytest.raises(ValueError, match="unknown table user"):
        c.check()
    c.declare(spark, "user", "id string", "id")
    c.check()
    own = c.client_schema(["post"])["tables"]["post"]
    assert {n: x["type"] for n, x in own["columns"].items()} == {"id": "number", "title": "string", "tags": "json", "at": "number", "ok": "boolean"}
    assert own["primaryKey"] == ["id"] and own["relationships"]["author"] == [{"sourceField": ["title"], "destTable": "user", "destField": ["id"], "cardinality": "one"}]
    with pytest.raises(ValueError, match="has no column"):
        c.declare(spark, "bad", "id long", "key")
