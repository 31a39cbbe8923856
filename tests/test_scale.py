"""What keeps the work of a page, and the memory of its parser, small."""

from html import escape

from pageloom.functions.scalars import escape_html, known_keys
from pageloom.operators.articles import block_json, block_variant
from pageloom.session import BATCH_BYTES
from pyspark.sql import functions as F


def test_batches_of_the_parser_are_small_in_any_session(spark, trees_of):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(limit, str(64 * 1024 * 1024))
    trees_of("<p>x</p>").collect()
    assert int(spark.conf.get(limit)) == BATCH_BYTES
    spark.conf.set(limit, "4096")  # a lower limit stays
    trees_of("<p>x</p>").collect()
    assert spark.conf.get(limit) == "4096"
    spark.conf.set(limit, str(BATCH_BYTES))


def test_only_texts_that_hold_a_character_are_searched_for_it(spark):
    texts = ["", "plain", "&", "&amp;", "a<b>c", "'\"'", "\r\n", "é&<>\"'\r&", "&&<<", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i INT, x STRING")
    got = [r[0] for r in df.orderBy("i").select(F.expr(escape_html("x"))).collect()]
    wanted = [
        x if x is None else escape(x).replace("&#x27;", "&#39;").replace("&quot;", "&#34;").replace("\r", "&#13;")
        for x in texts
    ]
    assert got == wanted
    assert escape_html("x").count("contains(") == 6


def test_keys_are_searched_for_by_name_only_where_one_is_written_otherwise(spark):
    rows = [
        '{"name": "x", "URL": 1}', '{"Name" : "x", "url": 1}', '{"NAME": 1, "name": 2}', '{"x": "\\"Name\\": y"}', "", None,
    ]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i INT, x STRING")
    sql = known_keys("x", ["name", "url"])
    got = [r[0] for r in df.orderBy("i").select(F.expr(sql)).collect()]
    assert got == [
        '{"name": "x", "url": 1}', '{"name" : "x", "url": 1}', '{"name": 1, "name": 2}', '{"x": "\\"Name\\": y"}', "", None,
    ]
    assert "exists" in sql


def test_a_text_becomes_a_variant_without_json(spark):
    image = "STRUCT<url: STRING>"
    df = spark.createDataFrame(
        [("a", "l", 0, "paragraph", 'x "y" \\ \n é', None), ("a", "l", 1, "image", None, ("u",)),
         ("a", "l", 2, "paragraph", None, None), ("a", "l", 3, "paragraph", "", None), ("a", "l", 4, "image", "t", ("u",)),
         ("a", "l", 5, "image", None, (None,)), ("a", "l", 6, None, "t", None)],
        f"id STRING, link STRING, pos INT, type STRING, text STRING, image {image}",
    ).selectExpr("*", f"CAST(NULL AS {image}) AS video", f"CAST(NULL AS {image}) AS ref")
    data = block_variant(df).selectExpr("pos", "to_json(data) AS data").collect()
    parsed = block_json(df).selectExpr("pos", "to_json(parse_json(data)) AS data").collect()
    assert sorted(map(tuple, data)) == sorted(map(tuple, parsed))
    plan = block_variant(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json(array(" not in plan and "structstojson(array" not in plan.lower()
