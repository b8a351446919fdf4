from risewatch.functions import sql


def test_sql_callable_forms(spark):
    sql.register(spark)
    assert spark.sql("select indel_similarity('abcd', 'abcde') s").first().s == 8 / 9
    assert spark.sql("select decode_entities('a &amp; b') s").first().s == "a & b"
    rows = spark.sql("select * from burst_segments('011001', array(1D, 5D, 7D, 0D, 0D, 2D))").collect()
    assert [tuple(r) for r in rows] == [(1, 2, 7.0), (5, 5, 2.0)]
