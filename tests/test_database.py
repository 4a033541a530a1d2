from pyspark.sql import functions as F

from latticework.sources import database


def table(spark, documents):
    rows = [(i, float(i), d) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows, "seq int, energy double, key_value_pairs string")


DOCUMENTS = [
    '{"row_name": "first", "level": 3, "share": 1, "ok": true, "tags": ["a", 1], "energy": 99, "mixed": 1, "it\'s": 2}',
    '{"row_name": "second", "share": 0.25, "note": "text", "mixed": "one"}',
    "{}", None, "no json", '{"level": -7, "nothing": null}',
]


def test_pairs_become_typed_columns(spark):
    told = database.lift_pairs(table(spark, DOCUMENTS))
    kinds = dict(told.dtypes)
    assert (kinds["level"], kinds["share"], kinds["ok"], kinds["note"], kinds["mixed"]) == ("bigint", "double", "boolean", "string", "string")
    rows = {r.seq: r for r in told.collect()}
    assert (rows[0].level, rows[0].share, rows[0].ok, rows[0].tags, rows[0].energy, rows[0]["it's"]) == (3, 1.0, True, '["a",1]', 0.0, 2)
    assert (rows[1].share, rows[1].note, rows[0].mixed, rows[1].mixed, rows[5].level) == (0.25, "text", "1", "one", -7)
    assert all(rows[i].level is None and rows[i].share is None for i in (2, 3, 4))
    assert database.lift_pairs(table(spark, DOCUMENTS), keys=["level", "absent"]).columns == ["seq", "energy", "level", "absent"]


def test_names_hold_where_at_most_one_is_missing(spark):
    def names(documents):
        told = database.named_rows(database.lift_pairs(table(spark, documents)), F.lit("p"), F.col("seq"))
        return [r.config_id for r in told.orderBy("seq").collect()]

    assert names(DOCUMENTS[:2]) == ["first", "second"]
    assert names(DOCUMENTS[:3]) == ["first", "second", "p_2"]
    assert names(DOCUMENTS[:4]) == ["p_0", "p_1", "p_2", "p_3"]
    assert names(["{}"]) == ["p_0"]
    assert database.lift_pairs(table(spark, [])).count() == 0
