from pyspark.sql import functions as F

from trustlake.functions import scrub, shapes, text

PHONES = {"+255766000001": "255766000001", "255766000001.0": "255766000001", "00255766000001": "255766000001", "  255766000001 ": "255766000001", "0712345678": "0712345678", "a3f09c11d2": "a3f09c11d2", "25.50": "25.50", "": None, "  ": None, "nan": None, "NaN": None, None: None, "+": None, "00": None, "0": "0", "+00255": "255", "255.0": "255"}


def one(spark, values, build, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(build(F.col("v"))).collect()]


def test_phones(spark):
    assert one(spark, list(PHONES), text.normalize_phone) == list(PHONES.values())


def test_phone_is_idempotent(spark):
    once = one(spark, list(PHONES), text.normalize_phone)
    assert one(spark, once, text.normalize_phone) == once


def test_blank_to_null_keeps_the_value(spark):
    assert one(spark, [" a ", "", " \t ", " ", None], text.blank_to_null) == [" a ", None, None, None, None]


def test_strict_long_refuses_spaces(spark):
    assert one(spark, ["12", "-3", None], text.strict_long) == [12, -3, None]
    import pytest

    for bad in (" 1 ", "1.0", "x", "1\n"):
        with pytest.raises(Exception, match="whole number"):
            one(spark, [bad], text.strict_long)


def test_safe_ratio(spark):
    df = spark.createDataFrame([(1, 2), (1, 0), (1, None)], "n int, d int")
    assert [r[0] for r in df.select(text.safe_ratio(F.col("n"), F.col("d"))).collect()] == [0.5, None, None]


def test_shapes(spark):
    given = ["+255700000000.0", "BD_TELCO_X", "a1b2", "", None, "é x\ty", "aaa  9"]
    want = ["+9{12}.9", "A{2}_A{5}_A", "a9a9", "<empty>", "<null>", r"U_a\sa", "a{3}_{2}9"]
    assert one(spark, given, shapes.shape_class) == want


def test_matches_ends_at_the_very_end(spark):
    assert one(spark, ["AB", "AB\n", "xAB", None], lambda c: text.matches(c, "^[A-Z]{2,3}$")) == [True, False, False, None]


def test_days_between(spark):
    df = spark.range(1).select(text.days_between(F.lit("2024-02-28").cast("date"), F.lit("2024-03-01").cast("date")))
    assert df.first()[0] == ["2024-02-28", "2024-02-29", "2024-03-01"]


def test_scrub(spark):
    given = {
        "id 123e4567-e89b-12d3-a456-426614174000.": "id <uuid>.",
        "mail a.b@example.com, or c@d.example.org": "mail <email>, or <email>",
        "key 'abc123' and \"x 9\" and `b1`": "key 'a{3}9{3}' and \"a_9\" and `a9`",
        "call +255 700 000 001 or 12 34 56": "call +9{3}_9{3}_9{3}_9{3} or 12 34 56",
        "x deadbeefdeadbeefdeadbeef00 y": "x x{26} y",
        "n 12345678 and +254712345678.0": "n 9{8} and +9{12}.9",
        "path '/tmp/a1' and shape '9{2}a' on 2024-01-05": "path '/tmp/a1' and shape '9{2}a' on 2024-01-05",
        "": "",
        None: None,
        "a\ufdd0b\ufdd1c": "abc",
    }
    once = one(spark, list(given), scrub.scrub)
    assert once == list(given.values())
    assert one(spark, once, scrub.scrub) == once
    assert len(one(spark, ["a " * 4000], scrub.scrub)[0]) == 2000


def test_scrub_stacktrace(spark):
    trace = 'Traceback\n  File "/app/x1.py", line 3\n    call("id 1234567")\r\nValueError: bad value "ab1"\n'
    assert one(spark, [trace, None, ""], scrub.scrub_stacktrace) == ['Traceback\n  File "/app/x1.py", line 3\n    call("id 9{7}")\nValueError: bad value "a{2}9"', None, ""]
    long = one(spark, ["x\n" * 20_000], scrub.scrub_stacktrace)[0]
    assert len(long) == 16_000 and long.endswith("x\nx")


def test_signature(spark):
    a, b, none, word, blank = one(spark, ["row 12 of batch deadbeef12 failed\nmore", " row 99 of  batch deadbeef99 failed", None, "INT32 overflow 9{3}", " \n "], scrub.error_signature)
    assert a == b == "row # of batch <hex> failed"
    assert (none, word, blank) == ("", "INT32 overflow 9{3}", "")
    assert len(one(spark, ["word " * 100], scrub.error_signature)[0]) <= 200
