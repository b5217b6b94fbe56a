import pytest
from pyspark.sql import functions as F

from trustlake.contracts import Column, ContractError, TableContract
from trustlake.operators import checks as K
from trustlake.operators import mutate as M
from trustlake.plans import usage


@pytest.fixture(scope="module")
def clean(spark):
    rows = [("BD_TELCO_SUB", "255700000001"), ("WEB_STREAM", None), ("PS_TELCO_DL", "255700000002")]
    return spark.createDataFrame(rows, "use_type string, phone_number string")


@pytest.mark.parametrize("check, mutation", [
    (usage.v6_phone_only_on_telco, M.set_value("use_type", "WEB_STREAM", 0)),
    (usage.v21_phone_no_leading_plus, M.add_leading_plus("phone_number")),
    (usage.v24_phone_no_dot, M.float_artifact("phone_number")),
])
def test_checks_catch_their_incident(clean, check, mutation):
    M.assert_catches(check, clean, mutation)


def test_a_mutation_without_effect_proves_nothing(clean):
    with pytest.raises(AssertionError, match="changes nothing"):
        M.assert_catches(usage.v24_phone_no_dot, clean, M.reorder_rows())


def test_null_is_failure_and_empty_is_inconclusive(spark):
    c = K.Check("positive", lambda: F.col("a") > 0, ("a",))
    df = spark.createDataFrame([(1.0,), (None,)], "a double")
    got = c.evaluate(df)
    assert got.verdict is K.Verdict.FAIL and got.measured["failing"] == 1 and got.measured["shapes a"] == {"<null>": 1}
    assert c.evaluate(df.where("false")).verdict is K.Verdict.INCONCLUSIVE
    assert c.failing(df).count() == 1


def test_registry_refuses_a_second_origin():
    K.check(name="once", origin="a")(lambda: F.lit(True))
    with pytest.raises(ValueError, match="already registered"):
        K.check(name="once", origin="b")(lambda: F.lit(True))
    K.REGISTRY.pop("once")


def test_worst():
    e = lambda v: K.Evidence("x", v)
    assert K.worst([]) is K.Verdict.INCONCLUSIVE
    assert K.worst([e(K.Verdict.PASS), e(K.Verdict.INCONCLUSIVE)]) is K.Verdict.INCONCLUSIVE
    assert K.worst([e(K.Verdict.FAIL), e(K.Verdict.INCONCLUSIVE)]) is K.Verdict.FAIL


def test_dirt_and_derivation(spark):
    df = spark.createDataFrame([("a ", "a"), ("b", "b"), (None, None)], "raw string, clean string")
    got = K.measure_dirt(df, "raw", F.trim)
    assert (got.measured["rows"], got.measured["dirty"], got.measured["rate"]) == (3, 1, 0.333333)
    assert K.verify_derivation(df, derived="clean", witness="raw", derive=F.trim).verdict is K.Verdict.PASS
    assert K.verify_derivation(df, derived="raw", witness="clean", derive=lambda c: c).verdict is K.Verdict.FAIL
    assert K.verify_derivation(df.where("false"), derived="raw", witness="clean", derive=F.trim).verdict is K.Verdict.INCONCLUSIVE


def test_verify_repair(spark):
    pre = spark.createDataFrame([(1, "+1", "+1"), (2, "2", "2")], "k int, raw string, n string")
    derive = lambda c: F.regexp_replace(c, r"^\+", "")
    post = pre.withColumn("n", derive(F.col("raw")))
    got = K.verify_repair(pre, post, repaired="n", witness="raw", derive=derive)
    assert got.verdict is K.Verdict.PASS and got.measured["changed"] == 1
    assert K.verify_repair(pre, post.withColumn("k", F.col("k") + 1), repaired="n", witness="raw", derive=derive).verdict is K.Verdict.FAIL
    assert K.verify_repair(pre, post.limit(1), repaired="n", witness="raw", derive=derive).verdict is K.Verdict.FAIL


def test_gates_and_rates(spark):
    df = spark.range(50).select(F.when(F.col("id") >= 10, F.col("id")).alias("x"))
    assert K.null_rate_at_most("x", 0.2)(df).verdict is K.Verdict.PASS
    assert K.null_rate_at_most("x", 0.1)(df).verdict is K.Verdict.FAIL
    assert K.null_rate_at_most("x", 0.2)(df.limit(5)).verdict is K.Verdict.INCONCLUSIVE
    assert K.share_at_least("known", F.col("x") > 0, 0.8)(df).verdict is K.Verdict.PASS
    assert K.rows_at_least(1)(df.where("false")).verdict is K.Verdict.FAIL
    assert K.Rate(1, 0).value is None and (K.Rate(1, 2) + K.Rate(1, 2)).value == 0.5
    assert K.Rate.of(df.where("false"), F.col("x"), F.col("x")).value is None


@pytest.mark.parametrize("m", [M.null_to_zero("x"), M.nudge("x", 1.0), M.drop_row(), M.duplicate_row(), M.set_value("x", 9.0, 1), M.set_where("x", 3.0, "k = 1"), M.prefix("s", "+"), M.suffix("s", "!")])
def test_mutations_change_frames(spark, m):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 2.0, None)], "k int, x double, s string")
    out = m.apply(df)
    assert out.columns == df.columns and not K.same_rows(df, out)


CONTRACT = TableContract("T", "a.t", (Column("k", "int64", True), Column("c", "string", False, "^[A-Z]{2}$"), Column("n", "int32", minimum=0, maximum=5), Column("e", "string", allowed=("x", "y"))), grain=("k",))


def test_contract_validates(spark):
    good = spark.createDataFrame([(1, "AB", 1, "x"), (2, None, None, None)], CONTRACT.struct())
    CONTRACT.validate(good)
    bad = spark.createDataFrame([(1, "abc", 9, "z"), (1, "AB", -1, "x"), (None, "AB", 1, "y")], CONTRACT.struct())
    with pytest.raises(ContractError) as e:
        CONTRACT.validate(bad)
    for part in ("k required: 1", "c pattern: 1", "n minimum: 1", "n maximum: 1", "e allowed: 1", "grain", "a{3}"):
        assert part in str(e.value)
    assert "abc" not in str(e.value)


def test_contract_schema_is_strict(spark):
    df = spark.createDataFrame([(1, "AB", 1.5, 0)], "k long, c string, n double, extra int")
    diff = CONTRACT.schema_diff(df.schema)
    assert any("missing column e" in x for x in diff) and any("unexpected column extra" in x for x in diff) and any("n: double" in x for x in diff)
    assert "order" in CONTRACT.schema_diff(CONTRACT.empty(spark).select("c", "k", "n", "e").schema)[0]


@pytest.mark.parametrize("build", [
    lambda: TableContract("T", "t", (Column("a", "string"),)),
    lambda: TableContract("T", "a.t", (Column("a", "string"), Column("a", "string"))),
    lambda: TableContract("T", "a.t", (Column("a", "blob"),)),
    lambda: TableContract("T", "a.t", (Column("a", "string"),), partition_by="b"),
    lambda: TableContract("T", "a.t", (Column("a", "string"),), grain=("b",)),
])
def test_contract_construction_errors(build):
    with pytest.raises(ContractError):
        build()


def test_fingerprint_ignores_checks_only():
    assert CONTRACT.fingerprint() == CONTRACT.with_checks(usage.v24_phone_no_dot).fingerprint()
    other = TableContract("T", "a.t", tuple(Column(c.name, c.dtype, description="d") for c in CONTRACT.columns))
    assert other.fingerprint() != CONTRACT.fingerprint() and len(other.fingerprint()) == 16


def test_checks_count_in_validation(spark):
    c = TableContract("U", "a.u", (Column("use_type", "string"), Column("phone_number", "string"))).with_checks(usage.v24_phone_no_dot)
    with pytest.raises(ContractError, match="check v24_phone_no_dot: 1"):
        c.validate(spark.createDataFrame([("x", "1.0")], c.struct()))
