from pyspark.sql import functions as F

from tabwork.operators import pii as P
from tabwork.operators import sampling as S


def test_email_phone_ssn_frames(spark):
    e = spark.createDataFrame([("a@example.com", 30), ("b@test.org", 40), ("c@mail.net", 50)], "email string, age int")
    f = {r.column_name: r for r in P.pii_scan_table(e).collect()}
    assert f["email"].entity_type == "EMAIL" and f["email"].sensitivity == "high" and f["email"].match_count == 3
    ph = spark.createDataFrame([("555-123-4567",), ("(555) 987-6543",), ("+1 555 111 2222",)], "phone string")
    assert P.pii_scan_table(ph).first().entity_type == "PHONE"
    ssn = spark.createDataFrame([("123-45-6789",), ("987-65-4321",), ("111-22-3333",)], "ssn string")
    assert P.pii_scan_table(ssn).first().entity_type in ("SSN", "NATIONAL_ID")


def test_clean_frame_has_no_findings(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "value int, label string")
    f = P.pii_scan_table(df)
    assert f.count() == 0
    assert P.pii_risk_score(f, 2).first().risk_score == 0


def test_name_rule_quirk(spark):
    assert P.name_entity("customer_name") == "NAME"
    assert P.name_entity("customer_name", strict=True) is None
    mixed = spark.createDataFrame([("a@b.com", "123-45-6789", "Ann")], "email string, ssn string, full_name string")
    f = P.pii_scan_table(mixed)
    assert P.pii_risk_score(f, 3).first().risk_score > 0


def test_encrypt_round_trip_and_mask(spark):
    df = spark.createDataFrame([("4111 1111 1111 1111",), ("ab",), (None,)], "card string")
    enc = P.pii_apply_encrypt(df.withColumn("orig", F.col("card")), ["card"], "0123456789abcdef")
    dec = P.pii_decrypt(enc, ["card"], "0123456789abcdef").collect()
    assert all(r.card == r.orig for r in dec)
    m = [r.card for r in P.pii_apply_mask(df, ["card"]).collect()]
    assert m[0] == "41" + "*" * 15 + "11" and m[1] == "***" and m[2] is None


def test_luhn_cards_only(spark):
    df = spark.createDataFrame([("4111 1111 1111 1111",), ("4111 1111 1111 1112",)], "c string")
    r = P.pii_text_redact(df, "c").collect()
    assert [x.credit_card_count for x in r] == [1, 0]


def _fold_counts(df):
    return {(r.l_returnflag, r.fold): r["count"] for r in df.groupBy("l_returnflag", "fold").count().collect()}


def test_stratified_folds_balanced_and_repartition_proof(spark, sf):
    from tabwork.session import table
    li = table(spark, sf, "lineitem").withColumn("rid", F.monotonically_increasing_id())
    li = li.select(F.expr("((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber").alias("rid"),
                   "l_returnflag").dropDuplicates(["rid"]).cache()
    a = _fold_counts(S.folds_stratified(li, "l_returnflag", "rid", k=5))
    b = _fold_counts(S.folds_stratified(li.repartition(13), "l_returnflag", "rid", k=5))
    assert a == b
    for cls in {k[0] for k in a}:
        sizes = [a.get((cls, f), 0) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1
    under = S.undersample_random(li, "l_returnflag", "rid").groupBy("l_returnflag").count().collect()
    assert len({r["count"] for r in under}) == 1
