"""Properties that hold on any table, and tables that are odd."""

import hmac
import re

import pytest
from pyspark.sql import functions as F

from veilspark.functions import keyed
from veilspark.operators import closure, gates, masking, policy, registry, selection
from veilspark.sources import readers, writers
from veilspark.streaming import streams

KEY = b"k" * 70


@pytest.fixture(scope="module")
def people(spark):
    rows = [(i, f"Name {i}", None if i % 5 == 0 else f"2024-{i % 12 + 1:02d}-{i % 28 + 1:02d}") for i in range(100)] + [(None, None, "2024-13-45"), (7, "Name 7", "20240115"), (8, "", "2024")]
    return spark.createDataFrame(rows, "member_id long, full_name string, birth_date string")


def test_digest_equals_the_standard_library(people):
    for hidden in (True, False):
        d = masking.Masker(KEY, hidden).digest(F.col("member_id"), "s")
        for r in people.select("member_id", d.alias("d")).collect():
            assert r.d == (None if r.member_id is None else hmac.new(KEY, f"s:{r.member_id}".encode(), "sha256").hexdigest())


def test_a_hidden_key_is_not_in_the_plan(people):
    df = people.select(masking.Masker(b"very-secret-key").digest(F.col("member_id"), "s"))
    plan = df._jdf.queryExecution().toString()
    assert "very-secret" not in plan and b"very-secret-key".hex() not in plan.lower()


def test_masking_twice_and_in_two_tables_is_equal(people):
    m = masking.Masker(KEY, hidden=False)
    tiers = {"member_id": "direct_identifier", "full_name": "direct_identifier", "birth_date": "quasi_identifier"}
    one, two = m.table(people, tiers).collect(), m.table(people.repartition(5), tiers).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))
    raw = {r.full_name for r in people.collect() if r.full_name}
    assert not raw & {r.full_name for r in one}
    assert {r.birth_date for r in one if r.birth_date and not re.match(masking.ISO_DATE, r.birth_date)} == {masking.BAD_DATE}
    linked = people.select(F.col("member_id").alias("patient_id"))
    other = m.table(linked, {"patient_id": "direct_identifier"})
    assert other.join(m.table(people, tiers), F.col("patient_id") == F.col("member_id"), "left_anti").where("patient_id IS NOT NULL").count() == 0


def test_shapes_survive(spark):
    df = spark.createDataFrame([("Ab-12 é",), ("",), (None,), ("x" * 200,)], "v string")
    got = [r.v for r in df.select(masking.same_shape(F.col("v"), keyed.hmac_hex(F.col("v"), "s", KEY)).alias("v")).collect()]
    assert re.fullmatch(r"[A-Z][a-z]-[0-9]{2} é", got[0]) and got[1] == "" and got[2] is None and re.fullmatch("[a-z]{200}", got[3])


def test_picks_are_exact_and_alike(spark, monkeypatch):
    df = spark.range(5000).withColumnRenamed("id", "k")
    want = {r.k for r in keyed.pick(df, "k", 1234, 1).collect()}
    monkeypatch.setattr(keyed, "SORTED_PICK", 10)
    assert {r.k for r in keyed.pick(df.repartition(6), "k", 1234, 1).collect()} == want and len(want) == 1234
    assert keyed.pick(df, "k", 9000, 1).count() == 5000 and keyed.pick(df.limit(0), "k", 3, 1).count() == 0
    for bad in (0, -1, 101):
        with pytest.raises(ValueError):
            selection.percentage_sample(df, "k", bad, 1)
    assert selection.percentage_sample(df.limit(0), "k", 50, 1).count() == 0
    assert selection.percentage_sample(df.limit(3), "k", 1, 1).count() == 1


def test_closure_leaves_no_engine_bug_and_may_be_everything(spark):
    from veilspark.plans.base import estate

    e = estate(spark, "/root/testdata/sf0.001")
    everyone = e["member"].select("member_id").persist()
    for anchors in (everyone, everyone.limit(0), everyone.limit(1)):
        found = closure.verdict(closure.dangling(closure.closure(e, anchors), e)).first()
        assert found.engine_bug == 0
    full = closure.closure(e, everyone)
    assert full["coverage"].count() == e["coverage"].count() and full["claim_line"].join(full["claim"], "claim_id", "left_anti").count() == 0
    broken = {**full, "provider": full["provider"].limit(0)}
    assert closure.verdict(closure.dangling(broken, e)).first().verdict == "failed"


def test_filters_reach_the_scan(spark):
    from veilspark.plans import QUERIES

    plan = QUERIES["filter_status"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan


def test_leaks_by_substring_and_by_pieces(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "id Customer#1 here"), (2, "clean"), (3, None), (4, "abc")], "i int, t string")
    raw = spark.createDataFrame([("Customer#1",), ("abc",), (None,)], "v string")
    assert [r.i for r in gates.leaks(texts, "t", raw, "v").collect()] == [1]
    monkeypatch.setattr(gates, "LEAK_BYTES", 1)
    assert [r.i for r in gates.leaks(texts, "t", raw, "v").collect()] == [1]


def test_leaks_are_the_same_at_every_size(spark, monkeypatch):
    values = ["Ann Lee", "123-45-6789", "a.b@c.org", "2024/01/02", "Zoë Ågren", "Customer#000000123", "Customer#000000124", "aaaa", "x" * 300, "abc", "", None]
    lines = ["to Ann Lee.", "ssn 123-45-6789", "xa.b@c.orgx", "on 2024/01/02", "fra Zoë Ågren", "idCustomer#000000123x", "Customer#00000012", "Ann  Lee", "aaa", "aaaaa", "y" * 250 + "Ann Lee" + "é" * 600 + "123-45-6789", "x" * 299, "x" * 301, "abc", "", None, "to Ann Lee."]
    texts, raw = spark.createDataFrame(list(enumerate(lines)), "i int, t string").withColumn("i", F.when(F.col("i") == 16, 0).otherwise(F.col("i"))), spark.createDataFrame([(v,) for v in values], "v string")
    want = sorted(0 if i == 16 else i for i, t in enumerate(lines) if t and any(v in t for v in values if v and len(v) >= 4))
    assert sorted(r.i for r in gates.leaks(texts, "t", raw, "v").collect()) == want
    monkeypatch.setattr(gates, "LEAK_BYTES", 1)
    assert sorted(r.i for r in gates.leaks(texts, "t", raw, "v").collect()) == want


def test_a_leak_of_any_member_is_seen_in_any_table(spark):
    from veilspark.plans import quality_queries

    SF = "/root/testdata/sf0.001"
    raw = quality_queries.entity(spark, SF, "member")
    frames = {"member": quality_queries.masked(spark, SF, "member"), "other": raw.where("member_id % 50 = 4").select("member_id", F.concat(F.lit("note of "), "name").alias("note"))}
    cells = gates.text_cells(frames)
    found = gates.leaks(cells, "text", raw, "name").select("entity", "column_name", "text").collect()
    assert {(x.entity, x.column_name) for x in found} == {("other", "note")} and len(found) == frames["other"].count() > 0


def test_gates_fail_when_they_should(spark):
    g = spark.createDataFrame([("a", True), ("b", False)], "gate string, passed boolean")
    assert gates.certify(g).first().status == "failed" and gates.certify(g.where("passed")).first().status == "certified" and gates.certify(g.limit(0)).first().status == "failed"
    links = spark.createDataFrame([("s", "1", "x"), ("s", "1", "y"), ("s", "2", "x"), ("t", "1", "z")], "scope string, original string, masked string")
    assert [r.original for r in gates.inconsistent(links).collect()] == ["1"] and [r.masked for r in gates.collisions(links).collect()] == ["x"]
    one = spark.range(50).select((F.col("id") * 1.0).alias("c"))
    assert gates.fingerprint(one, KEY).first() == gates.fingerprint(one.repartition(7), KEY).first() != gates.fingerprint(one.where("c > 0"), KEY).first()


def test_policy_covers_every_protected_column():
    for tier in ("direct_identifier", "quasi_identifier", "sensitive_clinical_attribute"):
        for column in ("member_id", "email", "anything", "zip", "billed_amount", "birth_date"):
            assert policy.resolve(tier, column).technique != "passthrough"
    assert policy.resolve("direct_identifier", "pat_id").scope == policy.resolve("quasi_identifier", "member_id").scope
    assert policy.resolve(None, "new_column") == policy.Rule("hmac_pseudonymization", "generic", "unclassified:new_column")


def test_transitions(spark):
    rows = [(1, 1, "draft"), (1, 2, "processing"), (1, 3, "published"), (2, 1, "failed")]
    h = spark.createDataFrame([(i, e, e, s) for i, e, s in rows], "id int, event_id int, occurred_at int, status string")
    assert [(r.id, r.event_id) for r in registry.illegal_transitions(h, registry.REPORT_CHANGES).collect()] == [(1, 3)]


def test_broken_lines_and_absent_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n\n{broken\n')
    df = spark.range(1).selectExpr("CAST(1 AS BIGINT) AS a")
    read = readers.read_ndjson(spark, str(tmp_path / "a.json"), df.schema).cache()
    assert read.count() == 2 and read.where("_corrupt_record IS NULL").count() == 1
    assert readers.read_relational(spark, str(tmp_path), "none", df.schema).count() == 0
    feed = tmp_path / "feed"
    feed.mkdir()
    (feed / "x.txt").write_text("lab|pat\n1|2\n")
    (feed / "y.json").write_text('[{"lab": 3}, {"lab": 4}]')
    (feed / "z.json").write_text('{"lab": 5}')
    one, two = readers.read_partner_feed(spark, str(feed), {"lab": "long", "pat": "string"}, spark.range(0).selectExpr("id AS lab").schema)
    assert [tuple(r) for r in one.collect()] == [(1, "2", "x.txt")] and sorted(tuple(r) for r in two.collect()) == [(3, "y.json"), (4, "y.json")]


def test_a_failed_publication_leaves_nothing(spark, tmp_path):
    def fail(path):
        spark.range(3).write.parquet(path)
        raise RuntimeError

    with pytest.raises(RuntimeError):
        writers.publish(spark, str(tmp_path / "out"), fail)
    assert not list(tmp_path.iterdir())
    writers.publish(spark, str(tmp_path / "out"), lambda p: spark.range(3).write.parquet(p))
    assert readers.is_complete(spark, str(tmp_path / "out"))


def test_late_rows_stay(spark):
    df = spark.sql("SELECT DATE '2024-06-01' AS d, DATE '2024-01-01' AS h UNION ALL SELECT DATE '2024-01-02', DATE '2024-01-01' UNION ALL SELECT NULL, DATE '2024-01-01'")
    assert sorted(r.late for r in streams.mark_late(df, "d", "h").collect()) == [False, False, True]


def test_rules_as_joins_equal_those_of_a_single_column(spark):
    from veilspark.operators import policy, rules

    names = ["MEMBER_ID", "pat_id", "ssn", "home_ssn_no", "e_mail", "Fax", "first_name", "patient_name", "addr_line1", "city", "zip5", "mrn", "group_number", "service_date_raw", "birth", "amount", "note", "provider_name", "npi", "quantity", "line_number", "result", None]
    tiers = [*policy.FALLBACK, None]
    rows = [(f"e{i % 3}", n, t) for n in names for i, t in enumerate(tiers)]
    rows = [(f"{e}.{i}", n, t) for i, (e, n, t) in enumerate(rows)]
    got = rules.resolve(spark.createDataFrame(rows, "entity string, column_name string, tier string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.column_name is not None:
            want = policy.resolve(r.tier, r.column_name)
            assert (r.technique, r.field_type, r.scope) == (want.technique, want.field_type, want.scope), r
    assert {r.scope for r in got if r.column_name == "MEMBER_ID" and r.tier == "direct_identifier"} == {"member-id-global"}
    assert {r.technique for r in got if r.column_name == "service_date_raw" and r.tier == "direct_identifier"} == {"date_shift"}


def test_classification_by_joins(spark):
    from veilspark.operators import profile, rules

    names = ["member_id", "ssn", "npi", "dob", "claim_id", "note", "paid", "zip", "delivered_at", "status"]
    rows = [(e, n) for e in ("provider", "claim", "Pharmacy ") for n in names]
    columns = spark.createDataFrame(rows, "entity string, column_name string")
    ruled, over = {("claim", "status"): "non_sensitive", ("claim", "ssn"): "pii"}, {("claim", "ssn"): "phi"}
    frame = lambda d: spark.createDataFrame([(*k, v) for k, v in d.items()], "entity string, column_name string, category string")
    got = {(r.entity, r.column_name): (r.category, r.confidence, r.layer) for r in rules.classify(columns, frame(ruled), frame(over)).collect()}
    assert got == {(e, n): profile.classify(e, n, rules=ruled, overrides=over) for e, n in rows}
    assert got["claim", "ssn"] == ("phi", 1.0, "override") and got["Pharmacy ", "npi"][1] == 0.95


def test_gates_fail_where_they_should(spark):
    from veilspark.operators import gates

    known = "entity string, column_name string, tier string, technique string, n_values long"
    passed = lambda *rows: gates.policy_coverage(spark.createDataFrame(list(rows), known)).first()
    good = ("claim", "status", "non_sensitive", "passthrough", 9)
    assert passed(good).passed and passed().passed
    assert (passed(good, ("claim", "x", None, "hmac_pseudonymization", 5)).passed, passed(good, ("claim", "x", None, "h", 5)).detail) == (False, "5")
    assert not passed(("member", "ssn", "direct_identifier", "passthrough", 3)).passed
    shape = "source_n long, source_mean double, source_nonzero long, masked_n long, masked_mean double, masked_nonzero long"
    ratio = lambda *row: gates.mean_ratio(spark.createDataFrame([row], shape)).first().passed
    assert ratio(9, 10.0, 9, 9, 40.0, 9) and not ratio(9, 10.0, 9, 9, 400.0, 9) and not ratio(9, 10.0, 9, 9, 0.0, 0) and ratio(3, 1.0, 3, 3, 999.0, 3)


def test_leaks_of_any_shape_on_both_sides_of_the_size(spark, monkeypatch):
    from veilspark.operators import gates

    raw = spark.createDataFrame([("Mary Ann",), ("12-34-5678",), ("Johnson",), ("abc",), (None,), ("é@x.org",)], "v string")
    texts = spark.createDataFrame([(1, "to Mary Ann, sir"), (2, "n 12-34-5678."), (3, "xxJohnsonyy"), (4, "abc"), (5, None), (6, "Mary  Ann"), (7, "q" * 700 + "é@x.org")], "i int, t string")
    found = []
    for limit in (gates.LEAK_BYTES, 0):
        monkeypatch.setattr(gates, "LEAK_BYTES", limit)
        found.append(sorted(r.i for r in gates.leaks(texts, "t", raw, "v").collect()))
    assert found == [[1, 2, 3, 7], [1, 2, 3, 7]]
