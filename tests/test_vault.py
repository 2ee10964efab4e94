"""The token vault: lasting, collision-free, repeatable."""

import pytest
from pyspark.sql import functions as F

from veilspark.sources.vault import TokenVault


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_tokens_last_and_only_buckets_of_new_values_change(spark, tmp_path):
    vault = TokenVault(spark, str(tmp_path), b"k", buckets=32)
    assert vault.extend(frame(spark, [f"v{i}" for i in range(50)] + [None, "v1"])) == 50
    first = {r.value: r.token for r in vault.by_value.rows().collect()}
    again = TokenVault(spark, str(tmp_path), b"k", buckets=32)
    assert again.extend(frame(spark, ["v3", "new", None])) == 1
    assert len(again.by_value.current()[1].rewritten) == 1 == len(again.by_token.current()[1].rewritten)
    second = {r.value: r.token for r in again.by_value.rows().collect()}
    assert {v: second[v] for v in first} == first and len(second) == 51 == len(set(second.values()))
    number = again.by_value.current()[1].number
    assert again.extend(frame(spark, ["v3"])) == 0 and again.by_value.current()[1].number == number
    got = again.tokens(frame(spark, ["v3", "new", "unknown"])).collect()
    assert {r.value: r.token for r in got} == {v: second[v] for v in ("v3", "new")}
    assert {r.token: r.value for r in again.values(spark.createDataFrame([(second["new"],), ("TKN-0",)], "token string")).collect()} == {second["new"]: "new"}


def test_two_digits_without_a_collision(spark, tmp_path):
    """40 values on 256 tokens meet often."""
    vault = TokenVault(spark, str(tmp_path), b"k", digits=2, buckets=4, hidden=False)
    vault.extend(frame(spark, [f"v{i}" for i in range(25)]))
    vault.extend(frame(spark, [f"v{i}" for i in range(15, 40)]))
    rows = vault.by_value.rows().collect()
    assert len({r.value for r in rows}) == len({r.token for r in rows}) == 40 and all(len(r.token) == 6 for r in rows)
    assert {(r.value, r.token) for r in rows} == {(r.value, r.token) for r in vault.by_token.rows().collect()}


def test_a_run_that_stopped_between_its_tables_is_finished(spark, tmp_path, monkeypatch):
    vault = TokenVault(spark, str(tmp_path), b"k", buckets=4, hidden=False)
    with monkeypatch.context() as m:
        m.setattr(vault.by_value, "apply", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            vault.extend(frame(spark, ["a", "b"]))
    assert vault.by_token.rows().count() == 2 and vault.by_value.rows().count() == 0
    assert vault.extend(frame(spark, ["a", "b", "c"])) == 3
    assert {(r.value, r.token) for r in vault.by_value.rows().collect()} == {(r.value, r.token) for r in vault.by_token.rows().collect()}


def test_recomputed_tokens_are_the_same(spark, tmp_path):
    made = []
    for k in (1, 5):
        vault = TokenVault(spark, str(tmp_path / str(k)), b"k", digits=3, buckets=2, hidden=False)
        vault.extend(frame(spark, [f"v{i}" for i in range(60)]).repartition(k))
        made.append({(r.value, r.token) for r in vault.by_value.rows().orderBy(F.rand()).collect()})
    assert made[0] == made[1]


def test_too_few_tokens(spark, tmp_path, monkeypatch):
    with pytest.raises(ValueError):
        TokenVault(spark, str(tmp_path), b"k", digits=0)
