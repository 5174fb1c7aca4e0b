"""The dataset catalog: distinct ids and names whatever the writers do, and no silent emptiness."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from cirrus.sources import sinks


def test_two_writers_keep_both_rows(spark, tmp_path):
    path = str(tmp_path / "catalog")
    df = spark.range(5)

    def write(i):
        return sinks.Catalog(spark, path).register(df, str(tmp_path / f"d{i}"), f"data {i}", 1)

    with ThreadPoolExecutor(max_workers=6) as pool:
        ids = list(pool.map(write, range(6)))
    assert sorted(ids) == [1, 2, 3, 4, 5, 6]
    table = sinks.Catalog(spark, path).table()
    assert sorted(r["id"] for r in table.collect()) == [1, 2, 3, 4, 5, 6]
    assert {r["name"] for r in table.collect()} == {f"data {i}" for i in range(6)}
    assert all(r["row_count"] == 5 and r["root_id"] == r["id"] and r["uploaded_at"] is not None for r in table.collect())


def test_a_name_is_taken_once_whoever_is_first(spark, tmp_path):
    path = str(tmp_path / "catalog")

    def write(i):
        try:
            return sinks.Catalog(spark, path).register(spark.range(2), str(tmp_path / f"d{i}"), "same", 7)
        except ValueError:
            return None

    with ThreadPoolExecutor(max_workers=4) as pool:
        got = list(pool.map(write, range(4)))
    assert sorted(x for x in got if x is not None) == [1] and sinks.Catalog(spark, path).table().count() == 1
    assert sinks.Catalog(spark, path).register(spark.range(2), str(tmp_path / "other"), "same", 8) == 2


def test_a_commit_number_is_taken_once(spark, tmp_path):
    cat = sinks.Catalog(spark, str(tmp_path / "catalog"))
    row = {"id": 1, "name": "a", "user_id": 1}
    cat._commit(1, row)
    with pytest.raises(sinks.Clash):
        cat._commit(1, {**row, "name": "b"})
    assert [r["name"] for r in cat.table().collect()] == ["a"] and cat._numbers() == [1]


def test_lineage_and_missing_or_unreadable_catalogs(spark, tmp_path):
    path = tmp_path / "catalog"
    cat = sinks.Catalog(spark, str(path))
    assert cat.table().count() == 0
    a = cat.register(spark.range(3), str(tmp_path / "a"), "a", 1)
    b = cat.register(spark.range(3), str(tmp_path / "b"), "a_normalized", 1, parent_id=a, method="Z_SCORE")
    c = cat.register(spark.range(3), str(tmp_path / "c"), "c", 1, parent_id=b, method="MIN_MAX")
    got = {r["id"]: r for r in cat.table().collect()}
    assert (got[c]["root_id"], got[c]["parent_name"], got[b]["parent_id"], got[a]["is_normalized"]) == (a, "a_normalized", a, False)
    (path / f"{9:020d}.json").write_text("not a row")
    with pytest.raises(Exception):
        cat.table().collect()
    with pytest.raises(Exception):
        cat.register(spark.range(3), str(tmp_path / "x"), "x", 1)
