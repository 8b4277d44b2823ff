"""The store of buckets: what a write touches, two writers, statistics, differences."""

import pytest

from citewell.errors import ConflictError
from citewell.operators.buckets import BucketStore, differing
from citewell.operators.store import corpus_stats

SCHEMA = "chunk_id string, scheme_id string, fetched_at string, text string, vector array<float>"


def rows(spark, ids, text="t"):
    return spark.createDataFrame([(f"c{k}", f"s{k % 3}", f"2026-01-{1 + k % 28:02d}", f"{text}{k}", [float(k), 0.5]) for k in ids], SCHEMA)


def content(df):
    return sorted((r.chunk_id, r.text) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return BucketStore(spark, str(tmp_path / "store"), buckets=16)


def test_a_merge_rewrites_what_it_touches(spark, store, tmp_path):
    assert store.read() is None and store.version().number == 0
    first = store.write(rows(spark, range(200)))
    second = store.merge(rows(spark, [5, 900], "new"), rows(spark, [7]).select("chunk_id"))
    want = {f"c{k}": f"t{k}" for k in range(200) if k != 7} | {"c5": "new5", "c900": "new900"}
    assert content(store.read()) == sorted(want.items())
    touched = differing(first, second)
    assert 1 <= len(touched) <= 3
    folders = sorted((tmp_path / "store" / "rows").iterdir())
    assert len(folders) == 2
    (new,) = (f for f in folders if f.name not in {b.write for b in first.buckets.values()})
    assert sorted(int(p.name.split("=")[1]) for p in new.glob("bucket=*")) == touched
    assert all(second.buckets[k] == first.buckets[k] for k in first.buckets.keys() - set(touched))
    assert content(store.read(first)) == content(rows(spark, range(200)))  # readers of the first keep it


def test_the_same_rows_write_nothing(spark, store, tmp_path):
    first = store.write(rows(spark, range(100)))
    again = store.write(rows(spark, range(100)).repartition(7))
    assert again.number == 2 and again.buckets == first.buckets and again.fingerprint == first.fingerprint
    assert len(list((tmp_path / "store" / "rows").iterdir())) == 1
    assert store.merge(rows(spark, []), None) is None and store.write(rows(spark, [])) is None
    emptied = store.write(rows(spark, []), force=True)
    assert emptied.rows == 0 and store.read().count() == 0 and emptied.fingerprint == ""


def test_replacement_drops_stale_ids_and_takes_the_first_of_an_id(spark, store):
    store.write(rows(spark, range(50)))
    twice = rows(spark, [1, 2]).unionByName(rows(spark, [1], "later"))
    batch = twice.selectExpr("*", "CASE WHEN text LIKE 'later%' THEN 1 ELSE 0 END AS at")
    store.write(batch, position="at")
    assert content(store.read()) == [("c1", "t1"), ("c2", "t2")]


def test_the_second_of_two_writers_does_not_win(spark, store):
    base = store.write(rows(spark, range(20)))
    one = store._stored(base, rows(spark, [30]))
    two = store._stored(base, rows(spark, [40]))
    store.commit(base, one)
    with pytest.raises(ConflictError):
        store.commit(base, two)
    assert content(store.read()) == [("c30", "t30")]


def test_a_merge_that_lost_starts_again(spark, store, monkeypatch):
    store.write(rows(spark, range(20)))
    real, raced = store.commit, []

    def commit(base, made):
        if not raced:
            raced.append(1)
            real(base, BucketStore._stored(store, base, rows(spark, [*range(20), 77])))  # another writer is first
        return real(base, made)

    monkeypatch.setattr(store, "commit", commit)
    last = store.merge(rows(spark, [88]))
    assert last.number == 3 and {"c77", "c88"} <= {c for c, _ in content(store.read())} and store.read().count() == 22


def test_a_commit_that_died_is_seen_and_released(spark, store, monkeypatch):
    store.write(rows(spark, range(5)))
    store._put("versions/000000000002", "")
    monkeypatch.setattr("citewell.operators.buckets.PATIENCE", 0.1)
    with pytest.raises(ConflictError, match="release"):
        store.version()
    store.release(2)
    assert store.version().number == 1


def test_statistics_come_from_the_manifest(spark, store, tmp_path):
    assert store.stats().first()["count"] == 0
    store.write(rows(spark, range(60)))
    store.merge(rows(spark, [61], "new"), rows(spark, [k for k in range(60) if k % 3 == 1]).select("chunk_id"))
    assert tuple(store.stats().first()) == tuple(corpus_stats(store.read()).first())
    for f in (tmp_path / "store" / "rows").rglob("*.parquet"):
        f.unlink()  # no row is read for them
    (one,) = store.stats().collect()
    assert (one["count"], one.max_fetched_at) == (store.version().rows, store.version().max_fetched_at)


def test_changes_between_versions(spark, store):
    first = store.write(rows(spark, range(30)))
    second = store.merge(rows(spark, [3, 50], "new"), rows(spark, [9]).select("chunk_id"))
    got = {r.chunk_id: r.change for r in store.changes(first, second).collect()}
    assert got == {"c3": "updated", "c50": "inserted", "c9": "deleted"}
    assert store.changes(second, second).count() == 0
    before = store.version(0 or 1)
    assert {r.change for r in store.changes(before, second).collect()} == {"updated", "inserted", "deleted"}


def test_vacuum_keeps_what_versions_name(spark, store):
    for k in range(4):
        store.write(rows(spark, range(10), f"v{k}"))
    gone = store.vacuum(keep=2)
    assert len([g for g in gone if g.startswith("rows/")]) == 2
    assert content(store.read()) == [(f"c{k}", f"v3{k}") for k in range(10)]
    assert content(store.read(store.version(3))) == [(f"c{k}", f"v2{k}") for k in range(10)]
