"""The store of crawls: lost writers, writers at once, replaced crawls, removed files."""

from __future__ import annotations

import datetime
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

from pagewright.sources.store import MANIFEST, Conflict, CrawlStore

PAGES = "site_id long, crawl_id long, url string"
DAY = datetime.datetime(2024, 1, 1)


@pytest.fixture
def put(spark):
    """Stages one page a crawl and commits it."""

    def run(store, *crawls, text="u", **more):
        rows = spark.createDataFrame([(s, c, f"{text}{c}") for s, c in crawls], PAGES)
        ends = spark.createDataFrame([(s, c, DAY + datetime.timedelta(days=c)) for s, c in crawls], MANIFEST.replace(", batch string", ""))
        return store.commit(store.stage({"pages": rows}), ends, **more)

    return run


def held(store, version=None):
    return sorted((r.site_id, r.crawl_id, r.url) for r in store.read("pages", PAGES, version).collect())


def test_commits_keep_the_newest_and_replace_their_own(spark, tmp_path, put):
    store = CrawlStore(spark, str(tmp_path / "s"))
    assert store.version() == 0 and held(store) == [] and store.vacuum() == []
    assert put(store, (1, 1), (1, 2), (1, 3), (2, 9)) == 1
    assert held(store) == [(1, 2, "u2"), (1, 3, "u3"), (2, 9, "u9")]
    assert put(store, (1, 3), (1, 4), (1, 4), text="v") == 2
    assert held(store) == [(1, 3, "v3"), (1, 4, "v4"), (1, 4, "v4"), (2, 9, "u9")]
    assert held(store, 1) == [(1, 2, "u2"), (1, 3, "u3"), (2, 9, "u9")]
    assert store.remove(spark.createDataFrame([(2, 9), (5, 5)], "site_id long, crawl_id long")) == 3 and (2, 9, "u9") not in held(store)
    assert store.commit(store.stage({"pages": spark.createDataFrame([], PAGES)}), spark.createDataFrame([], MANIFEST)) == 4
    assert held(store) == [(1, 3, "v3"), (1, 4, "v4"), (1, 4, "v4")]


def test_a_lost_writer_leaves_the_old_crawls(spark, tmp_path, put):
    store = CrawlStore(spark, str(tmp_path / "s"))
    put(store, (1, 1))
    store.stage({"pages": spark.createDataFrame([(1, 2, "never")], PAGES)})  # lost before its commit
    half = tmp_path / "s/data/pages/batch=half/_temporary/0"  # lost while it wrote
    half.mkdir(parents=True)
    (half / "part-0.parquet").write_bytes(b"half")
    broken = spark.range(1).selectExpr("1L site_id", "1L crawl_id", "raise_error('lost') url")
    with pytest.raises(Exception, match="lost"):
        store.stage({"pages": broken})
    with pytest.raises(Exception, match="lost"):  # lost while it wrote its manifest
        store.commit("none", spark.range(1).selectExpr("1L site_id", "9L crawl_id", "cast(raise_error('lost') as timestamp) finished_at"))
    assert store.version() == 1 and held(store) == [(1, 1, "u1")]
    assert store.vacuum() == [] and len(store.vacuum(grace_seconds=-5)) == 3
    assert held(store) == [(1, 1, "u1")] and list(Path(tmp_path, "s/staged").iterdir()) == []


def test_of_two_writers_one_gets_a_version(spark, tmp_path, put):
    store, other = (CrawlStore(spark, str(tmp_path / "s"), most=9) for _ in range(2))
    put(store, (1, 1))
    seen = iter([1])
    last = other.version
    other.version = lambda: next(seen, None) or last()  # it looked before the other one's commit
    put(store, (1, 2))
    assert put(other, (1, 3)) == 3 and [c for _, c, _ in held(store)] == [1, 2, 3]
    with pytest.raises(Conflict):
        put(store, (1, 4), base=2)
    stale = CrawlStore(spark, str(tmp_path / "s"), most=9)
    stale.version = lambda: 2
    with pytest.raises(Conflict):
        put(stale, (1, 4), base=2)
    with pytest.raises(Conflict):
        put(stale, (1, 4), tries=2)
    assert [c for _, c, _ in held(store)] == [1, 2, 3] and not list(Path(tmp_path, "s/staged").iterdir())


def test_writers_at_once_lose_nothing(spark, tmp_path, put):
    stores = [CrawlStore(spark, str(tmp_path / "s"), most=99) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda k: put(stores[k], (k, 1), (k, 2)), range(4)))
    assert sorted(versions) == [1, 2, 3, 4] and len(held(stores[0])) == 8


def test_vacuum_keeps_what_kept_versions_name(spark, tmp_path, put):
    store = CrawlStore(spark, str(tmp_path / "s"), most=1)
    for c in (1, 2, 3):
        put(store, (1, c))
    assert len(store.vacuum(versions=2, grace_seconds=-5)) == 1
    assert held(store) == [(1, 3, "u3")] and held(store, 2) == [(1, 2, "u2")] and not (tmp_path / "s/versions" / f"{1:012d}").exists()


def test_other_batches_are_pruned(spark, tmp_path, put):
    store = CrawlStore(spark, str(tmp_path / "s"), most=1)
    put(store, (1, 1))
    plan = store.read("pages", PAGES)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "batch" in plan and "_jdf" not in plan


def test_links_of_crawls_are_made_once(spark, sf_dir, monkeypatch):
    """Each commit of snk3_store reads links that are written already: its plan joins and groups nothing for them."""
    from pagewright.plans import files

    plans, stage = [], files.CrawlStore.stage
    monkeypatch.setattr(files.CrawlStore, "stage", lambda self, tables: plans.extend(t._jdf.queryExecution().optimizedPlan().toString() for name, t in tables.items() if name == "edges") or stage(self, tables))
    files.snk3_store(spark, sf_dir)
    assert len(plans) == 2 and not any(word in p for p in plans for word in ("Join", "Aggregate"))
