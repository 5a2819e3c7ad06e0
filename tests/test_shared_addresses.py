"""Pages that share an address, or whose addresses differ by a slash at the end, against SQL."""

from __future__ import annotations

import duckdb
import pytest

from pagewright.plans import all_plans


def both(spark, sf_dir, folder, name, urls):
    """Sorted rows of a query and of its SQL over pages of these addresses; page 0 comes first."""
    pages = spark.createDataFrame([(i, u, f"<title>t{i}</title><article>a {i}</article>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    pages.write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    for t in ("lineitem", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = all_plans.QUERIES[name](spark, str(folder))
    answer = con.execute(all_plans.ORACLE[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(df.columns)
    return sorted(repr(tuple(r[c] for c in names)) for r in df.collect()), sorted(map(repr, answer.fetchall()))


@pytest.mark.parametrize("shared", [1, 2, 60, 400])
def test_error_spike(spark, sf_dir, tmp_path, shared):
    got, wanted = both(spark, sf_dir, tmp_path, "d2", [f"https://a.b/{i // shared}" for i in range(400)])
    assert got == wanted


def test_links_of_llms_files(spark, sf_dir, tmp_path):
    urls = [f"https://a.b/{i}" for i in range(60)]
    # 23 and 46 are not crawled. 23 is linked as x/index.html.md, and x/ was crawled; y.md was crawled beside y.
    urls[23:25], urls[7], urls[8] = ["https://a.b/x", "https://a.b/x/"], "https://a.b/y", "https://a.b/y.md"
    urls[10], urls[11], urls[13], urls[14], urls[17] = "https://a.b/z/index.html", "https://a.b/z", "https://a.b/w/", "https://a.b/w//index.html", "https://a.b/w/?q=1#f"
    urls[30] = urls[31] = urls[32] = urls[46]
    got, wanted = both(spark, sf_dir, tmp_path, "j19", urls)
    assert got == wanted
