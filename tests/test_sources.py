import json

from pyspark.sql import functions as F

from citeframe.operators.checks import accepted
from citeframe.sources import batches, deals, layout, requests
from citeframe.sources import pages as sidecar


def test_deal_folder(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"deal_name":\n "B"}')
    (tmp_path / "a.json").write_text('{"deal_name": "A"}')
    pages = [{"file_name": "a.pdf", "page_number": 1, "text": "x"}, {"file_name": "a.pdf", "page_number": 3, "text": "y"}]
    (tmp_path / "a.pages.json").write_text(json.dumps(pages, indent=2))
    assert [r.deal_id for r in deals.list_deals(spark, str(tmp_path)).collect()] == ["a", "b"]
    rows = deals.read_page_files(spark, str(tmp_path)).orderBy("page_ord").collect()
    assert [(r.deal_id, r.page_number, r.text) for r in rows] == [("a", 1, "x"), ("a", 3, "y")]
    merged = deals.merge_profiles(
        deals.read_deal_files(spark, str(tmp_path)),
        spark.createDataFrame([("a", "first", 1), ("a", "second", 2), (None, "new", 3)], "deal_id string, profile string, save_ord int"),
    )
    kept = {r.deal_id: r.profile for r in merged.collect()}
    assert kept["a"] == "second" and "B" in kept["b"] and len(kept) == 3


def test_request_lines(spark, tmp_path):
    good = {"request_id": "1", "organization_id": "o", "document_name": " a.pdf ", "pages": [{"page_number": 1, "text": " t "}]}
    bad = {**good, "request_id": "2", "document_name": "a/b.pdf", "pages": []}
    path = tmp_path / "requests.json"
    path.write_text(json.dumps(good) + "\n" + json.dumps(bad) + "\n")
    checked = requests.check_requests(requests.read_requests(spark, str(path)))
    errors = {r.request_id: r.errors for r in checked.collect()}
    assert errors["1"] == []
    assert errors["2"] == ["document_name: a path", "pages: not 1 to 1,000"]
    pages = requests.request_pages(accepted(checked)).collect()
    assert [(p.request_id, p.page_number, p.text) for p in pages] == [("1", 1, "t")]
    assert checked.filter(F.col("source_type") == "other").count() == 2


def test_a_failed_retry_leaves_the_committed_batch(spark, tmp_path):
    root = str(tmp_path)
    runs = spark.createDataFrame([(1,), (2,)], "run_id int")
    parts = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "run_id int, part string")
    batches.write_batch({"runs": runs, "parts": parts}, root, "001")
    seen = lambda name: sorted(tuple(r) for r in batches.read_committed(spark, root, name).drop("batch_id").collect())
    before = seen("runs"), seen("parts")
    batches.write_table(runs.filter("run_id = 1"), root, "runs", "001", batches.new_attempt())
    assert (seen("runs"), seen("parts")) == before
    batches.write_batch({"runs": runs.filter("run_id = 1"), "parts": parts.filter("run_id = 1")}, root, "001")
    assert (seen("runs"), seen("parts")) == ([(1,)], [(1, "a")])
    batches.write_batch({"runs": runs.limit(0), "parts": parts.limit(0)}, root, "1")
    assert seen("runs") == [(1,)] and batches.committed(spark, root).count() == 2


def test_pages_are_kept_by_deal(spark, tmp_path):
    path = f"{tmp_path}/pages"
    rows = lambda *r: spark.createDataFrame(list(r), "deal_id string, page_ord int, text string")
    assert sidecar.stored_pages(spark, path) is None
    sidecar.write_pages(rows(("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z"), ("c", 0, "w")), path, buckets=2)
    sidecar.write_pages(rows(("a", 0, "new"), ("d", 0, "v")), path, buckets=2)
    stored = sidecar.stored_pages(spark, path)
    assert sorted((r.deal_id, r.page_ord, r.text) for r in stored.collect()) == [("a", 0, "new"), ("b", 0, "z"), ("c", 0, "w"), ("d", 0, "v")]
    deals_ = spark.createDataFrame([("a",), ("e",)], "deal_id string")
    assert [r[0] for r in sidecar.with_pages(deals_, stored).collect()] == ["a"]
    assert [r[0] for r in sidecar.without_pages(deals_, stored).collect()] == ["e"]


def test_run_layout_prunes_and_does_not_shuffle(spark, tmp_path):
    rows = [(k, k % 5, k % 3, k // 2) for k in range(300)]
    runs = spark.createDataFrame(rows, "run_id int, organization_id int, deal_id int, started_at int")
    layout.write_runs(runs, "runs_of_a_test", f"{tmp_path}/runs", buckets=4)
    newest = layout.newest_runs(spark, "runs_of_a_test")
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    best = {}
    for run, org, deal, start in rows:
        best[org, deal] = max(best.get((org, deal), (-1, -1)), (start, run))
    assert {(r.organization_id, r.deal_id): (r.started_at, r.run_id) for r in newest.collect()} == best
    # Buckets are pruned in either case; the plan only says so where it keeps the bucketing.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    one = layout.runs_of(spark, "runs_of_a_test", 3, 1)
    assert "SelectedBucketsCount: 1 out of 4" in one._jdf.queryExecution().executedPlan().toString()
    assert [r.run_id for r in one.collect()] == sorted((run for run, org, deal, _ in rows if (org, deal) == (3, 1)), reverse=True)
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
