from pyspark.sql import functions as F

from lectern.operators import audits, packages


def test_contents_pages_are_not_unmatched(spark):
    html = {1: "<p>a</p>", 2: "<nav><p>a</p></nav>", 3: "<p>a</p>", 4: '<div epub:type="toc">a</div>', 5: "<p>a</p>"}
    pages = spark.createDataFrame([(k, 100, h) for k, h in html.items()], "k long, n_tokens int, html string")
    matched = spark.createDataFrame([(1,), (5,)], "k long")
    contents = pages.where(packages.toc_like(F.col("html")))
    assert [r.k for r in audits.unmatched_between(pages, matched, "k", contents=contents).collect()] == [3]
    assert sorted(r.k for r in audits.unmatched_between(pages, matched, "k").collect()) == [2, 3, 4]
