from vellum.plans import catalogue


def test_pages_of_customers_meet_as_documents(spark):
    got = catalogue.merge_pages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in got and "page_index" not in got
