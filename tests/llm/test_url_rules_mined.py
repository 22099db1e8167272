"""Mining keeps every association, however many supersets of others pass too."""

from tidemark.llm import urlfilter


def test_many_bad_hosts(spark):
    pages = [(i, f"http://a.bad{i % 100}.edu/x") for i in range(2600)] + [(i, f"http://a.good{i % 100}.edu/x") for i in range(2600, 6000)]
    labels = [(i, int(i >= 2600), 0) for i, _ in pages]
    got = urlfilter.filter_urls(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert len(got) == 6000 and all(r.verdict == ("block" if r.page_id < 2600 else "allow") for r in got)
