from ledgerloom.llm import warc


def test_long_urls_come_back(spark):
    urls = ["http://a.example/" + "u" * n for n in (65_000, 65_530, 200_000, 300_000)]
    urls.append("data:text/html,\r\n\r\n" + "é" * 100_000)
    rows = [(2 * i + k, u, html) for i, u in enumerate(urls) for k, html in enumerate((f"page {i}", "x" * 600_000 + str(i)))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read_archive(warc.write_archive(pages)).collect()}
    assert len(got) == len(rows)
    for i, u, html in rows:
        assert (got[i].url, got[i].payload_bytes, got[i].intact) == (warc._one_line(u), len(html), True)
