from quillgraph.llm import url_filter


def test_words_and_tokens_beyond_the_head(spark, sf_dir, monkeypatch):
    """The same verdicts and scores, whatever part of the tables is broadcast."""
    rows = [
        (1, "http://a.com/en/casino/pills", "cheap pills"), (2, "http://b.com/en/casino", "cheap"), (3, "http://c.net/de/garden", "rose garden"), (4, "http://d.net/de/tulip", "garden"),
        (5, "http://cheappills.info/casino", "pills"), (6, "http://rosegarden.info/tulip", "rose"), (7, "http://x.info/pills", None), (8, "http://cheaprose.com/en/q", "the the"), (8, "http://cheaprose.com/en/q", "the the"),
        (9, None, None), (10, "http://rosecheap.info/tulip/tulip", None),
    ]
    small = spark.createDataFrame([(i, u, f"<title>{t}</title>" if t else None) for i, u, t in rows], "page_id long, url string, html string")
    for pages in (small, spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")):
        monkeypatch.undo()
        want = sorted(url_filter.judge(pages).collect(), key=str)
        for words, tokens in ((1, 2), (50_000, 0), (0, 100_000)):
            monkeypatch.setattr(url_filter, "VOCABULARY", words)
            monkeypatch.setattr(url_filter, "TOKENS", tokens)
            found = sorted(url_filter.judge(pages).collect(), key=str)
            assert len(found) == len(want)
            for a, b in zip(sorted(found, key=lambda r: (r.page_id, str(r.host))), sorted(want, key=lambda r: (r.page_id, str(r.host)))):
                assert a[:5] == b[:5] and (a.score is None) == (b.score is None) and (a.score is None or abs(a.score - b.score) < 1e-9)
