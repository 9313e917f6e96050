from datetime import datetime, timedelta

from driftloom.llm import url_filter

DAY = [datetime(2024, 1, 1) + timedelta(days=i) for i in range(40)]
ENTRIES = "list string, host string, path string, action string, at timestamp, url int, key string"


def run(spark, urls, entries):
    caps = spark.createDataFrame([(i, u, t, "h", 1) for i, (u, t) in enumerate(urls)], "page_id long, url string, fetched_at timestamp, host string, lists int")
    log = spark.createDataFrame([(*e, 1, "x") for e in entries], ENTRIES)
    return {r.page_id: (r.host, r.lists, r.blocked) for r in url_filter.evaluate(caps, log).collect()}


def test_intervals_and_ancestors(spark):
    log = [
        ("bad", "Evil.org", None, "add", DAY[5]),
        ("bad", "evil.org", None, "remove", DAY[10]),
        ("bad", "evil.org", None, "add", DAY[20]),
        ("ads", "a.evil.org", "/ads", "add", DAY[1]),
        ("ads", "a.evil.org", "/ads", "add", DAY[3]),
        ("tie", "tie.net", None, "add", DAY[2]),
        ("tie", "tie.net", None, "remove", DAY[2]),
        (None, "evil.org", None, "add", DAY[0]),
        ("bad", None, None, "add", DAY[0]),
    ]
    urls = [
        ("http://evil.org", DAY[4]), ("http://evil.org/x", DAY[5]), ("http://evil.org", DAY[10]), ("https://u:p@A.EVIL.org:80/ads/1?x#y", DAY[25]),
        ("http://a.evil.org/ad", DAY[9]), ("http://notevil.org", DAY[9]), ("http://tie.net", DAY[3]), ("nonsense", DAY[9]), (None, DAY[9]), ("http://evil.org", None),
        ("http://evil.org./ads", DAY[6]),
    ]
    got = run(spark, urls, log)
    assert [got[i][1] for i in range(len(urls))] == [[], ["bad"], [], ["ads", "bad"], ["bad"], [], [], [], [], [], ["bad"]]
    assert got[3][0] == "a.evil.org" and got[7][0] is None and got[10][0] == "evil.org"


def test_empty(spark):
    assert run(spark, [("http://x.org", DAY[1])], []) == {0: ("x.org", [], False)}
    assert run(spark, [], [("l", "x.org", None, "add", DAY[0])]) == {}
