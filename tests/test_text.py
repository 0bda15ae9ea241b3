"""Text functions on literal rows; what fits a prompt."""

from pyspark.sql import functions as F

from heddle.functions import text as T
from heddle.operators import context


def test_short_forms(spark):
    rows = spark.createDataFrame([(1, "  a \n b  "), (2, "x" * 400), (3, None), (4, "y" * 180), (5, "z" * 2000)], "id long, t string")
    got = {r["id"]: r for r in rows.select("id", T.snippet(F.col("t")).alias("s"), T.digest_prompt(F.col("t")).alias("d"), T.cut_passage(F.col("t")).alias("c")).collect()}
    assert (got[1]["s"], got[1]["d"], got[1]["c"]) == ("a b", "a b", "  a \n b  ")
    assert got[2]["s"] == "x" * 177 + "..." and got[2]["d"] == "x" * 320 + " …" and got[4]["s"] == "y" * 180
    assert got[3]["d"] == "" == got[3]["c"] and got[5]["c"] == "z" * 1600 + "\n...[chunk truncated]"


def test_hosts_and_redaction(spark):
    urls = {"HTTPS://Example.org:8443/x": "example.org:8443", "http://user@host/": None, "ftp://host/": None, "http://host": "host", "http://ho st/": None, None: None}
    got = {r["u"]: r["h"] for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", T.host_of(F.col("u")).alias("h")).collect()}
    assert got == urls
    row = spark.createDataFrame([({"apiKey": "abc", "Authorization": "x", "note": "Bearer abc.def and token=xyz", "none": None, "requestBody": "b"},)], "a map<string,string>")
    assert row.select(T.redact_attributes(F.col("a")).alias("a")).first()["a"] == {"apiKey": "[REDACTED]", "Authorization": "[REDACTED]", "note": "Bearer [REDACTED] and token=[REDACTED]", "none": "", "requestBody": "[REDACTED]"}


def test_evidence_stops_at_the_first_overflow(spark):
    rows = [(1, k, "/p", "L1-2", 0.5, "w" * n) for k, n in enumerate((100, 5000, 10, *[1600] * 20, 1), 1)]
    cited = spark.createDataFrame(rows, "qid long, number int, path string, source_location string, score double, content string")
    got = context.evidence(cited).orderBy("number").collect()
    sizes = [len(f"[{k}] /p · L1-2\n") + (n if n <= 1600 else 1600 + len("\n...[chunk truncated]")) + 1 for k, n in enumerate((100, 5000, 10, *[1600] * 20, 1), 1)]
    fits = [sum(sizes[:k]) for k in range(1, len(sizes) + 1) if sum(sizes[:k]) <= context.ANSWER_CHARS]
    assert [r["chars"] for r in got] == fits and len(fits) < len(rows) - 1  # the last one alone would fit, but stands after the stop
    plans = context.evidence(cited, True, used=5600).orderBy("number").collect()
    assert plans[0]["block"] == "[1] /p · L1-2 (relevance 0.50)\n    " + "w" * 100 + "\n" and len(plans) == 1
