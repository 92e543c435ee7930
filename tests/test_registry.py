import pytest
from pyspark.sql import functions as F

from veilwork.functions import registry


def test_functions_by_name(spark):
    df = spark.createDataFrame([("Ada Marlowe\na@b.org, +44 20 7946 0001", "MarIowe's"), (None, None)], "s string, w string")
    got = df.select(
        F.size(registry.call("email", "s")).alias("emails"), F.size(registry.call("phone", "s")).alias("phones"), registry.call("person", "s").alias("names"), registry.call("fold", "w").alias("fold"), registry.call("osa_distance", "w", F.lit("Marlowe")).alias("d")
    ).collect()
    assert (got[0]["emails"], got[0]["phones"], [n["text"] for n in got[0]["names"]], got[0]["fold"], got[0]["d"]) == (1, 1, ["Ada Marlowe"], "marlowe", 3)
    assert got[1]["fold"] is None and got[1]["names"] in (None, [])
    registry.add("loud", lambda c: F.upper(c))
    assert df.select(registry.call("loud", "w").alias("x")).first()["x"] == "MARIOWE'S"
    with pytest.raises(KeyError):
        registry.call("nothing")


def test_long_and_odd_texts(spark):
    from veilwork.operators import spans

    texts = ["x@a" + ".a" * 30_000, "a" * 200_000, "+1 " * 20_000, None, "", "https://x.org/" + "y" * 50_000 + ".", "a..b@c.org and x@y..org; p@q.rs...", "one 12 Long Road 12345\n" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    found = spans.find_all(df, "id", "t", listed=("R&D", "Road", "one")).collect()
    assert all(texts[r["id"]][r["start"] : r["end"]] == r["text"] for r in found)
    by = {}
    for r in found:
        by.setdefault((r["id"], r["kind"]), []).append(r["text"])
    assert by[6, "email"] == ["a..b@c.org", "p@q.rs"] and len(by[5, "url"]) == 1 and (0, "email") not in by
    assert len(by[7, "address"]) == 300 and len(by[7, "term"]) == 600


def test_a_thousand_terms_in_one_scan(spark):
    from veilwork.operators import spans

    df = spark.createDataFrame([(i, f"name {i} of R and D, Name{i}x, n a m e 7") for i in range(50)], "id long, t string")
    found = spans.terms(df, [f"name {i}" for i in range(1000)] + ["R&D"], "id", "t")
    rows = found.collect()
    assert sum(r["term"] == "R&D" for r in rows) == 50
    assert {r["id"] for r in rows if r["term"] == "name 7"} == set(range(50))
    assert sum(r["term"] == "name 49" for r in rows) == 1 and found._jdf.queryExecution().toString().count("Scan ExistingRDD") <= 4
