"""Street addresses: all streets of a line, and the forms of streets, codes and units."""

from veilwork.operators import names


def test_addresses(spark):
    far = "12 Long Road " + "and so on " * 30
    cases = [
        (far + "then 9 Short Lane, Leeds LS1 4AB", ["9 Short Lane, Leeds LS1 4AB"]),
        ("1 First Street and 2 Second Street, Bern 30120", ["1 First Street and 2 Second Street, Bern 30120", "2 Second Street, Bern 30120"]),
        *[(f"at 5 Old {t}, Town 12345.", [f"5 Old {t}, Town 12345"]) for t in "Ter Cir Pkwy Hwy Cres Link Loop Path Green Gate Hill View".split()],
        ("24 Sussex Drive, Ottawa K1A 0B1", ["24 Sussex Drive, Ottawa K1A 0B1"]),
        ("3 Ginza Street, Tokyo 123-4567", ["3 Ginza Street, Tokyo 123-4567"]),
        ("221 Baker Street, London NW16XE", ["221 Baker Street, London NW16XE"]),
        ("at 27/F, 1 Queens Road, Hong Kong 999077", ["27/F, 1 Queens Road, Hong Kong 999077"]),
        ("12 Long Road, built 1999", []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id long, s string")
    got = {}
    for r in names.addresses(df, "id", "s").collect():
        assert cases[r["id"]][0][r["start"] : r["end"]] == r["text"]
        got.setdefault(r["id"], []).append(r["text"])
    for i, (t, want) in enumerate(cases):
        assert sorted(got.get(i, [])) == sorted(want), t
