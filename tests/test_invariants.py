"""Properties that the SQL checks don't show."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilwork.operators import fuzzy, labels, pixels, spans
from veilwork.sources import sinks

TEXTS = [(1, "mail a.b@c.org, or +44 20 7946 0001; a.b@c.org again"), (2, None), (3, ""), (4, "password PassWord xpassword p a s s w o r d"), (5, "x" * 5000 + " a@b.io"), (6, "ünï a@b.io 😀 c@d.io")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def test_spans_slice_to_their_text(spark, docs):
    found = spans.find_all(docs, "doc_id", "text", listed=("password",))
    rows = found.join(docs.withColumnRenamed("text", "whole"), "doc_id").collect()
    assert len(rows) == 9
    assert all(r["whole"][r["start"] : r["end"]] == r["text"] for r in rows)


def test_resolution_is_disjoint_and_keeps_the_longest(spark):
    rows = [(1, "email", 0, 10, "high", None, "a"), (1, "term", 2, 5, "high", "t", "b"), (1, "url", 8, 30, "high", None, "c"), (1, "phone", 40, 50, "medium", None, "d"), (1, "term", 41, 44, "high", "u", "e"), (1, "term", 45, 49, "high", "v", "f")]
    df = spark.createDataFrame(rows, "doc_id long, kind string, start int, end int, confidence string, term string, text string")
    out = sorted(spans.resolve(df, "doc_id").collect(), key=lambda r: r["start"])
    assert [(r["start"], r["end"]) for r in out] == [(2, 5), (8, 30), (40, 50)]
    # the unsure phone takes the identity of the term inside it
    assert (out[2]["kind"], out[2]["term"], out[2]["holds"]) == ("term", "v", ["v", "u"])


def test_blocks_keep_the_length(spark, docs):
    kept = spans.resolve(spans.find_all(docs, "doc_id", "text"), "doc_id")
    out = spans.apply(docs, kept, "doc_id", "text", spans.STYLES["block"]()).collect()
    whole = dict(TEXTS)
    assert out and all(len(r["redacted"]) == len(whole[r["doc_id"]]) for r in out)
    assert not any(re.search(spans.EMAIL, r["redacted"]) for r in out)


def test_cover_leaves_nothing_of_any_span(spark, docs):
    found = spans.find_all(docs, "doc_id", "text", listed=("7946 0001; a",))
    cover = spans.cover(found, "doc_id")
    out = spans.apply(docs, cover, "doc_id", "text", F.lit("#")).collect()
    assert not any(re.search(spans.EMAIL, r["redacted"]) or "7946" in r["redacted"] for r in out)


def test_legend_has_no_value(spark, docs):
    entries = labels.assign(spans.resolve(spans.find_all(docs, "doc_id", "text"), "doc_id"), "doc_id")
    legend = labels.legend(entries, "doc_id")
    assert legend.columns == ["doc_id", "label", "description", "count"]
    same = entries.where("identity = 'email:a.b@c.org'").first()
    assert (same["label"], same["count"]) == ("E1", 2)


def test_sink_refuses_values_in_the_legend(spark, docs, tmp_path):
    entries = labels.assign(spans.resolve(spans.find_all(docs, "doc_id", "text"), "doc_id"), "doc_id")
    with pytest.raises(ValueError):
        sinks.write_labels(labels.key(entries, "doc_id"), labels.key(entries, "doc_id"), str(tmp_path / "l"), str(tmp_path / "k"))
    sinks.write_labels(labels.legend(entries, "doc_id"), labels.key(entries, "doc_id"), str(tmp_path / "l"), str(tmp_path / "k"))
    assert "value" not in spark.read.parquet(str(tmp_path / "l")).columns


def test_empty_tables(spark, docs):
    none = docs.where("false")
    kept = spans.resolve(spans.find_all(none, "doc_id", "text", listed=("a",)), "doc_id")
    assert kept.count() == 0
    assert labels.assign(kept, "doc_id").count() == 0
    assert spans.apply(none, kept, "doc_id", "text", F.lit("")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_osa_bounds(a, b):
    d = fuzzy.osa(a, b)
    assert d == fuzzy.osa(b, a)
    assert (d == 0) == (a == b)
    assert abs(len(a) - len(b)) <= d <= max(len(a), len(b))


def test_ncc_of_itself_is_one():
    rng = np.random.default_rng(1)
    page = rng.random((90, 120)) * 255
    t = page[30:45, 50:70]
    plane = pixels.ncc_plane(page, t)
    assert np.unravel_index(np.nanargmax(plane), plane.shape) == (30, 50)
    assert plane[30, 50] == pytest.approx(1, abs=1e-9)
    direct = np.array([[np.corrcoef(page[y : y + 15, x : x + 20].ravel(), t.ravel())[0, 1] for x in range(0, 101, 25)] for y in range(0, 76, 25)])
    assert np.allclose(plane[0:76:25, 0:101:25], direct, atol=1e-9)
    assert pixels.ncc_plane(page, np.ones((5, 5))) is None
    assert np.isnan(pixels.ncc_plane(np.ones((9, 9)), t[:4, :4])).all()


def test_template_places(spark, sf):
    from veilwork.plans import pictures

    got = {r["page"]: r for r in pictures.template_search(spark, sf).collect()}
    assert set(got) == {0, 1, 2, 3}
    for page, r in got.items():
        assert abs(r["x"] - 40) <= 1 and abs(r["y"] - 20 - 10 * page) <= 1
        assert r["inverted"] == (page == 2)


def test_ladder_and_resampling():
    steps = pixels.ladder(0.3, 3)
    assert 1.0 in steps and steps == sorted(steps)
    a = np.arange(48.0).reshape(6, 8)
    assert pixels.shrink(a, 4, 3).mean() == pytest.approx(a.mean())
    assert np.allclose(pixels.resize(a, 8, 6), a)
    ink = np.zeros((20, 20))
    ink[5:9, 6:12] = 200
    assert pixels.trim(ink).shape == (6, 8)


def test_pdf_offsets():
    pdf = sinks.pdf_bytes([(4, 3, bytes(36), "a (b)"), (2, 2, bytes(12), "")])
    at = int(re.search(rb"startxref\n(\d+)", pdf)[1])
    rows = pdf[at:].split(b"\n", 2)[2].split(b"trailer")[0]
    assert len(rows) % 20 == 0
    for i in range(1, len(rows) // 20):
        offset = int(rows[20 * i : 20 * i + 10])
        assert pdf[offset:].startswith(b"%d 0 obj" % i)


def test_stream_gives_the_batch_verdicts(spark, sf):
    from veilwork.plans import pictures
    from veilwork.streaming import limits

    batch = pictures.rate_limit_batch(spark, sf).where("refused").count()
    s = pictures._events(spark, sf).select("user_id", F.get_json_object("props", "$.k").alias("k"), F.col("ts").cast("timestamp").alias("ts"))
    out = pictures.run_stream(spark, limits.stream_refused(s, "user_id", "k", "ts"), "user_id long, k string, ts timestamp, refused boolean")
    assert out.where("refused").count() == batch


def test_burst_is_refused(spark):
    from veilwork.streaming import limits

    rows = [(i, "c", f"id{i % 10}", i) for i in range(12)] + [(100 + i, "c", "one", 5000 + i) for i in range(15)]
    df = spark.createDataFrame(rows, "e long, client string, k string, s long").withColumn("at", F.timestamp_seconds("s"))
    got = {r["e"]: (r["distinct_ids"], r["refused"]) for r in limits.refused(df, "client", "k", "at", "e").collect()}
    assert got[7] == (8, False) and got[8] == (9, True) and got[11] == (10, True)
    assert got[114] == (1, False)
