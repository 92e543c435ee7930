"""Queries of pictures, embeddings correlation, licence limits and streams."""

from __future__ import annotations

import hmac
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from veilwork.operators import pixels as pix
from veilwork.plans.common import Fixture, Registry, table
from veilwork.streaming import limits

query = Registry()

# planes from an integer formula, which both engines compute
_W, _H = 24, 18
PLANE = f"(SELECT p AS page, x, y, CAST((x * x * 7 + y * 13 + x * y * 5 + p * 11) % 97 AS DOUBLE) AS v FROM range(1, 3) t1(p), range(0, {_W}) t2(x), range(0, {_H}) t3(y))"
TEMPLATE = "(SELECT x - 5 AS tx, y - 4 AS ty, v AS tv FROM " + PLANE + " WHERE page = 1 AND x BETWEEN 5 AND 9 AND y BETWEEN 4 AND 7)"


def plane(spark):
    p, x, y = (spark.range(a, b).withColumnRenamed("id", n) for a, b, n in ((1, 3, "page"), (0, _W, "x"), (0, _H, "y")))
    v = (F.col("x") * F.col("x") * 7 + F.col("y") * 13 + F.col("x") * F.col("y") * 5 + F.col("page") * 11) % 97
    return p.join(F.broadcast(x)).join(F.broadcast(y)).withColumn("v", v.cast("double"))


@query(f"SELECT page, x, y, sum(v) OVER (PARTITION BY page ORDER BY x, y ROWS 0 PRECEDING) * 0 + (SELECT sum(v) FROM {PLANE} b WHERE b.page = a.page AND b.x <= a.x AND b.y <= a.y) AS s FROM {PLANE} a")
def prefix_sums(spark, sf_dir):
    return pix.prefix_sums(plane(spark), "page").select("page", "x", "y", "s")


@query(
    f"""WITH p AS (SELECT * FROM {PLANE}), t AS (SELECT *, tv - avg(tv) OVER () AS z FROM {TEMPLATE}), e AS (SELECT sum(z * z) AS energy, count(*) AS n FROM t),
h AS (SELECT page, x - tx AS ox, y - ty AS oy, v, z FROM p, t WHERE x - tx BETWEEN 0 AND {_W} - 5 AND y - ty BETWEEN 0 AND {_H} - 4)
SELECT page, ox AS x, oy AS y, round(sum(v * z) / sqrt(energy * var_pop(v) * n), 8) AS score FROM h, e GROUP BY page, ox, oy, energy, n HAVING var_pop(v) * n >= 1e-6"""
)
def ncc_small(spark, sf_dir):
    t = plane(spark).where("page = 1 and x between 5 and 9 and y between 4 and 7").select((F.col("x") - 5).alias("tx"), (F.col("y") - 4).alias("ty"), F.col("v").alias("tv"))
    return pix.correlate(plane(spark), t, "page").select("page", "x", "y", F.round("score", 8).alias("score"))


@query(
    f"""WITH p AS (SELECT * FROM {PLANE}), t AS (SELECT *, tv - avg(tv) OVER () AS z FROM {TEMPLATE}), e AS (SELECT sum(z * z) AS energy, count(*) AS n FROM t),
h AS (SELECT page, x - tx AS ox, y - ty AS oy, v, z FROM p, t WHERE x - tx BETWEEN 0 AND {_W} - 5 AND y - ty BETWEEN 0 AND {_H} - 4)
SELECT page, ox AS x, oy AS y, round(sum(v * z) / sqrt(energy * var_pop(v) * n), 8) AS score FROM h, e GROUP BY page, ox, oy, energy, n HAVING var_pop(v) * n >= 1e-6"""
)
def ncc_fft(spark, sf_dir):
    """The FFT kernel over whole planes, held against the same SQL."""
    rows = plane(spark).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("px"))

    def run(batches):
        import pandas as pd

        at = np.arange(1)
        for pdf in batches:
            for page, px in zip(pdf["page"], pdf["px"]):
                a = np.array([q["v"] for q in px], float).reshape(_H, _W)
                y, x = np.mgrid[0:_H, 0:_W]
                first = ((x * x * 7 + y * 13 + x * y * 5 + 11) % 97).astype(float)
                plane_ = pix.ncc_plane(a, first[4:8, 5:10])
                ys, xs = np.nonzero(~np.isnan(plane_))
                yield pd.DataFrame({"page": page, "x": xs, "y": ys, "score": plane_[ys, xs].round(8) + 0.0 * at})

    return rows.mapInPandas(run, "page long, x long, y long, score double")


@query(f"SELECT page, x // 6 AS cx, y // 6 AS cy, round(var_pop(v), 6) AS var FROM {PLANE} GROUP BY ALL")
def cell_variance(spark, sf_dir):
    return pix.cell_variance(plane(spark), "page", 6).select("page", "cx", "cy", F.round("var", 6).alias("var"))


@query(f"SELECT page, bin, n FROM (SELECT page, CAST(floor(v / 8) AS BIGINT) AS bin, count(*) AS n FROM {PLANE} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, bin) = 1")
def value_mode(spark, sf_dir):
    return pix.value_mode(plane(spark), "page")


@query(f"SELECT page, round(avg(CASE WHEN d >= 30 THEN 1.0 ELSE 0.0 END), 9) AS busy FROM (SELECT page, abs(lead(v) OVER (PARTITION BY page, y ORDER BY x) - v) AS d FROM {PLANE}) WHERE d IS NOT NULL GROUP BY page")
def busy_share(spark, sf_dir):
    return pix.busy_share(plane(spark), "page", 30).select("page", F.round("busy", 9).alias("busy"))


@query(f"SELECT page, list_sort(list(v))[CAST(floor(count(*) * 0.9) AS INTEGER) + 1] AS q90, list_sort(list(v))[CAST(floor(count(*) * 0.5) AS INTEGER) + 1] AS q50 FROM {PLANE} GROUP BY page")
def index_quantiles(spark, sf_dir):
    return plane(spark).groupBy("page").agg(F.collect_list("v").alias("vs")).select("page", pix.index_quantile(F.col("vs"), 0.9).alias("q90"), pix.index_quantile(F.col("vs"), 0.5).alias("q50"))


_ANGLES = [x / 2 for x in range(-6, 7)]


@query(
    f"""SELECT page, angle FROM (SELECT page, i, angle, sum(n * n) AS power FROM (SELECT page, i, angle, CAST(round(y - x * tan(radians(angle))) AS BIGINT) AS row_, count(*) AS n FROM {PLANE}, (SELECT i, i / 2.0 - 3 AS angle FROM range(0, 13) a(i)) WHERE v < 40 GROUP BY ALL) GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY page ORDER BY power DESC, i) = 1"""
)
def page_skew(spark, sf_dir):
    return pix.skew(plane(spark), "page", 40, _ANGLES)


@query(f"WITH s AS (SELECT page, unnest([{{'a': v, 'b': (v * 3 + x) % 50}}, {{'a': (v + 7) % 60, 'b': v}}, {{'a': x * 1.0, 'b': y * 1.0}}]) AS s FROM {PLANE} WHERE v < 60) SELECT page, round(corr(s.a, s.b), 8) AS corr FROM s GROUP BY page")
def ink_correlation(spark, sf_dir):
    v, x, y = F.col("v"), F.col("x"), F.col("y")
    px = plane(spark).select("page", (v < 60).alias("ink"), v.alias("r"), ((v * 3 + x) % 50).alias("tr"), ((v + 7) % 60).alias("g"), v.alias("tg"), x.cast("double").alias("b"), y.cast("double").alias("tb"))
    return pix.ink_correlation(px, "page").select("page", F.round("corr", 8).alias("corr"))


_SIDES, _DPIS = (None, 0.0, 1.0, 11.0, 11.99, 12.0, 30.0), (None, 0.0, 72.0, 149.0, 149.99, 150.0, 300.0)
SIZES = Fixture("id long, side double, dpi double, small boolean, most boolean, lettering boolean", tuple((i, _SIDES[i % 7], _DPIS[i // 7 % 7], i % 2 == 0, i % 3 != 0, i % 5 != 0) for i in range(98)))


@query(f"SELECT id, CAST(CASE WHEN most AND dpi <> 0 AND dpi < 150 THEN 2 WHEN most AND side <> 0 AND side < 12 THEN 2 WHEN lettering AND small THEN 1.5 ELSE 1 END AS DOUBLE) AS factor FROM {SIZES.sql}")
def page_upscale(spark, sf_dir):
    return SIZES.df(spark).select("id", pix.upscale(F.col("side"), F.col("dpi"), F.col("small"), F.col("most"), F.col("lettering")).cast("double").alias("factor"))


_MARK_SIDES = (0.0, 1.0, 5.0, 6.0, 12.0, 20.0, 60.0, 61.0, 179.0, 180.0, 600.0, 2000.0)
MARK_SIZES = Fixture("id long, w double, h double", tuple((12 * i + j, a, b) for i, a in enumerate(_MARK_SIDES) for j, b in enumerate(_MARK_SIDES)))


def _working_sql(target, least_short, most_long, floor_short):
    one = f"CASE WHEN s * {target} / l < {least_short} THEN {least_short} / s ELSE {target} / l END"
    two = f"CASE WHEN l * ({one}) > {most_long} THEN {most_long} / l ELSE {one} END"
    three = f"CASE WHEN s * ({two}) < {floor_short} THEN {floor_short} / s ELSE {two} END"
    return f"CASE WHEN l <= 0 OR s <= 0 THEN 0 ELSE least(1, {three}) END"


@query(
    f"""WITH m AS (SELECT id, greatest(w, h) AS l, least(w, h) AS s FROM {MARK_SIZES.sql})
SELECT id, round(CASE WHEN s > 0 AND l / s >= 3 THEN {_working_sql(20.0, 12.0, 160.0, 6.0)} ELSE {_working_sql(20.0, 7.0, 96.0, 4.0)} END, 9) AS coarse, round({_working_sql(40.0, 10.0, 160.0, 6.0)}, 9) AS fine, round({_working_sql(160.0, 12.0, 160.0, 6.0)}, 9) AS native FROM m"""
)
def working_scales(spark, sf_dir):
    w, h = F.col("w"), F.col("h")
    scales = {"coarse": pix.coarse_scale(w, h), "fine": pix.working_scale(w, h, pix.FINE), "native": pix.working_scale(w, h, pix.NATIVE)}
    return MARK_SIZES.df(spark).select("id", *[F.round(c, 9).alias(k) for k, c in scales.items()])


EDGES = Fixture("page long, x long, y long, r int, g int, b int", tuple((p, x, y, (x * 37 + y * 91 + p * 13) % (60 if p < 4 else 16), (x * y * 11 + p) % (40 if p < 4 else 16), 200 if (x + y) % p else 17) for p in range(1, 7) for x in range(5 + p) for y in range(1 if p == 6 else 4 + p)))


@query(
    f"""WITH p AS (SELECT *, max(x) OVER (PARTITION BY page) + 1 AS w, max(y) OVER (PARTITION BY page) + 1 AS h FROM {EDGES.sql}),
e AS (SELECT *, 2 * x AS pos FROM p WHERE y = 0 UNION ALL SELECT *, 2 * x + 1 FROM p WHERE y = h - 1 UNION ALL SELECT *, 2 * w + 2 * y FROM p WHERE x = 0 UNION ALL SELECT *, 2 * w + 2 * y + 1 FROM p WHERE x = w - 1),
c AS (SELECT page, r // 16 AS r, g // 16 AS g, b // 16 AS b, count(*) AS n, min(pos) AS first FROM e GROUP BY ALL)
SELECT page, CAST(r * 16 + 8 AS INTEGER) AS r, CAST(g * 16 + 8 AS INTEGER) AS g, CAST(b * 16 + 8 AS INTEGER) AS b FROM c QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, first) = 1"""
)
def ground_colours(spark, sf_dir):
    return pix.ground_colour(EDGES.df(spark), "page")


@query()
def template_search(spark, sf_dir):
    """Templates at several scales on synthetic pages; test_pixels has the places."""
    rng = np.random.default_rng(3)
    mark = rng.random((24, 30)) * 255
    rows = []
    for page in range(4):
        a = rng.normal(128, 12, (160, 200))
        t = pix.resize(mark, 30, 24)
        a[20 + 10 * page : 44 + 10 * page, 40:70] = 255 - t if page == 2 else t
        rows.append((page, 200, 160, bytearray(a.astype(np.float64).tobytes())))
    return pix.search_pages(spark.createDataFrame(rows, "page long, w int, h int, px binary"), [("mark", mark)])


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings), z AS (SELECT vec_id, list_transform(v, lambda x: x - list_avg(v)) AS v FROM e),
q AS (SELECT * FROM z WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, z.vec_id, list_cosine_similarity(q.v, z.v) AS score FROM q, z WHERE q.vec_id <> z.vec_id)
SELECT query_id, vec_id, round(score, 9) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 3"""
)
def correlation_top(spark, sf_dir):
    """The three vectors most correlated with each vector of the query set (ids
    divisible by 50): a block of queries against all rows, in NumPy; only each
    batch's best go on. The block is read once and broadcast; it is a fiftieth
    of the ids and comes in blocks of 4,096."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    queries = emb.where("vec_id % 50 = 0").withColumn("block", F.expr("(vec_id div 50) div 4096"))
    packed = queries.groupBy("block").agg(F.collect_list(F.struct("vec_id", "v")).alias("qs"))

    def run(batches):
        import pandas as pd

        unit = lambda m: (lambda z: z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300))(m - m.mean(axis=1, keepdims=True))
        for pdf in batches:
            for qs, ids, vs in zip(pdf["qs"], pdf["ids"], pdf["vs"]):
                qi = np.array([q["vec_id"] for q in qs])
                q, x, ids = unit(np.array([q["v"] for q in qs])), unit(np.array(list(vs))), np.asarray(ids)
                order = np.argsort(ids, kind="stable")
                x, ids = x[order], ids[order]
                s = np.round(q @ x.T, 12)
                s[qi[:, None] == ids[None, :]] = -2
                # a total order by score and then id: no more than three of a batch can stay
                top = np.argsort(-s, axis=1, kind="stable")[:, :3]
                yield pd.DataFrame({"query_id": np.repeat(qi, top.shape[1]), "vec_id": ids[top].ravel(), "score": np.take_along_axis(s, top, 1).ravel()})

    parts = emb.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(16)).alias("part"), F.expr("vec_id div 100000").alias("run")).agg(F.collect_list("vec_id").alias("ids"), F.collect_list("v").alias("vs"))
    from pyspark.sql import Window

    near = parts.join(packed).select("qs", "ids", "vs").mapInPandas(run, "query_id long, vec_id long, score double").where("score > -2")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("r", F.row_number().over(w)).where("r <= 3").select("query_id", "vec_id", F.round("score", 9).alias("score"))


@query(
    """SELECT e.event_id, count(DISTINCT json_extract_string(o.props, '$.k')) AS distinct_ids, count(DISTINCT json_extract_string(o.props, '$.k')) > 8 AS refused
FROM events e JOIN events o ON o.user_id = e.user_id AND o.ts >= e.ts - INTERVAL 10 MINUTE AND o.ts <= e.ts GROUP BY e.event_id"""
)
def rate_limit_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.get_json_object("props", "$.k").alias("k"))
    return limits.refused(rows, "user_id", "k", "ts", "event_id").select("event_id", "distinct_ids", "refused")


@query("SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def first_grants(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("txn"), "user_id", "event_type", "ts", "event_id")
    return limits.first_grants(rows.select("txn", "ts", "event_id", "user_id", "event_type"), "txn", "ts").select("user_id", "event_type", "ts", "event_id")


STAMPS = Fixture(
    "id long, v long, exp long, signed boolean, stamp long, crypto boolean, key boolean",
    ((1, 1, 2000, True, 900, True, True), (2, 1, 500, True, 1300, True, True), (3, 1, 701, True, 1301, True, True), (4, None, 2000, True, 700, True, True), (5, 1, 2000, False, 699, True, True), (6, 1, 2000, None, 1000, True, True))
    + tuple((7 + i, (1, None)[i % 2], (2000, 700, 699, None)[i // 2 % 4], (True, False)[i // 8 % 2], 1000 - i * 20, (True, False)[i // 16 % 2], (True, False)[i // 3 % 2]) for i in range(32)),
)


@query(
    f"""SELECT id, CASE WHEN v IS NULL OR exp IS NULL THEN 'unreadable' WHEN NOT crypto THEN 'nocrypto' WHEN NOT key THEN 'nokey' WHEN NOT coalesce(signed, false) THEN 'forged' WHEN exp + 300 < 1000 THEN 'expired' ELSE 'ok' END AS verdict,
 abs(1000 - stamp) <= 300 AS fresh FROM {STAMPS.sql}"""
)
def token_verdicts(spark, sf_dir):
    s = F.struct("v", "exp")
    return STAMPS.df(spark).select("id", limits.verdict(s, F.col("signed"), F.lit(1000), F.col("crypto"), F.col("key")).alias("verdict"), limits.in_replay_window(F.col("stamp"), F.lit(1000)).alias("fresh"))


SECRET = b"secret of the invented hooks"


def _signed(ts: str, body: str, secret: bytes = SECRET) -> str:
    return hmac.new(secret, f"{ts}:{body}".encode(), "sha256").hexdigest()


HOOKS = Fixture(
    "id long, header string, body string",
    tuple(
        enumerate(
            (
                (f"ts=1000;h1={_signed('1000', 'a')}", "a"), (f"ts=700;h1={_signed('700', 'a')}", "a"), (f"ts=1300;h1={_signed('1300', 'é')}", "é"), (f"ts=699;h1={_signed('699', 'a')}", "a"), (f"ts=1301;h1={_signed('1301', 'a')}", "a"), (f"ts=1000;h1={_signed('1000', 'a')}", "b"),
                (f"h1={_signed('1000', '')};ts=1000", ""), (f"ts=1000;h1={_signed('1000', 'a').upper()}", "a"), (f"ts=1000;h1={_signed('1000', 'a', b'other')}", "a"), ("ts=1000", "a"), ("", "a"), (None, "a"), (f"ts=;h1={_signed('', 'a')}", "a"), (f"ts=x;h1={_signed('x', 'a')}", "a"),
                (f"ts=1000;h1=0;h1={_signed('1000', 'a')}", "a"), (f"ts=1000;h1={_signed('1000', 'a')};h1=0", "a"), (f"ts=1000;v=1=2;h1={_signed('1000', 'a')}", "a"), (f"ts=1000;h1={_signed('1000', 'a')}0", "a"), (f"ts=1000;h1={_signed('1000', 'x' * 300)}", "x" * 300),
            )
        )
    ),
)
HOOKS = Fixture(HOOKS.schema, tuple((i, h, b) for i, (h, b) in HOOKS.rows))
_PADS = [p.hex() for p in limits.hmac_pads(SECRET)]


@query(
    f"""WITH p AS (SELECT id, body, list_filter(list_transform(string_split(coalesce(header, ''), ';'), lambda x: string_split(x, '=')), lambda x: len(x) = 2) AS ps FROM {HOOKS.sql}),
v AS (SELECT id, body, list_filter(ps, lambda x: x[1] = 'ts')[-1][2] AS ts, list_filter(ps, lambda x: x[1] = 'h1')[-1][2] AS h1 FROM p)
SELECT id, coalesce(ts <> '' AND abs(1000 - TRY_CAST(ts AS DOUBLE)) <= 300 AND h1 = sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(ts || ':' || body)))), false) AS holds FROM v"""
)
def webhook_signatures(spark, sf_dir):
    return HOOKS.df(spark).select("id", limits.signature_holds(F.col("header"), F.col("body"), SECRET, F.lit(1000)).alias("holds"))


def run_stream(spark, stream, schema):
    """Run a stream to the end of what is there, into the shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = root or "file://" + tempfile.mkdtemp(prefix="veilwork-stream-")
    at = f"{root}/stream-{os.urandom(8).hex()}"
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out")


def _events(spark, sf_dir):
    """events as a stream; the file lies in no folder of its own."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query(
    """WITH v AS (SELECT e.event_id, e.user_id, count(DISTINCT json_extract_string(o.props, '$.k')) > 8 AS refused
FROM events e JOIN events o ON o.user_id = e.user_id AND o.ts >= e.ts - INTERVAL 10 MINUTE AND o.ts <= e.ts GROUP BY e.event_id, e.user_id) SELECT user_id, count(*) AS n, count(*) FILTER (refused) AS n_refused FROM v GROUP BY user_id"""
)
def stream_rate_limit(spark, sf_dir):
    """The stateful limiter over the stream of events: every attempt gets a verdict."""
    s = _events(spark, sf_dir).select("user_id", F.get_json_object("props", "$.k").alias("k"), F.col("ts").cast("timestamp").alias("ts"))
    out = run_stream(spark, limits.stream_refused(s, "user_id", "k", "ts"), "user_id long, k string, ts timestamp, refused boolean")
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("refused").alias("n_refused"))


@query("SELECT user_id, event_type, CAST(1 AS BIGINT) AS n FROM events GROUP BY user_id, event_type")
def stream_first_grants(spark, sf_dir):
    s = _events(spark, sf_dir).select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("txn"), "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = run_stream(spark, limits.first_grants(s, "txn", "ts", stream=True, delay="60 days"), "txn string, user_id long, event_type string, ts timestamp")
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
