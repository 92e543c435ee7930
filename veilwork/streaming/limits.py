"""Licence limits: distinct ids per client in a sliding window, one grant for
each transaction, expiry, replay window and verdicts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_S, MOST = 600, 8
SKEW_S = 300


def refused(df: DataFrame, client: str, ident: str, at: str, order: str) -> DataFrame:
    """Adds distinct_ids (of the client in the ten minutes up to each attempt, both ends included)
    and refused. An id counts once in the window: an attempt whose id comes
    again before the window ends is shadowed from then on. So the count is the
    attempts of the window less the shadows - running sums over one sort of
    the client's rows, without a set for each row."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    rows = df.withColumn("_t", t)
    again = F.lead("_t").over(Window.partitionBy(client, ident).orderBy("_t", order))
    span = WINDOW_S * 1_000_000
    rows = rows.withColumn("_again", again)
    shadows = rows.where(F.col("_again") - F.col("_t") <= span)
    plus = shadows.select(client, F.col("_again").alias("_t"), F.lit(1).alias("d"))
    minus = shadows.select(client, (F.col("_t") + span + 1).alias("_t"), F.lit(-1).alias("d"))
    marks = plus.unionByName(minus).groupBy(client, "_t").agg(F.sum("d").alias("d"))
    inside = Window.partitionBy(client).orderBy("_t").rangeBetween(-span, 0)
    upto = Window.partitionBy(client).orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
    both = rows.withColumn("_own", F.lit(1)).withColumn("_d", F.lit(0)).unionByName(marks.select(client, "_t", F.lit(0).alias("_own"), F.col("d").alias("_d")), allowMissingColumns=True)
    counted = both.withColumn("distinct_ids", F.sum("_own").over(inside) - F.sum("_d").over(upto)).where("_own = 1")
    return counted.withColumn("refused", F.col("distinct_ids") > MOST).drop("_t", "_again", "_own", "_d")


def stream_refused(stream: DataFrame, client: str, ident: str, at: str, delay: str = "10 minutes") -> DataFrame:
    """The stream's twin: (client, id, at, refused), with the last sight of
    each id as state, which expires when the watermark has passed the window."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ids, seen = state.get if state.exists else ([], [])
        last = dict(zip(ids, seen))
        rows = pd.concat(list(batches)).sort_values([at, ident], kind="stable")
        verdicts = []
        for i, when in zip(rows[ident], rows[at]):
            now = int(pd.Timestamp(when).value // 1000)
            last = {k: v for k, v in last.items() if now - v <= WINDOW_S * 1_000_000}
            last[i] = now
            verdicts.append(len(last) > MOST)
        state.update((list(last), list(last.values())))
        latest = max(last.values()) // 1000 + WINDOW_S * 1000 + 1
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({client: [key[0]] * len(rows), ident: rows[ident].to_numpy(), at: rows[at].to_numpy(), "refused": verdicts})

    kinds = dict(stream.dtypes)
    out = f"{client} {kinds[client]}, {ident} {kinds[ident]}, {at} {kinds[at]}, refused boolean"
    timed = stream.withWatermark(at, delay)
    return timed.groupBy(client).applyInPandasWithState(step, out, "ids array<string>, seen array<long>", "append", "EventTimeTimeout")


def first_grants(df: DataFrame, txn: str, at: str, stream: bool = False, delay: str = "1 hour") -> DataFrame:
    """One grant for each transaction: retries make no second one."""
    if stream:
        return df.withWatermark(at, delay).dropDuplicatesWithinWatermark([txn])
    kinds = [c for c in df.columns if c != txn]
    return df.groupBy(txn).agg(F.min(F.struct(at, *[c for c in kinds if c != at])).alias("g")).select(txn, "g.*")


def grant_expiry(paid: Column, days: Column) -> Column:
    return F.unix_seconds(paid) + days * 86400


def in_replay_window(stamp: Column, now: Column) -> Column:
    return F.abs(now - stamp) <= SKEW_S


def hmac_pads(secret: bytes) -> tuple[bytes, bytes]:
    """What the two rounds of HMAC-SHA256 put before the message."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a text, as lower-case hex, by the built-in digest."""
    inner, outer = (F.unhex(F.lit(p.hex())) for p in hmac_pads(secret))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "utf-8")), 256))), 256)


def signature_holds(header: Column, body: Column, secret: bytes, now: Column) -> Column:
    """Whether a header `ts=...;h1=...` (other parts are ignored, of equal ones
    the last counts) signs `ts:body`, not more than SKEW_S seconds from now."""
    parts = F.filter(F.transform(F.split(F.coalesce(header, F.lit("")), ";"), lambda p: F.split(p, "=", -1)), lambda p: F.size(p) == 2)
    part = lambda name: F.get(F.try_element_at(F.filter(parts, lambda p: F.get(p, F.lit(0)) == name), F.lit(-1)), F.lit(1))
    stamp, given = part("ts"), part("h1")
    fresh = F.abs(now - F.trim(stamp).try_cast("double")) <= SKEW_S
    good = (F.length(stamp) > 0) & (F.length(given) > 0) & fresh & (hmac_sha256(secret, F.concat(stamp, F.lit(":"), F.coalesce(body, F.lit("")))) == given)
    return F.coalesce(good, F.lit(False))


def verdict(payload: Column, signed: Column, now: Column, crypto: Column | None = None, key: Column | None = None) -> Column:
    """unreadable, nocrypto, nokey, forged, expired or ok, in this order.
    payload: a struct with v and exp, null if it couldn't be read; crypto, key:
    whether signatures can be checked and there is a key; signed: whether the
    signature holds."""
    yes = F.lit(True)
    return (
        F.when(payload.isNull() | payload["v"].isNull() | payload["exp"].isNull(), "unreadable")
        .when(~F.coalesce(yes if crypto is None else crypto, F.lit(False)), "nocrypto")
        .when(~F.coalesce(yes if key is None else key, F.lit(False)), "nokey")
        .when(~F.coalesce(signed, F.lit(False)), "forged")
        .when(payload["exp"] + SKEW_S < now, "expired")
        .otherwise("ok")
    )
