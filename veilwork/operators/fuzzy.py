"""Tolerant matching of misread text: parts, phrases, other spellings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions import text as t

#: Connecting words that may stand between two parts of a phrase.
SEPARATORS = ("-", "–", "—", "•", "|", "/", "&", "+")


def osa(a: str | None, b: str | None) -> int | None:
    """Optimal string alignment distance: edits, with a swap of neighbours as one."""
    if a is None or b is None:
        return None
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
    return last[-1]


def osa_udf():
    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([osa(x, y) for x, y in zip(a, b)], dtype="Int32")

    return distance


#: Words of so many letters may have two edits, shorter ones one.
LONG = 9


def within_osa(a: Column, b: Column, edits: Column) -> Column:
    """osa(a, b) <= edits, which is 2 for b of LONG letters or more, else 1.
    Python works in Arrow batches, and only where the built-in distance doesn't
    settle it: it is between osa and twice osa."""
    lev = F.levenshtein(a, b)

    @F.pandas_udf("boolean")
    def slow(x: pd.Series, y: pd.Series) -> pd.Series:
        # null: the built-in distance has settled it
        return pd.Series([None if p is None else osa(p, q) <= (2 if len(q) >= LONG else 1) for p, q in zip(x, y)], dtype="boolean")

    unsure = (lev > edits) & (lev <= edits * 2)
    return F.when(lev <= edits, True).otherwise(F.coalesce(slow(F.when(unsure, a), b), F.lit(False)))


def gap_ok(gap: Column, connectors: int) -> Column:
    """Whether a gap between two parts of a phrase may be skipped: separators,
    crumbs of one to three digits, and so many connecting words at most."""
    tokens = t.words(gap)
    free = lambda w: w.isin(*SEPARATORS) | w.rlike("^[0-9]{1,3}$")
    joins = lambda w: F.lower(w).isin(*t.STOP_WORDS)
    return F.forall(tokens, lambda w: free(w) | joins(w)) & (F.size(F.filter(tokens, lambda w: joins(w) & ~free(w))) <= connectors)


def skipped_connectors(phrase: Column, first: Column, second: Column) -> Column:
    """Words of the phrase between two of its parts."""
    w = t.words(phrase)
    return (F.array_position(w, second) - F.array_position(w, first) - 1).cast("long")


def word_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, n) of the words of letters in each document; partial counts
    first."""
    return df.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))


def spellings(counts: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """(key, part, spelling, n): capitalised words of five letters or more of a
    document that are near a term's part, never occur there in lower case,
    aren't the part itself, nor a piece of it. parts: (part). They meet by
    their length."""
    # one row per folded word: whether it occurs in lower case
    lower = counts.where(F.col("word") == F.lower("word")).select(key, F.col("word").alias("low"))
    capital = counts.where(F.col("word").rlike(r"^\p{Lu}") & (F.length("word") >= 5)).withColumn("low", F.lower("word"))
    only = capital.join(lower, [key, "low"], "left_anti").withColumn("size", F.length("low"))
    p = parts.select("part", F.lower("part").alias("lp")).where(F.length("part") >= 5)
    edits = F.when(F.length("lp") >= LONG, 2).otherwise(1)
    p = p.withColumn("size", F.explode(F.sequence(F.length("lp") - 2, F.length("lp") + 2)))
    pairs = only.join(p, "size").where(F.col("low") != F.col("lp"))
    # a piece of the part is a word that was cut off
    whole = ~(F.startswith("lp", "low") | F.endswith("lp", "low"))
    near = pairs.where(within_osa(F.col("low"), F.col("lp"), edits) & whole)
    return near.groupBy(key, "part", t.in_case_of(F.col("word"), F.col("part")).alias("spelling")).agg(F.sum("n").alias("n"))


def phrase_hits(text: str, parts: list[str], connectors: int) -> list[tuple[int, int]]:
    """Spans of a phrase whose parts stand in order with allowed gaps, at most
    one of them misread, one exact at least; parts are used once."""
    import re

    tokens = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[A-Za-z0-9][A-Za-z0-9'’]*", text)]
    clean = lambda s: re.sub(r"[^a-z0-9]", "", re.sub(r"['’]s$", "", s.lower()))

    def fits(token: str, part: str) -> int:
        """0 for equal, 1 for misread, -1 for another word."""
        a, b = clean(token), clean(part)
        if a == b:
            return 0
        most = 2 if len(b) >= 8 else 1
        return 1 if len(b) >= 5 and abs(len(a) - len(b)) <= most and osa(a, b) <= most else -1

    stop = set(t.STOP_WORDS)
    out, used = [], set()
    for first in range(len(tokens)):
        if first in used:
            continue
        chain, misread = [first], fits(tokens[first][2], parts[0])
        if misread < 0:
            continue
        at = first
        for part in parts[1:]:
            best = None
            for k in range(at + 1, min(len(tokens), at + 6)):
                gap = text[tokens[at][1] : tokens[k][0]]
                words = [w for w in gap.split() if w not in SEPARATORS and not re.fullmatch(r"\d{1,3}", w)]
                if any(w.lower() not in stop for w in words) or len(words) > connectors:
                    break
                fit = fits(tokens[k][2], part) if k not in used else -1
                if fit == 0 or (fit == 1 and not misread):
                    best = (k, fit)
                    break
            if best is None:
                break
            chain.append(best[0])
            misread += best[1]
            at = best[0]
        if len(chain) == len(parts) and misread <= 1 and (misread < len(parts)):
            used.update(chain)
            out.append((tokens[chain[0]][0], tokens[chain[-1]][1]))
    return out


def phrases(df: DataFrame, key: str, text: str, term: str, connectors: int = 1) -> DataFrame:
    """(key, start, end, text) of a phrase's misread forms: an ordered chain
    with parts that are used up, which no built-in expresses."""
    parts = [w for w in term.split() if w.lower() not in t.STOP_WORDS]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, a, b, s[a:b]) for k, s in zip(pdf["key"], pdf["text"]) if s for a, b in phrase_hits(s, parts, connectors)]
            yield pd.DataFrame(rows, columns=[key, "start", "end", "text"])

    some = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return some.mapInPandas(find, f"{key} {dict(df.dtypes)[key]}, start int, end int, text string")
