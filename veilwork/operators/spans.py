"""Span detectors and span algebra.

A span is a row (id, kind, start, end, confidence, term, text): start from 0,
end exclusive, in code points. All detectors and terms work on the text where it
is, in one scan, and give an array of spans; only spans go through the one
shuffle on the document's id, for the resolution."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.functions.text import WHITE, run
from veilwork.operators.arrays import let, matches
from veilwork.operators.names import addresses_in, ascii_borders, names_in

# Patterns of the detectors.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}"
PHONE = r"\+[0-9]{1,3}[\s.-]?(?:\([0-9]{1,4}\)[\s.-]?)?[0-9]{1,4}(?:[\s.-]?[0-9]{2,4}){1,4}\b"
URL = r"\bhttps?://[^\s<>\"')\]]+"
URL_END = r"[.,;:!?]+$"

_SPAN = "array<struct<kind:string,start:int,end:int,confidence:string,term:string,text:string>>"


def _white(pattern: str) -> str:
    r"""The pattern with \s as all white space."""
    return pattern.replace(r"\s", WHITE)


def emails_in(text: Column) -> Column:
    """By EMAIL, written without its loop over labels, which takes a level of
    Java's stack for each: one class takes the host, and the second of two
    dots, which ends it, is hidden by a mark that an address's first part may
    hold but a host not. A match begins where a run begins or the last match
    ended, which is where it would begin anyway."""
    part = "A-Za-z0-9._%+-"
    flat = rf"(?:(?<![{part}])|\G)[{part}]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{{2,24}}"
    two = F.contains(text, F.lit(".."))
    found = lambda t: matches(t, flat)
    as_is = lambda m: F.struct(m["start"].alias("start"), F.substring(text, m["start"] + 1, F.length(m["text"])).alias("text"))
    return F.when(two, F.transform(found(F.regexp_replace(text, r"(?<=\.)\.", "_")), as_is)).otherwise(found(text))


def phones_in(text: Column) -> Column:
    """Numbers with a country code and 8 to 15 digits in all."""
    return F.filter(matches(text, ascii_borders(_white(PHONE))), lambda m: F.length(F.regexp_replace(m["text"], "[^0-9]", "")).between(8, 15))


def urls_in(text: Column) -> Column:
    """Web addresses without the sentence's punctuation after them."""
    return F.transform(matches(text, ascii_borders(_white(URL))), lambda m: F.struct(m["start"].alias("start"), F.regexp_replace(m["text"], run(".,;:!?") + "$", "").alias("text")))


#: Detectors by kind: (start, text) of what they find in a text.
DETECTORS = {"email": emails_in, "phone": phones_in, "url": urls_in, "address": addresses_in, "person": names_in}


def _spans(found: Column, kind: str) -> Column:
    made = lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["text"])).alias("end"), F.lit("high").alias("confidence"), F.lit(None).cast("string").alias("term"), m["text"].alias("text"))
    return F.transform(found, made)


_TERM_PART = re.compile(r"\s+and\b\s*|&|\s+|.", re.I | re.S)


def term_body(term: str, from_ocr: bool = False) -> str:
    """Pattern of a term: white space may stand between any two characters;
    a blank must be there (read text: blanks, dashes, bullets, bars or
    slashes, or none); `&` and a spaced `and` stand for each other."""
    any_ = f"[{WHITE}]*"
    gap = rf"[{WHITE}\-–—·•|/]*" if from_ocr else f"[{WHITE}]+"
    out = ""
    for m in _TERM_PART.finditer(term):
        part, more = m.group(), m.end() < len(term) and not term[m.end()].isspace()
        if part == "&":
            out += f"(?:&|{gap}and{gap})" + (any_ if more else "")
        elif part.isspace():
            out += gap
        elif part[0].isspace():
            out += f"(?:{gap}and{gap}|{gap}&{gap})"
        else:
            out += re.escape(part) + (any_ if more else "")
    return out


def _edge(c: str) -> str | None:
    """The class a term's border may not touch."""
    return "A-Za-z" if re.match("[A-Za-z]", c) else "0-9" if c.isdigit() and c.isascii() else None


def terms_in(text: Column, wanted: list[str], from_ocr: bool = False) -> Column:
    """Spans of listed terms, whatever their case. A border of a term may not
    touch a character of its own class; the one before is consumed with the
    match. A term is looked for only in a text that holds its words, white
    space aside, so a long list costs little where nothing is found."""
    listed = sorted({t.strip() for t in wanted if t.strip()}, key=lambda t: (-len(t), t))
    rows = []
    for term in listed:
        before, after = _edge(term[0]), _edge(term[-1])
        pattern = "(?iu)" + (f"(?:^|[^{before}])" if before else "") + term_body(term, from_ocr) + (f"(?![{after}])" if after else "")
        words = [w.lower() for w in re.split(r"\s+and\b|&|\s+", term, flags=re.I) if w]
        rows.append(F.struct(F.lit(term).alias("term"), F.lit(pattern).alias("pattern"), F.lit(before or "").alias("before"), F.array(*[F.lit(w) for w in words if w.isascii()]).cast("array<string>").alias("words")))
    if not rows:
        return F.array().cast(_SPAN)

    def hits(t: Column) -> Column:
        def made(m: Column) -> Column:
            first = F.left(m["text"], F.lit(1))
            lead = (((t["before"] == "A-Za-z") & ~first.rlike("[A-Za-z]")) | ((t["before"] == "0-9") & ~first.rlike("[0-9]"))).cast("int")
            return F.struct(
                F.lit("term").alias("kind"), (m["start"] + lead).alias("start"), (m["start"] + F.length(m["text"])).alias("end"), F.lit("high").alias("confidence"),
                t["term"].alias("term"), F.substring(m["text"], lead + 1, F.length(m["text"])).alias("text"),
            )

        return F.transform(matches(text, t["pattern"]), made)

    squeezed = F.lower(F.regexp_replace(text, f"[{WHITE}]+", ""))
    here = lambda s: F.filter(F.array(*rows), lambda t: F.forall(t["words"], lambda w: F.contains(s, w)))
    return F.flatten(F.transform(let(squeezed, here), hits))


def _rows(df: DataFrame, key: str, spans: Column) -> DataFrame:
    return df.select(F.col(key), F.inline(spans))


def emails(df: DataFrame, key: str, text: str) -> DataFrame:
    return _rows(df, key, _spans(emails_in(F.col(text)), "email"))


def phones(df: DataFrame, key: str, text: str) -> DataFrame:
    return _rows(df, key, _spans(phones_in(F.col(text)), "phone"))


def urls(df: DataFrame, key: str, text: str) -> DataFrame:
    return _rows(df, key, _spans(urls_in(F.col(text)), "url"))


def terms(df: DataFrame, wanted: list[str], key: str, text: str, from_ocr: bool = False) -> DataFrame:
    return _rows(df, key, terms_in(F.col(text), wanted, from_ocr))


def find_all(df: DataFrame, key: str, text: str, kinds: tuple[str, ...] = tuple(DETECTORS), listed: tuple[str, ...] = (), accept: Column | None = None, from_ocr: bool = False) -> DataFrame:
    """Spans of the enabled detectors and listed terms, in one scan, filtered
    before they are resolved: the filter doesn't commute with the resolution.
    A null text has none."""
    t = F.col(text)
    found = [_spans(names_in(t, from_ocr) if k == "person" else DETECTORS[k](t), k) for k in DETECTORS if k in kinds]
    if listed:
        found.append(terms_in(t, list(listed), from_ocr))
    out = _rows(df, key, F.concat(*found))
    return out if accept is None else out.where(accept)


def resolve(spans: DataFrame, key: str) -> DataFrame:
    """Spans of which no two overlap: the longest first, then the surer, then
    the first. A term inside a winner is kept once in its `holds`; it gives its
    identity to a winner that is unsure and no term, which makes it sure. Spans
    are folded by runs that touch nothing else, which are short however many
    spans a document has."""
    rank = F.when(F.col("confidence") == "high", 0).otherwise(1)
    item = F.struct(
        (F.col("start") - F.col("end")).alias("o1"), rank.alias("o2"), F.col("start").alias("start"), F.coalesce("term", F.lit("")).alias("o3"), F.col("kind").alias("kind"),
        F.col("end").alias("end"), "confidence", "term", "text",
    )
    kept_type = "array<struct<kind:string,start:int,end:int,confidence:string,term:string,text:string,holds:array<string>>>"

    def step(kept: Column, s: Column) -> Column:
        over = lambda k: (s["start"] < k["end"]) & (k["start"] < s["end"])
        # the first kept span that it overlaps
        hit = F.get(F.filter(kept, over), F.lit(0))
        inside = (s["kind"] == "term") & (hit["start"] <= s["start"]) & (s["end"] <= hit["end"])
        relabel = inside & (hit["confidence"] != "high") & (hit["kind"] != "term")

        def touched(k: Column) -> Column:
            mine = inside & (k["start"] == hit["start"])
            return F.struct(
                F.when(mine & relabel, "term").otherwise(k["kind"]).alias("kind"), k["start"].alias("start"), k["end"].alias("end"), F.when(mine & relabel, "high").otherwise(k["confidence"]).alias("confidence"),
                F.when(mine & relabel, s["term"]).otherwise(k["term"]).alias("term"), k["text"].alias("text"), F.when(mine & ~F.array_contains(k["holds"], s["term"]), F.concat(k["holds"], F.array(s["term"]))).otherwise(k["holds"]).alias("holds"),
            )

        new = F.struct(*[s[n].alias(n) for n in ("kind", "start", "end", "confidence", "term", "text")], F.array().cast("array<string>").alias("holds"))
        return F.when(F.exists(kept, over), F.transform(kept, touched)).otherwise(F.concat(kept, F.array(new)))

    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("_fresh", F.when(F.col("start") < reach, 0).otherwise(1))
    runs = runs.withColumn("_run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    folded = runs.groupBy(key, "_run").agg(F.aggregate(F.array_sort(F.collect_list(item)), F.array().cast(kept_type), step).alias("kept"))
    return folded.select(key, F.inline("kept")).withColumn("id", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")))


def cover(spans: DataFrame, key: str) -> DataFrame:
    """(key, start, end): the union of all spans as disjoint intervals.
    Redaction by it leaves no part of any span, also of those that the
    resolution drops."""
    item = F.struct(F.col("start").alias("start"), F.col("end").alias("end"))
    kind = "array<struct<start:int,end:int>>"

    def step(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joins = (F.size(out) > 0) & (F.get(out, F.size(out) - 1)["end"] >= s["start"])
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(out, F.array(s)))

    return spans.groupBy(key).agg(F.aggregate(F.array_sort(F.collect_list(item)), F.array().cast(kind), step).alias("c")).select(key, F.inline("c"))


def apply(df: DataFrame, spans: DataFrame, key: str, text: str, replacement: Column) -> DataFrame:
    """(key, redacted): the texts that have spans, each span as `replacement`
    (of its columns; null: nothing). A span that begins before the last one's
    end is skipped."""
    made = spans.select(key, "start", "end", F.coalesce(replacement, F.lit("")).alias("new"))
    lists = made.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "new"))).alias("_s"))
    whole = F.col(text)

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(whole, acc["at"] + 1, s["start"] - acc["at"])
        new = F.struct(F.concat(acc["out"], gap, s["new"]).alias("out"), s["end"].alias("at"))
        return F.when(s["start"] < acc["at"], acc).otherwise(new)

    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    full = F.aggregate("_s", zero, step, lambda acc: F.concat(acc["out"], F.substring(whole, acc["at"] + 1, F.length(whole))))
    return df.join(lists, key).select(key, full.alias("redacted"))


#: Styles of a redaction: block, label (of the kind), remove.
STYLES = {
    "block": lambda: F.expr("repeat('█', greatest(end - start, 1))"),
    "label": lambda: F.concat(F.lit("["), F.upper("kind"), F.lit("]")),
    "remove": lambda: F.lit(""),
}
