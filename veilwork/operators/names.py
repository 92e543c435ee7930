"""Names by position, and street addresses, as arrays of (start, text) per text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork.functions.text import CONTACT_FOUND, WHITE, run, strip
from veilwork.operators.arrays import let, matches, placed

# The words that anchor a name.
ROLE_WORDS = (
    r"Chief\s+[A-Za-z]+(?:\s+[A-Za-z]+)?\s+Officer|C[A-Z]{1,3}O|Chair(?:man|woman|person)?|Vice\s+Chair(?:man|woman|person)?|Vice\s+President|President|[SEAV]VP|VP"
    r"|(?:Managing|Executive|Finance|Investment|Non-?Executive)\s+Director|Director|(?:Managing|General|Founding)\s+Partner|Partner|Head\s+of\s+[A-Z][A-Za-z]*|Global\s+Head|Group\s+Head"
    r"|Co-?Founder|Founder|Principal|Associate|Analyst|Manager|Company\s+Secretary|Secretary|Treasurer|General\s+Counsel|Counsel|Solicitor|Barrister|Attorney|Advis[eo]r|Consultant|Controller|Trustee"
)
ROLES = rf"(?i)(?:^|[,\-–—|(]\s*|\s)(?:{ROLE_WORDS})(?:$|[,.\-–—|)]|\s)"
STRONG_ROLES = r"(?i)Chief\s+|\bC[A-Z]{1,3}O\b|Chair|President|\b[SEAV]?VP\b|Director|Partner|Founder|Head\s+of"
SIGN_OFF = r"(?i)\b(?:Yours\s+(?:sincerely|faithfully|truly)|(?:Best|Kind|Warm)\s+regards|Sincerely|Regards)\b"
SIGN_LABEL = r"(?i)(?:(?:^|\s)(?:Name|Signed\s+by|Signature|Printed\s+name|By)\s*:(?:\s*/s/)?|/s/)"
CONTACT_LABEL = r"(?i)^(?:T|M|E|D|F|P|Tel|Mob|Mobile|Cell|Email|E-?mail|Phone|Fax|Direct|DID|Office)\s*[:.]"
CONTACT_VALUE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\+[0-9][0-9\s().-]{7,}"
# Words that make a line no person: organisations, places, markets, sectors, headings.
NOT_NAMES = (
    r"(?i)\b(?:Ltd|Limited|LLC|LLP|L\.?P|Inc|Incorporated|Corp|Corporation|Pte|Pty|PLC|GmbH|AG|NV|BV|SA|SAS|Co|Company|Group|Holdings?"
    r"|Partners|Capital|Ventures?|Fund|Funds|Advisors?|Advisers?|Associates|Bank|Securities|Asset|Management|Investments?|Equity|Trust|Foundation"
    r"|Institute|University|College|School|Committee|Board|Team|Department|Division|Office|Branch|Tower|Building|Plaza|Centre|Center|Confidential"
    r"|City|Province|District|Ward|Town|Village|Street|Road|Avenue|Lane|Floor|Level|Vietnam|Singapore|Malaysia|Indonesia|Thailand|Kong|Kowloon"
    r"|China|Chinese|Pacific|Asia|Asian|America|American|Europe|European|Japan|Japanese|Korea|Korean|India|Indian|Australia|Australian"
    r"|Insurance|Nutrition|Pharmacy|Biotech|Medical|Hospital|Healthcare|Consumer|FinTech|Education|Online|Review|Travel|Experiences?"
    r"|Portfolio|Membership|Services|Restaurant|Savings|Postal|Exchange|Technology|Technologies|Software|Platform|Solutions?|Provider|Brand"
    r"|Summary|Overview|Highlights|Introduction|Appendix|Agenda|Contents|Disclaimer|Background|Conclusion|Recommendations?|Transaction"
    r"|Financials|Valuation|Projections|Structure|Process|Timetable)\b"
)
_PART = r"\p{Lu}[\p{Lu}\p{Ll}\p{M}'’.\-]*"
NAME = rf"^{_PART}(?:[{WHITE}]+{_PART}){{0,4}}$"
# Street types, units before a street, postal codes.
STREETS = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl|Terrace|Ter|Way|Circle|Cir|Parkway|Pkwy|Highway|Hwy|Crescent|Cres|Quay|Rise|Walk|Link|Close|Loop|Path|Green|Gate|Hill|View"
STREET = rf"\b[0-9]{{1,6}}[A-Za-z]?\s+(?:[A-Z][A-Za-z.'-]*\s+){{1,5}}(?:{STREETS})\b\.?"
UNIT = r"(?i)(?:#\s?[A-Z]{0,2}[0-9]{1,3}-[0-9]{1,4}[A-Za-z]?|[0-9]{1,3}/F|(?:UG|LG|G|B[0-9]?)/F|(?:Floor|Level)\s[0-9]{1,3}|[0-9]{1,3}\s?(?:st|nd|rd|th)?\s?(?:Floor|Level))\b[\s,]*$"
POSTAL = r"\b(?:[A-Z]{1,2}[0-9][A-Z0-9]?\s*[0-9][A-Z]{2}|[A-Z][0-9][A-Z]\s*[0-9][A-Z][0-9]|[0-9]{5}(?:-[0-9]{4})?|[0-9]{3}-[0-9]{4}|[0-9]{6}|(?!19[0-9]{2}|20[0-9]{2})[0-9]{4})\b"

_HIT = "array<struct<start:int,text:string>>"


def ascii_borders(pattern: str) -> str:
    r"""The pattern with \b as the border of ASCII words, which Java's isn't."""
    inside = "[A-Za-z0-9_]"
    return pattern.replace(r"\b", f"(?:(?<={inside})(?!{inside})|(?<!{inside})(?={inside}))")


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, start, raw, body) of the lines that aren't blank; start in
    the text."""
    rows = df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("line", "raw"))
    # a running sum over the document's lines: linear, where a fold would copy
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0)).cast("int"))
    return rows.withColumn("body", F.trim("raw")).where("body <> ''")


def neighbours(lines: DataFrame, key: str, above: int, below: int) -> DataFrame:
    """The bodies of the next lines up and down, blank ones left out before."""
    w = Window.partitionBy(key).orderBy("line")
    for k in range(1, above + 1):
        lines = lines.withColumn(f"above{k}", F.coalesce(F.lag("body", k).over(w), F.lit("")))
    for k in range(1, below + 1):
        lines = lines.withColumn(f"below{k}", F.coalesce(F.lead("body", k).over(w), F.lit("")))
    return lines


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(strip(c), run(",.;:") + "$", "")


def is_name(c: Column) -> Column:
    """Two to five capitalised parts of 48 characters at most that are no
    organisation, place, heading or job title."""
    t = _trimmed(c)
    parts = F.size(F.filter(F.split(t, f"[{WHITE}–-]+"), lambda p: p != ""))
    return (F.length(t) <= 48) & t.rlike(NAME) & (parts >= 2) & ~t.rlike(ascii_borders(NOT_NAMES)) & ~t.rlike(ROLES)


def is_role_line(c: Column) -> Column:
    """A short line that a job title leads."""
    t = strip(c)
    led = F.regexp_replace(t, r"^[\s•\-–—*·0-9.]+", "").rlike(rf"(?i)^(?:[,\-–—|(]\s*)?(?:{ROLE_WORDS})(?:$|[,.\-–—|)]|\s)")
    return led & ~is_name(t) & (F.length(t) <= 60) & (F.size(F.split(t, f"[{WHITE}]+")) <= 6)


def pieces(c: Column) -> Column:
    """Pieces of a line between commas, bars and dashes: (start, text)."""
    border = rf"[,|–—]|[{WHITE}]-[{WHITE}]"
    gaps, seps = F.split(c, border, -1), F.regexp_extract_all(c, F.lit(border), F.lit(0))
    both = F.zip_with(gaps, seps, lambda g, s: F.struct(g.alias("g"), F.coalesce(F.length(s), F.lit(0)).alias("n")))
    return placed(both, lambda x: F.length(x["g"]) + x["n"], lambda at, x: F.struct(at.alias("start"), x["g"].alias("text")), _HIT)


def _hit(start: Column, raw: Column) -> Column:
    """A piece without white space around and punctuation after it."""
    lead = F.length(raw) - F.length(F.regexp_replace(raw, f"^[{WHITE}]+", ""))
    return F.struct((start + lead).cast("int").alias("start"), _trimmed(raw).alias("text"))


def names_in(text: Column, from_ocr: bool = False) -> Column:
    """Names after a signature label, under a sign-off or label, over a job
    title or contact line, or beside a title on one line."""
    contact = lambda c: c.rlike(CONTACT_LABEL) | c.rlike(CONTACT_FOUND)
    sign_off = ascii_borders(SIGN_OFF)
    role = (lambda c: is_role_line(c)) if from_ocr else (lambda c: c.rlike(ROLES) & ~is_name(c))
    anchor = "|".join(["(?i)(?m)(?:" + p.replace("(?i)", "") + ")" for p in (ROLES, sign_off, SIGN_LABEL)]) + f"|(?m)(?:{CONTACT_LABEL})|{CONTACT_FOUND}"
    line = lambda at, raw: F.struct(at.alias("start"), raw.alias("raw"), strip(raw).alias("body"))
    lines = F.filter(placed(F.split(text, "\n", -1), lambda raw: F.length(raw) + 1, line, "array<struct<start:int,raw:string,body:string>>"), lambda x: x["body"] != "")

    def of_line(all_: Column, x: Column, i: Column) -> Column:
        near = lambda k: F.coalesce(F.get(all_, i + k)["body"], F.lit(""))
        body = x["body"]
        below = near(1)
        role_below = role(below)
        if from_ocr:
            role_below = role_below & (below.rlike(ascii_borders(STRONG_ROLES)) | contact(near(2)) | contact(near(3)))
        above = near(-1)
        anchored = above.rlike(sign_off) | above.rlike(SIGN_LABEL) | role_below | contact(below)
        rest = F.regexp_replace(body, "^.*?" + SIGN_LABEL, "")
        indent = F.length(x["raw"]) - F.length(F.regexp_replace(x["raw"], f"^[{WHITE}]+", ""))
        labelled = F.array(_hit(x["start"] + indent + F.length(body) - F.length(rest), rest))
        beside = let(pieces(x["raw"]), lambda p: F.when((F.size(p) >= 2) & F.exists(p, lambda q: role(q["text"]) & ~is_name(q["text"])), F.transform(F.filter(p, lambda q: is_name(q["text"])), lambda q: _hit(x["start"] + q["start"], q["text"]))).otherwise(F.array().cast(_HIT)))
        return F.when(body.rlike(SIGN_LABEL) & is_name(rest), labelled).when(is_name(body) & anchored, F.array(_hit(x["start"], x["raw"]))).otherwise(beside)

    found = let(lines, lambda all_: F.flatten(F.transform(all_, lambda x, i: of_line(all_, x, i))))
    # without an anchor in the whole text there is no name
    return F.when(text.rlike(anchor), found).otherwise(F.array().cast(_HIT))


def addresses_in(text: Column) -> Column:
    """Each street with the last postal code after it on its line, of 200
    characters at most; a unit before it belongs to it. Years are no postal
    codes."""

    def whole(m: Column) -> Column:
        stop = m["start"] + F.length(m["text"])
        after = F.regexp_extract(F.substring(text, stop + 1, F.length(text)), r"^[^\n]*", 0)
        lead = F.regexp_extract(F.regexp_extract(F.substring(text, F.lit(1), m["start"]), r"[^\n]*\z", 0), ascii_borders(UNIT), 0)

        def ended(codes: Column) -> Column:
            last = F.try_element_at(codes, F.lit(-1))
            begin = m["start"] - F.length(lead)
            raw = F.substring(text, begin + 1, stop + last["start"] + F.length(last["text"]) - begin)
            short = F.regexp_replace(raw, r"^[\s,]+", "")
            return F.struct((begin + F.length(raw) - F.length(short)).cast("int").alias("start"), F.regexp_replace(short, run(r"\s,") + "$", "").alias("text"))

        # a street that goes over a line's end has nothing after it on its first line
        return F.when(~F.contains(m["text"], F.lit("\n")), let(matches(after, ascii_borders(POSTAL)), lambda codes: F.when(F.size(codes) > 0, ended(codes))))

    found = F.transform(matches(text, ascii_borders(STREET)), whole)
    return F.filter(found, lambda x: x.isNotNull() & (F.length(x["text"]) <= 200))


def _rows(df: DataFrame, key: str, found: Column) -> DataFrame:
    return df.select(F.col(key), F.inline(found).alias("start", "text")).select(key, "start", (F.col("start") + F.length("text")).alias("end"), "text")


def names(df: DataFrame, key: str, text: str, from_ocr: bool = False) -> DataFrame:
    """(key, start, end, text) of names; no shuffle."""
    return _rows(df, key, names_in(F.col(text), from_ocr))


def addresses(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end, text) of addresses; no shuffle."""
    return _rows(df, key, addresses_in(F.col(text)))
