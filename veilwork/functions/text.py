"""String functions on columns. All are built from Spark's own functions and
stay inside code generation or its higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that don't count as parts of a phrase.
STOP_WORDS = ("and", "or", "of", "the", "a", "an", "&", "+")
# Marks that a reader confuses, as (seen, folded); the longer ones first.
LOOK_ALIKES = (("rn", "m"), ("vv", "w"), ("cl", "d"))
LOOK_ALIKE_MARKS = (("0oq", "o"), ("1il|!", "l"), ("5s$", "s"), ("8b", "b"), ("&a", "a"), ("2z", "z"), ("6g", "g"))
# What tells kinds of page tokens.
CONTACT_CUE = r"(?i)^(?:T|M|E|D|F|P|Tel|Mob|Mobile|Cell|Email|E-?mail|Phone|Fax|Direct|DID|Office)\s*[:.]"
CONTACT_VALUE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\+[0-9][0-9\s().-]{7,}"
ROLE_LINE = r"(?i)(?:^|[^A-Za-z0-9_])(?:Director|Partner|Manager|Officer|President|Associate|Analyst|Counsel)(?:$|[^A-Za-z0-9_])"
PUNCTUATION_END = r"[.,;:!?]+$"
#: White space, also what lies outside ASCII, for a character class.
WHITE = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def run(inside: str) -> str:
    """Pattern of a whole run of a class. Where a run must be followed by
    something, a pattern that may begin within it takes the square of the run's
    length to fail."""
    return f"(?<![{inside}])[{inside}]++"


#: CONTACT_VALUE from the beginning of an address's first part.
CONTACT_FOUND = CONTACT_VALUE.replace("[A-Za-z0-9._%+-]+@", run("A-Za-z0-9._%+-") + "@")


def strip(c: Column) -> Column:
    """Without white space around it."""
    return F.regexp_replace(c, rf"^[{WHITE}]++|{run(WHITE)}$", "")


def letters_of(c: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(c, "[^A-Za-z0-9]", "")


def drop_possessive(c: Column) -> Column:
    return F.regexp_replace(c, "['’]s$", "")


def plain(c: Column) -> Column:
    """Possessive off, lower case, letters, digits and & only."""
    return F.regexp_replace(F.lower(drop_possessive(c)), "[^a-z0-9&]", "")


def squeeze(c: Column) -> Column:
    """White space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def normalise_label(c: Column) -> Column:
    """Upper case, everything else an underscore, at most 40 characters."""
    marks = F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "_")
    return F.left(F.regexp_replace(marks, "^_+|_+$", ""), F.lit(40))


def render_label(c: Column) -> Column:
    return F.concat(F.lit("["), c, F.lit("]"))


def in_case_of(word: Column, typed: Column) -> Column:
    """word in the case pattern of typed: all capitals, all lower, or capitalised."""
    letters = F.regexp_replace(typed, "[^A-Za-z]", "")
    return (
        F.when((F.length(letters) > 1) & (letters == F.upper(letters)), F.upper(word))
        .when(typed == F.lower(typed), F.lower(word))
        .otherwise(F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substring(word, 2, 1 << 30))))
    )


def phrase_parts(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: ~F.lower(w).isin(*STOP_WORDS) & w.rlike("[A-Za-z0-9]"))


def part_edits(part: Column) -> Column:
    """Edits that a part of a phrase may differ by."""
    return F.when(F.length(letters_of(part)) >= 8, 2).otherwise(1)


def fuzzy_part(token: Column, part: Column, edits: Column) -> Column:
    """Whether a token is a part, give or take the edits; short parts must be equal."""
    a, b = F.lower(letters_of(drop_possessive(token))), F.lower(letters_of(drop_possessive(part)))
    near = (F.length(b) >= 5) & (F.abs(F.length(a) - F.length(b)) <= edits) & (F.levenshtein(a, b) <= edits)
    return (F.length(b) > 0) & ((a == b) | near)


def near(a: Column, b: Column) -> Column:
    """At most a third of the longer one's length apart; neither empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return (F.length(a) > 0) & (F.length(b) > 0) & (F.levenshtein(a, b) <= F.floor(longer / 3))


def fold(c: Column) -> Column:
    """Lower case, no possessive, nothing but letters, digits and marks that
    look like one; each class of look-alikes as one letter."""
    marks = "a-z0-9&$|!"
    out = F.translate(F.lower(c), "\u2018\u2019`", "'''")
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, f"^[^{marks}]+|[^{marks}]+$", ""), "'s$", ""), f"[^{marks}]+", "")
    for seen, folded in LOOK_ALIKES:
        out = F.replace(out, F.lit(seen), F.lit(folded))
    return F.translate(out, "".join(s for s, _ in LOOK_ALIKE_MARKS), "".join(f * len(s) for s, f in LOOK_ALIKE_MARKS))


def confusable(a: Column, b: Column) -> Column:
    return (fold(a) == fold(b)) & (F.length(fold(b)) >= 3)


def fragment_of(piece: Column, whole: Column) -> Column:
    """A beginning or end of it, of four letters and half of it at least."""
    p, w = F.lower(letters_of(piece)), F.lower(letters_of(whole))
    return (F.length(p) >= 4) & (F.length(p) * 2 >= F.length(w)) & (p != w) & (F.startswith(w, p) | F.endswith(w, p))


def host_contradicts(host: Column, term: Column) -> Column:
    """Whether the text under a shape match says that it is another word: it
    is there, and it is neither the term, a look-alike, a piece of it, nor one
    word of it."""
    h, t = F.lower(letters_of(drop_possessive(host))), F.lower(letters_of(term))
    one = F.exists(phrase_parts(term), lambda p: fuzzy_part(host, p, part_edits(p)))
    return (F.length(h) > 0) & ~F.contains(h, t) & ~confusable(host, term) & ~fragment_of(host, term) & ~one & (h != t)


def looks_like_name(c: Column) -> Column:
    """Up to four capitalised words, no digit, no word in capitals."""
    t = F.trim(c)
    w = words(t)
    return (
        (t != "")
        & ~t.rlike("[0-9]")
        & (F.size(w) <= 4)
        & F.forall(w, lambda x: x.rlike(r"^[A-Z][\p{L}'’-]*$"))
        & ~F.exists(w, lambda x: (F.length(x) > 1) & (x == F.upper(x)))
    )


def token_kind(c: Column) -> Column:
    """Kind of a page token, first match wins."""
    t = strip(c)
    bare = F.regexp_replace(t, f"[,{WHITE}]", "")
    grouped = F.regexp_replace(t, f"[{WHITE}]", "").rlike(r"^[0-9]{1,3}(?:,[0-9]{3})+$")
    return (
        F.when(t == "", "empty")
        .when(bare.rlike(r"^[0-9]{1,6}(?:[.][0-9]+)?%?$") | grouped, "digit")
        .when(t.rlike(CONTACT_CUE) | t.rlike(CONTACT_FOUND), "contact")
        .when(t.rlike(ROLE_LINE), "role")
        .when((F.length(t) <= 6) & t.rlike("[A-Za-z]") & ~t.rlike(f"[{WHITE}]"), "short")
        .when((F.size(F.split(t, f"[{WHITE}]+")) >= 4) | (F.length(t) >= 24), "long")
        .otherwise("word")
    )


def shape_relief(c: Column) -> Column:
    """What a short bar lets a word's picture score less."""
    n = F.length(c)
    return F.when(F.contains(c, F.lit(" ")) | (n <= 4), 0.0).otherwise(F.least(F.lit(0.08), (n - 4) * 0.008))


def pdf_number(c: Column) -> Column:
    """Four decimals at most, no trailing zeros; null if not finite."""
    text = F.format_string("%.4f", c)
    short = F.regexp_replace(F.regexp_replace(text, "0+$", ""), "[.]$", "")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.when(short == "-0", "0").otherwise(short))


def pdf_string(c: Column) -> Column:
    return F.concat(F.lit("("), F.regexp_replace(c, r"([\\()])", r"\\$1"), F.lit(")"))


def base64url(c: Column) -> Column:
    """Decoded text of unpadded base64url."""
    padded = F.rpad(F.translate(c, "-_", "+/"), (F.floor((F.length(c) + 3) / 4) * 4).cast("int"), F.lit("="))
    return F.unbase64(padded).cast("string")
