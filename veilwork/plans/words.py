"""Queries of string functions, tolerant matching, names and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwork.functions import text as t
from veilwork.operators import fuzzy, names
from veilwork.plans import detect_sql
from veilwork.plans.common import Fixture, Registry, kind_sql, table

query = Registry()

PAIRS = Fixture(
    "id long, a string, b string",
    (
        (1, "Marlowe's", "Marlowe"), (2, "MarIowe", "Marlowe"), (3, "Marlow", "Marlowe"), (4, "Kestrel", "Marlowe"), (5, "Hernshaw", "Hemshaw"), (6, "Cap1tal", "Capital"),
        (7, "rowan", "Rowan"), (8, "Rwoan", "Rowan"), (9, "ab", "abc"), (10, "", "abc"), (11, "Windermere", "Winderrnere"), (12, "mere", "Windermere"), (13, "Winder", "Windermere"),
        (14, "Juniper's", "Juniper Holdings"), (15, "JUNIPER", "Juniper"), (16, "Ledger2", "Ledger"), (17, "Oakfield", "Oakfeild"), (18, "Silverton-Hale", "Silverton Hale"), (19, "x", "x"), (20, "0liver", "Oliver"),
        (21, "P&N's", "PaN's"), (22, "Quiz", "Oui2"), (23, "5i$8", "ssb|b"), (24, "(Go!)", "60l"), (25, "cl", "d"), (26, "clad", "dad"), (27, "vvin", "win"), (28, "‘O’’s", "O"), (29, "a", "&"), (30, "A1B", "ail3"), (31, "z2g6", "2z6g"), (32, "", ""), (33, "rn’s", "m"), (34, "Ab-Cd", "abcd"),
    ),
)
LABELS = Fixture(
    "id long, s string",
    ((1, "claimant one"), (2, "  Jane's employer "), (3, "__a--b__"), (4, "ünïcode label"), (5, "a" * 60), (6, ""), (7, "Rowan Hale"), (8, "ROWAN HALE"), (9, "Rowan"), (10, "rowan hale"), (11, "Rowan 2"), (12, "Émile O’Hara-Pike"), (13, "one two  three\tfour five"), (14, "A B C D E")),
)
TOKENS = Fixture(
    "id long, s string",
    ((1, ""), (2, "  "), (3, "12.5%"), (4, "a@b.org"), (5, "+44 (20) 1"), (6, "Managing Director"), (7, "Q1"), (8, "four words of prose"), (9, "incomprehensibilities-xyz"), (10, "Harbour"), (11, "2024"), (12, "Rev 12"),
     *enumerate(("1234567", "123456", "1,234,567", "12,34", "1 234", "12.5.6", "5%", "%", "Tel. 5", "T:", "Telly: 5", "E-mail: x", "a@b.o", "a@b.c1.org", "+1234567", "+12345678", "+1 (2) 34 5", "Directors", "co-director", "PARTNER,", "sub_partner", "Officer2", "Abcdef", "Abcdefg", "123 ab", "a b c", "a b c d", "abcdefghijklmnopqrstuvw", "abcdefghijklmnopqrstuvwx", "#!", "q&a"), 13)),
)
GAPS = Fixture("id long, gap string", ((1, " "), (2, " - "), (3, " of the "), (4, " and "), (5, " 12 "), (6, " 1234 "), (7, " house "), (8, " & of "), (9, "")))
NUMBERS = Fixture("id long, x double", ((1, 1.0), (2, 0.5), (3, -2.25), (4, 3.14159), (5, 100.0), (6, 0.00001), (7, -0.00001), (8, 12.3400)))
TOKEN = Fixture("id long, payload string", ((1, "eyJ2IjoxLCJleHAiOjE3MDAwMDAwMDAsInBsYW4iOiJ5ZWFyIiwiaWQiOiJhIn0"), (2, "eyJ2IjoxLCJleHAiOjE5MDAwMDAwMDAsInBsYW4iOiJkYXkiLCJpZCI6ImJiIn0"), (3, "bm90IGpzb24")))

# the SQL twins of the functions, over a column expression
_POSS = "regexp_replace({0}, '[''’]s$', '')"
_LETTERS = "regexp_replace({0}, '[^A-Za-z0-9]', '', 'g')"


def poss(c):
    return _POSS.format(c)


def letters(c):
    return _LETTERS.format(c)


def fold_sql(c):
    marks = "a-z0-9&$|!"
    out = f"replace(replace(replace(lower({c}), '‘', ''''), '’', ''''), '`', '''')"
    for pattern in (f"^[^{marks}]+|[^{marks}]+$", "''s$", f"[^{marks}]+"):
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    for seen, folded in (("rn", "m"), ("vv", "w"), ("cl", "d"), ("[0oq]", "o"), ("[1il|!]", "l"), ("[5s$]", "s"), ("[8b]", "b"), ("[&a]", "a"), ("[2z]", "z"), ("[6g]", "g")):
        out = f"regexp_replace({out}, '{seen}', '{folded}', 'g')"
    return out


def clean(c):
    return f"lower({letters(poss(c))})"


def fragment_sql(p, w):
    p, w = f"lower({letters(p)})", f"lower({letters(w)})"
    return f"(length({p}) >= 4 AND length({p}) * 2 >= length({w}) AND {p} <> {w} AND (starts_with({w}, {p}) OR ends_with({w}, {p})))"


def part_sql(a, b, edits):
    a, b = clean(a), clean(b)
    return f"(length({b}) > 0 AND ({a} = {b} OR length({b}) >= 5 AND abs(length({a}) - length({b})) <= {edits} AND levenshtein({a}, {b}) <= {edits}))"


PARTS_SQL = "list_filter(string_split_regex(trim({0}), '\\s+'), lambda w: lower(w) NOT IN ({1}) AND regexp_matches(w, '[A-Za-z0-9]'))"


def parts_sql(c):
    return PARTS_SQL.format(c, ", ".join(f"'{w}'" for w in t.STOP_WORDS))


_EDITS = "(CASE WHEN length(" + letters("{0}") + ") >= 8 THEN 2 ELSE 1 END)"


@query(
    f"""SELECT id, {letters('a')} AS letters, regexp_replace(lower({poss('a')}), '[^a-z0-9&]', '', 'g') AS plain, CAST(levenshtein({letters('a')}, {letters('b')}) AS BIGINT) AS lev,
 {part_sql('a', 'b', _EDITS.format('b'))} AS part, ({letters('a')} <> '' AND {letters('b')} <> '' AND levenshtein({letters('a')}, {letters('b')}) <= floor(greatest(length({letters('a')}), length({letters('b')})) / 3)) AS near,
 {fold_sql('a')} AS folded, ({fold_sql('a')} = {fold_sql('b')} AND length({fold_sql('b')}) >= 3) AS confusable, {fragment_sql('a', 'b')} AS fragment, array_to_string({parts_sql('b')}, '|') AS parts,
 (length({clean('a')}) > 0 AND NOT contains({clean('a')}, lower({letters('b')})) AND NOT ({fold_sql('a')} = {fold_sql('b')} AND length({fold_sql('b')}) >= 3) AND NOT {fragment_sql('a', 'b')}
 AND len(list_filter({parts_sql('b')}, lambda p: {part_sql('a', 'p', _EDITS.format('p'))})) = 0 AND {clean('a')} <> lower({letters('b')})) AS veto FROM {PAIRS.sql}"""
)
def word_pairs(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return PAIRS.df(spark).select(
        "id", t.letters_of(a).alias("letters"), t.plain(a).alias("plain"), F.levenshtein(t.letters_of(a), t.letters_of(b)).cast("long").alias("lev"), t.fuzzy_part(a, b, t.part_edits(b)).alias("part"), t.near(t.letters_of(a), t.letters_of(b)).alias("near"),
        t.fold(a).alias("folded"), t.confusable(a, b).alias("confusable"), t.fragment_of(a, b).alias("fragment"), F.array_join(t.phrase_parts(b), "|").alias("parts"), t.host_contradicts(a, b).alias("veto"),
    )


@query(
    r"""SELECT id, left(regexp_replace(regexp_replace(upper(s), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 40) AS label, CAST(len(list_filter(string_split_regex(s, '\s+'), lambda w: w <> '')) AS BIGINT) AS n_words, trim(regexp_replace(s, '\s+', ' ', 'g')) AS squeezed,
 (NOT regexp_matches(trim(s), '[0-9]') AND trim(s) <> '' AND len(list_filter(string_split_regex(trim(s), '\s+'), lambda w: w <> '')) <= 4 AND len(list_filter(string_split_regex(trim(s), '\s+'), lambda w: w <> '' AND NOT (regexp_matches(w, '^[A-Z][\p{L}''’-]*$') AND NOT (length(w) > 1 AND w = upper(w))))) = 0) AS name,
 CASE WHEN contains(s, ' ') OR length(s) <= 4 THEN 0.0 ELSE least(0.08, (length(s) - 4) * 0.008) END::DOUBLE AS relief FROM """
    + LABELS.sql
)
def label_strings(spark, sf_dir):
    s = F.col("s")
    return LABELS.df(spark).select("id", t.normalise_label(s).alias("label"), t.word_count(s).alias("n_words"), t.squeeze(s).alias("squeezed"), t.looks_like_name(s).alias("name"), t.shape_relief(s).cast("double").alias("relief"))


@query(f"SELECT id, {kind_sql('s')} AS kind FROM {TOKENS.sql}")
def token_kinds(spark, sf_dir):
    return TOKENS.df(spark).select("id", t.token_kind(F.col("s")).alias("kind"))


_FREE = "(w IN (" + ", ".join(f"'{s}'" for s in fuzzy.SEPARATORS) + ") OR regexp_matches(w, '^[0-9]{1,3}$'))"
_JOIN = "(lower(w) IN (" + ", ".join(f"'{s}'" for s in t.STOP_WORDS) + "))"


@query(
    f"""SELECT id, len(list_filter(ws, lambda w: NOT ({_FREE} OR {_JOIN}))) = 0 AND len(list_filter(ws, lambda w: {_JOIN} AND NOT {_FREE})) <= 1 AS ok
FROM (SELECT id, list_filter(string_split_regex(gap, '\\s+'), lambda w: w <> '') AS ws FROM {GAPS.sql})"""
)
def phrase_gaps(spark, sf_dir):
    return GAPS.df(spark).select("id", fuzzy.gap_ok(F.col("gap"), 1).alias("ok"))


@query(
    f"""SELECT id, CASE WHEN r = '-0' THEN '0' ELSE r END AS number FROM (SELECT id, regexp_replace(regexp_replace(printf('%.4f', x), '0+$', ''), '[.]$', '') AS r FROM {NUMBERS.sql})"""
)
def pdf_numbers(spark, sf_dir):
    return NUMBERS.df(spark).select("id", t.pdf_number(F.col("x")).alias("number"))


@query(
    f"""SELECT id, CAST(CASE WHEN json_valid(j) THEN json_extract(j, '$.exp') END AS BIGINT) AS "exp", CASE WHEN json_valid(j) THEN json_extract_string(j, '$.plan') END AS plan
FROM (SELECT id, decode(from_base64(replace(replace(payload, '-', '+'), '_', '/') || repeat('=', CAST((4 - length(payload) % 4) % 4 AS INTEGER)))) AS j FROM {TOKEN.sql})"""
)
def token_payloads(spark, sf_dir):
    j = F.from_json(t.base64url(F.col("payload")), "exp long, plan string")
    return TOKEN.df(spark).select("id", j["exp"].alias("exp"), j["plan"].alias("plan"))


@query(
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\p{L}+')) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY doc_id, word),
 only_ AS (SELECT doc_id, word, lower(word) AS low, n FROM c WHERE regexp_matches(word, '^\p{Lu}') AND length(word) >= 5 AND NOT EXISTS (SELECT 1 FROM c l WHERE l.doc_id = c.doc_id AND l.word = lower(c.word))),
 p AS (SELECT part, lower(part) AS lp FROM (VALUES ('Thering'), ('Ererbleth'), ('Stion')) v(part)),
 -- DuckDB's distance counts bytes, so letters outside ASCII become marks
 x AS (SELECT *, regexp_replace(low, '[^ -~]', '#', 'g') AS m FROM only_)
 SELECT doc_id, part, upper(left(low, 1)) || substr(low, 2) AS spelling, CAST(sum(n) AS BIGINT) AS n FROM x, p WHERE abs(length(low) - length(lp)) <= 2 AND low <> lp AND NOT starts_with(lp, low) AND NOT ends_with(lp, low)
 AND (levenshtein(m, lp) <= (CASE WHEN length(lp) >= 9 THEN 2 ELSE 1 END)
  OR (length(lp) < 9 AND length(low) = length(lp) AND len(list_filter(range(1, length(lp)), lambda i: left(lp, i - 1) || substr(lp, i + 1, 1) || substr(lp, i, 1) || substr(lp, i + 2) = low)) > 0)
  OR (length(lp) >= 9 AND len(list_filter(range(1, length(lp)), lambda i: levenshtein(left(lp, i - 1) || substr(lp, i + 1, 1) || substr(lp, i, 1) || substr(lp, i + 2), m) <= 1)) > 0)) GROUP BY ALL"""
)
def spellings_offered(spark, sf_dir):
    parts = spark.createDataFrame([("Thering",), ("Ererbleth",), ("Stion",)], "part string")
    return fuzzy.spellings(fuzzy.word_counts(table(spark, sf_dir, "documents"), "doc_id", "text"), parts, "doc_id")


@query("SELECT d.doc_id, count(*) AS n FROM documents d, (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS w, doc_id AS i FROM documents) x WHERE x.i = d.doc_id GROUP BY d.doc_id")
def word_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).cast("long").alias("n")).where("n > 0")


OSA = Fixture("id long, a string, b string, d long", ((1, "ca", "abc", 3), (2, "rowan", "rwoan", 1), (3, "abcdef", "badcfe", 3), (4, "", "abc", 3), (5, "same", "same", 0), (6, "kitten", "sitting", 3)))


@query(f"SELECT id, d FROM {OSA.sql}")
def osa_distance(spark, sf_dir):
    return OSA.df(spark).select("id", fuzzy.osa_udf()("a", "b").cast("long").alias("d"))


PHRASES = Fixture("id long, s string, n long", ((1, "the Harbour & Lights fund", 1), (2, "Harbor and Lights", 1), (3, "Harbor and Lihgts", 0), (4, "Harbour house Lights", 0), (5, "Harbour 12 - Lights, Harbour Lights", 2), (6, "Lights Harbour", 0)))


@query(f"SELECT id, n FROM {PHRASES.sql}")
def phrase_chains(spark, sf_dir):
    rows = PHRASES.df(spark)
    hits = fuzzy.phrases(rows, "id", "s", "Harbour and Lights").groupBy("id").agg(F.count("*").alias("n"))
    return rows.select("id").join(hits, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


CONTACTS = Fixture(
    "id long, s string",
    tuple(
        enumerate(
            (
                "Rowan Hale\nManaging Director", "Rowan Hale\n\n+44 20 7946 0001", "Ada Marlowe\nada@marlowe.org", "Yours sincerely,\nAda Marlowe", "Name: Ada Marlowe\nnext", "By: /s/ Rowan Hale", "Rowan Hale, Managing Director", "Partner – Ada Marlowe",
                "Marlowe Group\nada@marlowe.org", "Ho Harbour City\n+44 20 7946 0001", "Overview\nManaging Director", "Rowan Hale\nnothing here", "MAI-ANH-VO\nPartner", "Harbour Tower\nDirector", "Harbour Hospital\nDirector", "Yum China\nTel: 12", "Rowan Associates\nCEO",
                "  Rowan Hale,  \n \t\nNon-Executive Director", "x /s/ Rowan Hale", "/s/ Rowan Hale", "Signed by: Ada Marlowe", "Printed name : Ada Marlowe.", "kind regards\r\nAda Marlowe\r", "Ada Marlowe - Head of Treasury", "Ada Marlowe-Partner", "Ada Marlowe | Barrister | Rowan Hale",
                "Vice Chair, Ada B. Marlowe", "Ada\nMarlowe\nDirector", "DID: 5\nAda Marlowe", "Ada Marlowe\nDID: 5", "Ada Marlowe\nOffice. 5", "Ada Marlowe\nthe chairs", "Ada Marlowe\nChairs", "Ada Marlowe\nSEVP", "Ada Marlowe\nEVP", "Ada Marlowe\nCTO\nRowan Hale\nCOO",
                "Émile O’Hara\nAnalyst", "Ada Marlowe De La Cruz\nAnalyst", "Ada Marlowe De La Cruz Hale\nAnalyst", "Analyst, Global Head", "Ada\u00a0Marlowe\nTrustee", "", "Regardsless\nAda Marlowe", "Regards Ada Marlowe", "Ada Marlowe\n\n\n\nTreasurer", "Name: Director\nAda Marlowe",
            ),
            1,
        )
    ),
)


@query(detect_sql.names(CONTACTS.sql, "id", "s"))
def names_by_position(spark, sf_dir):
    return names.names(CONTACTS.df(spark), "id", "s").select("id", F.lit("person").alias("kind"), "start", "end", F.lit("high").alias("confidence"), F.lit(None).cast("string").alias("term"), "text")


ADDRESSES = Fixture(
    "id long, s string",
    tuple(
        enumerate(
            (
                "Visit 221 Baker Street, London NW1 6XE today", "at 1600 Harbour View Avenue, Springfield, IL 62704.", "Unit 5, 10 Marina Quay, Singapore 018983", "10 Downing Street", "2020 Park opened, 12 Long Road in 1999", "12 Long Road, built 1999, code 5043", "#12-34, 10 Marina Quay 018983",
                "a 27/F, 1 Queens Road 999077", "UG/F 1 Queens Road 999077", "Level 3 1 Queens Road 999077", "3rd Floor, 1 Queens Road, 999077", "12 Long\nRoad 12345", "12 Long Road\n12345", "12 Long Road 12345 and 9 Short Lane, Leeds LS1 4AB", "1 A B C D E Road 12345", "1 A B C D E F Road 12345",
                "12 long Road 12345", "12 Long Roads 12345", "1234567 Long Road 12345", "12a Long Rd. 12345-6789", "x12 Long Road 12345", "é12 Long Road 12345", "3 Ginza Street, Tokyo 123-4567", "24 Sussex Drive, Ottawa K1A0B1", "12 Long Road 1899", "12 Long Road 1900", "12 Long Road 2100", "12 Long Road 0123",
                "12 Long Road " + "x" * 180 + " 12345", "12 Long Road " + "x" * 181 + " 12345", "#A1-2, #12-34 , 12 Long Road 12345", "12 Long Road 123", "12 O'Neil-Smith St 12345, no 99999", "",
            ),
            1,
        )
    ),
)


@query(detect_sql.addresses(ADDRESSES.sql, "id", "s"))
def street_addresses(spark, sf_dir):
    return names.addresses(ADDRESSES.df(spark), "id", "s").select("id", F.lit("address").alias("kind"), "start", "end", F.lit("high").alias("confidence"), F.lit(None).cast("string").alias("term"), "text")
