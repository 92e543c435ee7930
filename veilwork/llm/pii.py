"""Surrogates for personal data, with DataFrame functions only.

Entities are found in every text and cut into units (an address's local part
and domain, the words of a name, the digits of a number). Each distinct unit
gets a replacement by a keyed hash that keeps its type: a name its gender and
script, a number its layout and check digits. Numbers go through a keyed
permutation of all numbers of their length. Replacements that two units would
share, or that stand for a real unit, are drawn again, so different units stay
different and equal ones equal in the whole corpus; where the real numbers of a
length are so many that nothing may be left, the permutation alone keeps them
apart."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import Workspace, small, unused

# Forms of address and first names by gender ("u": either).
TITLES = {
    "m": ("Mr", "Mr.", "MR", "MR.", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr.", "г-н", "господин"),
    "f": ("Mrs", "Mrs.", "MRS", "MRS.", "Ms", "Ms.", "MS.", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra.", "Señorita", "г-жа", "госпожа"),
    "u": ("Dr", "Dr.", "DR.", "Prof", "Prof.", "Professor", "Doctor"),
}
FIRST = {
    "m": (
        "James", "John", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Daniel", "Paul", "George", "Steven", "Andrew", "Kevin", "Brian", "Hans", "Jürgen", "Martin", "Andreas", "Stefan", "Klaus", "Wolfgang", "Pierre", "François",
        "Michel", "Carlos", "José", "Jose", "Juan", "Pablo", "Miguel", "Luis", "Mohammed", "Ahmed", "Ali", "Raj", "Amit", "Hiroshi", "Kenji", "Wei", "Иван", "Сергей", "Дмитрий", "Александр", "Алексей",
    ),
    "f": (
        "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Anna", "Karen", "Nancy", "Lisa", "Emma", "Olivia", "Sophie", "Julia", "Laura", "Petra", "Ursula", "Sabine", "Claudia", "Marie", "Françoise", "Camille",
        "María", "Maria", "Carmen", "Lucía", "Ana", "Isabel", "Sofía", "Fatima", "Aisha", "Priya", "Yuki", "Mei", "Анна", "Мария", "Ольга", "Елена", "Наталья",
    ),
}
# What comes before a name.
CONTEXT = ("name is ", "name: ", "Name: ", "signed by ", "Signed by ", "Signed, ", "Regards, ", "regards, ", "Sincerely, ", "Contact: ", "Attn: ", "From: ", "Patient: ", "Customer: ")
_B, _E = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_WORD = r"\p{Lu}[\p{L}'’-]+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(w.replace(".", r"\.") for w in sorted(words, key=len, reverse=True)) + ")"


_TITLE = _any(TITLES["m"] + TITLES["f"] + TITLES["u"])
# what comes first tells most places apart at once
_FIRST_LETTER = r"(?=[\p{Lu}г])"
_TITLED = rf"{_FIRST_LETTER}{_B}{_TITLE} {{1,2}}{_WORD}(?: {_WORD}){{0,2}}"
_NAMED = rf"{_FIRST_LETTER}{_B}{_any(FIRST['m'] + FIRST['f'])} {_WORD}(?: {_WORD})?{_E}"
_AFTER = rf"(?=\p{{Lu}})(?<={_any(CONTEXT)}){_WORD} {_WORD}(?: {_WORD})?{_E}"
#: Kinds of entity by precedence at one place. The patterns hold no group.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*(?<!\.)\.[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d+-])(?<!\d\.)\d(?:[ -]?\d){12,18}(?![\d-])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "person": f"(?:{_TITLED}|{_NAMED}|{_AFTER})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_SYLLABLES = {
    "latin": ("ba", "ber", "da", "del", "fa", "gor", "ha", "jo", "ka", "lin", "mar", "nel", "pa", "ros", "sa", "ven"),
    "cyrillic": ("ба", "бер", "да", "дел", "фа", "гор", "ха", "йо", "ка", "лин", "мар", "нел", "па", "рос", "са", "вен"),
}
_ENDINGS = {
    "latin": {"m": "o", "f": "a", "u": "is", "last": "son"},
    "cyrillic": {"m": "ан", "f": "а", "u": "ис", "last": "ин"},
}


def kind_of(raw: Column) -> Column:
    """The kind of a match, which stands alone here: what no other kind fits is
    a name."""
    return F.coalesce(*[F.when(raw.rlike(f"^(?:{p})$"), k) for k, p in PATTERNS.items() if k != "person"], F.lit("person"))


def digest(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """64 hex digits, by a keyed hash in two rounds."""
    inner = F.sha2(F.concat(F.lit(key), F.lit("\x00in"), kind, F.lit("\x00"), attempt.cast("string"), F.lit("\x00"), value).cast("binary"), 256)
    return F.sha2(F.concat(F.lit(key), F.lit("\x00out"), inner).cast("binary"), 256)


def _digits(h: Column) -> Column:
    """54 decimal digits."""
    return F.concat(*[F.right(F.lpad(F.conv(F.substring(h, 1 + 16 * i, 15), 16, 10), 18, "0"), F.lit(13)) for i in range(4)])


def luhn(digits: Column) -> Column:
    """Sum of a number's digits, every second one from the right doubled."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)),
    )
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def _name(h: Column, script: Column, role: Column, attempt: Column) -> Column:
    def pick(s: str) -> Column:
        table = F.array(*map(F.lit, _SYLLABLES[s]))
        n = F.when(role == "last", 5).otherwise(3) + attempt
        parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.get(table, F.conv(F.substring(h, i.cast("int"), F.lit(1)), 16, 10).cast("int")))
        return F.concat(F.array_join(parts, ""), F.coalesce(*[F.when(role == r, e) for r, e in _ENDINGS[s].items()]))

    return F.initcap(F.when(script == "cyrillic", pick("cyrillic")).otherwise(pick("latin")))


def _permuted(digits: Column, key: str, unit: Column, attempt: Column, back: bool = False) -> Column:
    """A keyed permutation of all digit strings of one length (a Feistel
    network over the two halves), or its inverse."""
    n = F.length(digits)
    h = F.floor(n / 2).cast("int")
    size = lambda k: F.concat(F.lit("1"), F.repeat(F.lit("0"), k)).cast("long")
    half = lambda c: F.concat(F.lit("0"), c).cast("long")
    sa, sb = size(h), size(n - h)

    def f(i: Column, x: Column) -> Column:
        return F.conv(F.substring(digest(key, F.concat(F.lit("permute "), unit, n.cast("string")), F.concat(i.cast("string"), F.lit(":"), x.cast("string")), attempt), 1, 15), 16, 10).cast("long")

    def step(acc: Column, i: Column) -> Column:
        a, b = acc["a"], acc["b"]
        sign = F.lit(-1 if back else 1)
        return F.struct(F.when(i % 2 == 0, F.pmod(a + sign * F.pmod(f(i, b), sa), sa)).otherwise(a).alias("a"), F.when(i % 2 == 1, F.pmod(b + sign * F.pmod(f(i, a), sb), sb)).otherwise(b).alias("b"))

    start = F.struct(half(F.substring(digits, F.lit(1), h)).alias("a"), half(F.substring(digits, h + 1, n)).alias("b"))
    show = lambda c, k: F.when(k == 0, "").otherwise(F.lpad(c.cast("string"), k, "0"))
    return F.aggregate(F.sequence(F.lit(3 if back else 0), F.lit(0 if back else 3)), start, step, lambda r: F.concat(show(r["a"], h), show(r["b"], n - h)))


def _next(x: Column) -> Column:
    """The digit string after this one; after all nines come zeros."""
    up = F.lpad((x.cast("decimal(38,0)") + 1).cast("decimal(38,0)").cast("string"), F.length(x), "0")
    return F.when(x.rlike("^9+$"), F.repeat(F.lit("0"), F.length(x))).otherwise(up)


def _once(**cols: Column) -> Column:
    """A generator's output is computed once; a projection's would be for each use."""
    return F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()])))


def _with_moved(todo: DataFrame, key: str, attempt: Column) -> DataFrame:
    """Column `moved`: the digits of a number that a permutation p moves (not
    the first, nor a card's last; of an IBAN those after its check) by p, or,
    where they are dense, by the inverse of p after a step of one, which leaves
    no number where it is."""
    value, unit = F.col("value"), F.col("unit")
    n = F.length(value)
    digits = (
        F.when(unit.isin("phone", "ssn"), F.substring(value, F.lit(2), n))
        .when(unit == "card", F.substring(value, F.lit(2), n - 2))
        .when(unit == "iban", F.regexp_replace(F.substring(value, F.lit(5), n), "[^0-9]", ""))
        .otherwise("")
    )
    x = todo.select(*todo.columns, _once(digits=digits))
    x = x.select(*todo.columns, _once(p=F.when(F.col("digits") == "", "").otherwise(_permuted(F.col("digits"), key, unit, attempt))))
    x = x.select(*todo.columns, "p", _once(after=F.when(F.col("dense") & (F.col("p") != ""), _next(F.col("p")))))
    return x.select(*todo.columns, _once(moved=F.when(F.col("after").isNull(), F.col("p")).otherwise(_permuted(F.col("after"), key, unit, attempt, back=True))))


def mod97(code: Column) -> Column:
    """An IBAN's remainder: 1 if its check digits are right."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: ((r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97).cast("int"))


def space(unit: Column, value: Column) -> tuple[Column, Column]:
    """Which numbers a number changes places with, and how many there are;
    null and infinite for other units."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    fixed = F.when(unit == "iban", F.translate(F.concat(F.substring(value, 1, 2), F.regexp_replace(F.substring(value, F.lit(5), F.length(value)), "[A-Z]", "a")), "123456789", "0" * 9)).otherwise(F.concat(F.length(value).cast("string"), (F.substring(value, 1, 1) == "0").cast("string")))
    name = F.when(unit.isin("phone", "ssn", "card", "iban"), F.concat(unit, F.lit(":"), fixed))
    # of an IBAN only the digits are counted
    return name, F.when(name.isNull(), float("inf")).otherwise(F.pow(F.lit(10.0), digits - F.when(unit == "iban", 2).when(unit == "card", 2).otherwise(1)))


def _plain(key: str, kind: Column, value: Column, h: Column, attempt: Column, moved: Column) -> Column:
    """The replacement of a unit's canonical value; moved: see _with_moved()."""
    hashed = lambda tag, x, m: F.pmod(F.conv(F.substring(digest(key, F.lit(tag), x, attempt), 1, 15), 16, 10).cast("long"), F.lit(m)).cast("int")

    # the first digit stays zero or not; it moves by a hash of the rest
    lead = F.substring(value, 1, 1)
    number = F.concat(F.when(lead == "0", "0").otherwise(((lead.cast("int") - 1 + hashed("lead", moved, 9)) % 9 + 1).cast("string")), moved)

    def card(v: Column) -> Column:
        check = lambda b: (10 - luhn(F.concat(b, F.lit("0"))) % 10) % 10
        old = F.substring(v, F.lit(1), F.length(v) - 1)
        return F.concat(number, ((check(number) + F.right(v, F.lit(1)).cast("int") - check(old) + 10) % 10).cast("string"))

    def iban(v: Column) -> Column:
        country, body = F.substring(v, 1, 2), F.substring(v, F.lit(5), F.length(v))
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        letter = lambda c, at: F.chr(F.lit(65) + (F.ascii(c) - 65 + hashed("letter", F.concat(moved, at.cast("string")), 26)) % 26)
        step = lambda acc, c: F.struct(F.concat(acc["out"], F.when(c.rlike("[0-9]"), F.substring(moved, acc["at"] + 1, F.lit(1))).otherwise(letter(c, F.length(acc["out"])))).alias("out"), (acc["at"] + c.rlike("[0-9]").cast("int")).alias("at"))
        right = lambda b: 98 - mod97(F.concat(country, F.lit("00"), b))
        # its check is as far from the right one as it was
        whole = lambda new: F.concat(country, F.lpad(((right(new) + F.substring(v, 3, 2).cast("int") - right(body) + 200) % 100).cast("string"), 2, "0"), new)
        return F.get(F.transform(F.array(F.aggregate(F.split(body, ""), start, step, lambda acc: acc["out"])), whole), F.lit(0))

    digits = _digits(h)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.conv(F.substring(h, (i * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int") % 254 + 1).cast("string")), ".")
    letters = F.translate(F.substring(h, 1, 12), "0123456789", "ghijklmnop")
    script = F.when(value.rlike(r"^\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    return (
        F.when(kind == "local", F.concat(letters, F.lit("."), F.left(digits, F.lit(2))))
        .when(kind == "domain", F.concat(F.left(letters, F.lit(9)), F.lit("."), F.regexp_extract(value, r"([^.]+)$", 1)))
        .when(kind == "ip", octets)
        .when(kind == "card", card(value))
        .when(kind == "iban", iban(value))
        .when(kind.isin("phone", "ssn"), number)
        .otherwise(_name(h, script, F.regexp_replace(kind, "^first_", ""), attempt))
    )


def _fill(layout: Column, value: Column, keep: Column) -> Column:
    """layout with its letters and digits, after the first `keep` of them,
    taken from value in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        mark = c.rlike("[A-Za-z0-9]")
        new = F.when(~mark, c).when(acc["at"] < keep, c).otherwise(F.substring(value, (acc["at"] - keep + 1).cast("int"), F.lit(1)))
        return F.struct(F.concat(acc["out"], new).alias("out"), (acc["at"] + mark.cast("int")).alias("at"))

    return F.aggregate(F.split(layout, ""), start, step, lambda acc: acc["out"])


def _units(raws: DataFrame) -> DataFrame:
    """(raw, kind, pos, unit, value): value is the canonical form."""
    kind, raw = F.col("kind"), F.col("raw")
    title = f"^{_TITLE} {{1,2}}"
    words = F.split(F.regexp_replace(raw, title, ""), " ")
    male, female = (raw.rlike("^" + _any(TITLES[g]) + " ") | raw.rlike("^" + _any(FIRST[g]) + " ") for g in ("m", "f"))
    gender = F.when(female, "f").when(male, "m").otherwise("u")
    unit = lambda k, v: F.struct(k.alias("unit"), v.alias("value"))
    people = F.transform(words, lambda w, i: unit(F.when(i == F.size(words) - 1, F.lit("last")).otherwise(F.concat(F.lit("first_"), gender)), F.lower(w)))
    mail = F.array(unit(F.lit("local"), F.lower(F.substring_index(raw, "@", 1))), unit(F.lit("domain"), F.lower(F.substring_index(raw, "@", -1))))
    code = F.regexp_extract(raw, r"^\+(\d{1,3}?)(?=[ .(-]|\d{10}$|\d{2})", 1)
    bare = F.regexp_replace(raw, "[^A-Za-z0-9]", "")
    number = F.when(kind == "phone", F.substring(bare, F.length(code) + 1, F.length(bare))).when(kind == "ip", raw).otherwise(bare)
    units = F.when(kind == "person", people).when(kind == "email", mail).otherwise(F.array(unit(kind, number)))
    keep = F.when(kind == "phone", F.length(code)).otherwise(0)
    return raws.select("raw", "kind", keep.alias("keep"), F.posexplode(units).alias("pos", "u")).select("raw", "kind", "keep", "pos", "u.unit", "u.value")


def surrogates(values: DataFrame, key: str, ws: Workspace) -> DataFrame:
    """(unit, value, new) for distinct rows (unit, value): no two values of a
    unit share a replacement. None is a value of the corpus, but for numbers of
    a length (and kind) of which more than a fourth occur: these change places
    by a permutation that leaves none where it is. The round in which another
    value is settled depends on the corpus; all else on the key. It ends: a
    number finds a free one in every other round at least, a name gets longer
    in each."""
    name, count = space(F.col("unit"), F.col("value"))
    values = ws.write(values.select("unit", "value", name.alias("space"), count.alias("count")))
    crowded = ws.write(values.where("space is not null").groupBy("space").agg(F.count("*").alias("n"), F.min("count").alias("count")).where("4 * n > count").select("space", F.lit(True).alias("dense")))
    todo = ws.write(values.join(small(ws, crowded), "space", "left").select("unit", "value", F.coalesce("dense", F.lit(False)).alias("dense")))
    everything, done, attempt = todo.select("unit", F.col("value").alias("low")), None, 0
    while True:
        h = digest(key, F.col("unit"), F.col("value"), F.lit(attempt))
        moved = _with_moved(todo, key, F.lit(attempt)).select("unit", "value", "dense", "moved", _once(h=h))
        drawn = ws.write(moved.select("unit", "value", "dense", _plain(key, F.col("unit"), F.col("value"), F.col("h"), F.lit(attempt), F.col("moved")).alias("new"), "h"))
        # of those that drew one replacement the first by hash keeps it
        best = drawn.where("not dense").groupBy("unit", F.lower("new").alias("low")).agg(F.min_by("value", "h").alias("value"))
        free = best.join(everything.withColumn("low", F.lower("low")), ["unit", "low"], "left_anti")
        if done is not None:
            free = free.join(done.select("unit", F.lower("new").alias("low")), ["unit", "low"], "left_anti")
        good = drawn.where("not dense").join(free.select("unit", "value"), ["unit", "value"], "left_semi").unionByName(drawn.where("dense"))
        good = ws.write(good.select("unit", "value", "new"))
        done = good if done is None else ws.write(done.union(good))
        todo = ws.write(todo.join(good, ["unit", "value"], "left_anti"))
        attempt += 1
        if todo.isEmpty():
            return done


def replacements(df: DataFrame, key: str, doc: str, text: str, ws: Workspace) -> DataFrame:
    """(doc, th, new): the documents that hold entities, with the replacement
    of each entity in order."""
    t = F.col(text).cast("string")
    docs = df.select(F.col(doc).alias("doc"), F.xxhash64(t).alias("th"), F.regexp_extract_all(t, F.lit(ANY), F.lit(0)).alias("raws"))
    found = ws.write(docs.where(F.size("raws") > 0))
    raws = ws.write(found.select(F.explode("raws").alias("raw")).distinct().withColumn("kind", kind_of(F.col("raw"))))
    units = ws.write(_units(raws))
    new = surrogates(units.select("unit", "value").distinct(), key, ws)
    with_new = units.join(new, ["unit", "value"]).groupBy("raw", "kind", "keep").agg(F.sort_array(F.collect_list(F.struct("pos", "new"))).alias("parts"))
    part = F.transform("parts", lambda p: p["new"])
    title = F.regexp_extract("raw", f"^({_TITLE} {{1,2}})", 1)
    built = (
        F.when(F.col("kind") == "email", F.concat(F.get(part, F.lit(0)), F.lit("@"), F.get(part, F.lit(1))))
        .when(F.col("kind") == "person", F.concat(title, F.array_join(part, " ")))
        .when(F.col("kind") == "ip", F.get(part, F.lit(0)))
        .otherwise(_fill(F.col("raw"), F.get(part, F.lit(0)), F.col("keep")))
    )
    table = ws.write(with_new.select("raw", built.alias("new")))
    # an entity that fills the corpus is one row of the table: AQE splits the other side
    each = found.select("doc", "th", F.posexplode("raws").alias("pos", "raw")).join(small(ws, table), "raw")
    each = each.groupBy("doc", "th", "pos").agg(F.first("new").alias("new"))  # repeated rows
    return ws.write(each.groupBy("doc", "th").agg(F.sort_array(F.collect_list(F.struct("pos", "new"))).alias("p")).select("doc", "th", F.transform("p", lambda p: p["new"]).alias("new")))


def replace_pii(df: DataFrame, key: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of df with entities in `text` replaced, and
    n_entities (long; a column of that name in df gives way). `key` is the
    secret of the replacements: who has it can tell whether a guessed value
    stands behind one. It is part of the plan, so event logs must be kept as
    safe as it is.

    A null text stays null, an empty one empty; a text of any length is
    searched whole. Rows that repeat id and text get the same text. Where two
    kinds of entity begin at one place, the first of PATTERNS holds. Entities
    are e-mail addresses, IBANs, phone numbers with a country code, SSNs, card
    and account numbers of 13 to 19 digits, IPv4 addresses, and names of two
    words or more after a form of address, with a listed first name, or after
    words as "name is". An empty table gives an empty one."""
    ws = Workspace(df.sparkSession, "pii")
    d, th, new = unused(df, "doc", "th", "new")
    made = small(ws, replacements(df, key, doc, text, ws)).withColumnsRenamed({"doc": d, "th": th, "new": new})
    t = F.col(text).cast("string")
    joined = df.join(made, F.col(doc).eqNullSafe(F.col(d)) & (F.xxhash64(t) == F.col(th)), "left")
    gaps = F.split(t, ANY, -1)
    out = F.array_join(F.zip_with(gaps, new, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    return joined.select(*[F.col(c) for c in df.columns if c not in (text, "n_entities")], F.when(F.col(new).isNull(), t).otherwise(out).alias(text), F.coalesce(F.size(new), F.lit(0)).cast("long").alias("n_entities"))


__all__ = ["PATTERNS", "replace_pii"]
