"""Fuzzy line deduplication, with DataFrame functions only.

Lines are normalised (lower case, runs of letters and digits with a blank between)
and get SimHash signatures in blocks. The features of a line are its words of LEAST
bytes or more, or, for short lines and those of uncommon words, all pieces of PIECE
bytes. Hash bits of a feature put it into one of 2^s classes, so many that a class
has a few features; block c of the signature is the SimHash of class c, with
the number and bytes of its features. An
edit changes the class of what it takes and that of what it brings, so of two lines
with few edits some blocks are equal (pigeonhole principle): lines that share a
block are candidates. Lines with few classes get several tables of other hash bits,
long ones the first BLOCKS classes only. Candidates whose SimHash as a whole differs
in few bits are verified: a pair is a link if its edit similarity is at least 0.8; of pairs that similar, few aren't candidates (the README
gives figures). Of every connected group the first occurrence stays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import Workspace, components, small, unused
from veilwork.llm.linkage import link, members_of

SIMILARITY = 0.8
#: Words among which the next two common words, and the next one, are looked for
#: before the distance.
AHEAD, NEXT = 64, 6
#: What is between two common words has a distance computed if the product of its
#: sides' lengths is at most this.
GAP = 1 << 14
#: Bytes of a feature: words have LEAST or more, pieces PIECE.
LEAST, PIECE = 4, 5
#: Lines of fewer bytes have pieces for features, those of the second number or more
#: words; in between they have both. Lines whose words have fewer bytes than the
#: third number on average, or more than the fourth, have pieces too.
SHORT, LONG, FEWEST, MOST = 128, 32, 3.5, 14.0
#: A line of L bytes has about L / 8.5 long words, and L pieces: 2^s classes of 2.5 to
#: 5 words or 3.6 to 7 pieces are as many as L over these numbers. Lines that are up to
#: 0.85 as long share a scale s.
OF, NEAR = (21.0, 3.6), 0.85
#: Lines from so many bytes on count as no longer than so many bytes for each
#: distinct word or piece.
REPEATS, OWN = 700, (8.0, 2.0)
#: By words, by pieces and by pieces of lines with uncommon words: blocks of a table
#: at most, tables of the first scales (the last number for all after), and the bytes
#: of features that a block needs.
BLOCKS, TABLES, FULL = (7, 10, 12), ((4, 2, 1), (12, 4, 2, 1), (12, 6, 4)), (20, 15, 15)
#: Lines of similarity 0.8 differ in some 13 of 63 bits of their SimHash, seldom in
#: more than these; unrelated ones in about 28.
FAR = 22
#: Bit counts are kept in SUMS numbers of seven lanes of 8 bits.
SUMS = 5
_BYTES = 0x0001010101010101
_TOPS = 0x0080808080808080


def documents(df: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, th (hash of the text) and text: repeated rows are one document."""
    t = F.col(text).cast("string")
    return df.select(F.col(doc).cast("long").alias("doc"), F.xxhash64(t).alias("th"), t.alias("text"))


def occurrences(docs: DataFrame) -> DataFrame:
    """One row per line with a letter or digit: doc, th, line, h (hash of the
    normalised line), norm."""
    norm = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\n]+", " ")
    lines = docs.select("doc", "th", F.posexplode(F.split(norm, "\n", -1)).alias("line", "raw"))
    lines = lines.select("doc", "th", "line", _once(norm=F.trim("raw"))).where("norm <> ''")
    return lines.select("doc", "th", "line", F.xxhash64("norm").alias("h"), "norm")


def _once(**cols: Column) -> Column:
    """A generator's output is computed once; a projection's would be for each use."""
    return F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()])))


def _simhash(n: Column) -> Column:
    """From lanes s0, s1, ... the bits set in more than half of n features, up
    to 127 of them; of more the bits are still the same for the same features.
    A lane and what it lacks to 128 from more than half of n make its top bit."""
    least = (F.lit(127) - F.floor(F.least(n, F.lit(127)) / 2)) * F.lit(_BYTES)
    each = [F.shiftrightunsigned((F.col(f"s{i}") + least).bitwiseAND(F.lit(_TOPS)), 7 - i) for i in range(SUMS)]
    return reduce(lambda a, b: a.bitwiseOR(b), each)


def _tables(kind: int) -> Column:
    """By 2 s + (1 if the scale before is taken too): codes 32 s + t of the
    tables t of the scales."""
    of = lambda s: [32 * s + t for t in range(TABLES[kind][min(s, len(TABLES[kind])) - 1])] if s else []
    return F.lit([of(s) + (of(s - 1) if more else []) for s in range(32) for more in (0, 1)])


def blocks(lines: DataFrame) -> DataFrame:
    """From distinct lines (h, norm) rows (node, key): the signature's blocks."""
    x = lines.select("h", "norm", F.octet_length("norm").alias("size"), _once(words=F.split("norm", " ")))
    mean = F.col("size") / F.size("words") - 1
    kinds = F.when(~mean.between(FEWEST, MOST), F.lit([2])).when(F.col("size") < LONG, F.lit([1])).when(F.col("size") < SHORT, F.lit([0, 1])).otherwise(F.lit([0]))
    x = x.select("h", "norm", "size", "words", F.explode(kinds).alias("kind"))
    is_word = F.col("kind") == 0
    padded = F.array(F.concat(F.lit(" "), "norm", F.lit(" ")).cast("binary"))
    pieces = F.flatten(F.transform(padded, lambda b: F.transform(F.sequence(F.lit(1), F.greatest(F.length(b) + 1 - PIECE, F.lit(1))), lambda i: F.substring(b, i, F.lit(PIECE)).cast("string"))))
    x = x.select("h", "kind", "size", _once(features=F.when(is_word, F.col("words")).otherwise(pieces)))
    # long lines whose features come again and again have fewer than their bytes tell
    own = F.size(F.array_distinct("features")) * F.when(is_word, OWN[0]).otherwise(OWN[1])
    x = x.select("h", "kind", "features", _once(size=F.when(F.col("size") >= REPEATS, F.least(F.col("size").cast("double"), own)).otherwise(F.col("size").cast("double"))))
    scale = lambda share: F.greatest(F.lit(1), F.floor(F.log2(F.col("size") * share / F.when(is_word, OF[0]).otherwise(OF[1]))).cast("int"))
    x = x.select("h", "kind", "features", _once(s=scale(1.0), low=scale(NEAR)))
    at = F.col("s") * 2 + (F.col("low") < F.col("s")).cast("int")
    x = x.select("h", "kind", "low", F.when(is_word, F.get(_tables(0), at)).when(F.col("kind") == 1, F.get(_tables(1), at)).otherwise(F.get(_tables(2), at)).alias("codes"), "features")
    x = x.select("h", "kind", "low", "codes", "features", F.posexplode("features").alias("at", "f")).withColumn("n", F.octet_length("f")).where(~is_word | (F.col("n") >= LEAST)).withColumn("x", F.xxhash64("f"))
    most = F.when(is_word, BLOCKS[0]).when(F.col("kind") == 1, BLOCKS[1]).otherwise(BLOCKS[2])
    # what has no block at the lower scale has none at the other; a feature counts once
    x = x.where((F.col("x").bitwiseAND(F.expr("shiftleft(1L, low) - 1")) < most) & (F.array_position("features", F.col("f")) == F.col("at") + 1))
    x = x.select("h", "kind", "n", "x", F.explode("codes").alias("code"))
    part = F.expr("shiftrightunsigned(x, (code & 31) * (code div 32)) & (shiftleft(1L, code div 32) - 1)")
    x = x.withColumn("class", part.cast("int")).where(F.col("class") < most)
    x = x.select("h", F.expr("(kind * 1024 + code) * 16 + class").alias("g"), "n", "x")
    lanes = [F.sum(F.shiftrightunsigned("x", i).bitwiseAND(F.lit(_BYTES))).alias(f"s{i}") for i in range(SUMS)]
    # the features' bytes and, above them, their number
    summed = x.groupBy("h", "g").agg(*lanes, F.sum(F.col("n") + F.lit(1 << 32)).alias("n"))
    full = F.when(F.col("g") >= 16 * 1024, FULL[1]).otherwise(FULL[0])
    summed = summed.where(F.col("n").bitwiseAND(F.lit((1 << 32) - 1)) >= full)
    return summed.select(F.col("h").alias("node"), F.xxhash64("g", "n", _simhash(F.shiftright("n", 32))).alias("key"))


def signs(texts: DataFrame) -> DataFrame:
    """(node, sign): of lines (node, n) a struct of bits, the SimHash as a whole
    (63 bits), and chars, their length. The SimHash is of the distinct words of
    LEAST bytes, or, for short lines and those of uncommon words, of pieces of
    three bytes, which the sign bit tells. Bits are null if there are more
    features than a lane can count; a line without any has no row."""
    x = texts.select("node", "n", F.length("n").alias("chars"), F.octet_length("n").alias("size"), _once(words=F.split("n", " ")))
    mean = F.col("size") / F.size("words") - 1
    is_word = (F.col("size") >= SHORT) & mean.between(FEWEST, MOST)
    padded = F.array(F.concat(F.lit(" "), "n", F.lit(" ")).cast("binary"))
    pieces = F.flatten(F.transform(padded, lambda b: F.transform(F.sequence(F.lit(1), F.greatest(F.length(b) - 2, F.lit(1))), lambda i: F.substring(b, i, F.lit(3)).cast("string"))))
    x = x.select("node", "chars", is_word.alias("w"), F.explode(F.array_distinct(F.when(is_word, F.col("words")).otherwise(pieces))).alias("f"))
    x = x.where(~F.col("w") | (F.octet_length("f") >= LEAST)).select("node", "chars", "w", F.xxhash64("f").alias("x"))
    lane, top = 0x000100010001, 0x800080008000
    sums = [F.sum(F.shiftrightunsigned("x", i).bitwiseAND(F.lit(lane))).alias(f"s{i}") for i in range(21)]
    summed = x.groupBy("node", "chars", "w").agg(*sums, F.count("*").alias("k"))
    least = (F.lit(32767) - F.floor(F.least("k", F.lit(32767)) / 2)) * F.lit(lane)
    # bits of the first sixteen sums have places of their own; the others go between lanes 48 and 63
    parts = [F.shiftrightunsigned((F.col(f"s{i}") + least).bitwiseAND(F.lit(top)), 15 - i) for i in range(16)]
    rest = [F.shiftright((F.col(f"s{i}") + least).bitwiseAND(F.lit(top)), 15 + 16 * j).bitwiseAND(F.lit(1)) * F.lit(1 << (48 + (i - 16) * 3 + j)) for i in range(16, 21) for j in range(3)]
    sign = reduce(lambda a, b: a.bitwiseOR(b), [*parts, *rest])
    bits = F.when(F.col("k") <= 32767, F.when(F.col("w"), sign).otherwise(sign.bitwiseOR(F.lit(-(1 << 63)))))
    return summed.select("node", F.struct(bits.alias("bits"), "chars").alias("sign"))


def _most(a: Column, b: Column, threshold: float) -> Column:
    """Of lines of so many characters the greatest distance that is similar."""
    return F.floor(F.greatest(a, b) * (1 - threshold) + 1e-9).cast("int")


def near_signs(a: Column, b: Column, threshold: float = SIMILARITY) -> Column:
    """Whether two lines can be similar: FAR bits at most differ, and their
    lengths by no more than a distance may be, which loses nothing. Nothing is
    known of a null, nor of bits of different features."""
    x = a["bits"].bitwiseXOR(b["bits"])
    alike = (x < 0) | (F.bit_count(x) <= FAR)
    as_long = F.abs(a["chars"] - b["chars"]) <= _most(a["chars"], b["chars"], threshold)
    return F.coalesce(alike, F.lit(True)) & F.coalesce(as_long, F.lit(True))


def _in_order(wa: Column, wb: Column) -> Column:
    """From above the distance of two lines, from their words: the words of one
    are looked for in the other one after the other; what lies between two that
    are found costs its distance, or its longer side if it is long. A word is
    found at its place if as many words were passed over on both sides, else
    with the word after it among the next AHEAD, else alone among the next NEXT.
    There a short word isn't found if more words are passed over than on its own
    side, as it may be another."""
    both = lambda w: F.transform(w, lambda v, i: F.concat(v, F.lit(" "), F.coalesce(F.get(w, i + 1), F.lit(""))))
    text = lambda w: F.array_join(F.transform(w, lambda v: F.concat(v, F.lit(" "))), "")
    between = lambda p, q: F.when(F.length(p) * F.length(q) <= GAP, F.levenshtein(p, q)).otherwise(F.greatest(F.length(p), F.length(q)))
    state = lambda at, words, gap, cost: F.struct(at.alias("at"), words.alias("words"), gap.alias("gap"), cost.alias("cost"))
    zero, none = F.lit(0), F.lit("")

    def step(s: Column, x: Column) -> Column:
        w, k = x["w"], x["k"]
        passed = F.when((k == 1) & (s["words"] == 0), 0).otherwise(between(s["gap"], text(F.slice(wb, s["at"] + 1, k - 1))))
        return F.when(k > 0, state(s["at"] + k, zero, none, s["cost"] + passed)).otherwise(state(s["at"], s["words"] + 1, F.concat(s["gap"], w, F.lit(" ")), s["cost"]))

    def next_(s: Column, x: Column, pairs: Column) -> Column:
        w = x["w"]
        place = F.when(F.get(wb, s["at"] + s["words"]) == w, s["words"] + 1)
        pair = F.nullif(F.array_position(F.slice(pairs, s["at"] + 1, F.lit(AHEAD)), x["pair"]), F.lit(0)).cast("int")
        alone = F.array_position(F.slice(wb, s["at"] + 1, F.when(F.length(w) >= LEAST, NEXT).otherwise(F.least(s["words"] + 1, F.lit(NEXT)))), w).cast("int")
        # what is used more than once is computed once
        return F.element_at(F.transform(F.array(F.struct(w.alias("w"), F.coalesce(place, pair, alone).alias("k"))), lambda v: step(s, v)), 1)

    rest = lambda s: s["cost"] + between(s["gap"], text(F.slice(wb, s["at"] + 1, F.greatest(F.size(wb) - s["at"], zero))))
    words = F.zip_with(wa, both(wa), lambda w, p: F.struct(w.alias("w"), p.alias("pair")))
    found = F.transform(F.array(both(wb)), lambda pairs: F.aggregate(words, state(zero, zero, none, zero), lambda s, x: next_(s, x, pairs), rest))
    return F.element_at(found, 1)


def similar(pairs: DataFrame, threshold: float) -> DataFrame:
    """Of rows (a, b, na, nb: the normalised lines) the pairs (a, b) whose edit
    similarity reaches the threshold. What both lines begin or end with doesn't
    count for the distance. Words that differ place by place bound it from
    above, and so does what lies between common words that are met in one
    order; where that doesn't settle a pair, it is computed."""

    def common(x: Column, y: Column) -> Column:
        at = F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), False)
        return F.when(at == 0, F.greatest(F.size(x), F.size(y))).otherwise(at - 1).cast("int")

    most = _most(F.length("na"), F.length("nb"), threshold)
    x = pairs.select("a", "b", most.alias("most"), _once(wa=F.split("na", " "), wb=F.split("nb", " ")))
    x = x.select("a", "b", "most", "wa", "wb", _once(head=common(F.col("wa"), F.col("wb")), tail=common(F.reverse("wa"), F.reverse("wb"))))
    x = x.withColumn("tail", F.least("tail", F.least(F.size("wa"), F.size("wb")) - F.col("head")))
    middle = lambda w: F.slice(w, F.col("head") + 1, F.greatest(F.size(w) - F.col("head") - F.col("tail"), F.lit(0)))
    x = x.select("a", "b", "most", _once(wa=middle(F.col("wa")), wb=middle(F.col("wb"))))
    # every word with a blank after it: then what goes are whole pieces
    text = lambda w: F.array_join(F.transform(w, lambda v: F.concat(v, F.lit(" "))), "")
    by_place = F.aggregate(F.zip_with("wa", "wb", lambda p, q: F.when(p == q, 0).otherwise(F.greatest(F.length(p), F.length(q)))), F.lit(0), lambda s, v: s + v)
    above = F.when((F.size("wa") == F.size("wb")) & (by_place <= F.col("most")), by_place).otherwise(_in_order(F.col("wa"), F.col("wb")))
    x = x.select("a", "b", "most", _once(ma=text(F.col("wa")), mb=text(F.col("wb")), above=above))
    return x.where("above <= most or (abs(length(ma) - length(mb)) <= most and (greatest(length(ma), length(mb)) <= most or levenshtein(ma, mb, most) >= 0))").select("a", "b")


def removed_lines(df: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = SIMILARITY, ws: Workspace | None = None) -> DataFrame:
    """doc, th, removed: numbers (from 0) of the lines to remove, for
    documents that have such lines."""
    ws = ws or Workspace(df.sparkSession, "lines")
    docs = documents(df, doc, text)
    occ = ws.write(occurrences(docs), compression="zstd")
    lines = occ.groupBy("h").agg(F.min("norm").alias("norm"))
    keys = ws.write(blocks(lines))
    ws.tidy()
    members = members_of(keys, ws)
    ws.drop(keys)
    ws.tidy()
    wanted = ws.write(members.select(F.col("node").alias("h")).distinct())
    texts = ws.write(occ.join(small(ws, wanted), "h", "left_semi").groupBy(F.col("h").alias("node")).agg(F.min("norm").alias("n")))

    every, occ = occ, ws.write(occ.select("doc", "th", "line", "h"))
    ws.drop(every)

    def verify(todo: DataFrame) -> DataFrame:
        a, b = texts.select(F.col("node").alias("a"), F.col("n").alias("na")), texts.select(F.col("node").alias("b"), F.col("n").alias("nb"))
        return similar(todo.join(a, "a").join(b, "b"), threshold).distinct()

    signed = ws.write(members.join(ws.write(signs(texts)), "node", "left").select("key", "node", "sign"))
    comp = ws.write(components(link(signed, verify, ws, lambda a, b: near_signs(a, b, threshold)), ws))
    again = occ.groupBy(F.col("h").alias("node")).agg(F.count("*").alias("n")).where("n > 1").select("node")
    classes = ws.write(again.join(comp, "node", "full_outer").select(F.col("node").alias("h"), F.coalesce("root", "node").alias("root")))
    of_class = ws.write(occ.join(small(ws, classes), "h").select("root", "doc", "th", "line"))
    order = F.struct(F.col("doc").isNull().alias("no"), "doc", "line", "th")
    kept = ws.write(of_class.groupBy("root").agg(F.min(order).alias("first")))
    rest = of_class.join(small(ws, kept), "root").where(order != F.col("first"))
    return ws.write(rest.groupBy("doc", "th").agg(F.sort_array(F.collect_set("line")).alias("removed")))


def dedup_lines(df: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """All rows and columns of df, text without the removed lines, and
    n_lines, n_removed (long; columns of these names in df give way).

    A group's first occurrence is that with the least id, then line (a null
    id comes last). Lines without a letter or digit stay. Lines of any length
    are compared whole: the edit distance of two long lines that are alike
    takes time by the square of what differs. A null text
    stays null and has no lines; an empty one has one. Rows that repeat id and
    text are one document: they lose the same lines. Equal lines are known by
    their 64-bit hash. An empty table gives an empty one."""
    ws = Workspace(df.sparkSession, "lines")
    d, th, removed = unused(df, "doc", "th", "removed")
    out = small(ws, removed_lines(df, doc, text, threshold, ws)).withColumnsRenamed({"doc": d, "th": th, "removed": removed})
    t = F.col(text).cast("string")
    same = F.col(doc).cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(t) == F.col(th))
    left = F.filter(F.split(t, "\n", -1), lambda x, i: ~F.array_contains(removed, i))
    new = F.when(F.col(removed).isNull(), t).otherwise(F.array_join(left, "\n"))
    n_lines = F.octet_length(t) - F.octet_length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    kept = [F.col(c) for c in df.columns if c not in (text, "n_lines", "n_removed")]
    return df.join(out, same, "left").select(*kept, new.alias(text), F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(removed), F.lit(0)).cast("long").alias("n_removed"))
