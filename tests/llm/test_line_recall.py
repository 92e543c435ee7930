"""Line dedup against all pairs by edit similarity alone."""

import random

from pyspark.sql import functions as F

from veilwork.llm import linededup, linkage

RNG = random.Random(21)
WORDS = ["".join(RNG.choice("bcdfglmnprst") + RNG.choice("aeiou") for _ in range(RNG.randint(1, 4))) for _ in range(2000)]


def removed(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return {r["doc_id"] for r in linededup.dedup_lines(df).collect() if r["n_removed"]}


def test_changed_words(spark):
    # one changed word in so many: edit similarity 0.8 or more, in 2 to 71 % of
    # cases a candidate of two equal SimHash blocks
    lines, copies = [], set()
    for n in (8, 10, 20, 30, 50, 100):
        for _ in range(20):
            own = [RNG.choice(WORDS) for _ in range(n)]
            other = list(own)
            at = RNG.randrange(n)
            other[at] = RNG.choice([w for w in WORDS if len(w) == len(own[at]) and w != own[at]])
            if len(own[at]) <= 0.2 * len(" ".join(own)):
                copies.add(len(lines) + 1)
            lines += [" ".join(own), " ".join(other)]
    got = removed(spark, lines)
    assert got <= copies and len(got) >= 0.98 * len(copies)


def test_changed_letters(spark):
    # no word stays whole: a letter in each is another
    lines = []
    for _ in range(40):
        own = ["".join(RNG.choice(WORDS) for _ in range(4)) for _ in range(12)]
        lines += [" ".join(own), " ".join(w[:i] + "x" + w[i + 1 :] for w in own for i in [RNG.randrange(len(w))])]
    got = removed(spark, lines)
    assert got <= set(range(1, 80, 2)) and len(got) >= 36


def test_like_all_pairs(spark):
    rng = random.Random(9)
    base = [[rng.choice(WORDS) for _ in range(40)] for _ in range(4)]
    lines = []
    for _ in range(32):
        own = list(rng.choice(base))
        for i in rng.sample(range(40), rng.randint(0, 2)):
            own[i] = rng.choice(WORDS)
        lines.append(" ".join(own))
    lines += [" ".join(rng.choice(WORDS) for _ in range(30)) for _ in range(16)]

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            last = row
        return last[-1]

    root = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if root[i] != root[j] and distance(lines[i], lines[j]) <= 0.2 * max(len(lines[i]), len(lines[j])):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert removed(spark, lines) == {i for i, r in enumerate(root) if r != i}


def test_short_lines(spark):
    # exact copies by the normalised line, near copies by letters; without spaces too
    long = "東京都千代田区丸の内一丁目九番一号鉄鋼ビルディング"
    lines = ["Ietzte.", "ietzte", "---", "---", long, long, long.replace("九", "八"), "one two", "", "One, two!", "12", "13"]
    assert removed(spark, lines) == {1, 5, 6, 9}


def test_pairs_of_a_common_passage(spark, monkeypatch):
    # lines around one passage share blocks, but few are similar: pairs whose lengths
    # rule it out aren't verified, the others once, in however many rounds
    rng = random.Random(5)
    passage = [rng.choice(WORDS) for _ in range(25)]
    own = lambda n: [rng.choice(WORDS) for _ in range(n)]
    lines = [" ".join(own(n % 9) + passage + own(n % 23)) for n in range(90)]
    lines += [" ".join(line.split()[:-1] + own(1)) for line in lines[::6]]
    seen, real = [], linededup.similar

    def similar(pairs, threshold):
        seen.extend(pairs.select("a", "b", F.length("na"), F.length("nb")).collect())
        return real(pairs, threshold)

    monkeypatch.setattr(linededup, "similar", similar)
    least = removed(spark, lines)
    monkeypatch.setattr(linkage, "REST", 0)
    monkeypatch.setattr(linkage, "FEW", 0)
    once, seen[:] = list(seen), []
    assert removed(spark, lines) == least and least >= set(range(90, 105))
    for pairs in (once, seen):
        assert pairs and len({(a, b) for a, b, _, _ in pairs}) == len(pairs)
        assert all(abs(x - y) <= int(0.2 * max(x, y) + 1e-9) for _, _, x, y in pairs)


def test_bound_of_common_words(spark):
    # words change places, go, come twice or are others: what lies between common
    # words is never under the distance, and settles most pairs that are similar
    rng = random.Random(13)
    rows = []
    for n in range(120):
        own = [rng.choice(WORDS) for _ in range(rng.choice((12, 40, 120)))]
        other = list(own)
        for _ in range(1 + len(own) // 20):
            i = rng.randrange(len(other) - 1)
            other[i : i + 2] = rng.choice(([other[i + 1], other[i]], [other[i]], [other[i], other[i], other[i + 1]], [rng.choice(WORDS), other[i + 1]]))
        rows.append((n, " ".join(own), " ".join(other)))
    rows += [(-1, "", "a b"), (-2, "a b", "b a"), (-3, "a a a", "a"), (-4, "x", "y z")]
    df = spark.createDataFrame(rows, "n long, a string, b string")
    most = linededup._most(F.length("a"), F.length("b"), 0.8)
    got = df.select("n", F.levenshtein("a", "b").alias("exact"), most.alias("most"), linededup._in_order(F.split("a", " "), F.split("b", " ")).alias("above")).collect()
    assert all(r["exact"] <= r["above"] for r in got)
    alike = [r for r in got if r["n"] >= 0 and r["exact"] <= r["most"]]
    assert len(alike) > 100 and sum(r["above"] <= r["most"] for r in alike) >= 0.95 * len(alike)
