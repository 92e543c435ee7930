"""Language of documents, with spans of mixed-language text.

Per word, script ranges narrow the candidate languages and hashed letter
trigrams score them; a Viterbi path over the words, with a penalty for each
switch, labels the spans. The model is fitted on a sample of labelled rows
that is bounded by TRAIN_ROWS."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.llm.bpe import rest, slices
from veilwork.llm.common import ship, trim, unused

#: The model is fitted on about so many labelled rows at most, drawn by a hash of their id.
TRAIN_ROWS = 10_000
#: Trigrams are hashed to so many buckets: 2 to this power.
BITS = 16
#: What a change of language costs, in nats, and the most that one word can count.
SWITCH, CLIP = 8.0, 6.0
#: Share of a language's letters that a script must have to be one of its scripts.
SCRIPT_SHARE = 0.005
#: Words that a worker remembers.
CACHE = 200_000

# Code point ranges of scripts.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF), (0xFB1D, 0xFB4F))),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("gurmukhi", ((0xA00, 0xA7F),)),
    ("gujarati", ((0xA80, 0xAFF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("telugu", ((0xC00, 0xC7F),)),
    ("kannada", ((0xC80, 0xCFF),)),
    ("malayalam", ((0xD00, 0xD7F),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF), (0x1C90, 0x1CBF))),
    ("ethiopic", ((0x1200, 0x139F),)),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))),
)
_TABLE: list[np.ndarray] = []


def script_table() -> np.ndarray:
    """Per code point 0 (no letter), a script's number from 1, or one more
    than the last (letter of another script)."""
    if not _TABLE:
        script = np.full(0x110000, len(SCRIPTS) + 1, dtype=np.uint8)
        for n, (_, ranges) in enumerate(SCRIPTS, 1):
            for a, b in ranges:
                script[a : b + 1] = n
        letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), dtype=bool, count=0x110000)
        _TABLE.append(np.where(letter, script, 0).astype(np.uint8))
    return _TABLE[0]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every letter of the words: the word's number, the bucket of the
    trigram around it, its script. A non-letter is a border."""
    text = ("\n" + "\n".join(words) + "\n").lower()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    script = script_table()[codes]
    c = np.where(script > 0, codes, 0).astype(np.uint64)
    at = np.flatnonzero(script)
    h = c[at - 1] * np.uint64(0x9E3779B97F4A7C15) + c[at] * np.uint64(0xC2B2AE3D27D4EB4F) + c[at + 1] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.cumsum(codes == 10)[at] - 1, (h >> np.uint64(64 - BITS)).astype(np.int64), script[at]


class Model:
    """Log-likelihood of each bucket (rows) in each language (columns), and
    what a script takes away from languages not written in it."""

    def __init__(self, langs: list[str], scores: np.ndarray, scripts: np.ndarray):
        self.langs, self.scores, self.scripts = langs, scores, scripts

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per word: scores of the languages (best 0, least -CLIP), letters."""
        n, many = len(words), len(self.langs)
        word, bucket, script = trigrams(words)
        letters = np.bincount(word, minlength=n)
        out = np.zeros((n, many))
        for j in range(many):
            out[:, j] = np.bincount(word, weights=self.scores[bucket, j], minlength=n)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] += self.scripts[script[first]]
        out -= out.max(axis=1, keepdims=True)
        return np.maximum(out, -CLIP), letters


def is_training(doc: Column) -> Column:
    """Rows that a model may learn from; the others are held out."""
    return F.pmod(F.crc32(doc.cast("string")), F.lit(5)) != 0


def fit(df: DataFrame, text: str = "text", lang: str = "lang", doc: str = "doc_id", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most about `train_rows` rows with text and language whose id
    isn't held out (a null id counts as held out)."""
    ship(df.sparkSession)
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & is_training(F.col(doc)))
    there = rows.count()
    parts = 1 << 20
    share = parts if there <= train_rows else int(parts * train_rows / there)
    rows = rows.where(F.pmod(F.xxhash64(F.col(doc).cast("string")), F.lit(parts)) < share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest()
        sums = defaultdict(lambda: (np.zeros(1 << BITS, np.int64), np.zeros(len(SCRIPTS) + 2, np.int64)))
        for batch in batches:
            for part in slices(batch, 1):
                by = defaultdict(list)
                for name, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    by[name] += t.split()
                for name, words in by.items():
                    _, bucket, script = trigrams(words)
                    grams, scripts = sums[name]
                    grams += np.bincount(bucket, minlength=len(grams))
                    scripts += np.bincount(script, minlength=len(scripts))
        for name, (grams, scripts) in sums.items():
            for base, counts in ((0, grams), (1 << BITS, scripts)):
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at + base), pa.array(counts[at])], names=["lang", "at", "n"])

    got = rows.select(F.col(lang).cast("string").alias("l"), F.col(text).alias("t")).mapInArrow(count, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toArrow()
    names, at, n = got["lang"].to_pylist(), got["at"].to_numpy(), got["n"].to_numpy()
    langs = sorted(set(names))
    col = np.array([langs.index(x) for x in names], dtype=np.int64)
    counts, scripts = np.zeros((1 << BITS, len(langs))), np.zeros((len(SCRIPTS) + 2, len(langs)))
    grams = at < 1 << BITS
    counts[at[grams], col[grams]] = n[grams]
    scripts[at[~grams] - (1 << BITS), col[~grams]] = n[~grams]
    scores = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(counts))) if langs else counts
    written = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    # a script of no language tells nothing
    return Model(langs, scores, np.where(written | ~written.any(axis=1, keepdims=True), 0.0, -1e3))


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Labels of the best path through each sequence, all sequences a step at
    a time; among equals the one that stays, then the first language."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    labels, back = np.zeros(len(scores), np.int64), np.zeros(scores.shape, np.uint8)
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")
    own = np.arange(scores.shape[1], dtype=np.uint8)
    delta = np.zeros((len(lengths), scores.shape[1]))
    for t in range(longest):
        k = active[t]
        d = delta[:k]
        if t:
            best = d.argmax(axis=1)
            jump = d[np.arange(k), best] - SWITCH
            moved = jump[:, None] > d
            back[starts[:k] + t] = np.where(moved, best[:, None], own)
            d = np.where(moved, jump[:, None], d)
        delta[:k] = d + scores[starts[:k] + t]
    state = delta.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        at = starts[: active[t]] + t
        labels[at] = state[: active[t]]
        if t:
            state[: active[t]] = back[at, state[: active[t]]]
    return labels


def label(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """As viterbi(), but sequences whose best path can't leave their best
    language are labelled at once: there no stretch of words gains more from
    other languages than one switch costs."""
    labels = np.zeros(len(scores), np.int64)
    if not len(scores):
        return labels
    full = np.flatnonzero(lengths)
    total = np.add.reduceat(scores, starts[full], axis=0)
    best = total.argmax(axis=1)
    labels[:] = np.repeat(best, lengths[full])
    gain = -scores[np.arange(len(scores)), labels]  # the best language of each word has 0
    number = np.repeat(np.arange(len(full)), lengths[full])
    # a drop before each sequence starts its running minimum anew
    drop = float(gain.sum()) + 1.0
    run = np.cumsum(gain) - number * drop
    low = np.minimum.accumulate(run - gain)
    rise = np.maximum.reduceat(run - low, starts[full])
    mixed = full[rise > SWITCH]
    if len(mixed):
        part = np.concatenate([np.arange(starts[i], starts[i] + lengths[i]) for i in mixed])
        own = np.concatenate([[0], np.cumsum(lengths[mixed])[:-1]])
        labels[part] = viterbi(scores[part], own, lengths[mixed])
    return labels


class Predictor:
    """Scores of words, remembered, and documents' spans."""

    WORD = re.compile(r"\S+")

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self):
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.langs)))
        self.letters = np.zeros(0, np.int64)

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, list[dict]]]:
        if not self.model.langs:
            return [("und", 0.0, [])] * len(texts)
        if len(self.known) > CACHE:
            self._reset()
        words = [t.split() if t else [] for t in texts]
        flat = [w for ws in words for w in ws]
        new = [w for w in dict.fromkeys(flat) if w not in self.known]
        if new:
            scores, letters = self.model.words(new)
            self.known.update(zip(new, range(len(self.letters), len(self.letters) + len(new))))
            self.scores, self.letters = np.concatenate([self.scores, scores]), np.concatenate([self.letters, letters])
        rows = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(lengths) - lengths
        labels, letters, many = label(self.scores[rows], starts, lengths), self.letters[rows], len(self.model.langs)
        doc = np.repeat(np.arange(len(words)), lengths)
        by = np.bincount(doc * many + labels, weights=letters, minlength=len(words) * many).reshape(-1, many)
        turn = np.flatnonzero((np.diff(labels) != 0) & (np.diff(doc) == 0)) + 1
        turned = defaultdict(list)
        for i in turn.tolist():
            turned[int(doc[i])].append(i - int(starts[doc[i]]))
        out = []
        for i, text in enumerate(texts):
            total = by[i].sum()
            if not total:
                out.append(("und", 0.0, []))
                continue
            best = int(by[i].argmax())
            name = lambda k: self.model.langs[labels[starts[i] + k]]  # noqa: B023, E731
            cuts = [0]
            if i in turned:
                begins = [m.start() for m in self.WORD.finditer(text)]
                cuts += [begins[k] for k in turned[i]]
            langs = [name(k) for k in (0, *turned.get(i, ()))]
            out.append((self.model.langs[best], float(by[i][best] / total), [{"start": a, "end": b, "lang": x} for a, b, x in zip(cuts, [*cuts[1:], len(text)], langs)]))
        return out


SPANS = "array<struct<start:long,end:long,lang:string>>"


def identify(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, lang_pred (a learned language; `und` for null
    texts and those without a letter), score (share of the letters that the
    path gives to lang_pred; 0 for `und`) and spans (start, end, lang in code
    points, gapless). Among equal shares the first language by name. Without
    any labelled row all is `und`. Repeated rows give repeated rows.

    The model goes by broadcast: 2^BITS rows of one double per language."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([df.schema[c] for c in keep] + T._parse_datatype_string(f"lang_pred string, score double, spans {SPANS}").fields)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest()
        predict = Predictor(shared.value)
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        for batch in batches:
            for part in slices(batch, n, 2 << 20):
                got = predict(part.column(n).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:n], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], spans)],
                    names=schema.names,
                )
        del predict
        trim()

    return df.select(*keep, F.col(text).cast("string").alias(unused(df, "text")[0])).mapInArrow(run, schema)
