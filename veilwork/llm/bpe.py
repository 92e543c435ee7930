"""BPE encoding by backtracking over longest token matches, and decoding by an
offset table.

A word is a string of symbols; its last symbol carries the end-of-word mark.
At each place an Aho-Corasick automaton over the vocabulary tells the longest
token that starts there. A token may follow the one before it only if the pair
is compatible: if merging would leave the border between the two as it is. If
no shorter token fits either, the last token is taken back; a place that has
failed once is not tried again, so the work is linear in the word. The result
is that of applying the merges in their order.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.llm.common import Memo, ship, trim, unused

#: Bytes of words, and of chunks of text, that a worker remembers, in each of two
#: generations.
CACHE = 36 << 20


#: After every merge.
NEVER = 1 << 60


def byte_symbols() -> str:
    """The printable character that stands for each byte: itself if printable
    in Latin-1, else the next unused one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b) if b in own else chr(spare))
        spare += b not in own
    return "".join(out)


class Vocabulary:
    """The tables of one tokenizer file (kind: BPE with an end-of-word mark,
    byte symbols, lower case), from its JSON text."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        assert model["type"] == "BPE" and not spec["decoder"] and not spec["post_processor"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids = model["vocab"]
        size = max([*self.ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.names = [""] * size
        for name, i in self.ids.items():
            self.names[i] = name
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for name, i in self.added.items():
            self.names[i] = name
        # ranks: symbols first, then tokens in the order of their merges
        self.rank_of, self.id_of, self.parts = {}, [], []
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {a + b for a, b in merges}
        for name, i in self.ids.items():
            if name not in made and name not in self.added:
                self._add(name, i, None)
        self.merged = {}
        for a, b in merges:
            pair = (self.rank_of[a], self.rank_of[b])
            self.merged[pair] = self._add(a + b, self.ids[a + b], pair)
        # a token's text as symbols; the last one of a word is shifted up
        self.text_of = [self._symbols(self.names[i]) for i in self.id_of]
        self.lengths = [len(t) for t in self.text_of]
        self.by_text = {t: r for r, t in enumerate(self.text_of)}
        self.automaton = ahocorasick.Automaton()
        for t, r in self.by_text.items():
            # reversed: the automaton reports matches by their end, and a
            # reversed text makes the end of a match the start of its token
            self.automaton.add_word(t[::-1], r)
        self.automaton.make_automaton()
        self.shorter = [self._shorter(t) for t in self.text_of]
        # what a token grows through at its end and at its beginning; parts come first
        self.ends, self.begins = [], []
        for r, (a, b) in enumerate(self.parts):
            self.ends.append((r, NEVER) if a == r else (*self.ends[b][:-1], r, NEVER))
            self.begins.append((r, NEVER) if a == r else (*self.begins[a][:-1], r, NEVER))
        # decoding: every token followed by a blank, one after the other
        blob = [n.encode() + b" " for n in self.names]
        self.sizes = np.array([len(b) for b in blob], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(blob), dtype=np.uint8)

    def _add(self, name: str, i: int, pair) -> int:
        self.rank_of[name] = r = len(self.id_of)
        self.id_of.append(i)
        self.parts.append(pair or (r, r))
        return r

    def _symbols(self, name: str) -> str:
        if self.end and name.endswith(self.end):
            body = name[: -len(self.end)]
            return body[:-1] + chr(ord(body[-1]) + 0x1000)
        return name

    def _shorter(self, text: str) -> int:
        """The longest token that is a proper prefix; -1 if there is none."""
        for n in range(len(text) - 1, 0, -1):
            if (r := self.by_text.get(text[:n])) is not None:
                return r
        return -1

    def compatible(self, a: int, b: int) -> bool:
        """Whether the border between tokens a and b stays when the merges are
        applied to both texts in their order. Next to the border, a grows
        through the tokens that end it and b through those that begin it, each
        when its number comes; the border goes if the pair that stands there
        has a merge whose turn is before both. Of one number the left is first."""
        left, right, i, j = self.ends[a], self.begins[b], 1, 1
        x, y, grow_left, grow_right = left[0], right[0], left[1], right[1]
        turn = self.merged.get
        while True:
            border = turn((x, y))
            if border is not None and border < grow_left and border <= grow_right:
                return False
            if grow_left <= grow_right:
                if grow_left == NEVER:
                    return True
                x, i = grow_left, i + 1
                grow_left = left[i]
            else:
                y, j = grow_right, j + 1
                grow_right = right[j]

    def longest(self, word: str) -> list[int]:
        """For each place of the word, the longest token that starts there."""
        n, out = len(word), [-1] * len(word)
        for end, r in self.automaton.iter(word[::-1]):
            at = n - 1 - end
            if out[at] < 0 or self.lengths[r] > self.lengths[out[at]]:
                out[at] = r
        return out

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of byte symbols, without its end-of-word mark."""
        if self.end:
            word = word[:-1] + chr(ord(word[-1]) + 0x1000)
        whole = self.by_text.get(word)
        if whole is not None and self.parts[whole][0] == whole:
            return [self.id_of[whole]]
        n = len(word)
        longest, lengths, shorter = self.longest(word), self.lengths, self.shorter
        dead, out, at, token = set(), [], 0, None
        while at < n:
            if token is None:
                token = longest[at]
            end = at + lengths[token]
            if end not in dead and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at, token = end, None
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead.add(at)
                token = out.pop()
                at -= lengths[token]
        return [self.id_of[r] for r in out]

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' strings joined by blanks, as UTF-8."""
        if not len(ids):
            return b""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        step = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        step += np.arange(ends[-1])
        return self.blob[step[:-1]].tobytes()


# Letters of the regex module's Unicode version that are no
# letters to the tokenizers library (Unicode 16), and code points whose lower
# case is newer than Python's own.
NEWER = (
    "\u0558 \u058b-\u058c \u088f \u0c5c \u0cdc \u208f \u209d-\u209f \ua7ce-\ua7cf \ua7d2 \ua7d4 \ua7dd \ua7e2 \ua7f1 \uab6c-\uab6d "
    "\U000107bb-\U000107bf \U00010940-\U00010959 \U00010ec5-\U00010ec7 \U00010ed9-\U00010eee \U00011b0a "
    "\U00011db0-\U00011ddb \U00011df1 \U00016ea0-\U00016eb8 \U00016ebb-\U00016ed3 \U00016ff2-\U00016ff3 "
    "\U000187f8-\U000187ff \U00018cd6-\U00018cda \U00018d09-\U00018d20 \U00018d80-\U00018df2 \U00018e00-\U00019191 "
    "\U000191a0-\U000191d2 \U0001b123-\U0001b128 \U0001b168 \U0001d6a6 \U0001df1f-\U0001df24 \U0001df2b-\U0001df81 "
    "\U0001df90-\U0001df96 \U0001dfcd-\U0001dfff \U0001e6c0-\U0001e6de \U0001e6e0-\U0001e6e2 \U0001e6e4-\U0001e6e5 "
    "\U0001e6e7-\U0001e6ed \U0001e6f0-\U0001e6f4 \U0001e6fe-\U0001e6ff \U0002b73a-\U0002b73f \U0002b81e "
    "\U00011de0-\U00011de9 \U0001246f \U00012475-\U0001247f \U00012550-\U00012686 \U00016ff4-\U00016ff6 "
    "\U0002cea2-\U0002cead \U000323b0-\U00033479 \U0003d000-\U0003fc3f"
).replace(" ", "")
# Marks that the tokenizers library's NFC doesn't know: it neither
# reorders nor composes them.
UNKNOWN_MARKS = (
    "\u07fd \u0898-\u089f \u08ca-\u08d3 \u09fe \u0c3c \u0d3b-\u0d3c \u0eba \u1715 \u1abf-\u1ace \u1df6-\u1dfa \ua82c \U00010d24-\U00010d27 "
    "\U00010eab-\U00010eac \U00010efd-\U00010eff \U00010f46-\U00010f50 \U00010f82-\U00010f85 \U00011070 \U0001133b \U0001145e "
    "\U00011839-\U0001183a \U00011930 \U0001193d-\U0001193e \U00011943 \U000119e0 \U00011a34 \U00011a47 \U00011a99 \U00011d42 "
    "\U00011d44-\U00011d45 \U00011d97 \U00011f41-\U00011f42 \U00016ff0-\U00016ff1 \U0001e08f \U0001e130-\U0001e136 \U0001e2ae "
    "\U0001e2ec-\U0001e2ef \U0001e4ec-\U0001e4ef"
).replace(" ", "")
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


class Tokenizer:
    """Encodes whole texts; remembers chunks between white space and words."""

    # the normalizer's white space; str.split() also takes U+001C to U+001F
    SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
    WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    RARE = regex.compile(f"[{NEWER}{''.join(map(chr, LOWER))}]")
    RARE_WORD = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{NEWER}]]+|[\p{{N}}--[{NEWER}]]|(?:[^\s\p{{L}}\p{{N}}]|[{NEWER}])+")
    ODD = regex.compile("[\x1c-\x1f]")
    UNKNOWN = regex.compile(f"([{UNKNOWN_MARKS}])")

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.symbols = byte_symbols()
        self.added = regex.compile("|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True))) or "(?!)")
        self.words = Memo(self._word, CACHE)
        self.chunks = Memo(self._chunk, CACHE)

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() or not self.RARE.search(chunk):
            words = self.WORD.findall(chunk)
        else:
            words = self.RARE_WORD.findall(chunk.translate(LOWER))
        return b"".join(map(self.words.__getitem__, words))

    def _word(self, word: str) -> bytes:
        s = self.symbols
        return np.array(self.v.encode_word("".join([s[b] for b in word.encode()])), dtype="<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        if not unicodedata.is_normalized("NFC", text):
            # marks unknown to the library stand between what is normalised
            text = "".join([unicodedata.normalize("NFC", p) for p in self.UNKNOWN.split(text)])
        # per character: the final-sigma rule of str.lower() isn't wanted
        text = text.lower() if "Σ" not in text else text.replace("Σ", "σ").lower()
        parts = self.SPACE.split(text) if self.ODD.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, parts))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if "<|" not in text or not self.added.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.added.finditer(text):
            out.append(self._plain(text[at : m.start()]))
            out.append(np.array([self.v.added[m.group()]], dtype="<u4").tobytes())
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        return self.v.decode(np.frombuffer(ids, dtype="<u4")).decode()


SCHEMA = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("decoded", T.StringType()),
    ]
)
_LOADED: dict[int, Tokenizer] = {}
#: Bytes of text that are encoded at once: their ids, the decoded text and the
#: strings and arrays of both take some ten times as many.
AT_ONCE = 1 << 20


def rest() -> None:
    """Before other operators use this worker: its tokenizers forget what they
    remember, but stay."""
    for tok in _LOADED.values():
        tok.words.forget()
        tok.chunks.forget()
    trim()


def encode_decode(df: DataFrame, spec: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode and decode column `text` with the tokenizer whose JSON is `spec`
    (read by the caller; it goes to the workers by broadcast, its size is that
    of one vocabulary file). Returns the columns of `keep`, n_tokens, ids
    (binary, little-endian unsigned 32-bit) and decoded (tokens joined by a
    blank, as a tokenizer without decoder gives).

    Null and empty texts give no ids and an empty decoded text. Special tokens
    inside a text are their own ids. Repeated rows give repeated rows; other
    columns are dropped; an empty table gives an empty table."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(spec)
    key = hash(spec)
    kept = [F.col(c) for c in keep]
    schema = T.StructType([df.schema[c] for c in keep] + SCHEMA.fields)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _LOADED:
            _LOADED[key] = Tokenizer(Vocabulary(shared.value))
        tok = _LOADED[key]
        trim()
        for batch in batches:
            # slices: ids and decoded text are larger than the text
            for part in slices(batch, n, AT_ONCE):
                ids = [tok.encode(t) for t in part.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:n],
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array([tok.decode(x) for x in ids], pa.string()),
                    ],
                    names=schema.names,
                )

    return df.select(*kept, F.col(text).cast("string").alias(unused(df, "text")[0])).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, text: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts (column number `text`) have some `limit`
    bytes together, or one row with more."""
    lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def read_spec(path: str) -> str:
    """A vocabulary file's text, read on the driver."""
    with open(path, encoding="utf-8") as f:
        return f.read()


__all__ = ["Tokenizer", "Vocabulary", "encode_decode", "read_spec", "slices"]
