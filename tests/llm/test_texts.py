"""BPE, secrets, language ID and chat formatting against brute force."""

import hashlib
import math
import re
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from veilwork.llm import bpe, chat, langid, queries, secrets

DOCS = "doc_id long, text string, lang string, source string, ids string"
ODD = [(1, "plain words", "en", "a", "x"), (2, None, "en", "a", None), (3, "", None, None, "x"), (None, "no id 12", "en", "b", "x"), (5, "same", "en", "b", "x"), (5, "same", "en", "b", "x"), (6, "word " * 30_000, "en", "b", "x"), (7, "!!! 123 \n\t", "en", "b", "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


# ---- BPE ----

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Library.from_file(PATH)
OWN = bpe.Tokenizer(bpe.Vocabulary(bpe.read_spec(PATH)))


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def check_bpe(text):
    want = library_ids(text)
    got = OWN.encode(text)
    assert np.frombuffer(got, "<u4").tolist() == want
    assert OWN.decode(got) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8", max_codepoint=0x2FFF), max_size=60))
def test_bpe_like_library(text):
    check_bpe(text)


@settings(max_examples=600, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60))
def test_bpe_like_library_everywhere(text):
    check_bpe(text)


def test_bpe_marks_like_library():
    """Every mark that a normaliser may move or compose, after and before
    others, as the library's Unicode version has it."""
    import unicodedata

    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    text = " ".join(f"a\u0345{m} e{m}\u0301 {m}\u0334\u0345" for m in marks)
    pairs = [unicodedata.decomposition(chr(c)) for c in range(0x110000)]
    text += " " + " ".join("".join(chr(int(x, 16)) for x in d.split()) for d in pairs if d and d[0] != "<")
    check_bpe(text)


def test_bpe_merges_by_definition():
    """The backtracking encoder against merges applied one after the other."""
    v, rng = OWN.v, __import__("random").Random(12)
    tokens = [t for t in v.text_of if t]
    for _ in range(400):
        word = "".join(rng.choice(tokens) for _ in range(rng.randint(1, 4)))
        word = "".join(chr(ord(c) - 0x1000) if ord(c) >= 0x1000 else c for c in word)
        parts = [v.by_text[c] for c in word[:-1] + chr(ord(word[-1]) + 0x1000)]
        while True:
            best = min(((v.merged.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [best[0]]
        assert v.encode_word(word) == [v.id_of[r] for r in parts], word


def test_memory_of_words_is_bounded():
    from veilwork.llm.common import Memo

    memo = Memo(lambda w: b"x" * len(w), 100_000)
    for i in range(5000):
        assert memo[str(i)] == b"x" * len(str(i))
    assert memo.used <= 100_000 and 0 < len(memo) < 500 and len(memo.old) < 500
    assert memo["y" * 20_000] == b"x" * 20_000 and "y" * 20_000 not in memo


@settings(max_examples=300, deadline=None)
@given(st.text("abcdefghinorst'", max_size=40))
def test_bpe_letters_like_library(text):
    check_bpe(text)


def test_bpe_special_tokens():
    for text in ("a<|endoftext|>b", "<|startoftext|><|endoftext|>", "<|endoftext|", "It's WE'LL", "a\x1cb\x85c", "İ ẞ ΟΔΟΣ", ""):
        check_bpe(text)


def test_bpe_query(spark, sf, odd):
    rows = {r["doc_id"]: r for r in queries.op1_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs[:60]:
        ids = library_ids(d["text"])
        r = rows[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    out = bpe.encode_decode(odd, bpe.read_spec(PATH)).collect()
    assert len(out) == len(ODD)
    assert {r["n_tokens"] for r in out if r["doc_id"] in (2, 3)} == {0}
    assert bpe.encode_decode(odd.where("false"), bpe.read_spec(PATH)).count() == 0


# ---- secrets ----


def brute_secrets(text):
    found = []
    for kind, pattern in enumerate((r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", r"[0-9a-f]+")):
        for m in re.finditer(pattern, text or ""):
            if (len(m[2]) >= 6) if kind == 0 else (len(m[0]) >= (20, 24)[kind - 1]):
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_secrets_base(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op2_secrets(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        want = brute_secrets(docs[r["doc_id"]])
        text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        assert set(text.split(",")) - {""} <= set(r["spans"].split(","))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["password", "TOKEN", "api_key", "=", ": ", '"', "abcdef0123", "AKIA", "ABCDEFGH12345678", " ", "0123456789abcdef01234567", "x", "é"]), max_size=14))
def test_secrets_like_brute_force(parts):
    text = "".join(parts)
    assert [(s, k, e) for s, e, k, _ in secrets.candidates(text) if k < secrets.BASE] == brute_secrets(text)


def test_secret_ownership(spark):
    own, copied = "Zk29fJq81LmPq02XvB7t", "Qw83hGt52NxRy61TuC9s"
    rows = [(i, f"see {copied} here", f"owner{i}") for i in range(4)] + [(10, f"see {own} here", "solo"), (11, f"{own} twice {own}", "solo"), (12, "password=hunter2hunter2", None)]
    out = {r["doc_id"]: r for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[0]["spans"] == "" and out[10]["spans"] == "token:4:24"
    assert out[11]["n_live"] == 2 and out[12]["spans"] == "assign:0:23"
    s = out[11]["secrets"][0]
    assert (s["n_repos"], s["n_owners"], s["verdict"]) == (2, 1, "live")


def test_secrets_edges(spark, odd):
    out = secrets.scan_secrets(odd)
    assert out.count() == len(ODD)
    assert secrets.scan_secrets(odd.where("false")).count() == 0


# ---- language ID ----


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op6_langid(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = out.join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_spans_of_mixed_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    by = {r["lang"]: r["text"] for r in docs.where("length(text) > 800 and text not like '%@%'").collect()}
    mixed = by["en"][:400].rsplit(" ", 1)[0] + " " + by["fr"][:400].rsplit(" ", 1)[0]
    df = spark.createDataFrame([(1, mixed), (2, None), (3, "123 !!"), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert {s["lang"] for s in got[1]["spans"]} == {"en", "fr"}
    spans = got[1]["spans"]
    assert spans[0]["start"] == 0 and spans[-1]["end"] == len(mixed) and all(a["end"] == b["start"] for a, b in zip(spans, spans[1:]))
    assert abs(spans[-1]["start"] - mixed.rindex(by["fr"][:20])) < 60
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (2, 3, 4)] == [("und", 0.0)] * 3


def test_language_without_labels(spark, odd):
    none = langid.fit(odd.where("lang is null"))
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}
    assert langid.identify(odd.where("false"), none).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n, k = int(rng.integers(1, 7)), 3
        s = np.minimum(0, rng.normal(-3, 4, (n, k)))
        s -= s.max(axis=1, keepdims=True)
        cost = lambda p: sum(s[i, x] for i, x in enumerate(p)) - langid.SWITCH * sum(a != b for a, b in zip(p, p[1:]))
        best = max(product(range(k), repeat=n), key=cost)
        for f in (langid.viterbi, langid.label):
            assert math.isclose(cost(tuple(f(s, np.array([0]), np.array([n])))), cost(best))


# ---- chat ----


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool]", ""]), st.lists(st.sampled_from(["[INST]", "[/INST]", "</s>", "<s>", "\\", "[ROLE", "[\\/INST]", "<\\\\s>", " ", "\n", "é", "x"]), max_size=8).map("".join)), min_size=1, max_size=6))
def test_chat_round_trip(turns):
    text = "".join(chat.format_turn(r, t) for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.parse(text)] == turns


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool] ", "", "é"]), st.lists(st.sampled_from(["[INST]", " [/INST]\n", " </s>\n", "<s> ", "\\", "[ROLE x] ", " ", "\n", "x"]), max_size=6).map("".join)), min_size=1, max_size=5), st.lists(st.integers(0, 400), max_size=12))
def test_chat_stream_cut_anywhere(turns, cuts):
    """The reader finds the turns whatever pieces the conversation comes in."""
    text = "".join(chat.format_turn(r, t) for r, t in turns)
    cuts = sorted({0, len(text), *(c for c in cuts if c < len(text))})
    reader, spans = chat._Reader(), []
    for a, b in zip(cuts, cuts[1:]):
        spans += reader.feed(text[a:b])
    spans += reader.close()
    assert reader.n_turns == len(turns) and reader.formatted_chars == len(text)
    assert reader.turns.hexdigest() == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_chat_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    by = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in rows:
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    out = queries.op8_chat(spark, sf).collect()
    assert len(out) == len(by)
    for r in out:
        turns = by[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] > sum(len(t) for _, t in turns)


def test_chat_edges(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, None, None), (None, 0, "user", "x" * 200_000), (2, None, "tool", ""), (1, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2 and got[None]["n_turns"] == 1
    assert chat.read_back(chat.format_turns(df.where("false"))).count() == 0


