"""What Python workers keep between operators."""

import inspect
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame

from veilwork.llm import bpe, langid, neardup


def test_tokenizers_forget_words_for_other_operators():
    tok = bpe.Tokenizer(bpe.Vocabulary(bpe.read_spec(public_tokenizers.path("word_bpe_49k.json"))))
    bpe._LOADED[-1] = tok
    try:
        ids = tok.encode("some words, and others")
        assert tok.words and tok.chunks
        bpe.rest()
        assert not tok.words and not tok.chunks and not tok.words.old and not tok.chunks.used
        assert tok.encode("some words, and others") == ids
    finally:
        del bpe._LOADED[-1]
    for operator in (langid.fit, langid.identify, neardup.idf_table, neardup.near_duplicates):
        assert "rest()" in inspect.getsource(operator)


def test_document_frequencies_without_rdd_workers(spark, monkeypatch):
    """Workers of RDDs are processes besides those of DataFrames."""
    texts = ["a b c d e f", "a b c d e f", "x", None, "", "g h i j k l m n"] * 7
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    monkeypatch.setattr(DataFrame, "rdd", property(lambda self: 1 / 0))
    got = neardup.idf_table(df, "text")
    n = Counter(b for t in texts for b in neardup.bucket(neardup.shingles([t])[1]).tolist())
    want = np.zeros(1 << neardup.DF_BITS, np.int64)
    want[list(n)] = list(n.values())
    assert np.array_equal(got, neardup.idf_of(want, len(texts)))
    assert len(neardup.idf_table(df.where("false"), "text")) == 1 << neardup.DF_BITS
