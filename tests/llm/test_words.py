"""Words that a weak hash would confuse, and hashes that are made to collide."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomspark.llm import exact_dedup, hashed, jaccard, packing

from .test_jaccard import kept_by_hand


def thue_morse(n, letters="ab"):
    """The word of length n and its complement: equal in any polynomial hash modulo a power of two once n is large."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


def words_to_confuse():
    rnd = random.Random(1)
    out = [w for n in (32, 64, 128, 1024, 2048, 4096) for w in thue_morse(n)] + [f"x{i}" for i in range(300)]
    return out + ["".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 90))) for _ in range(300)]


def test_keys_of_different_words_differ():
    words = sorted(set(words_to_confuse()))
    x = np.frombuffer("  ".join(words).encode(), np.uint8)
    keys = hashed.WordKeys(2).keys(x, *hashed.word_edges(x))
    assert all(len(set(k.tolist())) == len(words) for k in keys) and not set(keys[0].tolist()) & set(keys[1].tolist())
    y = np.frombuffer(("\n".join(reversed(words)) + "\t").encode(), np.uint8)  # a word's key is its own, wherever it stands
    assert hashed.WordKeys().keys(y, *hashed.word_edges(y))[0].tolist() == keys[0].tolist()[::-1]
    assert [len(k) for k in hashed.WordKeys(2).keys(x[:0], *hashed.word_edges(x[:0]))] == [0, 0]


@pytest.mark.parametrize("bits", [64, 5])
def test_ids_are_the_tokenizers_own_even_if_keys_collide(bits):
    path = packing.default_tokenizer()
    tok, memo = Tokenizer.from_file(path), packing.Tokens(path, key_bits=bits)
    words = words_to_confuse()
    texts = words[:12] + [" ".join(words[k::7]) for k in range(7)] + [""] + words[:4]
    for _ in range(2):
        for text, ids in zip(texts, memo.encode_all(texts), strict=True):
            assert np.frombuffer(ids, memo.dtype).tolist() == [*tok.encode(text, add_special_tokens=False).ids, packing.END_ID]


def test_unlike_texts_of_such_words_both_stay(spark):
    rows = [(k, w + " end") for k, w in enumerate(thue_morse(1024))] + [(9, None), (10, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.without_near_copies(df).collect()) == [0, 1, 9]


def stay(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_exact_stage_goes_by_id_and_text(spark):
    schema = "doc_id long, text string, _proof string, _rows int"
    df = spark.createDataFrame([(i, t, "p", 1) for i, t in [(1, "alpha"), (1, "beta"), (0, "beta"), (None, "gamma"), (None, "alpha"), (1, "alpha"), (None, "gamma"), (1, "al  pha"), (1, "al pha")]], schema)
    out = exact_dedup.keep_first_copies(spark, df, "")
    assert out.columns == df.columns
    got = [(i, " ".join(t.split())) for i, t in stay(out)]
    assert got == [(0, "beta"), (1, "al pha"), (1, "alpha"), (None, "gamma")]


def test_near_stage_with_null_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text + " one"), (None, text + " two"), (3, "other words stand here alone"), (3, "other words stand here alone"), (4, "x y"), (4, text.upper() + " p q r s t u v w x y z a b c d e f g")]
    out = stay(jaccard.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out == sorted([(3, rows[2][1])] * 2 + [(4, "x y"), (4, rows[5][1]), out[-1]], key=repr) and out[-1] in rows[:2]


def test_texts_of_one_hash_stay(spark, monkeypatch):
    """With a hash that all texts share, only equal ones go."""
    from pyspark.sql import functions as F

    rows = [(k, f"text number {k // 2}") for k in range(8)]
    monkeypatch.setattr(jaccard, "node", lambda text: F.lit(7).cast("long"))
    got = stay(jaccard.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == [(k, f"text number {k // 2}") for k in range(0, 8, 2)]


def test_comparing_all_loses_no_link(spark):
    rnd = random.Random(6)
    word = lambda: f"w{rnd.randrange(3000)}"
    base, rows = [word() for _ in range(120)], []
    for _ in range(150):
        own = list(base)
        for _ in range(rnd.randrange(3)):
            own[rnd.randrange(120)] = word()
        rows.append((len(rows), " ".join(own)))
    got = [r.doc_id for r in jaccard.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == kept_by_hand(rows)
