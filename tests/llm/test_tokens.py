import zlib
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomspark.llm import hashed, packing
from loomspark.llm import sentencepiece_dropout as sp

from .odd import odd, texts

ODD_TEXTS = [
    "", "a", " ", "  x  y ", "\n\n a\n", "😀 é", "ab " * 10, "It's the 'STUFF' you'll  Ünïcode É́ x́", "<|endoftext|> <|ENDOFTEXT|>", "Σίσυφος ΑΣ İstanbul 123abc!!! don't''s", "a\x1cb c d \x85e",
    "ſ K Å ǅ 漢字かな ȩ́", "½²ª º ×÷ ¡\xad¿", "AA'S 'LL a<|b", "x" * 3000, "***the$$$ a%%%b c,,.",
]


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_memo_gives_the_tokenizer_s_own_ids(text):
    own = packing._load(packing.default_tokenizer())
    assert np.frombuffer(own.encode(text), own.dtype).tolist() == own.tok.encode(text, add_special_tokens=False).ids + [1]


def test_a_small_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_BITS", 7)
    monkeypatch.setattr(packing, "CHUNK", 40)
    own = packing.Tokens(packing.default_tokenizer())
    for text in ODD_TEXTS * 2 + [" ".join(f"w{i}" for i in range(90))]:
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == own.tok.encode(text, add_special_tokens=False).ids + [1]


def test_the_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_BITS", 12)
    monkeypatch.setattr(packing, "CHUNK", 2000)
    own = packing.Tokens(packing.default_tokenizer())
    for k in range(100):
        own.encode_all([" ".join(f"word{k}x{i}" for i in range(100)) + " " + "y" * 500] * 3)
        assert own.map.held <= 1 << 11 and own.ids.n <= 1 << 12


def test_texts_are_encoded_alike_one_by_one_and_together(monkeypatch):
    own, some = packing.Tokens(packing.default_tokenizer()), ODD_TEXTS * 3
    want = [own.tok.encode(t, add_special_tokens=False).ids + [1] for t in some]
    for chunk in (1 << 20, 30):
        monkeypatch.setattr(packing, "CHUNK", chunk)
        assert [np.frombuffer(x, own.dtype).tolist() for x in packing.Tokens(packing.default_tokenizer()).encode_all(some)] == want


def test_word_keys_do_not_depend_on_the_piece():
    text = b"some words, and some\tmore \x0b" * 30 + b"x" * 500 + b" end"
    words = text.split()
    far = b"y z\n" * 40_000 + text  # words are taken some 64 KB at a time

    def keys(data):
        x = np.frombuffer(data, np.uint8)
        return hashed.WordKeys().keys(x, *hashed.word_edges(x))[0]

    for data in (text, far):
        own, got = data.split(), keys(data).tolist()
        assert len(got) == len(own) and len(set(got)) == len(set(own)) == len(set(zip(own, got, strict=True)))
    assert len(keys(b"")) == 0
    assert (keys(far)[-len(words) :] == keys(text)).all() and (keys(text[:600])[:-1] == keys(text)[: len(text[:600].split()) - 1]).all()


def test_map_and_runs_against_a_dict():
    rnd, m, want = np.random.default_rng(1), hashed.Map(10), {}
    for lo in range(0, 500, 50):
        keys = rnd.integers(0, 1 << 63, 50).astype(np.uint64) >> np.uint64(9 * (lo % 3)) if lo else np.arange(50, dtype=np.uint64)
        keys = np.array([k for k in np.unique(np.maximum(keys, np.uint64(1))).tolist() if k not in want], np.uint64)
        m.add(keys, np.arange(len(want), len(want) + len(keys)))
        want.update(zip(keys.tolist(), range(len(want), len(want) + len(keys))))
        ask = np.concatenate([np.array(list(want), np.uint64), rnd.integers(0, 1 << 63, 50).astype(np.uint64)])
        assert m.find(ask).tolist() == [want.get(k, -1) for k in ask.tolist()]
    runs = hashed.Runs(np.dtype("<u2"))
    lists = [rnd.integers(0, 9, rnd.integers(0, 4)) for _ in range(40_000)]
    assert runs.add(np.concatenate(lists), np.array([len(x) for x in lists])) == 0
    some = rnd.integers(0, 40_000, 1000)
    data, stops = runs.joined(some)
    assert data.tolist() == [y for k in some for y in lists[k].tolist()] and stops[-1] == len(data)


def test_every_simple_letter_as_the_tokenizer_has_it():
    own = packing.Tokens(packing.default_tokenizer())
    letters = [chr(c) for c in range(0x21, 0x250)]
    for c in letters:
        if packing._SIMPLE.fullmatch(c.encode()):
            assert packing._SIMPLE.fullmatch(c.lower().encode())
    for text in (" ".join(letters), " ".join(f"a{c}b" for c in letters), "".join(letters)):
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == own.tok.encode(text, add_special_tokens=False).ids + [1]


def test_merges_of_invented_words_as_the_tokenizer_has_them():
    own, rnd = packing.Tokens(packing.default_tokenizer()), np.random.default_rng(3)
    pools = ["abcdefghijklmnopqrstuvwxyz", "aeio", "éèaêçñí", "!?.*#$%&-=_", "a", "=", "thingoner'"]
    words = ["".join(rnd.choice(list(pools[k % len(pools)]), rnd.integers(1, 40))) for k in range(20_000)]
    text = " ".join(words)
    assert own.merges is not None
    assert np.frombuffer(own.encode(text), own.dtype).tolist() == own.tok.encode(text, add_special_tokens=False).ids + [1]
    own.merges = None
    own.forget()
    assert np.frombuffer(own.encode(text[:20_000]), own.dtype).tolist() == own.tok.encode(text[:20_000], add_special_tokens=False).ids + [1]


def test_packing_puts_every_id_in_one_piece(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 9)
    df = odd(spark, [(50 + k, "lorem ipsum dolor " * (40 * k)) for k in range(12)])
    got = packing.pack(df).collect()
    tok, want, windows = Tokenizer.from_file(packing.default_tokenizer()), defaultdict(int), defaultdict(list)
    for i, t in texts(df):
        want[i, zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes())] += 1
    whole = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
        whole[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= packing.WINDOW
    assert sum(sum(n for _, n in p) < packing.WINDOW for p in windows.values()) <= 4  # the last of each shard
    for i, t in texts(df):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for start, n, crc, total in whole[i]:
            assert total in {len(tok.encode(u or "", add_special_tokens=False).ids) + 1 for j, u in texts(df) if j == i}
            if total == len(ids) and sum(j == i for j, _ in texts(df)) == 1:
                assert crc == zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())
        assert sum(n for _, n, _, _ in whole[i]) == sum(len(tok.encode(u or "", add_special_tokens=False).ids) + 1 for j, u in texts(df) if j == i)
    assert packing.pack(df.limit(0)).count() == 0


def test_bm25_finds_the_like_document():
    rnd = np.random.default_rng(1)
    pieces = [rnd.integers(0, 500, 300) for _ in range(30)]
    pieces[20] = np.concatenate([pieces[3][:200], rnd.integers(0, 500, 100)])
    df = np.bincount(np.concatenate([np.unique(p) for p in pieces]), minlength=500)
    score = packing.Index(pieces, df, 100).scores(3)
    score[3] = 0
    assert score.argmax() == 20
    # by the formula, term by term
    mean, want = np.mean([len(p) for p in pieces]), 0.0
    for t in np.unique(pieces[3]):
        tf = int((pieces[20] == t).sum())
        idf = max(0.0, np.log((100 - df[t] + 0.5) / (df[t] + 0.5)))
        want += idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(pieces[20]) / mean))
    assert abs(score[20] - want) < 1e-9


def test_documents_are_dealt_by_their_rarest_shared_token(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = packing.default_tokenizer()
    tokens, kind = packing.token_table(docs, path), packing._dtype(path)
    df = packing.term_statistics(tokens, kind, packing._load(path).tok.get_vocab_size())
    order = np.argsort(packing.rarity(df))
    rows = packing.keyed(tokens, kind, df).collect()
    assert len(rows) == docs.count()
    for r in rows:
        own = np.unique(np.frombuffer(r.ids, kind))
        shared = own[df[own] > 1]
        assert df[order[r.key]] == (df[shared].min() if len(shared) else 1)


MODEL = sp.default_model()


@pytest.mark.parametrize("text", ODD_TEXTS + ["a▁b", "x▁ ▁", " a▁"])
def test_without_dropout_as_the_library_and_always_lossless(text):
    v = sp._load(MODEL)
    plain = np.frombuffer(v.encode(text, 0.0, 1, 0), "<i4").tolist()
    if "▁" not in text and "" not in text:
        assert plain == sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text)
    for p, seed in ((0.0, 1), (0.3, 1), (0.3, 2), (1.0, 1)):
        assert v.decode(np.frombuffer(v.encode(text, p, seed, 0), "<i4").tolist()) == text


def test_dropout_varies_by_seed_and_repeats_by_key():
    v, text = sp._load(MODEL), "international understanding of considerable misrepresentation " * 3
    one, two = v.encode(text, 0.3, 1, 0), v.encode(text, 0.3, 2, 0)
    assert one != two != v.encode(text, 0.0, 2, 0) and one == sp.Vocabulary(MODEL).encode(text, 0.3, 1, 0)
    assert len(v.encode(text, 1.0, 1, 0)) > len(one) > len(v.encode(text, 0.0, 1, 0))


def test_round_trip_of_odd_documents(spark):
    df = odd(spark)
    back = sp.decode(sp.encode(df))
    assert set(df.columns) <= set(back.columns) and back.where("NOT text <=> decoded").count() == 0 and back.count() == df.count()
    assert back.where("text IS NULL AND ids IS NOT NULL").count() == 0
    assert sp.decode(sp.encode(df.limit(0))).count() == 0


def test_equal_words_of_one_text_are_cut_in_many_ways(spark):
    v, n = sp._load(MODEL), 200
    text = " ".join(["international"] * n)
    ids = np.frombuffer(v.encode(text, 0.1, 1, 5), "<i4").tolist()
    words = "".join(f"|{i}" if v.decoded[i][:1] == b" " else f",{i}" for i in ids).split("|")[1:]
    assert len(words) == n and len(set(words)) > 8 and v.decode(ids) == text
    df = spark.createDataFrame([(k, text) for k in range(20)], "doc_id long, text string")
    assert len({tuple(r.ids) for r in sp.encode(df).collect()}) == 20


def by_agenda(v, word, gaps):
    """One word by the plain rule: of all adjacent pairs that make a piece and aren't skipped, the best and leftmost comes up."""
    symbols, skipped, gap, since = [(i, i + 1) for i in range(len(word))], set(), next(gaps, -1), 0
    while True:
        pairs = [(v.rank[word[a:c]], a, b, c) for (a, b), (_, c) in zip(symbols, symbols[1:], strict=False) if word[a:c] in v.rank and (a, b, c) not in skipped]
        if not pairs:
            break
        _, a, b, c = min(pairs)
        if since == gap:
            skipped.add((a, b, c))
            gap, since = next(gaps, -1), 0
            continue
        symbols = [x for x in symbols if x not in ((a, b), (b, c))] + [(a, c)]
        symbols.sort()
        since += 1
    out = []
    for a, b in symbols:
        out += [v.ids[word[a:b]]] if word[a:b] in v.ids else [v.byte[x] for x in word[a:b].encode("utf-8", "surrogatepass")]
    return out


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_dropout_against_a_plain_agenda(spark, dropout, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(25).collect()
    texts = [r.text[:3000] for r in docs] + [t for t in ODD_TEXTS if "x" * 100 not in t] + ["international " * 50 + "a" * 45 + " " + "ab" * 60]
    v = sp.Vocabulary(MODEL)
    for words, bits in ((sp._WORDS, sp.MEMO_BITS), (40, 7)):  # the memo decides about work alone
        monkeypatch.setattr(sp, "_WORDS", words)
        monkeypatch.setattr(sp, "MEMO_BITS", bits)
        v.forget()
        got = v.encode_all(texts, list(range(len(texts))), dropout, 9)
        for k, text in enumerate(texts):
            want = []
            if text:
                for place, word in enumerate(w for ws in v._words(text) for w in ws):
                    own = sp._occurrence(np.array([k], np.uint64), np.array([place], np.uint64), 9)
                    want += v.segment(word, iter(()))[0] if word.strip(sp._LITERAL) == "" else by_agenda(v, word, sp._each_gap(own, dropout))
            assert np.frombuffer(got[k], "<i4").tolist() == want, (k, text[:50])


def test_candidates_are_skipped_at_the_rate_of_dropout():
    own = sp._occurrence(np.arange(200_000, dtype=np.uint64), np.zeros(200_000, np.uint64), 1)
    gap = sp._gaps(own, 0, 0.1, 63)
    assert abs((gap == 0).mean() - 0.1) < 0.003 and abs((gap[gap > 0] == 1).mean() - 0.1) < 0.003
    assert abs((sp._gaps(own[gap == 0], 1, 0.1, 63) == 0).mean() - 0.1) < 0.01


def test_long_texts_are_cut_between_words(monkeypatch):
    v, text = sp._load(MODEL), "some words  of   a text " * 40 + "x" * 300 + "   end "
    whole = v.encode(text, 0.2, 1, 3)
    monkeypatch.setattr(sp, "_CHUNK", 7)
    assert v.encode(text, 0.2, 1, 3) == whole
