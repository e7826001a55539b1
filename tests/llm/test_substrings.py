import hashlib
import random
from collections import Counter

from loomspark.llm import substring_dedup

from .odd import odd, texts


def by_hand(rows, length=400):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    out = Counter()
    for d, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    return out


def run(spark, df, monkeypatch):
    monkeypatch.setattr(substring_dedup, "table", lambda *a: df)
    return Counter(tuple(r) for r in substring_dedup.op5_substring_dedup(spark, "").collect())


def test_shared_pieces_of_two_letter_texts(spark, monkeypatch):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("ab") for _ in range(1500)) for _ in range(3)]
    piece = lambda: rnd.choice(base)[rnd.randrange(900) :][: rnd.randrange(800)]
    rows = [(i, piece() + "".join(rnd.choice("xyz ") for _ in range(rnd.randrange(300))) + piece()) for i in range(60)]
    rows += [(100, "a" * 3000), (103, "ab" * 900), (104, "é" * 500), (105, "a" * 399), (106, "q" * 400), (107, "q" * 400), (109, "w" * 401)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(spark, df, monkeypatch) == by_hand(rows)


def test_odd_documents(spark, monkeypatch):
    df = odd(spark).where("length(text) < 10000 OR text IS NULL")
    assert run(spark, df, monkeypatch) == by_hand(texts(df))
    assert run(spark, df.limit(0), monkeypatch) == Counter()


def test_equal_strings_choose_the_same_place():
    rnd = random.Random(9)
    core = bytes(rnd.choice(b"abcd ") for _ in range(400))
    places = set()
    for _ in range(40):
        before = bytes(rnd.choice(b"abcd ") for _ in range(rnd.randrange(700)))
        at, _, first, last = substring_dedup.samples(before + core + bytes(rnd.choice(b"abcd ") for _ in range(rnd.randrange(700))))
        k = next(k for k in range(len(at)) if first[k] <= len(before) <= last[k])
        places.add(int(at[k]) - len(before))
    assert len(places) == 1


def test_runs_across_the_edge_of_a_piece_are_one(monkeypatch):
    rnd = random.Random(11)
    data = bytes(rnd.choice(b"abcd ") for _ in range(6000))
    whole = [c.tolist() for c in substring_dedup.samples(data)]
    monkeypatch.setattr(substring_dedup, "_PIECE", 500)
    assert [c.tolist() for c in substring_dedup.samples(data)] == whole


def test_long_documents_keep_their_unique_text(spark, monkeypatch):
    rnd = random.Random(12)  # two documents over a piece long; workers have the module's own piece
    long = ["".join(rnd.choices("abcd ", k=substring_dedup._PIECE + 3000)) for _ in range(2)]
    at = substring_dedup._PIECE - 200
    rows = [(1, long[0]), (2, long[1]), (3, "xyz" + long[0][at : at + 900]), (4, long[1][:500])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(spark, df, monkeypatch) == by_hand(rows)
