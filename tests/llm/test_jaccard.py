import random
import re

import numpy as np
from pyspark.sql import functions as F

from loomspark.llm import jaccard, simhash

from .odd import odd, texts


def shingles_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept_by_hand(rows):
    sets, at = [shingles_by_hand(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                at[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted((d for i, (d, _) in enumerate(rows) if d == least[find(i)]), key=repr)


def test_stage_keeps_what_brute_force_keeps(spark, monkeypatch):
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(3000)}"
    rows, line = [], " ".join(word() for _ in range(30))
    for g in range(25):  # chains of copies with some words changed, near the bound and on both sides of it
        words = [word() for _ in range(rnd.choice([6, 12, 40, 150, 400]))]
        for _ in range(7):
            rows.append((len(rows), " ".join(words) + (f" {line}" if g % 3 == 0 else "")))
            for _ in range(rnd.randrange(1, 2 + len(words) // 40)):
                words[rnd.randrange(len(words))] = word()
    base = [word() for _ in range(120)]
    for _ in range(60):  # a large group that meets at the same shingles
        own = list(base)
        for _ in range(rnd.randrange(4)):
            own[rnd.randrange(120)] = word()
        rows.append((len(rows), " ".join(own)))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept_by_hand(rows)
    monkeypatch.setattr(jaccard, "SMALL", 64)  # the largest group here has 63 texts
    got = [r.doc_id for r in simhash.keep_one_per_component(spark, df, "").collect()]
    assert sorted(got, key=repr) == want and len(want) < len(rows)


def test_large_groups_lose_no_link(spark, monkeypatch):
    """Groups over SMALL: what goes and what stays is as by brute force, however few are compared at first."""
    rnd = random.Random(6)
    word = lambda: f"w{rnd.randrange(3000)}"
    base, rows = [word() for _ in range(120)], []
    for _ in range(150):
        own = list(base)
        for _ in range(rnd.randrange(3)):
            own[rnd.randrange(120)] = word()
        rows.append((len(rows), " ".join(own)))
    df, want = spark.createDataFrame(rows, "doc_id long, text string"), kept_by_hand(rows)
    for small in (64, 8):
        monkeypatch.setattr(jaccard, "SMALL", small)
        assert sorted(r.doc_id for r in jaccard.without_near_copies(df).collect()) == want, small


def test_links_that_no_centre_makes(spark, monkeypatch):
    """Two families and some strays share their rarest shingles, each text is like few others, and groups are all large: chains are
    joined by links between texts that are both no centre."""
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(3000)}"
    line, rows = [word() for _ in range(60)], []
    for _ in range(3):
        words = line + [word() for _ in range(40)]
        for _ in range(25):  # a chain: each is a near copy of the one before, far ones aren't
            rows.append((len(rows), " ".join(words)))
            for _ in range(2):
                words[60 + rnd.randrange(40)] = word()
    rows += [(len(rows) + k, " ".join(line + [word() for _ in range(60)])) for k in range(20)]
    rnd.shuffle(rows)
    df, want = spark.createDataFrame(rows, "doc_id long, text string"), kept_by_hand(rows)
    asked, across = [], jaccard._across

    def seen(*of):
        out = across(*of)
        asked.append(0 if out is None else out.count())
        return out

    for name, value in {"SMALL": 2, "CENTRES": 1, "_across": seen, "common_shingles": lambda *_: (np.zeros(0, np.uint64), np.zeros(0, np.int64))}.items():
        monkeypatch.setattr(jaccard, name, value)
    assert sorted(r.doc_id for r in jaccard.without_near_copies(df).collect()) == want and len(want) >= 21
    assert 0 < asked[0] < len(rows) * (len(rows) - 1) // 2


def test_a_large_family_makes_few_pairs(spark, monkeypatch):
    """400 changed copies of a text that is itself not there: each is compared with few others, and none that is alike is missed."""
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(50000)}"
    base, rows = [word() for _ in range(120)], []
    for k in range(400):
        own = list(base)
        for _ in range(rnd.choice([1, 1, 1, 2, 2, 2, 3, 3, 4])):
            own[rnd.randrange(120)] = word()
        rows.append((k, " ".join(own)))
    made, staged = {}, jaccard.staged

    def counted(df, label, keep=False):
        out = staged(df, label, keep)
        if label in ("pairs", "across"):
            made[label] = out.count()
        return out

    monkeypatch.setattr(jaccard, "staged", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id for r in jaccard.without_near_copies(df).collect()), key=repr) == kept_by_hand(rows)
    assert 0 < made["pairs"] < 8 * len(rows) and 0 < made["across"] < 2 * len(rows), made


def test_parity_sketches_differ_in_no_more_than_the_sets():
    rnd = random.Random(8)
    for n in (1, 5, 80, 3000):
        words = [f"w{rnd.randrange(9000)}" for _ in range(n)]
        for changed in (0, 1, 7, n):
            other = [f"x{rnd.randrange(9000)}" if rnd.random() * n < changed else w for w in words]
            a, b = (jaccard.shingles(" ".join(w)) for w in (words, other))
            bits = sum(int(x).bit_count() for x in (jaccard.parities(a) ^ jaccard.parities(b)).view(np.uint64))
            assert bits <= len(np.setxor1d(a, b)) and (changed or bits == 0)


def test_common_shingles_are_counted_over_all_texts(spark):
    """A line that five of 24,000 texts have, and one that all have: a sample of 20,000 counted neither right."""
    line, rare = "a line that all of them have", "this is in few texts alone"
    df = spark.range(24_000).select(F.concat_ws(" ", F.lit(line), F.when(F.col("id") % 4_800 == 0, F.lit(rare)), F.sha1(F.col("id").cast("string"))).alias("text"))
    counts = np.zeros(1 << jaccard.BUCKET_BITS, np.int64)
    for r in df.collect():
        np.add.at(counts, jaccard.bucket(jaccard.shingles(r.text)).astype(np.int64), 1)
    hot, n = jaccard.common_shingles(df, "text")
    assert (counts[hot.astype(np.int64)] == n).all() and (np.diff(hot.astype(np.int64)) > 0).all()
    for text, least in ((line, 24_000), (rare, 5)):
        at = np.searchsorted(hot, jaccard.bucket(jaccard.shingles(text)))
        assert (hot[at] == jaccard.bucket(jaccard.shingles(text))).all() and (n[at] >= least).all()
    first = jaccard.prefix(jaccard.shingles(df.first().text), hot, n)
    assert len(first) and not set(first.tolist()) & set(jaccard.shingles(line).tolist())
    assert [len(x) for x in jaccard.common_shingles(df.limit(0), "text")] == [0, 0]


def test_real_and_odd_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(700)
    for df in (docs, odd(spark).select("doc_id", "text")):
        got = sorted([r.doc_id for r in jaccard.without_near_copies(df).collect()], key=repr)
        assert got == kept_by_hand(texts(df))
    assert jaccard.without_near_copies(df.limit(0)).count() == 0
