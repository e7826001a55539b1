import hashlib
import math
import re
import zlib
from collections import Counter

from loomspark.llm import resampling

from .odd import odd, texts


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]]


def by_hand(rows, target, percent=25, least=20):
    s, t = Counter(), Counter()
    own = [features(x) for _, x in rows]
    for _, f in own:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (t_all[1] + 10000) / ((s[b] + 1) * (t_all[0] + 10000)))) for t_all in [(t.total(), s.total())] for b in s}
    out = []
    for (i, _), (n, f) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [r[:4] + (k,) for k, r in enumerate(fit[: percent * len(fit) // 100], 1)]
    return Counter(drawn + [r[:4] + (None,) for r in fit[len(drawn) :]] + [r[:4] + (None,) for r in out if not r[4]])


def rows_of(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


def test_odd_rows_equal_brute_force(spark):
    prose = "The Größe of things, 3.14 and ÉTÉ: ice-cream & co. " * 6
    df = odd(spark, [(100 + k, prose + " extra" * k) for k in range(20)] + [(200, prose), (200, prose), (None, prose)])
    target = spark.createDataFrame([(1, "things and co größe"), (2, None), (3, "")], "item_id long, text string")
    got = rows_of(resampling.resample(df, target))
    want = by_hand(texts(df), ["things and co größe", None, ""])
    assert got == want and sum(r[4] is not None for r in got) == 6
    for some, goal in ((df.limit(0), target), (df, target.limit(0))):
        assert rows_of(resampling.resample(some, goal)) == by_hand(texts(some), texts(goal.withColumnRenamed("item_id", "doc_id")) and [x for _, x in texts(goal.withColumnRenamed("item_id", "doc_id"))])


def test_runs_of_three_words_and_other_shares(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 11}" for j in range(30))) for k in range(40)], "doc_id long, text string")
    got = resampling.resample(docs, docs.limit(3), percent=50, longest=3, buckets=64, least_words=5)
    rows = got.collect()
    assert {r.n_features for r in rows} == {30 + 29 + 28} and sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 21))
    ranked = sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])
    assert [(-r.score, r.doc_id) for r in ranked] == sorted((-r.score, r.doc_id) for r in ranked)


def test_main_path_is_native(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(resampling, "staged", lambda df, label: seen.append(df) or df)
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    resampling.resample(docs, docs)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in seen]
    assert plans and not any(w in p for p in plans for w in ("Python", "Pandas", "Arrow"))
