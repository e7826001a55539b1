import math
import re
import statistics
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from loomspark.llm import language_id, quality

from .odd import odd, texts

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    got = language_id.identify(docs, model).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 150 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98
    assert sum(r.rejected for r in got) <= 2 and all(0 <= r.score <= 1 for r in got)
    assert model.predict(["?!", None, "", "123"])[0] == ["und"] * 4 and model.predict(["?!"])[2] == [True]


def test_the_rejection_quantile_exists(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = language_id.fit(docs)
    named = docs.where(~language_id.held_out(docs.doc_id) & docs.lang.isNotNull())
    below = language_id.identify(named, model).where("lang_pred <> 'und' AND score < " + repr(model.reject_below)).count()
    assert language_id.TRAIN_ROWS >= 4000 and (model.reject_below == language_id.REJECT_MOST or below > 0)


def test_few_letters_are_less_sure_than_a_page(spark):
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    heats = [t for _, t in model.short]
    assert len(heats) >= 5 and heats == sorted(heats, reverse=True) and heats[-1] >= model.temperature
    lang, score, rejected = model.predict(["a", "e", "The house that we saw is old, and the people who live there have been good to us. " * 4])
    assert max(score[:2]) < 0.5 and rejected[:2] == [True, True] and lang[2] == "en" and score[2] > 0.9 and not rejected[2]


def test_temperatures_of_short_texts_by_hand():
    """The likeliest of the grid for each length, never below that of longer texts; between the sizes, straight lines of logarithms."""
    pieces = [("ab", 2, "x"), ("ba", 2, "y"), ("ab", 2, "y"), ("abcdabcd", 8, "x"), ("dcbadcba", 8, "y"), ("zzzzzzzz", 8, "none")]
    counts = [language_id.subwords(t) for t, _, _ in pieces]
    weights = [[math.sin(b), math.cos(3 * b)] for b in range(language_id.BUCKETS)]
    model = language_id.Model(["x", "y"], language_id.np.array(weights, "f4"), language_id.np.zeros(2, "f4"), 0.5, 0.0)
    rows = [(c.nonzero()[0], c[c.nonzero()[0]]) for c in counts]
    model.short = language_id.heated(model, language_id.np.array([n for _, n, _ in pieces]), [y for _, _, y in pieces], language_id.Shares(rows))

    def loss(t, length):
        total = 0
        for (_, n, y), c in zip(pieces, counts, strict=True):
            if n == length and y != "none":
                z = [sum(int(c[b]) * weights[b][k] for b in c.nonzero()[0]) / int(c.sum()) / t for k in (0, 1)]
                total += math.log(sum(map(math.exp, z))) - z["xy".index(y)]
        return total

    grid = [2.0 ** (e / 4) for e in range(-16, 41)]
    long = max(0.5, min(grid, key=lambda t: loss(t, 8)))
    assert model.short == ((3.0, max(long, min(grid, key=lambda t: loss(t, 2)))), (26.0, long))
    (a, s), (b, t) = model.short
    assert math.isclose(model.heat([1])[0], s) and math.isclose(model.heat([5000])[0], 0.5)
    assert math.isclose(model.heat([9])[0], math.exp(math.log(s) + (math.log(t) - math.log(s)) * math.log(9 / a) / math.log(b / a)))


def test_snippets_are_parts_of_the_text_with_a_letter():
    text = "Straße 12, Bücher und 日本語 " * 9
    got = language_id.snippets(text)
    assert [n for n, _ in got if n > 8] == [16, 32, 64] and all(len(t) == n and t in text for n, t in got)
    assert language_id.snippets("12 345") == language_id.snippets("") == [] and got == language_id.snippets(text)


def test_language_of_odd_documents(spark):
    df = odd(spark)
    got = language_id.identify(df, language_id.fit(df)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(texts(df))
    assert {r.lang_pred for r in got if r.text and re.search(r"\w", r.text)} == {"en"}
    assert language_id.identify(df, language_id.fit(df.limit(0))).where("lang_pred <> 'und' OR NOT rejected").count() == 0
    stage = language_id.keep_identified(spark, df, "")
    assert stage.columns == df.columns and stage.where("text IS NULL").count() == 0


def test_subword_counts_do_not_depend_on_the_piece(monkeypatch):
    text = "Straße und Bücher " * 50
    whole = language_id.subwords(text)
    monkeypatch.setattr(language_id, "_PIECE", 7)
    assert (language_id.subwords(text) == whole).all()


def counts_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd(spark), allowMissingColumns=True)
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    by_text = {}
    got = quality.judge(docs, model)
    for i, t in texts(docs):
        by_text.setdefault(i, Counter())[counts_by_hand(t)] += 1
    for r in got.collect():
        assert by_text[r.doc_id][(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)] > 0
        assert not (r.kept and r.base_failed)
    assert got.count() == docs.count()


def test_clean_documents_are_kept_and_junk_is_not(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.judge(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) / len(good) > 0.99 and sum(r.kept for r in bad) / len(bad) < 0.5


def test_toxic_documents_go_where_many_are_trusted_and_clean_ones_stay(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.judge(docs, quality.fit(docs, labels)).join(labels, "doc_id").where("NOT base_failed").collect()
    share = lambda rows: sum(not r.kept for r in rows) / len(rows)
    assert share([r for r in got if r.toxic == 1]) > 0.15 and share([r for r in got if r.quality == 0]) > 0.98
    assert share([r for r in got if r.quality == 1 and r.toxic == 0]) < 0.003


def test_the_ratio_and_threshold_against_brute_force(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit(docs, labels)
    good = labels.where("quality = 1 AND toxic = 0").selectExpr("doc_id", "pmod(shiftright(xxhash64(doc_id, 'trusted sample'), 20), 5) = 0 AS apart").collect()
    text = dict((r.doc_id, r.text or "") for r in docs.collect())
    bucket = lambda w: int(xxhash.xxh64_intdigest(w.lower().encode()) * 0xC2B2AE3D27D4EB4F % 2**64 >> (64 - quality.BITS))
    grams = {i: [bucket(w) for w in re.findall(r"[^\x20\x09-\x0D]+", t)] for i, t in text.items()}
    raw, target = Counter(b for g in grams.values() for b in g), Counter(b for r in good if not r.apart for b in grams[r.doc_id])
    n, m = sum(target.values()) + quality.BUCKETS, sum(raw.values()) + quality.BUCKETS
    score = {i: sum(math.log((target[b] + 1) / n * m / (raw[b] + 1)) for b in g) / len(g) if g else 0.0 for i, g in grams.items()}
    own = sorted(score[r.doc_id] for r in good if r.apart and not counts_by_hand(text[r.doc_id])[5])
    at = quality.KEEP_SHARE * len(own)
    least = own[int(at)] - quality.MARGIN * statistics.pstdev(own) / math.sqrt(1 + at)
    assert abs(least - model.threshold) < 1e-9
    for r in quality.judge(docs, model).collect():
        assert abs(r.score - score[r.doc_id]) < 1e-9 and r.kept == (not r.base_failed and r.score >= model.threshold)


def test_all_trusted_documents_count(spark):
    """None is left out where more are labelled than a sample once held."""
    docs = spark.range(90_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("one"), F.repeat(F.lit(" two"), 60)).alias("text"))
    model = quality.fit(docs, docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic"))
    part = docs.where("pmod(shiftright(xxhash64(doc_id, 'trusted sample'), 20), 5) <> 0").count()
    at = [int(quality.ngrams(quality.word_hashes([w]))[0]) for w in ("one", "two")]
    n, m = part * 61 + quality.BUCKETS, 90_000 * 61 + quality.BUCKETS
    for b, k in zip(at, (1, 60), strict=True):
        assert math.isclose(model.log_ratio[b], math.log((part * k + 1) / n * m / (90_000 * k + 1)), abs_tol=1e-9)


def test_quality_without_labels_is_the_base_rule(spark):
    df = odd(spark)
    out = quality.judge(df, quality.fit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert out.where("kept = base_failed").count() == 0 and out.count() == df.count()
    assert quality.judge(df.limit(0), quality.fit(df.limit(0), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))).count() == 0


def test_only_texts_that_may_be_trusted_are_moved(spark, monkeypatch):
    """2,000 texts, 100 of them trusted, whose labels aren't broadcast: the others are counted where they are read."""
    docs = spark.range(2000).selectExpr("IF(id = 7, NULL, id) AS doc_id", "concat('one two ', id) AS text")
    labels = spark.range(0, 2000, 20).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    asked, counted = [], quality._counted
    monkeypatch.setattr(quality, "_counted", lambda df: asked.append(df) or counted(df))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        quality.fit(docs, labels)
        rows = asked[0].collect()
        plan, moved = [asked[0]._jdf.queryExecution().executedPlan()], []
        while plan:
            x = plan.pop()
            if x.nodeName() == "Exchange":
                moved.append(x.metrics().get("shuffleRecordsWritten").get().value())
            plan += [x.children().apply(k) for k in range(x.children().size())]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 2000 and 60 < sum(bool(r.trusted) for r in rows) < 100
    assert moved and sum(moved) < 1000, moved
    some = quality.maybe_in(docs, labels).where("maybe")
    assert some.join(labels, "doc_id").count() == 100 and some.count() < 130
    assert quality.maybe_in(docs, labels.limit(0)).where("maybe").count() == 0
