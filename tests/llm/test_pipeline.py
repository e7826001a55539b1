import random

import corpus_pipeline
from loomspark.llm import packing, simhash
from loomspark.llm.common import staged

from .test_jaccard import kept_by_hand, shingles_by_hand

SF = "/root/testdata/sf0.001"


def planted(docs):
    """Copies of long documents with one word in sixty changed, each near its original by brute force, and their ids."""
    rnd, rows = random.Random(2), []
    for r in sorted(docs.where("lang = 'en' AND n_chars > 1500").collect(), key=lambda r: r.doc_id)[:30]:
        words = r.text.split()
        for k in range(5, len(words), 60):
            words[k] = f"changed{rnd.randrange(10**6)}"
        text = " ".join(words)
        a, b = shingles_by_hand(text), shingles_by_hand(r.text)
        if len(a & b) / len(a | b) >= 0.8:
            rows.append((10**6 + r.doc_id, text, r.lang, r.source, len(text)))
    return docs.unionByName(docs.sparkSession.createDataFrame(rows, docs.schema)), {r[0] for r in rows}


def test_stages_feed_one_another(spark):
    docs, near = planted(spark.read.parquet(f"{SF}/documents.parquet"))
    columns, left, ids = docs.columns, [docs.count()], None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = ids, staged(stage(spark, docs, SF), name)
        assert docs.columns == columns
        left.append(docs.count())
        ids = {r.doc_id: r.text for r in docs.collect()}
        if name == "simhash_near_dedup":
            assert sorted(ids, key=repr) == kept_by_hand(sorted(before.items())) and not near & set(ids)
    assert left[0] >= left[1] > left[2] > left[3] == left[4] > 0 and len(near) > 10
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    tokens = packing.token_table(docs, packing.default_tokenizer()).groupBy().sum("n").first()[0]
    assert pieces.groupBy().sum("length").first()[0] == tokens


def test_candidates_by_fingerprint(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(5000)}" for _ in range(6000)]
    rows = [(0, " ".join(base)), (1, " ".join([*base, "end"])), (2, " ".join(reversed(base))), (3, "short text"), (4, None)]
    assert simhash.candidate_pairs(spark.createDataFrame(rows, "doc_id long, text string")).count() == 1


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
