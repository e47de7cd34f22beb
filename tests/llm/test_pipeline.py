"""The pipeline's stages, each on what its predecessor kept, against what each must have done."""

import random

import corpus_pipeline
from lodestone.llm import jaccard, pii
from lodestone.llm.common import durable

DATA = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(durable(stage(spark, kept[-1], DATA), name))
        ids = {r.doc_id for r in kept[-1].select("doc_id").collect()}
        assert ids <= {r.doc_id for r in kept[-2].select("doc_id").collect()} and ids
    assert all(k.columns == columns for k in kept[:-1])
    assert kept[4].count() == kept[3].count() == kept[5].count()
    before, after = ({r.doc_id: r for r in k.collect()} for k in (kept[3], kept[4]))
    for i, r in before.items():
        for kind, a, b in pii.entities(r.text):
            if kind in ("email", "card"):
                assert r.text[a:b] not in after[i].text
        if not pii.entities(r.text):
            assert after[i] == r
        assert after[i].n_chars == len(after[i].text)
    ran = corpus_pipeline.run(spark, DATA).select("doc_id", "n_tokens", "ids_sha256").collect()
    assert {tuple(r) for r in ran} == {tuple(r) for r in kept[5].select("doc_id", "n_tokens", "ids_sha256").collect()}


def test_stages_on_no_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, DATA), name)
    assert docs.count() == 0


def test_near_duplicates_are_five_words_and_four_fifths(spark):
    rng = random.Random(11)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    for k in range(60):  # near copies with up to 30 % appended, and with words changed; then short texts
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((6, 9, 14, 30, 80, 150, 400)))]
        rows.append((10_000 + 10 * k, " ".join(base)))
        for n in range(1, 4):
            near = base + [f"v{rng.randrange(10**6)}" for _ in range(rng.randint(0, 3 * len(base) // 10))]
            if n == 3:
                near[rng.randrange(len(near))] = "changed"
            rows.append((10_000 + 10 * k + n, " ".join(near)))
    sets = {i: jaccard.shingles(t, 5) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and top(a) != top(b):
                up[max(top(a), top(b))] = min(top(a), top(b))
    got = corpus_pipeline.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA)
    assert {r.doc_id for r in got.collect()} == {i for i in sets if top(i) == i}


def test_cells_never_miss_at_four_fifths():
    import numpy as np

    rng = random.Random(1)
    for n in (1, 3, 4, 5, 7, 8, 10, 18, 40, 57, 200, 1000):
        for _ in range(60):
            one = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
            apart = rng.randint(0, jaccard.most_apart(n, 80))
            drop = rng.randint(0, min(apart, n // 5))
            two = np.concatenate([one[drop:], np.array([rng.getrandbits(64) for _ in range(apart - drop)], np.uint64)])
            if 100 * (n - drop) >= 80 * (n + apart - drop) and apart:  # equal sets are one set before they have cells
                mine, theirs = ({c for quota, codes in jaccard.cells_of(x, 80) for c in sorted(codes.tolist())[:quota]} for x in (one, two))
                assert mine & theirs
