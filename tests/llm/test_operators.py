"""Each training-data operator against a brute-force version, and on awkward rows."""

import hashlib
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontam, jaccard, licenses, pii, quality_model, quality_rules, secrets, toxicity, urls
from lodestone.llm.common import components, durable

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, license string, stats string, decontamination string, words string"
#: Null, empty, white space, marks alone, a very long text, repeated rows and ids, text beyond the first plane.
AWKWARD = [
    (1, None, "x", "y", "z", "w"), (2, "", None, None, None, None), (3, " \t\n\x0b ", "", "", "", ""), (4, "*** || !!", "", "", "", ""),
    (5, "the of and " * 40_000, "", "", "", ""), (6, "MIT License\nMIT License", "", "", "", ""), (6, "MIT License\nMIT License", "", "", "", ""),
    (7, "Über 𝔘nicode 漢字 \u2028 K\u0301elvin \u212a é", "", "", "", ""), (None, "no key here at all", "", "", "", ""),
]


def words(text, lower=True):
    t = text or ""
    if lower:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def both(docs, awkward):
    return docs.select("doc_id", "text").union(awkward.select("doc_id", "text"))


def test_licenses_against_brute_force(docs, awkward, empty):
    got = licenses.scan_licenses(both(docs, awkward)).collect()
    assert len(got) == docs.count() + len(AWKWARD)
    for r in got:
        w = words(r.text)
        places = [(k, x) for p, x in licenses.BASE_PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        x = r.license
        assert (x.n_words, x.n_base) == (len(w), len(places))
        assert x.first_word == (min(k for k, _ in places) if places else None)
        assert x.last_word == (max(k for k, _ in places) if places else None)
        assert x.base_labels == ",".join(sorted({n for _, n in places}))
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1
    assert licenses.scan_licenses(empty).columns[-1] == "license_" and licenses.scan_licenses(empty).count() == 0


def test_licenses_full_grant_shifted_and_partial(spark):
    grant = next(words for label, words, _ in licenses.TEMPLATES if label == "bsd")
    rows = spark.createDataFrame([(1, "zz " * 50 + grant.upper().replace(" ", ", ")), (2, " ".join(reversed(grant.split()))), (3, "Licensed under CC BY-NC 4.0."), (4, "plain words")], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan_licenses(rows).collect()}
    assert got[1].labels == "bsd" and got[1].score > 0.999 and got[1].n_base == 0
    assert got[2].labels == "" and got[2].score < 1
    assert got[3].labels == "cc-by-nc" and got[4].score == 0


def brute_licences(w, rare, templates):
    """(labels, best share) by trying every place of both grids for every template."""
    hits = [(p, x) for p, x in enumerate(w) if x in rare]
    if not hits:
        return set(), 0.0
    own = sorted((rare[x] for x in {x for _, x in hits}), reverse=True)
    cut = own[min(len(own), max(licenses.LOOKED_UP, (len(own) + 1) // 2)) - 1]
    labels, best, s = set(), 0.0, licenses.SLACK
    for label, text, needed in templates:
        t = text.split()
        total = sum(rare[x] for x in t if x in rare and rare[x] >= cut)
        for start in {k for p, x in hits for q in range(len(t)) if t[q] == x for k in ((p - q) // (2 * s) * 2 * s, (p - q + s) // (2 * s) * 2 * s - s)}:
            there = {q for p, x in hits if rare[x] >= cut for q in range(len(t)) if t[q] == x and start <= p - q < start + 2 * s}
            share = sum(rare[t[q]] for q in there) / total if there else 0.0
            best = max(best, share)
            piece = " " + " ".join(w[max(start, 0) : max(start, 0) + len(t) + 4 * s]) + " "
            if share >= licenses.LEAST - 1e-12 and all(f" {x} " in piece for x in needed):
                labels.add(label)
    return labels, best


def test_licence_labels_against_brute_force(spark, docs):
    rng = random.Random(9)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    plain = [f"plain{k}" for k in range(50)] + ["the", "of", "this", "software", "license", "copy"]
    for k in range(250):
        w = [rng.choice(plain) for _ in range(rng.randint(0, 60))]
        for label, text, needed in rng.sample(licenses.TEMPLATES, rng.randint(0, 3)):
            t = [x for x in text.split() if rng.random() > 0.15 * (k % 3)]
            if k % 5 == 0:
                t.insert(rng.randrange(len(t)), "and something between")
            at = rng.randint(0, len(w))
            w[at:at] = t
        rows.append((10_000 + k, " ".join(w)))
    rows.append((20_000, "mozilla " * 300 + "public license"))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    idf = licenses.word_rarity(frame, sorted(licenses._index(licenses.TEMPLATES)))
    rare = licenses.licence_words(licenses.TEMPLATES, idf)
    seen = Counter()
    for r in licenses.scan_licenses(frame).collect():
        labels, best = brute_licences(words(r.text), rare, licenses.TEMPLATES)
        base = set(filter(None, r.license.base_labels.split(",")))
        assert set(filter(None, r.license.labels.split(","))) == labels | base, r.doc_id
        if not base:
            assert r.license.score == pytest.approx(min(1.0, best if labels else best / 2))
        seen.update(labels)
    assert len(seen) > 12 and sum(seen.values()) > 150


def test_urls_rules_and_parts(spark):
    rows = [(1, "HTTP://WWW.Example.COM/en/1?x"), (2, "https://a.example.com/en/x#y"), (3, "https://b.net/es/1"), (4, "https://b.net/de/1"), (5, None), (6, "no scheme"), (7, "https://x.com"), (8, "https://notexample.com/en/"), (9, "q://h?/a"), (1, "HTTP://WWW.Example.COM/en/1?x")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    none = spark.createDataFrame([], "host string, bad int")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, none).orderBy("page_id").collect()]
    assert got == [
        (1, "www.example.com", "/en/1", "www.example.com/en/", "allow"), (1, "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        (2, "a.example.com", "/en/x", "example.com/en/", "block"), (3, "b.net", "/es/1", "net/es/", "block"), (4, "b.net", "/de/1", None, "allow"),
        (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "x.com", "", None, "allow"), (8, "notexample.com", "/en/", "com/", "allow"), (9, "h", "", None, "allow"),
    ]


def test_host_reputation_shrinks_towards_domain_and_suffix(spark):
    rows = [("a.bad.org", 1)] * 40 + [("b.bad.org", 1)] * 30 + [("c.bad.org", 1)] + [("x.good.org", 0)] * 60 + [("y.good.org", 1)] + [("y.good.org", 0)] * 20 + [("z.mid.org", 1)] + [(None, 1), ("n.good.org", None)]
    got = {r.host: r for r in urls.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["a.bad.org"].lower > 0.5 > got["x.good.org"].rate
    assert got["c.bad.org"].rate > got["z.mid.org"].rate  # one bad page each; the domains differ
    assert got["z.mid.org"].rate < 1 and "n.good.org" not in got
    pages = spark.createDataFrame([(1, "http://a.bad.org/q")], "page_id long, url string")
    assert urls.filter_urls(pages, spark.createDataFrame(rows, "host string, bad int")).first().verdict == "block"


def test_quality_statistics_against_brute_force(docs, awkward, empty):
    for r in quality_rules.text_statistics(both(docs, awkward)).collect():
        w, t = space_words(r.text), r.text or ""
        c = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if space_words(x)]
        s = r.stats
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
    assert quality_rules.text_statistics(empty).count() == 0


def test_quality_rules_learn_thresholds_and_keep_good(spark):
    rng = random.Random(3)
    rows, marks = [], []
    for k in range(400):
        bad = k % 4 == 0
        rows.append((k, " ".join(("x" if rng.random() < 0.2 else rng.choice("abcdefg") * rng.randint(2, 6) + str(rng.random())) + ("***" if bad else "") for _ in range(30))))
        marks.append((k, 0 if bad else 1, 0))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    judged, rules = quality_rules.judge_quality(docs, labels)
    assert rules and all(r.precision >= quality_rules.LEAST_PRECISION for r in rules)
    assert {r.doc_id for r in judged.where("kept").collect()} == {k for k in range(400) if k % 4}
    assert {r.doc_id for r in quality_rules.keep_good(docs, labels).collect()} == {k for k in range(400) if k % 4}
    none = labels.limit(0)
    judged, rules = quality_rules.judge_quality(docs, none)
    assert rules == [] and judged.where("kept").count() == 400
    assert quality_rules.judge_quality(docs.limit(0), labels)[0].count() == 0


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in space_words(t)] if t is None or t.isascii() else [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in space_words(t)]
        sets[i] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 90 * (len(sets[a]) + len(sets[b]) - n) and top(a) != top(b):
                    up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_jaccard_against_brute_force(spark, docs):
    rng = random.Random(5)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    base = [f"w{k}" for k in range(120)]
    for k in range(90):  # near copies around the threshold, chains of them, and copies
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = f"v{rng.randrange(40)}"
        rows.append((10_000 + k, " ".join(t[: rng.randint(105, 120)]).title() if k % 7 else " ".join(base)))
    rows += [(20_000, None), (20_001, ""), (20_002, "a b"), (20_003, "A  B"), (20_004, "a b c"), (20_005, "same " * 50_000), (20_006, "same " * 9)]
    got = {r.doc_id: (r.n_shingles, r.component) for r in jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("link", [90, 80])
def test_jaccard_cells_never_miss(link):
    rng = random.Random(1)
    import numpy as np

    def first(cells, often):
        return {c for quota, codes in cells for c in sorted(codes.tolist(), key=lambda c: (often(c), c))[:quota]}

    met = 0
    for n in (1, 3, 5, 8, 9, 10, 11, 12, 18, 40, 57, 58, 200, 1000):
        for trial in range(60):
            one = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
            apart = rng.randint(0, jaccard.most_apart(n, link))
            drop = rng.randint(0, min(apart, n * (100 - link) // 100))
            two = np.concatenate([one[drop:], np.array([rng.getrandbits(64) for _ in range(apart - drop)], np.uint64)])
            i = n - drop
            if 100 * i >= link * (n + apart - drop) and set(one.tolist()) != set(two.tolist()):
                met += 1
                for often in (lambda c: 0, lambda c: c % 7, lambda c: -c):  # whatever the common order
                    assert first(jaccard.cells_of(one, link), often) & first(jaccard.cells_of(two, link), often), (n, trial)
    assert met > 300


def spread(rng, n, words=9):
    return [" ".join(f"w{rng.randrange(10**9)}" for _ in range(words + 2)) for _ in range(n)]


def test_jaccard_disjoint_sets_share_no_cells(spark):
    rng = random.Random(8)
    for words in (9, 100):
        for n in (1_000, 4_000):
            rows = spark.createDataFrame(list(enumerate(spread(rng, n, words))), "key long, text string")
            points = rows.mapInArrow(lambda b: jaccard._point(b, 3, 90), "key long, n long, digest binary, counts binary, cells array<struct<quota:int,codes:array<long>>>")
            assert jaccard.shared_cells(points.select(F.col("key").alias("id"), "cells")).count() == 0


def shuffled_rows(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_jaccard_shuffles_each_cell_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)  # as where more cells are shared than may be broadcast
    texts = spread(random.Random(9), 500, 100)
    rows = spark.createDataFrame([(2 * k + n, t + " x" * n) for k, t in enumerate(texts) for n in range(1 + (k < 50))], "key long, text string")
    points = rows.mapInArrow(lambda b: jaccard._point(b, 3, 90), "key long, n long, digest binary, counts binary, cells array<struct<quota:int,codes:array<long>>>")
    nodes = durable(points.select(F.col("key").alias("id"), "cells"), "nodes")
    cells = nodes.select(F.explode("cells.codes").alias("c")).agg(F.sum(F.size("c"))).first()[0]
    before, usual = shuffled_rows(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = jaccard.shared_cells(nodes).select("id").distinct().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert {r.id for r in got} == {2 * k + n for k in range(50) for n in range(2)}
    assert shuffled_rows(spark) - before < 1.7 * cells


def test_durable_leaves_no_shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        found = files.getAllFiles()
        return {n for k in range(found.size()) if (n := found.apply(k).getName()).startswith("shuffle_")}

    before = held()
    df = spark.range(10_000, numPartitions=3).groupBy((F.col("id") % 7).alias("k")).count()
    table = durable(df, "counts")
    for _ in range(100):  # Spark deletes them in the background
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, df.collect()))  # the query itself can run again


def test_jaccard_links_come_from_the_trees(spark):
    rng = random.Random(6)
    rows = list(enumerate(spread(rng, 300, 60)))
    for k in range(100):  # near copies of the first hundred, and a hot group of them around one text
        w = rows[k][1].split(" ")
        w[-1] = f"x{k}"
        rows.append((1_000 + k, " ".join(w)))
    for k in range(600):
        w = rows[200][1].split(" ")
        w[k % 2 * -1] = f"y{k}"
        rows.append((2_000 + k, " ".join(w)))
    docs = spark.createDataFrame(rows, "key long, text string")
    points = docs.mapInArrow(lambda b: jaccard._point(b, 3, 90), "key long, n long, digest binary, counts binary, cells array<struct<quota:int,codes:array<long>>>")
    nodes, texts = points.select(F.col("key").alias("id"), "counts", "cells").cache(), docs.select(F.col("key").alias("id"), "text")
    members = jaccard.shared_cells(nodes.select("id", "cells")).join(nodes.select("id", "counts"), "id")
    assert members.agg(F.max("m")).first()[0] > jaccard.TILE
    pairs = jaccard.first_search(members, 90)
    links = jaccard.verify(pairs, texts, 3, 90)
    found = {tuple(sorted(r)) for r in links.collect()}
    assert {(k, 1_000 + k) for k in range(100)} <= found  # every planted near copy, by the first search
    assert pairs.count() < 12 * 700  # not the 180,000 pairs of the hot group
    joined = components(links.toDF("a", "b"))
    assert jaccard.further_search(members, joined, 90).count() == 0
    # without what the first search found, the further one gives every pair of the hot group that shares a cell, once
    apart = components(links.limit(0).toDF("a", "b"))
    every = jaccard.further_search(members, apart, 90).cache()
    whole = {r.node for r in components(every.toDF("a", "b")).collect()}
    assert len(whole) == 601 and every.count() == every.distinct().count()
    got = {r.key: r.component for r in jaccard.link_documents(docs, key="key").collect()}
    assert all(got[1_000 + k] == k for k in range(100)) and {got[2_000 + k] for k in range(600)} == {200}
    with pytest.raises(ValueError):
        jaccard.link_documents(docs, key="text")


@pytest.mark.parametrize("link", [90, 80])
def test_r_tree_finds_what_brute_force_finds(link):
    import numpy as np

    rng = np.random.default_rng(0)
    near = np.repeat(rng.poisson(3, (1, jaccard.GROUPS)), 900, axis=0) + (rng.random((900, jaccard.GROUPS)) < 0.05)
    points = np.vstack([rng.poisson(3, (1200, jaccard.GROUPS)), near]).astype(np.uint8)
    tree = jaccard.RTree(points, link)
    assert len(tree.levels) == 2
    for k in range(0, 2100, 97):
        low = np.minimum(points, points[k]).sum(axis=1, dtype=np.int64)
        at, overlap = tree.search(points[k])
        assert set(at.tolist()) == set(np.flatnonzero(100 * low >= link * (points.sum(axis=1, dtype=np.int64) + int(points[k].sum()) - low)).tolist())
        assert list(overlap) == list(low[at])


def test_count_vectors_fold():
    import numpy as np

    rng = random.Random(3)
    h = np.array([rng.getrandbits(64) for _ in range(9000)], np.uint64)
    long, short = jaccard.count_vector(h), jaccard.count_vector(h[:4000])
    assert (len(long), len(short)) == (8 * jaccard.GROUPS, 2 * jaccard.GROUPS)
    folded = jaccard._vectors([long.tobytes(), short.tobytes()])
    assert folded.shape == (2, 2 * jaccard.GROUPS) and (folded[0] >= folded[1]).all() and folded.sum() == 13000


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bpe_equals_the_tokenizers_library(spark, docs, awkward, empty):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    more = spark.createDataFrame([(50, "<|endoftext|>Hi <|startoftext|>there"), (51, "ΑΣΣ İ ẞ ½ ٣ I'LL don't aaaaaaaa x\x00y e\u0301 \x1c\x85"), (52, "snake_case __x__ '''s 12a3")], "doc_id long, text string")
    rows = both(docs, awkward).union(more)
    for r in bpe.decode(bpe.encode(rows, bpe.vocabulary_path()), bpe.vocabulary_path()).collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == t.decode(ids, skip_special_tokens=False)
    for r in bpe.encode(rows, bpe.vocabulary_path(), digests=True).collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(empty, bpe.vocabulary_path()).count() == 0


def brute_secrets(text):
    out = []
    for order, (kind, pattern, least) in enumerate([("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), ("access", r"(AKIA[A-Z0-9]+)", 20), ("hex", r"([0-9a-f]+)", 24)]):
        out += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text or "") if len(m[1]) >= least]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


SECRETS = ["token=a password: 'abcdef' ſecret=abcdef", "secret=token:longvalue1", "AKIA" + "A" * 15, "AKIA" + "A" * 16 + " " + "ab" * 12 + " " + "ab" * 11 + "a", 'API_KEY" = "x.y/z+1"', "https://u:pw1234@host -----BEGIN RSA PRIVATE KEY-----", "é𝔘 token=abcdefg"]


def test_secrets_against_brute_force_and_ledger(spark, docs, awkward, empty):
    rows = both(docs, awkward).union(spark.createDataFrame(list(enumerate(SECRETS, 900)), "doc_id long, text string"))
    found, ledger = secrets.scan_secrets(rows.withColumn("copy", F.col("text")))
    for r in found.collect():
        mine = [f"{x.kind}:{x.start}:{x.end}" for x in r.findings]
        assert [x for x in mine if x.split(":")[0] in ("assign", "access", "hex")] == brute_secrets(r.copy)
    n = ledger.count()
    assert n == rows.select(F.sha2(F.coalesce("text", F.lit("")), 256)).distinct().count()
    again, later = secrets.scan_secrets(rows, ledger)
    assert later.count() == n and again.count() == rows.count()  # nothing is scanned twice
    newer, more = secrets.scan_secrets(rows, ledger, version="next")
    assert more.count() == 2 * n and newer.where("size(findings) > 0").count() == found.where("size(findings) > 0").count()
    assert secrets.scan_secrets(empty)[0].count() == 0


def test_secrets_over_versions_of_history(spark):
    first = [("a.py", "c1", "token=abcdefgh"), ("b.py", "c1", "plain"), ("c.py", "c1", "token=abcdefgh")]
    later = first + [("a.py", "c2", "token = other99"), ("d.py", "c2", "token=abcdefgh"), ("b.py", "c2", None)]
    schema = "path string, blob string, text string"  # a commit in a column that clashes
    rows, ledger = secrets.scan_secrets(spark.createDataFrame(first, schema))
    assert ledger.count() == 2 and rows.columns == ["path", "blob", "blob_", "findings"]
    old = ledger.where("size(findings) > 0").first().blob
    marked = ledger.withColumn("findings", F.when(F.col("blob") == old, F.array(F.struct(F.lit("kept").alias("kind"), F.lit(1).cast("long").alias("start"), F.lit(2).cast("long").alias("end")))).otherwise(F.col("findings")))
    for most in (500_000, 1, 0):  # the unseen blobs are broadcast; the seen ones are not either; neither
        secrets.BROADCAST_BLOBS, usual = most, secrets.BROADCAST_BLOBS
        try:
            rows, whole = secrets.scan_secrets(spark.createDataFrame(later, schema), marked)
            got = {(r.path, r.blob): [f.kind for f in r.findings] for r in rows.collect()}
        finally:
            secrets.BROADCAST_BLOBS = usual
        # seen blobs keep what the ledger says, wherever they are found again
        assert got == {("a.py", "c1"): ["kept"], ("b.py", "c1"): [], ("c.py", "c1"): ["kept"], ("a.py", "c2"): ["assign"], ("d.py", "c2"): ["kept"], ("b.py", "c2"): []}
        assert whole.count() == 4 and whole.select("blob", "rule_version").distinct().count() == 4


def test_pii_surrogates_are_distinct_consistent_and_typed(spark, docs, awkward, empty):
    extra = [(900 + k, f"mail a.b{k}@mail7.example.com or +1 (017) 555-77{k:02d} from 10.0.0.{k}, card 4111 1111 1111 1111 and Mrs Anna Schmidt met Herr Karl, Mr. Иван.") for k in range(60)]
    rows = both(docs, awkward).union(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("was", F.col("text"))
    got = pii.pseudonymize(rows, "k1").collect()
    assert len(got) == rows.count()
    made, back = {}, {}
    for r in got:
        found = pii.entities(r.was)
        assert [(s.kind, s.start, s.end) for s in r.surrogates] == found
        if not found:
            assert r.text == r.was
            continue
        if r.doc_id and r.doc_id >= 900:
            new = pii.entities(r.text)
            assert [k for k, _, _ in new] == [k for k, _, _ in found]
            for (k, a, b), (_, c, d), s in zip(found, new, r.surrogates):
                old, now = (k, r.was[a:b]), (k, r.text[c:d])
                assert old != now and made.setdefault(old, now) == now and back.setdefault(now, old) == old
                assert s.id == pii.identity(k, r.was[a:b], b"k1")
    assert not set(made) & set(back)
    card = made["card", "4111 1111 1111 1111"][1]
    digits = card.replace(" ", "")
    assert pii._luhn(digits[:-1]) == int(digits[-1]) and card[4] == " "
    given = made["person", "Mrs Anna Schmidt"][1].split()[1]
    assert given.istitle() and given.isascii() and given.endswith(tuple(pii.GIVEN["f", "latin"]))
    given = made["person", "Mr. Иван"][1].split()[1]
    assert given.istitle() and given[0] >= "Ѐ" and given.endswith(tuple(pii.GIVEN["m", "cyrillic"]))
    assert pii.pseudonymize(empty, "k").count() == 0


def test_pii_collisions_are_drawn_again(spark):
    # numbers of three digits leave so little room that surrogates meet originals
    rows = [(pii.identity("ssn", f"{k:03d}", b"k"), "ssn", f"{k:03d}") for k in range(0, 1000, 8)]
    found = spark.createDataFrame(rows, "id string, kind string, text string")
    again = {r.id: r.draw for r in pii.draws(found, b"k").collect()}
    made = [pii.surrogate("ssn", t, b"k", again.get(i, 0)) for i, _, t in rows]
    assert again and len(set(made)) == len(rows) and not set(made) & {t for _, _, t in rows}


def test_pii_whole_names_and_their_further_mentions(spark):
    whole = ["Mr. Juan Carlos Perez", "Mrs Anne-Marie Smith", "Mr Ludwig van Beethoven", "Dr. Meredith Grey", "Prof. Dr. Łukasz O'Brien", "г-н Иван Петров", "Dr J. R. Tolkien", "Madame Marie d'Arc", "Herr von Moltke", "доктор Ольга Сёмина", "Frau de la Cruz Lopez", "Mr. McDonald"]
    for x in whole:
        text = f"Then {x}'s friend met {x}, who left. But he"
        a = text.index(x)
        assert pii.entities(text) == [("person", a, a + len(x)), ("person", a + len(x) + 14, a + 2 * len(x) + 14)], x
    assert [t[1:] for t in pii.entities("Mr. Paul Herr Karl")] == [(0, 8), (9, 18)] and not pii.entities("Dr. a 3") and not pii.entities("Mr A b")
    rows = [(1, "Perez knew Mr. Juan Carlos Perez. Juan Perez and Mrs Anne-Marie Smith spoke; Marie Smith's mail smith@Perez.com, Perezoso. O'Brien left Dr O'Brien."), (2, "Perez and Juan without a title"), (3, "Mr. Juan Carlos Perez again")]
    one, two, three = pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k").orderBy("doc_id").collect()
    w = one.text.split(" ")
    assert w[0] + "." == w[5] and w[6] == w[3] and w[7] == w[0] and w[10].split("-")[1] == w[13] and w[11] + "'s" == w[14]
    assert w[18] == w[21][:-1] and "Perezoso." in w and not {"Perez", "Juan", "Carlos", "Smith", "Marie", "O'Brien"} & set(re.findall(r"[\w']+", one.text))
    assert two.text == rows[1][1] and not two.surrogates and three.text == " ".join(w[2:5] + [w[0]]) + " again"
    person = [s for s in one.surrogates if s.kind == "person"]
    assert len(person) == 9 and len({s.id for s in person}) == 3 and three.surrogates[0].id in {s.id for s in person}


def test_pii_numbers_in_another_layout_are_one_entity(spark):
    rows = [(1, "+44 20 7946 0958"), (2, "call +442079460958!"), (3, "+44 (0)20 7946 0958"), (4, "4111 1111 1111 1111"), (5, "4111-1111-1111-1111"), (6, "+44 20 7946 0959")]
    got = pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k").orderBy("doc_id").collect()
    digits = [re.sub(r"\(0\)|\D", "", r.text) for r in got]
    assert digits[0] == digits[1] == digits[2] != digits[5] and digits[3] == digits[4] and digits[0].startswith("44")
    assert len({r.surrogates[0].id for r in got}) == 3 and re.fullmatch(r"\+44 \(0\)\d\d \d{4} \d{4}", got[2].text)


def test_pii_names_without_a_title_and_the_key_of_the_session(spark):
    (r,) = pii.pseudonymize(spark.createDataFrame([("Then Anna Schmidt left; Schmidt and Anna said so. Frau Schmidt",)], "text string"), "k").collect()
    assert {s.kind for s in r.surrogates} == {"person"} and not {"Anna", "Schmidt"} & set(re.findall(r"\w+", r.text)) and pii.entities("Anna said") == []
    spark.conf.unset(pii.KEY_SETTING)
    key = pii.session_key(spark)
    assert len(key) == 64 and pii.session_key(spark) == key
    spark.conf.set(pii.KEY_SETTING, "mine")
    assert pii.session_key(spark) == "mine"
    spark.conf.unset(pii.KEY_SETTING)


def test_pii_lists_and_patterns_that_are_used_up(spark):
    # every listed name after one title, every address of one letter at one letter: no other text of the kind is free
    names = [f"{t} {n}" for t, of in (("Mr.", ("m", "latin")), ("Frau", ("f", "cyrillic"))) for n in pii.NAMES[of]]
    mails = [f"{a}@{b}.de" for a in pii.ALPHABETS[1] for b in pii.ALPHABETS[1]]
    rows = [(k, f"from {x}, again.") for k, x in enumerate(names + mails)]
    got = pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    made = [r.text[5:-8] for r in got]
    assert len(got) == len(rows) == len(set(made)) and not set(made) & {*names, *mails}
    for r in got:
        (s,), old = r.surrogates, rows[r.doc_id][1]
        assert pii.entities(r.text) == [(s.kind, 5, len(r.text) - 8)] and r.text[5:].split(" ")[0] == old[5:].split(" ")[0] or s.kind == "email"
    ips = {pii.surrogate("ip", f"10.0.0.{k}", b"k", pii.LONGER) for k in range(50)}
    import ipaddress

    assert len(ips) == 50 and all(ipaddress.ip_address(x).version == 6 for x in ips)


def test_decontamination_against_brute_force(spark, docs, awkward, empty):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").select(F.col("item_id").cast("string"), "text").union(spark.createDataFrame([("e", ""), ("n", None), ("two", "MIT License"), (None, "the of and"), ("two", "MIT License"), ("rep", "the of and " * 4)], "item_id string, text string"))
    windows = {}
    for r in bench.where("item_id is not null").collect():
        w = words(r.text)
        for k in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[k : k + 10]), set()).add(r.item_id)
    rows = both(docs, awkward)
    for size in (decontam.BLOCK_WORDS, 300):  # one block, and many
        got = decontam.decontaminate(rows, bench, block_words=size).collect()
        assert len(got) == rows.count()
        for r in got:
            w, hit, items = words(r.text), set(), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if own := windows.get(tuple(w[k : k + n])):
                        hit.update(range(k, k + n))
                        items |= own
            d = r.decontamination
            assert d.n_words == len(w) and d["items"] == sorted(items) and {j for s in d.spans for j in range(s.start, s.end)} == hit
    assert decontam.decontaminate(awkward, bench.limit(0)).count() == len(AWKWARD)
    assert decontam.decontaminate(empty, bench).count() == 0


def auc(pairs):
    good, bad = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_quality_model_held_out_accuracy(spark, awkward, empty):
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect()}
    got = quality_model.score_quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert auc([(known[r.doc_id], r.score) for r in got if r.held_out and r.doc_id in known]) > 0.97
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality_model.score_quality(docs, flipped).collect()} == pytest.approx({r.doc_id: r.score for r in got})
    none = quality_model.score_quality(awkward, labels.limit(0)).collect()
    assert len(none) == len(AWKWARD) and {r.score for r in none} == {0.5}
    assert quality_model.score_quality(empty, labels).count() == 0


def test_isotonic_is_monotone():
    x, y = quality_model.pool_adjacent([1, 2, 3, 4, 5], [0.1, 0.5, 0.3, 0.9, 0.8], [1, 2, 2, 1, 1])
    assert list(y) == pytest.approx([0.1, 0.4, 0.85]) and list(x) == pytest.approx([1, 2.5, 4.5])


def test_toxicity_held_out_accuracy_and_spans(spark, awkward, empty):
    rng = random.Random(2)
    plain, foul = [f"word{k}" for k in range(300)], ["grobian", "knave", "rascal", "villain"]
    rows, marks = [], []
    for k in range(600):
        toxic = k % 5 == 0
        w = [rng.choice(plain) for _ in range(rng.randint(5, 150))]
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(foul) + rng.choice(["", ",", "s"]))
        rows.append((k, " ".join(w)))
        marks.append((k, 1, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit_crf(docs, labels)
    got = toxicity.tag_toxic(docs, model).collect()
    held = {r.doc_id for r in docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).collect()}
    assert auc([(r.doc_id % 5 == 0, r.toxicity.score) for r in got if r.doc_id in held]) > 0.98
    for r in got:
        for s in r.toxicity.spans:
            assert any(f in r.text[s.start : s.end] for f in foul) and s.probability >= 0.5
    assert sum(bool(r.toxicity.spans) for r in got) > 100
    odd = toxicity.tag_toxic(awkward, model).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r.toxicity.score <= 1 for r in odd)
    assert toxicity.tag_toxic(empty, model).count() == 0
    nothing = toxicity.fit_crf(docs, labels.limit(0))
    assert all(r.toxicity.score < 0.5 for r in toxicity.tag_toxic(awkward, nothing).collect())


def test_toxicity_scores_follow_the_largest_of_all_marginals():
    import numpy as np

    weights = {"knave": 7.0, "meek": 1.0, "mild": 0.5}
    model = toxicity.Crf(weights, -6.0, np.array([[0.5, -0.5], [-0.5, 0.5]]), np.zeros(2), np.array([1.0, 4.0, -3.0]))
    texts = ["plain words\nall plain", "plain words\nmild plain", "plain meek\nplain", "a knave\nplain meek", "plain " * 200, "", None, "\n\n"]
    got = [model.aggregate(m) for m in model.marginals(texts, toxicity._Known(model.emission))]
    for text, x in zip(texts, got):
        every = [np.array([model.emission(w) for w in c]) for c in toxicity.chains(text)]
        m = np.concatenate([toxicity.forward_backward(e[None], np.array([len(e)]), model.trans, model.start)[0][0] for e in every] or [np.zeros(0)])
        assert list(x) == pytest.approx([np.log1p(m[m > toxicity.FAINT].sum()), m.max() if len(m) else 0.0, 1.0])
    scores = [model.score(x) for x in got[:4]]
    assert scores == sorted(set(scores)) and got[2][1] < toxicity.FAINT  # no ties below FAINT
    assert (toxicity.TRAINING_DOCS, toxicity.STEPS, toxicity.RATE) == (4000, 30, 0.35)


def test_forward_backward_against_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    trans, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    e, n = rng.normal(size=(2, 5)), np.array([5, 3])
    m, pairs, logz = toxicity.forward_backward(e, n, trans, start)
    total, z2 = np.zeros((2, 2)), 0.0
    for c in range(2):
        weight = {}
        for y in itertools.product((0, 1), repeat=int(n[c])):
            weight[y] = np.exp(start[y[0]] + sum(e[c, t] * y[t] for t in range(n[c])) + sum(trans[y[t], y[t + 1]] for t in range(n[c] - 1)))
        z = sum(weight.values())
        z2 += np.log(z)
        for t in range(n[c]):
            assert m[c, t] == pytest.approx(sum(w for y, w in weight.items() if y[t]) / z)
        for y, w in weight.items():
            for t in range(n[c] - 1):
                total[y[t], y[t + 1]] += w / z
    assert pairs == pytest.approx(total) and logz == pytest.approx(z2)
