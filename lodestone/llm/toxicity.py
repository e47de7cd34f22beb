"""Toxicity: a linear-chain conditional random field over tokens, aggregated to document scores and offsets."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import durable, fresh, small_batches

#: Documents to learn from, at most so many of each class (those with the lowest hash): a documented bound.
TRAINING_DOCS = 4000
#: A token's traits are its word and its first letters of these lengths.
PREFIXES = (3, 4, 5, 6, 7)
#: Traits with a weight, at most; also the bound on what is sent to the executors.
MOST_TRAITS = 20_000
#: Tokens of a chain; longer lines are cut into chains of this length.
CHAIN = 64
STEPS, RATE, DECAY = 30, 0.35, 0.02
#: Marginals up to this one aren't summed in a document's score; its largest marginal is over all tokens.
FAINT = 0.05
#: Words whose emissions a task keeps.
KEEP_WORDS = 400_000
TRIM = ".,;:!?\"'()[]{}|*#$%&<>_-+=~`^/\\"


def traits(token: str) -> list[str]:
    """What a token is known by: its lower-case word without marks around it, and prefixes of that."""
    w = token.lower().strip(TRIM)
    return [w, *[f"{w[:k]}~" for k in PREFIXES if len(w) >= k]] if w else []


def chains(text: str | None) -> list[list[str]]:
    """Tokens of the whole text: a chain per line, long lines cut."""
    out = []
    for line in (text or "").split("\n"):
        words = line.split()
        out += [words[k : k + CHAIN] for k in range(0, len(words), CHAIN)]
    return out


def forward_backward(emission: np.ndarray, length: np.ndarray, trans: np.ndarray, start: np.ndarray, counted: bool = True):
    """Marginals of the second state, pair marginals summed (zeros unless ``counted``), and log partition of padded chains.

    ``emission``: (chains, steps) score of the second state over the first. Probabilities are scaled at each step.
    """
    n, steps = emission.shape
    e = np.exp(np.clip(emission, -30, 30))
    m, first = np.exp(trans), np.exp(start)
    alpha, beta, scale = np.zeros((steps, n, 2)), np.ones((steps, n, 2)), np.ones((steps, n))
    a = np.stack([np.full(n, first[0]), first[1] * e[:, 0]], axis=1)
    live = np.arange(steps)[:, None] < length[None, :]
    for t in range(steps):
        if t:
            p = alpha[t - 1]
            a = np.stack([p[:, 0] * m[0, 0] + p[:, 1] * m[1, 0], (p[:, 0] * m[0, 1] + p[:, 1] * m[1, 1]) * e[:, t]], axis=1)
        s = a.sum(axis=1)
        scale[t] = np.where(live[t], s, 1.0)
        alpha[t] = a / s[:, None]
    pairs = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        nb = beta[t + 1]
        w = np.stack([nb[:, 0], nb[:, 1] * e[:, t + 1]], axis=1) / scale[t + 1][:, None]
        b = np.stack([m[0, 0] * w[:, 0] + m[0, 1] * w[:, 1], m[1, 0] * w[:, 0] + m[1, 1] * w[:, 1]], axis=1)
        on = live[t + 1]
        beta[t] = np.where(on[:, None], b, 1.0)
        if not counted:
            continue
        x = alpha[t][on][:, :, None] * m[None] * w[on][:, None, :]
        pairs += (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    g = alpha * beta
    marginal = (g[:, :, 1] / g.sum(axis=2)).T
    return np.where(live.T, marginal, 0.0), pairs, float(np.log(scale).sum())


def _padded(emission: np.ndarray, length: np.ndarray):
    """Chains (one after the other in ``emission``) of like length as matrices: (matrix, lengths, places in ``emission``, mask)."""
    start = np.cumsum(length) - length
    low = 0
    for high in (8, 16, 32, CHAIN):
        at = np.flatnonzero((length > low) & (length <= high))
        low = high
        for k in range(0, len(at), 4096):
            part = at[k : k + 4096]
            mask = np.arange(high)[None, :] < length[part][:, None]
            place = np.where(mask, start[part][:, None] + np.arange(high)[None, :], 0)
            yield np.where(mask, emission[place], 0.0), length[part], place, mask


class _Known(dict):
    """Emissions of words, computed when first asked for."""

    def __init__(self, compute):
        self.compute = compute

    def __missing__(self, word):
        if len(self) > KEEP_WORDS:
            self.clear()
        self[word] = value = self.compute(word)
        return value


class Crf:
    """Weights of the field: traits, transitions, start; and of the document score. A bounded size."""

    def __init__(self, weights: dict[str, float], bias: float, trans: np.ndarray, start: np.ndarray, document: np.ndarray):
        self.weights, self.bias, self.trans, self.start, self.document = weights, bias, trans, start, document
        self.heads = {t[: PREFIXES[0]] for t in weights}
        self.quiet = self._quiet()

    def emission(self, token: str) -> float:
        w = token.lower().strip(TRIM)
        if w[: PREFIXES[0]] not in self.heads:
            return self.bias
        return self.bias + sum([self.weights.get(t, 0.0) for t in traits(token)])

    def _quiet(self) -> float:
        """An emission such that chains with none above have no marginal above FAINT; exact, not a guess.

        Where neighbours attract each other, marginals grow with every emission; so a chain of CHAIN such tokens, and
        all shorter ones, bound them. Without attraction no chain is passed over.
        """
        if self.trans[0, 0] + self.trans[1, 1] < self.trans[0, 1] + self.trans[1, 0]:
            return -np.inf
        lengths = np.arange(1, CHAIN + 1)
        low, high = -30.0, 10.0
        for _ in range(30):
            middle = (low + high) / 2
            m, _, _ = forward_backward(np.full((CHAIN, CHAIN), middle), lengths, self.trans, self.start)
            low, high = (middle, high) if m.max() <= FAINT else (low, middle)
        return low if low > -29 else -np.inf

    def marginals(self, texts: list[str | None], known: dict) -> list[list[tuple[int, np.ndarray]]]:
        """For each text: (number of its first token, marginals of its tokens) of the chains that may matter.

        Chains without a marginal above FAINT matter where the text has no other: they hold its largest marginal then.
        """
        get, quiet, chosen, lengths, owners = known.__getitem__, self.quiet, [], [], []
        out: list[list[tuple[int, np.ndarray]]] = [[] for _ in texts]
        below = []
        for k, text in enumerate(texts):
            n, faint = 0, []
            for c in chains(text):
                e = list(map(get, c))
                if max(e) > quiet:
                    chosen += e
                    lengths.append(len(e))
                    owners.append((k, n))
                else:
                    faint.append((n, e))
                n += len(c)
            if faint:
                below.append((k, faint))
        self._solve(chosen, lengths, owners, out)
        chosen, lengths, owners = [], [], []
        for k, faint in below:
            if not any(m.max() > FAINT for _, m in out[k]):
                for n, e in faint:
                    chosen += e
                    lengths.append(len(e))
                    owners.append((k, n))
        self._solve(chosen, lengths, owners, out)
        return out

    def _solve(self, chosen: list[float], lengths: list[int], owners: list[tuple[int, int]], out: list[list[tuple[int, np.ndarray]]]) -> None:
        """Adds to ``out`` the marginals of chains given by their emissions, one after the other."""
        if not chosen:
            return
        emission, length = np.array(chosen), np.array(lengths)
        flat = np.zeros(len(emission))
        for matrix, own, place, mask in _padded(emission, length):
            m, _, _ = forward_backward(matrix, own, self.trans, self.start, counted=False)
            flat[place[mask]] = m[mask]
        for (k, n), a, b in zip(owners, np.cumsum(length) - length, np.cumsum(length)):
            out[k].append((n, flat[a:b]))

    def aggregate(self, found: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Of a document's marginals: the sum of those above FAINT (log), the largest of all; and a constant."""
        m = np.concatenate([x for _, x in found]) if found else np.zeros(0)
        sure = m[m > FAINT]
        return np.array([np.log1p(sure.sum()), m.max() if len(m) else 0.0, 1.0])

    def score(self, features: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-features @ self.document)))


def _training(docs: DataFrame, labels: DataFrame, text: str, key: str) -> DataFrame:
    """(text, toxic): a bounded sample, the lowest hashes of each class."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max("toxic").cast("int").alias("toxic"))
    held = (F.crc32(F.col("k").cast("string").cast("binary")) % 3) == 1
    known = known.where(~held).withColumn("h", F.xxhash64("k"))
    chosen = [known.where(F.col("toxic") == v).orderBy("h", "k").limit(TRAINING_DOCS) for v in (0, 1)]
    chosen = chosen[0].union(chosen[1])
    return docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k").select("text", "toxic")


def _evidence(training: DataFrame) -> dict[str, tuple[int, int]]:
    """trait -> (toxic documents, other documents) that hold it; the MOST_TRAITS strongest reach the driver."""

    def counted(batches):
        total: Counter = Counter()
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1).to_pylist()):
                for t in {t for c in chains(x.as_py()) for w in c for t in traits(w)}:
                    total[t, y] += 1
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in total]), pa.array([y for _, y in total], pa.int64()), pa.array(list(total.values()), pa.int64())], ["t", "y", "n"])

    sums = training.mapInArrow(counted, "t string, y long, n long").groupBy("t").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    best = sums.where("a >= 3").orderBy(F.desc(F.col("a") / (F.col("b") + 1.0)), F.desc("a"), "t").limit(MOST_TRAITS)
    return {r.t: (r.a, r.b) for r in best.collect()}


def fit_crf(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Crf:
    """Learns the field on a bounded sample of labelled documents.

    Tokens are labelled from the documents' labels: in a toxic document, tokens with a trait that is nearly only found
    in toxic documents are toxic; all others, and all tokens of other documents, aren't. The likelihood's gradient is
    the observed minus the expected counts of traits and transitions, from forward-backward in each partition, summed
    on the driver (one vector of bounded size a partition). Documents' marginals then fit a logistic score, weighted
    to the classes' shares of all labels learned from. Without toxic labels every score is near zero.
    """
    training = durable(_training(docs, labels, text, key).repartition(12), "training")
    shares = {r.toxic: r["count"] for r in training.groupBy("toxic").count().collect()}
    found = _evidence(training)
    if not shares.get(1) or not shares.get(0) or not found:
        return Crf({}, -5.0, np.zeros((2, 2)), np.zeros(2), np.array([0.0, 0.0, -5.0]))
    pure = {t for t, (a, b) in found.items() if a >= 4 and a / shares[1] >= 30 * (b + 0.5) / shares[0] * (3 if "~" in t and len(t) < 6 else 1)}
    number = {t: k for k, t in enumerate(sorted(found))}
    size = len(number)

    def tokens(batches):
        """Each document's chains as trait numbers and labels."""
        for batch in batches:
            numbers, labels_, lengths, ys = [], [], [], []
            for x, y in zip(batch.column(0), batch.column(1).to_pylist()):
                c = [[(own := traits(w), [number[t] for t in own if t in number]) for w in line] for line in chains(x.as_py())]
                numbers.append([[k for _, k in line] for line in c])
                labels_.append([[int(y == 1 and any(t in pure for t in own)) for own, _ in line] for line in c])
                lengths.append(sum(map(len, c)))
                ys.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.list_(pa.list_(pa.list_(pa.int32())))), pa.array(labels_, pa.list_(pa.list_(pa.int8()))), pa.array(ys, pa.int32())], ["traits", "tags", "toxic"])

    tagged = durable(training.mapInArrow(tokens, "traits array<array<array<int>>>, tags array<array<tinyint>>, toxic int"), "tagged")
    theta = np.zeros(size + 7)  # traits, bias, transitions, start
    theta[size] = -3.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        def gradient(batches, theta=theta):
            g = np.zeros(size + 7)
            trans, start = theta[size + 1 : size + 5].reshape(2, 2), theta[size + 5 :]
            for batch in batches:
                of_chain = batch.column(0).flatten()
                of_token = of_chain.flatten()
                length, tags = of_chain.value_lengths().to_numpy(), batch.column(1).flatten().flatten().to_numpy().astype(np.int64)
                if not len(tags):
                    continue
                count, own = of_token.value_lengths().to_numpy(), of_token.flatten().to_numpy()
                token = np.repeat(np.arange(len(tags)), count)
                emission = theta[size] + np.bincount(token, weights=theta[own], minlength=len(tags))
                rest = tags.astype(float)
                first_of = np.zeros(len(tags), bool)
                first_of[(np.cumsum(length) - length)[length > 0]] = True
                for matrix, n, place, mask in _padded(emission, length):
                    m, pairs, _ = forward_backward(matrix, n, trans, start)
                    rest[place[mask]] -= m[mask]
                    g[size + 1 : size + 5] -= pairs.ravel()
                g[:size] += np.bincount(own, weights=rest[token], minlength=size)
                g[size] += rest.sum()
                g[size + 6] += rest[first_of].sum()
                g[size + 5] -= rest[first_of].sum()
                inner = np.flatnonzero(~first_of)
                np.add.at(g, size + 1 + 2 * tags[inner - 1] + tags[inner], 1)
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary())], ["g"])

        total = np.sum([np.frombuffer(r.g) for r in tagged.mapInArrow(gradient, "g binary").collect()], axis=0) - DECAY * theta
        first, second = 0.9 * first + 0.1 * total, 0.99 * second + 0.01 * total**2
        theta = theta + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    model = Crf({t: float(theta[k]) for t, k in number.items()}, float(theta[size]), theta[size + 1 : size + 5].reshape(2, 2), theta[size + 5 :], np.zeros(3))

    def aggregated(batches):
        known = _Known(model.emission)
        for batch in batches:
            rows = [model.aggregate(m) for m in model.marginals(batch.column(0).to_pylist(), known)]
            yield pa.RecordBatch.from_arrays([pa.array([r.tolist() for r in rows], pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    seen = training.mapInArrow(aggregated, "x array<double>, toxic int").collect()  # bounded by 2 * TRAINING_DOCS
    known = labels.where((F.crc32(F.col(key).cast("string").cast("binary")) % 3) != 1).agg(F.avg("toxic")).first()[0] or 0.5
    x, y = np.array([r.x for r in seen]), np.array([r.toxic for r in seen])
    weight = np.where(y == 1, known / max(1, (y == 1).sum()), (1 - known) / max(1, (y == 0).sum())) * len(y)
    beta = np.zeros(3)
    for _ in range(30):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        beta = beta + np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * beta)
    model.document = beta
    return model


def tag_toxic(docs: DataFrame, model: Crf, text: str = "text") -> DataFrame:
    """All columns and ``toxicity``: struct(score, spans: array of (start, end, probability)).

    Whole texts are tagged; ``spans`` are tokens whose marginal is at least 0.5, in code points, neighbours joined.
    Null and empty texts have no spans and the score of a text without toxic tokens.
    """
    small_batches(docs.sparkSession)
    at, out = docs.columns.index(text), fresh(docs, "toxicity")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = "struct<score:double,spans:array<struct<start:long,end:long,probability:double>>>"
    arrow = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])))])
    word = re.compile(r"\S+")

    def spans(content: str, found: list[tuple[int, np.ndarray]]) -> list[dict]:
        likely = {n + int(k): float(m[k]) for n, m in found for k in np.flatnonzero(m >= 0.5)}
        if not likely:
            return []
        got, i = [], 0
        for line in re.finditer(r"[^\n]+", content):
            for m in word.finditer(content, line.start(), line.end()):
                if i in likely:
                    p = likely[i]
                    if got and got[-1]["next"] == i:
                        got[-1] |= {"end": m.end(), "next": i + 1, "probability": max(p, got[-1]["probability"])}
                    else:
                        got.append({"start": m.start(), "end": m.end(), "probability": p, "next": i + 1})
                i += 1
        return [{k: s[k] for k in ("start", "end", "probability")} for s in got]

    def tagged(batches):
        crf = sent.value
        known = _Known(crf.emission)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            got = [{"score": crf.score(crf.aggregate(m)), "spans": spans(t or "", m)} for t, m in zip(texts, crf.marginals(texts, known))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, arrow)], [*batch.schema.names, out])

    added = docs.select(F.lit(None).cast(kind).alias(out)).schema.fields
    return docs.mapInArrow(tagged, type(docs.schema)([*docs.schema.fields, *added]))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """The operator over all documents, learning from the labels outside the held-out part."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit_crf(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3) == 1
    rows = tag_toxic(docs, model)
    score = F.col("toxicity.score")
    return rows.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.7).cast("int").alias("predicted"))
