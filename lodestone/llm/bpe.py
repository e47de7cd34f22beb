"""BPE encoding and decoding by an index of pair occurrences."""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import fresh, small_batches

#: Distinct words whose encodings a task keeps; beyond that it starts anew, which costs time only.
KEEP_WORDS = 300_000
#: Texts of about so many characters are encoded together.
SLICE_CHARS = 4_000_000


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where printable, else the next letters from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordBpe:
    """A vocabulary with word ends: NFC, white space made single spaces, lower case, split, then merges by rank."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {k: t for t, k in self.ids.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.decimal = {k: str(k) for k in self.tokens}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # a pair is one number: first symbol * 2^16 + second
        self.rank = {self.ids[a] << 16 | self.ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.pairs = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in pairs]
        made: dict[int, int] = {}
        for rank, (_, _, whole) in enumerate(self.pairs):
            made[whole] = max(rank, made.get(whole, -1))
        # then a merge never makes a pair of a lower rank, and ascending ranks over all words are each word's own order
        if max(self.ids.values()) >= 1 << 16 or any(made.get(a, -1) > rank or made.get(b, -1) > rank for rank, (a, b, _) in enumerate(self.pairs)):
            raise ValueError("a merge comes before the merge that makes its part, or there are too many symbols")
        letters = _byte_letters()
        self.inner = [self.ids[letters[b]] for b in range(256)]
        self.last = [self.ids[letters[b] + self.end] for b in range(256)]
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.space = regex.compile(r"\s+")
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = regex.compile("|".join(regex.escape(x) for x in self.added)) if self.added else None
        # texts of these characters alone are in NFC, and white space in them is what str.split() splits at
        self.plain = re.compile("[\\t-\\r -~\u00c0-\u024f]*")
        self.plain_split = re.compile(r"[^\W\d_]+|\d|'s|'t|'re|'ve|'m|'ll|'d|(?:[^\s\w]|_)+")
        self.known: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, str, str]] = {}

    def forget(self) -> None:
        self.known.clear()
        self.chunks.clear()

    def normal(self, text: str) -> str:
        # each character by itself is lower-cased, so that a final sigma isn't a case of its own
        text = self.space.sub(" ", unicodedata.normalize("NFC", text))
        low = text.lower()
        return "".join(map(str.lower, text)) if "\u03a3" in text else low

    def words(self, text: str) -> list[str | int]:
        """Pre-tokens in order; an added token's number where its content stands."""
        if self.special is None or "<|" not in text:
            return self.split.findall(self.normal(text))
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self.split.findall(self.normal(text[at : m.start()]))
            out.append(self.added[m[0]])
            at = m.end()
        return out + self.split.findall(self.normal(text[at:]))

    def learn(self, words: set[str]) -> None:
        """Encodes words that aren't known yet, all together.

        The index maps each pair with a rank to the places where it occurs; ranks are taken in ascending order, each
        applied at all its places from left to right, and the lists of the neighbouring pairs are updated.
        """
        if len(self.known) + len(words) > KEEP_WORDS:
            self.known.clear()
        todo = [w for w in words if w not in self.known]
        inner, last, rank_of, pairs = self.inner, self.last, self.rank.get, self.pairs
        symbol: list[int] = []
        starts: list[int] = []
        for w in todo:
            starts.append(len(symbol))
            raw = w.encode("utf-8")
            symbol += [inner[b] for b in raw]
            symbol[-1] = last[raw[-1]]
            symbol.append(-1)
        n = len(symbol)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        places: dict[int, list[int]] = {}
        for i, (x, y) in enumerate(zip(symbol, symbol[1:])):
            if x >= 0 and y >= 0 and (r := rank_of(x << 16 | y)) is not None:
                if r in places:
                    places[r].append(i)
                else:
                    places[r] = [i]
        active = list(places)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            at = places.pop(rank)
            a, b, whole = pairs[rank]
            at.sort()
            for i in at:
                j = right[i]
                if symbol[i] != a or j >= n or symbol[j] != b:
                    continue  # an earlier merge took a part of it
                symbol[i], symbol[j] = whole, -2
                k = right[i] = right[j]
                if k < n:
                    left[k] = i
                    if (y := symbol[k]) >= 0 and (r := rank_of(whole << 16 | y)) is not None:
                        if r in places:
                            places[r].append(i)
                        else:
                            places[r] = [i]
                            heapq.heappush(active, r)
                p = left[i]
                if p >= 0 and (x := symbol[p]) >= 0 and (r := rank_of(x << 16 | whole)) is not None:
                    if r in places:
                        places[r].append(p)
                    else:
                        places[r] = [p]
                        heapq.heappush(active, r)
        for w, i in zip(todo, starts):
            out = []
            while i < n and symbol[i] != -1:
                out.append(symbol[i])
                i = right[i]
            self.known[w] = tuple(out)

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.words(t) for t in texts]
        self.learn({w for words in split for w in words if isinstance(w, str)})
        known = self.known
        return [[k for w in words for k in (known[w] if isinstance(w, str) else (w,))] for words in split]

    def _chunks(self, texts: list[str]) -> list[list[str] | None]:
        """Plain texts in lower case, cut at white space, which no word crosses; None for other texts."""
        fits = self.plain.fullmatch
        return [t.lower().split() if fits(t) and "<|" not in t else None for t in texts]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, SHA-256 of the decimal ids joined by a space, SHA-256 of the decoded text) of each text."""
        cut = self._chunks(texts)
        if len(self.chunks) > KEEP_WORDS:
            self.chunks.clear()
        new = [c for c in {c for words in cut if words for c in words} if c not in self.chunks]
        parts = [self.plain_split.findall(c) for c in new]
        self.learn({w for p in parts for w in p})
        known, chunks, decimal, token = self.known, self.chunks, self.decimal, self.tokens
        for c, p in zip(new, parts):
            ids = known[p[0]] if len(p) == 1 else [k for w in p for k in known[w]]
            chunks[c] = (len(ids), " ".join([decimal[k] for k in ids]), " ".join([token[k] for k in ids]))
        rest = iter(self.encode([t for t, words in zip(texts, cut) if words is None]))
        out = []
        for words in cut:
            if words is None:
                ids = next(rest)
                n, a, b = len(ids), " ".join(map(str, ids)), self.decode(ids)
            else:
                got = [chunks[c] for c in words]
                n, a, b = sum([g[0] for g in got]), " ".join([g[1] for g in got]), " ".join([g[2] for g in got])
            out.append((n, hashlib.sha256(a.encode()).hexdigest(), hashlib.sha256(b.encode()).hexdigest()))
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, as a vocabulary without a decoder is decoded."""
        return " ".join([self.tokens[k] for k in ids])


_loaded: dict[int, WordBpe] = {}


def _model(sent) -> WordBpe:
    key = hash(sent.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordBpe(sent.value)
    return _loaded[key]


def _runs(texts: list[str]):
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= SLICE_CHARS:
            yield part
            part, n = [], 0
    if part:
        yield part


def encode(docs: DataFrame, vocabulary: str, text: str = "text", digests: bool = False) -> DataFrame:
    """Adds ``ids`` (array of int) to every row; whole texts, null as empty (no ids).

    ``vocabulary`` is the path of a tokenizers JSON file with a word-end BPE model; the driver reads it and sends its
    text (a fixed size, about 2 MB) to the executors. With ``digests``, adds instead n_tokens, ids_sha256 and
    decoded_sha256: of the decimal ids joined by a space and of the decoded text. Repeated rows are encoded alike.
    """
    with open(vocabulary, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids"]
    new = [fresh(docs, c) for c in new]

    def work(batches):
        model = _model(sent)
        model.forget()
        gc.disable()  # no cycles are made, and collections would walk all that is kept
        try:
            for batch in batches:
                texts, columns = [x.as_py() or "" for x in batch.column(at)], []
                if digests:
                    got = []
                    for part in _runs(texts):
                        got += model.digests(part)
                    columns = [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())]
                else:
                    columns = [pa.array([x for part in _runs(texts) for x in model.encode(part)], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *new])
        finally:  # also after an error or a limit: Spark uses the worker again
            gc.enable()
            model.forget()  # an idle worker keeps the vocabulary only

    kinds = ("long", "string", "string") if digests else ("array<int>",)
    added = docs.select(*[F.lit(None).cast(k).alias(c) for c, k in zip(new, kinds)]).schema.fields
    return docs.mapInArrow(work, type(docs.schema)([*docs.schema.fields, *added]))


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (string) to rows with an array of ids; null ids give null."""
    with open(vocabulary, encoding="utf-8") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())
    at, new = encoded.columns.index(ids), fresh(encoded, "decoded")

    def work(batches):
        model = _model(sent)
        for batch in batches:
            got = [None if (x := v.as_py()) is None else model.decode(x) for v in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], [*batch.schema.names, new])

    return encoded.mapInArrow(work, type(encoded.schema)([*encoded.schema.fields, *encoded.select(F.lit(None).cast("string").alias(new)).schema.fields]))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    """The operator over all documents, ids and decoded texts as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, vocabulary_path(), digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
