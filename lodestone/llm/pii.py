"""Personal data: keyed, type-consistent surrogates for detected entities, checked against collisions."""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import durable, fresh, small_batches

#: Given names by gender, in the Latin and the Cyrillic script. Beside a surname they tell a person
#: without a title too.
NAMES = {
    ("f", "latin"): "Ada Alice Anna Beate Carla Chloe Clara Diana Elena Emma Eva Greta Hanna Ines Irene Jana Julia Laura Lea Lucia Marie Marta Nora Olga Paula Rosa Sara Sofia Tanja Vera".split(),
    ("m", "latin"): "Adam Alan Anton Bruno Carlos David Diego Emil Erik Felix Frank Georg Hugo Ivan Jan Jorge Karl Leo Louis Lucas Marc Martin Max Nils Oscar Paul Peter Rafael Simon Tomas".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Ксения Мария Нина Ольга Софья".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Олег Павел".split(),
}
#: Titles that precede a name, and their gender where they tell it.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Mx": None, "Sir": "m", "Dame": "f", "Lady": "f", "Dr": None, "Prof": None, "Doctor": None, "Professor": None,
    "Herr": "m", "Herrn": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Señorita": "f", "Sr": "m", "Sra": "f", "Srta": "f", "Don": "m", "Doña": "f", "Dra": "f",
    "Madame": "f", "Mademoiselle": "f", "Monsieur": "m", "Mme": "f", "Mlle": "f", "Docteur": None, "Professeur": None, "Doktor": None,
    "г-н": "m", "г-жа": "f", "Г-н": "m", "Г-жа": "f", "господин": "m", "госпожа": "f", "Господин": "m", "Госпожа": "f",
    "доктор": None, "Доктор": None, "профессор": None, "Профессор": None, "д-р": None, "Д-р": None, "проф": None, "Проф": None,
}
#: Words inside a name that aren't replaced.
PARTICLES = "van von vom der den dem de del della delle di da das do dos du des la las le los el al bin bint ibn ben ter ten te zu zum zur af av y фон де ван".split()
_LETTERS = [c for c in map(chr, (*range(0x41, 0x250), *range(0x400, 0x530))) if c.isalpha()]
_UPPER, _LOWER = ("".join(c for c in _LETTERS if test(c)) for test in (str.isupper, str.islower))
#: A word of a name: McDonald, O'Brien, Anne-Marie, Łukasz; without a possessive 's.
_NAME = rf"[{_UPPER}](?:(?:(?!['’]s\b)['’-])?[{_UPPER}{_LOWER}])*"
_TITLE = rf"(?=[{''.join(sorted({t[0] for t in TITLES}))}])(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")(?:\.[ \u00a0]?|[ \u00a0])[ \u00a0]*"
_PART = rf"(?:(?:{'|'.join(PARTICLES)})[ \u00a0]+)*(?:[dDlL]['’])?(?!{_TITLE})(?:{_NAME}(?<=\w\w)|[{_UPPER}]\.(?=[ \u00a0]?[{_UPPER}]))"
_FIRST = "".join(sorted({n[0] for names in NAMES.values() for n in names}))
_GIVEN = rf"(?=[{_FIRST}])(?:" + "|".join(sorted((n for names in NAMES.values() for n in names), key=len, reverse=True)) + r")(?=[ \u00a0])"
#: In order of preference where matches overlap.
KINDS = (
    ("email", r"(?<![\w.+-])[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("ip", r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d]|\.\d)"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w+.-])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\w-])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", r"(?<![\w.-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])"),
    ("person", rf"\b(?:(?:{_TITLE})+{_PART}|{_GIVEN}[ \u00a0]+{_PART})(?:(?:[ \u00a0]+|(?<=\.)){_PART})*"),
)
_PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS))
#: What a text must hold to have any entity.
_GATE = re.compile(rf"@|\d{{2}}|\b(?:{_TITLE}|{_GIVEN})")
_TITLED, _WORD, _PIECE = re.compile(rf"(?:{_TITLE})+"), re.compile(rf"(?<!\w){_NAME}"), re.compile(rf"[{_UPPER}][{_UPPER}{_LOWER}]+")
#: Alphabets; a character keeps its alphabet, so script, case and format stay.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ")
#: The letters of names beyond these: Ł, Š, Ё and others, by script and case.
ALPHABETS += tuple("".join(c for c in case if not any(c in a for a in ALPHABETS) and (c >= "Ѐ") == cyrillic) for case in (_LOWER, _UPPER) for cyrillic in (False, True))
_OF = {c: (a, k) for a in ALPHABETS for k, c in enumerate(a)}
#: What names are composed of, by script: beginnings and vowels of syllables, and endings of given names and surnames.
SYLLABLES = {
    "latin": ("b d f g h j k l m n p r s t v w z br dr fr gl gr kl kr pl st tr".split(), "a e i o u".split()),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х бр др гр кр пр ст".split(), "а е и о у".split()),
}
GIVEN = {
    ("f", "latin"): "na lia ra ssa line nne".split(), ("m", "latin"): "n r s l las ndo".split(), (None, "latin"): "n na l ra s lis".split(),
    ("f", "cyrillic"): "на лия ра вна ша".split(), ("m", "cyrillic"): "н р й слав мир".split(), (None, "cyrillic"): "н на р ра".split(),
}
SURNAME = {
    ("f", "latin"): "ler nsen man ck rt lli nson".split(), ("m", "latin"): "ler nsen man ck rt lli nson".split(), (None, "latin"): "ler nsen man ck rt lli nson".split(),
    ("f", "cyrillic"): "нова рина лева вская".split(), ("m", "cyrillic"): "нов рин лев вский".split(), (None, "cyrillic"): "нко рян лчук".split(),
}
#: Rounds in which colliding surrogates are drawn again.
ROUNDS = 20
#: From this draw on a surrogate is longer than its entity, and more so with each draw: no list or pattern is too small.
LONGER = 6


def entities(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, leftmost first, without overlaps.

    Persons are told by a title, or by a listed given name before a surname.
    """
    if not text or not _GATE.search(text):
        return []
    found = [(m.lastgroup, m.start(), m.end()) for m in _PATTERN.finditer(text)]
    titled = [bool(k == "person" and _TITLED.match(text, a, b)) for k, a, b in found]
    if any(titled):  # a name without a title that repeats words of a titled one is a further mention of that
        known = {x for (_, a, b), t in zip(found, titled) if t for x in _PIECE.findall(text, a, b)}
        found = [(k, a, b) for (k, a, b), t in zip(found, titled) if k != "person" or t or not known.issuperset(_PIECE.findall(text, a, b))]
    return found


def further_mentions(text: str, found: list[tuple[str, int, int]], made: list[str]) -> list[tuple[int, int, int, str]]:
    """(start, end, number in ``found``, replacement) of the other mentions of the persons' name words in the text.

    ``made``: the surrogates of ``found``. A word that several persons have follows the last of them named before it,
    else the first. Parts of a hyphenated name are known by themselves too; single letters aren't.
    """
    parts: list[tuple[int, dict[str, str]]] = []
    known: dict[str, tuple[int, str]] = {}
    for k, ((kind, a, b), new) in enumerate(zip(found, made)):
        if kind == "person":
            own = {}
            for was, now in zip(_names(text[a:b])[1][1::2], _names(new)[1][1::2]):
                own |= {w: n for w, n in [(was, now), *zip(_PIECE.findall(was), _PIECE.findall(now))] if len(w) > 1}
            parts.append((k, own))
    if not parts:
        return []
    for k, own in reversed(parts):
        known |= {w: (k, n) for w, n in own.items()}
    out, ahead, spans = [], iter(parts), [*found, ("", len(text), len(text))]
    last = 0
    for kind, a, b in spans:
        for m in _WORD.finditer(text, last, a):
            for x in [m] if m[0] in known else _PIECE.finditer(text, m.start(), m.end()):
                if x[0] in known:
                    out.append((x.start(), x.end(), *known[x[0]]))
        if kind == "person":
            k, own = next(ahead)
            known |= {w: (k, n) for w, n in own.items()}
        last = b
    return out


def _names(text: str) -> tuple[str, list[str]]:
    """A person's titles, and the rest: what is between the words of the name, and at odd places these words."""
    head = m[0] if (m := _TITLED.match(text)) else ""
    return head, re.split(f"({_NAME})", text[len(head) :])


def _permuted(value: int, size: int, key: bytes) -> int:
    """A keyed permutation of 0 .. size - 1: a Feistel network on the next even number of bits, walked into range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(6):
            digest = hmac.digest(key, bytes([r]) + right.to_bytes((half + 7) // 8, "big"), "sha256")
            left, right = right, left ^ (int.from_bytes(digest * (half // 256 + 1), "big") & mask)
        value = (left << half) | right
        if value < size:
            return value


def _like(text: str, key: bytes) -> str:
    """Another text of the same pattern: each letter and digit stays in its alphabet, marks stay. One-to-one."""
    at = [(k, *_OF[c]) for k, c in enumerate(text) if c in _OF]
    if not at:
        return text
    value = size = 0
    for n, (_, alphabet, k) in enumerate(at):
        value, size = (value * len(alphabet) + k, size * len(alphabet)) if n else (k, len(alphabet))
    value, out = _permuted(value, size, key), list(text)
    for k, alphabet, _ in reversed(at):
        value, c = divmod(value, len(alphabet))
        out[k] = alphabet[c]
    return "".join(out)


def _luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = sum((d := int(c) * (2 - k % 2)) // 10 + d % 10 for k, c in enumerate(reversed(digits)))
    return -total % 10


def _composed(piece: str, gender: str | None, endings: dict, more: int, key: bytes) -> str:
    """A pronounceable name for a run of letters, of its script and case; one letter stays one letter.

    It has two syllables and an ending, for long names one syllable more, and ``more`` besides.
    """
    if len(piece) == 1:
        return _like(piece, key)
    script = "cyrillic" if piece[0] >= "Ѐ" else "latin"
    parts, last = SYLLABLES[script], endings[gender, script]
    count, again = 2 + (len(piece) > 8) + more, 0
    while True:
        value, out = int.from_bytes(hmac.digest(key, f"{again}|{gender if endings is GIVEN else ''}|{piece.lower()}".encode(), "sha512"), "big"), ""
        for _ in range(count):
            for choice in parts:
                value, k = divmod(value, len(choice))
                out += choice[k]
        out = (out + last[value % len(last)]).capitalize()
        out = out.upper() if piece.isupper() else out
        if out != piece and out not in TITLES and out.lower() not in PARTICLES:
            return out
        again += 1


def _name(rest: list[str], gender: str | None, draw: int, key: bytes) -> None:
    """Replaces the words of a name, at the odd places of ``rest``; the last one is longer with each draw."""
    words = rest[1::2]
    listed = any(words[0] in names for names in NAMES.values())
    for k, word in enumerate(words):
        endings = GIVEN if k < len(words) - 1 or k == 0 and listed else SURNAME
        more = draw if k == len(words) - 1 else 0
        rest[2 * k + 1] = re.sub(rf"[{_UPPER}{_LOWER}]+", lambda m: _composed(m[0], gender, endings, more, key), word)


def plain(kind: str, text: str) -> str:
    """The entity without what is only its layout: +44 20 7946 0958 and +442079460958 are one."""
    if kind == "phone":
        text = text.replace("(0)", "")
    return re.sub(r"[^0-9A-Za-z+]", "", text) if kind in ("phone", "card", "iban") else text


def _with_digits(text: str, digits: str) -> str:
    """``text`` with its digits, but a trunk zero in brackets, replaced in order."""
    new = iter(digits)
    return "".join(part if part == "(0)" else re.sub(r"\d", lambda _: next(new), part) for part in re.split(r"(\(0\))", text))


def surrogate(kind: str, text: str, key: bytes, draw: int = 0) -> str:
    """The replacement of an entity: of its kind and format, fixed by key and draw.

    Names are composed of syllables, longer with each draw; all else is one-to-one for each draw. It never equals ``text``
    where the pattern has another text. From draw LONGER on an e-mail's local part is lengthened by keyed letters,
    numbers by digits; an IP address becomes one of version 6.
    """
    out = _drawn(kind, text, key, draw)
    if draw < LONGER or kind == "person":
        return out
    value = int.from_bytes(hmac.digest(key, f"longer|{kind}|{draw}|{plain(kind, text)}".encode("utf-8", "surrogatepass"), "sha512"), "big")
    size = 8 + 2 * (draw - LONGER)
    if kind == "ip":
        return _version6(value)
    alphabet = ALPHABETS[1] if kind == "email" else ALPHABETS[0]
    more = "".join(alphabet[value // len(alphabet) ** k % len(alphabet)] for k in range(size))
    return out.replace("@", more + "@") if kind == "email" else out + more


def _version6(value: int) -> str:
    """A unique local address of IP version 6."""
    return ":".join(["fd" + f"{value % 2**8:02x}", *(f"{value >> 8 + 16 * k & 0xFFFF:04x}" for k in range(7))])


def _drawn(kind: str, text: str, key: bytes, draw: int) -> str:
    """A surrogate of the entity's own length."""
    own = hmac.digest(key, f"{kind}|{draw}".encode(), "sha256")
    for _ in range(4):
        if kind == "email":
            local, _, domain = text.rpartition("@")
            name, _, top = domain.rpartition(".")
            out = f"{_like(local, own)}@{_like(name, own)}.{top}"
        elif kind == "ip":
            value = int.from_bytes(bytes(map(int, text.split("."))), "big")
            out = ".".join(map(str, _permuted(value, 1 << 32, own).to_bytes(4, "big")))
        elif kind == "phone":
            digits = plain(kind, text).lstrip("+")
            kept = 0 if text[0] != "+" else 1 if digits[0] in "17" else 2  # about the country's code
            out = _with_digits(text, digits[:kept] + _like(digits[kept:], own))
        elif kind == "card":
            number = plain(kind, text)
            valid, made = _luhn(number[:-1]) == int(number[-1]), number
            while True:  # numbers that pass the check digit stay among such, others among others
                made = made[0] + _like(made[1:], own)
                if (_luhn(made[:-1]) == int(made[-1])) == valid:
                    break
            out = _with_digits(text, made)
        elif kind == "person":
            head, rest = _names(text)
            gender = next((g for t in re.findall(r"[\w-]+", head) if (g := TITLES[t])), None)
            gender = gender or next((g for (g, _), names in NAMES.items() if rest[1] in names), None)
            _name(rest, gender, draw, own)
            out = head + "".join(rest)
        elif kind == "iban":
            out = text[:2] + _like(text[2:], own)
        else:
            out = _like(text, own)
        if out != text:
            return out
        own = hmac.digest(own, b"again", "sha256")
    return out


def identity(kind: str, text: str, key: bytes) -> str:
    """Under which all mentions of an entity meet, in whatever layout; doesn't tell the entity."""
    return hmac.new(key, f"{kind}|{plain(kind, text)}".encode("utf-8", "surrogatepass"), hashlib.sha256).hexdigest()[:32]


def draws(found: DataFrame, key: bytes) -> DataFrame | None:
    """(id, draw) of the entities whose first surrogate collides; None where none does.

    ``found``: (id, kind, text), one row each. Surrogates that two entities share, or that equal another entity, are
    drawn again for all but the smallest id, until none collides; from draw LONGER on the room for them grows with each
    draw, so the number of entities doesn't matter. Comparisons are grouped counts and joins by hash.
    """
    @F.pandas_udf("string")
    def drawn(kind, text, draw):
        return kind.combine(text, lambda k, t: (k, t)).combine(draw, lambda p, d: identity(p[0], surrogate(*p, key, int(d)), key))

    now = found.withColumn("draw", F.lit(0))
    changed = False
    for round_ in range(ROUNDS):
        now = durable(now.withColumn("made", drawn("kind", "text", "draw")), "surrogates")
        shared = now.groupBy("made").agg(F.min(F.struct("draw", "id"))["id"].alias("first"), F.count("*").alias("n")).where("n > 1")
        losers = now.join(shared, "made").where("id <> first").select("id").union(now.join(found.select(F.col("id").alias("made")), "made", "left_semi").select("id")).distinct()
        losers = durable(losers, "losers")
        if not losers.limit(1).count():
            break
        changed = True
        if round_ == ROUNDS - 1:
            raise RuntimeError(f"surrogates still collide after {ROUNDS} rounds")
        now = now.drop("made").join(losers.withColumn("again", F.lit(1)), "id", "left").withColumn("draw", F.col("draw") + F.coalesce("again", F.lit(0))).drop("again")
    return now.where("draw > 0").select("id", "draw") if changed else None


def pseudonymize(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with the entities of ``text`` replaced, and ``surrogates``.

    ``surrogates``: array of (kind, start, end, id), offsets in the original text in code points; ``id`` is the same for
    all mentions of an entity in all rows. E-mail and IP addresses, IBANs, phone, social security and card numbers,
    names after a title, and the words of such a name elsewhere in the same text are replaced by others of the same kind, script, gender and format, as the key ``secret`` has
    it. Equal entities get equal surrogates everywhere; different ones different surrogates, none of which is itself an
    entity of the table (checked over all distinct entities, and drawn again). Null texts stay null; texts without
    entities stay as they are; repeated rows are treated alike.
    """
    small_batches(docs.sparkSession)
    key, at = secret.encode(), docs.columns.index(text)
    mentioned = pa.schema([("id", pa.string()), ("kind", pa.string()), ("text", pa.string())])

    def mentions(batches):
        for batch in batches:
            got = {(k, t[a:b]) for x in batch.column(0) if (t := x.as_py()) for k, a, b in entities(t)}
            rows = sorted((identity(k, t, key), k, t) for k, t in got)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else ((), (), ()))], schema=mentioned)

    found = durable(docs.select(text).mapInArrow(mentions, "id string, kind string, text string").dropDuplicates(["id"]), "entities")
    again = draws(found, key)
    out = fresh(docs, "surrogates")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("id", pa.string())]))
    own, rows, names = fresh(docs, "draws"), docs, docs.columns
    if again is not None:
        # the few rows that mention an entity with another draw carry it along; others aren't changed by the join
        rows = _with_draws(docs, again, text, own, key)

    def replaced(batches):
        for batch in batches:
            texts, marks = [], []
            extra = batch.column(batch.num_columns - 1).to_pylist() if own in batch.schema.names else [None] * batch.num_rows
            for x, more in zip(batch.column(at), extra):
                content, drawn = x.as_py(), {d["id"]: d["draw"] for d in more or []}
                found = entities(content)
                ids = [identity(k, content[a:b], key) for k, a, b in found]
                made = [surrogate(k, content[a:b], key, drawn.get(i, 0)) for (k, a, b), i in zip(found, ids)]
                every = [(a, b, k, new) for k, ((_, a, b), new) in enumerate(zip(found, made))]
                if any(k == "person" for k, _, _ in found):
                    every = sorted(every + further_mentions(content, found, made))
                parts, spans, last = [], [], 0
                for a, b, k, new in every:
                    parts += [content[last:a], new]
                    spans.append({"kind": found[k][0], "start": a, "end": b, "id": ids[k]})
                    last = b
                texts.append("".join([*parts, content[last:]]) if spans else content)
                marks.append(spans)
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(marks, kind)], [*names, out])

    added = docs.select(F.lit(None).cast("array<struct<kind:string,start:long,end:long,id:string>>").alias(out)).schema.fields
    return rows.mapInArrow(replaced, type(docs.schema)([*docs.schema.fields, *added]))


def _with_draws(docs: DataFrame, again: DataFrame, text: str, own: str, key: bytes) -> DataFrame:
    """``docs`` and ``own``: array of (id, draw) of the mentioned entities with another draw than the first.

    Rows meet their draws by the hash of the text. Only hashes and ids are shuffled, unless the draws outgrow a
    broadcast.
    """
    def mentioned(batches):
        for batch in batches:
            pairs = {(h, identity(k, t[a:b], key)) for h, x in zip(batch.column(0).to_pylist(), batch.column(1)) if (t := x.as_py()) for k, a, b in entities(t)}
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], ["h", "id"])

    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    by_text = docs.select(digest.alias("h"), text).mapInArrow(mentioned, "h string, id string").join(again, "id").distinct().groupBy("h").agg(F.collect_list(F.struct("id", "draw")).alias(own))
    by_text = durable(by_text, "draws")
    mark = fresh(docs, "digest")
    return docs.withColumn(mark, digest).join(by_text.withColumnRenamed("h", mark), mark, "left").select(*docs.columns, own)


#: The session's setting that holds the key of the registered queries.
KEY_SETTING = "spark.lodestone.pii.key"


def session_key(spark) -> str:
    """The key in the session's setting KEY_SETTING. Where it is unset, a random one is drawn for this session and kept
    there: surrogates of different sessions then differ, and nobody can undo them."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_SETTING, key)
    return key


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """The operator over all documents: the new text, how many entities were replaced, and which kinds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = pseudonymize(docs, session_key(spark))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("surrogates", lambda s: s["kind"]))), ",")
    return rows.select("doc_id", "text", F.size("surrogates").cast("long").alias("n_replaced"), kinds.alias("kinds"))
