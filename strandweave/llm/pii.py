"""Personal data: fixed patterns, plus information-theoretic sanitisation of terms that reveal an entity.

Base spans per kind (email, ip, card, phone) are leftmost and non-overlapping; failing matches are dropped
without a retry. The method adds two kinds of spans. A `secret` is a run of letters, digits and underscores that
carries SECRET_BITS of self-information or more (length times the entropy of its characters). A `term` is a word that
reveals a protected entity. Protected are each base value and each class of values, as single ones are
often rare: the domain of an e-mail address, the network of an ip, the issuer of a card, the prefix of a phone
number, and the kind itself, secrets included.

All counts are of distinct texts, so copies of a document reveal nothing by themselves: N texts; those that
mention entity e; those that hold term t; those that hold t near a mention of e (CONTEXT_WORDS either side, CONTEXT_CHARS
at most). A term discloses the entity when

    texts(t, e) >= MIN_TEXTS,  texts(t, e) / texts(t) >= MIN_SHARE  and  log2(N texts(t, e) / (texts(t) texts(e))) >= MIN_BITS.

The share says that the term alone, without the entity, points to it; so every occurrence in every document becomes
a span. Terms go to the workers in chunks of at most CHUNK_TERMS. Words with digits are generalised to [NUMBER],
capitalised ones to [NAME], others are removed.

To count each text once without moving all texts, a bitmap of fixed size marks the hashes of repeated texts. It only
sieves: texts that it marks are dealt by hash and counted once, the others where they are.

Null text counts as empty: no spans. Repeated rows are reported each. A null id stays null. Extra columns are
ignored by `find` and kept by `sanitise`, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from strandweave.llm.common import bitmap, bits_at, has_bit, map_arrow, memo, slices, staged, texts_of, use

CONTEXT_WORDS, CONTEXT_CHARS = 8, 400
MIN_TEXTS, MIN_SHARE, MIN_BITS = 3, 0.5, 3.0
#: Self-information that makes a string a secret, its least length, and the letters and digits it must have.
SECRET_BITS, SECRET_LENGTH, SECRET_MIX = 72, 24, 3
#: log2 of the bits of the bitmap of repeated texts: 8 MB.
TEXT_BITS = 26
#: Distinct terms that a worker counts before it hands its partial counts on.
FLUSH_WORDS = 200_000
#: Words that a worker remembers the terms of.
MEMO = 400_000
#: Disclosing terms that are broadcast at once.
CHUNK_TERMS = 200_000
KINDS = ("email", "ip", "card", "phone")

# Fixed patterns of the four kinds.
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

_SECRET = re.compile(rf"[A-Za-z0-9_]{{{SECRET_LENGTH},}}+")

_MENTIONS = pa.list_(pa.struct([("entities", pa.list_(pa.int64())), ("terms", pa.list_(pa.string()))]))
_ROW = pa.schema([("th", pa.int64()), ("mentions", _MENTIONS), ("term", pa.string()), ("df", pa.int64()), ("text", pa.string())])
_DDL = "th long, mentions array<struct<entities:array<long>,terms:array<string>>>, term string, df long, text string"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @ outwards, so in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


def secret_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Strings of high self-information outside the base spans."""
    out = []
    for m in _SECRET.finditer(text):
        n = len(m[0])
        digits = len(_DIGITS.findall(m[0]))
        if digits < SECRET_MIX or n - digits - m[0].count("_") < SECRET_MIX or any(a < m.end() and m.start() < b for _, a, b in base):
            continue
        if -sum(k * math.log2(k / n) for k in Counter(m[0]).values()) >= SECRET_BITS:
            out.append(("secret", *m.span()))
    return out


_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = re.compile(r"^\W*(.*?)\W*$", re.S)


def normal(word: str) -> str:
    """Lower case without the punctuation around it; empty if under three characters are left."""
    t = (word if word.isalnum() else _EDGE.match(word)[1]).lower()
    return t if len(t) >= 3 else ""


class _Terms(dict):
    """word -> its term, if any; forgets everything when it has grown large."""

    def __missing__(self, word: bytes) -> str:
        if len(self) >= MEMO:
            self.clear()
        t = self[word] = normal(word.decode())
        return t

    def of(self, text: str) -> set[str]:
        """Distinct terms of a text."""
        use("pii")
        out = set(map(self.__getitem__, set(text.encode().split())))
        out.discard("")
        return out


_terms = memo(_Terms(), "pii")


def entities_of(kind: str, value: str) -> list[str]:
    """What a mention protects: the value, its class, its kind."""
    if kind == "secret":
        return ["secret"]
    if kind == "email":
        same = value.lower()
        group = same.rpartition("@")[2]
    elif kind == "ip":
        same = ".".join(x.lstrip("0") or "0" for x in value.split("."))
        group = ".".join(same.split(".")[:2])
    else:
        same = "".join(_DIGITS.findall(value))
        group = same[: 6 if kind == "card" else 4]
    return [f"{kind}:{same}", f"{kind}/{group}", kind]


def _key(entity: str) -> int:
    return xxhash.xxh3_64_intdigest(entity) - (1 << 63)


def mentions_of(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[list[str], list[str]]]:
    """(entities, terms near) for each span."""
    taken = sorted((a, b) for _, a, b in spans)
    for kind, a, b in spans:
        lo, hi = max(0, a - CONTEXT_CHARS), min(len(text), b + CONTEXT_CHARS)
        left = [m for m in _WORD.finditer(text, lo, a) if m.start() > lo or lo == 0][-CONTEXT_WORDS:]
        right = [m for m in _WORD.finditer(text, b, hi) if m.end() < hi or hi == len(text)][:CONTEXT_WORDS]
        yield entities_of(kind, text[a:b]), sorted({t for m in left + right if (t := normal(m[0])) and not any(s < m.end() and m.start() < e for s, e in taken)})


class Terms:
    """Disclosing terms, and a quick test whether a text can hold any: they are searched for in it all at once."""

    def __init__(self, terms: frozenset[str]):
        self.terms, self.machine = terms, ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for t in terms:
            self.machine.add_word(_folded(t))
        if terms:
            self.machine.make_automaton()

    def __contains__(self, term: str) -> bool:
        return term in self.terms

    def any_in(self, text: str) -> bool:
        return bool(self.terms) and next(self.machine.iter(_folded(text)), None) is not None


def _folded(text: str) -> str:
    """Lower case; both small sigmas are one, as which of them a capital becomes depends on what is next to it."""
    return text.lower().replace("ς", "σ")


def term_spans(text: str, spans: list[tuple[str, int, int]], terms: Terms) -> list[dict]:
    """Every occurrence of one of the terms outside the base spans."""
    if not terms.any_in(text):
        return []
    out = []
    taken = sorted((a, b) for _, a, b in spans)
    for m in _WORD.finditer(text):
        if (t := normal(m[0])) in terms and not any(s < m.end() and m.start() < e for s, e in taken):
            s = m.start() + m[0].lower().find(t) if len(m[0].lower()) == len(m[0]) else m.start()
            out.append({"start": s, "end": s + len(t) if len(t) <= m.end() - s else m.end()})
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def protected(text: str) -> list[tuple[str, int, int]]:
    base = base_spans(text)
    return base + secret_spans(text, base)


def _scan(texts: DataFrame, repeated: np.ndarray | None) -> DataFrame:
    """Rows of texts(th, text) with mentions, and of partial text counts (term, df), where the term "" counts all texts.
    Texts whose hash is in the bitmap `repeated` are handed on uncounted, as rows (th, text)."""
    held = texts.sparkSession.sparkContext.broadcast(repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()

        def rows(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ROW], schema=_ROW)

        def counts() -> pa.RecordBatch:
            out = rows(len(df), term=list(df.keys()), df=list(df.values()))
            df.clear()
            return out

        for b in slices(batches, most=1 << 20):
            hashes, texts_ = b.column(0).to_numpy(), texts_of(b.column(1))
            again = has_bit(held.value, bits_at(hashes.view(np.uint64), TEXT_BITS)) if held.value is not None else np.zeros(len(texts_), bool)
            th, found = [], []
            for h, t, x in zip(hashes.tolist(), texts_, again.tolist()):
                if x:
                    continue
                df.update(_terms.of(t))
                df[""] += 1
                if spans := protected(t):
                    th.append(h)
                    found.append([{"entities": list(map(_key, e)), "terms": near} for e, near in mentions_of(t, spans)])
            if th:
                yield rows(len(th), th=th, mentions=found)
            if again.any():
                yield rows(int(again.sum()), th=hashes[again], text=b.column(1).filter(pa.array(again)))
            if len(df) > FLUSH_WORDS:
                yield counts()
        if df:
            yield counts()

    return map_arrow(texts.select("th", "text"), run, _DDL)


def disclosing(docs: DataFrame) -> DataFrame:
    """(term), distinct: the terms that disclose some entity."""
    texts = docs.where("text is not null").select(F.xxhash64("text").alias("th"), "text")
    several = texts.groupBy("th").agg(F.count("*").alias("n")).where("n > 1").select(F.col("th").alias("h"))
    first = staged(_scan(texts, bitmap(several, TEXT_BITS)), "pii")
    rest = _scan(first.where("text is not null").select("th", "text").dropDuplicates(["th"]), None)
    scan = first.where("text is null").unionByName(staged(rest, "pii-repeated"))
    mentions = scan.where("mentions is not null").count()
    at = scan.where("mentions is not null").select("th", F.explode("mentions").alias("m")).select("th", F.explode("m.entities").alias("entity"), F.col("m.terms").alias("terms"))
    of_entity = at.select("entity", "th").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    joint = at.select("entity", "th", F.explode("terms").alias("term")).distinct().groupBy("entity", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= MIN_TEXTS)
    joint = staged(joint, "pii-joint", 6 * CONTEXT_WORDS * mentions)
    df = scan.where("term <> ''").groupBy("term").agg(F.sum("df").alias("n_t"))
    total = scan.where("term = ''").agg(F.sum("df").alias("n"))
    return (
        joint.join(df, "term").join(of_entity, "entity").join(F.broadcast(total))  # one row: the number of texts
        .where((F.col("n_te") >= MIN_SHARE * F.col("n_t")) & (F.log2(F.col("n") * F.col("n_te") / (F.col("n_t") * F.col("n_e"))) >= MIN_BITS))
        .select("term").distinct().coalesce(1 + 6 * CONTEXT_WORDS * mentions // CHUNK_TERMS)
    )


def _located(docs: DataFrame, finish, schema) -> DataFrame:
    """map_arrow over docs with finish(batch, texts, protected spans, term spans): one pass for each chunk of terms, the
    last of which finishes the rows; the others hand on a column of the spans found so far."""
    names, at = docs.columns, docs.columns.index("text")
    spark = docs.sparkSession

    def step(df: DataFrame, terms: frozenset[str], last: bool) -> DataFrame:
        held = spark.sparkContext.broadcast(terms)
        more = len(df.columns) > len(names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Terms(held.value)
            for b in slices(batches):
                texts = texts_of(b.column(at))
                spans = [protected(t) for t in texts]
                before = b.column(len(names)).to_pylist() if more else [[]] * len(texts)
                found = [x + term_spans(t, s, known) for t, s, x in zip(texts, spans, before)]
                own = b.select(range(len(names)))
                if last:
                    yield finish(own, texts, spans, [[("term", y["start"], y["end"]) for y in sorted(x, key=lambda y: y["start"])] for x in found])
                else:
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(found, _SPANS)], names=[*names, "__sw_extra"])

        return map_arrow(df, run, schema if last else wide)

    wide = docs.withColumn("__sw_extra", F.expr("cast(array() as array<struct<start:long,end:long>>)")).schema
    chunk: list[str] = []
    for r in staged(disclosing(docs), "pii-terms").toLocalIterator():
        if len(chunk) == CHUNK_TERMS:
            docs, chunk = step(docs, frozenset(chunk), False), []
        chunk.append(r.term)
    return step(docs, frozenset(chunk), True)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, all spans and their number: a row per document."""

    def finish(b: pa.RecordBatch, texts, spans, terms) -> pa.RecordBatch:
        n = [pa.array([sum(k == kind for k, _, _ in s) for s in spans], pa.int64()) for kind in KINDS]
        base = [_joined(x for x in s if x[0] != "secret") for s in spans]
        every = [_joined(s + t) for s, t in zip(spans, terms)]
        return pa.RecordBatch.from_arrays([b.column(0), *n, pa.array(base, pa.string()), pa.array(every, pa.string()), pa.array([len(s) + len(t) for s, t in zip(spans, terms)], pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_spans"])

    got = _located(docs.select(F.col("doc_id").cast("long"), "text"), finish, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_spans long")
    return got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_spans")


def count_base(docs: DataFrame) -> DataFrame:
    """doc_id and counts of base spans by kind: a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            spans = [Counter(k for k, _, _ in base_spans(t)) for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([s[k] for s in spans], pa.int64()) for k in KINDS)], names=["doc_id", *(f"n_{k}" for k in KINDS)])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Replace each span by its kind; overlapping spans merge under the first one's kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        a = max(a, at)
        out.append(text[at:a])
        if kind != "term":
            out.append(f"[{kind.upper()}]")
        else:
            word = text[a:b]
            out.append("[NUMBER]" if _DIGITS.search(word) else "[NAME]" if word[:1].isupper() else "")
        at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame) -> DataFrame:
    """docs, all columns and rows, with personal data, secrets and disclosing terms taken out of `text`."""
    names, at = docs.columns, docs.columns.index("text")

    def finish(b: pa.RecordBatch, texts, spans, terms) -> pa.RecordBatch:
        clean = [redact(t, s + x) if s or x else t for t, s, x in zip(b.column(at).to_pylist(), spans, terms)]
        cols = list(b.columns)
        cols[at] = pa.array(clean, b.column(at).type)
        return pa.RecordBatch.from_arrays(cols, names=names)

    return _located(docs, finish, docs.schema)
