"""Quality classifier by co-training.

Two views of a document: its text (style figures and selected hashed words) and its metadata (language, source,
length). Each view has a logistic regression, first fitted on labelled rows (a bounded sample, LABELLED_ROWS,
those with the least hash of their id, one row for an id). A tenth is held out to calibrate each view, another to fit
the combination. In each of ROUNDS rounds each view scores all unlabelled documents (rows of equal features count
once) and hands those it is surest of to the other view, GROWTH_SHARE of them for either class and GROWTH_ROWS at
most, from those that it has not handed over yet; ties are broken by a hash of the features. Sure is meant within the view: the highest and the
lowest of its logits. The pseudo-label is the view's calibrated probability, so a view that knows little
teaches little. Then both are fitted anew. In the end they are combined by a logistic regression over the two
calibrated logits, and every document is scored.

Good means quality 1 and not toxic. Documents are kept at a combined score of KEEP or more.

Null text counts as empty, null metadata as a value of its own. Rows without any words score by the same
formula. Repeated rows get equal scores; labels given twice count as good only if all agree. A null id is never
labelled. Without labels of both classes every score is the prior (0.5 with no labels). Extra columns are ignored,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from strandweave.llm.common import map_arrow, memo, slices, staged, texts_of, use

LABELLED_ROWS, ROUNDS, KEEP = 8_000, 2, 0.5
#: Of the unlabelled rows, what a view hands over for either class in a round; and at most so many rows.
GROWTH_SHARE, GROWTH_ROWS = 0.05, 1_000
#: Hash buckets of words, and how many of them the text view uses.
WORD_BUCKETS, WORDS_USED = 1 << 16, 1024
META_BUCKETS = 256
_STYLE = 10

SCHEMA = "doc_id long, score double, p_text double, p_meta double, kept boolean"
#: Words that a worker remembers the buckets of.
MEMO = 200_000
_buckets: dict[bytes, int] = memo({}, "cotrain")


def _bucket(word: bytes) -> int:
    b = _buckets.get(word)
    if b is None:
        if len(_buckets) > MEMO:
            _buckets.clear()
        b = _buckets[word] = xxhash.xxh32_intdigest(word.decode().lower().strip(".,;:!?\"'()[]")) % WORD_BUCKETS
    return b


def style(text: str, words: list[bytes]) -> list[float]:
    """Figures of the text, each about 0 to 1."""
    raw, n = text.encode(), max(1, len(words))
    size = max(1, len(raw))
    lines = [x for x in text.split("\n") if x]
    upper = size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks = size - len(raw.translate(None, b"#*$%&|<>!{}[]=_~^\\/@"))
    digits = size - len(raw.translate(None, b"0123456789"))
    distinct = len(set(words))
    return [1.0, np.log1p(len(words)) / 10, min(1.0, size / n / 20), upper / size, marks / size * 4, digits / size * 4, distinct / n, 1 - len(set(lines)) / max(1, len(lines)), float(len(words) < 50), min(1.0, len(lines) / n * 4)]


def meta_buckets(lang, source, n_chars) -> list[int]:
    size = -1 if n_chars is None else int(max(0, n_chars)).bit_length()
    keys = (f"l{lang}", f"s{source}", f"c{size}", f"l{lang}c{size}")
    return [xxhash.xxh32_intdigest(k) % META_BUCKETS for k in keys]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 12) -> np.ndarray:
    """Newton steps with conjugate gradients; the first column is the intercept. Products are in x's precision."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[0] = 1e-3
    kind = x.dtype
    for _ in range(steps):
        p = _sigmoid((x @ w.astype(kind)).astype(float))
        g = (y - p).astype(kind) @ x - ridge * w
        if np.abs(g).max(initial=0) < 1e-3 * max(1, len(y) ** 0.5):
            break
        d = (p * (1 - p) + 1e-6).astype(kind)
        step, r = np.zeros_like(w), g.copy()
        q, rr = r.copy(), r @ r
        for _ in range(20):
            hq = (d * (x @ q.astype(kind))) @ x + ridge * q
            a = rr / (q @ hq)
            step += a * q
            r -= a * hq
            new = r @ r
            if new < 1e-4 * rr:
                break
            q, rr = r + new / rr * q, new
        w += step
    return w


def _text_rows(idx: list[bytes], figures: np.ndarray) -> np.ndarray:
    x = np.zeros((len(idx), _STYLE + WORDS_USED), np.float32)
    x[:, :_STYLE] = figures
    for k, raw in enumerate(idx):
        x[k, _STYLE + np.frombuffer(raw, np.uint16).astype(np.int64)] = 1
    return x


def _meta_rows(raw: list[bytes]) -> np.ndarray:
    x = np.zeros((len(raw), 1 + META_BUCKETS), np.float32)
    x[:, 0] = 1
    for k, r in enumerate(raw):
        x[k, 1 + np.frombuffer(r, np.uint16).astype(np.int64)] = 1
    return x


def select_words(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Buckets with the largest chi-square against the label, from those in five documents or more."""
    n = np.zeros((2, WORD_BUCKETS))
    for b, label in zip(docs, y):
        n[int(label), b] += 1
    size = np.array([(y == 0).sum(), (y == 1).sum()], float)[:, None]
    both = n.sum(axis=0)
    expected = np.maximum(both * size / max(1, len(y)), 1e-9)
    chi = ((n - expected) ** 2 / expected).sum(axis=0)
    chi[both < 5] = -1
    order = np.argsort(-chi, kind="stable")[:WORDS_USED]
    return np.sort(order[chi[order] > 0])


class Model:
    """Both views, their calibration and the combination; a few thousand numbers."""

    def __init__(self, chosen: np.ndarray):
        self.slot = np.full(WORD_BUCKETS, -1, np.int32)
        self.slot[chosen] = np.arange(len(chosen))
        self.text, self.meta = np.zeros(_STYLE + WORDS_USED), np.zeros(1 + META_BUCKETS)
        self.scale = {"text": np.array([0.0, 1.0]), "meta": np.array([0.0, 1.0])}
        self.both = np.array([0.0, 0.5, 0.5])

    def logits(self, idx: list[bytes], figures: np.ndarray, meta: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated logits of the two views; sparse sums, no wide matrix."""
        words = self.text[_STYLE:]
        t = figures @ self.text[:_STYLE] + np.array([words[np.frombuffer(r, np.uint16)].sum() for r in idx])
        m = self.meta[0] + np.array([self.meta[1 + np.frombuffer(r, np.uint16).astype(np.int64)].sum() for r in meta])
        (a, b), (c, d) = self.scale["text"], self.scale["meta"]
        return a + b * t, c + d * m

    def combine(self, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        return _sigmoid(self.both[0] + self.both[1] * t + self.both[2] * m)


_FEATURES = "doc_id long, words binary, style array<double>, meta binary"


def features(docs: DataFrame, model: Model | None) -> DataFrame:
    """words: slots of the chosen buckets (all buckets without a model), style figures, metadata buckets."""
    held = None if model is None else docs.sparkSession.sparkContext.broadcast(model.slot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use("cotrain")
        for b in slices(batches):
            words, figures = [], []
            for t in texts_of(b.column(1)):
                w = t.encode().split()
                own = np.unique(np.fromiter(map(_bucket, set(w)), np.int64))
                if held is not None:
                    own = held.value[own]
                    own = own[own >= 0]
                words.append(own.astype(np.uint16).tobytes())
                figures.append(style(t, w))
            meta = [np.array(meta_buckets(*m), np.uint16).tobytes() for m in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.binary()), pa.array(figures, pa.list_(pa.float64())), pa.array(meta, pa.binary())], names=["doc_id", "words", "style", "meta"])

    some = [F.col(c) if c in docs.columns else F.lit(None).alias(c) for c in ("lang", "source", "n_chars")]
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text", *some), run, _FEATURES)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            t, m = held.value.logits(b.column(1).to_pylist(), np.array(b.column(2).to_pylist()).reshape(-1, _STYLE), b.column(3).to_pylist())
            s = held.value.combine(t, m)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(_sigmoid(t)), pa.array(_sigmoid(m)), pa.array(s >= KEEP)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return map_arrow(rows.select("doc_id", "words", "style", "meta"), run, SCHEMA)


def logit_rows(pool: DataFrame, model: Model) -> DataFrame:
    """(fh, text, meta): calibrated logits of both views for pool rows."""
    held = pool.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            t, m = held.value.logits(b.column(1).to_pylist(), np.array(b.column(2).to_pylist()).reshape(-1, _STYLE), b.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t), pa.array(m)], names=["fh", "text", "meta"])

    return map_arrow(pool.select("fh", "words", "style", "meta"), run, "fh long, text double, meta double")


def surest(logits: DataFrame, view: str, k: int, taken: set[int]) -> dict[int, float]:
    """fh -> probability: the k highest and the k lowest logits of a view among the rows not taken, ties by fh."""
    spark = logits.sparkSession
    left = logits.join(F.broadcast(spark.createDataFrame([(x,) for x in sorted(taken)], "fh long")), "fh", "left_anti") if taken else logits  # ROUNDS * 2 * GROWTH_ROWS at most
    out: dict[int, float] = {}
    for order in (F.desc(view), F.asc(view)):
        for r in left.orderBy(order, "fh").limit(k).collect():
            out.setdefault(r.fh, float(_sigmoid(np.array(r[view]))))
    return out


def train(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame, list[tuple[int, str, int]]]:
    """(model, staged features of all documents, rows handed over as (round, view, how many))."""
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.min(F.when((F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("y")).select(F.col("doc_id").cast("long"), "y")
    have = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED_ROWS))
    some = features(docs.join(have.select("doc_id"), "doc_id", "left_semi"), None)
    got = some.groupBy("doc_id").agg(F.min(F.struct("words", "style", "meta")).alias("f")).join(have, "doc_id").select("doc_id", "f.*", "y").collect()
    got.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r.doc_id)), r.doc_id))
    y = np.array([r.y for r in got], float)
    part = np.array([xxhash.xxh32_intdigest(str(r.doc_id)) % 10 for r in got], int)
    rows_of = {"fit": np.flatnonzero(part > 1), "scale": np.flatnonzero(part == 0), "both": np.flatnonzero(part == 1)}
    buckets = [np.frombuffer(r.words, np.uint16) for r in got]
    fit = rows_of["fit"]
    model = Model(select_words([buckets[k] for k in fit], y[fit]) if len(fit) else np.zeros(0, np.int64))
    rows = staged(features(docs, model), "cotrain")
    if any(len(set(y[x])) < 2 for x in rows_of.values()):
        share = min(max(y.mean(), 0.01), 0.99) if len(y) else 0.5
        model.text[0] = model.meta[0] = np.log(share / (1 - share))
        model.text[1:] = 0
        return model, rows, []
    slots = []
    for b in buckets:
        s = model.slot[b]
        slots.append(s[s >= 0].astype(np.uint16).tobytes())
    figures = np.array([r.style for r in got])
    x = {"text": _text_rows(slots, figures), "meta": _meta_rows([r.meta for r in got])}
    more: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {"text": [], "meta": []}

    def refit() -> None:
        held = rows_of["scale"]
        for view in x:
            w = fit_logistic(np.concatenate([x[view][fit], *(r for r, _ in more[view])]), np.concatenate([y[fit], *(p for _, p in more[view])]))
            setattr(model, view, w)
            z = (x[view][held] @ w).astype(float)
            model.scale[view] = fit_logistic(np.stack([np.ones(len(z)), z], axis=1), y[held], 0.1)

    refit()
    pool = rows.join(known.select("doc_id"), "doc_id", "left_anti").select(F.xxhash64("words", "style", "meta").alias("fh"), "words", "style", "meta")
    pool = staged(pool.dropDuplicates(["fh"]), "cotrain-pool")
    k = min(GROWTH_ROWS, math.ceil(GROWTH_SHARE * pool.count()))
    taken: dict[str, set[int]] = {"text": set(), "meta": set()}
    handed = []
    for n in range(ROUNDS):
        logits = staged(logit_rows(pool, model), "cotrain-logits")
        sure = {view: surest(logits, view, k, taken[view]) for view in x}
        want = F.broadcast(logits.sparkSession.createDataFrame([(h,) for h in sorted(sure["text"].keys() | sure["meta"].keys())], "fh long"))  # 4 * GROWTH_ROWS at most
        row = {r.fh: r for r in pool.join(want, "fh").collect()}
        for view, other in (("text", "meta"), ("meta", "text")):
            new = [row[h] for h in sorted(sure[view])]
            taken[view] |= sure[view].keys()
            handed.append((n, view, len(new)))
            if new:
                own = _text_rows([r.words for r in new], np.array([r.style for r in new])) if other == "text" else _meta_rows([r.meta for r in new])
                more[other].append((own, np.array([sure[view][r.fh] for r in new])))
        refit()
    both = rows_of["both"]
    t, m = model.logits([slots[k] for k in both], figures[both], [got[k].meta for k in both])
    model.both = fit_logistic(np.stack([np.ones(len(t)), t, m], axis=1), y[both], 0.1)
    return model, rows, handed


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """SCHEMA: a row per document."""
    model, rows, _ = train(docs, labels)
    return scored(rows, model)
