"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

`fit` counts hashed word unigrams and bigrams over every document (raw) and over the trusted ones (target). A
bucket's log ratio compares its target count with what the raw share leads one to expect, both plus PSEUDO; it is
zero where the difference is under EVIDENCE deviations. Texts are dealt to FOLDS by their hash and each is scored
without the target counts of its own fold, so trusted documents have no advantage over others. The cut-off is
where, on labelled rows, the share of trusted ones kept plus the mean share of toxic and of low-quality ones
rejected is largest (the least such value, in steps of STEP). Base counts and `base_failed` follow fixed rules.

Words are maximal runs of anything but 0x20 and 0x09-0x0D. Null text counts as empty; an empty document has
all counts zero, fails the base rule and is not kept. A repeated row is judged like any other row, so equal
texts get equal verdicts. Without any trusted document all ratios are zero and the base rule alone decides;
without any bad one the cut-off is the least score of a trusted one. Labels that disagree count as bad.
Other columns, whatever their names, are ignored by `judge` and passed through by `keep_clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from strandweave.llm.common import BROADCAST_ROWS, SpanHash, hashes_of, map_arrow, slices, sliding_cover, staged, texts_of

#: Buckets for hashed n-grams; the model is FOLDS vectors of this length, so what is broadcast is bounded.
BUCKETS = 1 << 18
#: Parts of the target; a text is scored by all but its own.
FOLDS = 4
#: Added to a bucket's target count and to the count expected of it.
PSEUDO = 1.0
#: Deviations from the expected count below which a bucket says nothing.
EVIDENCE = 3.0
#: Steps in which the cut-off is chosen (nats per n-gram).
STEP = 0.0005
TRUSTED, LOW, TOXIC = 0, 1, 2

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"

_SYMBOLS = bytes(b"#*$%&|<>")
_SPACES = bytes(b" \t\n\x0b\x0c\r")


def ngram_buckets(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each unigram and bigram of a document."""
    two = SpanHash(h).grams(2)
    return (np.concatenate((h, two)) % np.uint64(buckets)).astype(np.int64)


def base_counts(text: str, h: np.ndarray) -> tuple[int, int, int, int, int]:
    raw = text.encode()
    n = len(h)
    word_chars = len(text) - (len(raw) - len(raw.translate(None, _SPACES)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    dup = 0
    if "\n" in text:
        seen: set[str] = set()
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif line.encode().split():
                seen.add(line)
    repeat = 0
    if n >= 4:
        _, inverse, counts = np.unique(SpanHash(h).grams(3), return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        if twice.any():
            repeat = int(sliding_cover(twice, 3, n).sum())
    return n, word_chars, symbols, dup, repeat


def labelled_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, kind) of labelled documents. Trusted: good and not toxic."""
    bad = F.when(F.max(F.coalesce("toxic", F.lit(0))) == 1, TOXIC).when(F.min("quality") == 0, LOW).when(F.min("quality") == 1, TRUSTED)
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(bad.alias("kind")).where("kind is not null")


def fold_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) % FOLDS


def with_kind(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, bool]:
    """((doc_id, text, kind) of all documents, whether the labels went to the workers): they do if they are
    BROADCAST_ROWS at most, so that texts stay where they are; else both sides are shuffled."""
    ids = staged(labelled_ids(labels), "labelled", labels.count())
    few = ids.count() <= BROADCAST_ROWS
    return docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids) if few else ids, "doc_id", "left"), few


def counted(rows: DataFrame, buckets: int) -> np.ndarray:
    """(1 + FOLDS, buckets) n-gram counts of rows(kind, text): of all texts, and of the trusted ones of each fold. At
    most `buckets` rows reach the driver."""
    names = ["bucket", "raw", *(f"n{k}" for k in range(FOLDS))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((1 + FOLDS, buckets), np.int64)
        for b in slices(batches):
            found: list[list[np.ndarray]] = [[] for _ in range(1 + FOLDS)]
            for kind, text in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                h = hashes_of(text)
                if len(h):
                    own = ngram_buckets(h, buckets)
                    found[0].append(own)
                    if kind == TRUSTED:
                        found[1 + fold_of(text)].append(own)
            for total, some in zip(n, found):
                if some:
                    total += np.bincount(np.concatenate(some), minlength=buckets)
        some = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(x[some]) for x in n)], names=names)

    got = map_arrow(rows.select("kind", "text"), count, ", ".join(f"{c} long" for c in names)).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in names[1:])).toArrow()
    out = np.zeros((1 + FOLDS, buckets), np.int64)
    for k, c in enumerate(names[1:]):
        out[k, got.column("bucket").to_numpy()] = got.column(c).to_numpy()
    return out


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log(target count / count expected from raw) where the counts are evidence of a difference, else zero."""
    if not target.sum():
        return np.zeros(len(raw), np.float32)
    expected = raw * (target.sum() / raw.sum())
    sure = np.abs(target - expected) >= EVIDENCE * np.sqrt(expected + 1)
    return np.where(sure, np.log((target + PSEUDO) / (expected + PSEUDO)), 0).astype(np.float32)


def cut_off(scores: DataFrame) -> float:
    """The cut-off from scores(kind, llr) of labelled documents; a row per kind and STEP reaches the driver."""
    got = scores.groupBy("kind", F.floor(F.col("llr") / STEP).alias("step")).agg(F.count("*").alias("n")).toPandas()
    if not (got.kind == TRUSTED).any():
        return float("-inf")
    steps = np.unique(got.step)
    good = got[got.kind == TRUSTED]
    if len(good) == len(got):
        return float(good.step.min() * STEP)
    below = {k: np.array([x.n[x.step < s].sum() for s in steps]) / x.n.sum() for k, x in got.groupby("kind")}
    gain = np.mean([x for k, x in below.items() if k != TRUSTED], axis=0) - below[TRUSTED]
    return float(steps[np.argmax(np.round(gain, 12))] * STEP)


def fit_ratios(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio by fold and bucket, from rows(kind, text). Raw counts cover all documents."""
    n = counted(rows, buckets)
    target = n[1:]
    return np.stack([log_ratio(n[0], target.sum(axis=0) - own) for own in target])


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, float]:
    """(log ratio by fold and bucket, cut-off)."""
    rows, few = with_kind(docs, labels)
    known = rows.where("kind is not null")
    if not few:
        rows = staged(rows, "quality-rows")
        known = rows.where("kind is not null")
    ratios = fit_ratios(rows, buckets)
    held = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            scores = [judge_text(t, held.value, 0.0) for t in texts_of(b.column(1))]
            out = pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.array([r[6] for r in scores], pa.float64())], names=["kind", "llr"])
            yield out.filter(pa.array([not r[5] for r in scores], pa.bool_()))

    return ratios, cut_off(map_arrow(known.select("kind", "text"), run, "kind int, llr double"))


def judge_text(text: str, ratios: np.ndarray, threshold: float) -> tuple:
    h = hashes_of(text)
    n, chars, symbols, dup, repeat = base_counts(text, h)
    failed = n < 50 or 100 * repeat > 50 * n
    own = ratios[fold_of(text)]
    llr = float(own[ngram_buckets(h, len(own))].sum(dtype=float) / (2 * n - 1)) if n else 0.0
    return n, chars, symbols, dup, repeat, failed, llr, not failed and llr >= threshold


def judge(docs: DataFrame, ratios: np.ndarray, threshold: float, *more: str) -> DataFrame:
    """One row per document with SCHEMA, and integer columns of docs named in `more`."""
    held = docs.sparkSession.sparkContext.broadcast(ratios)
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [judge_text(t, held.value, threshold) for t in texts_of(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *map(pa.array, zip(*rows)), *(c.cast(pa.int32()) for c in b.columns[2:])], names=[*names, *more])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text", *more), run, ", ".join([SCHEMA, *(f"{c} int" for c in more)]))


def judge_base(docs: DataFrame) -> DataFrame:
    """The columns of SCHEMA that follow fixed rules: a row per document."""
    return judge(docs, np.zeros((FOLDS, 1), np.float32), 0.0).drop("llr", "kept")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float | None = None) -> DataFrame:
    """Rows of docs, all columns, that the rules keep. `threshold` overrides the cut-off."""
    ratios, cut = fit(docs, labels)
    least = cut if threshold is None else threshold
    held = docs.sparkSession.sparkContext.broadcast(ratios)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array([judge_text(t, held.value, least)[-1] for t in texts_of(b.column(at))], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """judge() with a model and cut-off fitted on the same documents. Scores are staged, so that each text is scored once."""
    rows, few = with_kind(docs, labels)
    rows = rows if few else staged(rows, "quality-rows")
    scored = staged(judge(rows, fit_ratios(rows), 0.0, "kind"), "judged")
    cut = cut_off(scored.where("kind is not null and not base_failed").select("kind", "llr"))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= cut)).drop("kind")
