"""Substring dedup with repeated-phrase automata.

A window is WINDOW = 35 consecutive words; a word goes if a window over it starts anywhere else too, in the
same document or another. Words are runs of anything but 0x20 and 0x09-0x0D, compared unchanged.

1. Anchors. Every window picks the least 8-word gram hash inside it (leftmost on ties), a choice that depends
   on the window's words alone. Consecutive windows with the same anchor form a run, a span of 35 to 62 words.
   One row (anchor, run hash) per run goes into a partial aggregation: anchors with one occurrence are done.
   An anchor whose runs are all equal is settled by its runs; where runs differ, single windows decide.
2. Confirmation. Two bitmaps of a fixed size (repeated anchors; those with different runs) go to the workers.
   They only sieve: a second scan writes the distinct runs of sieved anchors in each text and how often they occur there, with
   window hashes where runs differ. Runs whose (anchor, run hash) occurs twice are settled. For the others windows
   are counted by (anchor, window hash), each distinct run once with its number. A full bitmap costs time, never rows.
   What is confirmed are passages, each the words of a run or window taken from one text that holds it.
3. Location. A third bitmap keeps texts without any confirmed run out of the shuffle. The others, each distinct text
   once, come in bounded shards with the passages whose hashes they hold; the passages of a shard are compiled into one
   Aho-Corasick automaton over word numbers and its texts are streamed through it. Its hits alone say where words
   go: they compare the words themselves, so that two passages with equal hashes are not mistaken for each other.
   Rows take the result of their text.

Null text counts as empty (no words). Documents of under 35 words lose nothing. Repeated rows are copies of
each other and are all kept as rows. Null ids stay null. Extra columns are ignored, whatever their names. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandweave.llm.common import SpanHash, bitmap, bits_at, has_bit, hashes_of, map_arrow, slices, staged, texts_of

WINDOW, GRAM = 35, 8
#: log2 of the bits of a bitmap: 16 MB each, whatever the data.
BITMAP_BITS = 27
#: log2 of the bits of the bitmap of texts with repeats: 2 MB.
DOC_BITS = 24
#: Words of the passages compiled into one automaton; those of one text are never split.
SHARD_WORDS = 200_000


def runs_of(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, run hash, first window, last window) per run, and the span hashes of the document."""
    spans = SpanHash(h)
    n = len(h) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, spans
    g = spans.grams(gram)
    pick = np.empty(n, np.int64)
    width = window - gram + 1
    for i in range(0, n, 1 << 15):
        j = min(n, i + (1 << 15))
        pick[i:j] = np.arange(i, j) + np.lib.stride_tricks.sliding_window_view(g[i : j + width - 1], width).argmin(axis=1)
    first = np.concatenate(([0], np.flatnonzero(np.diff(pick)) + 1))
    last = np.concatenate((first[1:], [n])) - 1
    return g[pick[first]], spans.of(first, last + window), first, last, spans


def _anchor_counts(docs: DataFrame) -> DataFrame:
    """(h, mixed): anchors that occur twice or more, and whether their runs differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            some = [runs_of(hashes_of(t))[:2] for t in texts_of(b.column(0))]
            h, v = (np.concatenate([x[k] for x in some]).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(v)], names=["h", "v"])

    runs = map_arrow(docs.select("text"), run, "h long, v long")
    return runs.groupBy("h").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 1").select("h", (F.col("lo") != F.col("hi")).alias("mixed"))


def repeated_runs(docs: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """Staged (th, h, v, start, end, at): the distinct confirmed runs of each text, and where it has them first. `at`
    lists the windows of the run that are confirmed, by number, or is null for all of it."""
    anchors = staged(_anchor_counts(docs), "anchors")
    held = docs.sparkSession.sparkContext.broadcast((bitmap(anchors, bits), bitmap(anchors.where("mixed"), bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several, differ = held.value
        for b in slices(batches):
            ths, cols, wins, sizes, lone = [], [[], [], [], [], []], [], [], []
            for th, text in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                h, v, first, last, spans = runs_of(hashes_of(text))
                keep = np.flatnonzero(has_bit(several, bits_at(h, bits)))
                if not len(keep):
                    continue
                _, once, times = np.unique(v[keep], return_index=True, return_counts=True)
                keep = keep[once]
                ths += [th] * len(keep)
                for col, x in zip(cols, (h.view(np.int64), v.view(np.int64), first, last + WINDOW)):
                    col.append(x[keep])
                cols[4].append(times)
                split = has_bit(differ, bits_at(h[keep], bits))
                n = np.where(split, last[keep] - first[keep] + 1, 0)
                s = np.arange(n.sum()) + np.repeat(first[keep] - np.cumsum(n) + n, n)
                wins.append(spans.of(s, s + WINDOW).view(np.int64))
                sizes.append(n)
                lone.append(~split)
            if ths:
                ends = np.cumsum(np.concatenate(([0], *sizes))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(wins)), mask=pa.array(np.concatenate(lone)))
                yield pa.RecordBatch.from_arrays([pa.array(ths, pa.int64()), *(pa.array(np.concatenate(x)) for x in cols), lists], names=["th", "h", "v", "start", "end", "m", "wins"])

    seen = staged(map_arrow(_keyed(docs).select("th", "text"), run, "th long, h long, v long, start long, end long, m long, wins array<long>"), "runs")
    settled = seen.groupBy("h", "v").agg(F.sum("m").alias("n")).where("n > 1").select("h", "v", F.lit(None).cast("array<int>").alias("at"))
    # windows of each distinct run of an anchor whose runs differ, with the number of its occurrences
    variants = staged(seen.where("wins is not null").groupBy("h", "v").agg(F.sum("m").alias("n"), F.first("wins").alias("wins")), "variants")
    windows = variants.select("h", "v", "n", F.posexplode("wins").alias("k", "w"))
    twice = windows.groupBy("h", "w").agg(F.sum("n").alias("s")).where("s > 1").select("h", "w")
    lone = windows.where("n = 1").join(twice, ["h", "w"]).groupBy("h", "v").agg(F.collect_list("k").alias("at"))
    marks = staged(settled.unionByName(lone), "marks")  # the join below then deals both sides itself and can split a hot run
    own = seen.select("th", "h", "v", "start", "end").join(marks, ["h", "v"])
    # copies of a text have the same runs: dealt by (h, v) already, each is kept once
    return staged(own.dropDuplicates(["th", "h", "v"]).select("th", "h", "v", "start", "end", "at"), "confirmed")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def passages_of(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """(h, v, passages): the words of each confirmed run, or of its confirmed stretches, joined by spaces; taken
    from the text of the least hash that holds it. texts(th, text) are distinct."""
    holder = staged(runs.groupBy("h", "v").agg(F.min("th").alias("th")), "holders")
    taken = runs.join(holder, ["h", "v", "th"]).groupBy("th").agg(F.collect_list(F.struct("h", "v", "start", "end", "at")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: tuple[list, list, list] = ([], [], [])
            for text, own in zip(texts_of(b.column(0)), b.column(1).to_pylist()):
                words = text.encode().split()
                for r in own:
                    out[0].append(r["h"])
                    out[1].append(r["v"])
                    out[2].append([b" ".join(words[i:j]).decode() for i, j in stretches(r["start"], r["end"], r["at"])])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.string()))], names=["h", "v", "passages"])

    return map_arrow(texts.join(taken, "th").select("text", "runs"), run, "h long, v long, passages array<string>")


def stretches(start: int, end: int, at: list[int] | None) -> list[tuple[int, int]]:
    """The confirmed parts of a run: all of it, or its confirmed windows, those that follow each other joined."""
    if at is None:
        return [(start, end)]
    out: list[tuple[int, int]] = []
    for k in sorted(at):
        if out and start + k + WINDOW - 1 == out[-1][1]:
            out[-1] = (out[-1][0], out[-1][1] + 1)
        else:
            out.append((start + k, start + k + WINDOW))
    return out


def _shards(texts: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Texts in shards whose passages take SHARD_WORDS words, or a single text."""
    held, size = [], 0
    for x in texts:
        n = sum(p.count(_space(p)) + 1 for p in x[2])
        if held and size + n > SHARD_WORDS:
            yield held
            held, size = [], 0
        held.append(x)
        size += n
    if held:
        yield held


def _space(passage):
    return b" " if isinstance(passage, bytes) else " "


def locate(texts: Iterable[tuple]) -> Iterator[tuple[object, list, np.ndarray]]:
    """(key, words, removed mask) for texts given as (key, words, passages that they may hold, words joined by spaces), all
    strings or all bytes: each shard's passages become one automaton, through which all its texts are streamed."""
    for shard in _shards(texts):
        machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        number: dict = {}
        for p in dict.fromkeys(p for _, _, passages in shard for p in passages):
            machine.add_word(tuple(number.setdefault(w, len(number) + 1) for w in p.split(_space(p))))
        if len(machine):
            machine.make_automaton()
        for key, words, _ in shard:
            step = np.zeros(len(words) + 1, np.int64)
            if len(machine) and words:
                for end, n in machine.iter(tuple(number.get(w, 0) for w in words)):
                    step[end - n + 1] += 1
                    step[end + 1] -= 1
            yield key, words, np.cumsum(step[:-1]) > 0


def _judged(docs: DataFrame, result) -> DataFrame:
    """(doc_id, n_words, n_removed, result): result(words kept) of every row."""
    runs = repeated_runs(docs)
    held = docs.sparkSession.sparkContext.broadcast(bitmap(runs.select(F.col("th").alias("h")), DOC_BITS))

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            maybe = has_bit(held.value, bits_at(b.column(1).to_numpy().view(np.uint64), DOC_BITS)).tolist()
            texts = texts_of(b.column(2))
            done = [(None, None) if m else (len(w := t.encode().split()), result(w)) for t, m in zip(texts, maybe)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t if m else None for t, m in zip(texts, maybe)], pa.string()), pa.array([n for n, _ in done], pa.int64()), pa.array([x for _, x in done], pa.string())], names=["doc_id", "th", "text", "n_words", "result"])

    rows = staged(map_arrow(_keyed(docs), sieve, "doc_id long, th long, text string, n_words long, result string"), "sieved")
    texts = staged(rows.where("text is not null").select("th", "text").dropDuplicates(["th"]), "texts")
    passages = passages_of(texts, runs)
    own = runs.select("th", "h", "v").join(passages, ["h", "v"]).groupBy("th").agg(F.flatten(F.collect_list("passages")).alias("passages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            given = ((th, t.encode().split(), [x.encode() for x in p or ()]) for th, t, p in zip(b.column(0).to_pylist(), texts_of(b.column(1)), b.column(2).to_pylist()))
            out = [(th, len(words), int(gone.sum()), result([w for w, g in zip(words, gone.tolist()) if not g])) for th, words, gone in locate(given)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 3 else pa.int64()) for k, c in enumerate(zip(*out))], names=["th", "n_words", "n_removed", "result"])

    of_text = staged(map_arrow(texts.join(own, "th", "left").select("th", "text", "passages"), run, "th long, n_words long, n_removed long, result string"), "of-text")
    plain = rows.where("text is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "result")
    return plain.unionByName(rows.where("text is not null").select("doc_id", "th").join(of_text, "th").drop("th"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space): a row per document."""
    return _judged(docs, lambda words: hashlib.sha256(b" ".join(words)).hexdigest()).withColumnRenamed("result", "kept_sha256")


def strip(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every document without its repeated words; the others joined by one space."""
    return _judged(docs, lambda words: b" ".join(words).decode()).select("doc_id", F.col("result").alias("text"))
