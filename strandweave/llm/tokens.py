"""Token ids by the tokenizers library, with a memo of pieces.

Neither vocabulary merges across the pieces cut here, so the ids of a text are the ids of its pieces in a row.
For the byte-level vocabulary a piece is a space and what follows up to the next space or line feed, or a line
feed and what follows; for the one with word ends it is a word, A-Z lower-cased. Texts in which white space
stands in any other way go to the library whole. New pieces are encoded together, many to a call.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandweave.llm.common import memo, use

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Pieces that a worker remembers, and misses after which it forgets them.
MEMO, MISSES = 250_000, 20_000_000
# White space of any kind but single spaces and line feeds as described: 0x09, 0x0B-0x0D, 0x1C-0x1F and beyond ASCII.
_WIDE_SPACE = tuple("\x1c\x1d\x1e\x1f\x85\xa0                　")
_ODD_SPACE = (*"\t\x0b\x0c\r", *_WIDE_SPACE)
# ASCII marks that never join letters before them (the apostrophe does).
_MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
_PARTS = rf"(?s)^(?P<head>.*?)(?P<tail>[{re.escape(_MARKS)}]*)$"
_encoders: dict[str, "Encoder"] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts are split and their distinct pieces found by Arrow; only those are looked up, once per call."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        vocab = self.tok.get_vocab()
        self.by_word = self.tok.token_to_id("</w>") is not None or any(t.endswith("</w>") for t in list(vocab)[:2000])
        self.bar = vocab.get("|</w>")
        self.opens = np.zeros(max(vocab.values()) + 1, bool)  # ids whose token begins with a space byte
        if not self.by_word:
            self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        if len(self.opens) > 1 << 16:
            raise ValueError("ids are held in 16 bits")
        self.memo: dict[str, bytes] = memo({}, "tokens")
        self.tails: dict[str, bytes] = memo({}, "tokens")
        self.missed = 0
        self.firsts: dict[str, bytes] = memo({}, "tokens")
        self.odd = f"[{''.join(_WIDE_SPACE)}]" if self.by_word else f"  |\n |\n\n| \n\\z|[{''.join(_ODD_SPACE)}]"

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint16).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, fresh: list[str]) -> dict[str, bytes]:
        """Ids of different pieces, many encoded in one line where that cannot change them."""
        texts = fresh if self.by_word else [p if p[:1] == "\n" else f" {p}" for p in fresh]
        if self.by_word:
            joint = [(p, t) for p, t in zip(fresh, texts) if "|" not in t]
        else:
            joint = [(p, t) for p, t in zip(fresh, texts) if t[0] == " " and len(t) > 1]
        out: dict[str, bytes] = {}
        for i in range(0, len(joint), 512):
            part = joint[i : i + 512]
            line = " | ".join(t for _, t in part) if self.by_word else "".join(t for _, t in part)
            ids = np.array(self.tok.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.int64)
            cut = np.flatnonzero(ids == self.bar) if self.by_word else np.flatnonzero(self.opens[ids])[1:]
            if len(cut) == len(part) - 1:
                lo = np.concatenate(([0], cut + self.by_word)).tolist()
                hi = np.concatenate((cut, [len(ids)])).tolist()
                raw = ids.astype(np.uint16).tobytes()
                out.update((p, raw[2 * a : 2 * b]) for (p, _), a, b in zip(part, lo, hi))
        rest = [(p, t) for p, t in zip(fresh, texts) if p not in out]
        out.update(zip((p for p, _ in rest), self._plain([t for _, t in rest])))
        return out

    def _looked_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces. When the memo is full it only holds what it has, and starts anew after MISSES misses,
        so that it follows the texts."""
        ids = list(map(self.memo.get, pieces))
        miss = [p for p, x in zip(pieces, ids) if x is None]
        if miss:
            new = self._new(miss)
            ids = [new[p] if x is None else x for p, x in zip(pieces, ids)]
            self.missed += len(miss)
            if self.missed > MISSES:
                self.memo.clear()
                self.missed = 0
            if len(self.memo) < MEMO:
                self.memo.update(new)
        return ids

    def _tail(self, marks: str) -> bytes:
        if marks not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[marks] = self._plain([marks])[0] if marks else b""
        return self.tails[marks]

    def _ids_of(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of different pieces in a row, how many each has). Letters and the marks behind them are cut apart by both
        vocabularies, so a piece of both is looked up in two parts."""
        parts = pc.extract_regex(pieces, _PARTS)
        head, tail = pc.struct_field(parts, "head"), pc.struct_field(parts, "tail")
        cut = pc.and_(pc.utf8_is_alpha(pc.utf8_ltrim(head, "\n")), pc.greater(pc.binary_length(tail), 0))
        heads = pc.if_else(cut, head, pieces).dictionary_encode()
        tails = pc.if_else(cut, tail, "").dictionary_encode()
        raws = self._looked_up(heads.dictionary.to_pylist())
        codes = np.stack((heads.indices.to_numpy(), len(raws) + tails.indices.to_numpy()), axis=1).ravel()
        raws += map(self._tail, tails.dictionary.to_pylist())
        ids, size = _gather(*_flat(raws), codes)
        return ids, size.reshape(-1, 2).sum(axis=1)

    def _opening(self, pieces: list[str]) -> list[bytes]:
        """Pieces at the start of a text, which have no space before them."""
        if len(self.firsts) > MEMO // 8:
            self.firsts.clear()
        new = [p for p in dict.fromkeys(pieces) if p not in self.firsts]
        self.firsts.update(zip(new, self._plain(new)))
        return [self.firsts[p] for p in pieces]

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, `end` after each; how many each has, with it). Null counts as empty."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd))
        split = pc.ascii_split_whitespace(pc.ascii_lower(plain)) if self.by_word else pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        flat = split.flatten().dictionary_encode()
        ids, size = self._ids_of(flat.dictionary.cast(pa.string()))
        # a code per piece of every text: a whole odd text is one piece, and so is the end id
        n = np.ones(len(texts), np.int64)
        n[~odd] = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        ends = np.cumsum(n + 1)
        codes = np.full(int(ends[-1]) if len(ends) else 0, -1, np.int64)
        codes[ends - 1] = -2
        more: list[bytes] = []  # of pieces that are not in `flat`
        if odd.any():
            codes[ends[odd] - 2] = len(size) + np.arange(odd.sum())
            more += self._plain(texts.filter(pa.array(odd)).to_pylist())
        codes[codes == -1] = flat.indices.to_numpy()
        if not self.by_word:
            at = (ends - n - 1)[~odd]
            first = flat.dictionary.take(pa.array(codes[at])).to_pylist()
            codes[at] = len(size) + len(more) + np.arange(len(at))
            more += self._opening(first)
        codes[ends - 1] = len(size) + len(more)
        more.append(np.array([end], np.uint16).tobytes())
        own, sizes = _flat(more)
        out, taken = _gather(np.concatenate((ids, own)), np.concatenate((size, sizes)), codes)
        return out, np.diff(np.cumsum(taken)[ends - 1], prepend=0)


def _flat(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids in a row, how many each has)."""
    return np.frombuffer(b"".join(raws), "<u2"), np.fromiter(map(len, raws), np.int64, len(raws)) // 2


def _gather(ids: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the coded pieces in a row, how many each has)."""
    start, own = np.cumsum(size) - size, size[codes]
    upto = np.cumsum(own)
    return ids[np.repeat(start[codes] - upto + own, own) + np.arange(int(upto[-1]) if len(upto) else 0)], own


def encoder(path: str) -> Encoder:
    """One per worker and vocabulary."""
    use("tokens")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
