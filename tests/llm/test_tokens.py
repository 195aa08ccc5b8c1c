import pyarrow as pa
import pytest

from strandweave.llm.common import slices
from strandweave.llm.tokens import BYTE_BPE, WORD_BPE, Encoder, tokenizer_path

TEXTS = [None, "", " ", "\n", " \n", "\x0b", "a\tb", "Hello,  world! \n", "\n\nx", " lead", "trail ", "étÉ 　 x", "A|B | c", "don't!!",
         "ΑΣ ΟΔΟΣ.", "x\xa0y", "İstanbul", "</w> <|endoftext|> [UNK]", "a\n", "\nfoo, bar", "I'll we'LL 123abc!! abc123?", "\x1cfoo",
         "日本語 テキスト。", "a \nb", "fin.\n", "one two, two; one", "one two, two; one"]


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
@pytest.mark.parametrize("memo", [1_000_000, 3])
def test_encoder_matches_library(name, memo, monkeypatch):
    monkeypatch.setattr("strandweave.llm.tokens.MEMO", memo)
    enc = Encoder(tokenizer_path(name))
    for _ in range(2):  # the second time from the memo
        for texts in (TEXTS, TEXTS[::-1], TEXTS[:1], []):
            ids, n = enc.encode(pa.array(texts, pa.string()), 7)
            want = [enc.tok.encode(t or "", add_special_tokens=False).ids + [7] for t in texts]
            assert n.tolist() == [len(w) for w in want]
            assert ids.tolist() == [i for w in want for i in w]


def test_slices():
    b = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, 5]), pa.array(["aaaa", None, "bb", "c" * 50, "d"])], names=["k", "t"])
    got = [x.column(0).to_pylist() for x in slices(iter([b, b.slice(0, 0), b.slice(3)]), 2, 6)]
    assert got == [[1, 2], [3], [4], [5], [4], [5]]
