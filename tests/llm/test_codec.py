"""The codec of bpe_matrix from batch to batch."""

import random

from marginalia.llm import bpe_matrix


def ranks():
    out = {bytes([i]): i for i in range(256)}
    for token in (b"ab", b"abc", b"cd", b"bc", b"abcd", b"aa", b"aaaa", b"dab"):
        out[token] = len(out)
    return out


def test_pieces_are_merged_once_for_all_batches(monkeypatch):
    rng = random.Random(1)
    texts = [["".join(rng.choices("abcd", k=rng.randrange(1, 12))) for _ in range(50)] + ["é", "a" * 300] for _ in range(40)]
    whole = [x.tolist() for x in bpe_matrix.Codec(ranks()).encode_texts(texts)]
    codec, merged = bpe_matrix.Codec(ranks()), []
    monkeypatch.setattr(codec, "encode_pieces", lambda pieces, real=codec.encode_pieces: (merged.extend(pieces), real(pieces))[1])
    assert [x.tolist() for at in range(0, 40, 8) for x in codec.encode_texts(texts[at : at + 8])] == whole
    assert len(merged) == len(set(merged)) == len({p for t in texts for p in t})
    monkeypatch.setattr(bpe_matrix, "KNOWN", 60, raising=False)  # and where the worker begins anew
    assert [x.tolist() for at in range(0, 40, 8) for x in codec.encode_texts(texts[at : at + 8])] == whole
    for pieces, ids in zip(texts, whole, strict=True):
        assert ids == [i for p in pieces for i in codec.by_heap(p.encode()).tolist()]
    assert codec.encode_texts([]) == [] and [x.tolist() for x in codec.encode_texts([[]])] == [[]]
