"""The words and runs of one batch in collocations."""

from collections import Counter

import numpy as np
import pyarrow as pa

from marginalia.llm.collocations import Words


def test_phrases_of_a_batch_are_made_in_arrow():
    texts = ["A b c, b c\ta b", None, "", "é b c;b\nc A", "...", "b c"]
    langs = ["en", "en", None, None, "fr", "en"]
    w = Words(pa.record_batch({"text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string())}))
    assert isinstance(w.vocabulary, pa.BinaryArray)  # no Python object for each word or phrase
    for k in (1, 2, 3, 4):
        want = Counter()
        for text, lang in zip(texts, langs, strict=True):
            for piece in "".join("\n" if c in ".,;:!?" else c for c in (text or "").replace("A", "a")).split("\n"):
                own = piece.split()
                want.update((lang or "und", " ".join(own[i : i + k])) for i in range(len(own) - k + 1))
        got = w.batch(*w.counted(*w.runs(k), k), k)
        assert {(r["lang"], r["phrase"]): r["f"] for r in got.to_pylist()} == want and got.num_rows == len(want)
    empty = Words(pa.record_batch({"text": pa.array([None], pa.string()), "lang": pa.array(["en"], pa.string())}))
    assert [empty.batch(np.empty(0, np.int64), np.empty(0, np.int64), k).num_rows for k in (1, 2)] == [0, 0]
