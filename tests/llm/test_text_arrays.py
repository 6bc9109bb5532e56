import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import text_arrays as t

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab \n\té \U0001f600")), max_size=8))
def test_words_and_hashes_follow_documents(texts):
    for part in t.slices(pa.array(texts, pa.string()), most=16):
        words = t.split_words(part.data, part.bounds)
        raw = part.data.tobytes()
        hashes = t.word_hashes(part.data, words)
        seen = {}
        for d, text in enumerate(texts[part.first : part.last]):
            own = range(words.bounds[d], words.bounds[d + 1])
            got = [raw[words.start[i] : words.end[i]].decode() for i in own]
            assert got == WORD.findall(text)
            for i, w in zip(own, got, strict=True):
                assert seen.setdefault(w, hashes[i]) == hashes[i]
        assert len(set(map(int, seen.values()))) == len(seen)
        points, bounds = t.code_points(part.data, part.bounds)
        assert [len(x) for x in texts[part.first : part.last]] == np.diff(bounds).tolist()


def test_gram_mask_marks_windows_inside_documents():
    bounds = np.array([0, 3, 3, 5, 9])
    for k in (1, 2, 3, 4):
        own = [d for d in range(4) for _ in range(bounds[d + 1] - bounds[d])]
        want = [own[i] == own[i + k - 1] for i in range(9 - k + 1)]
        assert t.gram_mask(bounds, k).tolist() == want


def test_malformed_bytes_are_replaced():
    data = np.frombuffer(b"ab\xffc", np.uint8)
    points, bounds = t.code_points(data, np.array([0, 2, 4]))
    assert bounds.tolist() == [0, 2, 4] and points[2] == 0xFFFD
