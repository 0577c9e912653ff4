"""Very long documents: places, slices and words that do not fit one piece."""

import random

import numpy as np

from lodeframe.llm import kernels, simhash, substrings
from lodeframe.llm.kernels import Words


def test_anchors_do_not_depend_on_the_bits_of_a_place(monkeypatch):
    rng = random.Random(3)
    data = np.frombuffer(" ".join(f"w{rng.randrange(400)}" for _ in range(9000)).encode(), dtype=np.uint8)
    words = Words(data, np.array([0, len(data)]))
    args = words.hashes(), np.diff(words.first)
    want = substrings.bundles(*args)
    monkeypatch.setattr(substrings, "_PLACE_BITS", np.uint64(10))
    for a, b in zip(want, substrings.bundles(*args)):
        assert np.array_equal(a, b)


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(4)
    text = " ".join("x" * rng.choice([1, 3, 900]) + str(rng.randrange(50)) for _ in range(400)).encode()
    data = np.frombuffer(text, dtype=np.uint8)
    words = Words(data, np.array([0, len(data)]))
    hashes, windows = words.hashes(), kernels.window_hashes(words.hashes(), 50)
    assert words.hashes()[0] == Words(data[:40], np.array([0, 40])).hashes()[0] or b" " not in text[:40]
    monkeypatch.setattr(kernels, "PIECE", 128)
    assert np.array_equal(words.hashes(), hashes) and np.array_equal(kernels.window_hashes(hashes, 50), windows)
    assert [w for part in kernels.word_slices(text, 100) for w in part] == text.split()


def test_slices_of_a_long_document_have_its_windows(monkeypatch):
    rng = random.Random(5)
    data = np.frombuffer(" ".join(f"w{rng.randrange(400)}" for _ in range(5000)).encode(), dtype=np.uint8)
    words = Words(data, np.array([0, len(data)]))

    def windows():
        out = {}
        for hashes, counts, word in substrings._sliced(words):
            for _, at, n, anchor, _ in zip(*substrings.bundles(hashes, counts)):
                out.update({at + word + i: anchor for i in range(n)})
        return out

    whole = windows()
    monkeypatch.setattr(substrings, "SLICE", 333)
    assert windows() == whole and sorted(whole) == list(range(4951))


def test_fingerprints_of_long_texts_come_in_slices(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(f"W{rng.randrange(400)}é" for _ in range(n)).encode() for n in (0, 1, 2, 3, 500)]
    want = [simhash.fingerprint(t) for t in texts]
    monkeypatch.setattr(kernels.word_slices, "__defaults__", (40,))
    assert [simhash.fingerprint(t) for t in texts] == want
