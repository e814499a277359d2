import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridlore.llm import anchors, packing, suffix
from gridlore.llm import kernels as K

SPACE, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é-.\n\t \x0b7Z𝄞", max_size=20)), max_size=6))
def test_words_match_patterns(texts):
    for pattern, kind in ((SPACE, K.NON_SPACE), (ALNUM, K.ALNUM)):
        w = K.split_words(pa.array(texts, pa.string()), kind, lower=True)
        got = [x.decode() for x in w.arrow().to_pylist()]
        want = [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]
        assert got == [x for d in want for x in d]
        assert np.diff(w.bounds).tolist() == [len(d) for d in want]


def test_equal_words_hash_alike_and_others_do_not():
    words = ["a", "ab", "abcdefgh", "abcdefghi", "x" * 1000, "x" * 1001, "a", "x" * 1000]
    h = K.hash_words(K.split_words(pa.array([" ".join(words)]), K.NON_SPACE, False))
    assert h[0] == h[6] and h[4] == h[7] and len(set(h.tolist())) == 6


def test_grams_stay_inside_documents():
    bounds = np.array([0, 3, 3, 4, 9])
    assert K.grams_inside(bounds, 3).tolist() == [0, 4, 5, 6]
    assert K.grams_inside(np.array([0, 1]), 2).tolist() == []


def test_bites_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 0, 50, 1, 1)]})
    assert [b.num_rows for b in K.bites(batch, "text", 6)] == [2, 1, 2]


@pytest.mark.parametrize("bits", [1, 2, 7, 8, 13, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
    raw = packing.pack(ids, bits)
    assert len(raw) == (1000 * bits + 7) // 8 and (packing.unpack(raw, 1000, bits) == ids).all()


def test_files_give_random_access(tmp_path):
    path = f"file://{tmp_path}/x.pack"
    docs = [np.random.default_rng(i).integers(0, 9000, n).astype(np.uint32) for i, n in enumerate((0, 5, 20_000, 1))]
    w = packing.Writer(path, 14)
    w.add(np.array([3, 4]), np.array([False, False]), np.array([0, 5]), np.concatenate(docs[:2]))
    w.add(np.array([5, 9]), np.array([False, True]), np.array([20_000, 20_001]), np.concatenate(docs[2:]))
    assert w.close() == (4, 20_006)
    r = packing.Reader(path)
    for i, d in enumerate(docs):
        assert (r.document(i) == d).all()
    assert (r.ids(8000, 8300) == np.concatenate(docs)[8000:8300]).all() and r.nulls.tolist() == [False, False, False, True]
    (tmp_path / "x.pack").write_bytes((tmp_path / "x.pack").read_bytes()[:-3])
    with pytest.raises(ValueError):
        packing.Reader(path)


def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(150):
        s = [rng.randint(1, rng.choice([1, 2, 3, 26])) for _ in range(rng.randint(1, 200))] + [0]
        assert suffix.suffix_array(np.array(s, dtype=np.uint16)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_repeated_windows():
    rng = random.Random(5)
    for _ in range(80):
        base = bytes(rng.choice(b"ab") for _ in range(60))
        texts = [base[rng.randint(0, 20) : rng.randint(30, 60)] for _ in range(rng.randint(1, 9))] + [b""]
        size = rng.choice([3, 8, 20])
        every = [t[i : i + size] for t in texts for i in range(len(t) - size + 1)]
        want = [[i for i in range(len(t) - size + 1) if every.count(t[i : i + size]) > 1] for t in texts]
        assert [x.tolist() for x in suffix.repeated(texts, size, 60)] == want


def test_equal_windows_have_equal_anchors(monkeypatch):
    rng = random.Random(7)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 300))) for _ in range(6)]
    data = np.frombuffer(b"".join(texts) + bytes(8), dtype=np.uint8).copy()
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    whole = anchors.stretches(data, offsets, 24, 8)
    seen = {}
    for d, first, size, place, gram in zip(whole.doc, whole.first, whole.size, whole.anchor, whole.gram):
        for i in range(first, first + size - 23):
            key = texts[d][i : i + 24]
            assert len(key) == 24 and seen.setdefault(key, (gram, first + place - i)) == (gram, first + place - i)
    assert sum(whole.size - 23) == sum(max(0, len(t) - 23) for t in texts)
    # in small pieces no window is lost or met twice
    monkeypatch.setattr(anchors, "PIECE", 64)
    parts = anchors.stretches(data, offsets, 24, 8)
    assert sum(parts.size - 23) == sum(whole.size - 23)
