import hashlib
import re

import numpy as np
import pytest

from matchloom.llm import substring_dedup, suffix_dedup, windows


def _brute(rows, width):
    big = float("inf")
    first = {}
    for i, s in rows:
        for k in range(len(s) - width + 1):
            first[s[k : k + width]] = min(first.get(s[k : k + width], big), big if i is None else i)
    out = []
    for i, s in rows:
        gone = bytearray(len(s))
        for k in range(len(s) - width + 1):
            if first[s[k : k + width]] < (big if i is None else i):
                gone[k : k + width] = b"\1" * width
        out.append((i, s, bytes(gone)))
    return out


def _sorted(rows):
    return sorted(rows, key=repr)


def test_words(docs, prose):
    got = _sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.query(docs(prose)).collect())
    rows = [(i, tuple(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in prose]
    want = [(i, len(s), sum(g), hashlib.sha256(" ".join(w for w, x in zip(s, g, strict=True) if not x).encode()).hexdigest()) for i, s, g in _brute(rows, 13)]
    assert got == _sorted(want) and sum(w[2] for w in want) > 500


def test_bytes(docs, prose):
    got = _sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.query(docs(prose)).collect())
    rows = [(i, (t or "").encode()) for i, t in prose]
    want = []
    for i, s, g in _brute(rows, 50):
        kept = bytes(c for c, x in zip(s, g, strict=True) if not x)
        want.append((i, len(s), sum(g), len(re.findall(rb"\x01+", g)), hashlib.sha256(kept).hexdigest()))
    assert got == _sorted(want) and sum(w[2] for w in want) > 2000


def test_empty_table(docs):
    assert substring_dedup.query(docs([], 1)).collect() == [] and suffix_dedup.query(docs([], 1)).collect() == []


def test_texts_of_the_operator(docs):
    line = " ".join(f"t{k}" for k in range(13))
    got = {r.doc_id: r.kept for r in substring_dedup.deduplicate(docs([(1, f"a {line} b"), (2, f"c  {line}\nd")])).collect()}
    assert got == {1: f"a {line} b", 2: "c d"}


def test_long_texts_are_cut_into_stretches(monkeypatch):
    t = windows.Tokens(suffix_dedup._cut, 50, 12)
    raw = np.random.default_rng(1).integers(97, 101, 5000, np.uint8).tobytes()
    whole = windows._anchors_of(raw, t)
    monkeypatch.setattr(windows, "_STRETCH", 300)
    assert (windows._anchors_of(raw, t) == whole).all()


@pytest.mark.parametrize("n", [1, 2, 7, 11, 35])
def test_sliding(n):
    x = np.random.default_rng(n).integers(0, 1 << 60, 100).astype(np.uint64)
    assert (windows._over(x, n, np.minimum, True) == [x[k : k + n].min() for k in range(100 - n + 1)]).all()
    assert (windows._over(x, n, lambda a, b: a + b, False) == [x[k : k + n].sum() for k in range(100 - n + 1)]).all()


def test_passes_sort_only_what_a_digit_parts(monkeypatch):
    """Groups whose windows have one digit are in order; those that a digit parts are still told apart, digit by digit."""
    rng = np.random.default_rng(4)
    group = np.repeat(np.arange(60), 20)
    doc = rng.integers(0, 5, len(group))
    words = np.repeat(rng.integers(0, 9, (60, 3)), 20, 0).astype(np.uint64)
    odd = group % 20 == 7
    words[odd, 2] = rng.integers(0, 3, odd.sum())  # three groups with collisions that only the last digit parts
    sorted_, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorted_.append(len(keys[0])) or lexsort(keys))
    low = {}
    for g, w, d in zip(group.tolist(), map(tuple, words.tolist()), doc.tolist(), strict=True):
        low[g, w] = min(d, low.get((g, w), d))
    want = [k for k, (g, w, d) in enumerate(zip(group.tolist(), map(tuple, words.tolist()), doc.tolist(), strict=True)) if d > low[g, w]]
    for shuffled in (False, True):
        order = rng.permutation(len(group)) if shuffled else np.arange(len(group))
        got = windows.repeated(lambda d, rows: words[order][rows, d], 3, group[order], doc[order])
        assert sorted(order[got].tolist()) == want
    assert sum(sorted_) == 2 * odd.sum()


def test_bytes_at_any_place():
    """Eight bytes read where they lie, in a text of any length, up to its very end."""
    for n in (50, 53, 57, 64):
        text = np.frombuffer(bytes(range(n)), np.uint8)
        at = np.arange(n - 49)
        digit, digits = windows.Bytes(50).digits(text, np.array([0]), np.array([n]), np.zeros(len(at), np.int64), at)
        for d in range(digits):
            k = min(8 * d, 42)
            assert [x.tobytes() for x in digit(d, at)] == [text[a + k : a + k + 8].tobytes() for a in at]
