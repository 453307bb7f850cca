import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from contractlens.llm import substrings


def brute(rows, window):
    seen = Counter()
    raw = [(t or "").encode() for _, t in rows]
    for r in raw:
        seen.update(r[i : i + window] for i in range(len(r) - window + 1))
    out = []
    for (i, _), r in zip(rows, raw):
        cover = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - window + 1):
            if seen[r[k : k + window]] > 1:
                cover[k : k + window] = True
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        kept = bytes(b for b, c in zip(r, cover) if not c)
        out.append((i, len(r), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_array_and_prefixes():
    rnd = random.Random(2)
    for _ in range(60):
        raw = bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 120)))
        buf = np.frombuffer(raw, np.uint8)
        sa = substrings.suffix_array(buf, 256)
        assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        want = [0] + [next((k for k in range(len(raw)) if raw[a : a + k + 1] != raw[b : b + k + 1] or max(a, b) + k >= len(raw)), 0) for a, b in zip(sa[:-1], sa[1:])]
        assert substrings.common_prefixes(buf, sa).tolist() == want


@pytest.mark.parametrize("hot", [6000, 3])
def test_matches_brute_force(spark, hot):
    rnd = random.Random(hot)
    text = lambda n: "".join(rnd.choice("abcdeé \n") for _ in range(n))
    passage, line = text(300), text(230)
    rows = [(i, text(rnd.randrange(0, 900))) for i in range(25)]
    rows += [(100 + i, text(150) + passage[i % 7 : 290 - i] + text(90)) for i in range(20)]
    near = text(700)
    for i in range(12):
        w = list(near)
        w[rnd.randrange(700)] = "#"
        rows.append((200 + i, "".join(w)))
    rows += [(300, line * 3), (301, "xy" * 400), (302, "q" * 199), (303, "q" * 201), (304, None), (305, ""), (306, near), (306, near), (None, near)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, s int").repartition(4)
    got = sorted((tuple(r) for r in substrings.remove_repeats(df, hot_rows=hot).collect()), key=repr)
    assert got == brute(rows, 200)


def test_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_in_slices(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SLICE", 1000)
    rnd = random.Random(8)
    text = "".join(rnd.choice("abcdef") for _ in range(4000))
    roller = substrings.Roller(3000)
    seen = set()
    for _, t, off, f, e, _ in substrings._rows([text.encode(), b"x" * 10], roller, 200, 48):
        for a, b, c in zip(off.tolist(), f.tolist(), e.tolist()):
            seen.update(range(a, a + c - b))
    assert seen == set(range(3801))
