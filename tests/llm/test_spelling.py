import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.llm.data import AWKWARD, frame

from paperloom.llm.sorted_edits import code_points, near_pairs
from paperloom.llm.spelling import group_spellings, keyed_words, runs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute(rows, min_length, dominance):
    count = Counter()
    for doc_id, text, *_ in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= min_length:
                count[word] += 1
    count = {w: n for w, n in count.items() if n >= 2}
    found, forms = {}, {}
    for w, n in count.items():
        others = sorted((-m, v) for v, m in count.items() if near(w, v))
        form = others[0][1] if others and -others[0][0] >= dominance * n else None
        forms[w] = form
        found[w] = [n, form, len(others), count[form] if form else None]
    for w in found:
        root = w
        while forms[root]:
            root = forms[root]
        found[w].append(root)
    return {w: tuple(v) for w, v in found.items()}


def run(spark, rows, **how):
    out = group_spellings(frame(spark, rows), **how).collect()
    assert len(out) == len({r.word for r in out})
    return {r.word: (r.n, r.form, r.n_near, r.form_n, r.root) for r in out}


def test_scan_against_all_pairs():
    rng = random.Random(1)
    for _ in range(200):
        groups = [
            sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(6))) for _ in range(rng.randrange(1, 30))})
            for _ in range(rng.randrange(1, 5))
        ]
        texts = [w for g in groups for w in g]
        number = [k for k, g in enumerate(groups) for _ in g]
        i, j = near_pairs(*code_points(texts), np.array([k == 0 for g in groups for k in range(len(g))]))
        want = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if number[a] == number[b] and near(texts[a], texts[b])]
        assert sorted(zip(i.tolist(), j.tolist())) == want


@pytest.mark.parametrize("group_words", [20_000, 3])
def test_against_all_words(spark, group_words):
    rng = random.Random(5)
    bases = ["".join(rng.choice("abcé") for _ in range(rng.randrange(4, 10))) for _ in range(25)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(80):
            word = list(bases[min(24, int(rng.expovariate(0.3)))])
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                k = rng.randrange(len(word))
                word[k : k + rng.randrange(2)] = rng.choice(["", "a", "b", "É"])
            text.append("".join(word) if rng.random() < 0.8 else "".join(word).upper())
        rows.append((rng.choice([i, i, 7, None]), " ".join(text), "en", "s"))
    got = run(spark, rows, min_length=4, dominance=3, group_words=group_words)
    want = brute(rows, 4, 3)
    assert got == want
    assert sum(v[1] is not None for v in want.values()) > 20 and any(v[1] and v[1] != v[4] for v in want.values())


def test_each_pair_has_one_key(spark):
    words = sorted({"".join(p) for p in np.random.default_rng(2).choice(list("ab"), (300, 7))} | {"a" * 8, "a" * 7 + "b"})
    vocabulary = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    for limit in (20_000, 2):
        keys = {}
        for r in keyed_words(vocabulary, 7, limit).collect():
            keys.setdefault(r.key, []).append((r.m, r.cut, r.word))
        found = Counter()
        for members in keys.values():
            for m, cut, a in members:
                for _, _, b in members:
                    shared = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
                    if a < b and near(a, b) and min(len(a), len(b)) == m and shared < cut:
                        found[a, b] += 1
        assert found == Counter((a, b) for a in words for b in words if a < b and near(a, b))


def test_awkward_rows(spark):
    text = "Straße STRASSE strasse naïveté naïvete NAÏVETÉ x" + "y" * 100_000 + " and x" + "y" * 100_000
    rows = [*AWKWARD, *AWKWARD, (20, text, "de", "s"), (21, text, "de", "s"), (21, text, "de", "s")]
    assert run(spark, rows) == brute(rows, 7, 10)
    assert run(spark, []) == {}
    assert runs("aÉ×b漢c-d\ud800E") == ["aé×b".replace("é", "É").encode("latin-1"), b"c", b"d", b"e"]
