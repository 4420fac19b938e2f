import random
import re

from paperloom.llm.decontaminate import MASKS, MIN_WORDS, find_leaks
from tests.llm.data import AWKWARD, frame, words


def brute(docs, items):
    """Best overlap of every pair over all alignments that share a seed."""
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    best = {}
    for doc_id, text, *_ in docs:
        a = split(text)
        for item_id, item in items:
            b = split(item)
            if len(b) < 5:
                continue
            for shift in range(-len(b) + 1, len(a)):
                same = [0 <= shift + i < len(a) and a[shift + i] == b[i] for i in range(len(b))]
                seeded = any(
                    all(same[p + q] for q, c in enumerate(m) if c == "1") and 0 <= shift + p and shift + p + len(m) <= len(a)
                    for m in MASKS for p in range(len(b) - len(m) + 1)
                )
                if not seeded:
                    continue
                answer = (0, 0)
                for i in range(len(same)):  # all stretches, by the definition
                    for j in range(i + 1, len(same) + 1):
                        matched = sum(same[i:j])
                        if same[i] and same[j - 1] and 5 * matched >= 4 * (j - i) and matched >= min(MIN_WORDS, len(b)):
                            answer = max(answer, (j - i, matched))
                if answer[1]:
                    best[doc_id, item_id] = max(best.get((doc_id, item_id), (0, 0)), answer)
    return best


def run(spark, docs, items):
    bench = spark.createDataFrame([(*i, "clash", "clash") for i in items], "item_id long, text string, doc_id string, row string")
    return {(r.doc_id, r.item_id): (r.n_words, r.n_match) for r in find_leaks(frame(spark, docs), bench).collect()}


def test_against_all_alignments(spark):
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, rng.choice([5, 7, 20, 40])))) for i in range(8)]
    items += [(50, None), (51, ""), (52, "four words are few"), (0, " ".join(words(rng, 15)))]
    docs = []
    for i in range(60):
        text = words(rng, 60)
        passage = (rng.choice(items)[1] or "").split()
        for _ in range(rng.randrange(5)):
            if passage:
                passage[rng.randrange(len(passage))] = "other"
        at = rng.randrange(60)
        docs.append((i, " ".join(text[:at] + passage[rng.randrange(3) :] + text[at:]).upper(), "en", "s"))
    found = run(spark, docs, items)
    assert found == brute(docs, items) and len(found) > 20


def test_awkward_rows(spark):
    items = [(1, "no id at all but some words here"), (None, "same text again and again and again same text")]
    found = run(spark, AWKWARD, items)
    assert found == brute(AWKWARD, items)
    assert set(found) == {(None, 1), (6, None), (7, None)}
    assert run(spark, [], items) == {} and run(spark, AWKWARD, []) == {}
