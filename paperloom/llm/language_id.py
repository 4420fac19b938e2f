"""Language identification with hyperdimensional n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from paperloom.llm.common import map_batches, python_ready

DIMENSION, NGRAM, SEED = 1024, 3, 5
#: Characters of a text that are turned into n-grams at a time.
BLOCK = 1 << 20
#: Letter vectors kept per worker; beyond that they are made anew.
LETTERS = 20_000
#: Cells of the matrix of last letters that `bundle` may fill per n-gram.
FULLNESS = 64
#: Standard deviations of a score by chance that a text gets for free before it is rejected.
NOISE = 3

_IS_LETTER = np.zeros(0, bool)


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, 0 for what is no letter."""
    global _IS_LETTER
    if not len(_IS_LETTER):
        _IS_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_IS_LETTER[points], points, 0).astype(np.int64)


def ngrams(text: str | None, n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (code points, packed) and their counts; none without a letter.

    A run of other characters is one 0, and so are both ends of the text.
    """
    text, parts, carried, any_letter = text or "", [], np.zeros(1, np.int64), False
    for at in range(0, len(text), BLOCK):
        new = _letters(text[at : at + BLOCK])
        any_letter |= bool(new.any())
        points = np.concatenate([carried, new, np.zeros(int(at + BLOCK >= len(text)), np.int64)])
        points = points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]
        if len(points) >= n:
            code = points[: len(points) - n + 1].copy()
            for k in range(1, n):
                code = (code << 21) | points[k : len(points) - n + 1 + k]
            parts.append(np.unique(code, return_counts=True))
        carried = points[-(n - 1) :]
    if not any_letter:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    return merge(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def merge(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, place = np.unique(codes, return_inverse=True)
    return codes, np.bincount(place, counts, len(codes)).astype(np.int64)


@lru_cache(maxsize=LETTERS)
def letter_vector(point: int, dimension: int = DIMENSION, seed: int = SEED) -> np.ndarray:
    """The random vector of +1 and -1 that stands for a code point (0: a word's edge)."""
    bits = np.random.Generator(np.random.Philox(key=[seed, point])).integers(0, 2, dimension, dtype=np.int8)
    return bits * np.int8(2) - np.int8(1)


def _letters_at(codes: np.ndarray, place: int, n: int) -> np.ndarray:
    """The code points at a place of packed n-grams."""
    return (codes >> np.int64(21 * (n - 1 - place))) & np.int64((1 << 21) - 1)


def bundle(codes: np.ndarray, counts: np.ndarray, n: int = NGRAM, dimension: int = DIMENSION) -> np.ndarray:
    """Sum of the n-gram vectors, each the product of its letters' vectors rotated by their place.

    N-grams that differ only in their last letter share the product of the others, so the
    last letters are summed first, by one matrix product, unless most of that matrix would be empty.
    """
    total = np.zeros(dimension, np.float64)
    for at in range(0, len(codes), 4096):
        part, times = codes[at : at + 4096], counts[at : at + 4096]
        heads, row = np.unique(part >> np.int64(21), return_inverse=True)
        last, column = np.unique(_letters_at(part, n - 1, n), return_inverse=True)
        if len(heads) * len(last) > FULLNESS * len(part):
            heads, row, last = part >> np.int64(21), np.arange(len(part)), None
        bound = np.ones((len(heads), dimension), np.int8)
        for k in range(n - 1):
            known, place = np.unique(_letters_at(heads, k + 1, n), return_inverse=True)
            bound *= np.roll(np.stack([letter_vector(int(p), dimension) for p in known]), n - 1 - k, axis=1)[place]
        if last is None:
            known, place = np.unique(_letters_at(part, n - 1, n), return_inverse=True)
            bound = bound * np.stack([letter_vector(int(p), dimension) for p in known])[place]
            total += times.astype(np.float32) @ bound.astype(np.float32)
            continue
        grid = np.bincount(row * len(last) + column, times, len(heads) * len(last)).astype(np.float32)
        ends = np.stack([letter_vector(int(p), dimension) for p in last]).astype(np.float32)
        total += np.einsum("ij,ij->j", grid.reshape(len(heads), len(last)) @ ends, bound.astype(np.float32))
    return total


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """One unit vector per non-null ``lang``, bundled from all n-grams of all its texts."""
    return profiles(docs)[0]


def profiles(docs: DataFrame) -> tuple[dict[str, np.ndarray], dict[str, float]]:
    """The vectors of `learn`, and per language the chance that two of its n-grams are equal.

    The chance is estimated from the length of the summed vector: n-gram vectors are
    nearly orthogonal, so its square is the dimension times the sum of squared counts.

    Every batch adds up its texts' n-grams per language and turns them into one vector;
    the vectors are summed by Spark.  What reaches the driver is one row per language.
    """

    def run(batch):
        found: dict[str, list] = {}
        for text, lang in zip(batch["text"], batch["lang"]):
            codes, counts = ngrams(text)
            if len(codes) and lang is not None:
                found.setdefault(lang, []).append((codes, counts))
        out = []
        for lang, parts in found.items():
            merged = merge(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            out.append((lang, [*bundle(*merged).tolist(), float(merged[1].sum())]))  # the last is the number of n-grams
        return out

    sums = map_batches(docs.select("text", "lang"), run, "lang string, vector array<double>")
    sums = sums.select("lang", F.posexplode("vector").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v")).orderBy("lang").collect()
    units, chances = {}, {}
    for row in rows:
        *vector, total = (p["x"] for p in row["v"])
        norm = max(np.linalg.norm(vector), 1e-12)
        units[row["lang"]], chances[row["lang"]] = np.array(vector) / norm, float(norm**2 / DIMENSION / total**2)
    return units, chances


def predict(text: str | None, langs: list[str], prototypes: np.ndarray) -> tuple[str, float]:
    """Nearest prototype by cosine (ties: first by name); ``und`` and 0 without letters or prototypes."""
    return _nearest(*ngrams(text), langs, prototypes)


def _nearest(codes: np.ndarray, counts: np.ndarray, langs: list[str], prototypes: np.ndarray) -> tuple[str, float]:
    if not len(codes) or not langs:
        return "und", 0.0
    vector = bundle(codes, counts)
    cosines = prototypes @ (vector / max(np.linalg.norm(vector), 1e-12))
    best = int(np.argmax(cosines))
    return langs[best], float(min(1.0, max(0.0, cosines[best])))


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """``doc_id, lang_pred, score`` per row of `docs` (doc_id, text)."""
    langs, table = _table(docs, prototypes)

    def run(batch):
        return [(i, *predict(t, langs.value, table.value)) for i, t in zip(batch["doc_id"], batch["text"])]

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def expected_score(counts: np.ndarray, chance: float) -> float:
    """Cosine that n-grams with these counts have on average if drawn from a language with this `chance` (see `profiles`)."""
    return float(counts.sum() * np.sqrt(chance) / np.sqrt((counts.astype(np.float64) ** 2).sum()))


def is_known(text: str | None, langs: list[str], prototypes: np.ndarray, chances: dict[str, float], share: float) -> bool:
    """Whether the text's n-grams are `share` times as usual in the nearest language as its own are, or may be.

    What any text scores by chance has the standard deviation of a random direction,
    ``1 / sqrt(DIMENSION)``; a text that misses by less than `NOISE` of these stays, so
    short texts, whose expected score is within the noise, are not judged.
    """
    codes, counts = ngrams(text)
    lang, score = _nearest(codes, counts, langs, prototypes)
    return lang != "und" and score + NOISE / np.sqrt(DIMENSION) >= share * expected_score(counts, chances[lang])


def keep_known(
    docs: DataFrame, prototypes: dict[str, np.ndarray], min_score: float, chances: dict[str, float] | None = None
) -> DataFrame:
    """Rows of `docs`, unchanged, whose text has a language with at least `min_score`.

    With `chances` of the languages, `min_score` is a share of the score that is expected
    for the text's n-grams (`is_known`), else a cosine.
    """
    langs, table = _table(docs, prototypes)
    python_ready(docs.sparkSession)

    def known_text(text):
        if chances is not None:
            return bool(is_known(text, langs.value, table.value, chances, min_score))
        lang, score = predict(text, langs.value, table.value)
        return lang != "und" and score >= min_score

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([known_text(t) for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _table(docs: DataFrame, prototypes: dict[str, np.ndarray]):
    context = docs.sparkSession.sparkContext
    langs = list(prototypes)
    table = np.array([prototypes[x] for x in langs]) if langs else np.zeros((0, DIMENSION))
    return context.broadcast(langs), context.broadcast(table)


def held_out() -> Column:
    """Whether crc32 of the id's text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row of `docs` (doc_id, text, lang).

    Learned from text and non-null lang of the rows that are not held out.  A null text,
    or one without a letter, is ``und`` with score 0, as is every text when nothing could
    be learned.  Repeated rows each count and each get their answer.
    """
    flagged = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    prototypes = learn(flagged.where("not held_out"))
    return identify(flagged, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
