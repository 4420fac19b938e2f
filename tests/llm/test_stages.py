"""Decisions of the pipeline's stages on planted rows."""

import random

from paperloom.llm import stages
from tests.llm.data import frame, words

SF = "/root/testdata/sf0.01"


def random_text(rng, alphabet, n):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 10))) for _ in range(n))


def test_language_rejects_random_and_keeps_short_texts(spark):
    rng = random.Random(4)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    latin, cyrillic = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    planted = [(-1 - i, random_text(rng, a, n)) for i, (a, n) in enumerate([(a, n) for a in (latin, cyrillic) for n in (30, 200) for _ in range(20)])]
    rows = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in planted], docs.schema)
    kept = {r.doc_id for r in stages.language(spark, docs.union(rows), SF).select("doc_id").collect()}
    known = {r.doc_id for r in docs.where("lang is not null and text rlike '[A-Za-z]'").collect()}
    assert known <= kept and {564, 909} <= kept  # clean documents of a few words
    assert not {i for i, _ in planted} & kept


def contents(df):
    return sorted((str(r.doc_id), r.text) for r in df.select("doc_id", "text").collect())


def test_rows_without_an_id_or_with_a_repeated_one_are_judged_one_by_one(spark):
    rng = random.Random(6)
    a, b, c, d, e = (words(rng, 60, 10**9) for _ in range(5))
    text = " ".join
    near = text([*c[:59], "other"])
    rows = [(None, text(a)), (None, text(b)), (None, near), (3, text(c)), (7, text(d)), (7, text(e)), (7, text([*e[:59], "other"])), (7, text(d))]
    rows += [(7, near)]
    kept = stages.near_duplicates(spark, frame(spark, [(i, t, "en", "src1") for i, t in rows]), SF)
    got = contents(kept)
    sure = sorted([("None", text(a)), ("None", text(b)), ("3", text(c)), ("7", text(d))])
    assert [r for r in got if r[1] not in (text(e), text([*e[:59], "other"]))] == sure and len(got) == 5

    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, text(a)), (None, f"{text(b)} {item}"), (5, text(c)), (5, item)]
    clean = stages.decontaminated(spark, frame(spark, [(i, t, "en", "src1") for i, t in rows]), SF)
    assert contents(clean) == sorted([("None", text(a)), ("5", text(c))])


def test_a_chosen_row_brings_no_other_row_of_its_id(spark):
    rng = random.Random(9)
    rows = [(None, " ".join(words(rng, n)), "en", "src1") for n in range(1, 41)]
    rows += [(4, "one and the same text", "en", "src2")] * 10
    docs = frame(spark, rows)
    out = stages.mixed(spark, docs, SF)
    got = contents(out)
    total = sum(len(t.split()) for _, t, *_ in rows)
    assert out.columns == docs.columns and 0.6 * total < sum(len(t.split()) for _, t in got) <= 0.9 * total
    assert len(set(t for i, t in got if i == "None")) == sum(i == "None" for i, _ in got)
