"""Mixing, url rules, token files, shards and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from paperloom.llm import mixing, sharding, stages, tokens, url_rules
from paperloom.llm.decontaminate import _WORD
from paperloom.session import materialise
from tests.llm.data import AWKWARD, frame
from tests.llm.test_near_dedup import brute as copies_of


# mixing ------------------------------------------------------------------------------------


def fill(budget, children):
    """Shares of (name, weight, capacity) by giving the rest away again and again."""
    done, left = {}, sorted(children, key=lambda c: (c[2] / c[1], str(c[0])))
    while left:
        weights = sum(c[1] for c in left)
        name, weight, capacity = left[0]
        if capacity * weights <= weight * budget:
            done[name], budget, left = capacity, budget - capacity, left[1:]
        else:
            return done | {n: w * budget // weights for n, w, _ in left}
    return done


def slow_mix(rows, levels, weights, share, epochs, seed):
    leaves = defaultdict(list)
    for row in rows:
        leaves[row[2:]].append(row)
    total = sum(r[1] for r in rows)
    weight = lambda k, v: weights.get(levels[k], {}).get(v, 1)
    supply = {p: sum(r[1] for r in rs) for p, rs in leaves.items()}
    supply = {p: s for p, s in supply.items() if s and all(weight(k, v) for k, v in enumerate(p))}
    out = []

    def down(prefix, budget):
        k = len(prefix)
        if k == len(levels):
            size = supply[prefix]
            whole, rest = divmod(budget, size)
            for e in range(whole):
                out.extend((r[0], e) for r in leaves[prefix])
            so_far = 0
            order = lambda r: (hashlib.md5(f"{seed}:{whole}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
            for r in sorted(leaves[prefix], key=order):
                so_far += r[1]
                if so_far <= rest and rest:
                    out.append((r[0], whole))
            return
        names = {p[k] for p in supply if p[:k] == prefix}
        children = [(n, weight(k, n), epochs * sum(s for p, s in supply.items() if p[: k + 1] == (*prefix, n))) for n in names]
        for name, part in fill(budget, children).items():
            down((*prefix, name), part)

    down((), min(total * share[0] // share[1], epochs * sum(supply.values())))
    return sorted((str(a), b) for a, b in out)


def mixed(spark, rows, levels, weights, share, epochs, seed):
    schema = "doc_id long, n_tokens long, " + ", ".join(f"{p} string" for p in levels) + ", epoch string, whole int, budget string"
    df = spark.createDataFrame([(*r, "e", 1, "b") for r in rows], schema)
    return sorted((str(r.doc_id), r.epoch) for r in mixing.mix(df, levels, weights, share, epochs, seed).collect())


@pytest.mark.parametrize("share,epochs", [((1, 2), 1), ((9, 10), 3), ((3, 1), 2)])
def test_mix_against_plain_python(spark, share, epochs):
    rng = random.Random(7)
    rows = [(i, rng.randrange(40), rng.choice(["a", "b", None]), rng.choice("xyz"), rng.choice("pqrs")) for i in range(400)]
    rows += [(i, 500, "a", "x", "p") for i in range(400, 600)]  # one leaf with most of all tokens
    rows += [(None, 5, "b", "x", "p"), (None, 3, "b", "x", "p"), (700, 9, "out", "x", "p"), (701, 0, "b", "zero", "p")]
    weights = {"d": {"a": 5, "b": 3, "out": 0}, "l": {"x": 4}}
    args = (["d", "l", "s"], weights, share, epochs, 3)
    assert mixed(spark, rows, *args) == slow_mix(rows, *args)
    assert mixed(spark, [], *args) == []


def test_shortage_goes_to_siblings_first():
    assert fill(100, [("a", 1, 10), ("b", 1, 200), ("c", 2, 200)]) == {"a": 10, "b": 30, "c": 60}


# url rules ---------------------------------------------------------------------------------


def test_url_rules_against_every_rule(spark):
    rng = random.Random(11)
    label = lambda: rng.choice(["a", "b", "ab", "net", "network", "x-y"])
    path = lambda: "".join(rng.choice(["/", "/en", "/e", "n", "/de/", "é"]) for _ in range(rng.randrange(4)))
    rules = [("block", "net", "/"), ("allow", "net", "/"), ("block", None, "/"), ("allow", "", "")]
    rules += [(rng.choice(["allow", "block"]), ".".join(label() for _ in range(rng.randrange(1, 4))), path()) for _ in range(60)]
    urls = [None, "", "no scheme", "http://", "http://?q", "HTTP://NET/EN?x", "http://net", "x://y://net/", "http://a.net/\n#f", "http://.net./"]
    urls += [f"https://{'.'.join(label() for _ in range(rng.randrange(1, 5))).upper()}{path()}{rng.choice(['', '?a', '#b'])}" for _ in range(400)]
    pages = [(i if i % 50 else None, u, "h", "p", "r", "k") for i, u in enumerate(urls + urls[:30])]
    df = spark.createDataFrame(pages, "page_id long, url string, host string, path string, rule string, key string")
    out = url_rules.judge_urls(df, spark.createDataFrame(rules, "action string, host string, path string"), "other").collect()
    assert len(out) == len(pages)
    merged = {}
    for action, h, p in rules:
        if h is not None:
            merged[h, p] = max(merged.get((h, p), ""), action)
    for r in out:
        fits = [(len(h + p), len(h.split(".")), h + p, a) for (h, p), a in merged.items()
                if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        want = max(fits, default=(0, 0, None, "other"))
        assert (r.rule, r.verdict) == want[2:], (r, want)
    by_url = Counter((r.host, r.path) for r in out)
    assert by_url["net", "/EN"] == 2 and ("", "") in by_url
    empty = spark.createDataFrame([], "action string, host string, path string")
    assert {r.verdict for r in url_rules.judge_urls(df, empty).collect()} == {"allow"}
    assert url_rules.judge_urls(df.limit(0), empty).collect() == []


# token files -------------------------------------------------------------------------------


def test_tokens_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD_TOKENS", 3000)
    rng = random.Random(12)
    odd = ["a  b", " lead", "trail ", "tab\tbed", "x\n\ny", "x \ny", "don't we'll", "a\u00a0b c", "<|endoftext|>", "\n", "é ü\nß 漢字 ok", "!! !", "\0 a"]
    rows = [(i, t, "en", "s") for i, t in enumerate(odd)]
    rows += [(100 + i, " ".join(rng.choice(["the", "The,", "quick", "brown.\nFox", "x1"]) for _ in range(rng.randrange(200))), "en", "s") for i in range(80)]
    rows += [(300 + i, t, "en", "s") for i, (_, t, *_) in enumerate(AWKWARD)] + [(None, "no id", "en", "s")]
    rng.shuffle(rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    out = sorted(tokens.encode_and_read(spark, frame(spark, rows)).collect(), key=lambda r: r.start)
    at = 0
    assert len(out) == len(rows)
    for r, (doc_id, text, *_) in zip(out, sorted(rows, key=lambda r: (r[0] is not None, r[0]))):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tokens.encode_and_read(spark, frame(spark, [])).collect() == []
    again = [(5, "same", "en", "s")] * 3 + [(5, "other", "en", "s")]
    starts = sorted(r.start for r in tokens.encode_and_read(spark, frame(spark, again)).collect())
    assert len(starts) == 4 and starts[0] == 0


def test_grammar_and_random_access():
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 30, rng.integers(0, 300)).astype(np.uint32) for _ in range(60)] + [np.full(101, 7, np.uint32)] * 12
    docs = [np.append(d, np.uint32(0)) for d in docs]
    row = tokens._pack(0, 0, list(range(len(docs))), docs)
    shard = dict(zip([c.split()[0] for c in tokens.SHARD.split(", ")], row))
    rules = np.frombuffer(shard["rules"], "<u4").reshape(-1, 2)
    lengths = np.frombuffer(shard["lengths"], "<i8")
    assert len(rules) and len(shard["symbols"]) < 4 * shard["n_tokens"]
    ends = np.cumsum(np.frombuffer(shard["doc_symbols"], "<i8"))
    for k, ((doc_id, ids), want) in enumerate(zip(tokens._documents(shard), docs)):
        assert doc_id == k and ids.tolist() == want.tolist() == tokens.decode_document(shard, k).tolist()
        symbols = np.frombuffer(shard["symbols"], "<u4")[(ends[k - 1] if k else 0) : ends[k]]
        for p in {0, len(want) // 2, len(want) - 1}:
            assert tokens.token_at(symbols, rules, lengths, p) == want[p]


def test_grammar_leaves_no_pair_that_pays():
    rng = np.random.default_rng(2)
    for _ in range(120):
        n = rng.integers(1, 400)
        ids = rng.integers(0, rng.integers(1, 8), n).astype(np.uint32)
        closing = rng.random(n) < rng.choice([0, 0.05, 0.3])
        closing[-1] = True
        symbols, closes, rules, lengths = tokens.build_grammar(ids, closing)
        assert (tokens.expand(symbols, rules, lengths) == ids).all()
        assert (np.cumsum(tokens._sizes(symbols, lengths))[closes] == np.flatnonzero(closing) + 1).all()
        last, times = {}, Counter()
        for i, pair in enumerate(zip(symbols.tolist(), symbols[1:].tolist())):
            if not closes[i] and not (pair[0] == pair[1] and last.get(pair) == i - 1):
                last[pair] = i
                times[pair] += 1
        assert max(times.values(), default=0) < tokens.MIN_COUNT


def test_grammar_with_more_symbols_than_16_bits():
    rng = np.random.default_rng(3)
    for n in (65_000, 66_000):  # rules take the numbers beyond 16 bits, or the ids alone do
        ids = np.concatenate([np.tile(rng.permutation(n), 2), np.tile(rng.integers(0, n, 3000), 6)]).astype(np.uint32)
        closing = np.arange(len(ids)) % 1001 == 1000
        closing[-1] = True
        symbols, closes, rules, lengths = tokens.build_grammar(ids, closing)
        assert n + len(rules) > 1 << 16 and len(symbols) < len(ids) - 12_000
        assert (tokens.expand(symbols, rules, lengths) == ids).all()
        assert (np.cumsum(tokens._sizes(symbols, lengths))[closes] == np.flatnonzero(closing) + 1).all()
        assert max(Counter(zip(symbols.tolist(), symbols[1:].tolist())).values()) < tokens.MIN_COUNT + 1


def test_grammar_of_one_repeated_word_is_logarithmic():
    ids, closing = np.full(1 << 18, 7, np.uint32), np.zeros(1 << 18, bool)
    closing[-1] = True
    symbols, _, rules, lengths = tokens.build_grammar(ids, closing)
    assert len(symbols) < 16 and len(rules) < 20 and lengths.max() == 1 << 15
    assert (tokens.expand(symbols, rules, lengths) == ids).all()


def test_encoder_cuts_marks_off_and_encodes_a_word_once():
    e = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY))
    words = ["café", "naïve", "don't", "x²", "3×4", "a÷", "漢字", "ȿ", "e\u0301", "it's", "Ġ", "über" * 9, "42", "_", "<", "\x7f"]
    tails = ["", ".", "...", "!?", "'", "!" * 15, "!" * 16, "…", "'s", "$$$"]
    texts = [" ".join(f"{w}{t}\n{t}{w}" for w in words) for t in tails] + [f"{w}{t}" for w in words for t in tails]
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in e.encode(texts)] == want
    known = len(e.uses)
    e.encode(["so word, word. word word? (word)"])
    assert len(e.uses) == known + 6  # so, word, comma, question mark, (word, bracket; the stop was there
    assert [x.tolist() for x in e.encode(texts[::-1])] == want[::-1]


def test_encoder_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    e = tokens.Encoder(public_tokenizers.path(tokens.VOCABULARY))
    rng = random.Random(1)
    for _ in range(30):
        texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(20)) for _ in range(3)]
        assert [x.tolist() for x in e.encode(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# shards ------------------------------------------------------------------------------------


def test_hilbert_curve_visits_neighbours():
    for n, bits in ((2, 4), (3, 3)):
        axes = np.stack([a.ravel() for a in np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij")])
        index = sharding.hilbert_index(list(axes), bits)
        assert sorted(index.tolist()) == list(range(1 << (bits * n)))
        path = axes[:, np.argsort(index)]
        assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_keep_their_law(spark, law):
    rows = [(i, "x" * (i % 97), "en" if i % 3 else "de", f"s{i % 5}") for i in range(503)] + [(5, "same", None, None)] * 40 + AWKWARD[:8]
    docs = frame(spark, rows).withColumn("size", F.coalesce(F.length("text"), F.lit(0)).cast("long") + 16)
    out = sharding.hilbert_shards(docs, ["size", "lang", "source"], 7, law, "size").collect()
    assert len(out) == len(rows) and {r.law for r in out} == {law} and out[0].kept is False
    shards = defaultdict(list)
    for r in out:
        shards[r.shard].append(r)
        assert r.grown_shard is None
    assert set(shards) == set(range(7))
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    sums = [len(s) if law == "rows" else sum(r.size for r in s) for s in shards.values()]
    assert max(sums) - min(sums) <= (1 if law == "rows" else 2 * max(r.size for r in out))
    assert sharding.hilbert_shards(docs.limit(0), ["size", "lang"], 7, law, "size").collect() == []


def test_fewer_rows_than_shards_and_files(spark, tmp_path):
    out = sharding.hilbert_shards(frame(spark, [(1, "a", "en", "s"), (2, "b", "en", "s")]), ["n_chars", "lang"], 40)
    assert sorted(r.slot for r in out.collect()) == [0, 0]
    sharding.write_shards(out, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 2


# pipeline ----------------------------------------------------------------------------------


def test_pipeline_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in docs.orderBy("doc_id").collect()]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, kept, sf), name)
        assert out.columns == docs.columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        now = [r for r in rows if r[0] in {x.doc_id for x in kept.select("doc_id").collect()}]
        if name == "language":
            assert ids >= {r[0] for r in now if len(r[1]) > 20} and len(ids) == out.count()
        if name == "near_dedup":
            assert ids == {int(i) for i, _, c in copies_of(now, 5, 80) if i == c}
        if name == "decontaminate":
            flat = lambda t: f" {' '.join(_WORD.findall(t.lower()))} "  # noqa: E731 - the test tables hold whole items
            assert ids == {r[0] for r in now if not any(flat(t) in flat(r[1]) for _, t in items)}
        if name == "mix":
            total = {r[0]: len(r[1].encode().split()) for r in now}
            share = sum(total[i] for i in ids) / sum(total.values())
            assert 0.8 < share <= 0.9
        kept = out
    final = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert {r.doc_id for r in final.collect()} == {r.doc_id for r in kept.collect()}
    assert corpus_pipeline.run(spark, sf).count() == kept.count()


def test_stages_on_awkward_and_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    for rows in (AWKWARD, []):
        docs = frame(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns and out.count() <= len(rows)
    once = stages.near_duplicates(spark, frame(spark, AWKWARD), sf)
    assert sorted(r.doc_id for r in once.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 6, 8, 9, 10]


def test_shards_keep_columns_with_the_helpers_names(spark):
    names = ["doc_id", "lang", "_part", "_row", "_start", "_curve", "_spread", "_size", "_row_in", "_id0", "row"]
    docs = spark.createDataFrame([(i, "en", *[f"{n}{i}" for n in names[2:]]) for i in range(30)], names)
    for law in ("rows", "bytes"):
        out = sharding.hilbert_shards(docs, ["doc_id", "lang"], 4, law, "doc_id").select(names).collect()
        assert sorted(map(tuple, out)) == sorted(map(tuple, docs.collect()))
