import hashlib
import random
import re

import pytest

from paperloom.llm import chat, pii
from paperloom.llm.boosting import BoostedTrees, threshold_for
from paperloom.llm.templates import Template, TemplateError, parse
from tests.llm.data import AWKWARD, frame


def plain_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append((3, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_base_spans_against_the_patterns():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice("ab.@-+ 0123459()%é\n") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_long_runs_take_no_quadratic_time():
    pii.base_spans("a" * 300_000 + " @ " + "1" * 300_000 + "+" * 1000)


def test_added_spans_keep_base(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        card = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        card += next(d for d in "0123456789" if pii.luhn(card + d))
        bits = [f"mail me{i}@host{i % 7}.example.com now", f"card {card} ok", f"number {rng.randrange(10**15, 10**16)} no",
                f"at 10.0.{i % 256}.7 and v1.2.300.4", f"call +1 (555) 555-{1000 + i} ok"]
        rows.append((i, " ".join(rng.sample(bits, 3)), "en", "s"))
    rows += [(900 + i, t, "en", "s") for i, (_, t, *_) in enumerate(AWKWARD)]
    out = {r.doc_id: r for r in pii.find_pii(frame(spark, rows)).collect()}
    assert len(out) == len(rows)
    for i, text, *_ in rows:
        base = plain_spans(text or "")
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        r = out[i]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in base) for x in range(4))
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(",")) | {""}
    assert pii.find_pii(frame(spark, [])).collect() == []
    assert pii.find_pii(frame(spark, [(1, "no digits", "en", "s"), (None, None, "en", "s")])).count() == 2


def _card(rng):
    card = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return card + next(d for d in "0123456789" if pii.luhn(card + d))


def test_the_trees_add_what_the_patterns_miss(spark):
    """Off-pattern forms of other people's data are found, clean numbers beside them are not."""
    rng = random.Random(11)
    fill = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"]) for _ in range(6))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows, planted, clean = [], {}, {}
    for i in range(400):  # the corpus that teaches: plain forms only
        plain = [f"u{i}.x{i % 9}@mail{i % 7}.example.org", f"10.{i % 256}.{i % 99}.7", _card(rng), f"+1 ({rng.randrange(200, 999)}) 555-{1000 + i}"]
        rows.append((i, f"{fill()} {plain[i % 4]} {fill()}", "en", "s"))
    for i in range(400, 700):
        area, card = rng.randrange(200, 999), _card(rng)
        hidden, kind = [
            (f"jo{i} [at] host{i % 5} [dot] example [dot] net", "email"), (f"an{i}(at)box{i % 5}(dot)example", "email"), (f"{area} 555 {1000 + i}", "phone"),
            (f"({area}) 555-{1000 + i}", "phone"), (".".join(card[k : k + 4] for k in range(0, 16, 4)), "card"), (f"172[.]16[.]{i % 250}[.]9", "ip"),
        ][i % 6]
        other = [
            f"version 3.2.{300 + i}.4", f"20{i % 90 + 10}-0{i % 9 + 1}-1{i % 9} 12", f"order {number(11)}", f"{rng.randrange(1, 99)} {number(3)} {number(3)} {number(3)}",
            "see you at noon.Then we eat", f"{number(4)}/{number(4)}/{number(3)}9/{'5' if pii.luhn('0') else '1'}",
        ][rng.randrange(5)]
        left = f"{fill()} {hidden} {fill()}; "
        planted[i] = (kind, len(left) - len(f" {hidden} ") - len(left.split(hidden)[1]) + 1, hidden)
        clean[i] = (len(left), len(left) + len(other))
        rows.append((i, left + other, "en", "s"))
    out = {r.doc_id: r for r in pii.find_pii(frame(spark, rows)).collect()}
    hits, false = 0, 0
    for i, (kind, _, hidden) in planted.items():
        text = rows[i][1]
        start = text.index(hidden)
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in out[i].spans.split(",") if x)]
        hits += any(k == kind and s <= start + 1 and e >= start + len(hidden) - 1 for k, s, e in spans)
        base = plain_spans(text)
        false += sum(s < clean[i][1] and e > clean[i][0] for k, s, e in spans if (pii.KINDS.index(k), s, e) not in base)
    assert hits >= 0.9 * len(planted), hits
    assert hits >= 0.95 * (hits + false), (hits, false)


def test_numbers_in_plenty_take_linear_time():
    import time

    took = []
    for n in (5_000, 20_000):
        text = "12 34 56 78 90.1.2.3 " * n
        start = time.perf_counter()
        base, found = pii.base_spans(text), pii.candidates(text)
        pii.chosen([{"kind": k, "start": s, "end": e} for k, s, e in found], [0.9] * len(found), [0.5] * 4)
        took.append(time.perf_counter() - start)
        assert len(found) < 40 * n and len(base) <= 4 * n
    assert took[1] < 12 * took[0]


def test_redaction():
    assert pii.redact("write a@b.c or +1 555 5550123", "email:6:11,phone:15:29") == "write [email] or [phone]"
    assert pii.redact(None, "") is None and pii.redact("x", "") == "x"


def test_trees_learn_an_interaction():
    import numpy as np

    x = np.random.default_rng(1).random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    p = BoostedTrees().fit(x[:3000], y[:3000]).predict(x[3000:])
    assert ((p > 0.5) == y[3000:]).mean() > 0.95
    assert threshold_for(np.array([0.9, 0.8, 0.7]), np.array([1.0, 0.0, 0.0]), 0.9) == 0.9
    assert threshold_for(np.array([0.9]), np.array([0.0]), 0.9) == 2.0


def test_tables_of_examples_give_the_trees_and_thresholds_of_all_rows(spark):
    """Counted rows, added up by Spark or by the driver, teach what the same rows teach one by one."""
    import numpy as np

    from paperloom.llm.boosting import thresholds

    rng = np.random.default_rng(3)
    x = np.floor(rng.random((3000, 3)) * [40, 5, 2])
    y = ((x[:, 0] > 21) ^ (x[:, 1] > 2) ^ (rng.random(3000) < 0.1)).astype(float)
    plain = BoostedTrees(rounds=4).fit(x, y)
    table = spark.createDataFrame([(a, b, 1) for a, b in zip(x.tolist(), y.tolist())], "x array<double>, y double, n long").repartition(7)
    for local_rows in (0, 20_000):
        assert BoostedTrees(rounds=4).fit_table(table, local_rows).trees == plain.trees
    score, kind = np.round(plain.predict(x), 3), np.arange(3000) % 2
    truth = (y == 1) & (kind == 1) | (kind == 0) & (score > 0.7)
    rows = spark.createDataFrame(list(zip(kind.tolist(), score.tolist(), truth.tolist(), [1] * 3000)), "kind int, score double, right boolean, n long")
    for precision in (0.8, 0.9, 0.98, 1.0):
        want = {k: threshold_for(score[kind == k], truth[kind == k].astype(float), precision) for k in (0, 1)}
        assert {k: thresholds(rows, precision).get(k, 2.0) for k in (0, 1)} == want


def test_every_example_counts(spark):
    """More examples than any sample would hold: the rare ones move the trees as well."""
    common, rare = ([1.0] * 31, 30_000), ([2.0] * 31, 30)
    rows = [(i, [(0, i % 2 == 0, x)]) for x, n in (common, rare) for i in range(n)]
    rows += [(i, [(0, True, [3.0] * 31)]) for i in range(30)]
    scanned = spark.createDataFrame(rows, "doc_id long, examples array<struct<kind: int, right: boolean, x: array<double>>>")
    seen = []
    fitted = BoostedTrees.fit_table

    def spy(self, table, local_rows):
        seen.append(table.selectExpr("sum(n)").first()[0])
        return fitted(self, table, local_rows)

    BoostedTrees.fit_table = spy
    try:
        trees, cuts = pii.fit(scanned)
    finally:
        BoostedTrees.fit_table = fitted
    assert seen == [20_040] and len(cuts) == len(pii.KINDS) and cuts[1:] == [2.0] * 3


# chat --------------------------------------------------------------------------------------

SCHEMA = "conv_id long, turn long, role string, text string, seq string, piece int, start string, loss string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, "x", "y") for r in rows], SCHEMA)


def test_escape_is_reversible():
    rng = random.Random(8)
    alphabet = ["<", "/s>", "[", "INST]", "/INST]", "\\", "ROLE]", "x", " ", "</s>", "[INST]", "é"]
    for _ in range(5000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(9)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROLS)


def test_conversations_round_trip(spark):
    rng = random.Random(6)
    alphabet = ["</s>", "[INST] ", " [/INST]", "[ROLE]", "a", "\n", "<\\/s>", "é", "<", "["]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "[ROLE]x", "", None]), "".join(rng.choice(alphabet) for _ in range(6)))
            for c in range(25) for t in range(rng.randrange(1, 9))]
    rows += [(None, 1, "user", None), (99, None, "assistant", ""), (99, 0, "user", "x"), (99, 0, "user", "x"), (77, 0, "assistant", "long " * 90_000)]
    out = {r.conv_id: r for r in chat.read_conversations(chat.format_conversations(turns(spark, rows))).collect()}
    low = lambda v: (v is not None, v if v is not None else "")
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (low(r[1]) if r[1] is not None else (False, 0), low(r[2]), low(r[3])))
        text = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in mine)
        learned = "".join(t or "" for _, _, r, t in mine if r == "assistant")
        got = out[conv]
        assert got.n_turns == len(mine) and got.turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert got.loss_chars == len(learned) and got.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        whole, _ = Template(chat.TEMPLATE, chat.escape).render((r or "", t or "") for _, _, r, t in mine)
        assert got.formatted_chars == len(whole)
    assert chat.format_conversations(turns(spark, [])).collect() == []


def test_templates():
    t = Template("A{% for m in messages %}{% if loop.first and m.role == 'user' %}<{{ m.text | upper }}>{% elif not loop.last %}-{% else %}"
                 "{% generation %}{{ 'x' + m.text }}{% endgeneration %}{% endif %}{% endfor %}Z", chat.escape)  # fmt: skip
    assert t.render([("user", "hi"), ("b", "c"), ("b", "d")]) == ("A<HI>-xdZ", [(6, 8)])
    assert t.render([]) == ("", [])
    nodes = parse("a{{ 'b' + 'c' | upper }}{% if 'x' == 'x' %}d{% else %}{{ m.text }}{% endif %}{% if false %}no{% endif %}e", {"upper": str.upper})
    assert len(nodes) == 1 and nodes[0].value.value == "abCde"
    for bad in ("{{ m.__class__ }}", "{{ open }}", "{% if m.role %}", "{{ m.text | eval }}", "{% for x in y %}{% endfor %}", "{{ 'a' 'b' }}", "{{ ( 'a' }}",
                "{% endif %}", "{{ }}", "{{ ? }}", "no loop"):
        with pytest.raises(TemplateError):
            Template(bad, chat.escape)
