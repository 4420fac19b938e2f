"""Personal data: fixed patterns, wide candidate generators, and boosted trees that choose among them.

The fixed patterns find what is written plainly.  Generators of high recall propose much
more: spelt or bracketed addresses, spaced quads, numbers without a prefix or with odd
separators, and every run of digit groups inside a longer one.  The trees learn which of
these to take from the corpus itself: plain spans are rewritten, where they stand, into
such forms (right) and into near misses (wrong), and proposals that their own format or
context contradicts are wrong as well.  All other proposals teach nothing.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from paperloom.llm.boosting import LOCAL_ROWS, BoostedTrees, thresholds
from paperloom.llm.common import map_batches, numbered
from paperloom.session import materialise

KINDS = ("email", "ip", "card", "phone")
#: Seed of the order in which every third example is kept from the trees; the share that must be right.
SEED, PRECISION = 17, 0.98

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a failing start inside a run of digits fails for the whole run, so runs are tried once
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_AT = r"(?:\s?(?:@|[\[({]\s?(?:at|@)\s?[\])}])\s?|\s{1,3}at\s{1,3})"
_DOT = r"(?:\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\s{1,3}dot\s{1,3}|\.)"
_MAIL_LIKE = re.compile(rf"(?<![\w.+-])[\w.+-]{{1,64}}{_AT}[\w-]{{1,63}}(?:{_DOT}[\w-]{{1,63}})+", re.I)
_MAIL_HINT = re.compile(r"@|[\[({]\s?at\s?[\])}]|\sat\s", re.I)
_POINT = r"\s?(?:\.|[\[(]\s?\.\s?[\])])\s?"
_QUAD = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{_POINT}[0-9]{{1,3}}){{3}}(?![0-9])")
_GROUPS = re.compile(r"\+?\(?[0-9]+\)?(?:[ ./\-]{1,2}\(?[0-9]+\)?)*")
_GROUP = re.compile(r"[+(]?[0-9]+\)?")
_CONTEXT = re.compile(r"mail|phone|tel|call|card|visa|contact|addr|fax|mobile|host|server|\bip\b", re.I)
_VERSION = re.compile(r"(?:\bv|version|ver\.?|release|section|§)\s?$", re.I)
_DATE = re.compile(r"(?:[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})")
_THOUSANDS = re.compile(r"[0-9]{1,3}(?:[ .][0-9]{3})+$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` of the fixed patterns: leftmost, not overlapping within a kind."""
    found = []
    end, p = 0, text.find("@")
    while p >= 0:  # each @ takes all characters before it that may belong to a name
        start = p
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, p) if start < p else None
        if match:
            end = match.end()
            found.append((0, start, end))
        p = text.find("@", max(p + 1, end))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append((3, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], s[0], s[2]))


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Overlapping proposals of high recall, each with the kind it may be.

    A run of digit groups proposes each part of it, from group to group, that has as many
    digits as a card or a phone number and no single digit behind its first group, so a
    run of n groups makes a few n proposals.
    """
    found = []
    if _MAIL_HINT.search(text):
        found += [(0, *m.span()) for m in _MAIL_LIKE.finditer(text)]
    found += [(1, *m.span()) for m in _QUAD.finditer(text)]
    for m in _GROUPS.finditer(text):
        if m.end() - m.start() < 9:
            continue
        groups = [g.span() for g in _GROUP.finditer(text, *m.span())]
        sizes = [sum(c.isdigit() for c in text[s:e]) for s, e in groups]
        for i, (start, _) in enumerate(groups):
            total = 0
            for j in range(i, len(groups)):
                total, end = total + sizes[j], groups[j][1]
                if total > 19 or j > i and sizes[j] < 2:  # only the first group may be a single digit
                    break
                if total >= 12:
                    found.append((2, start, end))
                if 9 <= total <= 15:
                    found.append((3, start, end))
    return found


def _side(c: str) -> float:
    return 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isalpha() else 3.0 if c.isdigit() else 4.0


def _parts(s: str) -> list[str]:
    return [x for x in re.split(r"[^0-9]+", s) if x]


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format of a candidate and what stands around it."""
    s, before = text[start:end], text[max(0, start - 24) : start]
    digits, parts = _digits(s), _parts(s)
    host = re.split(_AT, s, maxsplit=1, flags=re.I)[-1]
    top = re.split(r"[^\w]+", host)[-1]
    separators = [c for c in s if not c.isalnum()]
    lengths = [len(x) for x in parts] or [0]
    return [
        float(kind), float(len(s)), float(len(digits)), float(len(separators)), float(len(set(separators))),
        float(s.startswith("+")), float("(" in s), float(s.count(".")), float(s.count("-")), float(s.count(" ")), float(s.count("/")),
        float(12 <= len(digits) <= 19 and luhn(digits)), float(digits[:1] in ("3", "4", "5", "6") and bool(digits)),
        float(max((int(x[:6]) for x in parts), default=0) <= 255), float(len(parts)), float(max(lengths)), float(min(lengths)),
        float(lengths[0]), float(lengths[-1]), float("@" in s), float("[" in s or "{" in s), float(bool(re.search(r"\sdot\s", s, re.I))),
        float(bool(re.search(r"\sat\s", s, re.I))), float(len(top)), float(top.isascii() and top.isalpha()),
        float(bool(_DATE.search(s))), float(bool(_THOUSANDS.match(s))), float(bool(_VERSION.search(before))),
        _side(text[start - 1 : start]), _side(text[end : end + 1]), float(bool(_CONTEXT.search(before))),
    ]


def contradicted(text: str, kind: int, start: int, end: int) -> bool:
    """Whether a proposal's own format or context speaks against it."""
    s, before = text[start:end], text[max(0, start - 24) : start]
    if kind == 0:  # "at" as a word, and a full stop: a sentence that goes on
        return not re.search(r"@|[\[({]", s) and not re.search(r"\sdot\s", s, re.I)
    if kind == 1:
        return any(int(x) > 255 for x in _parts(s)) or bool(_VERSION.search(before)) or text[end : end + 1] == "."
    if kind == 2:
        return not luhn(_digits(s))
    plain = len(_parts(s)) == 1 and not s.startswith("+") and not _CONTEXT.search(before)
    return plain or bool(_DATE.search(s)) or bool(_THOUSANDS.match(s))


def rewritten(kind: int, plain: str) -> tuple[list[str], list[str]]:
    """Other ways to write a span of the fixed patterns, and near misses that look like them."""
    digits = _digits(plain)
    if kind == 0:
        name, host = plain.rsplit("@", 1)
        dots = host.split(".")
        name = name.replace("%", "")
        right = [f"{name}{a}{d.join(dots)}" for a, d in ((" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("@", "[.]"), (" [at] ", "."))]
        return right, [f"{dots[0]} at {dots[-1]}.{name[:8].strip('.+-') or 'x'}"]
    if kind == 1:
        parts = plain.split(".")
        return [" . ".join(parts), "[.]".join(parts), ". ".join(parts)], [" . ".join([*parts[:3], str(300 + int(parts[3]))])]
    fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
    if kind == 2:
        wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
        missed = [wrong[i : i + 4] for i in range(0, len(wrong), 4)]
        return [x.join(fours) for x in (".", "/", "  ", " - "[:2])], [x.join(missed) for x in (".", "/", "  ", " ", "-")] + [wrong]
    head, body = digits[: max(0, len(digits) - 10)], digits[-10:]
    local = [body[:3], body[3:6], body[6:]]
    if len(body) < 10:
        head, local = "", [body[:3], body[3:6], body[6:]]
    shown = ([head] if head else []) + local
    thousands = re.sub(r"(?<=[0-9])(?=(?:[0-9]{3})+$)", " ", body)
    right = [" ".join(local), "-".join(local), ".".join(local), f"({local[0]}) {local[1]}-{local[2]}", " ".join(shown), "/".join(local)]
    return [x for x in right if 9 <= len(_digits(x))], [digits, thousands, f"{body[:4]}-{body[4:6]}-{body[6:8]} {body[8:]}"]


def _same_span(kind: int, start: int, end: int, kinds: dict[int, tuple[list[int], list[int]]]) -> bool | None:
    """True where a proposal covers four fifths of a span of its kind and no more; None where it touches one."""
    touched = False
    for k, (starts, ends) in kinds.items():
        i = bisect.bisect_right(ends, start)
        while i < len(starts) and starts[i] < end:  # spans of a kind do not overlap
            touched = True
            if k == kind and 5 * (min(end, ends[i]) - max(start, starts[i])) >= 4 * (max(end, ends[i]) - min(start, starts[i])):
                return True
            i += 1
            if i < len(starts) and starts[i] < end and k != kind:
                break
    return None if touched else False


def examples(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, bool, list[float]]]:
    """``kind, right, features`` from each span of `base`, rewritten between what stands before and behind it."""
    out = []
    for kind, start, end in base:
        before, behind = text[max(0, start - 24) : start], text[end : end + 2]
        right, wrong = rewritten(kind, text[start:end])
        choice = zlib.crc32(text[start:end].encode("utf-8", "surrogatepass"))
        for forms, good in ((right, True), (wrong, False)):
            form = forms[choice % len(forms)] if forms else ""
            window, at = before + form + behind, (len(before), len(before) + len(form))
            for k, s, e in candidates(window):
                if k == kind and (s, e) == at:
                    out.append((kind, good, features(window, k, s, e)))
                elif good and k == kind and s >= at[0] and e <= at[1] and 5 * (e - s) < 4 * len(form):
                    out.append((kind, False, features(window, k, s, e)))  # a part of the whole
    return out


SCANNED = (
    "doc_id long, base array<struct<kind: int, start: int, end: int>>, "
    "proposed array<struct<kind: int, start: int, end: int, x: array<double>>>, "
    "examples array<struct<kind: int, right: boolean, x: array<double>>>"
)


def scan(docs: DataFrame) -> DataFrame:
    """Base spans, proposals that touch none of them, and examples to learn from, per row of `docs` (doc_id, text)."""

    def run(batch):
        out = []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            text = text or ""
            base, proposed = base_spans(text), []
            learned = examples(text, base)
            kinds = {k: ([s for x, s, _ in base if x == k], [e for x, _, e in base if x == k]) for k in {b[0] for b in base}}
            for kind, start, end in candidates(text):
                same = _same_span(kind, start, end, kinds)
                if same is None or same:
                    if same:
                        learned.append((kind, True, features(text, kind, start, end)))
                    continue
                x = features(text, kind, start, end)
                proposed.append({"kind": kind, "start": start, "end": end, "x": x})
                if contradicted(text, kind, start, end):
                    learned.append((kind, False, x))
            out.append((doc_id, [dict(zip(("kind", "start", "end"), b)) for b in base], proposed,
                        [dict(zip(("kind", "right", "x"), e)) for e in learned]))
        return out

    return map_batches(docs.select("doc_id", "text"), run, SCANNED)


def fit(scanned: DataFrame, local_rows: int = LOCAL_ROWS) -> tuple[BoostedTrees | None, list[float]]:
    """Trees and one threshold per kind, from all examples.

    Two thirds fit the trees; on the rest, every third by a seeded hash, each kind's
    threshold is the lowest at which enough of what it takes is right.  A kind that cannot
    reach that, or without examples, adds nothing.  Equal examples travel as one with their number.
    """
    rows = scanned.select("doc_id", F.explode("examples").alias("e")).select("doc_id", "e.kind", "e.right", "e.x")
    rows = rows.withColumn("_hash", F.xxhash64(F.lit(SEED), "doc_id", "kind", "x"))
    rows = numbered(rows, ["_hash", "x", "right"], None, "numbered")
    rows = rows.groupBy("kind", "right", "x", ((F.col("_start") % 3) == 2).alias("unseen")).agg(F.count("*").alias("n"))
    rows = materialise(rows, "distinct")
    if rows.select("right").distinct().count() < 2:
        return None, [2.0] * len(KINDS)
    seen = rows.where("not unseen").select("x", F.col("right").cast("double").alias("y"), "n")
    trees = BoostedTrees().fit_table(seen, local_rows)

    def run(batch):
        score = trees.predict(np.array(batch["x"])).tolist() if batch["x"] else []
        return list(zip(batch["kind"], score, batch["right"], batch["n"]))

    scored = map_batches(rows.where("unseen").select("kind", "x", "right", "n"), run, "kind int, score double, right boolean, n long")
    found = thresholds(scored, PRECISION)
    return trees, [found.get(k, 2.0) for k in range(len(KINDS))]


def chosen(proposed: list[dict], score: np.ndarray, thresholds: list[float]) -> list[tuple[int, int, int]]:
    """The accepted proposals, surest first (ties: the longer), none touching another."""
    starts: list[int] = []
    ends: list[int] = []
    taken = []
    for i in sorted(range(len(proposed)), key=lambda i: (-score[i], proposed[i]["start"] - proposed[i]["end"], i)):
        p = proposed[i]
        if score[i] < thresholds[p["kind"]]:
            continue
        at = bisect.bisect_left(starts, p["end"])  # taken spans are disjoint: only the last before the end can touch
        if at and ends[at - 1] > p["start"]:
            continue
        starts.insert(at, p["start"])
        ends.insert(at, p["end"])
        taken.append((p["kind"], p["start"], p["end"]))
    return taken


def _text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], x[0], x[2])))


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): base counts, base_sha256 and all ``spans``.

    ``n_email`` to ``n_phone`` count the base spans, base_sha256 is over ``kind:start:end``
    of these, comma-joined in order (code points, end exclusive).  ``spans`` adds the
    proposals that the trees accept, surest first, where they touch neither a base span
    nor another accepted one.  A null or empty text has none, a null doc_id stays null,
    repeated rows get equal results, and other columns are ignored.
    """
    scanned = materialise(scan(docs), "scanned")
    trees, thresholds = fit(scanned)

    def run(batch):
        out = []
        for doc_id, base, proposed in zip(batch["doc_id"], batch["base"], batch["proposed"]):
            base = [(b["kind"], b["start"], b["end"]) for b in base]
            taken = list(base)
            if proposed and trees is not None:
                taken += chosen(proposed, trees.predict(np.array([p["x"] for p in proposed])), thresholds)
            counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
            out.append((doc_id, *counts, hashlib.sha256(_text_of(base).encode()).hexdigest(), _text_of(taken)))
        return out

    return map_batches(
        scanned, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def redact(text: str | None, spans: str) -> str | None:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first to start."""
    if not text or not spans:
        return text
    out, at = [], 0
    for part in spans.split(","):
        kind, start, end = part.split(":")
        if int(start) >= at:
            out += [text[at : int(start)], f"[{kind}]"]
        at = max(at, int(end))
    return "".join([*out, text[at:]])
