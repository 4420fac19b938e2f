"""Token ids in grammar-compressed shards: tokenised, written and read back by Spark.

A shard holds a run of documents in doc_id order, one row of a Parquet data set:

* ``part, shard``: place in the order; ``n_docs, n_tokens``
* ``doc_ids``: int64 per document, with ``id_valid`` (one byte each: 0 for a null id)
* ``doc_tokens``: int64 per document, its number of ids with the end id
* ``doc_symbols``: int64 per document, its number of symbols in ``symbols``
* ``symbols``: uint32, token ids below `first_rule`, rules from there on
* ``rules``: uint32 pairs; rule k is symbol ``first_rule + k`` and stands for its two symbols
* ``lengths``: int64 per rule, the number of ids it expands to

All numbers are little-endian.  No rule crosses a document's end, so a document, and with
the lengths any id in it, is decoded without its neighbours.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from paperloom.llm.common import map_batches, python_ready
from paperloom.session import shared_dir

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: First symbol that is a rule; above every vocabulary's ids.
FIRST_RULE = 1 << 20
#: A shard is closed once it has so many ids; a longer document is a shard of its own.
SHARD_TOKENS = 1 << 21
#: Replacements that pay for a rule: it takes 16 bytes, and each use saves the 4 bytes of a symbol.
MIN_COUNT = 5
#: Pieces whose ids a worker remembers at most.
REMEMBERED = 600_000
#: Characters of the regular texts that are looked up at once, and new pieces encoded in one text.
GROUP_CHARS, TOGETHER = 1_000_000, 1000

_OTHER_SPACE = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _regular(text: str) -> bool:
    """Every space or line end stands alone between visible characters, and no special token can be there."""
    odd = "  " in text or " \n" in text or "\n " in text or "\n\n" in text or "<|" in text or "\0" in text
    return not odd and text[0] not in " \n" and text[-1] not in " \n" and not _OTHER_SPACE.search(text)


#: Marks that may end a word, as a table over bytes, and the letters and digits before them.
_MARK, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(string.punctuation.encode())] = True
_PLAIN[list((string.ascii_letters + string.digits).encode())] = True
#: Bytes of ASCII letters and of the characters U+00C0 to U+023F, letters but for the signs in `_signs`.
_LETTER = np.zeros(256, bool)
_LETTER[list(string.ascii_letters.encode()) + list(range(0x80, 0xC0)) + list(range(0xC3, 0xC9))] = True
#: The first bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _signs(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Where two bytes are one of the signs U+00D7 and U+00F7."""
    return (one == 0xC3) & ((two == 0x97) | (two == 0xB7))


def _clean(data: bytes) -> bool:
    """Every text in `data`, each with a line end before it, is surely regular; others are looked at one by one."""
    buf = np.frombuffer(data, np.uint8)
    space = (buf == 32) | (buf == 10)
    if space[-1] or (space[1:] & space[:-1]).any() or b"<|" in data:
        return False
    return not (((buf < 32) & (buf != 10)) | (buf == 0xC2) | ((buf >= 0xE1) & (buf <= 0xE3))).any()


def _split(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the pieces of regular texts that begin with a line end each.

    A piece begins at a space or line end, and where up to 15 marks end a word behind a letter or digit (of those known here).
    """
    buf = np.frombuffer(data, np.uint8)
    opens = (buf == 32) | (buf == 10)
    starts = np.flatnonzero(opens)
    ends = np.append(starts[1:], len(buf))
    tail = ends[_MARK[buf[ends - 1]]] - 1
    for _ in range(15):
        before, lead = buf[tail - 1], buf[tail - 2]
        wide = (before >= 0x80) & (before < 0xC0) & (lead >= 0xC3) & (lead < 0xC9) & ~_signs(lead, before)
        opens[tail[_PLAIN[before] | wide]] = True
        tail = tail[_MARK[before]] - 1
        if not len(tail):
            break
    starts = np.flatnonzero(opens)
    return starts, np.diff(starts, append=len(buf))


def _two_words(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of at most 16 bytes as two numbers each."""
    eight = np.ndarray((len(data) + 9,), "<u8", data + bytes(16), strides=(1,))
    return eight[starts] & _FIRST[np.minimum(sizes, 8)], eight[starts + np.minimum(sizes, 8)] & _FIRST[np.maximum(sizes - 8, 0)]


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parts of `flat` one after the other."""
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    return flat[at]


class Encoder:
    """Encodes texts with a tokenizers vocabulary, pieces that come again only once.

    The byte-level vocabulary cuts texts around a line end, before a single space between
    visible characters, and between a letter or digit and the marks that end a word, so
    such pieces can be encoded apart.  Texts with other spacing, or with what may be a
    special token, go to the tokenizer whole.

    A piece of up to 16 bytes is found by them, as two numbers, in a table of slots; longer
    ones in a dict.  Both give a piece's number, and `ends` the place of its ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for words of letters alone, which the file's pre-tokenizer leaves whole, written as it writes them
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.written = np.zeros(256, "<u2")  # the character for each byte
        for char in " " + string.ascii_letters + "".join(map(chr, range(0xC0, 0x240))):
            ((shown, _),) = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(char)
            self.written[list(char.encode())] = list(map(ord, shown))
        vocabulary = self.tokenizer.get_vocab()
        space = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that begin with a space
        space[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True
        line = np.zeros_like(space)
        line[vocabulary["Ċ"]] = True
        self.space, self.line = space, line
        self._empty(1 << 12)

    def _empty(self, slots: int) -> None:
        self.low, self.high, self.number = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.long: dict[bytes, int] = {}
        self.ids, self.ends, self.uses = np.empty(0, np.uint32), np.zeros(1, np.int64), np.empty(0, np.int32)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def _cut(self, ids: list[np.ndarray], opens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of `n` pieces that were encoded many in one text, and their sizes."""
        flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        starts = np.flatnonzero(opens[flat])
        if len(starts) != n:
            raise ValueError("the vocabulary does not cut words at spaces")
        return flat, np.diff(starts, append=len(flat))

    def _learn(self, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Encode new pieces and append their ids; the number of each."""
        if not len(starts):
            return np.empty(0, np.int64)
        buf = np.frombuffer(data, np.uint8)
        flat = _gather(buf, starts, sizes)
        other = ~_LETTER[flat]
        other[1:] |= _signs(flat[:-1], flat[1:])
        other = np.add.reduceat(other, np.cumsum(sizes) - sizes, dtype=np.int64)
        first = buf[starts]
        kinds = np.select([(first == 32) & (other == 1), first == 32, first == 10], [0, 1, 2], 3)
        order = np.argsort(kinds, kind="stable")
        found = []
        for kind in range(4):
            at = order[kinds[order] == kind]
            together = 1 if kind == 3 else TOGETHER
            groups = [at[k : k + together] for k in range(0, len(at), together)]
            texts = [_gather(buf, starts[g], sizes[g]) for g in groups]
            if kind == 0:
                shown = [self.written[t].tobytes().decode("utf-16-le").replace("Ġ", " Ġ") for t in texts]
                coded = self.words.encode_batch_fast(shown, add_special_tokens=False)
                found.append(self._cut([np.array(e.ids, np.uint32) for e in coded], self.space, len(at)))
                continue
            texts = [t.tobytes().decode() for t in texts]
            if kind < 3:
                found.append(self._cut(self._whole(texts), self.space if kind == 1 else self.line, len(at)))
            else:
                marks = self._whole(texts)
                found += [(ids, np.array([len(ids)])) for ids in marks]
        numbers = np.empty(len(starts), np.int64)
        numbers[order] = len(self.uses) + np.arange(len(starts))
        self._append(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
        return numbers

    def _append(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.ends = np.concatenate([self.ends, len(self.ids) + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, flat])
        self.uses = np.concatenate([self.uses, np.zeros(len(sizes), np.int32)])

    def _slots(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each short piece, and places at which each new piece stands once; these have no number yet."""
        mask = len(self.low) - 1
        mixed = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        slot = ((mixed >> np.uint64(32)) & np.uint64(mask)).astype(np.int64)
        todo, new = np.arange(len(low)), []
        while len(todo):
            at = slot[todo]
            free = self.low[at] == 0  # no piece begins with a zero byte
            if free.any():
                asking = todo[free]
                self.number[slot[asking]] = asking  # one of those that want a slot gets it
                winner = asking[self.number[slot[asking]] == asking]
                self.low[slot[winner]], self.high[slot[winner]] = low[winner], high[winner]
                new.append(winner)
            other = (self.low[at] != low[todo]) | (self.high[at] != high[todo])
            todo = todo[other]
            slot[todo] = (slot[todo] + 1) & mask
        return slot, np.concatenate(new) if new else np.empty(0, np.int64)

    def _room(self, coming: int) -> None:
        """Keep a third of the slots free, whatever the coming pieces are; too many are forgotten.

        The pieces that were used more than once stay, at most half of what may be kept.
        """
        known = len(self.uses)
        forget = known and (known + coming > REMEMBERED or len(self.ids) > 8 * REMEMBERED)
        if not forget and len(self.low) >= 1.5 * (known + coming):
            return
        taken = np.flatnonzero(self.low)
        if forget:
            often = np.argsort(-self.uses[self.number[taken]], kind="stable")[: REMEMBERED // 2]
            taken = np.sort(taken[often[self.uses[self.number[taken[often]]] > 1]])
        low, high, number = self.low[taken], self.high[taken], self.number[taken]
        slots = 1 << int(1.5 * ((len(taken) if forget else known) + coming)).bit_length()
        if forget:
            starts, sizes = self.ends[number], np.diff(self.ends)[number]
            flat, number = _gather(self.ids, starts, sizes), np.arange(len(taken))
            self._empty(slots)
            self._append(flat, sizes)
        else:
            self.low, self.high, self.number = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.number[self._slots(low, high)[0]] = number

    def _numbers(self, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each piece; new pieces are learned."""
        numbers = np.empty(len(starts), np.int64)
        short = np.flatnonzero(sizes <= 16)
        slot, new = self._slots(*_two_words(data, starts[short], sizes[short]))
        self.number[slot[new]] = self._learn(data, starts[short[new]], sizes[short[new]])
        numbers[short] = self.number[slot]
        at = np.flatnonzero(sizes > 16)
        pieces = [data[a : a + n] for a, n in zip(starts[at].tolist(), sizes[at].tolist())]
        fresh = {p: k for k, p in zip(at.tolist(), pieces) if p not in self.long}
        where = np.array(list(fresh.values()), np.int64)
        self.long.update(zip(fresh, self._learn(data, starts[where], sizes[where]).tolist()))
        numbers[at] = [self.long[p] for p in pieces]
        return numbers

    def _regular(self, marked: list[bytes], data: bytes) -> list[np.ndarray]:
        """Ids of regular texts, each with a line end before it, whose id is taken off again; `data` is all of them."""
        starts, sizes = _split(data)
        self._room(len(starts))
        numbers = self._numbers(data, starts, sizes)
        self.uses += np.bincount(numbers, minlength=len(self.uses)).astype(np.int32)
        first = self.ends[numbers]
        sizes = self.ends[numbers + 1] - first
        ids = _gather(self.ids, first, sizes)
        total = np.concatenate([[0], np.cumsum(sizes)])
        cuts = total[np.searchsorted(starts, np.cumsum([0] + [len(m) for m in marked]))].tolist()
        return [ids[a + 1 : b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, as ``encode(text, add_special_tokens=False)`` gives them; none for null."""
        out: list = [np.empty(0, np.uint32)] * len(texts)
        groups, held = [[]], 0
        for i, text in enumerate(texts):
            if text:
                if held >= GROUP_CHARS:
                    groups.append([])
                    held = 0
                groups[-1].append(i)
                held += len(text)
        for group in filter(None, groups):
            marked = [b"\n" + texts[i].encode() for i in group]
            data = b"".join(marked)
            if not _clean(data):
                odd = [i for i in group if not _regular(texts[i])]
                for i, ids in zip(odd, self._whole([texts[i] for i in odd])):
                    out[i] = ids
                apart = set(odd)
                marked, group = [m for i, m in zip(group, marked) if i not in apart], [i for i in group if i not in apart]
                data = b"".join(marked)
            if group:
                for i, ids in zip(group, self._regular(marked, data)):
                    out[i] = ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# grammar -----------------------------------------------------------------------------------


def _frequent(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that occur often enough to pay for a rule, ascending, and their counts."""
    ordered = np.sort(codes)
    edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, np.int64)
    counts = np.diff(np.append(edge, len(ordered)))
    often = counts >= MIN_COUNT
    return ordered[edge[often]], counts[often]


def _choose(pairs: np.ndarray, counts: np.ndarray, bits: int, top: int) -> np.ndarray:
    """Places of frequent pairs, most frequent first, none of which can overlap another in the text.

    A symbol is only a left or only a right half in one pass; a pair of equal symbols
    keeps its symbol to itself.
    """
    order = np.argsort(-counts, kind="stable")
    lefts, rights = (pairs[order] >> bits).astype(np.int64), (pairs[order] & ((1 << bits) - 1)).astype(np.int64)
    left, right = lefts.tolist(), rights.tolist()
    side = bytearray(top)  # 1: a left half, 2: a right half, 3: both in one pair
    seen = np.frombuffer(side, np.uint8)
    chosen: list[int] = []
    for begin in range(0, len(order), 1024):
        some = slice(begin, begin + 1024)
        open_ = np.flatnonzero((seen[lefts[some]] < 2) & (seen[rights[some]] % 2 == 0))  # the others are out already
        for k in (begin + open_).tolist():
            a, b = left[k], right[k]
            if side[a] > 1:
                continue
            if a == b:
                if not side[a]:
                    side[a] = 3
                    chosen.append(k)
            elif side[b] in (0, 2):
                side[a], side[b] = 1, 2
                chosen.append(k)
    return order[chosen]


def _every_second(at: np.ndarray) -> np.ndarray:
    """Which of the ascending positions stand where no run of them may be used twice in a row."""
    if not len(at):
        return np.empty(0, bool)
    place = np.arange(len(at))
    first = np.concatenate([[True], np.diff(at) != 1])
    return (place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0


def _codes(symbols: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """The pairs that begin at these positions, as one number each."""
    codes = (symbols[at] << bits) | symbols[at + 1]
    return codes.astype(np.uint32) if bits == 16 else codes


def _around(at: np.ndarray, steps: tuple[int, ...], symbols: np.ndarray, closing: np.ndarray, bits: int) -> np.ndarray:
    """The pairs of different symbols inside a document that begin so many places from `at`, each once."""
    here = np.zeros(len(symbols) + 2, bool)
    for step in steps:
        here[at + step + 1] = True
    here = here[1:-2]  # a pair begins before the last symbol
    here &= ~closing[:-1]
    at = np.flatnonzero(here)
    a, b = symbols[at], symbols[at + 1]
    codes = (a << bits) | b
    return (codes.astype(np.uint32) if bits == 16 else codes)[a != b]


def _places(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The place of each code in the ascending table, or -1: by hash slots, by order where slots are shared."""
    width = len(table).bit_length() + 3
    if table.dtype == np.uint32:
        slots = lambda x: (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - width)
    else:
        slots = lambda x: (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - width)
    held, own = np.full(1 << width, -1, np.int32), slots(table)
    every = np.arange(len(table), dtype=np.int32)
    held[own] = every
    shared = np.zeros(1 << width, bool)
    shared[own[held[own] != every]] = True
    slot = slots(codes)
    place = held[slot]
    place[table[place] != codes] = -1
    again = np.flatnonzero(shared[slot])
    spot = np.minimum(np.searchsorted(table, codes[again]), len(table) - 1)
    place[again] = np.where(table[spot] == codes[again], spot, -1)
    return place


def _sizes(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Number of ids that each symbol expands to."""
    out = np.ones(len(symbols), np.int64)
    is_rule = symbols >= FIRST_RULE
    out[is_rule] = lengths[symbols[is_rule].astype(np.int64) - FIRST_RULE]
    return out


def build_grammar(ids: np.ndarray, closing: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``symbols, closing, rules, lengths`` of a sequence whose documents end where `closing` is true.

    Each pass replaces the most frequent pairs that cannot overlap by new symbols, and the
    next works on the result, until no pair pays for its rule.  All pairs are counted
    once; after a pass only those around what was replaced change: old pairs get fewer, and
    what is new holds a new symbol.  Pairs of equal symbols, of which every second one in a run
    can be replaced, are few and counted anew.
    """
    # inside, ids are numbered without gaps and rules follow; while all fit, a pair is a number of 32 bits
    present = np.flatnonzero(np.bincount(ids)) if len(ids) else np.empty(0, np.int64)
    rank = np.zeros(int(present[-1]) + 1 if len(present) else 1, np.int64)
    rank[present] = np.arange(len(present))
    symbols, closing = rank[ids], closing.copy()
    rules: list[np.ndarray] = []
    lengths = np.ones(len(present), np.int64)
    known = len(present)
    bits = 16 if known <= 1 << 16 else 32
    pairs, counts = _frequent(_around(np.arange(len(symbols)), (0,), symbols, closing, bits))
    while True:
        same = np.flatnonzero((symbols[:-1] == symbols[1:]) & ~closing[:-1])
        # runs of one symbol are runs of positions, unless a document ends between
        same = same[_every_second(same)]
        twins, times = _frequent(_codes(symbols, same, bits))
        every = np.concatenate([pairs, twins])
        chosen = _choose(every, np.concatenate([counts, times]), bits, known)
        if not len(chosen):
            break
        table = np.sort(every[chosen])
        halves = np.stack([table >> bits, table & ((1 << bits) - 1)], axis=1).astype(np.int64)
        side = np.zeros(known, np.uint8)  # 1: a left half, 2: a right half, 3: both in one pair
        side[halves[:, 0]] = 1
        side[halves[:, 1]] += 2
        side = side[symbols]
        at = np.flatnonzero(((side[:-1] & 1) & (side[1:] >> 1)).view(bool) & ~closing[:-1])
        place = _places(table, _codes(symbols, at, bits))
        fits = place >= 0
        at, place = at[fits], place[fits]
        twin = np.flatnonzero((halves[:, 0] == halves[:, 1])[place])  # other chosen pairs can't overlap
        stands = np.ones(len(at), bool)
        stands[twin] = _every_second(at[twin])
        at, place = at[stands], place[stands]
        counts[chosen[chosen < len(pairs)]] = 0  # all of these are replaced
        lost = np.sort(_around(at, (-1, 1), symbols, closing, bits))
        counts = counts - (np.searchsorted(lost, pairs, "right") - np.searchsorted(lost, pairs, "left"))
        still = counts >= MIN_COUNT
        pairs, counts = pairs[still], counts[still]
        if bits == 16 and known + len(table) > 1 << 16:
            bits, pairs = 32, ((pairs.astype(np.int64) >> 16) << 32) | (pairs & 0xFFFF)
        symbols[at] = known + place
        closing[at] = closing[at + 1]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        stay = np.flatnonzero(stay)
        symbols, closing = symbols[stay], closing[stay]
        fresh = at - np.arange(len(at))  # where the new symbols stand now
        lengths = np.concatenate([lengths, lengths[halves[:, 0]] + lengths[halves[:, 1]]])
        rules.append(halves)
        more, often = _frequent(_around(fresh, (-1, 0), symbols, closing, bits))
        pairs, counts = np.concatenate([pairs, more]), np.concatenate([counts, often])
        known += len(table)
    flat = np.concatenate(rules) if rules else np.empty((0, 2), np.int64)
    named = np.concatenate([present, FIRST_RULE + np.arange(len(flat))]).astype(np.uint32)
    return named[symbols], closing, named[flat], lengths[len(present) :]


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The token ids that `symbols` stand for; where there are many, each different one is opened once."""
    if len(symbols) <= 2 * len(rules):
        return _open(symbols, rules, lengths)
    place = np.zeros(FIRST_RULE + len(rules), np.int32)
    place[symbols] = 1
    distinct = np.flatnonzero(place)
    place[distinct] = np.arange(len(distinct), dtype=np.int32)
    sizes = _sizes(distinct, lengths)
    starts, place = np.cumsum(sizes) - sizes, place[symbols]
    return _gather(_open(distinct.astype(np.uint32), rules, lengths), starts[place], sizes[place])


def _open(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The token ids of `symbols`: rules are opened level by level, each half at its place."""
    sizes = _sizes(symbols, lengths)
    ends = np.cumsum(sizes)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint32)
    at = ends - sizes
    while len(symbols):
        plain = symbols < FIRST_RULE
        out[at[plain]] = symbols[plain]
        halves, at = rules[symbols[~plain].astype(np.int64) - FIRST_RULE], at[~plain]
        symbols = np.concatenate([halves[:, 0], halves[:, 1]])
        at = np.concatenate([at, at + _sizes(halves[:, 0], lengths)])
    return out


def token_at(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, position: int) -> int:
    """The id at `position` of a document's symbols, by descending one path of rules."""
    size = _sizes(symbols, lengths)
    ends = np.cumsum(size)
    k = int(np.searchsorted(ends, position, side="right"))
    position -= int(ends[k] - size[k])
    symbol = int(symbols[k])
    while symbol >= FIRST_RULE:
        a, b = (int(x) for x in rules[symbol - FIRST_RULE])
        first = int(lengths[a - FIRST_RULE]) if a >= FIRST_RULE else 1
        symbol, position = (a, position) if position < first else (b, position - first)
    return symbol


# files -------------------------------------------------------------------------------------

SHARD = (
    "part int, shard int, n_docs long, n_tokens long, doc_ids binary, id_valid binary, doc_tokens binary, "
    "doc_symbols binary, symbols binary, rules binary, lengths binary"
)


def _pack(part: int, shard: int, doc_ids: list, ids: list[np.ndarray]) -> tuple:
    sizes = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids)
    closing = np.zeros(len(flat), bool)
    closing[np.cumsum(sizes) - 1] = True
    symbols, closing, rules, lengths = build_grammar(flat, closing)
    ends = np.flatnonzero(closing) + 1
    return (
        part, shard, len(doc_ids), int(sizes.sum()),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is not None for d in doc_ids),
        sizes.astype("<i8").tobytes(), np.diff(ends, prepend=0).astype("<i8").tobytes(),
        symbols.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<i8").tobytes(),
    )


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, parts: int | None = None) -> None:
    """Write the ids of every text (null: empty), each closed by `END_ID`, in doc_id order.

    Rows are range-partitioned by id (and by a hash of the row, so that repeated ids do
    not meet in one task) and sorted; a task writes the shards of its range one by one
    and holds one shard at a time.
    """
    spark = docs.sparkSession
    python_ready(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    file = public_tokenizers.path(vocabulary)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        part, number = TaskContext.get().partitionId(), 0
        doc_ids, ids, held = [], [], 0

        def close() -> pa.RecordBatch:
            row = _pack(part, number, doc_ids, ids)
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, arrow, strict=True)], schema=arrow)

        end = np.array([END_ID], np.uint32)
        for batch in batches:
            columns = batch.to_pydict()
            for doc_id, found in zip(columns["doc_id"], encoder(file).encode(columns["text"])):
                doc_ids.append(doc_id)
                ids.append(np.concatenate([found, end]))
                held += len(ids[-1])
                if held >= SHARD_TOKENS:
                    yield close()
                    number += 1
                    doc_ids, ids, held = [], [], 0
        if doc_ids:
            yield close()

    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(SHARD)
    ordered.mapInArrow(run, schema).write.parquet(path)


def _documents(shard: dict) -> Iterator[tuple[int | None, np.ndarray]]:
    """``doc_id, ids`` of every document of a shard row."""
    read = lambda name, kind: np.frombuffer(shard[name], kind)
    ids = expand(read("symbols", "<u4"), read("rules", "<u4").reshape(-1, 2), read("lengths", "<i8"))
    ends = np.cumsum(read("doc_tokens", "<i8"))
    for k, (doc_id, valid) in enumerate(zip(read("doc_ids", "<i8").tolist(), shard["id_valid"])):
        yield (doc_id if valid else None), ids[(ends[k - 1] if k else 0) : ends[k]]


def decode_document(shard: dict, k: int) -> np.ndarray:
    """The ids of document `k` of a shard row alone."""
    ends = np.cumsum(np.frombuffer(shard["doc_symbols"], "<i8"))
    symbols = np.frombuffer(shard["symbols"], "<u4")[(ends[k - 1] if k else 0) : ends[k]]
    return expand(symbols, np.frombuffer(shard["rules"], "<u4").reshape(-1, 2), np.frombuffer(shard["lengths"], "<i8"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document, from the files.

    ``start`` counts the ids of all documents before; ids_crc32 is the crc32 of the ids as
    little-endian 32-bit numbers.
    """
    files = spark.read.parquet(path)
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.select(F.col("part").alias("of"), before.alias("part_start"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        files.select("part", "shard", "n_tokens").join(parts, F.col("part") == F.col("of"))
        .select(
            F.col("part").alias("p"), F.col("shard").alias("s"),
            (F.col("part_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("shard_start"),
        )
    )

    def run(batch):
        out = []
        for row in range(len(batch["part"])):
            shard, at = {k: v[row] for k, v in batch.items()}, 0
            for doc_id, ids in _documents(shard):
                out.append((doc_id, shard["part"], shard["shard"], at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                at += len(ids)
        return out

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    decoded = map_batches(files, run, "doc_id long, part int, shard int, at long, n_tokens long, ids_crc32 long")
    return decoded.join(starts, (F.col("part") == F.col("p")) & (F.col("shard") == F.col("s"))).select(
        "doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_and_read(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = shared_dir(spark, "tokens")
    write_tokens(docs, path)
    return read_tokens(spark, path)
