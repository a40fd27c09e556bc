"""Byte-pair encoding as a lazily determinised finite-state transducer.

A token sequence is the byte-pair encoding of its bytes exactly if every pair of neighbours is
*stable*: encoding the bytes of the two tokens gives those two tokens again. So, read from left to
right, each prefix of a word has one last token, found among the few tokens that end there. A
state of the transducer is what the future can still depend on: the last token that is certain and
the bytes after it. A token is emitted as soon as every boundary that some longer token could
still use descends from it, so the look-ahead is bounded by the longest token. States and
transitions are made when a text first needs them.
"""

from __future__ import annotations

import json
from itertools import chain

import regex

#: Fixed value: the pattern that splits a text before the merges (the rule of the vocabulary).
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: States and letters of remembered words per worker; beyond these the tables start anew, results don't change. Longer words than LONG aren't remembered.
MAX_STATES, MAX_LETTERS, LONG = 400_000, 4_000_000, 64


def printable_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(other)}


class Words(dict):
    """Ids of the words met so far; a new word runs through the transducer."""

    def __init__(self, run):
        super().__init__()
        self.run, self.letters = run, 0

    def __missing__(self, word: str) -> tuple[int, ...]:
        got = self.run(word.encode())
        if len(word) <= LONG:
            self[word] = got
            self.letters += len(word)
        return got


class State(dict):
    """Transitions by byte: byte -> (next state, emitted ids).

    ``prev`` is the last emitted id. ``open`` holds one pair for each boundary that a longer token
    may still start at: the bytes from there on and the ids from the last emitted one to there.
    The last pair is the end of what was read.
    """

    __slots__ = ("prev", "open")

    def __init__(self, prev: int, open_: tuple):
        super().__init__()
        self.prev, self.open = prev, open_


class Transducer:
    """Encoder and decoder for a vocabulary file in the JSON form of byte-level BPE."""

    def __init__(self, definition: str | bytes):
        model = json.loads(definition)["model"]
        byte_of, vocab = printable_bytes(), model["vocab"]
        self.vocab = {bytes(byte_of[c] for c in s): i for s, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            if self.rank.setdefault(pair, r) == r:
                self.made[pair] = whole
                self.parts.setdefault(whole, pair)
        self.bytes_of = {i: b for b, i in self.vocab.items()}
        self.single = [self.vocab[bytes([b])] for b in range(256)]
        self.longer = {t[:n] for t in self.vocab for n in range(1, len(t))}
        self._stable: dict[tuple[int, int], bool] = {}
        self._edges: dict[tuple[int, int], list] = {}
        self._split = regex.compile(PRETOKEN).findall
        self._reset()

    def _reset(self) -> None:
        self.start = State(-1, ((b"", ()),))
        self.states = {(-1, self.start.open): self.start}
        self.words = Words(self.word)

    def merge(self, text: bytes) -> list[int]:
        """The definition: apply the merge of the lowest rank, leftmost first, until none applies."""
        ids, rank, never = [self.single[b] for b in text], self.rank.get, len(self.rank)
        while len(ids) > 1:
            best, k = min((rank(p, never), k) for k, p in enumerate(zip(ids, ids[1:])))
            if best == never:
                break
            ids[k : k + 2] = [self.made[ids[k], ids[k + 1]]]
        return ids

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge while ``token`` is built, each with the rank that ends it."""
        got = self._edges.get((token, side))
        if got is None:
            got, until = [], len(self.rank)
            at = token
            while True:
                got.append((at, until))
                if at not in self.parts:
                    break
                pair = self.parts[at]
                at, until = pair[side], self.rank[pair]
            self._edges[token, side] = got
        return got

    def stable(self, a: int, b: int) -> bool:
        """Whether b may follow a: no merge across them comes before those inside. a < 0: at the start."""
        got = self._stable.get((a, b))
        if got is None:
            if a < 0:
                got = self.merge(self.bytes_of[b]) == [b]
            else:
                rank, never = self.rank.get, len(self.rank)
                # of equal ranks the leftmost merges first, hence < on the left and <= on the right
                got = self.stable(-1, b) and not any((r := rank((x, y), never)) < ends_x and r <= ends_y and r < never for x, ends_x in self._edge(a, 1) for y, ends_y in self._edge(b, 0))
            self._stable[a, b] = got
        return got

    def grow(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """Make the transition of ``state`` at ``byte``."""
        b, kept, new = bytes([byte]), [], None
        vocab, longer = self.vocab, self.longer
        for rest, ids in state.open:
            rest += b
            if new is None and (token := vocab.get(rest)) is not None and self.stable(ids[-1] if ids else state.prev, token):
                new = (*ids, token)
            if rest in longer:
                kept.append((rest, ids))
        n = len(new)
        for _, ids in kept:
            k = 0
            while k < n and k < len(ids) and ids[k] == new[k]:
                k += 1
            n = k
        emitted = new[:n]
        if n:
            kept = [(rest, ids[n:]) for rest, ids in kept]
        kept.append((b"", new[n:]))
        key = new[n - 1] if n else state.prev, tuple(kept)
        target = self.states.get(key)
        if target is None:
            target = self.states[key] = State(*key)
        state[byte] = target, emitted
        return target, emitted

    def word(self, text: bytes) -> tuple[int, ...]:
        """The ids of one word of the split."""
        state, out = self.start, []
        for byte in text:
            step = state.get(byte)
            if step is None:
                step = self.grow(state, byte)
            state, emitted = step
            if emitted:
                out += emitted
        return (*out, *state.open[-1][1])

    def encode_into(self, text: str, out: list[int]) -> None:
        """Append the ids of ``text``; the special token's string is ordinary text."""
        out.extend(chain.from_iterable(map(self.words.__getitem__, self._split(text))))
        if self.words.letters > MAX_LETTERS or len(self.states) > MAX_STATES:
            self._reset()

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; [] for None and for the empty text."""
        out: list[int] = []
        self.encode_into(text or "", out)
        return out

    def decode(self, ids) -> str:
        machine = Utf8Machine()
        return "".join(machine.feed(self.bytes_of[i]) for i in ids if i in self.bytes_of) + machine.end()


class Utf8Machine:
    """Incremental UTF-8 decoding: bytes in any cuts, characters as soon as they are complete.

    The state is the bytes still wanted, the code point so far and the bounds of the next byte, so
    overlong forms and surrogates are refused at once. An ill-formed sequence gives U+FFFD.
    """

    def __init__(self):
        self.want, self.code, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        if not self.want and data.isascii():
            return data.decode("ascii")
        out = []
        for b in data:
            if self.want:
                if self.low <= b <= self.high:
                    self.code, self.want = self.code << 6 | b & 0x3F, self.want - 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.want:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.want, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.want, self.code = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.want, self.code = 2, b & 0x0F
                self.low, self.high = 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                self.want, self.code = 3, b & 0x07
                self.low, self.high = 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        """What an unfinished sequence at the end gives."""
        return "�" if self.want else ""


_LOADED: dict[int, Transducer] = {}


def loaded(definition: str) -> Transducer:
    """The transducer of a definition, made once per Python worker and kept between tasks."""
    key = hash(definition)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Transducer(definition)
    return _LOADED[key]
