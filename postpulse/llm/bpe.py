"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

Which merges happen at a place depends on what follows only through a chain of merges of ever
higher priority, so a bound on the bytes that can matter follows from the merge list alone.
Text goes through a window; a token is emitted once the window reaches the bound beyond the
token's begin, and the window moves to the next token.  A token boundary, once certain, splits
the rest of the text into an independent problem, so the window is all the state there is.
"""

from __future__ import annotations

import codecs
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from postpulse.llm.common import map_rows

# The pattern of the vocabulary's pre-tokenizer and Unicode's white space.
_WHITE = r"\t-\r \x85\xa0  -     　"
_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _WHITE + r"\p{L}\p{N}]+|["
    + _WHITE + r"]+(?![^" + _WHITE + r"])|[" + _WHITE + r"]+"
)
#: Encoded pieces of text that a Python worker remembers; then it starts anew.
REMEMBERED = 500_000
#: A mark behind letters is a pre-token of its own, of one byte.
_MARKS = frozenset(",.;:!?")
#: Characters that are split at once.
_SLICE = 1 << 16


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1
    characters for themselves, the others in order from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _ranges(points: Iterable[int]) -> str:
    """Code points as the inside of a set in a pattern."""
    found: list[list[int]] = []
    for p in sorted(points):
        if found and p == found[-1][1] + 1:
            found[-1][1] = p
        else:
            found.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found)


def disputed() -> dict[str, str]:
    """Characters that this pattern engine may class otherwise than the tokenizers library, and
    how the library classes them: its Unicode version is another than Python's and the engine's.

    Where Python's tables and the engine's disagree, the library is asked with its own
    pre-tokenizer: behind a letter a letter makes no new pre-token, and behind a number a mark does.
    """
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    whole = "".join(every)
    odd = []
    for kind in "LN":
        ours = set(regex.findall(rf"\p{{{kind}}}", whole))
        odd += [c for c in every if (unicodedata.category(c)[0] == kind) != (c in ours)]
    odd = sorted(set(odd))
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    starts = {begin for _, (begin, _) in split("".join(f"a{c}!" for c in odd))}
    letters = {ord(c) for i, c in enumerate(odd) if 3 * i + 1 not in starts}
    numbers = {ord(c) for i, c in enumerate(odd) if {3 * i + 1, 3 * i + 2} <= starts}
    others = {ord(c) for c in odd} - letters - numbers
    return {"all": _ranges(map(ord, odd)), "L": _ranges(letters), "N": _ranges(numbers), "other": _ranges(others)}


def exact_pattern(odd: dict[str, str]) -> str:
    """The pre-tokenizer's pattern with the library's classes for disputed characters."""
    def kind(own: str, name: str) -> str:
        return f"(?:(?![{odd['all']}]){own}" + (f"|[{odd[name]}])" if odd[name] else ")")

    letters, numbers = kind(r"\p{L}", "L"), kind(r"\p{N}", "N")
    others = kind(f"[^{_WHITE}" + r"\p{L}\p{N}]", "other")
    return (
        f"'s|'t|'re|'ve|'m|'ll|'d| ?{letters}+| ?{numbers}+| ?{others}+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
    )


def load(path: str) -> dict:
    """Merges, token bytes, special tokens and disputed characters of a byte-level BPE file."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    letters = byte_letters()
    raw = lambda token: bytes(letters[c] for c in token)
    vocab = whole["model"]["vocab"]
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in whole["model"]["merges"]]
    special = {t["content"]: t["id"] for t in whole["added_tokens"]}
    tokens = {i: raw(t) for t, i in vocab.items()} | {i: t.encode() for t, i in special.items()}
    return {
        "merges": [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges],
        "tokens": [tokens.get(i, b"") for i in range(max(tokens) + 1)],
        "special": special, "disputed": disputed(),
    }


def sufficient_lookahead(merges: list[tuple[int, int, int]], tokens: list[bytes]) -> int:
    """Bytes from a token's begin that decide the token, whatever comes later.

    In order of the merges, ``right[t]`` is the number of bytes from the begin of t that tell
    whether t is still whole on its right side: the largest of |t| + (bytes that tell whether w
    stands behind it) over the merges (t, w) so far.  To tell that w stands there, it must have
    been formed, which its last part had to survive, and be whole on its own right side.
    """
    size = [len(t) for t in tokens]
    right, formed = size.copy(), size.copy()
    for a, b, ab in merges:
        behind = max(right[b], formed[b])
        right[a] = max(right[a], size[a] + behind)
        formed[ab] = max(formed[ab], size[a] + behind)
    return max(max(r, f) for r, f in zip(right, formed, strict=True))


class Encoder:
    """Texts to ids.  One per Python worker; ``model`` is what load() gives."""

    def __init__(self, model: dict, window: int | None = None) -> None:
        self.ranks = {(a, b): rank for rank, (a, b, _) in enumerate(model["merges"])}
        self.made = [ab for _, _, ab in model["merges"]]
        self.tokens = model["tokens"]
        self.single = [0] * 256
        merged = {ab for _, _, ab in model["merges"]}
        specials = set(model["special"].values())
        for i, token in enumerate(self.tokens):
            if len(token) == 1 and i not in merged and i not in specials:
                self.single[token[0]] = i
        self.lookahead = sufficient_lookahead(model["merges"], self.tokens)
        self.window = window or 4 * self.lookahead
        self.special = model["special"]
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        odd = model["disputed"]
        self.usual, self.odd, self.exact = regex.compile(_PATTERN), None, None
        if odd["all"]:
            self.odd, self.exact = regex.compile(f"[{odd['all']}]"), regex.compile(exact_pattern(odd))
            self.least_lead = chr(int(odd["all"][2:10], 16)).encode()[0]  # first byte of the smallest of them
        self.pattern = self.usual
        self.words = regex.compile(f"(?<=[^{_WHITE}]) (?=[^{_WHITE}])")
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of a short sequence, by priority and from the left."""
        if len(ids) > 48:
            return self._merge_long(ids)
        rank, never = self.ranks.get, len(self.made)
        pairs = [rank(p, never) for p in zip(ids, ids[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best == never:
                break
            at = pairs.index(best)
            token = ids[at] = self.made[best]
            del ids[at + 1], pairs[at]
            if at < len(pairs):
                pairs[at] = rank((token, ids[at + 1]), never)
            if at:
                pairs[at - 1] = rank((ids[at - 1], token), never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links, for windows."""
        n, ranks = len(ids), self.ranks
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = self.made[rank], False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (r := ranks.get((ids[left], ids[after[left]]))) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[after[left]]))
        return [t for t, live in zip(ids, alive, strict=True) if live]

    def stream(self, blocks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one pre-token that comes in blocks; at most a window and a block are held."""
        held, single, source, ended = b"", self.single, iter(blocks), False
        while True:
            while not ended and len(held) < self.window:
                more = next(source, None)
                ended = more is None
                held += more or b""
            if not held:
                return
            part = held if ended and len(held) <= self.window else held[: self.window]
            sure = len(part) if len(part) == len(held) and ended else len(part) - self.lookahead
            at = 0
            for token in self.merge([single[b] for b in part]):
                if at and at > sure or at == 0 and sure < 0:
                    break
                yield token
                at += len(self.tokens[token])
            held = held[at:]

    def _pretoken(self, text: str, keep: bool = True) -> bytes:
        found = self.pieces.get(text)
        if found is None:
            raw = text.encode()
            if len(raw) <= self.window:
                ids = self.merge([self.single[b] for b in raw])
            else:
                ids = list(self.stream(raw[i : i + self.window] for i in range(0, len(raw), self.window)))
            found = np.array(ids, "<u4").tobytes()
            if keep and len(raw) <= 256:
                if len(self.pieces) >= REMEMBERED:
                    self.pieces.clear()
                self.pieces[text] = found
        return found

    def _choose(self, text: str) -> None:
        """The pattern for a text: both split a piece without disputed characters alike."""
        self.pattern = self.usual
        if self.odd is not None and not text.isascii():
            leads = np.frombuffer(text.encode(), np.uint8).max()
            if leads >= self.least_lead and self.odd.search(text):
                self.pattern = self.exact

    def _piece(self, text: str) -> bytes:
        """A piece that ends where white space can't reach across."""
        core = text[1:] if text[0] == " " else text
        if core.isalpha():  # letters only: one pre-token
            found = self._pretoken(text, keep=False)
        elif core and core[-1] in _MARKS and core[:-1].isalpha():
            found = (self.known.get(text[:-1]) or self._piece(text[:-1])) + self.single[ord(core[-1])].to_bytes(4, "little")
        elif len(text) > _SLICE:
            return b"".join(self._pretoken(m.group()) for m in self.pattern.finditer(text))
        else:
            found = b"".join(map(self._pretoken, self.pattern.findall(text)))
        if len(text) <= 256:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[text] = found
        return found

    def _plain(self, text: str) -> Iterator[bytes]:
        """Cuts at single spaces between characters that are no white space: a pre-token
        always begins at such a space, so the pieces are independent."""
        if not text:
            return
        first, *rest = self.words.split(text)
        yield self.known.get(first) or self._piece(first)
        get = self.known.get
        for at in range(0, len(rest), _SLICE):
            spaced = [" " + w for w in rest[at : at + _SLICE]]
            found = list(map(get, spaced))
            if None in found:
                found = [f if f is not None else self._piece(s) for s, f in zip(spaced, found, strict=True)]
            yield b"".join(found)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        self._choose(text)
        if self.cut is None or not any(t in text for t in self.special):
            return b"".join(self._plain(text))
        out = []
        for part in self.cut.split(text):
            out.append(self.special[part].to_bytes(4, "little") if part in self.special else b"".join(self._plain(part)))
        return b"".join(out)


class Decoder:
    """Ids to text with the bytes of one unfinished character as its only state; bytes that
    are no UTF-8 become U+FFFD."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], last: bool = False) -> str:
        return self.state.decode(b"".join(map(self.tokens.__getitem__, ids)), last)

    def decode(self, packed: bytes, block: int = 1 << 16) -> Iterator[str]:
        self.state.reset()
        ids = np.frombuffer(packed, "<u4")
        for at in range(0, len(ids), block):
            yield self.feed(ids[at : at + block].tolist())
        yield self.feed([], last=True)


def encode_and_decode(docs: DataFrame, path: str, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with two more columns (their names are returned): the ids packed as
    little-endian unsigned 32-bit integers, and the text decoded from these ids.

    * A null or empty text has no ids and decodes to the empty text.
    * Special tokens of the file are found in the text first, as its library does by default.
    * Every row and column of ``docs`` stays; nothing is shuffled.  A worker remembers at most
      REMEMBERED pieces; a long run without a break goes through the window.
    """
    model = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(texts: pa.Array) -> Iterator[tuple]:
        encoder = _encoder(path, model.value)
        decoder = Decoder(encoder.tokens)
        for text in texts:
            packed = encoder.encode(text.as_py() or "")
            yield packed, "".join(decoder.decode(packed))

    return map_rows(docs, text_col, run, [("ids", "binary", pa.binary()), ("decoded", "string", pa.string())])


_workers: dict[tuple[str, int], tuple[dict, Encoder]] = {}


def _encoder(path: str, model: dict) -> Encoder:
    """One encoder for each model in a Python worker."""
    key = (path, id(model))
    if key not in _workers:
        _workers.clear()
        _workers[key] = model, Encoder(model)  # the model is kept, so its id stays its own
    return _workers[key][1]
