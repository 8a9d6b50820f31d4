"""Token counts of a unigram model over a trie of distinct pre-tokens.

A pre-token is a word with the word-begin mark before it.  The distinct pre-tokens of a batch
form a trie, walked in sorted order (its depth-first order): a node's forward score, the best
score of any segmentation of its prefix, is computed once from its ancestors' scores and is
shared by all words below it.  A terminal keeps its number of tokens, which is all that the
documents need.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from postpulse.llm.common import map_rows

MARK = "▁"
#: Words whose counts a Python worker remembers; then it starts anew.
REMEMBERED = 500_000
#: Characters of a path that are kept for sharing; a longer word is walked on its own.
LONGEST_SHARED = 512


def load(path: str) -> dict[str, float]:
    """Log-probabilities of a vocabulary's pieces.

    The file ranks its pieces but holds no probabilities, so Zipf's law over the rank is
    taken: p(rank) = 1 / ((rank + 1) H).  Control, byte and unused pieces are left out.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = [
        i for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        and model.get_score(i) > -1e8
    ]
    ranked = sorted(usable, key=lambda i: (-model.get_score(i), i))
    whole = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
    return {model.id_to_piece(i): -math.log(r + 1) - whole for r, i in enumerate(ranked)}


class Counter:
    """Tokens of words.  A character that no piece covers takes a token for each of its UTF-8
    bytes, at the price of the rarest piece each.  Of equal scores the fewer tokens win."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.rare = min(pieces.values(), default=-20.0) - 1.0
        self.known: dict[bytes, int] = {}

    def _grow(self, word: str, scores: list[tuple[float, int]]) -> None:
        """Adds the nodes of ``word`` below those in ``scores`` (one per prefix)."""
        get, longest = self.pieces.get, self.longest
        for end in range(len(scores), len(word) + 1):
            size = len(word[end - 1].encode("utf-8", "surrogatepass"))
            before = scores[end - 1]
            best = (before[0] + size * self.rare, before[1] - size)
            for begin in range(max(0, end - longest), end):
                if (price := get(word[begin:end])) is not None:
                    way = (scores[begin][0] + price, scores[begin][1] - 1)
                    if way > best:
                        best = way
            scores.append(best)

    def learn(self, words: set[bytes]) -> None:
        """Counts the words that aren't known yet, in one walk over their trie."""
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = list(words)
        path, scores = "", [(0.0, 0)]
        for word in sorted(MARK + w.decode() for w in fresh):
            shared = 0
            for a, b in zip(path, word, strict=False):
                if a != b:
                    break
                shared += 1
            del scores[shared + 1 :]
            self._grow(word, scores)
            self.known[word[1:].encode()] = -scores[-1][1]
            path = word[:LONGEST_SHARED]
            del scores[LONGEST_SHARED + 1 :]

    def count(self, text: bytes) -> tuple[int, int]:
        """(words, tokens)."""
        words = text.split()
        try:
            return len(words), sum(map(self.known.__getitem__, words))
        except KeyError:
            self.learn(set(words))
            return len(words), sum(map(self.known.__getitem__, words))


_workers: dict[tuple[str, int], Counter] = {}


def _counter(path: str, pieces: dict[str, float]) -> Counter:
    """One counter for each vocabulary in a Python worker."""
    key = (path, id(pieces))
    if key not in _workers:
        _workers.clear()
        _workers[key] = Counter(pieces)  # which also keeps the vocabulary's id in use
    return _workers[key]


def count_tokens(docs: DataFrame, path: str, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with two more columns (their names are returned): words and tokens.

    * Words are runs of anything but ASCII white space; null or empty: 0 and 0.
    * Whole texts are counted; equal words have equal counts wherever they are.
    * Every row and column of ``docs`` stays and nothing is shuffled.  A worker's memory is
      bounded by REMEMBERED words (or one document's words, if it has more).
    """
    pieces = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(texts: pa.Array) -> Iterator[tuple]:
        counter = _counter(path, pieces.value)
        raw = [(t.as_py() or "").encode() for t in texts]
        known = counter.known
        fresh = {w for t in raw for w in t.split() if w not in known}
        if len(known) + len(fresh) <= REMEMBERED:
            counter.learn(fresh)  # one trie for the batch
        for text in raw:
            yield counter.count(text)

    return map_rows(docs, text_col, run, [("n_words", "bigint", pa.int64()), ("n_tokens", "bigint", pa.int64())])
