"""Quality rules: counts of a text, and a hashed n-gram logistic regression over them.

The model is trained here on a bounded sample of labelled rows.  Its features are the shares of
hashed word 1- and 2-grams and character 3-, 4- and 5-grams; its score is a sum of mean weights, so
scoring is a gather over numpy arrays of a batch.  Platt's sigmoid, fitted on a held-out part and
weighted to the labels' own proportions, turns the score into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postpulse.llm.common import columns_of, map_batches
from postpulse.llm.textbytes import chunks, mix, piece_hashes, utf8, words

#: Labelled rows of each class that the model is fitted on, at most.
SAMPLE = 800
#: A text is kept from this probability of good quality on.
KEEP = 0.5
#: Base rules.
FEWEST_WORDS, MOST_REPEATED = 20, 30
#: Words of the windows whose repetition is counted.
WINDOW = 8

_BITS = 11
_BINS = 1 << _BITS
_KINDS = 5  # word 1- and 2-grams, character 3-, 4- and 5-grams
_ROUNDS, _RATE, _SCALE = 100, 0.5, 20.0
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _within(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive offsets."""
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated(hashes: np.ndarray) -> np.ndarray:
    """Whether each value occurs more than once."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(hashes), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice


def counts(data: np.ndarray, offsets: np.ndarray, cut: tuple | None = None) -> dict[str, np.ndarray]:
    """The base counts of values that lie end to end."""
    begins, ends, first = cut or words(data, offsets)
    n_docs = len(offsets) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    inside = np.zeros(len(data) + 1, np.int8)
    inside[begins] += 1
    np.subtract.at(inside, ends, 1)
    in_word = np.cumsum(inside[:-1]) > 0
    hashes = piece_hashes(data, begins, ends)
    repeat_words = np.zeros(n_docs, np.int64)
    at = np.flatnonzero(np.arange(len(begins)) + WINDOW <= first[doc + 1]) if len(begins) else np.zeros(0, np.int64)
    if len(at):
        value = mix(doc[at].astype(np.uint64) + np.uint64(1))
        for step in range(WINDOW):
            value = mix(value * np.uint64(0x9FB21C651E98DF25) + hashes[at + step])
        covered = np.zeros(len(begins) + 1, np.int64)
        twice = at[_repeated(value)]
        np.add.at(covered, twice, 1)
        np.subtract.at(covered, twice + WINDOW, 1)
        repeat_words = _within(np.cumsum(covered[:-1]) > 0, first)
    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    edges = edges[edges < len(data)]
    dup_lines = np.zeros(n_docs, np.int64)
    if len(edges):
        line_doc = np.searchsorted(offsets, edges, "right") - 1
        stops = np.minimum(np.append(edges[1:], len(data)), offsets[line_doc + 1])
        stops = np.where((stops > edges) & (data[np.maximum(stops - 1, 0)] == 10), stops - 1, stops)
        worded = np.searchsorted(begins, stops) > np.searchsorted(begins, edges)
        edges, stops, line_doc = edges[worded], stops[worded], line_doc[worded]
        if len(edges):
            value = piece_hashes(data, edges, stops) ^ mix(line_doc.astype(np.uint64) + np.uint64(7))
            _, kept = np.unique(value, return_index=True)
            dup_lines = np.bincount(line_doc, minlength=n_docs) - np.bincount(line_doc[kept], minlength=n_docs)
    return {
        "n_words": np.diff(first), "word_chars": _within(in_word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _within(_SYMBOL[data], offsets), "n_dup_lines": dup_lines, "n_repeat_words": repeat_words,
    }


def base_failed(found: dict[str, np.ndarray]) -> np.ndarray:
    return (found["n_words"] < FEWEST_WORDS) | (100 * found["n_repeat_words"] > MOST_REPEATED * found["n_words"])


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the UTF-8 bytes of each character as one number, index of the first of each value and the total)."""
    follows = (data & 0xC0) == 0x80
    if not follows.any():
        return data.astype(np.uint64), offsets
    follows[offsets[:-1][offsets[:-1] < len(data)]] = False
    begins = np.flatnonzero(~follows)
    sizes = np.diff(np.append(begins, len(data)))
    letters = data[begins].astype(np.uint64)
    for step in range(1, 4):
        longer = np.flatnonzero(sizes > step)
        letters[longer] = (letters[longer] << np.uint64(8)) | data[begins[longer] + step]
    return letters, np.searchsorted(begins, offsets)


def _grams(data: np.ndarray, offsets: np.ndarray, cut: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of n-gram: bins, and the first and past-last gram of each value."""
    begins, ends, first = cut
    hashes = piece_hashes(data, begins, ends)
    shift = np.uint64(64 - _BITS)
    yield (hashes >> shift).astype(np.int32), first[:-1], first[1:]
    pairs = mix(hashes[:-1] * np.uint64(0x9FB21C651E98DF25) + hashes[1:]) if len(hashes) > 1 else np.zeros(0, np.uint64)
    yield (pairs >> shift).astype(np.int32), first[:-1], np.maximum(first[1:] - 1, first[:-1])
    letters, at = characters(data, offsets)
    value = letters
    for n in range(2, 6):
        value = value[:-1] * np.uint64(0x9FB21C651E98DF25) + letters[n - 1 :] if len(value) else value
        if n > 2:
            bins = ((value * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int32)
            last = np.maximum(np.minimum(at[1:] - n + 1, len(bins)), at[:-1])
            yield bins, np.minimum(at[:-1], len(bins)), np.minimum(last, len(bins))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bins, shares) of one text."""
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    at, share = [], []
    for kind, (bins, low, high) in enumerate(_grams(data, offsets, words(data, offsets))):
        n = int(high[0] - low[0])
        if n > 0:
            found, times = np.unique(bins[low[0] : high[0]], return_counts=True)
            at.append(found + kind * _BINS)
            share.append(times / n)
    if not at:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    return np.concatenate(at).astype(np.int32), np.concatenate(share).astype(np.float32)


class Model:
    """Weights, and the two numbers of the calibration."""

    def __init__(self, weights: np.ndarray, slope: float, shift: float) -> None:
        self.weights, self.slope, self.shift = weights, slope, shift

    def probability(self, data: np.ndarray, offsets: np.ndarray, cut: tuple) -> np.ndarray:
        score = np.zeros(len(offsets) - 1)
        for kind, (bins, low, high) in enumerate(_grams(data, offsets, cut)):
            sums = np.concatenate([[0.0], np.cumsum(self.weights[kind * _BINS : (kind + 1) * _BINS][bins], dtype=np.float64)])
            score += (sums[np.maximum(high, low)] - sums[low]) / np.maximum(high - low, 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * _SCALE * score + self.shift, -500, 500)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], proportion: float) -> Model:
    """Full-batch AdaGrad on four fifths of the rows, Platt's sigmoid on the rest.

    ``rows``: (label, bins, shares); ``proportion``: share of good rows among all labels.
    """
    table = np.zeros((len(rows), _KINDS * _BINS), np.float32)
    for i, (_, at, share) in enumerate(rows):
        table[i, at] = share * _SCALE
    label = np.array([r[0] for r in rows], float)
    inner = np.arange(len(rows)) % 5 > 0
    fitted, truth = table[inner], label[inner]
    weights, squares, bias = np.zeros(_KINDS * _BINS, np.float32), np.full(_KINDS * _BINS, 1e-8, np.float32), 0.0
    for _ in range(_ROUNDS):
        error = ((_sigmoid(fitted @ weights + bias) - truth) / len(truth)).astype(np.float32)
        slope = error @ fitted + 1e-6 * weights
        squares += slope * slope
        weights -= _RATE * slope / np.sqrt(squares)
        bias -= 0.5 * float(error.sum())
    used = ~inner if set(label[~inner]) == {0, 1} else np.ones(len(rows), bool)
    score, label = (table[used] @ weights).astype(float), label[used]
    share_good = min(max(label.mean(), 1e-6), 1 - 1e-6)
    weight = np.where(label > 0, proportion / share_good, (1 - proportion) / (1 - share_good))
    good, bad = (label > 0).sum(), (label == 0).sum()
    target = np.where(label > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, shift = 1.0, bias
    for _ in range(50):  # Newton steps on the two numbers, damped
        p = _sigmoid(slope * score + shift)
        g = weight * (p - target)
        h = weight * np.maximum(p * (1 - p), 1e-9)
        a, b, c = (h * score * score).sum() + 1e-6, (h * score).sum(), h.sum() + 1e-6
        gs, gb = (g * score).sum(), g.sum()
        det = a * c - b * b
        if det <= 0:
            break
        ds, db = (c * gs - b * gb) / det, (a * gb - b * gs) / det
        size = max(1.0, abs(ds) / 0.5, abs(db) / 0.5)
        slope, shift = max(1e-3, slope - ds / size), shift - db / size
    return Model(weights.astype(np.float32), float(slope), float(shift))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = SAMPLE,
) -> Model | None:
    """A model from at most ``sample`` labelled rows of each class (the smallest hashes of the
    id, so the same rows give the same model); None if a class has no labelled text.

    Drawn are labels whose id has a text, and of several texts of one id the one with the
    smallest SHA-256; an id labelled both ways counts in both classes.  The drawn labels are
    broadcast, and sparse features of the drawn texts come to the driver: at most 2 x ``sample``
    rows of at most 5 x 2**11 bins each, however often an id repeats.
    """
    known = columns_of(labels, id=id_col, label=label_col).where("id is not null and label in (0, 1)").distinct()
    texts = columns_of(docs, id=id_col, text=text_col).where("text is not null and id is not null")
    known = known.join(texts.select("id").distinct(), "id", "left_semi")
    by_class = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(by_class) != {0, 1}:
        return None
    drawn = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(sample)
        drawn = part if drawn is None else drawn.unionByName(part)
    texts = texts.join(F.broadcast(drawn), "id").groupBy("id", "label").agg(
        F.min_by("text", F.sha2("text", 256)).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features((t.as_py() or "").encode()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("label"),
                pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary()),
            ], names=["id", "label", "bins", "shares"])

    rows = texts.select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("int").alias("label"), "text").mapInArrow(
        run, "id bigint, label int, bins binary, shares binary"
    ).collect()
    rows = sorted(rows, key=lambda r: (hash((r["id"], 17)) & 0xFFFF, r["id"], bytes(r["bins"]), r["label"]))
    ready = [(r["label"], np.frombuffer(r["bins"], np.int32), np.frombuffer(r["shares"], np.float32)) for r in rows]
    if {r[0] for r in ready} != {0, 1}:
        return None
    return fit(ready, by_class[1] / (by_class[0] + by_class[1]))


def judge_quality(docs: DataFrame, model: Model | None, text_col: str = "text", keep: float = KEEP) -> tuple[DataFrame, list[str]]:
    """``docs`` with the base counts, base_failed, probability and kept (the names used are
    returned); every row and column of ``docs`` stays and nothing is shuffled.

    * Null or empty text: no words, so base_failed.  kept: not base_failed and, with a model,
      a probability of ``keep`` at least.  Without a model (no labels of both classes) the
      probability is null and the base rules decide.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> list[pa.Array]:
        data, offsets = utf8(texts)
        parts: list[list[np.ndarray]] = [[] for _ in range(len(COUNTS) + 2)]
        for _, _, part, at in chunks(data, offsets):
            cut = words(part, at)
            found = counts(part, at, cut)
            chance = sent.value.probability(part, at, cut) if sent.value is not None else np.full(len(at) - 1, np.nan)
            for column, value in zip(parts, [*(found[c] for c in COUNTS), base_failed(found), chance], strict=True):
                column.append(value)
        whole = [np.concatenate(p) if p else np.zeros(0) for p in parts]
        failed, chance = whole[-2].astype(bool), whole[-1]
        kept = ~failed & ((chance >= keep) | np.isnan(chance))
        return [
            *(pa.array(w.astype(np.int64)) for w in whole[:-2]), pa.array(failed),
            pa.array(chance.astype(np.float64), pa.float64(), mask=np.isnan(chance.astype(np.float64))), pa.array(kept),
        ]

    fields = [(c, "bigint") for c in COUNTS] + [("base_failed", "boolean"), ("probability", "double"), ("kept", "boolean")]
    return map_batches(docs, text_col, run, fields)
