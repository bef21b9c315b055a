"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features are shares of kinds of characters, word and line lengths, how
far it repeats its own words and whether it repeats another line of its document, for the line itself and for the lines before and
after it. A chain over the lines of a document joins them with weights for the four changes of state.
Documents are labelled, not lines, so in training every line carries its document's label. A
document's score is the mean of its lines' marginal probabilities of good (forward-backward), weighted
by line length, on a logistic scale fitted to the documents' labels.

The model is fitted on a bounded sample of labelled documents: the ``SAMPLE_DOCS`` whose ids hash
lowest, of each at most ``SAMPLE_LINES`` lines from a hashed place on, and ``SAMPLE_CHARS`` characters of these. Every document is scored over its
whole text; only the weights, a few hundred numbers, travel to the tasks.

Cases: null and empty texts are one empty line and get its score. Repeated rows get equal scores. Of
repeated labels the lowest counts; null labels are ignored. Without two classes of labelled documents
every score is the share of good ones, or 0.5 with none. Columns of the input stay, apart from
``score``, which is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.llm.columns import with_new

SAMPLE_DOCS = 4000
SAMPLE_LINES = 400
SAMPLE_CHARS = 100_000
PART_CHARS = 1 << 20
STEPS = 200
RATE = 0.15
PENALTY = 1e-4
_SPACE, _LINE, _UPPER, _LOWER, _DIGIT, _SYMBOL, _PIPE, _BANG, _STOP, _OTHER, _HIGH = range(11)


def _kinds() -> np.ndarray:
    """Kind of each byte of UTF-8."""
    kinds = np.full(256, _OTHER, np.uint8)
    kinds[128:] = _HIGH
    for kind, chars in ((_SPACE, b" \t\r\x0b\x0c"), (_LINE, b"\n"), (_SYMBOL, b"#*$%&<>"), (_PIPE, b"|"), (_BANG, b"!"), (_STOP, b".,;:?'\"-()")):
        kinds[list(chars)] = kind
    kinds[ord("A"):ord("Z") + 1] = _UPPER
    kinds[ord("a"):ord("z") + 1] = _LOWER
    kinds[ord("0"):ord("9") + 1] = _DIGIT
    return kinds


KINDS = _kinds()


def _repetition(data: np.ndarray, word_start: np.ndarray, blank: np.ndarray, starts: np.ndarray, words: np.ndarray) -> tuple:
    """Per line the share of words equal to the word before, and the share of distinct words; by 64-bit word hashes."""
    first = np.flatnonzero(word_start)
    again, distinct = np.zeros(len(starts)), np.ones(len(starts))
    if not len(first):
        return again, distinct
    place = np.arange(len(data), dtype=np.int64)
    place -= np.maximum.accumulate(np.where(word_start, place, 0))
    mixed = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed *= np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    mixed[blank] = 0
    hashes = np.add.reduceat(mixed, first)
    line = np.searchsorted(starts, first, side="right") - 1
    same = np.zeros(len(first), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    n = np.maximum(words, 1)
    again = np.bincount(line, same, len(starts)) / n
    order = np.lexsort((hashes, line))
    new = np.ones(len(first), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.where(words > 0, np.bincount(line[order], new, len(starts)) / n, 1.0)
    return again, distinct


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x k) of the lines of all texts, the lengths of the lines, and the number of lines of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    kinds = KINDS[data]
    ends = np.flatnonzero(kinds == _LINE)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    doc_ends = np.cumsum([len(r) for r in raw])
    per_doc = np.diff(np.concatenate([[0], np.searchsorted(ends, doc_ends - 1, side="right")]))
    # at an empty line a sum between starts would take in its line feed only, which no kind counts
    sums = {k: np.add.reduceat(kinds == k, starts, dtype=np.int64) for k in (_SPACE, _UPPER, _LOWER, _DIGIT, _SYMBOL, _PIPE, _BANG, _STOP, _HIGH)}
    blank = (kinds == _SPACE) | (kinds == _LINE)
    word_start = ~blank
    word_start[1:] &= blank[:-1]
    words = np.add.reduceat(word_start, starts, dtype=np.int64)
    again, distinct = _repetition(data, word_start, blank, starts, words)
    length = ends - starts
    shown = np.maximum(length - sums[_SPACE], 1)
    repeats = np.zeros(len(ends))
    line = 0
    buffer = data.tobytes()
    for n in per_doc.tolist():
        if n > 1:
            seen: set[bytes] = set()
            for i in range(line, line + n):
                body = buffer[starts[i]:ends[i]]
                if body and body in seen:
                    repeats[i] = 1.0
                seen.add(body)
        line += n
    letters = np.maximum(sums[_UPPER] + sums[_LOWER], 1)
    own = np.column_stack([
        np.minimum(1, 3 * sums[_SYMBOL] / shown), np.minimum(1, 5 * sums[_PIPE] / shown), sums[_UPPER] / letters, sums[_DIGIT] / shown,
        np.minimum(1, 5 * sums[_BANG] / shown), np.minimum(1, 5 * sums[_STOP] / shown), sums[_HIGH] / shown,
        np.minimum(1, shown / np.maximum(words, 1) / 12), np.log1p(length) / 8, length == 0, words <= 3, repeats, again, distinct,
        np.log1p(np.repeat(per_doc, per_doc)) / 6,
    ]).astype(np.float64)
    first = np.zeros(len(ends), bool)
    first[np.concatenate([[0], np.cumsum(per_doc)[:-1]])] = True
    last = np.roll(first, -1)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    near = np.column_stack([first, last, np.ones(len(ends))])
    return np.hstack([own, before, after, near]), length.astype(np.float64), per_doc


def parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of whole texts of about PART_CHARS; the arrays of a run take some fifty bytes a character."""
    run, chars = [], 0
    for text in texts:
        run.append(text)
        chars += len(text or "")
        if chars > PART_CHARS:
            yield run
            run, chars = [], 0
    if run:
        yield run


def _log_add(a: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp(np.take(a, 0, axis), np.take(a, 1, axis))


def forward_backward(emit: np.ndarray, moves: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (lines x 2), expected moves (2 x 2) and log normalisers of all chains together.

    ``emit`` are log weights (lines x 2) of the lines of all documents, one after the other. Step t works
    on all chains that have a t-th line.
    """
    first = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
    order = np.argsort(-per_doc, kind="stable")
    heads, sizes = first[order], per_doc[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # chains with more than t lines
    forward, backward = np.empty_like(emit), np.zeros_like(emit)
    for t in range(longest):
        at = heads[:active[t]] + t
        forward[at] = emit[at] if t == 0 else emit[at] + _log_add(forward[at - 1][:, :, None] + moves[None], 1)
    for t in range(longest - 2, -1, -1):
        at = heads[:active[t + 1]] + t
        backward[at] = _log_add(moves[None] + (emit[at + 1] + backward[at + 1])[:, None, :], 2)
    logz_sorted = _log_add(forward[heads + sizes - 1], 1)
    logz = np.empty(len(per_doc))
    logz[order] = logz_sorted
    of_line = np.repeat(logz, per_doc)
    marginals = np.exp(forward + backward - of_line[:, None])
    inner = np.ones(len(emit), bool)
    inner[first] = False
    to = np.flatnonzero(inner)
    pairs = forward[to - 1][:, :, None] + moves[None] + (emit[to] + backward[to])[:, None, :] - of_line[to][:, None, None]
    return marginals, np.exp(pairs).sum(axis=0), logz


class Model:
    """Weights of good against bad for each feature, and of moves between states."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, slope: float = 1.0, offset: float = 0.0):
        self.weights, self.moves, self.slope, self.offset = weights, moves, slope, offset

    def emissions(self, features: np.ndarray) -> np.ndarray:
        half = features @ self.weights / 2
        return np.column_stack([-half, half])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        evidence = [self.evidence(*line_features(part)) for part in parts(texts)]
        return 1 / (1 + np.exp(-(self.slope * np.concatenate(evidence or [np.zeros(0)]) + self.offset)))

    def evidence(self, features: np.ndarray, length: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        """Log odds of the length-weighted mean marginal."""
        good = forward_backward(self.emissions(features), self.moves, per_doc)[0][:, 1]
        first = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
        weight = length + 1
        mean = np.clip(np.add.reduceat(weight * good, first) / np.add.reduceat(weight, first), 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))


def _scale(evidence: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic scale, slope at least 0.1; Newton steps with a small penalty."""
    x = np.column_stack([evidence, np.ones(len(evidence))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.1, 0.1])
        change = np.linalg.solve(curve, x.T @ (labels - p) - 0.1 * (w - [1.0, 0.0]))
        w = w + np.clip(change, -1, 1)
        if np.abs(change).max() < 1e-8:
            break
    return max(float(w[0]), 0.1), float(w[1])


def fit(features: np.ndarray, length: np.ndarray, per_doc: np.ndarray, labels: np.ndarray) -> Model:
    """Likeliest weights with a quadratic penalty, by full-gradient steps with adapted rates; then the scale."""
    k = features.shape[1]
    share = labels.mean() if len(labels) else 0.5
    if not len(labels) or not 0 < share < 1:  # one class only: a constant
        share = min(max(share, 1e-6), 1 - 1e-6)
        weights = np.zeros(k)
        weights[-1] = np.log(share / (1 - share))
        return Model(weights, np.zeros((2, 2)))
    weights, moves = np.zeros(k), np.zeros((2, 2))
    of_line = np.repeat(labels, per_doc).astype(int)
    inner = np.ones(len(of_line), bool)
    inner[np.concatenate([[0], np.cumsum(per_doc)[:-1]])] = False
    steps_seen = np.zeros((2, 2))
    np.add.at(steps_seen, (of_line[np.flatnonzero(inner)], of_line[np.flatnonzero(inner)]), 1)
    lines = len(of_line)
    mean, spread = np.zeros(k + 4), np.zeros(k + 4)
    for step in range(1, STEPS + 1):
        model = Model(weights, moves)
        marginals, moved, _ = forward_backward(model.emissions(features), moves, per_doc)
        gradient = np.concatenate([
            features.T @ (of_line - marginals[:, 1]) / lines - PENALTY * weights,
            ((steps_seen - moved) / lines - PENALTY * moves).ravel()])
        mean = 0.9 * mean + 0.1 * gradient
        spread = 0.99 * spread + 0.01 * gradient**2
        change = RATE * mean / (1 - 0.9**step) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
        weights, moves = weights + change[:k], moves + change[k:].reshape(2, 2)
    model = Model(weights, moves)
    return Model(weights, moves, *_scale(model.evidence(features, length, per_doc), labels))


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, docs_most: int, lines_most: int,
           chars_most: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``docs_most`` labelled documents, each of at most ``lines_most`` lines and ``chars_most`` characters."""
    chosen = (
        labels.groupBy(F.col(key).alias("_key")).agg(F.min("quality").alias("_label"))
        .filter("_label in (0, 1) and _key is not null").orderBy(F.xxhash64("_key"), "_key").limit(docs_most)
    )
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    first = F.when(F.size(lines) > lines_most, F.pmod(F.xxhash64("_key"), F.size(lines) - lines_most)).otherwise(0).cast("int") + 1
    body = docs.select(F.col(key).alias("_key"), F.col(text)).join(F.broadcast(chosen), "_key").select(  # docs_most rows
        "_key", "_label", F.substring(F.array_join(F.slice(lines, first, lines_most), "\n"), 1, chars_most).alias("_text"))
    rows = body.dropDuplicates(["_key"]).orderBy("_key").collect()
    return [r["_text"] for r in rows], np.array([r["_label"] for r in rows], float)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          docs_most: int = SAMPLE_DOCS, lines_most: int = SAMPLE_LINES) -> Model:
    texts, marks = sample(docs, labels, key, text, docs_most, lines_most)
    if not texts:
        return fit(np.zeros((0, line_features([""])[0].shape[1])), np.zeros(0), np.zeros(0, int), marks)
    features, length, per_doc = (np.concatenate(x) for x in zip(*map(line_features, parts(texts))))
    return fit(features, length, per_doc, marks)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, 0 to 1. Each task scores batches of whole texts."""
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.scores(batch.tolist()), dtype="float64")

    return with_new(docs, {"score": F.pandas_udf(scored, "double")(F.col(text))})
