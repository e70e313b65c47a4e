"""Document quality from a linear-chain conditional random field over lines.

Every line is a position of the chain with the states bad and good. A state's score is
linear in features of the line and of the lines before and after it; neighbouring
states have transition scores. A document's score is the mean of its lines' forward-backward
marginals of "good", weighted by the length of the lines; ``lines`` gives the marginals and labels
themselves.

The field is fitted on labelled documents by maximum conditional likelihood. The lines of a document need
not carry its label: they start with it, and after a first fit a line whose features speak clearly for
the other state takes that, as long as the lines that agree with the document keep the majority of its
length. Then the field is fitted again, and so on ``REFINE`` times.

The fit sees at most ``SAMPLE`` labelled documents, those with the smallest hash of
their id and text, where copies of a text under one id are one document, and at most
``SAMPLE_LINES`` of their lines: beyond that the documents with the most lines give only
some, all of them equally many, in runs spread over the text. So the driver holds a bounded number of feature
rows; everything else runs in tasks over whole texts, and whole texts are scored.
Features come from the text alone. Chains of more than ``SEGMENT`` lines are cut in segments that
are worked on side by side, so the time of a text grows with its lines and not with steps one after another.

Edge cases: a null or empty text is one empty line and gets a score; very long texts
are chains of as many lines as they have; labels that are null are not learned from; a
document labelled good and bad counts twice; if nothing is labelled every score is 0.5; rows
that repeat an id each get a row; an empty table gives no rows; other columns are kept by
``accepted`` and not read by ``scores``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import map_batches, map_texts, staged, texts_of

SAMPLE = 4000
SAMPLE_LINES = 500_000
ROUNDS = 250
RATE = 0.1
RIDGE = 1e-3
# Fits after the first one, their rounds, and the margin by which a line's own features must speak
# against its label.
REFINE = 2
REFINE_ROUNDS = 60
MARGIN = 1.0
# Lines in a row that a long document gives to the fit.
RUN = 16
# Lines of documents that are worked on together, which bounds memory.
LINES_AT_ONCE = 200_000
# Lines of a chain that are worked on one after another.
SEGMENT = 1024

UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SYMBOLS = b"#*$%&|<>!"
OWN = 14
SHARED = (5, 6, 8, 9, 10)  # of the neighbours
FEATURES = OWN + 2 * len(SHARED) + 2


def line_features(line: bytes, words: list[bytes], seen: set[bytes], before: bytes | None) -> tuple[float, ...]:
    size, count = len(line), len(words)
    if not count:
        return (0.0, 1.0) + (0.0,) * (OWN - 2)
    per = 1.0 / size
    distinct = len(set(words))
    twins = sum(map(bytes.__eq__, words, words[1:])) / count
    return (
        min(np.log1p(count) / 8, 2.0),
        0.0,
        1.0 if count < 4 else 0.0,
        1.0 if count < 10 else 0.0,
        min(size / count / 10, 3.0),
        (size - len(line.translate(None, UPPER))) * per * 4,
        (size - len(line.translate(None, SYMBOLS))) * per * 10,
        (size - len(line.translate(None, DIGITS))) * per * 10,
        min((1 - distinct / count) * 2, 2.0) if count > 1 else 0.0,
        2.0 * twins,
        1.0 if line in seen else 0.0,
        1.0 if line == before else 0.0,
        (size - len(line.translate(None, MARKS))) * per * 10,
        1.0 if count > 3 and 4 * distinct < count else 0.0,
    )


def features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of the lines of a text, and the lengths of the lines."""
    lines = raw.split(b"\n")
    seen: set[bytes] = set()
    rows, before = [], None
    for line in lines:
        words = line.split()
        rows.append(line_features(line, words, seen, before))
        if words:
            seen.add(line)
        before = line
    own = np.array(rows)
    shared = own[:, SHARED]
    edge = np.zeros((1, len(SHARED)))
    ones = np.ones((len(own), 1))
    last = np.zeros((len(own), 1))
    last[0], last[-1] = 0.5, last[-1] + 0.5
    return (
        np.hstack([own, np.vstack([edge, shared[:-1]]), np.vstack([shared[1:], edge]), ones, last]),
        np.array([len(line) + 1 for line in lines], float),
    )


class Chains:
    """Documents as chains side by side, the longest first, one array per line number.

    Chains longer than ``segment`` are cut, see ``long_chain``.
    """

    def __init__(self, sizes: np.ndarray, segment: int = SEGMENT):
        self.segment = segment
        starts = np.r_[0, np.cumsum(sizes)][:-1].astype(np.int64)
        self.long = [slice(int(a), int(a + n)) for a, n in zip(starts, sizes) if n > segment]
        starts, sizes = starts[sizes <= segment], sizes[sizes <= segment]
        order = np.argsort(-sizes, kind="stable")
        sorted_sizes, starts = sizes[order], starts[order]
        longest = int(sorted_sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sorted_sizes, -np.arange(longest), side="left")
        self.rows = [starts[:n] + t for t, n in enumerate(active)]

    def marginals(self, unary: np.ndarray, step: np.ndarray):
        """P(good) per line, log-likelihood part and pair marginals, per chain batch.

        ``unary`` is the score of good over bad for every line, ``step`` the 2 x 2 scores of
        transitions.
        """
        forward = np.zeros((len(unary), 2))
        backward = np.zeros((len(unary), 2))
        total = 0.0
        for t, rows in enumerate(self.rows):
            if t == 0:
                alpha = np.zeros((len(rows), 2))
            else:
                prior = forward[self.rows[t - 1][: len(rows)]]
                alpha = np.logaddexp(prior[:, :1] + step[0], prior[:, 1:] + step[1])
            alpha[:, 1] += unary[rows]
            forward[rows] = alpha
        for t in range(len(self.rows) - 2, -1, -1):
            later = self.rows[t + 1]
            rows = self.rows[t][: len(later)]
            beta = backward[later].copy()
            beta[:, 1] += unary[later]
            backward[rows] = np.logaddexp(beta[:, :1] + step[:, 0], beta[:, 1:] + step[:, 1])
        for chain in self.long:
            forward[chain], backward[chain] = long_chain(unary[chain], step, self.segment)
        both = forward + backward
        norm = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - norm)
        pairs = np.zeros((2, 2))
        steps = [(self.rows[t - 1][: len(self.rows[t])], self.rows[t]) for t in range(1, len(self.rows))]
        steps += [(np.arange(c.start, c.stop - 1), np.arange(c.start + 1, c.stop)) for c in self.long]
        for rows, later in steps:
            beta = backward[later].copy()
            beta[:, 1] += unary[later]
            joint = forward[rows][:, :, None] + step[None] + beta[:, None, :] - norm[rows][:, None, None]
            pairs += np.exp(joint).sum(axis=0)
        if self.rows:
            total = norm[self.rows[0]].sum()
        return good, total + sum(norm[c.start] for c in self.long), pairs


def then(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Scores of going from a to c to b: the product of 2 x 2 matrices in logarithms."""
    return np.logaddexp(left[..., :, :1] + right[..., :1, :], left[..., :, 1:] + right[..., 1:, :])


def long_chain(unary: np.ndarray, step: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward scores of one chain, its segments side by side.

    For each segment the scores from any state before it to any state at each line are found, for all
    segments at once; then what enters each segment is passed on from one to the next.
    """
    count = -(-len(unary) // segment)
    shape, same = (count, 2, 2), np.log(np.eye(2) + np.array([[0, 1e-300], [1e-300, 0]]))
    same[0, 1] = same[1, 0] = -np.inf
    own = np.zeros(count * segment)
    own[: len(unary)] = unary
    own = own.reshape(count, segment)
    real = (np.arange(count * segment) < len(unary)).reshape(count, segment)

    def line(t: int) -> np.ndarray:
        """Scores of the step to line ``t`` of each segment; a line past the end keeps the state."""
        out = np.broadcast_to(step, shape).copy()
        out[:, :, 1] += own[:, t, None]
        if t == 0:
            out[0] = [[0, own[0, 0]]] * 2
        out[~real[:, t]] = same
        return out

    into = [line(0)]
    for t in range(1, segment):
        into.append(then(into[-1], line(t)))
    out_of = [np.broadcast_to(same, shape)]
    for t in range(segment - 1, 0, -1):
        out_of.append(then(line(t), out_of[-1]))
    out_of.reverse()
    entering, leaving = np.zeros((count, 1, 2)), np.zeros((count, 2, 1))
    entering[0] = [[0, -np.inf]]
    first = line(0)
    for s in range(1, count):
        entering[s] = then(entering[s - 1], into[-1][s - 1])
    for s in range(count - 2, -1, -1):
        leaving[s] = then(first[s + 1], then(out_of[0][s + 1], leaving[s + 1]))
    forward = np.stack([then(entering, m)[:, 0, :] for m in into], axis=1).reshape(-1, 2)
    backward = np.stack([then(m, leaving)[:, :, 0] for m in out_of], axis=1).reshape(-1, 2)
    return forward[: len(unary)], backward[: len(unary)]


class Model:
    """Weights of the field, with the scale of the features they were fitted on."""

    def __init__(self, weights: np.ndarray, step: np.ndarray):
        self.weights, self.step = weights, step

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted marginals of the texts, a bounded number of lines at a time."""
        out = np.zeros(len(texts))
        held, first, lines = [], 0, 0
        for at, raw in enumerate(texts):
            found = features(raw)
            held.append(found)
            lines += len(found[0])
            if lines >= LINES_AT_ONCE or at == len(texts) - 1:
                out[first : at + 1] = self.of(held)
                held, first, lines = [], at + 1, 0
        return out

    def of(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        sizes = np.array([len(x) for x, _ in found])
        good = self.lines(found)
        weight = np.concatenate([n for _, n in found])
        starts = np.r_[0, np.cumsum(sizes)][:-1]
        # Rounded, so that a text whose lines are all undecided is not off by what sums lose.
        return np.clip(np.round(np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts), 12), 0, 1)

    def lines(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Marginals of "good" of all lines, one text after the other."""
        sizes = np.array([len(x) for x, _ in found])
        return Chains(sizes).marginals(np.concatenate([x for x, _ in found]) @ self.weights, self.step)[0]


def relabelled(speaks: np.ndarray, labels: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A label for each line: the document's, or the other one where its features clearly say so.

    ``speaks`` is the score of good over bad by a line's features alone. Where the lines that keep
    the document's label would be less than half of its length, all of them keep it.
    """
    own = np.repeat(labels, sizes)
    contrary = speaks * (2 * own - 1) < -MARGIN
    starts = np.r_[0, np.cumsum(sizes)][:-1]
    share = np.add.reduceat(lengths * ~contrary, starts) / np.add.reduceat(lengths, starts)
    return np.where(contrary & np.repeat(share >= 0.5, sizes), 1 - own, own)


def fit(
    rows: list[np.ndarray], labels: np.ndarray, lengths: list[np.ndarray] | None = None, rounds: int = ROUNDS, refine: int = REFINE
) -> Model:
    """Fit in which the lines of a document may differ; without ``lengths`` lines count alike."""
    model = Model(np.zeros(FEATURES), np.zeros((2, 2)))
    if not len(rows):
        return model
    sizes, x = np.array([len(r) for r in rows]), np.concatenate(rows)
    weight = np.ones(len(x)) if lengths is None else np.concatenate(lengths)
    each = np.repeat(labels, sizes)
    model = climbed(model, x, sizes, each, rounds)
    for _ in range(refine):
        after = relabelled(x @ model.weights, labels, sizes, weight)
        if (after == each).all():
            break
        each = after
        model = climbed(model, x, sizes, each, REFINE_ROUNDS)
    return model


def climbed(model: Model, x: np.ndarray, sizes: np.ndarray, each: np.ndarray, rounds: int) -> Model:
    """Maximum conditional likelihood of the lines' labels, from a model on."""
    weights, step = model.weights.copy(), model.step.copy()
    chains = Chains(sizes)
    starts = np.zeros(len(x), bool)
    starts[np.r_[0, np.cumsum(sizes)][:-1].astype(np.int64)] = True
    before, after = each[:-1][~starts[1:]], each[1:][~starts[1:]]
    # Every line counts alike, as the likelihood of a chain grows with its lines.
    observed_steps = np.bincount(2 * before + after, minlength=4).reshape(2, 2).astype(float)
    scale = 1.0 / len(x)
    moments = [np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)]
    for turn in range(1, rounds + 1):
        good, _, pairs = chains.marginals(x @ weights, step)
        slope = np.r_[x.T @ (each - good) * scale, ((observed_steps - pairs) * scale).ravel()]
        slope -= RIDGE * np.r_[weights, step.ravel()]
        moments = [0.9 * moments[0] + 0.1 * slope, 0.99 * moments[1] + 0.01 * slope**2]
        rise = RATE * (moments[0] / (1 - 0.9**turn)) / (np.sqrt(moments[1] / (1 - 0.99**turn)) + 1e-8)
        weights, step = weights + rise[:FEATURES], step + rise[FEATURES:].reshape(2, 2)
    return Model(weights, step)


def spread_lines(count: int, limit: int) -> np.ndarray:
    """Places of at most ``limit`` lines of ``count``: runs of lines at even distances, and the last ones."""
    if count <= limit:
        return np.arange(count)
    run = min(RUN, limit)
    runs, rest = divmod(limit, run)
    starts = np.linspace(0, count - rest - run, runs).astype(int)
    # Runs do not meet: there are more lines than they hold.
    starts = np.maximum.accumulate(starts - np.arange(runs) * run) + np.arange(runs) * run
    return np.r_[(starts[:, None] + np.arange(run)).ravel(), np.arange(count - rest, count)]


def line_limit(counts: list[int], total: int) -> int:
    """The most lines a document may give so that all give at most ``total``, one each at least."""
    left = total
    for at, count in enumerate(sorted(counts)):
        share = left // (len(counts) - at)
        if count > share:
            return max(share, 1)
        left -= count
    return max(counts, default=1)


def train(
    docs: DataFrame,
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
    lines: int = SAMPLE_LINES,
) -> Model:
    """Fit on at most ``sample`` documents of ``docs`` in ``labelled`` (doc_id, quality) and ``lines`` of their lines."""
    known = labelled.where("quality IN (0, 1)").select(F.col("doc_id").alias("_id"), "quality").distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), text.alias("text"), F.xxhash64(text).alias("_hash"))
    ids = texts.select("_id", "_hash").distinct().join(known, "_id")
    chosen = ids.orderBy(F.xxhash64("_id", "_hash"), "_id", "_hash", "quality").limit(sample)
    # ``chosen`` has at most ``sample`` rows of three numbers; of copies one is taken.
    found = texts.join(F.broadcast(chosen), ["_id", "_hash"]).groupBy("_id", "_hash", "quality").agg(F.min("text").alias("text"))
    found = staged(found, "crf-sample")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    limit = line_limit([r["n"] for r in found.select(n_lines.alias("n")).collect()], lines)

    def rows(batch: pa.RecordBatch) -> dict:
        given = [(x[p], n[p]) for x, n in map(features, texts_of(batch, "text")) for p in [spread_lines(len(x), limit)]]
        return {
            "quality": batch.column("quality"),
            "_id": batch.column("_id"),
            "x": [x.astype("<f4").tobytes() for x, _ in given],
            "n": [n.astype("<f4").tobytes() for _, n in given],
        }

    picked = map_batches(found.select("_id", "quality", "text"), rows, "quality int, _id long, x binary, n binary")
    table = sorted(picked.collect(), key=lambda r: (r["_id"], r["quality"], bytes(r["x"])))
    return fit(
        [np.frombuffer(r["x"], "<f4").reshape(-1, FEATURES).astype(float) for r in table],
        np.array([r["quality"] for r in table], int),
        [np.frombuffer(r["n"], "<f4").astype(float) for r in table],
    )


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of every whole text."""
    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "score": model.score(list(texts_of(batch, "text")))}

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, score double")


def lines(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``line`` (from 0), ``good`` (its marginal) and ``label`` of every line of every whole text."""
    names = ["doc_id", "line", "good", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text")):
                good = model.lines([features(raw)])
                columns = [pa.array([doc] * len(good), pa.int64()), pa.array(np.arange(len(good))), pa.array(good), pa.array((good >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, line long, good double, label int")


def accepted(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without the documents that score below ``least``."""
    fields = docs.schema.fields

    def run(batch: pa.RecordBatch) -> dict:
        keep = np.flatnonzero(model.score(list(texts_of(batch, text_col))) >= least)
        kept = pa.array(keep, pa.int64())
        return {f.name: batch.column(f.name).take(kept) for f in fields}

    return map_texts(docs, run, docs.schema)
