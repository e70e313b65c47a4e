"""Packing by non-negative least squares over the histogram of lengths.

Documents are tokenised and cut into pieces of the window; what is left of each is shorter. Full
pieces are sequences of their own. For the others only the histogram of lengths matters, which
has fewer entries than the window whatever the corpus:

1. ``combinations`` enumerates all sets of two or three occurring lengths that fill the window.
2. ``repeats`` finds how often to use each: non-negative least squares against the histogram
   (accelerated projected gradient), where long lengths weigh more, as short ones fit anywhere.
3. Repeats are rounded, the largest first, as far as the histogram goes.
4. ``greedy`` packs the residual: the longest length, then the longest that fits its gap and so on;
   a gap that nothing fits is filled by cutting the longest piece left. As no sequence needs
   padding whose length is a power of two, what remains last is cut at powers of two.

All steps work on whole runs of equal sequences, so the plan depends on the window and not on
the corpus: a run says "pieces i to j of length n, from token s on, are at offset o of the
sequences from q on". Pieces are numbered within their length by the task that made them and a
count of the tasks before; ids are not shuffled.

Edge cases: a null text is an empty one, which is the end mark alone; rows that repeat an id are
packed each on its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.common import bytes_of, few_rows_at_once, staged, texts_of
from fleetlens.llm.packing import ROWS_AT_ONCE, tokenizer_path

WINDOW = 1024
END = 0
TOKENIZER = "byte_bpe_50k.json"
# Steps of the least-squares solver.
STEPS = 300
# Sets kept for each token of the window.
SETS_EACH = 4
# What a token too few or too many of the longest length weighs against one of the shortest.
LONG_WEIGHT = 10.0
# Bytes of text that are tokenised together.
TEXT_AT_ONCE = 1 << 20
# Bits for the number of a piece within its length.
RANK_BITS = 40

PIECE = "doc_id long, start long, length long, doc_tokens long, ids binary"


def pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, window: int) -> DataFrame:
    """Pieces of every whole text with their ids (little-endian numbers of 32 bits).

    ``part`` and ``place`` number the pieces of a length: the task, and the piece within it.
    """
    names = ["doc_id", "start", "length", "doc_tokens", "ids", "part", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(tokenizer), np.array([END], "<u4").tobytes()
        part, places = TaskContext.get().partitionId(), [0] * (window + 1)
        width = 4 * window

        def rows_of(owners: list[int | None], texts: list[str]) -> pa.RecordBatch:
            rows = []
            for owner, ids in zip(owners, encode(texts)):
                ids += end
                for at in range(0, len(ids), width):
                    own = ids[at : at + width]
                    length = len(own) // 4
                    rows.append((owner, at // 4, length, len(ids) // 4, own, part, places[length]))
                    places[length] += 1
            kinds = [pa.binary() if n == "ids" else pa.int64() for n in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            owners, texts, size = [], [], 0
            for owner, raw in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text")):
                owners.append(owner)
                texts.append(raw.decode())
                size += len(raw)
                if size >= TEXT_AT_ONCE:
                    yield rows_of(owners, texts)
                    owners, texts, size = [], [], 0
            if owners:
                yield rows_of(owners, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECE + ", part long, place long")


def encoder(tokenizer: str):
    """Function from texts to the bytes of their ids.

    The vocabulary of the file is read by two libraries that give equal ids. The faster one
    takes all texts but those that may hold a special token.
    """
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    import tokenizers
    from public_tokenizers import PATTERN

    # They stay with the Python worker from task to task.
    kept = vars(tokenizers).setdefault("_kept_encoders", {})
    if tokenizer not in kept:
        whole = tokenizers.Tokenizer.from_file(tokenizer)
        with open(tokenizer, encoding="utf-8") as file:
            read = json.load(file)
        special = {t["content"]: t["id"] for t in read.get("added_tokens", [])}
        ranks = {bytes_of(word): rank for word, rank in read["model"]["vocab"].items() if word not in special}
        fast = tiktoken.Encoding("fast", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        kept[tokenizer] = whole, fast, tuple(special)
    whole, fast, special = kept[tokenizer]

    def one(text: str) -> bytes:
        if not any(mark in text for mark in special):
            return np.array(fast.encode_ordinary(text), "<u4").tobytes()
        return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    return lambda texts: map(one, texts)


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Sets of two or three of the lengths that fill the window, descending, padded with 0."""
    occurs = np.zeros(window + 1, bool)
    occurs[lengths] = True
    longest = lengths[:, None]
    pair = np.stack([longest[:, 0], window - longest[:, 0]], axis=1)
    pair = pair[(pair[:, 0] >= pair[:, 1]) & (pair[:, 1] > 0) & occurs[pair[:, 1]]]
    first, second = (x.ravel() for x in np.meshgrid(lengths, lengths, indexing="ij"))
    third = window - first - second
    good = (first >= second) & (second >= third) & (third > 0)
    good[good] = occurs[third[good]]
    triple = np.stack([first[good], second[good], third[good]], axis=1)
    return np.concatenate([np.pad(pair, ((0, 0), (0, 1))), triple]).astype(np.int64).reshape(-1, 3)


def repeats(sets: np.ndarray, histogram: np.ndarray, steps: int = STEPS, long_weight: float = LONG_WEIGHT) -> np.ndarray:
    """How often to use each set: least squares of what the histogram is missed by, none negative."""
    size = len(histogram)
    if not len(sets):
        return np.zeros(0)
    weight = np.linspace(1.0, long_weight, size)
    weight[0] = 0.0
    scale = histogram.max(initial=1.0)
    wanted = histogram / scale
    flat = sets.ravel()

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, 3), size)

    def slope(x: np.ndarray) -> np.ndarray:
        return (weight * (used(x) - wanted))[sets].sum(axis=1)

    # The largest curvature, by powers.
    x, curvature = np.ones(len(sets)), 1.0
    for _ in range(20):
        x = (weight * used(x))[sets].sum(axis=1)
        curvature = np.linalg.norm(x)
        x /= curvature
    x = y = np.zeros(len(sets))
    pace = 1.0
    for _ in range(steps):
        after = np.maximum(y - slope(y) / (1.05 * curvature), 0)
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        y = after + (pace - 1) / faster * (after - x)
        x, pace = after, faster
    return x * scale


class Plan:
    """Runs (length, first piece, pieces, start, tokens, first sequence, offset) and what is unused."""

    def __init__(self, histogram: dict[int, int], window: int):
        self.window, self.sequences = window, 0
        self.runs: list[tuple[int, int, int, int, int, int, int]] = []
        # By length: parts of pieces (length of the piece, first piece, pieces, start).
        self.left = {length: [(length, 0, count, 0)] for length, count in histogram.items() if count}
        self.count = dict(histogram)

    def take(self, length: int, pieces: int) -> list[tuple[int, int, int, int]]:
        """``pieces`` unused parts of a length, in runs."""
        taken, wanted, own = [], pieces, self.left[length]
        while wanted:
            whole, first, count, start = own.pop()
            used = min(count, wanted)
            taken.append((whole, first, used, start))
            if used < count:
                own.append((whole, first + used, count - used, start))
            wanted -= used
        self.count[length] -= pieces
        if not self.count[length]:
            del self.count[length], self.left[length]
        return taken

    def put(self, length: int, parts: list[tuple[int, int, int, int]]) -> None:
        self.left.setdefault(length, []).extend(parts)
        self.count[length] = self.count.get(length, 0) + sum(p[2] for p in parts)

    def place(self, parts: list[tuple[int, int, int, int]], tokens: int, sequence: int, offset: int) -> None:
        for whole, first, count, start in parts:
            self.runs.append((whole, first, count, start, tokens, sequence, offset))
            sequence += count

    def fill(self, lengths: list[int], times: int, cut: int = 0) -> None:
        """``times`` sequences of these lengths in a row; the last one is cut to ``cut`` tokens, if any."""
        offset = 0
        for i, length in enumerate(lengths):
            parts, tokens = self.take(length, times), length
            if cut and i == len(lengths) - 1:
                tokens = cut
                self.put(length - cut, [(whole, first, count, start + cut) for whole, first, count, start in parts])
            self.place(parts, tokens, self.sequences, offset)
            offset += tokens
        self.sequences += times

    def split_last(self, lengths: list[int]) -> None:
        """One set of pieces as sequences whose lengths are powers of two, the longest first."""
        room = offset = 0
        total = sum(lengths)
        for length in lengths:
            (whole, first, _, start), used = self.take(length, 1)[0], 0
            while used < length:
                if not room:
                    room, offset = 1 << (total.bit_length() - 1), 0
                    total -= room
                    self.sequences += 1
                tokens = min(room, length - used)
                self.place([(whole, first, 1, start + used)], tokens, self.sequences - 1, offset)
                used, room, offset = used + tokens, room - tokens, offset + tokens


def greedy(plan: Plan) -> None:
    """Pack what is left, longest first, cutting a piece where nothing fits a gap."""
    while plan.count:
        lengths = sorted(plan.count, reverse=True)
        need = {lengths[0]: 1}
        content, gap = [lengths[0]], plan.window - lengths[0]
        for length in lengths:
            more = min(gap // length, plan.count[length] - need.get(length, 0))
            if more:
                need[length] = need.get(length, 0) + more
                content += [length] * more
                gap -= more * length
        if gap:
            longest = next((n for n in lengths if plan.count[n] > need.get(n, 0)), None)
            if longest is None:
                plan.split_last(content)
                continue
            need[longest] = need.get(longest, 0) + 1
            content.append(longest)
        plan.fill(content, min(plan.count[n] // k for n, k in need.items()), gap)


def plan(histogram: dict[int, int], window: int = WINDOW, steps: int = STEPS) -> np.ndarray:
    """All runs of a histogram, see ``Plan``."""
    out = Plan(histogram, window)
    if window in out.count:
        out.fill([window], out.count[window])
    lengths = np.array(sorted(out.count), np.int64)
    if len(lengths):
        sets = combinations(lengths, window)
        counts = np.zeros(window + 1)
        counts[lengths] = [out.count[n] for n in lengths.tolist()]
        # Of many ways to meet the histogram one with few sets is taken.
        sets = sets[np.argsort(-repeats(sets, counts, steps), kind="stable")[: SETS_EACH * window]]
        often = repeats(sets, counts, steps)
        for i in np.argsort(-often, kind="stable").tolist():
            times = int(round(often[i]))
            if not times:
                break
            own = [n for n in sets[i].tolist() if n]
            times = min(times, *(out.count.get(n, 0) // own.count(n) for n in own))
            if times:
                out.fill(own, times)
    greedy(out)
    return np.array(out.runs, np.int64).reshape(-1, 7)


def look_up_table(runs: np.ndarray) -> dict[int, tuple[np.ndarray, list[np.ndarray]]]:
    """By length of the whole piece: where the runs of its pieces change, and the runs of each stretch."""
    table = {}
    for length in np.unique(runs[:, 0]).tolist():
        own = runs[runs[:, 0] == length]
        edges = np.unique(np.concatenate([own[:, 1], own[:, 1] + own[:, 2]]))
        spans: list[list] = [[] for _ in edges]
        for run in own[np.argsort(own[:, 3], kind="stable")]:
            for at in range(*np.searchsorted(edges, [run[1], run[1] + run[2]])):
                spans[at].append(run)
        table[length] = edges, [np.array(s, np.int64).reshape(-1, 7) for s in spans]
    return table


class Places:
    """The look-up table as arrays, for many pieces at once."""

    def __init__(self, runs: np.ndarray):
        keys, spans = [np.zeros(0, np.int64)], []
        for length, (edges, own) in look_up_table(runs).items():
            keys.append((length << RANK_BITS) + edges)
            spans += own
        # Stretches in the order of length and first piece; the runs of each, and where they begin.
        self.keys, self.counts = np.concatenate(keys), np.array([len(x) for x in spans], np.int64)
        self.begins = np.cumsum(self.counts) - self.counts
        self.runs = np.concatenate([np.zeros((0, 7), np.int64), *spans])

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Parts of each piece: how many, and start, tokens, sequence and offset of all parts."""
        at = self.keys.searchsorted((lengths << RANK_BITS) + ranks, "right") - 1
        counts = self.counts[at]
        ends = np.cumsum(counts)
        within = np.arange(counts.sum()) - np.repeat(ends - counts, counts)
        found = self.runs[np.repeat(self.begins[at], counts) + within]
        return counts, [found[:, 3], found[:, 4], found[:, 5] + np.repeat(ranks, counts) - found[:, 1], found[:, 6]]


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    steps: int = STEPS,
) -> DataFrame:
    """Pieces of all documents with their ids, ``sequence_id`` and ``offset``."""
    made = pieces(docs, tokenizer or tokenizer_path(TOKENIZER), id_col, text_col, window)
    with few_rows_at_once(docs.sparkSession, ROWS_AT_ONCE):
        found = staged(made, "nnls-pieces")
    counts = staged(found.groupBy("length", "part").agg(F.count("*").alias("n")), "nnls-counts")
    # At most ``window`` rows reach the driver.
    histogram = dict(counts.groupBy("length").agg(F.sum("n")).collect())
    table = Places(plan(histogram, window, steps))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task and length: written, so that its size is known when the join is planned.
    starts = staged(counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "nnls-starts")
    names = ["first", "tokens", "sequence_id", "offset"]

    @F.arrow_udf(f"array<struct<{', '.join(f'{name}: bigint' for name in names)}>>")
    def look_up(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        parts, columns = table.of(lengths.to_numpy(), ranks.to_numpy())
        ends = np.concatenate([[0], np.cumsum(parts)]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c) for c in columns], names))

    # Only lengths and ranks go through Python; ids stay where they are, and are cut there.
    ranked = found.join(starts, ["length", "part"])
    whole = ["doc_id", "start", F.col("length").alias("whole"), "doc_tokens", "ids"]
    ranked = ranked.select(*whole, look_up("length", F.col("first") + F.col("place")).alias("parts"))
    parts = ranked.select("doc_id", "start", "whole", "doc_tokens", "ids", F.inline("parts"))
    own = F.expr("CASE WHEN tokens = whole THEN ids ELSE substring(ids, CAST(4 * first + 1 AS INT), CAST(4 * tokens AS INT)) END")
    return parts.select(
        "doc_id",
        (F.col("start") + F.col("first")).alias("start"),
        F.col("tokens").alias("length"),
        "doc_tokens",
        own.alias("ids"),
        "sequence_id",
        "offset",
    )


def padding(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """``sequences``, ``tokens`` and ``padding`` of the whole: none at a power of two, else up to the window."""
    sizes = packed.groupBy("sequence_id").agg(F.sum("length").alias("size"))
    pad = F.expr(f"CASE WHEN bit_count(size) = 1 THEN 0 ELSE {window} - size END")
    return sizes.agg(F.count("*").alias("sequences"), F.sum("size").alias("tokens"), F.sum(pad).alias("padding"))
