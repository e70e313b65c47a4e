"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Longer documents are cut into pieces of the capacity. What is packed is then the
histogram of lengths, which has at most ``capacity`` entries whatever the corpus:

* Large pieces, above a third of the capacity, are at most two to a sequence. They
  are matched greedily, the longest first, each with the longest large piece that fits.
* Smaller pieces, the longest first, go to the smallest gap that holds them, else
  to a new sequence.

Equal lengths are handled in runs, so the plan is a list of runs "pieces i to j of length
n lie in sequences a to b at offset o". Its size depends on the capacity alone. Pieces
are numbered within their length by the task that made them and a count of the tasks before, and
look their run up; neither pieces nor ids are shuffled.

Edge cases: a null text is an empty one, which is the end mark alone; rows that
repeat an id are packed each on its own; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.common import bytes_of, few_rows_at_once, staged, texts_of

CAPACITY = 2048
END = 0
# Distinct words a Python worker keeps the ids of; it starts over beyond that.
CACHE_WORDS = 800_000
# Bytes of text whose new words are encoded together.
TEXT_AT_ONCE = 1 << 20
# Texts that are handed to a task at once: Spark and the worker each hold them, and both keep the memory.
ROWS_AT_ONCE = 500

# Marks that end a word: the tokenizer splits them off as well.
TAIL = re.compile(rb"(?<=[a-z0-9])([.,!?;:]+)(?=\s|$)")

# Words the fast encoder takes: printable, and of letters whose lower case and composed form every
# library agrees on.
PLAIN = "[!-~\u00a1-\u024f]+"
WORD_END, END_BYTE = "</w>", b"\0"

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def words_of(raw: bytes) -> list[bytes]:
    """Parts of a text that the tokenizer encodes on their own.

    It lowers letters too, but not within the names of its special tokens.
    """
    return (raw if b"<|" in raw else TAIL.sub(rb" \1", raw.lower())).split()


class Words(dict):
    """Gives every new word the next number."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def raw_word(word: str) -> bytes:
    """Bytes of a vocabulary entry, a byte of its own for the end of a word."""
    return bytes_of(word[: -len(WORD_END)]) + END_BYTE if word.endswith(WORD_END) else bytes_of(word)


class Encoder:
    """Ids of texts, word by word: each distinct word is encoded once."""

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        import tokenizers

        self.whole = tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        vocabulary, merges = read["model"]["vocab"], read["model"]["merges"]
        self.split = regex.compile(read["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.plain = regex.compile(PLAIN).fullmatch
        # The same merges for an encoder of byte strings: a word's end is a byte of its own, which
        # joins the byte before it first of all.
        ends = [w for w in vocabulary if w.endswith(WORD_END) and len(w) == 1 + len(WORD_END)]
        words = [*ends, *("".join(pair) for pair in merges), *(w for w in vocabulary if len(w) == 1)]
        ranks = {raw_word(word): rank for rank, word in enumerate(words)}
        known = [vocabulary[word] for word in words]
        for byte in range(256):
            ranks.setdefault(bytes([byte]), len(ranks))
        self.ids = np.array(known + [-1] * (len(ranks) - len(known)), np.int64)
        self.closes = np.zeros(len(ranks), bool)
        self.closes[[rank for raw, rank in ranks.items() if raw.endswith(END_BYTE)]] = True
        self.fast = tiktoken.Encoding("words", pat_str="[^\\x00]+\\x00", mergeable_ranks=ranks, special_tokens={})
        self.forget()

    def forget(self) -> None:
        self.words, self.flat, self.sizes = Words(), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and how many each has."""
        own, parts, counts, others = [], [], [], []
        for place, word in enumerate(words):
            if word.isalpha():
                own.append(place)
                parts.append(word.lower().decode())
                counts.append(1)
                continue
            text = word.decode()
            if self.plain(text) and "<|" not in text:
                found = self.split(text.lower())
                own.append(place)
                parts += found
                counts.append(len(found))
            else:
                others.append((place, self.whole.encode(text, add_special_tokens=False).ids))
        # All at once: the ends of the parts tell where the words end.
        tokens = np.array(self.fast.encode_ordinary("\0".join([*parts, ""])), np.int64)
        ends = np.r_[0, np.flatnonzero(self.closes[tokens]) + 1][np.r_[0, np.cumsum(counts, dtype=np.int64)]]
        sizes = np.zeros(len(words), np.int64)
        sizes[own] = np.diff(ends)
        for place, ids in others:
            sizes[place] = len(ids)
        flat, starts = np.zeros(int(sizes.sum()), np.uint32), np.cumsum(sizes) - sizes
        plain = np.zeros(len(flat), bool)
        plain[np.arange(len(tokens)) + np.repeat(starts[own] - ends[:-1], np.diff(ends))] = True
        flat[plain] = self.ids[tokens]
        for place, ids in others:
            flat[starts[place] : starts[place] + len(ids)] = ids
        return flat, sizes

    def texts(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Ids of each text, the end mark last."""
        if len(self.words) > CACHE_WORDS:
            self.forget()
        own = [np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)) for words in texts]
        new = list(islice(reversed(self.words), len(self.words) - len(self.sizes)))[::-1]
        if new:
            flat, sizes = self.encode(new)
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        starts = np.cumsum(self.sizes) - self.sizes
        out = []
        for numbers in own:
            sizes = self.sizes[numbers]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            ids = np.full(total + 1, END, np.uint32)
            ids[:total] = self.flat[np.arange(total) + np.repeat(starts[numbers] - (ends - sizes), sizes)]
            out.append(ids)
        return out


def pieces(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of every whole text, with the checksum of their ids (and the ids).

    The tokenizer drops white space and never joins what it separates, so ids are
    found word by word, and each distinct word is encoded once. ``part`` and ``place`` number the
    pieces of a length: the task that made them, and the piece within it.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers
        from pyspark import TaskContext

        # The tokenizer and its words stay with the Python worker from task to task.
        kept = vars(tokenizers).setdefault("_kept_words", {})
        if tokenizer not in kept:
            kept[tokenizer] = Encoder(tokenizer)
        encoder, part, places = kept[tokenizer], TaskContext.get().partitionId(), [0] * (capacity + 1)

        def rows_of(owners: list[int | None], texts: list[list[bytes]]) -> pa.RecordBatch:
            found, rows = encoder.texts(texts), []
            for owner, ids in zip(owners, found):
                raw = ids.astype("<u4").tobytes()
                for number, at in enumerate(range(0, len(ids), capacity)):
                    length = min(capacity, len(ids) - at)
                    crc = zlib.crc32(raw[4 * at : 4 * (at + length)])
                    rows.append((owner, number, at, length, crc, part, places[length]))
                    places[length] += 1
            columns = list(zip(*rows))
            arrays = [pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, columns)]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(columns[3])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(offsets, np.concatenate(found).astype(np.int32)))
            return pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * with_ids)

        for batch in batches:
            owners, held, size = [], [], 0
            for owner, raw in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text")):
                owners.append(owner)
                held.append(words_of(raw))
                size += len(raw)
                if size >= TEXT_AT_ONCE:
                    yield rows_of(owners, held)
                    owners, held, size = [], [], 0
            if held:
                yield rows_of(owners, held)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECE + ", part long, place long" + (", ids array<int>" if with_ids else ""))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first piece, first sequence, pieces per sequence, offset), sorted.

    Within a run, piece ``first + k`` lies in sequence ``first sequence + k // per`` at
    ``offset + (k % per) * length``.
    """
    left = {length: n for length, n in histogram.items() if n}
    used = dict.fromkeys(left, 0)
    large = sorted(length for length in left if 3 * length > capacity)
    runs: list[tuple[int, int, int, int, int]] = []
    # Sequences with room, by gap: (first sequence, how many).
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_gaps: list[int] = []
    total = 0

    def place(length: int, count: int, sequence: int, per: int, offset: int) -> None:
        runs.append((length, used[length], sequence, per, offset))
        used[length] += count
        left[length] -= count

    def leave(gap: int, sequence: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(open_gaps, gap)
            gaps[gap].append((sequence, count))

    for length in reversed(large):
        while left[length]:
            partner = next(
                (p for p in reversed(large) if p + length <= capacity and left[p] > (p == length)), None
            )
            if partner is None:
                count = left[length]
                place(length, count, total, 1, 0)
                leave(capacity - length, total, count)
            else:
                count = left[length] // 2 if partner == length else min(left[length], left[partner])
                place(length, count, total, 1, 0)
                place(partner, count, total, 1, length)
                leave(capacity - length - partner, total, count)
            total += count

    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(open_gaps, length)
            if at == len(open_gaps):
                # No gap holds it: as many new sequences as all that are left would fill.
                count = -(-left[length] // (capacity // length))
                leave(capacity, total, count)
                total += count
                continue
            gap = open_gaps[at]
            sequence, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], open_gaps[at]
            per = gap // length
            filled = min(count, left[length] // per)
            if filled:
                place(length, filled * per, sequence, per, capacity - gap)
                leave(gap - per * length, sequence, filled)
            elif left[length]:
                rest = left[length]
                place(length, rest, sequence, rest, capacity - gap)
                leave(gap - rest * length, sequence, 1)
                filled = 1
            leave(gap, sequence + filled, count - filled)
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with ``sequence_id`` and ``offset``."""
    made = pieces(docs, tokenizer or tokenizer_path(), id_col, text_col, capacity, with_ids)
    with few_rows_at_once(docs.sparkSession, ROWS_AT_ONCE):
        found = staged(made, "packing-pieces")
    counts = staged(found.groupBy("length", "part").agg(F.count("*").alias("n")), "packing-counts")
    # At most ``capacity`` rows reach the driver.
    histogram = dict(counts.groupBy("length").agg(F.sum("n")).collect())
    runs = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first")
    # One row per task and length: written, so that its size is known when the join is planned.
    starts = staged(counts.select("length", "part", first), "packing-starts")
    ranked = found.join(starts, ["length", "part"]).withColumn("_rank", F.col("_first") + F.col("place"))
    columns = [c for c in found.columns if c not in ("part", "place")]
    lengths, firsts = runs[:, 0], runs[:, 1]
    bounds = {int(n): (int(a), int(b)) for n, a, b in zip(*(np.unique(lengths, return_index=True)), np.r_[np.unique(lengths, return_index=True)[1][1:], len(runs)])}

    @F.arrow_udf("sequence_id long, offset long")
    def look_up(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        length, rank = lengths.to_numpy(), ranks.to_numpy()
        at = np.zeros(len(rank), np.int64)
        for value in np.unique(length):
            own, (low, high) = length == value, bounds[int(value)]
            at[own] = low + np.searchsorted(firsts[low:high], rank[own], side="right") - 1
        into, per = rank - runs[at, 1], runs[at, 3]
        sequence, offset = runs[at, 2] + into // per, runs[at, 4] + into % per * length
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], ["sequence_id", "offset"])

    # Only lengths and ranks go through Python; ids stay where they are.
    return ranked.select(*columns, look_up("length", "_rank").alias("_at")).select(*columns, "_at.*")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and ``ids`` of whole sequences, from ``pack(with_ids=True)``."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.transform("p", lambda p: p["ids"])).alias("ids"))
