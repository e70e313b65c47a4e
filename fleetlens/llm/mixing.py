"""Mixing sources to target weights, in fixed-length blocks of words.

The words of a source, document after document, are cut into blocks of ``BLOCK``
words. Sources get targets from their weights; a target stops at ``MAX_PASSES`` times the
source's size and the excess is shared again by weight. A source's target is a number of
slots. They are dealt over output shards by multinomial draws: the total is split by
binomial draws down a binary tree of shards, so each shard finds its counts and the
number of the first slot on its own, and counts add up to the target. Slot ``j`` of a
source is the block ``perm(j)`` of pass ``j // blocks``, with a keyed pseudorandom
permutation of the source's block numbers per pass, so no word is taken more often than
there are passes. The last slot is cut to the words that are still missing. Slots are
joined with documents by block number.

All draws depend on the seed, the source's rank and the shard alone, so reruns agree.

Edge cases: null and empty texts have size 0 and are never taken; null sources are
one source that comes last; an empty source has the target 0; rows that repeat an id
are documents of their own; long documents span many blocks; an empty table gives no
rows; other columns are carried by ``mixed`` and not read by ``taken``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from fleetlens.llm.common import map_batches, map_texts, partitions, staged

BLOCK = 512
SHARD_SLOTS = 1024
WEIGHTS = (5, 2, 1)
MAX_PASSES = 2
SEED = 20240229
# Parts of a source whose words are counted apart; raise for sources of more than
# some billion documents.
BUCKETS = 4096
# Shards are listed in two steps of at most this many.
FAN = 4096

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sized(rows: DataFrame, text_col: str) -> DataFrame:
    """``_size`` (words) of every whole text beside the columns of ``rows``.

    The text is a column, or a field of the column ``row``.
    """
    within = "row" in rows.columns

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column("row").field(text_col) if within else batch.column("text")
        sizes = [0 if (raw := text.as_buffer()) is None else len(raw.to_pybytes().split()) for text in texts]
        return {name: batch.column(name) for name in batch.schema.names} | {"_size": sizes}

    return map_texts(rows, run, StructType([*rows.schema.fields, StructField("_size", LongType())]))


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: rank, size, weight and target; ``sizes`` has source and _size."""
    totals = sizes.groupBy("source").agg(F.sum("_size").alias("source_size"))
    # From here on there is a row per source.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = totals.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long"))
    everything = Window.partitionBy()
    # Sources reach their limit in the order of size by weight; the limited ones are
    # a prefix of that order. All numbers are whole and twice the words.
    lcm = int(np.lcm.reduce(WEIGHTS))
    order = [F.col("source_size") * F.floor(F.lit(lcm) / F.col("weight")), F.col("rank")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns(
        {
            "budget": 3 * F.sum("source_size").over(everything),
            "limit": 2 * MAX_PASSES * F.col("source_size"),
            "spent": F.coalesce(F.sum(2 * MAX_PASSES * F.col("source_size")).over(before), F.lit(0)),
            "left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    full = F.col("weight") * (F.col("budget") - F.col("spent")) >= F.col("limit") * F.col("left")
    ranked = ranked.withColumn("full", full)
    spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everything), F.lit(0))
    left = F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything), F.lit(0))
    share = F.col("weight") * (F.col("budget") - spent) / F.greatest(2 * left, F.lit(1))
    target = F.when(F.col("full"), (F.col("limit") / 2).cast("double")).otherwise(share.cast("double"))
    return ranked.withColumn("target", target).select("source", F.col("rank").cast("long").alias("rank"), "source_size", "weight", "target")


def mix64(*parts: int) -> int:
    """A well-mixed 64-bit number of whole numbers."""
    state = 0x9E3779B97F4A7C15
    for part in parts:
        state = (state ^ part) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        state ^= state >> 29
        state = state * 0x94D049BB133111EB & (1 << 64) - 1
        state ^= state >> 32
    return state


def feistel(values: np.ndarray, size: int, key: int, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of ``range(size)``: four rounds, walked back into range."""
    half = max((max(size - 1, 1).bit_length() + 1) // 2, 1)
    low = np.uint64((1 << half) - 1)
    keys = [np.uint64(mix64(key, i)) for i in range(4)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ rounds(left, k), left
            else:
                left, right = right, left ^ rounds(right, k)
        return (left << np.uint64(half)) | right

    def rounds(x: np.ndarray, k: np.uint64) -> np.ndarray:
        y = (x ^ k) * np.uint64(0xBF58476D1CE4E5B9)
        y ^= y >> np.uint64(31)
        y *= np.uint64(0x94D049BB133111EB)
        return (y ^ (y >> np.uint64(29))) & low

    out = once(values.astype(np.uint64))
    while (outside := out >= size).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


class Deal:
    """Slots of one source: what they hold and how many each shard gets."""

    def __init__(self, rank: int, size: int, target: float, block: int, seed: int):
        self.rank, self.size, self.block, self.seed = rank, size, block, seed
        self.blocks = -(-size // block)
        self.tail = size - (self.blocks - 1) * block if size else 0
        want = min(round(target), MAX_PASSES * size)
        self.passes, rest = divmod(want, size) if size else (0, 0)
        self.last, self.cut = 0, None
        if rest:
            tail_at = int(feistel(np.array([self.blocks - 1]), self.blocks, self.key(self.passes), True)[0])
            slots = -(-rest // block)
            if tail_at < slots:
                slots = -(-(rest + block - self.tail) // block)
            have = slots * block - (block - self.tail) * (tail_at < slots)
            self.last, self.cut = slots, have - rest
        self.slots = self.passes * self.blocks + self.last
        self.drawn: dict[tuple[int, int], int] = {}

    def key(self, turn: int) -> int:
        return mix64(self.seed, self.rank, turn)

    def shard(self, shard: int, shards: int) -> tuple[int, int]:
        """First slot and number of slots of a shard."""
        low, high, first, count = 0, shards, 0, self.slots
        while high - low > 1 and count:
            middle = (low + high) // 2
            left = self.split(low, high, count, middle)
            if shard < middle:
                high, count = middle, left
            else:
                low, first, count = middle, first + left, count - left
        return first, count

    def split(self, low: int, high: int, count: int, middle: int) -> int:
        """Of ``count`` slots of shards ``low`` to ``high``, those of the shards below ``middle``."""
        if (low, high) not in self.drawn:
            draw = np.random.Generator(np.random.Philox(key=mix64(self.seed, self.rank, low, high)))
            self.drawn[low, high] = int(draw.binomial(count, (middle - low) / (high - low)))
        return self.drawn[low, high]

    def content(self, first: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pass, block and length of the slots ``first`` to ``first + count - 1``."""
        slots = np.arange(first, first + count)
        turns = slots // max(self.blocks, 1)
        blocks = np.zeros(count, np.int64)
        for turn in np.unique(turns):
            own = turns == turn
            blocks[own] = feistel(slots[own] - turn * self.blocks, self.blocks, self.key(int(turn)))
        lengths = np.where(blocks == self.blocks - 1, self.tail, self.block)
        if self.cut:
            lengths[slots == self.slots - 1] -= self.cut
        return turns, blocks, lengths


def slots(sources: DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """One row per slot: rank, shard, slot, pass, block number and words."""
    # Slots are at most the blocks of all passes and one cut block per source.
    number = F.sum(F.ceil(F.col("target") / block) + MAX_PASSES + 1).over(Window.partitionBy())
    shards = F.ceil(number / shard_slots).cast("long")
    groups = sources.withColumn("shards", shards).withColumn(
        "g", F.explode(F.expr(f"sequence(0L, (shards - 1) div {FAN})"))
    )
    listed = groups.select(
        "rank",
        "source_size",
        "target",
        "shards",
        F.explode(F.expr(f"sequence(g * {FAN}, least((g + 1) * {FAN}, shards) - 1)")).alias("shard"),
    ).repartition(partitions(sources.sparkSession), "rank", "shard")

    def run(batch: pa.RecordBatch) -> dict:
        out = {name: [] for name in ("rank", "shard", "slot", "turn", "block", "words")}
        deals: dict[int, Deal] = {}
        for row in batch.to_pylist():
            rank = row["rank"]
            if rank not in deals:
                deals[rank] = Deal(rank, row["source_size"], row["target"], block, seed)
            first, count = deals[rank].shard(row["shard"], row["shards"])
            turns, blocks, words = deals[rank].content(first, count)
            for name, values in zip(
                out, (np.full(count, rank), np.full(count, row["shard"]), np.arange(first, first + count), turns, blocks, words)
            ):
                out[name].append(values)
        return {name: np.concatenate(parts) if parts else [] for name, parts in out.items()}

    found = map_batches(listed, run, "rank long, shard long, slot long, turn long, block long, words long")
    # Spark cannot know how many rows the function makes; a file's size it does, so it
    # broadcasts slots only where they are few.
    return staged(found, "mixing-slots")


def placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, whole: bool):
    """Documents with ``_rank`` of the source and ``_at``, their first word in it; sources.

    ``whole`` keeps each row of ``docs`` as the column ``row``, so its columns may have any names.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.xxhash64(id_col, text_col).alias("_key"),
        F.struct("*").alias("row") if whole else F.col(text_col).cast("string").alias("text"),
    )
    rows = staged(sized(rows, text_col).drop("text"), "mixing-sizes")
    sources = staged(targets(rows.select("source", "_size")), "mixing-sources")
    of = sources.select(F.col("source").alias("_source"), F.col("rank").alias("_rank"))
    # The sources are read from a file of known size: broadcast if small, else shuffled.
    rows = rows.join(of, rows["source"].eqNullSafe(of["_source"])).drop("_source")
    rows = rows.withColumn("_bucket", F.pmod(F.col("_key"), F.lit(BUCKETS)))
    inside = Window.partitionBy("_rank", "_bucket").orderBy("doc_id", "_key", "_size")
    rows = rows.withColumn("_in", F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sums = rows.groupBy("_rank", "_bucket").agg(F.sum("_size").alias("_sum"))
    upto = Window.partitionBy("_rank").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sums.withColumn("_start", F.sum("_sum").over(upto) - F.col("_sum")).drop("_sum")
    rows = rows.join(starts, ["_rank", "_bucket"]).withColumn("_at", F.col("_start") + F.col("_in") - F.col("_size"))
    return staged(rows.drop("_bucket", "_in", "_start", "_key"), "mixing-placed"), sources


def pieces(rows: DataFrame, taken_slots: DataFrame, block: int) -> DataFrame:
    """Per document and slot the words taken: (_rank, _at, turn, first word, words)."""
    spread = (
        rows.where("_size > 0")
        .select("_rank", "_at", "_size", F.explode(F.expr(f"sequence(_at div {block}, (_at + _size - 1) div {block})")).alias("block"))
    )
    joined = spread.join(taken_slots.withColumnRenamed("rank", "_rank"), ["_rank", "block"])
    start = F.greatest(F.col("_at"), F.col("block") * block)
    end = F.least(F.col("_at") + F.col("_size"), F.col("block") * block + F.col("words"))
    return joined.select(
        "_rank", "_at", "turn", (start - F.col("_at")).alias("first"), (end - start).alias("count")
    ).where("count > 0")


def taken(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block: int = BLOCK,
    shard_slots: int = SHARD_SLOTS,
    seed: int = SEED,
) -> DataFrame:
    """Per document its size, its source's size and target, and the words the mix takes."""
    rows, sources = placed(docs, id_col, text_col, source_col, whole=False)
    found = pieces(rows, slots(sources, block, shard_slots, seed), block)
    sums = found.groupBy("_rank", "_at").agg(F.sum("count").alias("taken")).withColumn("_full", F.lit(True))
    facts = sources.select(F.col("rank").alias("_rank"), "source_size", "target")
    joined = rows.withColumn("_full", F.col("_size") > 0).join(sums, ["_rank", "_at", "_full"], "left")
    return joined.join(facts, "_rank").select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
    )


def cut(text: str, size: int, runs: list[tuple[int, int]]) -> list[str]:
    """The texts of runs (first word, words); a run of all words is the whole text."""
    if all(run == (0, size) for run in runs):
        return [text] * len(runs)
    words = [m.span() for m in WORD.finditer(text)]
    return [text if run == (0, size) else text[words[run[0]][0] : words[run[0] + run[1] - 1][1]] for run in runs]


def merged(parts: list[dict]) -> list[tuple[int, int]]:
    """Pieces (turn, first, count) joined where one follows the other in the same pass."""
    runs: list[list[int]] = []
    for part in sorted(parts, key=lambda p: (p["turn"], p["first"])):
        if runs and runs[-1][0] == part["turn"] and runs[-1][1] + runs[-1][2] == part["first"]:
            runs[-1][2] += part["count"]
        else:
            runs.append([part["turn"], part["first"], part["count"]])
    return [(first, count) for _, first, count in runs]


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    length_col: str = "n_chars",
    block: int = BLOCK,
    shard_slots: int = SHARD_SLOTS,
    seed: int = SEED,
) -> DataFrame:
    """The mix itself, in the columns of ``docs``.

    One row per pass over a document and run of words taken in it; the text is the whole
    text if all words are, else from the run's first word to its last. ``length_col``,
    if there is one, is the length of the new text.
    """
    rows, sources = placed(docs, id_col, text_col, source_col, whole=True)
    found = pieces(rows, slots(sources, block, shard_slots, seed), block)
    # A document's pieces are at most its blocks in each pass.
    parts = found.groupBy("_rank", "_at").agg(F.collect_list(F.struct("turn", "first", "count")).alias("_parts"))
    joined = rows.where("_size > 0").join(parts, ["_rank", "_at"]).select("row", "_size", "_parts")
    names = docs.columns

    def run(batch: pa.RecordBatch) -> dict:
        places, texts = [], []
        row = batch.column("row")
        for at, (text, size, own) in enumerate(zip(row.field(text_col), batch.column("_size").to_pylist(), batch.column("_parts"))):
            found = cut(text.as_py(), size, merged(own.as_py()))
            places += [at] * len(found)
            texts += found
        chosen = row.take(pa.array(places, pa.int64()))
        return {name: chosen.field(name) for name in names} | {text_col: texts, length_col: [len(t) for t in texts]}

    return map_texts(joined, run, docs.schema)
