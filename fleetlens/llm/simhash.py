"""Near-duplicates by SimHash: pigeonhole blocks, join on blocks, verified distance.

A fingerprint is cut into ``blocks`` blocks. Two fingerprints that differ in at most
``distance`` bits agree in at least ``blocks - distance`` whole blocks, so they share
one of the keys made of every choice of that many blocks. Distinct fingerprints are
joined on these keys and their Hamming distance is verified.

A key shared by more than ``bucket_rows`` fingerprints is not joined with itself.
Its rows are keyed again on the bits that the key leaves free, cut into sub-blocks of
``SUB_BITS`` bits, by the same argument. A bucket of the second kind has at most
2^(SUB_BITS * distance) distinct fingerprints whatever the size of the corpus, and
gives a spanning forest of its links instead of its pairs, so no link is lost and no
group is expanded.

Edge cases: null and empty texts have the fingerprint zero and link like any
other; texts of fewer words than a shingle hash the whole sequence; documents with
equal fingerprints link at distance zero; rows that repeat an id each get a row; a
row with a null id gets a class like any other but is never its representative unless
all of the class are null; an empty table gives no rows; other columns are kept
by ``one_of_each`` and not read by the rest.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import map_texts, staged, texts_of
from fleetlens.llm.components import components

SHINGLE = 3
DISTANCE = 3
SEED = 42
BLOCKS = 6
BUCKET_ROWS = 256
SUB_BITS = 4
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
# Shingles hashed at once, which bounds memory for very long texts.
STEP = 1 << 16


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned SimHash of a UTF-8 text."""
    words = raw.translate(LOWER).split()
    if not words:
        return 0
    total = max(len(words) - shingle + 1, 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, total, STEP):
        part = words[start : start + STEP + shingle - 1]
        if total == 1:
            hashes = [digest(b" ".join(part), seed)]
        else:
            hashes = [digest(b" ".join(x), seed) for x in zip(*(part[i:] for i in range(shingle)))]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``text_key`` (a hash of the text) and ``fp``, the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> dict:
        values = np.array([fingerprint(raw, shingle) for raw in texts_of(batch, "text")], np.uint64)
        return {"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "fp": values.view(np.int64)}

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text_key(text_col).alias("text_key"),
        F.col(text_col).cast("string").alias("text"),
    )
    return map_texts(rows, run, "doc_id long, text_key long, fp long")


def spans(bits: int, count: int) -> list[tuple[int, int]]:
    """(start, width) of ``count`` blocks that cover ``bits`` bits, low bits first."""
    edges = [bits * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def mask_of(blocks) -> int:
    return sum(((1 << width) - 1) << start for start, width in blocks)


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def block_keys(distance: int, blocks: int) -> list[int]:
    """Masks of every choice of blocks that a close pair may agree in."""
    parts = spans(64, blocks)
    return [mask_of(choice) for choice in combinations(parts, blocks - distance)]


def free_bits(mask: int) -> list[int]:
    return [bit for bit in range(64) if not mask >> bit & 1]


def close_pairs(fps: DataFrame, distance: int, blocks: int, bucket_rows: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints; hot buckets give a spanning forest."""
    masks = block_keys(distance, blocks)
    keyed = fps.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("part")) for i, m in enumerate(masks)])
        ).alias("k"),
    ).select("fp", "k.choice", "k.part")
    sizes = keyed.groupBy("choice", "part").agg(F.count("*").alias("n")).where("n > 1")
    shared = staged(keyed.join(sizes, ["choice", "part"]), "simhash-buckets")

    cold = shared.where(F.col("n") <= bucket_rows).select("choice", "part", "fp")
    left, right = cold.withColumnRenamed("fp", "a"), cold.withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    links = left.join(right, ["choice", "part"]).where((F.col("a") < F.col("b")) & near).select("a", "b")

    # The bits a key leaves free, in sub-blocks: a close pair agrees in all but
    # ``distance`` of them.
    sub_keys = []
    for choice, mask in enumerate(masks):
        free = free_bits(mask)
        subs = [sum(1 << bit for bit in free[i : i + SUB_BITS]) for i in range(0, len(free), SUB_BITS)]
        for dropped in combinations(subs, min(distance, len(subs))):
            kept = ((1 << 64) - 1) ^ sum(dropped)
            sub_keys.append((choice, signed(kept)))
    by_choice = [[m for c, m in sub_keys if c == choice] for choice in range(len(masks))]
    table = F.array(*[F.array(*[F.lit(m) for m in row]) for row in by_choice])
    hot = (
        shared.where(F.col("n") > bucket_rows)
        .select("fp", F.explode(F.element_at(table, F.col("choice") + 1)).alias("mask"))
        .select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("part"))
        .distinct()
    )
    forests = hot.groupBy("mask", "part").applyInArrow(lambda t: forest(t, distance), "a long, b long")
    return links.unionByName(forests).distinct()


def forest(bucket: pa.Table, distance: int) -> pa.Table:
    """Spanning forest of the close pairs of one bounded bucket."""
    fps = np.unique(bucket.column("fp").to_numpy())
    left, right = [], []
    todo = np.arange(len(fps))
    while len(todo):
        frontier, todo = [todo[0]], todo[1:]
        while frontier and len(todo):
            at = frontier.pop()
            near = np.bitwise_count((fps[todo] ^ fps[at]).view(np.uint64)) <= distance
            found, todo = todo[near], todo[~near]
            left += [int(fps[at])] * len(found)
            right += fps[found].tolist()
            frontier += found.tolist()
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    blocks: int = BLOCKS,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Per row ``doc_id``, ``fp``, its class and ``component_id``, the smallest id reachable."""
    marked = staged(fingerprints(docs, id_col, text_col, shingle), "simhash-marks")
    distinct = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    links = staged(close_pairs(distinct.select("fp"), distance, blocks, bucket_rows), "simhash-links")
    roots = staged(components(links), "simhash-roots")
    smallest = (
        roots.join(distinct, roots["node"] == distinct["fp"])
        .groupBy("root")
        .agg(F.min("first_id").alias("component_id"))
    )
    linked = roots.join(smallest, "root").select(F.col("node").alias("fp"), "root", "component_id")
    classes = staged(
        distinct.join(linked, "fp", "left").select(
            "fp",
            F.coalesce("root", "fp").alias("class_fp"),
            F.coalesce("component_id", "first_id").alias("component_id"),
        ),
        "simhash-classes",
    )
    # Both sides come from files, so the join shuffles both and adaptive execution can
    # split a fingerprint that many documents have.
    return marked.join(classes, "fp").select("doc_id", "text_key", "fp", "class_fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: the smallest id, then the smallest text hash.

    Rows that repeat both are cut to one.
    """
    classes = near_duplicates(docs, id_col, text_col, **options)
    own = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = own.groupBy("class_fp").agg(F.min(F.struct("doc_id", "text_key")).alias("best"))
    chosen = chosen.select(F.col("best.doc_id").alias("_kept_id"), F.col("best.text_key").alias("_kept_key")).distinct()
    # Own names beside the row as a whole, so that its columns may have any names.
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("key"))
    matches = keyed["id"].eqNullSafe(chosen["_kept_id"]) & (keyed["key"] == chosen["_kept_key"])
    # The join leaves rows partitioned and sorted by the two keys, so this adds no shuffle.
    return keyed.join(chosen, matches, "left_semi").dropDuplicates(["id", "key"]).select("row.*")


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def as_hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
