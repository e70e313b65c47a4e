"""Removal of byte strings that repeat across documents, by prefix doubling.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id. As in prefix doubling, the name of a string of 2n bytes is
made of the names of its halves, and what is unique among names of one length is not
carried to the next. Names are 64-bit hashes, so doubling from 1 to 16 bytes, and the
overlapping pairs that give 33, 50 and 84 bytes, need no exchange. Spark exchanges and
sorts names to tell which of them repeat, in three rounds:

* 16 bytes. Of the 35 names in each 50-byte window the smallest (leftmost of equal ones)
  is the window's anchor; equal windows have equal anchors, and about one position in
  17 is one. Anchors whose name is in one document only drop out with all their windows.
* 33 and 84 bytes. A window that repeats agrees with its twin in the 33 bytes up to or
  from its anchor; anchors unique in both drop out. An anchor whose 84 bytes, the
  reach of all its windows, are in a smaller document is settled: its windows go.
* 50 bytes. What is left are the edges of repeated passages. The windows of each
  distinct edge, from its first document, are compared one by one.

Documents are kept in blocks of about ``BLOCK_BYTES``, and names travel as sorted arrays,
each distinct name once per block, so a name that a third of all documents have costs a
value per block. The answers are bits in the order of the names. A block and what it
receives are bounded whatever the number of documents, as are the names of one part but
for a name that every block has: it costs its part 16 to 32 bytes a block. For such
corpora ``BLOCK_BYTES`` is the number to raise.

Names are not compared byte by byte: two different strings with one 64-bit name would
count as equal. Among n names that is expected n^2 / 2^65 times at most, with a name for
every 17 bytes: 0.0001 times in a gigabyte, 100 times in a terabyte.

Edge cases: a null text is an empty one; texts under 50 bytes keep everything; matches
never cross documents; a repeat within one document alone stays; null ids count as
larger than all others; rows with equal ids are not smaller than each other, each
gives a row; an empty table gives no rows; other columns are not read. A document
longer than a block has a block of its own and is named a segment at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import staged, texts_of

LENGTH = 50
ANCHOR = 16
HALF = 33
BLOCK_BYTES = 2 << 20
# Bytes of text whose names one part sorts.
PART_BYTES = 4 << 20
SEGMENT = 1 << 20
REACH = LENGTH - ANCHOR  # bytes a window may have before or after its anchor
PLACE_BITS = np.uint64(24)
NO_ID = np.iinfo(np.int64).max

BLOCK = "block long, ids binary, sizes binary, text binary"
NAMES = "part long, block long, names binary"
REPLY = "block long, round int, part long, bits binary"
ENTRY = np.dtype([("context", "<u8"), ("left", "<u8"), ("right", "<u8"), ("doc", "<i8")])
WINDOW = np.dtype([("name", "<u8"), ("doc", "<i8")])


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents in compressed blocks, without a shuffle."""
    kinds = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("text", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=3).compress
        ids, held, size = [], [], 0
        for batch in batches:
            for doc, raw in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text")):
                ids.append(NO_ID if doc is None else doc)
                held.append(raw)
                size += len(raw) + 1
                if size >= BLOCK_BYTES:
                    yield row(number, ids, held, pack)
                    ids, held, size, number = [], [], 0, number + 1
        if ids:
            yield row(number, ids, held, pack)

    def row(number, ids, held, pack) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in held], np.int64)
        values = [number, np.array(ids, np.int64).tobytes(), sizes.tobytes(), pack(b"".join(held))]
        return pa.RecordBatch.from_arrays([pa.array([v], k.type) for v, k in zip(values, kinds)], schema=kinds)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, BLOCK)


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of concatenations of two named strings."""
    name = left * np.uint64(0x9E3779B97F4A7C15)
    name += right
    name ^= name >> np.uint64(32)
    name *= np.uint64(0xD6E8FEB86659FD93)
    name ^= name >> np.uint64(29)
    return name


def joined(names: np.ndarray, shift: int) -> np.ndarray:
    """Names of longer strings: each with the one ``shift`` further on."""
    return pair(names[:-shift], names[shift:])


class Block:
    """The documents of a block as one array of codes, apart by more than a context."""

    def __init__(self, ids: bytes, sizes: bytes, text: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.sizes = np.frombuffer(sizes, np.int64)
        self.text = zstandard.ZstdDecompressor().decompress(text)
        gap = LENGTH
        self.starts = np.r_[0, np.cumsum(self.sizes + gap)][:-1] + gap
        total = int((self.sizes + gap).sum()) + gap
        # Separators are a code of their own.
        codes = np.full(total, 256, np.uint16)
        places = np.repeat(self.starts - (np.cumsum(self.sizes) - self.sizes), self.sizes) + np.arange(len(self.text))
        codes[places] = np.frombuffer(self.text, np.uint8)
        self.codes = codes
        # Where windows start: they end within the same document.
        long = self.sizes >= LENGTH
        edge = np.zeros(total + 1, np.int8)
        edge[self.starts[long]] = 1
        edge[(self.starts + self.sizes)[long] - LENGTH + 1] = -1
        self.fits = np.cumsum(edge[:-1], dtype=np.int8).view(bool)

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        """Number within the block of the document at each place."""
        return np.searchsorted(self.starts, places, side="right") - 1

    def segments(self) -> Iterator[Segment]:
        for start in range(0, len(self.codes), SEGMENT):
            yield Segment(self, start, min(start + SEGMENT, len(self.codes)))


class Segment:
    """Anchors of the windows that start between two places of a block."""

    def __init__(self, block: Block, start: int, end: int):
        # Room for the contexts of all anchors, with separators beyond the block.
        low, high = start - REACH, end + REACH + 2 * LENGTH
        codes = block.codes[max(low, 0) : high]
        codes = np.pad(codes, (max(-low, 0), max(high - len(block.codes), 0)), constant_values=256)
        self.low = low
        names = codes.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
        for size in (1, 2, 4, 8):
            names = joined(names, size)
        self.names = names  # of 16 bytes
        windows = np.flatnonzero(block.fits[start:end]) + start
        # The smallest name of a window and, in the low bits, its place in the segment.
        ranked = (names >> PLACE_BITS) << PLACE_BITS
        ranked |= np.arange(len(ranked), dtype=np.uint64)
        for step in (1, 2, 4, 8, 16):
            ranked = np.minimum(ranked[:-step], ranked[step:])
        ranked = np.minimum(ranked[: -(REACH - 31)], ranked[REACH - 31 :])
        places = (ranked[windows - low] & np.uint64((1 << 24) - 1)).astype(np.int64) + low
        new = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]) | (windows[1:] != windows[:-1] + 1)]) if len(places) else places
        last = np.r_[new[1:], len(places)] - 1 if len(new) else new
        # One row per anchor and run of windows: their first and last start.
        self.anchor, self.first, self.last = places[new], windows[new], windows[last]
        self.name = names[self.anchor - low]
        self.doc = block.doc_of(self.anchor)

    def longer(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of 84 bytes around some anchors, and of 33 up to and from them."""
        at = self.anchor[own] - self.low
        n32 = lambda i: pair(self.names[i], self.names[i + 16])
        n33 = lambda i: pair(n32(i), n32(i + 1))
        n50 = lambda i: pair(n32(i), n32(i + 18))
        return pair(n50(at - REACH), n50(at)), n33(at - (HALF - ANCHOR)), n33(at)

    def windows(self, starts: np.ndarray) -> np.ndarray:
        """Names of the 50 bytes from each start."""
        at = starts - self.low
        return pair(pair(self.names[at], self.names[at + 16]), pair(self.names[at + 18], self.names[at + 34]))


def packed(number: int, keys: np.ndarray, values: np.ndarray, parts: int) -> pa.Table:
    """A row per part that has any of the keys; values keep their order."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    found, at = np.unique(part[order], return_index=True)
    pieces = np.split(values[order], at[1:]) if len(found) else []
    return pa.table(
        {
            "part": pa.array(found, pa.int64()),
            "block": pa.array([number] * len(found), pa.int64()),
            "names": pa.array([x.tobytes() for x in pieces], pa.binary()),
        }
    )


def unpacked(keys: np.ndarray, parts: int, replies: dict[int, bytes], bits: int) -> list[np.ndarray]:
    """The ``bits`` answers to each key, from the replies of its part."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    found, at, sizes = np.unique(part[order], return_index=True, return_counts=True)
    out = [np.zeros(len(keys), bool) for _ in range(bits)]
    for value, start, size in zip(found.tolist(), at, sizes):
        answers = np.unpackbits(np.frombuffer(replies[value], np.uint8), count=size * bits).astype(bool)
        for i in range(bits):
            out[i][order[start : start + size]] = answers[i * size : (i + 1) * size]
    return out


def answered(names: DataFrame, round_: int, decide) -> DataFrame:
    """Ask the parts: ``decide`` gets the arrays of all blocks and gives bit arrays."""

    def run(part: pa.Table) -> pa.Table:
        arrays = [raw.as_buffer() for raw in part.column("names").combine_chunks()]
        sizes, flags = decide(arrays)
        edges = np.r_[0, np.cumsum(sizes)]
        bits = [np.packbits(np.concatenate([f[a:b] for f in flags])).tobytes() for a, b in zip(edges, edges[1:])]
        n = part.num_rows
        return pa.table(
            {
                "block": part.column("block"),
                "round": pa.array([round_] * n, pa.int32()),
                "part": part.column("part"),
                "bits": pa.array(bits, pa.binary()),
            }
        )

    return names.groupBy("part").applyInArrow(run, REPLY)


def shared_names(arrays: list) -> tuple[list[int], list[np.ndarray]]:
    """Whether a name is in two blocks, or in two documents of one."""
    parts = [np.frombuffer(a, "<u8").reshape(2, -1) for a in arrays]
    sizes = [x.shape[1] for x in parts]
    names, several = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
    _, back, count = np.unique(names, return_inverse=True, return_counts=True)
    return sizes, [(count[back] > 1) | (several > 0)]


def smaller_elsewhere(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    order = np.lexsort((docs, keys))
    ranked = keys[order]
    group = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]])
    least = docs[order][np.r_[True, ranked[1:] != ranked[:-1]]]
    out = np.zeros(len(keys), bool)
    out[order] = least[group] < docs[order]
    return out


def settled_and_open(arrays: list) -> tuple[list[int], list[np.ndarray]]:
    """Whether a context is in a smaller document; whether half of it is in another context."""
    parts = [np.frombuffer(a, ENTRY) for a in arrays]
    rows = np.concatenate(parts)
    _, first, back = np.unique(rows["context"], return_index=True, return_inverse=True)
    distinct = rows[first]
    open_ = np.zeros(len(distinct), bool)
    for side in ("left", "right"):
        _, at, count = np.unique(distinct[side], return_inverse=True, return_counts=True)
        open_ |= count[at] > 1
    return [len(x) for x in parts], [smaller_elsewhere(rows["context"], rows["doc"]), open_[back]]


def seen_windows(arrays: list) -> tuple[list[int], list[np.ndarray]]:
    parts = [np.frombuffer(a, WINDOW) for a in arrays]
    rows = np.concatenate(parts)
    return [len(x) for x in parts], [smaller_elsewhere(rows["name"], rows["doc"])]


class Reader:
    """A block with the answers so far; computes what the next round asks."""

    def __init__(self, number: int, block: Block, replies: dict[int, dict[int, bytes]], parts: int):
        self.number, self.block, self.replies, self.parts = number, block, replies, parts
        self.segments = list(block.segments())

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct names of anchors, sorted, and whether two documents have them."""
        names = np.concatenate([s.name for s in self.segments])
        docs = np.concatenate([s.doc for s in self.segments])
        # Anchors come in the order of documents, which a stable sort keeps.
        order = np.argsort(names, kind="stable")
        names, docs = names[order], docs[order]
        first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else order
        last = np.r_[first[1:], len(names)] - 1 if len(names) else order
        return names[first], (docs[first] != docs[last])

    def ask_anchors(self) -> pa.Table:
        names, several = self.anchors()
        part = (names % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        found, at = np.unique(part[order], return_index=True)
        pieces = np.split(order, at[1:]) if len(found) else []
        return pa.table(
            {
                "part": pa.array(found, pa.int64()),
                "block": pa.array([self.number] * len(found), pa.int64()),
                "names": pa.array(
                    [np.concatenate([names[x], several[x].astype(np.uint64)]).tobytes() for x in pieces], pa.binary()
                ),
            }
        )

    def shared(self) -> None:
        """Keep, per segment, the anchors that are in several documents, and their contexts."""
        names, _ = self.anchors()
        (keep,) = unpacked(names, self.parts, self.replies.get(0, {}), 1)
        self.own, self.entries_of = [], []
        for segment in self.segments:
            own = np.flatnonzero(keep[np.searchsorted(names, segment.name)]) if len(names) else np.zeros(0, np.int64)
            row = np.zeros(len(own), ENTRY)
            row["context"], row["left"], row["right"] = segment.longer(own)
            row["doc"] = self.block.ids[segment.doc[own]]
            self.own.append(own)
            self.entries_of.append(row)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct contexts of the shared anchors with their first document, and anchor names."""
        self.shared()
        rows = np.concatenate(self.entries_of)
        keys = np.concatenate([s.name[own] for s, own in zip(self.segments, self.own)])
        order = np.lexsort((rows["doc"], rows["context"]))
        rows, keys = rows[order], keys[order]
        first = np.r_[True, rows["context"][1:] != rows["context"][:-1]][: len(rows)]
        return rows[first], keys[first]

    def ask_contexts(self) -> pa.Table:
        rows, keys = self.entries()
        return packed(self.number, keys, rows, self.parts)

    def judge(self) -> None:
        """Keep, per segment, the settled anchors and the windows that must be compared."""
        rows, keys = self.entries()
        smaller, open_ = unpacked(keys, self.parts, self.replies.get(1, {}), 2)
        contexts, first = np.ascontiguousarray(rows["context"]), np.ascontiguousarray(rows["doc"])
        self.settled, self.starts, self.windows_of = [], [], []
        for segment, own, entry in zip(self.segments, self.own, self.entries_of):
            at = np.searchsorted(contexts, entry["context"])
            settled = smaller[at] | (first[at] < entry["doc"]) if len(own) else np.zeros(0, bool)
            edges = own[~settled & open_[at]] if len(own) else own
            starts, docs = self.spread(segment, edges)
            row = np.zeros(len(starts), WINDOW)
            row["name"], row["doc"] = segment.windows(starts), docs
            self.settled.append(own[settled])
            self.starts.append(starts)
            self.windows_of.append(row)

    def spread(self, segment: Segment, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of some anchors, and their documents' ids."""
        counts = segment.last[own] - segment.first[own] + 1
        ends = np.cumsum(counts)
        starts = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(segment.first[own], counts)
        return starts, np.repeat(self.block.ids[segment.doc[own]], counts)

    def compared(self) -> np.ndarray:
        """Distinct windows to compare, with their first document in the block."""
        self.judge()
        rows = np.concatenate(self.windows_of)
        rows = rows[np.lexsort((rows["doc"], rows["name"]))]
        return rows[np.r_[True, rows["name"][1:] != rows["name"][:-1]][: len(rows)]]

    def ask_windows(self) -> pa.Table:
        rows = self.compared()
        return packed(self.number, rows["name"], rows, self.parts)

    def result(self) -> pa.Table:
        """Removed spans of each document of the block."""
        block = self.block
        rows = self.compared()
        (smaller,) = unpacked(rows["name"], self.parts, self.replies.get(2, {}), 1)
        edge = np.zeros(len(block.codes) + 1, np.int32)
        names, first = np.ascontiguousarray(rows["name"]), np.ascontiguousarray(rows["doc"])
        for segment, settled, starts, own in zip(self.segments, self.settled, self.starts, self.windows_of):
            np.add.at(edge, segment.first[settled], 1)
            np.add.at(edge, segment.last[settled] + LENGTH, -1)
            at = np.searchsorted(names, own["name"])
            gone = starts[smaller[at] | (first[at] < own["doc"])] if len(rows) else starts
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + LENGTH, -1)
        removed = np.cumsum(edge[:-1]) > 0
        out = {name: [] for name in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        ends = np.cumsum(block.sizes)
        for doc, start, size, end in zip(block.ids.tolist(), block.starts, block.sizes, ends):
            mask = removed[start : start + size]
            turns = np.flatnonzero(np.diff(np.r_[False, mask, False].view(np.int8)))
            raw = block.text[end - size : end]
            kept = np.frombuffer(raw, np.uint8)[~mask].tobytes() if len(turns) else raw
            spans = turns.reshape(-1, 2)
            for column, value in zip(
                out.values(),
                (
                    None if doc == NO_ID else doc,
                    int(size),
                    int(size) - len(kept),
                    len(spans),
                    hashlib.sha256(kept).hexdigest(),
                    [{"start": int(a), "end": int(b)} for a, b in spans],
                ),
            ):
                column.append(value)
        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({name: pa.array(values, kinds.get(name, span)) for name, values in out.items()})


def asked(source: DataFrame, replies: DataFrame | None, parts: int, question: str, schema: str) -> DataFrame:
    """``question`` of every block, joined with the answers it has so far."""

    def run(_, own: pa.Table, answers: pa.Table) -> pa.Table:
        by_round: dict[int, dict[int, bytes]] = {}
        for row in answers.to_pylist():
            by_round.setdefault(row["round"], {})[row["part"]] = row["bits"]
        row = own.to_pylist()[0]
        return getattr(Reader(row["block"], Block(row["ids"], row["sizes"], row["text"]), by_round, parts), question)()

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                reader = Reader(row["block"], Block(row["ids"], row["sizes"], row["text"]), {}, parts)
                yield from getattr(reader, question)().to_batches()

    if replies is None:
        return source.mapInArrow(alone, schema)
    return source.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the removed spans and a digest of what is left."""
    source = staged(blocks(docs, id_col, text_col), "suffix-blocks")
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # Text is stored at about two fifths of its size.
    parts = max(1, -(-int(2.5 * size) // PART_BYTES))
    replies = None
    rounds = (("ask_anchors", shared_names), ("ask_contexts", settled_and_open), ("ask_windows", seen_windows))
    for number, (question, decide) in enumerate(rounds):
        found = staged(answered(asked(source, replies, parts, question, NAMES), number, decide), f"suffix-round{number}")
        replies = found if replies is None else replies.unionByName(found)
    schema = (
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<start: bigint, end: bigint>>"
    )
    return asked(source, replies, parts, "result", schema)
