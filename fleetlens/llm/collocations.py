"""Phrase collocations per language, counted in weighted acyclic automata.

1. ``shards`` turns texts into numbered words, half a million a row, in one pass. Words are numbered
   in the order of their bytes within a row.
2. ``frequent`` counts the hashes of words by a group-by over each task's own counts, in order and
   packed by buckets of hashes, and marks those that occur ``least`` times in a bitmap; then those of pairs of frequent words, and so
   on up to the longest n-grams. A hash below that has no frequent n-gram. This only leaves work
   out, as every part of a frequent phrase is frequent; what a hash or a bit shares with others is
   counted and dropped later.
3. The remaining n-grams of a task's shards are sorted and built into automata that map an n-gram to
   its count, one for each range of n-grams (``automata.build``).
4. The automata of a range are united, weights added (``automata.union``). Ranges are cut
   between n-grams of up to three words, so a frequent first word has several.
5. Candidates are read off. The counts of their parts, which lie in other ranges, are found by
   composing an automaton of the wanted parts with the range's counts (``automata.compose``).

Memory of a task depends on ``SHARD_WORDS``, on the bitmap, which has at most ``MOST_BITS`` bits,
and on the bounds of the ranges, whose number grows with the number of words.

Edge cases: a null text is empty; a null language is ``und``; rows that repeat an id or a
text count each; texts without words and an empty table give no rows; ids and other columns
are not read. A word may be as long as a text.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from fleetlens.llm import automata
from fleetlens.llm.common import as_array, few_rows_at_once, staged

LONGEST = 5
LEAST = 100
TOP = 2000
UNKNOWN = "und"

# Words of a shard; with those of a slice they have numbers of 21 bits.
SHARD_WORDS = 500_000
# Words of all languages that a task holds, in shards.
OPEN_SHARDS = 3
# Hashes that a task holds before it hands them on, and words a bucket of hashes is meant for.
HELD_HASHES, BUCKET_WORDS = 2_000_000, 2_000_000
# N-grams that a task counts before it builds automata of them.
MOST_KEYS = 100_000
# Shards or automata that are handed to a task at once.
ROWS_AT_ONCE = 2
SLICE_BYTES = 1 << 20
# N-grams up to this size are marked, so that automata hold hardly any that are not frequent.
MARKED_SIZES = LONGEST
# Bits of a bitmap for each hash in it, and at most: beyond, it tells less, but never wrong.
BITS_EACH, MOST_BITS = 16, 1 << 30
# Bits of one row of Spark's bitmap functions.
BITMAP_ROW = 32768
# Words a range of n-grams is meant for.
RANGE_WORDS = 1_000_000
# N-grams of a shard that ranges are cut by, and how many of all shards at most.
MARKS, SAMPLE = 64, 65_536
# Parts of a language that are ranked first.
RANK_PARTS = 32

BREAK = b"\n"
NORMAL = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b".,;:!?\n\x0b\x0c\r" + b"\t", b"abcdefghijklmnopqrstuvwxyz" + BREAK * 10 + b" "
)

SHARD = "lang string, words array<binary>, hashes binary, ids binary, owned long, n long, marks array<binary>"
RANGE = "range int, " + automata.COLUMNS


class Numbers(dict):
    """Gives every new word the next number."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def slices(raw: bytes) -> Iterator[list[bytes]]:
    """Words and breaks of a text, some at a time; some of the words are empty."""
    text = raw.translate(NORMAL).replace(BREAK, b" \n ")
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].split(b" ")
        at = end + 1


def hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """Hash by word number, half of what is used; number 0 is the break."""
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.array([0, *(xxhash.xxh32_intdigest(w, seed) for w in words)], np.uint32)


def kept_hashes(raw: bytes) -> np.ndarray:
    """Word hashes of a shard, both halves alike."""
    half = np.frombuffer(raw, np.uint32).astype(np.uint64)
    return half << np.uint64(32) | half


def longer_hashes(grams: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of n-grams with one word more."""
    mixed = (grams * np.uint64(0x9E3779B97F4A7C15) + words) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ (mixed >> np.uint64(29))


def short(h: np.ndarray) -> np.ndarray:
    """The half of a hash that is counted by."""
    return h >> np.uint64(32)


class Marked(NamedTuple):
    """A set of hashes as a bitmap whose size is a power of two; it may hold others too."""

    bits: bytes

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = short(h) & np.uint64(8 * len(self.bits) - 1)
        own = np.frombuffer(self.bits, np.uint8)[(at >> np.uint64(3)).astype(np.int64)]
        return (own >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def sorted_shard(numbers: Numbers, held: array) -> tuple[list[bytes], np.ndarray]:
    """Words in the order of their bytes, numbered from 1, and the text by these numbers (0: break)."""
    words = sorted(w for w in numbers if w and w != BREAK)
    into = np.zeros(len(numbers), np.int32)
    into[[numbers[w] for w in words]] = np.arange(1, len(words) + 1)
    ids = np.frombuffer(held, np.int32)
    ids = into[ids[ids != numbers[b""]]]
    keep = np.ones(len(ids), bool)
    keep[1:] = (ids[1:] != 0) | (ids[:-1] != 0)
    return words, ids[keep]


def following(values: np.ndarray, starts: int, distance: int) -> np.ndarray:
    """The value ``distance`` after each of the first ``starts`` ones; 0 beyond the end."""
    out = np.zeros(starts, values.dtype)
    found = values[distance : distance + starts]
    out[: len(found)] = found
    return out


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time, as each may hold millions of words."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def marks_of(words: list[bytes], ids: np.ndarray) -> list[bytes]:
    """N-grams of up to three words at even distances."""
    out = []
    for at in np.linspace(0, len(ids), MARKS, endpoint=False).astype(int):
        gram = ids[at : at + 3].tolist()
        gram = gram[: gram.index(0)] if 0 in gram else gram
        if gram:
            out.append(b" ".join(words[i - 1] for i in gram))
    return out


def shards(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """Rows of numbered words.

    A shard counts the n-grams that start in its first ``owned`` numbers. Where a shard is full
    within a text, the few numbers after these open the next shard of the language too.
    """
    target = StructType.fromDDL(SHARD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        held: dict[str, tuple[Numbers, array]] = {}

        def start(words: list[bytes]) -> tuple[Numbers, array]:
            numbers = Numbers({b"": 0, BREAK: 1})
            return numbers, array("i", map(numbers.__getitem__, words))

        def flush(langs: list[str], lookahead: int) -> Iterator[pa.RecordBatch]:
            for lang in langs:
                numbers, text = held[lang]
                words, ids = sorted_shard(numbers, text)
                owned = max(len(ids) - lookahead, 0)
                held[lang] = start([words[i - 1] if i else BREAK for i in ids[owned:].tolist()])
                n = int(np.count_nonzero(ids[:owned]))
                if n:
                    h, raw = hashes(lang, words).tobytes(), ids.astype("<i4").tobytes()
                    values = [lang, words, h, raw, owned, n, marks_of(words, ids)]
                    arrays = [as_array([v], f.type) for v, f in zip(values, arrow)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

        total = 0
        for batch in batches:
            for lang, value in zip(batch.column("lang").to_pylist(), batch.column("text")):
                raw = value.as_buffer()
                for tokens in slices(raw.to_pybytes() if raw is not None else b""):
                    if lang not in held:
                        held[lang] = start([])
                    numbers, text = held[lang]
                    text.extend(map(numbers.__getitem__, tokens))
                    total += len(tokens)
                    if total >= OPEN_SHARDS * SHARD_WORDS:
                        yield from flush(list(held), LONGEST - 1)
                        total = 0
                    elif len(text) >= SHARD_WORDS:
                        yield from flush([lang], LONGEST - 1)
                        total -= len(text)
                if lang in held:
                    held[lang][1].append(1)
        yield from flush(list(held), 0)

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang")
    return docs.select(lang, F.col(text_col).cast("string").alias("text")).mapInArrow(run, target)


def open_grams(h: np.ndarray, ids: np.ndarray, marks: list[Marked]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Starts and hashes of the n-grams of each size that may be frequent, one size more than is marked if there is one."""
    at = np.flatnonzero(ids)
    sizes = [(at, h[ids[at]])]
    for size, marked in enumerate(marks, 1):
        at, g = sizes[-1]
        keep = marked.holds(g)
        at, g = at[keep], g[keep]
        sizes[-1] = at, g
        if size == LONGEST:
            break
        # Both the n-gram at a start and the one at the next start.
        both = np.flatnonzero(np.diff(at) == 1)
        sizes.append((at[both], longer_hashes(g[both], h[ids[at[both] + size]])))
    return sizes


def summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order with the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts[order], heads) if len(heads) else counts


def packed(keys: np.ndarray, counts: np.ndarray, first: int) -> bytes:
    """Steps between hashes in order, the first from ``first``, and counts, by place of their bytes."""
    steps = np.diff(keys.astype("<i8"), prepend=first).astype("<u4")
    planes = [x.view(np.uint8).reshape(len(keys), -1).T.tobytes() for x in (steps, counts.astype("<i8"))]
    return pa.compress(b"".join(planes), "zstd", asbytes=True)


def unpacked(raw: bytes, size: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(raw, 12 * size, "zstd", asbytes=True), np.uint8).reshape(12, size)
    steps, counts = (np.ascontiguousarray(x.T).view(kind).ravel() for x, kind in ((planes[:4], "<u4"), (planes[4:], "<i8")))
    return (np.cumsum(steps, dtype=np.int64) + first).astype(np.uint32), counts


def hash_counts(parts: DataFrame, marks: list[Marked], bits: int) -> DataFrame:
    """Hashes and counts of each task's n-grams, of the size after those that are marked.

    A row has those of one bucket, which is the first ``bits`` bits of a hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1 << bits, dtype=np.int64) << (32 - bits)

        def flush(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            keys, counts = summed(found)
            cuts = np.append(np.searchsorted(keys, edges), len(keys))
            full = np.flatnonzero(np.diff(cuts)).tolist()
            for some in (full[i : i + 1000] for i in range(0, len(full), 1000)):
                rows = [packed(keys[cuts[i] : cuts[i + 1]], counts[cuts[i] : cuts[i + 1]], int(edges[i])) for i in some]
                sizes = pa.array([int(cuts[i + 1] - cuts[i]) for i in some], pa.int32())
                arrays = [pa.array(some, pa.int32()), sizes, pa.array(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "size", "counts"])

        found, total = [], 0
        for row in rows_of(batches):
            at, g = open_grams(kept_hashes(row["hashes"]), np.frombuffer(row["ids"], "<i4"), marks)[-1]
            found.append(np.unique(short(g[at < row["owned"]]).astype(np.uint32), return_counts=True))
            total += len(found[-1][0])
            if total >= HELD_HASHES:
                yield from flush(found)
                found, total = [], 0
        if found:
            yield from flush(found)

    return parts.select("hashes", "ids", "owned").mapInArrow(run, "bucket int, size int, counts binary")


def frequent(parts: DataFrame, least: int, marks: list[Marked], words: int) -> Marked:
    """Hashes of the n-grams, of the size after those that are marked, that occur ``least`` times."""
    bits = max(-(-words // BUCKET_WORDS) - 1, 0).bit_length()

    def often_of(key: tuple, rows: pa.Table) -> pa.Table:
        first = key[0].as_py() << (32 - bits)
        keys, counts = summed([unpacked(r["counts"], r["size"], first) for r in rows.to_pylist()])
        return pa.table({"h": pa.array(keys[counts >= least].view(np.int32))})

    with few_rows_at_once(parts.sparkSession, ROWS_AT_ONCE):
        found = hash_counts(parts, marks, bits).groupBy("bucket").applyInArrow(often_of, "h int")
        often = staged(found, "collocations-frequent")
    size = BITMAP_ROW
    while size < min(BITS_EACH * often.count(), MOST_BITS):
        size *= 2
    place = F.col("h").cast("long").bitwiseAND(size - 1)
    row, bit = F.floor(place / BITMAP_ROW).cast("int"), place.bitwiseAND(BITMAP_ROW - 1)
    # At most ``MOST_BITS`` bits reach the driver and go to the tasks.
    rows = often.groupBy(row.alias("row")).agg(F.bitmap_construct_agg(bit).alias("bits")).collect()
    whole = bytearray(size // 8)
    for number, bits in rows:
        whole[number * BITMAP_ROW // 8 : (number + 1) * BITMAP_ROW // 8] = bits
    return Marked(bytes(whole))


def grams(row: dict, marks: list[Marked]) -> Iterator[tuple[automata.Key, int]]:
    """Distinct n-grams of a shard's words, the language in front, with their counts.

    What has a part that is not frequent is left out.
    """
    words, owned = row["words"], row["owned"]
    h, ids = kept_hashes(row["hashes"]), np.frombuffer(row["ids"], "<i4")
    # How long the n-grams go on from each start: an n-gram that is open has open beginnings.
    reach = np.zeros(len(ids), np.int8)
    for size, (at, _) in enumerate(open_grams(h, ids, marks), 1):
        reach[at] = size
    for size in range(len(marks) + 2, LONGEST + 1):
        at = np.flatnonzero((reach[:-1] == size - 1) & (reach[1:] >= size - 1))
        reach[at] = size
    starts = np.flatnonzero(reach[:owned] > 1)
    window = [np.where(reach[starts] > j, ids[np.minimum(starts + j, len(ids) - 1)], 0) for j in range(LONGEST)]
    # A word alone is a row of its own, before the windows it starts.
    usable = marks[0].holds(h)
    usable[0] = False
    single = np.flatnonzero(usable).astype(ids.dtype)
    alone = [single, *[np.zeros_like(single)] * (LONGEST - 1)]
    table = [np.concatenate([column, more]).astype(np.uint64) for column, more in zip(window, alone)]
    wide, wider = np.uint64(21), np.uint64(42)
    order = np.lexsort(((table[3] << wide) | table[4], (table[0] << wider) | (table[1] << wide) | table[2]))
    table = [column[order].astype(np.int32) for column in table]
    singles = np.bincount(ids[:owned], minlength=len(words) + 1)
    changed, found = np.zeros(len(order), bool), []
    changed[:1] = True
    for size, column in enumerate(table, 1):
        changed[1:] |= column[1:] != column[:-1]
        heads = np.flatnonzero(changed)
        counts = np.diff(np.append(heads, len(order)))
        real = column[heads] != 0
        heads, counts = heads[real], counts[real]
        found.append((heads, np.full(len(heads), size), singles[column[heads]] if size == 1 else counts))
    heads, sizes, counts = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((sizes, heads))
    first, named = row["lang"].encode(), [b"", *words]
    rows = np.stack(table, axis=1)
    for lines in np.array_split(order, max(1, len(order) // 10_000)):
        for gram, size, count in zip(rows[heads[lines]].tolist(), sizes[lines].tolist(), counts[lines].tolist()):
            if count:
                yield (first, *[named[i] for i in gram[:size]]), count


def bounds_of(parts: DataFrame, ranges: int) -> list[automata.Key]:
    """Keys that cut all n-grams into about ``ranges`` ranges, by a bounded sample."""
    marks = parts.select("lang", F.explode("marks").alias("mark"))
    some = marks.orderBy(F.xxhash64("mark", "lang"), "mark", "lang").limit(SAMPLE).collect()
    keys = sorted((r.lang.encode(), *bytes(r.mark).split(b" ")) for r in some)
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)} if keys else ())


def range_batch(place: int, machine: automata.Automaton) -> pa.RecordBatch:
    columns = automata.as_columns([machine])
    arrays = [pa.array([place], pa.int32()), *[pa.array(v, pa.binary()) for v in columns.values()]]
    return pa.RecordBatch.from_arrays(arrays, names=["range", *columns])


def shard_automata(parts: DataFrame, marks: list[Marked], bounds: list[automata.Key]) -> DataFrame:
    """Automata of n-gram counts, for each range, of the shards of a task."""

    def by_range(counts: dict[automata.Key, int]) -> Iterator[pa.RecordBatch]:
        place, held = 0, []
        for pair in sorted(counts.items()):
            if place < len(bounds) and pair[0] >= bounds[place]:
                if held:
                    yield range_batch(place, automata.build(held))
                place, held = bisect_right(bounds, pair[0]), []
            held.append(pair)
        if held:
            yield range_batch(place, automata.build(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[automata.Key, int] = {}
        for row in rows_of(batches):
            for key, count in grams(row, marks):
                counts[key] = counts.get(key, 0) + count
                if len(counts) >= MOST_KEYS:
                    yield from by_range(counts)
                    counts = {}
        yield from by_range(counts)

    own = parts.select("lang", "words", "hashes", "ids", "owned")
    return own.mapInArrow(run, RANGE)


def united(machines: DataFrame) -> DataFrame:
    """One automaton for each range: weights of equal n-grams are added."""

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        whole = automata.union([automata.from_row(row) for row in rows.to_pylist()])
        return pa.Table.from_batches([range_batch(key[0].as_py(), whole)])

    return machines.groupBy("range").applyInArrow(one, RANGE)


def candidates(ranges: DataFrame, least: int) -> DataFrame:
    """Frequent phrases of two words or more: ``lang``, ``words``, ``a``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            pairs = automata.items(automata.from_row(row))
            found = [(key, count) for key, count in pairs if count >= least and len(key) > 2]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key[0].decode() for key, _ in found], pa.string()),
                    pa.array([[w.decode() for w in key[1:]] for key, _ in found], pa.list_(pa.string())),
                    pa.array([count for _, count in found], pa.int64()),
                ],
                names=["lang", "words", "a"],
            )

    return ranges.mapInArrow(run, "lang string, words array<string>, a long")


def part_counts(wanted: DataFrame, ranges: DataFrame, bounds: list[automata.Key]) -> DataFrame:
    """Counts of the distinct phrases ``lang``, ``part`` by composing them with their range."""

    def key_of(lang: str, part: str) -> automata.Key:
        return (lang.encode(), *part.encode().split(b" "))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts = batch.column("lang"), batch.column("part")
            at = [bisect_right(bounds, key_of(*pair)) for pair in zip(langs.to_pylist(), parts.to_pylist())]
            yield pa.RecordBatch.from_arrays([langs, parts, pa.array(at, pa.int32())], names=["lang", "part", "range"])

    def look_up(_, asked: pa.Table, machine: pa.Table) -> pa.Table:
        found: list[tuple[automata.Key, int]] = []
        if asked.num_rows and machine.num_rows:
            keys = sorted(map(key_of, asked.column("lang").to_pylist(), asked.column("part").to_pylist()))
            found = list(automata.compose(automata.acceptor(keys), automata.from_row(machine.to_pylist()[0])))
        return pa.table(
            {
                "lang": pa.array([key[0].decode() for key, _ in found], pa.string()),
                "part": pa.array([b" ".join(key[1:]).decode() for key, _ in found], pa.string()),
                "f": pa.array([count for _, count in found], pa.int64()),
            }
        )

    asked = wanted.select("lang", "part").distinct().mapInArrow(place, "lang string, part string, range int")
    sides = asked.groupBy("range").cogroup(ranges.groupBy("range"))
    return sides.applyInArrow(look_up, "lang string, part string, f long")


def scored(found: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates with their lowest-scoring cut; arithmetic in decimals of 38 digits."""
    cut = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    cuts = found.select("lang", "words", "a", cut).select(
        "lang",
        F.array_join("words", " ").alias("phrase"),
        "a",
        "k",
        F.array_join(F.expr("slice(words, 1, k)"), " ").alias("left"),
        F.array_join(F.expr("slice(words, k + 1, size(words))"), " ").alias("right"),
    )
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("part").alias(side), F.col("f").alias(name)), ["lang", side])
    big = "CAST({} AS DECIMAL(19, 0))"
    score = f"CAST((1000 * {big.format('a')} * {big.format('n')}) div ({big.format('l')} * {big.format('r')}) AS LONG)"
    least = F.min(F.struct(F.expr(score).alias("score"), "k", "l", "r")).alias("cut")
    lowest = cuts.join(totals, "lang").groupBy("lang", "phrase", "a", "n").agg(least)
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def whole_phrases(found: DataFrame) -> DataFrame:
    """``lang`` and ``phrase`` of the candidates that occur as often within one word more.

    If a much longer phrase occurs as often, so does each one between them.
    """
    inner = F.explode(
        F.array(F.expr("slice(words, 1, size(words) - 1)"), F.expr("slice(words, 2, size(words) - 1)"))
    ).alias("inner")
    longer = found.where(F.size("words") > 2).select("lang", inner, "a")
    most = longer.groupBy("lang", F.array_join("inner", " ").alias("phrase")).agg(F.max("a").alias("most"))
    own = found.select("lang", F.array_join("words", " ").alias("phrase"), "a")
    return own.join(most, ["lang", "phrase"]).where("most >= a").select("lang", "phrase")


def mine(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    least: int = LEAST,
    top: int | None = TOP,
    range_words: int = RANGE_WORDS,
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score``; all phrases without ``top``."""
    parts = staged(shards(docs, lang_col, text_col), "collocations-shards", "zstd")
    totals = staged(parts.groupBy("lang").agg(F.sum("n").alias("n")), "collocations-totals")
    words = totals.agg(F.sum("n")).first()[0] or 0
    bounds = bounds_of(parts, -(-words // range_words))
    marks: list[Marked] = []
    for _ in range(MARKED_SIZES):
        marks.append(frequent(parts, least, marks, words))
    machines = shard_automata(parts, marks, bounds)
    with few_rows_at_once(docs.sparkSession, ROWS_AT_ONCE):
        ranges = staged(united(machines), "collocations-ranges")
        found = staged(candidates(ranges, least), "collocations-candidates")
    pieces = F.explode(
        F.expr(
            "flatten(transform(sequence(1, size(words) - 1), k -> array(slice(words, 1, k), slice(words, k + 1, size(words)))))"
        )
    )
    wanted = found.select("lang", pieces.alias("piece")).select("lang", F.array_join("piece", " ").alias("part"))
    counts = staged(part_counts(wanted, ranges, bounds), "collocations-parts")
    kept = scored(found, counts, totals).join(whole_phrases(found), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    if top is not None:
        part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
        first = kept.withColumn("part", part)
        place = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
        kept = first.withColumn("place", place).where(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    ranked = kept.withColumn("rank", rank)
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
