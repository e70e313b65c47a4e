"""Packing by least squares: an exact round trip of ids, and what padding is left."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import tokenizers
from helpers import plan_of
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm import nnls_packing
from fleetlens.llm.packing import tokenizer_path
from fleetlens.llm.queries import QUERIES

PATH = tokenizer_path(nnls_packing.TOKENIZER)
SCHEMA = "doc_id long, text string, ids string, length string, part long, place string, first string"
TOKENIZER = tokenizers.Tokenizer.from_file(PATH)


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


ROWS = [
    (1, "The cat sat on the mat."),
    (2, None),
    (3, ""),
    (4, "  \n\n\t x " * 700),
    (5, "é ü ß 日本語 😀 ́ can't we'll <|endoftext|> <|endof"),
    (6, "word " * 5000),
    (6, "word " * 5000),
    (7, "a" * 20_000 + " " * 20_000 + "7" * 5000),
    (None, "a row without an id"),
    (None, None),
]


def rebuilt(packed, rows):
    """Checks every document's pieces and every sequence's places; gives the sequences' sizes."""
    pieces, places = defaultdict(list), defaultdict(list)
    for r in packed:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert len(ids) == r.length > 0
        pieces[r.doc_id, r.doc_tokens].append((r.start, ids))
        places[r.sequence_id].append((r.offset, r.length))
    want = Counter((doc, tuple(ids_of(text))) for doc, text in rows)
    for (doc, tokens), own in pieces.items():
        copies = sum(n for (d, ids), n in want.items() if d == doc and len(ids) == tokens)
        assert copies
        for (d, ids), n in want.items():
            if d == doc and len(ids) == tokens:
                # Copies of a document may be cut apart in different places.
                covered = Counter()
                for start, part in own:
                    assert list(ids[start : start + len(part)]) == part
                    covered.update(range(start, start + len(part)))
                assert covered == Counter({i: copies for i in range(tokens)})
    assert {(d, len(i)) for d, i in want} == set(pieces)
    sizes = []
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= nnls_packing.WINDOW
        sizes.append(at)
    return sizes


def padding(sizes):
    return sum(nnls_packing.WINDOW - s for s in sizes if s & (s - 1))


def test_round_trip(spark):
    rng = random.Random(1)
    rows = ROWS + [(100 + i, "some words of it " * rng.randrange(400)) for i in range(150)]
    df = spark.createDataFrame([(*r, "x", "y", 3, "z", "w") for r in rows], SCHEMA).repartition(3)
    packed = nnls_packing.pack(df)
    sizes = rebuilt(packed.collect(), rows)
    total = nnls_packing.padding(packed).first()
    assert (total.sequences, total.tokens, total.padding) == (len(sizes), sum(sizes), padding(sizes))
    assert padding(sizes) == 0 and len(sizes) <= -(-sum(sizes) // nnls_packing.WINDOW) + 10


def test_ids_do_not_go_through_python_for_their_places(spark):
    df = spark.createDataFrame([(1, "some words of it " * 400), (2, "more")], "doc_id long, text string")
    plan = plan_of(nnls_packing.pack(df))
    # The function gets two numbers a piece; a function over whole rows would get the ids as well.
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan


def test_query_on_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = QUERIES["op12_nnls_packing"](spark, sf_dir).collect()
    docs = {r.doc_id: ids_of(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ends, places = Counter(), defaultdict(int)
    for r in got:
        part = docs[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(docs[r.doc_id])
        ends[r.doc_id] += r.length
        places[r.sequence_id] += r.length
    assert ends == Counter({doc: len(ids) for doc, ids in docs.items()})
    assert padding(places.values()) == 0


def test_empty_table(spark):
    assert nnls_packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_both_libraries_give_equal_ids(text):
    (got,) = nnls_packing.encoder(PATH)([text])
    assert [*np.frombuffer(got, "<u4"), 0] == ids_of(text)


def test_every_character_gives_equal_ids():
    for first in range(0, 0x11000, 64):
        own = [chr(c) for c in range(first, first + 64) if not 0xD800 <= c < 0xE000]
        text = "".join(f"{c}{c} a{c}1{c} " for c in own)
        (got,) = nnls_packing.encoder(PATH)([text])
        assert [*np.frombuffer(got, "<u4"), 0] == ids_of(text), hex(first)


def planned(histogram, window):
    runs = nnls_packing.plan(dict(histogram), window, steps=60)
    table, sizes = nnls_packing.look_up_table(runs), Counter()
    for length, count in histogram.items():
        edges, spans = table[length]
        assert edges[0] == 0 and edges[-1] == count
        for own in spans[:-1]:
            # Parts of a piece follow each other and cover it.
            assert own[0, 3] == 0 and (own[1:, 3] == own[:-1, 3] + own[:-1, 4]).all()
            assert own[-1, 3] + own[-1, 4] == length
    filled = defaultdict(list)
    for _, _, count, _, tokens, sequence, offset in runs.tolist():
        for i in range(count):
            filled[sequence + i].append((offset, tokens))
    for own in filled.values():
        at = 0
        for offset, tokens in sorted(own):
            assert offset == at
            at += tokens
        assert at <= window
        sizes[at] += 1
    assert sum(s * n for s, n in sizes.items()) == sum(n * c for n, c in histogram.items())
    return sizes


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_plans_of_any_histogram(histogram):
    sizes = planned(histogram, 64)
    tokens = sum(n * c for n, c in histogram.items())
    assert all(size & (size - 1) == 0 for size in sizes)
    assert sum(sizes.values()) <= -(-tokens // 64) + 6


def test_plan_does_not_grow_with_the_corpus():
    rng = np.random.default_rng(2)
    lengths, counts = np.unique(np.clip(rng.lognormal(5, 1, 20_000).astype(int), 1, 1023), return_counts=True)
    runs = [len(nnls_packing.plan(dict(zip(lengths.tolist(), (counts * k).tolist())))) for k in (1, 1000)]
    assert runs[1] < 3 * runs[0]


@pytest.mark.parametrize("window", [8, 33])
def test_combinations(window):
    lengths = np.array([n for n in range(1, window) if n % 3 or n == 6])
    got = [tuple(int(x) for x in row if x) for row in nnls_packing.combinations(lengths, window)]
    own = lengths.tolist()
    want = {(a, b) for a in own for b in own if a >= b and a + b == window}
    want |= {(a, b, c) for a in own for b in own for c in own if a >= b >= c and a + b + c == window}
    assert len(got) == len(set(got)) and set(got) == want
