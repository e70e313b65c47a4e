"""Phrase collocations against counting in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from fleetlens.llm import automata, collocations
from fleetlens.llm.common import staged

SCHEMA = "doc_id long, text string, lang string, words string, n long, part string, kind string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=None):
    counts, totals = {}, Counter()
    for lang, text in rows:
        own = counts.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang if lang is not None else "und"] += len(words)
            for size in range(1, 6):
                own.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = set()
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for phrase, a in found.items():
            longer = (q for q in found if len(q) > len(phrase) and found[q] >= a)
            if any(q[i : i + len(phrase)] == phrase for q in longer for i in range(len(q) - len(phrase) + 1)):
                continue
            cuts = [(1000 * a * totals[lang] // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def frame(spark, rows):
    full = [(i % 5, text, lang, "x", 7, "y", "shard") for i, (lang, text) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def random_rows(seed, count, kinds=6):
    rng = random.Random(seed)
    words = ["The", "cat", "é", "日本", "of x", "\x01", "a-b", "A"][:kinds]
    marks = [" ", "  ", "\t", ". ", "\n", ",", " ", " "]
    return [
        (rng.choice(["en", None, "und", "a b", ""]), "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(60))))
        for _ in range(count)
    ]


AWKWARD = [("en", None), ("en", ""), (None, " .,;\n\t "), ("en", "one"), ("en", "the cat the cat " * 300), ("en", "x y z " * 40)] + [
    ("de", "alles ist gut heute Abend. ")
] * 30


def found_in(df, least, **more):
    return {tuple(r) for r in collocations.mine(df, least=least, **more).collect()}


def test_against_counting(spark):
    rows = random_rows(1, 200) + AWKWARD
    assert found_in(frame(spark, rows), 12) == brute(rows, 12, 2000)


def test_small_shards_and_ranges_lose_nothing(spark, monkeypatch):
    rows = random_rows(2, 120) + AWKWARD
    # Shards are cut within texts and pieces, n-grams of one word lie in several ranges.
    monkeypatch.setattr(collocations, "SHARD_WORDS", 90)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 40)
    monkeypatch.setattr(collocations, "MOST_KEYS", 50)
    assert found_in(frame(spark, rows), 10, range_words=150, top=None) == brute(rows, 10)


def test_first_of_each_language(spark):
    rows = random_rows(3, 150, kinds=8)
    assert found_in(frame(spark, rows), 3, top=5) == brute(rows, 3, 5)


def test_full_bitmap_tells_less_but_never_wrong(spark, monkeypatch):
    rows = random_rows(4, 80)
    everything = collocations.Marked(b"\xff" * 4096)
    monkeypatch.setattr(collocations, "frequent", lambda *_: everything)
    assert found_in(frame(spark, rows), 5) == brute(rows, 5, 2000)


def test_one_text_of_a_million_words_without_breaks(spark):
    text = "alpha beta " * 500_000 + "gamma"
    df = spark.createDataFrame([(text, None)], "text string, lang string")
    rows = {r.phrase: (r.a, r.l, r.r, r.n) for r in collocations.mine(df, least=100).collect()}
    assert rows["alpha beta"] == (500_000, 500_000, 500_000, 1_000_001)
    # Of the others only those remain that no longer phrase holds as often.
    assert rows["alpha beta alpha beta"][0] == 499_999 and "beta alpha" not in rows
    assert not any("gamma" in phrase for phrase in rows)


def test_empty_table(spark):
    assert collocations.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.mine(frame(spark, [("en", None), (None, "")])).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_automata(seed):
    rng = random.Random(seed)
    labels = [b"a", b"ab", b"b", "é".encode(), b"\x00", b"z"]

    def pairs():
        keys = {tuple(rng.choice(labels) for _ in range(rng.randrange(0, 5))) for _ in range(rng.randrange(1, 200))}
        return {key: rng.randrange(0, 10**rng.randrange(1, 12)) for key in keys}

    tables = [pairs() for _ in range(4)]
    machines = [automata.build(sorted(t.items())) for t in tables]
    assert [dict(automata.items(m)) for m in machines] == tables
    assert list(automata.items(machines[0])) == sorted(tables[0].items())
    kept = automata.as_columns(machines)
    again = [automata.from_row({name: column[i] for name, column in kept.items()}) for i in range(4)]
    total = Counter()
    for table in tables:
        total.update(table)
    whole = automata.union(again)
    assert dict(automata.items(whole)) == dict(total) | {k: 0 for t in tables for k in t if k not in total}
    asked = {k for k in total if rng.random() < 0.3} | {(b"not", b"there"), (b"a", b"a", b"a", b"a", b"a", b"a")}
    found = dict(automata.compose(automata.acceptor(sorted(asked)), whole))
    assert found == {k: total[k] for k in asked if k in total}


def test_equal_remainders_are_one_state():
    words = [b"a", b"b", b"c"]
    machine = automata.build([((x, y, z), 5) for x in words for y in words for z in words])
    assert len(machine.final) == 4


def test_automata_get_frequent_phrases_alone(spark):
    rng = random.Random(5)
    # Triples of these words are frequent, most longer phrases are not.
    rows = [("en", " ".join(rng.choice("abcde") for _ in range(40))) for _ in range(400)] + [("en", "a b c d e")] * 30
    parts = staged(collocations.shards(frame(spark, rows), "lang", "text"), "test-shards")
    marks, words = [], sum(r.n for r in parts.select("n").collect())
    for _ in range(collocations.MARKED_SIZES):
        marks.append(collocations.frequent(parts, 30, marks, words))
    want = Counter()
    for _, text in rows:
        own = text.split()
        for size in range(1, 6):
            want.update(tuple(own[i : i + size]) for i in range(len(own) - size + 1))
    got = Counter()
    for row in collocations.shard_automata(parts, marks, []).collect():
        got.update({tuple(w.decode() for w in k[1:]): n for k, n in automata.items(automata.from_row(row.asDict()))})
    assert any(len(k) > 3 for k, n in want.items() if n >= 30)
    assert {k: n for k, n in want.items() if n >= 30}.items() <= got.items() <= want.items()
    # Hashes in a bitmap may be shared, hardly more.
    rare = sum(n < 30 for n in want.values())
    assert sum(n < 30 for n in got.values()) < 0.2 * rare


def test_an_automaton_takes_few_bytes():
    rng = random.Random(6)
    keys = sorted({tuple(str(rng.randrange(300)).encode() for _ in range(rng.randrange(1, 5))) for _ in range(5000)})
    machine = automata.build((key, rng.randrange(100, 500)) for key in keys)
    (row,) = ({name: column[0] for name, column in automata.as_columns([machine]).items()},)
    assert dict(automata.items(automata.from_row(row))) == dict(automata.items(machine))
    assert sum(map(len, row.values())) < 10 * len(keys)


def test_hash_counts_are_packed_by_bucket(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 20_000, 3000)) for _ in range(40)]
    docs = spark.createDataFrame([("en", text) for text in texts], "lang string, text string")
    parts = staged(collocations.shards(docs, "lang", "text"), "test-shards")
    want = Counter()
    for row in parts.collect():
        ids = np.frombuffer(row.ids, "<i4")[: row.owned]
        want.update(np.frombuffer(row.hashes, np.uint32)[ids[ids != 0]].tolist())
    rows = collocations.hash_counts(parts, [], 3).collect()
    got = Counter()
    for row in rows:
        keys, counts = collocations.unpacked(row.counts, row.size, row.bucket << 29)
        assert (keys >> 29 == row.bucket).all()
        got.update(dict(zip(keys.tolist(), counts.tolist())))
    assert got == want and len({row.bucket for row in rows}) == 8
    # A hash and its count take a few bytes of the shuffle, not a row.
    assert sum(len(row.counts) for row in rows) < 5 * sum(row.size for row in rows)
    often = {h for h, n in want.items() if n >= 8}
    monkeypatch.setattr(collocations, "BUCKET_WORDS", 1000)
    marked = collocations.frequent(parts, 8, [], 120_000)
    assert marked.holds(np.array(sorted(often), np.uint64) << np.uint64(32)).all()
    others = np.array(sorted(set(want) - often), np.uint64) << np.uint64(32)
    assert marked.holds(others).mean() < 0.2
