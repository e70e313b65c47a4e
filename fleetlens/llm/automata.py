"""Acyclic automata with whole-number weights: build from sorted keys, union, compose.

A key is a tuple of labels (byte strings). An automaton maps each of its keys to a weight:
the sum of the outputs on the key's path and of its last state. Outputs are pushed towards
the start, so that states with equal remainders are one state.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa

Key = tuple[bytes, ...]


class Automaton(NamedTuple):
    """States in the order they were closed; the start is the last one.

    State ``s`` has the arcs ``first[s]`` up to ``first[s + 1]``, in the order of their labels,
    and the output ``final[s]`` if a key ends there (-1: none does).
    """

    words: list[bytes]
    first: np.ndarray
    label: np.ndarray
    target: np.ndarray
    out: np.ndarray
    final: np.ndarray


KINDS = {"first": "<i8", "label": "<i4", "target": "<i4", "out": "<i8", "final": "<i8"}
# Columns an automaton is kept in.
COLUMNS = ", ".join(f"{name} binary" for name in ("words", *KINDS))


def packed(values: np.ndarray, kind: str) -> bytes:
    """Numbers by place of their bytes, compressed; how many there are in front."""
    planes = values.astype(kind).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    size, width = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw[8:], size * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, size).T).view(kind).ravel()


def packed_words(words: list[bytes]) -> bytes:
    sizes, whole = packed(np.array([len(w) for w in words], np.int64), "<i8"), b"".join(words)
    head = b"".join(n.to_bytes(8, "little") for n in (len(sizes), len(whole)))
    return head + sizes + pa.compress(whole, "zstd", asbytes=True)


def unpacked_words(raw: bytes) -> list[bytes]:
    sizes_end, size = 16 + int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:16], "little")
    ends = np.cumsum(unpacked(raw[16:sizes_end], "<i8")).tolist()
    whole = pa.decompress(raw[sizes_end:], size, "zstd", asbytes=True)
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


def as_columns(machines: list[Automaton]) -> dict[str, list]:
    columns: dict[str, list] = {name: [] for name in ("words", *KINDS)}
    for m in machines:
        arcs = np.diff(m.first)
        # Arcs go back to states that were closed before: how far, which is mostly little.
        back = np.repeat(np.arange(len(arcs)), arcs) - m.target
        columns["words"].append(packed_words(m.words))
        for (name, kind), values in zip(KINDS.items(), (arcs, m.label, back, m.out, m.final)):
            columns[name].append(packed(values, kind))
    return columns


def from_row(row: dict) -> Automaton:
    arcs, label, back, out, final = (unpacked(row[name], kind) for name, kind in KINDS.items())
    target = np.repeat(np.arange(len(arcs), dtype=np.int32), arcs) - back
    return Automaton(unpacked_words(row["words"]), np.append(0, np.cumsum(arcs)), label, target, out, final)


class State:
    """A state that may still get arcs."""

    __slots__ = ("arcs", "final")

    def __init__(self) -> None:
        self.arcs: list[list] = []
        self.final = -1


def build(pairs: Iterable[tuple[Key, int]]) -> Automaton:
    """Automaton of (key, weight) pairs, keys strictly ascending.

    Of what has been read only the path of the last key is open. What the next key does not
    share is closed: a state equal to a closed one becomes that one.
    """
    closed: dict[tuple, int] = {}
    path, last = [State()], ()

    def close(state: State) -> int:
        return closed.setdefault((state.final, tuple(map(tuple, state.arcs))), len(closed))

    for key, weight in pairs:
        shared = 0
        for a, b in zip(key, last):
            if a != b:
                break
            shared += 1
        while len(path) > shared + 1:
            done = path.pop()
            path[-1].arcs[-1][1] = close(done)
        rest = weight
        for depth in range(shared):
            arc, after = path[depth].arcs[-1], path[depth + 1]
            common = min(arc[2], rest)
            if common < arc[2]:
                # What the arc no longer gives, the state after it gives on every way on.
                surplus, arc[2] = arc[2] - common, common
                for other in after.arcs:
                    other[2] += surplus
                if after.final >= 0:
                    after.final += surplus
            rest -= common
        for place in range(shared, len(key)):
            path[-1].arcs.append([key[place], -1, rest])
            rest = 0
            path.append(State())
        path[-1].final = rest
        last = key
    while len(path) > 1:
        done = path.pop()
        path[-1].arcs[-1][1] = close(done)
    # The start has a place of its own, after all others.
    states = [*closed, (path[0].final, tuple(map(tuple, path[0].arcs)))]
    words = sorted({arc[0] for _, arcs in states for arc in arcs})
    number = {word: i for i, word in enumerate(words)}
    arcs = [arc for _, own in states for arc in own]
    return Automaton(
        words,
        np.cumsum([0, *(len(own) for _, own in states)], dtype=np.int64),
        np.array([number[a[0]] for a in arcs], np.int32),
        np.array([a[1] for a in arcs], np.int32),
        np.array([a[2] for a in arcs], np.int64),
        np.array([final for final, _ in states], np.int64),
    )


def items(machine: Automaton) -> Iterator[tuple[Key, int]]:
    """All (key, weight) pairs, keys ascending."""
    words, first, final = machine.words, machine.first.tolist(), machine.final.tolist()
    arcs = list(zip([words[i] for i in machine.label.tolist()], machine.target.tolist(), machine.out.tolist()))
    open_: list[tuple[int, Key, int]] = [(len(final) - 1, (), 0)]
    while open_:
        state, key, weight = open_.pop()
        if final[state] >= 0:
            yield key, weight + final[state]
        for word, target, out in reversed(arcs[first[state] : first[state + 1]]):
            open_.append((target, (*key, word), weight + out))


def union(machines: list[Automaton]) -> Automaton:
    """Automaton of all keys; weights of equal keys are added."""
    merged = heapq.merge(*map(items, machines), key=itemgetter(0))
    return build((key, sum(w for _, w in same)) for key, same in groupby(merged, key=itemgetter(0)))


def acceptor(keys: Iterable[Key]) -> Automaton:
    """Automaton of keys, strictly ascending, without weights."""
    return build((key, 0) for key in keys)


def compose(wanted: Automaton, machine: Automaton) -> Iterator[tuple[Key, int]]:
    """Keys of both automata with their added weights: both are walked at once."""

    def moves(m: Automaton, state: int) -> dict[bytes, tuple[int, int]]:
        own = range(int(m.first[state]), int(m.first[state + 1]))
        return {m.words[m.label[i]]: (int(m.target[i]), int(m.out[i])) for i in own}

    known: dict[int, dict] = {}
    open_: list[tuple[int, int, Key, int]] = [(len(wanted.final) - 1, len(machine.final) - 1, (), 0)]
    while open_:
        a, b, key, weight = open_.pop()
        if wanted.final[a] >= 0 and machine.final[b] >= 0:
            yield key, weight + int(wanted.final[a]) + int(machine.final[b])
        if b not in known:
            known[b] = moves(machine, b)
        for word, (target, out) in moves(wanted, a).items():
            if word in known[b]:
                own, more = known[b][word]
                open_.append((target, own, (*key, word), weight + out + more))
