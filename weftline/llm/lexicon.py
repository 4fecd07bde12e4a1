"""A minimal acyclic transducer from words to lists of ids, in flat arrays that can be memory-mapped."""

from __future__ import annotations

import io

import numpy as np

ARRAYS = ("arcs", "targets", "outputs", "finals", "offsets", "ids")


def compile_lexicon(entries: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """Arrays of the smallest automaton that accepts the words, sharing prefixes and suffixes.

    Words are added in byte order; a state is replaced by an equal registered
    one as soon as no later word can change it. The outputs on a path add up to
    the word's rank in byte order, under which ``offsets`` and ``ids`` hold its
    ids. ``arcs`` are ``state * 256 + byte``, sorted; state 0 is the start.
    """
    words = sorted(entries)
    register: dict[tuple, int] = {}
    frozen: list[tuple] = []
    #: Of each open state along the last word: whether it is final, and its arcs to frozen states.
    path: list[list] = [[False, []]]

    def freeze(down_to: int, word: bytes) -> None:
        while len(path) > down_to + 1:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            state = register.get(key)
            if state is None:
                state = register[key] = len(frozen)
                frozen.append(key)
            path[-1][1].append((word[len(path) - 1], state))

    last = b""
    for word in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        freeze(shared, last)
        path.extend([False, []] for _ in range(len(word) - shared))
        path[-1][0] = True
        last = word
    freeze(0, last)
    frozen.append((path[0][0], tuple(path[0][1])))

    # Targets are frozen before their sources, so word counts are known in order; the start comes last and is numbered 0.
    counts, start = [0] * len(frozen), len(frozen) - 1
    number = lambda s: 0 if s == start else s + 1
    arcs, targets, outputs, finals = [], [], [], np.zeros(len(frozen) + 1, np.bool_)
    for state, (final, out) in enumerate(frozen):
        total = int(final)
        for byte, target in out:
            arcs.append(number(state) * 256 + byte)
            targets.append(number(target))
            outputs.append(total)
            total += counts[target]
        counts[state] = total
        finals[number(state)] = final
    order = np.argsort(np.array(arcs, np.int64), kind="stable")
    lists = [entries[w] for w in words]
    return {
        "arcs": np.array(arcs, np.int64)[order], "targets": np.array(targets, np.int32)[order], "outputs": np.array(outputs, np.int32)[order],
        "finals": finals, "offsets": np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int64),
        "ids": np.array([i for x in lists for i in x], np.int32),
    }


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """One uncompressed file, each array behind the other with its length in front."""
    out = io.BytesIO()
    out.write(np.array([len(arrays[n]) for n in ARRAYS], np.int64).tobytes())
    for name in ARRAYS:
        data = arrays[name].tobytes()
        out.write(data + b"\0" * (-len(data) % 8))
    return out.getvalue()


_KINDS = {"arcs": np.int64, "targets": np.int32, "outputs": np.int32, "finals": np.bool_, "offsets": np.int64, "ids": np.int32}


class Lexicon:
    """The transducer over a memory-mapped file, which all workers of a machine share."""

    def __init__(self, path: str) -> None:
        sizes = np.fromfile(path, np.int64, len(ARRAYS))
        at = sizes.nbytes
        for name, size in zip(ARRAYS, sizes.tolist(), strict=True):
            kind = np.dtype(_KINDS[name])
            setattr(self, name, np.memmap(path, kind, "r", at, (size,)) if size else np.zeros(0, kind))
            at += size * kind.itemsize + -(size * kind.itemsize) % 8

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for words that aren't in the lexicon; all words advance together, byte by byte."""
        found = np.full(len(words), -1, np.int64)
        if not len(self.arcs):
            return found
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        data = np.frombuffer(b"".join(words), np.uint8)
        alive, state, rank, at = np.flatnonzero(lengths), None, None, 0
        state, rank = np.zeros(len(alive), np.int64), np.zeros(len(alive), np.int64)
        while len(alive):
            arc = state * 256 + data[starts[alive] + at]
            place = np.minimum(np.searchsorted(self.arcs, arc), len(self.arcs) - 1)
            hit = self.arcs[place] == arc
            alive, place, rank = alive[hit], place[hit], rank[hit]
            state, rank, at = self.targets[place].astype(np.int64), rank + self.outputs[place], at + 1
            ended = lengths[alive] == at
            done = ended & self.finals[state]
            found[alive[done]] = rank[done]
            alive, state, rank = alive[~ended], state[~ended], rank[~ended]
        return found
