"""A minimal acyclic transducer over byte strings, in flat arrays that can be memory-mapped.

Words share their prefixes and their suffixes. Every transition carries how many words sort before those behind it, so
the sum along a word's path is the word's number; a table of numbers gives its output, a list of ids.
"""

from __future__ import annotations

import io

import numpy as np

_MAGIC = b"parlance-lexicon-1"


def _minimal_states(words: list[bytes]) -> tuple[list[tuple[bool, tuple[tuple[int, int], ...]]], int]:
    """States as (final, transitions) of the least automaton for sorted distinct words, and its start."""
    register: dict[tuple, int] = {}
    states: list[tuple] = []

    def settle(final: bool, arcs: list[tuple[int, int]]) -> int:
        state = (final, tuple(arcs))
        at = register.get(state)
        if at is None:
            at = register[state] = len(states)
            states.append(state)
        return at

    path: list[list] = [[False, []]]  # of the last word: final, settled transitions
    last = b""
    for w in words:
        same = 0
        top = min(len(w), len(last))
        while same < top and w[same] == last[same]:
            same += 1
        while len(path) > same + 1:
            final, arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(final, arcs)))
        for _ in w[same:]:
            path.append([False, []])
        path[-1][0] = True
        last = w
    while len(path) > 1:
        final, arcs = path.pop()
        path[-1][1].append((last[len(path) - 1], settle(final, arcs)))
    return states, settle(*path[0])


class Lexicon:
    """Transitions sit in one displaced table: state + byte is the place, and the place tells whose it is."""

    ARRAYS = ("owner", "target", "skip", "final", "out_ptr", "out_ids")

    def __init__(self, arrays: dict[str, np.ndarray], start: int):
        self.arrays, self.start = arrays, start
        for name in self.ARRAYS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, outputs: dict[bytes, list[int]]) -> Lexicon:
        words = sorted(w for w in outputs if w)
        states, start = _minimal_states(words)
        count = [0] * len(states)  # words behind each state; transitions lead to states settled before
        for i, (final, arcs) in enumerate(states):
            count[i] = final + sum(count[t] for _, t in arcs)
        total = sum(len(arcs) for _, arcs in states)
        size = total + 512
        taken = np.zeros(size * 2, bool)
        base = np.zeros(len(states), np.int64)
        order = sorted((i for i, s in enumerate(states) if s[1]), key=lambda i: -len(states[i][1]))
        used_base = np.zeros(size * 2, bool)
        low = 256
        for i in order:
            arcs = states[i][1]
            bytes_ = np.array([b for b, _ in arcs])
            at = low
            while True:
                free = at + np.flatnonzero(~taken[at : at + 4096])
                if len(free):
                    b = free - bytes_[0]
                    fits = ~used_base[b]
                    for x in bytes_[1:]:
                        fits &= ~taken[np.minimum(b + x, len(taken) - 1)]
                    hit = np.flatnonzero(fits)
                    if len(hit):
                        base[i] = b[hit[0]]
                        break
                at += 4096
                if at + 4608 > len(taken):
                    taken, used_base = (np.concatenate([t, np.zeros(len(t), bool)]) for t in (taken, used_base))
            taken[base[i] + bytes_] = True
            used_base[base[i]] = True
            while taken[low]:
                low += 1
        dead = np.flatnonzero(~used_base)  # states without transitions need a place of their own
        leaves = [i for i, s in enumerate(states) if not s[1]]
        for i, at in zip(leaves, dead[1:], strict=False):
            base[i] = at
        end = int(max(np.flatnonzero(taken)[-1] if taken.any() else 0, base.max() if len(base) else 0)) + 257
        owner, target, skip = np.full(end, -1, np.int32), np.zeros(end, np.int32), np.zeros(end, np.int32)
        final = np.zeros(end, bool)
        for i, (is_final, arcs) in enumerate(states):
            final[base[i]] = is_final
            before = int(is_final)
            for b, t in arcs:
                place = base[i] + b
                owner[place], target[place], skip[place] = base[i], base[t], before
                before += count[t]
        lengths = np.array([len(outputs[w]) for w in words], np.int64)
        ptr = np.zeros(len(words) + 1, np.int32)
        np.cumsum(lengths, out=ptr[1:])
        ids = np.array([x for w in words for x in outputs[w]], np.int32)
        return cls({"owner": owner, "target": target, "skip": skip, "final": final, "out_ptr": ptr, "out_ids": ids}, int(base[start]))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each span's word, or -1: all spans walk the automaton together, one byte at a time."""
        out = np.full(len(starts), -1, np.int32)
        live = np.flatnonzero(ends > starts)
        at, stop = starts[live], ends[live]
        state = np.full(len(live), self.start, np.int32)
        number = np.zeros(len(live), np.int32)
        while len(live):
            place = state + data[at]
            good = self.owner[place] == state
            if not good.all():
                place, live, at, stop, number = place[good], live[good], at[good], stop[good], number[good]
            number = number + self.skip[place]
            state = self.target[place]
            at = at + 1
            done = at == stop
            if done.any():
                hit = done & self.final[state]
                out[live[hit]] = number[hit]
                go = ~done
                live, at, stop, state, number = live[go], at[go], stop[go], state[go], number[go]
        return out

    def to_bytes(self) -> bytes:
        """Header line, then the arrays, each at a multiple of 64 bytes."""
        body, parts = io.BytesIO(), []
        for name in self.ARRAYS:
            a = np.ascontiguousarray(self.arrays[name])
            body.write(b"\0" * (-body.tell() % 64))
            parts.append(f"{name}:{a.dtype.str}:{len(a)}:{body.tell()}")
            body.write(a.tobytes())
        head = _MAGIC + f" {self.start} {' '.join(parts)}\n".encode()
        head = head[:-1] + b" " * (-len(head) % 64) + b"\n"
        return head + body.getvalue()

    @classmethod
    def open(cls, path: str) -> Lexicon:
        """Maps the file; its pages are shared by all workers of a machine."""
        with open(path, "rb") as f:
            head = f.readline()
        if not head.startswith(_MAGIC):
            raise ValueError("not a lexicon")
        start, *parts = head[len(_MAGIC) :].decode().split()
        raw = np.memmap(path, np.uint8, "r")
        arrays = {}
        for p in parts:
            name, dtype, n, at = p.split(":")
            lo = len(head) + int(at)
            arrays[name] = raw[lo : lo + int(n) * np.dtype(dtype).itemsize].view(dtype)
        return cls(arrays, int(start))
