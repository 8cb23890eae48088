"""External recursive induced sorting of one shard: which windows of its strings occur twice, in memory that does not grow with the shard.

A member of a shard is a string of symbols (bytes, or 64-bit hashes of words) around an anchor. Members with the same anchor are compared:

* recursion: the tails that begin at the anchors are strings of symbols; neighbouring symbols become names in the order of their pairs, and the strings of
  names, half as long, are sorted by recursion, down to one name a tail. That orders the tails; neighbours then get the length of their common prefix;
* induction: the suffix one symbol further left is ordered by its first symbol, then by the suffix after it. Tuples (group of the anchor and symbol, member, common
  prefix) go through a queue that returns them by key and, within a key, in the order of arrival. The common prefix with the tuple before it is one more than the least one since
  the last arrival of the same key. This goes on until the leftmost window of each member;
* neighbours with a common prefix of a whole window, at any step, are windows that occur twice.

All that grows with the shard lies in files of a folder of the task: strings, names, and the runs of the queues, each of at most ``limit`` tuples. They are
read and written in batches; in memory are a few batches, and for the group that a batch ends in the last prefix of each of its symbols.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np

#: What tails are filled up with; less than every symbol.
PAD = np.iinfo(np.int64).min


class TupleQueue:
    """A stable priority queue of integer tuples: pushed in batches, drained by the first column. Full batches are sorted and written as runs, which draining merges."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit = folder, limit
        self.batches: list[np.ndarray] = []
        self.rows = self.pushed = 0
        self.runs: list[np.ndarray] = []

    def push(self, *columns: np.ndarray) -> None:
        """columns[0] is the key."""
        for a in range(0, len(columns[0]), self.limit):
            batch = np.stack([c[a : a + self.limit] for c in columns]).astype(np.int64, copy=False)
            self.batches.append(batch)
            self.rows += batch.shape[1]
            self.pushed += batch.shape[1]
            if self.rows >= self.limit:
                self.spill()

    def _sorted(self) -> np.ndarray:
        rows = np.concatenate(self.batches, 1) if len(self.batches) > 1 else self.batches[0]
        self.batches, self.rows = [], 0
        return rows[:, np.argsort(rows[0], kind="stable")]

    def spill(self) -> None:
        path = f"{self.folder}/{uuid.uuid4().hex}.npy"
        np.save(path, self._sorted())
        self.runs.append(np.load(path, mmap_mode="r"))
        os.remove(path)

    def drain(self) -> Iterator[np.ndarray]:
        """Batches of about limit tuples at most in order of key, then of arrival."""
        if not self.runs:
            if self.batches:
                yield self._sorted()
            return
        if self.batches:
            self.spill()
        runs, at = self.runs, [0] * len(self.runs)
        step = max(1, self.limit // len(runs))
        while left := [k for k, r in enumerate(runs) if at[k] < r.shape[1]]:
            bound = min(int(runs[k][0, min(at[k] + step, runs[k].shape[1]) - 1]) for k in left)
            ends = {k: at[k] + int(np.searchsorted(runs[k][0, at[k] : at[k] + step], bound, "left")) for k in left}
            rows = np.concatenate([runs[k][:, at[k] : ends[k]] for k in left], 1)
            if rows.shape[1]:
                yield rows[:, np.argsort(rows[0], kind="stable")]
            for k in left:
                stop = ends[k] + int(np.searchsorted(runs[k][0, ends[k] :], bound, "right"))
                for a in range(ends[k], stop, self.limit):
                    yield np.asarray(runs[k][:, a : min(a + self.limit, stop)])
                at[k] = stop
        self.runs = []


def _file(folder: str, kind, shape: tuple[int, ...]) -> np.ndarray:
    """An array on disk; the disk is free again as soon as the array is no longer used."""
    path = f"{folder}/{uuid.uuid4().hex}.npy"
    held = np.lib.format.open_memmap(path, "w+", kind, shape)
    os.remove(path)
    return held


def _names(matrix: np.ndarray, folder: str, limit: int) -> np.ndarray:
    """Numbers that sort as the rows of matrix do: neighbouring symbols get names in the order of their pairs, and the strings of names are sorted by recursion."""
    m, width = matrix.shape
    if width == 1:
        return matrix[:, 0]
    half = (width + 1) // 2
    by_second, by_first, by_place = (TupleQueue(folder, limit) for _ in range(3))
    step = max(1, limit // half)
    for a in range(0, m, step):
        rows = np.asarray(matrix[a : a + step])
        second = np.full((len(rows), half), PAD)
        second[:, : width // 2] = rows[:, 1::2]
        by_second.push(second.ravel(), rows[:, ::2].ravel(), a * half + np.arange(len(rows) * half))
    for second, first, place in by_second.drain():
        by_first.push(first, second, place)
    last, name = None, -1
    for first, second, place in by_first.drain():
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new[0] = last != (first[0], second[0])
        names = name + np.cumsum(new)
        last, name = (first[-1], second[-1]), int(names[-1])
        by_place.push(place, names)
    shorter, at = _file(folder, np.int64, (m, half)), 0
    for _, names in by_place.drain():
        shorter.reshape(-1)[at : at + len(names)] = names
        at += len(names)
    return _names(shorter, folder, limit)


def least_between(values: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """min(values[x + 1 .. y]) for x < y, by a sparse table."""
    width = y - x
    level = np.zeros(len(x), np.int64)
    some = width > 1
    level[some] = np.log2(width[some]).astype(np.int64)
    out, row = np.zeros(len(x), values.dtype), values
    for k in range(int(level.max(initial=0)) + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(row[x[at] + 1], row[y[at] + 1 - (1 << k)])
        if len(row) > 1 << k:
            row = np.minimum(row[: -(1 << k)], row[1 << k :])
    return out


class _Prefixes:
    """The common prefix of each tuple with the last one of the same group and symbol, tuples coming in batches in the order of the step before, groups ascending."""

    def __init__(self):
        self.group, self.least = -1, {}

    def of(self, group: np.ndarray, symbol: np.ndarray, used: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the used tuples by group, then symbol, then arrival; their prefixes). used: the places that have a symbol further left."""
        key = np.lexsort((symbol[used], group[used])) if symbol.dtype != np.uint8 else np.argsort(group[used] << 8 | symbol[used], kind="stable")
        place = used[key]
        g, s = group[place], symbol[place]
        again = np.flatnonzero((g[1:] == g[:-1]) & (s[1:] == s[:-1])) + 1
        out = np.zeros(len(place), np.int64)
        out[again] = 1 + least_between(lcp, place[again - 1], place[again])
        if self.least and len(group) and group[0] == self.group:
            first = np.setdiff1d(np.arange(int(np.searchsorted(g, self.group, "right"))), again)
            running = np.minimum.accumulate(lcp[: int(np.searchsorted(group, self.group, "right"))])
            for k in first.tolist():
                if (seen := self.least.get(int(s[k]))) is not None:
                    out[k] = 1 + min(seen, int(running[place[k]]))
        if len(group):
            begin = int(np.searchsorted(group, group[-1], "left"))
            if group[-1] == self.group:
                low = int(lcp[begin:].min())
                self.least = {k: min(v, low) for k, v in self.least.items()}
            else:
                self.group, self.least = int(group[-1]), {}
            after = np.append(np.minimum.accumulate(lcp[begin:][::-1])[::-1], np.iinfo(np.int64).max - 1)
            low = int(np.searchsorted(g, self.group, "left"))
            last = low + np.flatnonzero(np.append(s[low + 1 :] != s[low:-1], True)[: len(place) - low])
            self.least |= zip(s[last].tolist(), after[place[last] + 1 - begin].tolist(), strict=True)
        return place, out


def repeated_windows(members: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]], length: int, folder: str, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, number, first, end) of the maximal runs of window starts that also occur in another member of the same anchor.

    members: batches of (anchor, rel, size, symbols, number): the anchor and its place in the member's string, the string's length, all strings one after another
    (uint8, without 255, or int64, without PAD), and a number that the result names the member by.
    """
    files = {k: open(f"{folder}/{k}", "wb") for k in ("anchor", "rel", "right", "number", "tails", "left")}  # noqa: SIM115
    kind, m = np.dtype(np.uint8), 0
    for anchor, rel, size, symbols, number in members:
        kind, m = symbols.dtype, m + len(anchor)
        pivot = np.cumsum(size) - size + rel
        tails = np.full((len(anchor), length), 0 if kind == np.uint8 else PAD, kind)
        left = np.zeros((len(anchor), length), kind)
        for k in range(length):
            inside = np.flatnonzero(k < size - rel)
            tails[inside, k] = symbols[pivot[inside] + k] + (1 if kind == np.uint8 else 0)
            inside = np.flatnonzero(k < rel)
            left[inside, k] = symbols[pivot[inside] - 1 - k]
        for name, values in (("anchor", anchor), ("rel", rel), ("right", size - rel), ("number", number)):
            files[name].write(np.ascontiguousarray(values, np.int64).tobytes())
        files["tails"].write(tails.tobytes())
        files["left"].write(left.tobytes())
    for f in files.values():
        f.close()
    if not m:
        return
    at = {k: np.memmap(f"{folder}/{k}", np.int64, "r", shape=(m,)) for k in ("anchor", "rel", "right", "number")}
    tails, left = (np.memmap(f"{folder}/{k}", kind, "r", shape=(m, length)) for k in ("tails", "left"))
    rows = max(1, limit // length)
    if kind == np.uint8:
        wide = _file(folder, np.int64, (m, -(-length // 8)))
        for a in range(0, m, 8 * rows):
            part = np.zeros((min(8 * rows, m - a), 8 * wide.shape[1]), np.uint8)
            part[:, :length] = tails[a : a + 8 * rows]
            wide[a : a + len(part)] = (part.view(">u8").astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
    name = _names(wide if kind == np.uint8 else tails, folder, limit)
    by_tail, by_anchor = TupleQueue(folder, limit), TupleQueue(folder, limit)
    for a in range(0, m, limit):
        by_tail.push(name[a : a + limit], np.arange(a, min(a + limit, m)))
    for _, member in by_tail.drain():
        by_anchor.push(at["anchor"][member], member)

    # From here members are numbered in the order of their tails, anchor by anchor; column k of the text is the k-th symbol left of the anchors.
    group_of, rel_of, number_of, anchor_of = (_file(folder, np.int64, (m,)) for _ in range(4))
    column = _file(folder, kind, (length, m))

    def anchors() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        begin, group, before = 0, -1, None
        for all_keys, all_members in by_anchor.drain():
            for a in range(0, len(all_keys), rows):
                keys, member = all_keys[a : a + rows], all_members[a : a + rows]
                text, right = np.asarray(tails[member]), at["right"][member]
                earlier = before or (keys[:1] - 1, text[:1], right[:1])
                keys_, text_, right_ = (np.concatenate([x[-1:], y]) for x, y in zip(earlier, (keys, text, right), strict=True))
                new = keys_[1:] != keys_[:-1]
                differ = text_[1:] != text_[:-1]
                same = np.minimum(np.where(differ.any(1), differ.argmax(1), length), np.minimum(right_[1:], right_[:-1]))
                own = slice(begin, begin + len(keys))
                group_of[own] = group + np.cumsum(new)
                rel_of[own], number_of[own], anchor_of[own] = at["rel"][member], at["number"][member], keys
                column[:, own] = left[member].T
                yield np.arange(begin, begin + len(keys)), np.where(new, 0, same)
                begin, group, before = begin + len(keys), int(group_of[begin + len(keys) - 1]), (keys, text, right)

    found = TupleQueue(folder, limit)
    stream, step = anchors(), 0
    while True:
        queue, prefixes, before = TupleQueue(folder, limit), _Prefixes(), np.zeros(0, np.int64)
        for member, lcp in stream:
            twice = np.flatnonzero(lcp >= length)
            if len(twice):
                chain = np.concatenate([before, member])
                hit = np.unique(np.concatenate([chain[twice + len(before) - 1], member[twice]]))
                found.push(hit, rel_of[hit] - step)
            group = group_of[member]
            used = np.flatnonzero(rel_of[member] > step)
            if step < length:
                place, prefix = prefixes.of(group, column[step, member], used, lcp)
                if kind == np.uint8:
                    queue.push(group[place] << 8 | column[step, member[place]], member[place], prefix)
                else:
                    queue.push(column[step, member[place]], group[place], member[place], prefix)
            before = member[-1:]
        if not queue.pushed:
            break
        step += 1
        stream = (b[1:] for b in queue.drain()) if kind == np.uint8 else _by_group(queue, folder, limit)
    for member, first, end in _runs(found):
        yield anchor_of[member], number_of[member], first, end


def _by_group(queue: TupleQueue, folder: str, limit: int) -> Iterator[np.ndarray]:
    """(member, prefix) of tuples drained by symbol, now by group."""
    again = TupleQueue(folder, limit)
    for _, group, member, prefix in queue.drain():
        again.push(group, member, prefix)
    for batch in again.drain():
        yield batch[1:]


def _runs(found: TupleQueue) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Maximal runs of found (member, start); a member's starts come in descending order."""
    kept = None
    for member, start in found.drain():
        new = np.ones(len(member), bool)
        new[1:] = (member[1:] != member[:-1]) | (start[1:] < start[:-1] - 1)
        head = np.flatnonzero(new)
        names, first, end = member[head], start[np.concatenate([head[1:], [len(member)]]).astype(np.int64) - 1], start[head] + 1
        if kept is not None:
            if names[0] == kept[0] and end[0] >= kept[1]:
                end[0] = kept[2]
            else:
                yield tuple(np.array([x], np.int64) for x in kept)
        kept = (names[-1], first[-1], end[-1])
        yield names[:-1], first[:-1], end[:-1]
    if kept is not None:
        yield tuple(np.array([x], np.int64) for x in kept)
