"""Suffix and common-prefix arrays by external induced sorting.

A suffix is of type S if it is smaller than the next one, else of type L; S* is an S suffix after an L suffix. S*
substrings are sorted and named, the string of names is sorted recursively (in memory once it is short enough), and the
order of all other suffixes is induced: L suffixes from left to right, then S suffixes from right to left.

Memory is bounded by the bytes given, not by the text. The text and every array that is longer lie in mapped, unlinked
files of the task. S* substrings are named by external sorts, a few characters a pass. Induced tuples (character, position,
common prefix with the tuple before) wait in a priority queue ordered by character and arrival: lanes of neighbouring
characters that go to disk, of which only the first is taken up and sorted. Tuples are taken out and induced in batches that
end before the first tuple that the batch itself puts into the queue, so small and large alphabets run alike.

The common prefix of two neighbours is one more than the least value between the suffixes that induced them; at the
border of L and S within a character it is the shorter run of that character. Values are right up to ``cap``; suffixes
that agree in ``cap`` characters are neighbours, in any order.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np

#: Bytes of a queue, a sort or an array that stay in memory; the rest goes to the task's scratch files.
MEMORY = 8 << 20
#: One name is sorted in memory for so many bytes given; that takes about six times as much while it lasts.
NAME = 16
#: Tuples of a batch, and how many of a lane are looked at for one.
BLOCK, LOOK = 1 << 15, 1 << 12
#: Tuples of a lane of several characters. A batch ends where a lane does, or before a tuple that it puts into its own lane;
#: over a pass that is about n / LANE + LANE times, so without a number here LANE grows with the root of n.
LANE: int | None = None
#: Sorted runs that are merged at once.
RUNS = 64


def array(n: int, dtype, memory: int = MEMORY) -> np.ndarray:
    if n * np.dtype(dtype).itemsize <= memory:
        return np.zeros(n, dtype)
    with tempfile.TemporaryFile() as f:  # the mapping keeps the unlinked file
        return np.memmap(f, dtype, "w+", shape=(n,))


def spans(n: int, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    return ((at, min(n, at + size)) for at in range(0, n, size))


class Sorter:
    """Rows of 64-bit numbers by their first column: runs that fit in memory are sorted, written and merged."""

    def __init__(self, memory: int, columns: int = 2) -> None:
        self.memory, self.columns, self.held, self.parts, self.runs, self.file = memory, columns, 0, [], [], None

    def push(self, rows: np.ndarray) -> None:
        self.parts.append(rows)
        self.held += rows.nbytes
        if self.held > self.memory:
            self.spill()

    def rows(self) -> np.ndarray:
        rows = np.concatenate([np.empty((0, self.columns), np.int64), *self.parts])
        self.parts, self.held = [], 0
        return rows[np.argsort(rows[:, 0], kind="stable")]

    def spill(self) -> None:
        self.runs.append(self.write([self.rows()]))

    def write(self, blocks) -> tuple[int, int]:
        """A run: where it begins and its rows."""
        with tempfile.TemporaryFile() as f:
            for b in blocks:
                f.write(b.tobytes())
            n = f.tell() // (8 * self.columns)
            return np.memmap(f, np.int64, "r", shape=(n, self.columns)), n

    def blocks(self) -> Iterator[np.ndarray]:
        if not self.runs:
            if self.parts:
                yield self.rows()
            return
        if self.parts:
            self.spill()
        while len(self.runs) > RUNS:
            self.runs = [*self.runs[RUNS:], self.write(self.merged(self.runs[:RUNS]))]
        yield from self.merged(self.runs)

    def merged(self, runs: list) -> Iterator[np.ndarray]:
        size = max(64, self.memory // (8 * self.columns * len(runs)))
        at = [0] * len(runs)
        while True:
            heads = [np.asarray(run[i : i + size]) for (run, _), i in zip(runs, at, strict=True)]
            ends = [h[-1, 0] for h, (_, n), i in zip(heads, runs, at, strict=True) if i + len(h) < n]
            taken = [int(np.searchsorted(h[:, 0], min(ends), "right")) if ends else len(h) for h in heads]
            out = np.concatenate([h[:k] for h, k in zip(heads, taken, strict=True)])
            if not len(out):
                return
            yield out[np.argsort(out[:, 0], kind="stable")]
            at = [i + k for i, k in zip(at, taken, strict=True)]


class Lanes:
    """Priority queue of (character, position, common prefix) by lane; within a lane, tuples come out as they came in."""

    def __init__(self, memory: int = MEMORY) -> None:
        self.memory, self.held, self.lanes, self.file, self.spills = memory, 0, {}, None, 0

    def push(self, lane: int, tuples: np.ndarray) -> None:
        self.lanes.setdefault(lane, []).append(tuples)
        self.held += tuples.nbytes
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        """A lane's tuples in memory become one stretch of the file."""
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for lane in self.lanes.values():
            k = len(lane)
            while k and isinstance(lane[k - 1], np.ndarray):
                k -= 1
            if k < len(lane):
                where = self.file.tell()
                for x in lane[k:]:
                    self.file.write(x.tobytes())
                lane[k:] = [(where, sum(map(len, lane[k:])))]
        self.held, self.spills = 0, self.spills + 1

    def pop(self, lane: int, most: int = BLOCK) -> np.ndarray:
        """About the next ``most`` tuples of a lane, (n, 3); none if it is empty."""
        parts, n, waiting = [], 0, self.lanes.get(lane, [])
        taken = 0
        while taken < len(waiting) and n < most:
            x = waiting[taken]
            if isinstance(x, np.ndarray):
                self.held -= x.nbytes
                taken += 1
            else:
                where, rows = x
                few = min(rows, most - n)
                self.file.seek(where)
                x = np.frombuffer(self.file.read(24 * few), np.int64).reshape(-1, 3)
                if few < rows:
                    waiting[taken] = (where + 24 * few, rows - few)
                else:
                    taken += 1
            parts.append(x)
            n += len(x)
        del waiting[:taken]
        if not waiting:
            self.lanes.pop(lane, None)
        return np.concatenate(parts) if parts else np.empty((0, 3), np.int64)


def least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo..hi] for each pair, lo <= hi."""
    width = int((hi - lo).max(initial=0)) + 1
    table, k = [values], 1
    while 2 * k <= width:
        last = table[-1]
        table.append(np.minimum(last[:-k], last[k:]))
        k *= 2
    out = np.empty(len(lo), values.dtype)
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    for i, t in enumerate(table):
        at = np.flatnonzero(level == i)
        if len(at):
            out[at] = np.minimum(t[lo[at]], t[hi[at] - (1 << i) + 1])
    return out


def run_lengths(text: np.ndarray, at: np.ndarray, cap: int) -> np.ndarray:
    """Length of the run of equal characters from each place, up to cap. The text's last character ends every run."""
    out, active, char = np.ones(len(at), np.int64), np.arange(len(at)), text[at]
    while len(active):
        active = active[out[active] < cap]
        active = active[text[np.minimum(at[active] + out[active], len(text) - 1)] == char[active]]
        active = active[at[active] + out[active] < len(text)]
        out[active] += 1
    return out


class Kinds:
    """Types of all suffixes in one pass from right to left: S* places in order, and how many suffixes of each type begin
    with each character."""

    def __init__(self, text: np.ndarray, memory: int) -> None:
        n = len(text)
        self.top = int(max(int(text[a:b].max()) for a, b in spans(n)))
        self.l, self.s, self.stars = (array(self.top + 1, np.int64, memory) for _ in range(3))
        found, after, kind = [], np.iinfo(np.int64).max, True
        places, total = tempfile.TemporaryFile(), 0
        for lo, hi in reversed(list(spans(n, 8 * BLOCK))):
            t = np.asarray(text[lo:hi]).astype(np.int64)
            following = np.append(t[1:], after)
            known = np.flatnonzero(t != following)
            is_s = np.empty(hi - lo, bool)
            stop = int(known[-1]) + 1 if len(known) else 0
            is_s[:stop] = np.repeat(t[known] < following[known], np.diff(known, prepend=-1))
            is_s[stop:] = kind
            star = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + lo + 1
            if hi < n and kind and not is_s[-1]:
                star = np.append(star, hi)
            places.write(star[::-1].astype(np.int64).tobytes())
            total += len(star)
            for counts, chars in ((self.l, t[~is_s]), (self.s, t[is_s]), (self.stars, np.asarray(text[star]))):
                found, times = np.unique(chars, return_counts=True)
                counts[found] += times
            after, kind = int(t[0]), bool(is_s[0])
        self.star = array(total, np.int64, memory)
        for a, b in spans(total):
            places.seek(8 * (total - b))
            self.star[a:b] = np.frombuffer(places.read(8 * (b - a)), np.int64)[::-1]
        places.close()


class Substrings:
    """The S* substrings, up to and with the first character of the next; a shorter one sorts after what it begins."""

    def __init__(self, text: np.ndarray, start: np.ndarray, top: int, memory: int) -> None:
        self.text, self.start, self.memory, self.pad = text, start, memory, top + 1
        self.bits = self.pad.bit_length()

    def length(self, which: np.ndarray) -> np.ndarray:
        last = len(self.start) - 1
        return np.where(which < last, self.start[np.minimum(which + 1, last)] - self.start[which] + 1, 1)

    def key(self, which: np.ndarray, skip: int, chars: int) -> np.ndarray:
        out = np.zeros(len(which), np.int64)
        start, length = self.start[which], self.length(which)
        for j in range(skip, skip + chars):
            c = self.text[np.minimum(start + j, len(self.text) - 1)].astype(np.int64)
            out = (out << self.bits) | np.where(j < length, c, self.pad)
        return out

    def names(self) -> tuple[np.ndarray, int]:
        """(name of each substring in turn, number of names). A pass sorts by what is known so far and some characters more;
        equal rows that have characters left go on to the next pass."""
        m, more = len(self.start), 31 // self.bits
        chars, done = 62 // self.bits, Sorter(self.memory)
        sorter = Sorter(self.memory)
        for a, b in spans(m):
            which = np.arange(a, b)
            sorter.push(np.stack((self.key(which, 0, chars), which), axis=1))
        going, first = m, True
        skip = 0
        while going:
            skip += chars
            then, going = Sorter(self.memory), 0
            at, last, rank, old, old_at = 0, None, 0, None, 0
            for rows in sorter.blocks():
                key, which = rows[:, 0], rows[:, 1]
                index = np.arange(at, at + len(key))
                new = np.concatenate(([last is None or key[0] != last], key[1:] != key[:-1]))
                group = np.zeros(len(key), np.int64) if first else key >> 31
                top = np.concatenate(([old is None or group[0] != old], group[1:] != group[:-1]))
                # place of the first row with this key, counted from the first row of the group
                begin = np.maximum.accumulate(np.where(top, index, old_at if old is not None else 0))
                since = np.where(new, index - begin, -1)
                carried = rank - (old if old is not None else 0)
                held = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
                since = np.where(held >= 0, since[np.maximum(held, 0)], carried)
                ranks = group + since
                tied = ~new
                tied[:-1] |= ~new[1:]
                tied[-1] = tied[0] = True  # what the neighbouring blocks hold is not known here
                on = tied & (self.length(which) >= skip)  # one that ends here is still to be told from those that go on
                done.push(np.stack((ranks[~on], which[~on]), axis=1))
                if on.any():
                    then.push(np.stack(((ranks[on] << 31) | self.key(which[on], skip, more), which[on]), axis=1))
                    going += int(on.sum())
                at, last, rank, old, old_at = at + len(key), key[-1], int(ranks[-1]), int(group[-1]), int(begin[-1])
            sorter, first, chars = then, False, more
        placed, name, last = Sorter(self.memory), -1, None
        for rows in done.blocks():
            new = np.concatenate(([last is None or rows[0, 0] != last], rows[1:, 0] != rows[:-1, 0]))
            names = name + np.cumsum(new)
            placed.push(np.stack((rows[:, 1], names), axis=1))
            name, last = int(names[-1]), rows[-1, 0]
        out, at = array(m, np.int32 if m < 1 << 31 else np.int64, self.memory), 0
        for rows in placed.blocks():
            out[at : at + len(rows)] = rows[:, 1]
            at += len(rows)
        return out, name + 1

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of different substrings."""
        out, active = np.zeros(len(a), np.int64), np.arange(len(a))
        shorter, x, y = np.minimum(self.length(a), self.length(b)), self.start[a], self.start[b]
        end = len(self.text) - 1
        while len(active):
            at = out[active]
            same = (at < shorter[active]) & (self.text[np.minimum(x[active] + at, end)] == self.text[np.minimum(y[active] + at, end)])
            active = active[same]
            out[active] += 1
        return out


class Induction:
    """One pass. Upwards it induces L suffixes from S* suffixes; mirrored (characters counted from the top), S from L."""

    def __init__(self, text: np.ndarray, top: int, mirrored: bool, cap: int, memory: int, counts: np.ndarray, seeds: np.ndarray, read: Callable) -> None:
        """counts, seeds: suffixes to be induced, and given ones, by character. read(a, b): (position, common prefix) of the given."""
        self.text, self.top, self.mirrored, self.cap, self.read = text, top, mirrored, cap, read
        self.queue = Lanes(memory)
        self.stamp, self.carry = array(top + 1, np.int64, memory), array(top + 1, np.int64, memory)  # stamp: character + 1
        self.here, self.here_char, self.last_code, self.last_pos = [], -1, -2, 0
        self.lane_of, self.heavy, self.given = array(top + 1, np.int32, memory), [], []
        held, was_heavy, was_level, size = 0, True, -1, LANE or max(64, 2 * isqrt(len(text)))
        for lo, hi in spans(top + 1):
            side = slice(lo, hi) if not mirrored else slice(top + 1 - hi, top + 1 - lo)
            own, given = (np.asarray(x[side]) for x in (counts, seeds))
            if mirrored:
                own, given = own[::-1], given[::-1]
            total = own + given
            heavy = total > size
            light = np.where(heavy, 0, total)
            level = (held + np.cumsum(light) - light) // size
            start = heavy | np.append(was_heavy, heavy[:-1]) | (level != np.append(was_level, level[:-1]))
            lane = len(self.heavy) - 1 + np.cumsum(start)
            self.lane_of[lo:hi] = lane
            self.heavy += heavy[start].tolist()
            self.given += [0] * (len(self.heavy) - len(self.given))
            first = int(lane[0])
            for i, k in enumerate(np.bincount(lane - first, weights=given).astype(np.int64).tolist()):
                self.given[first + i] += k
            held, was_heavy, was_level = held + int(light.sum()), bool(heavy[-1]), int(level[-1])

    def char(self, pos: np.ndarray) -> np.ndarray:
        c = self.text[pos].astype(np.int64)
        return self.top - c if self.mirrored else c

    def run(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(is it induced, position, common prefix with the one before) in blocks, in order of the pass."""
        taken = 0
        for lane, (heavy, given) in enumerate(zip(self.heavy, self.given, strict=True)):
            if heavy:
                while len(t := self.queue.pop(lane)):
                    yield from self.blocks(2 * t[:, 0], t[:, 1], t[:, 2])
                    if len(t) == 1 and len(a := self.queue.pop(lane)):
                        skipped, a = self.along(t[0], a)
                        yield from skipped
                        self.queue.push(lane, a)
                for a, b in spans(given):
                    pos, lcp = self.read(taken + a, taken + b)
                    yield from self.blocks(2 * self.char(pos) + 1, pos, lcp)
            else:
                t = self.queue.pop(lane, 1 << 62)
                pos, lcp = self.read(taken, taken + given)
                code, pos, lcp = in_order(np.append(2 * t[:, 0], 2 * self.char(pos) + 1), np.append(t[:, 1], pos), np.append(t[:, 2], lcp))
                while len(code):
                    before, fits = self.before(code[:LOOK], pos[:LOOK])
                    least = np.minimum.accumulate(np.where(fits, 2 * before, np.iinfo(np.int64).max))
                    n = int(np.count_nonzero(least >= code[:LOOK]))
                    shown, new = self.batch(code[:n], pos[:n], lcp[:n], before[:n], fits[:n], lane)
                    yield (code[:n] & 1) == 0, pos[:n], shown
                    if n == 1 and new is not None and (len(code) == 1 or code[1] != code[0]):
                        skipped, new = self.along(np.array([code[0] >> 1, pos[0]]), new)
                        yield from skipped
                    code, pos, lcp = code[n:], pos[n:], lcp[n:]
                    if new is not None:
                        code, pos, lcp = in_order(np.append(code, 2 * new[:, 0]), np.append(pos, new[:, 1]), np.append(lcp, new[:, 2]))
            taken += given

    def along(self, t: np.ndarray, new: np.ndarray) -> tuple[list[tuple], np.ndarray]:
        """If a tuple t, the last of its character so far, has induced one of the same character only, and a run of that lies
        before it: the run but for its first character in one block, and the tuple of that one in place of the new one."""
        char, pos = int(t[0]), int(t[1])
        if len(new) > 1 or new[0, 0] != char:
            return [], new
        k = self.run_before(pos, char) - 1
        if k < 1:
            return [], new
        value, steps = int(new[0, 2]), np.arange(k)
        places = pos - 1 - steps
        self.last_code, self.last_pos = 2 * char, int(places[-1])
        ids = np.concatenate(self.here)
        self.carry[ids] = np.minimum(self.carry[ids], value)
        self.carry[char] = self.cap
        left = np.array([[char, pos - 1 - k, min(value + k, self.cap)]])
        return [(np.ones(k, bool), places, np.minimum(value + steps, self.cap))], left

    def run_before(self, pos: int, char: int) -> int:
        """How many characters before pos are the same as this one."""
        raw, n = self.top - char if self.mirrored else char, 0
        while pos - n > 0:
            part = np.asarray(self.text[max(0, pos - n - 4096) : pos - n])
            other = np.flatnonzero(part != raw)
            if len(other):
                return n + len(part) - 1 - int(other[-1])
            n += len(part)
        return n

    def blocks(self, code: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> Iterator[tuple]:
        """Tuples of one character and kind: none of them comes before another's."""
        for a, b in spans(len(pos)):
            shown, _ = self.batch(code[a:b], pos[a:b], lcp[a:b], *self.before(code[a:b], pos[a:b]), -1)
            yield (code[a:b] & 1) == 0, pos[a:b], shown

    def before(self, code: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Character before each position, and whether its suffix is induced: a greater one, or an equal one from its own kind."""
        before = self.char(np.maximum(pos - 1, 0))
        return before, (2 * before >= code) & (pos > 0)

    def batch(self, code: np.ndarray, pos: np.ndarray, lcp: np.ndarray, before: np.ndarray, fits: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Induce from a batch: its common prefixes with the borders put right, and new tuples of ``lane`` itself."""
        char = code >> 1
        previous = np.concatenate(([self.last_code], code[:-1]))
        lcp = np.where(previous >> 1 != char, 0, lcp)
        border = np.flatnonzero((code & 1 == 1) & (previous == code - 1))
        if len(border):
            other = np.where(border > 0, pos[border - 1], self.last_pos)
            lcp[border] = np.minimum(run_lengths(self.text, other, self.cap), run_lengths(self.text, pos[border], self.cap))
        self.last_code, self.last_pos = int(code[-1]), int(pos[-1])
        first_char, last_char, mine = int(char[0]), int(char[-1]), None
        old = self.here if self.here_char == first_char == last_char else []
        at = np.flatnonzero(fits)
        if len(at):
            chars = before[at]
            order = np.argsort(chars, kind="stable")
            at, chars = at[order], chars[order]
            first = np.concatenate(([True], chars[1:] != chars[:-1]))
            heads = np.flatnonzero(first)
            group = chars[heads]
            lo = np.where(first, 0, np.concatenate(([0], at[:-1] + 1)))
            least = least_between(lcp, lo, at)
            known = self.stamp[group] == first_char + 1
            least[heads] = np.where(known, np.minimum(least[heads], self.carry[group]), 0)
            out = np.stack((chars, pos[at] - 1, np.minimum(least + 1, self.cap)), axis=1)
            last = at[np.append(heads[1:], len(at)) - 1]
            from_here = np.minimum.accumulate(lcp[::-1])[::-1]
            rest = np.where(last + 1 < len(lcp), from_here[np.minimum(last + 1, len(lcp) - 1)], self.cap)
            lanes = self.lane_of[chars]
            cuts = np.flatnonzero(lanes[1:] != lanes[:-1]) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lanes)], strict=True):
                if lanes[i] == lane:
                    mine = out[i:j]
                else:
                    self.queue.push(int(lanes[i]), out[i:j])
        if old:
            ids = np.concatenate(old)
            self.carry[ids] = np.minimum(self.carry[ids], int(lcp.min()))
        self.here, self.here_char = old, last_char
        if len(at):
            self.carry[group], self.stamp[group] = rest, last_char + 1
            self.here = [*old, group[~known] if old else group]
        return lcp, mine


def in_order(code: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(code, kind="stable")
    return code[order], *(x[order] for x in others)


def in_memory(text: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix doubling, until ranks differ or cover ``cap`` characters."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    small = np.int32 if n < 1 << 31 else np.int64
    levels, h = [rank.astype(small)], 1
    while h < cap and rank.max() + 1 < n:
        second = np.zeros(n, np.int64)
        second[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))
        levels.append(rank.astype(small))
        h *= 2
    suffix = np.argsort(rank, kind="stable")
    off = np.zeros(n, np.int64)
    a, b = suffix[:-1], suffix[1:]
    for i in reversed(range(len(levels))):
        x, y = a + off[1:], b + off[1:]
        same = (np.maximum(x, y) < n) & (levels[i][np.minimum(x, n - 1)] == levels[i][np.minimum(y, n - 1)])
        off[1:][same] += 1 << i
    return suffix, np.minimum(off, cap)


#: What the last calls did: spills of queues, depth of recursion.
seen = {"spills": 0, "depth": 0}


def suffix_array(text: np.ndarray, cap: int, memory: int = MEMORY, base: int | None = None, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the one before). The last character must be 0 and the only one.
    base: names that are sorted in memory, by default what fits."""
    n, base = len(text), memory // NAME if base is None else base
    seen["depth"] = max(seen["depth"], depth)
    if n <= 2:
        return np.arange(n)[::-1].copy(), np.zeros(n, np.int64)
    kinds = Kinds(text, memory)
    star, m = kinds.star, len(kinds.star)
    parts = Substrings(text, star, kinds.top, memory)
    names, different = parts.names()
    deeper = (cap + 1) // 2 + 1
    if different == m:  # no two substrings are equal: the names are the order
        order, shared = array(m, np.int64, memory), array(m, np.int32, memory)
        for a, b in spans(m):
            order[names[a:b]] = np.arange(a, b)
    else:
        order, shared = in_memory(np.asarray(names), deeper) if m <= base else suffix_array(names, deeper, memory, base, depth + 1)
    del names

    # S* suffixes with their common prefixes: names that agree, then the substrings that differ, then a run cut by an S*
    seeds, seed_lcp = array(m, np.int64, memory), array(m, np.int32, memory)
    for lo, hi in spans(m):
        y, l = np.asarray(order[lo:hi]), np.asarray(shared[lo:hi]).astype(np.int64)
        x = np.append(order[lo - 1] if lo else y[0], y[:-1])
        lcp = np.full(hi - lo, cap, np.int64)
        whole = np.flatnonzero(l < deeper)
        if lo == 0:
            lcp[0], whole = 0, whole[whole > 0]
        a, b = x[whole] + l[whole], y[whole] + l[whole]
        common = parts.common(a, b)
        ended = ((common == parts.length(a)) | (common == parts.length(b))) & (common > 0)
        more = np.zeros(len(common), np.int64)
        e = np.flatnonzero(ended)
        more[e] = np.minimum(run_lengths(text, star[a[e]] + common[e] - 1, cap), run_lengths(text, star[b[e]] + common[e] - 1, cap)) - 1
        lcp[whole] = np.minimum(cap, star[a] - star[x[whole]] + common + more)
        seeds[lo:hi], seed_lcp[lo:hi] = star[y], lcp
    del order, shared

    # L suffixes, upwards
    total = int(kinds.l.sum())
    l_pos, l_lcp, filled = array(total, np.int64, memory), array(total, np.int32, memory), 0
    up = Induction(text, kinds.top, False, cap, memory, kinds.l, kinds.stars, lambda a, b: (np.asarray(seeds[a:b]), np.asarray(seed_lcp[a:b]).astype(np.int64)))
    for induced, pos, lcp in up.run():
        k = int(induced.sum())
        l_pos[filled : filled + k], l_lcp[filled : filled + k] = pos[induced], lcp[induced]
        filled += k
    seen["spills"] += up.queue.spills
    del seeds, seed_lcp, up

    # S suffixes, downwards; the result is filled from its end
    def downwards(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        lcp = np.zeros(b - a, np.int64)
        lo = total - b
        after = np.asarray(l_lcp[lo + 1 : total - a + 1]).astype(np.int64)  # shared with the next one upwards
        lcp[b - a - len(after) :] = after[::-1]
        return np.asarray(l_pos[lo : total - a])[::-1], lcp

    suffix, values = array(n, np.int64, memory), array(n, np.int32, memory)
    down, at = Induction(text, kinds.top, True, cap, memory, kinds.s, kinds.l, downwards), n
    for _, pos, lcp in down.run():
        suffix[at - len(pos) : at], values[at - len(pos) : at] = pos[::-1], lcp[::-1]
        at -= len(pos)
    seen["spills"] += down.queue.spills
    suffix[0] = n - 1  # the end of the text
    # values[i] is shared with the next suffix upwards
    carried = 0
    for lo, hi in spans(n):
        part = values[lo:hi].copy()
        values[lo:hi] = np.append(carried, part[:-1])
        carried = part[-1]
    values[0] = 0
    return suffix, values
