"""Lookups over the routing tables of all nodes, without writing tables or rounds out.

Bucket b of an owner holds the first nodes to arrive under a prefix of b + 1 bits, whoever the owner is.  So the tables of
all nodes are ranges of the sorted ids, and a list of arrivals for each prefix with more nodes than a bucket holds.  They
travel to the tasks, and a task takes its lookups from first to last round.
"""

from __future__ import annotations

import numpy as np

_TOP = np.uint64(2**64 - 1)
#: Ids are told apart by so many bits at most, so that a distance and a column fit into 64.
MOST_BITS = 50
_COLUMN = np.uint64(12)


def shared_bits(x: np.ndarray) -> np.ndarray:
    """Leading zero bits of 64; the bit after the first is cleared, so that no conversion rounds up to a power."""
    y = (x & ~(x >> np.uint64(1))).astype(np.float64)
    return np.minimum(1086 - (y.view(np.int64) >> 52), 64)


class Routes:
    """The tables of nodes given in order of arrival: ``words`` are the 64-bit words of their ids, a column each.

    ``fits`` says whether the first word tells all nodes apart; only then can lookups be made.  ``dead`` nodes are in the
    tables of others and give no answer.
    """

    def __init__(self, node: np.ndarray, words: np.ndarray, dead: np.ndarray | None, size: int, k: int, bits: int | None = None):
        order = np.argsort(words[:, 0], kind="stable")
        self.node, self.words, self.size, self.k, self.bits = node[order], words[order], size, k, bits
        self.dead = dead[order] if dead is not None and dead.any() else None
        self.word = np.ascontiguousarray(self.words[:, 0])
        self.by_node = np.argsort(self.node, kind="stable")
        self.in_order = self.node[self.by_node]
        self.node_rank = np.empty(len(node), np.int64)
        self.node_rank[self.by_node] = np.arange(len(node))
        shared = shared_bits(self.word[1:] ^ self.word[:-1])
        self.most = int(shared.max(initial=0))
        self.fits = self.most <= MOST_BITS and k <= size and size + k < 1 << int(_COLUMN) and (bits is None or bits <= 64)
        self.shift = np.uint64(63 - min(self.most, 63))
        self.keys, self.lists = np.zeros(0, np.int64), np.zeros((0, size), np.int32)
        if self.fits:
            self._arrivals(np.argsort(order), shared)

    @classmethod
    def of(cls, parts: dict) -> Routes:
        out = cls.__new__(cls)
        vars(out).update(parts)
        return out

    def _arrivals(self, at: np.ndarray, shared: np.ndarray) -> None:
        """For every prefix with more nodes than ``size`` the first to arrive; ``at`` are places in order of arrival."""
        keys, lists = [self.keys], [self.lists]
        for p in range(self.most + 1):
            first = np.flatnonzero(np.r_[True, shared < p]) if len(at) else np.zeros(0, np.int64)
            many = np.diff(np.r_[first, len(at)]) > self.size
            if not many.any():
                break
            group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(at)]))[at]
            held = at[many[group]]
            group = group[many[group]]
            by = np.argsort(group, kind="stable")
            begins = np.searchsorted(group[by], np.flatnonzero(many))
            lists.append(held[by[begins[:, None] + np.arange(self.size)]].astype(np.int32))
            keys.append((p << 40) + first[many])
        self.keys, self.lists = np.concatenate(keys), np.concatenate(lists)

    def places(self, node: np.ndarray) -> np.ndarray:
        """Where living nodes are, else -1."""
        if not len(self.node):
            return np.full(len(node), -1)
        at = self.by_node[np.minimum(np.searchsorted(self.in_order, node), len(self.node) - 1)]
        found = self.node[at] == node
        if self.dead is not None:
            found &= ~self.dead[at]
        return np.where(found, at, -1)

    def _under(self, t: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of nodes that share ``p`` bits with ``t``."""
        free = np.where(p < 64, _TOP >> np.minimum(p, 63).astype(np.uint64), np.uint64(0))
        return np.searchsorted(self.word, t & ~free), np.searchsorted(self.word, t | free, "right")

    def _nearest(self, t: np.ndarray, at: np.ndarray, there: np.ndarray, k: int) -> np.ndarray:
        key, column = self._sorted(t, at, there, k)
        return np.where(key == _TOP, -1, np.take_along_axis(at, column, 1))

    def _sorted(self, t: np.ndarray, at: np.ndarray, there: np.ndarray, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` least distances in order, the first column first where they are equal, and the columns that they stand in."""
        key = (self.word[at] ^ t[:, None]) >> self.shift
        key = np.where(there, key << _COLUMN | np.arange(at.shape[1], dtype=np.uint64), _TOP)
        key.sort(axis=1)
        key = key[:, :k]
        column = (key & np.uint64((1 << int(_COLUMN)) - 1)).astype(np.int64)
        return np.where(key == _TOP, _TOP, key >> _COLUMN), np.minimum(column, at.shape[1] - 1)

    def _answers(self, t: np.ndarray, p: np.ndarray) -> np.ndarray:
        """What an owner that shares p - 1 bits with the target answers, if its bucket there holds k or more."""
        low, high = self._under(t, p)
        at = low[:, None] + np.arange(self.size)
        there = at < high[:, None]
        at[~there] = 0
        many = np.flatnonzero(high - low > self.size)
        at[many] = self.lists[np.searchsorted(self.keys, (p[many].astype(np.int64) << 40) + low[many])]
        return self._nearest(t, at, there, self.k)

    def _ends(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The longest prefix of a target under which there are k nodes; the k + 1 nearest of all; whether buckets hold
        all nodes under the longest prefix of k + 1, so that owners there know them all.  Those on the target's side of that
        prefix are k at most, so only the other side can be too large."""
        k, n = self.k, len(self.word)
        near = np.searchsorted(self.word, t)[:, None] + np.arange(-k - 1, k + 1)
        bits = np.where((near >= 0) & (near < n), shared_bits(self.word[np.clip(near, 0, n - 1)] ^ t[:, None]), -1)
        full = np.minimum(bits[:, : k + 3], bits[:, k - 1 :]).max(axis=1)
        more = np.maximum(np.minimum(bits[:, : k + 2], bits[:, k:]).max(axis=1), 0)
        low, high = self._under(t, more)
        at = low[:, None] + np.arange(self.size + k)
        there = at < high[:, None]
        at[~there] = 0
        return full, self._nearest(t, at, there, k + 1), high - low - (bits > more[:, None]).sum(axis=1) <= self.size

    def _found(self, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Whether a node ends the search: the target itself, alive, or one that shares enough bits."""
        first = target[:, 0] if at.ndim == 1 else target[:, :1]
        some = at >= 0
        hit = some & (self.word[at] == first)
        row = np.nonzero(hit)
        hit[row] = (self.words[at[row]] == target[row[0]]).all(axis=-1)
        if self.dead is not None:
            hit &= ~self.dead[at]
        if self.bits is not None:
            hit |= some & (shared_bits(self.word[at] ^ first) >= self.bits)
        return hit

    def lookups(self, target: np.ndarray, starts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of the k nearest seen, rounds) of each target; ``starts`` are places by distance, -1 for none."""
        t = np.ascontiguousarray(target[:, 0])
        full, ends, plain = self._ends(t)
        out, rounds = np.full((len(t), self.k), -1, np.int64), np.zeros(len(t), np.int32)
        at = np.flatnonzero(plain)
        if len(at):
            out[at], rounds[at] = (self._living if self.dead is None else self._mixed)(target[at], starts[at], full[at], ends[at], most)
        for i in np.flatnonzero(~plain):
            best, rounds[i] = self._one([int(x) for x in target[i]], [int(x) for x in starts[i] if x >= 0], most)
            out[i, : len(best)] = best
        return out, rounds

    def _living(self, target, starts, full, ends, most):
        """Where all nodes live, the nearest one asked decides: k from its bucket are nearer than all before, and where that
        holds fewer, it and its answer hold the k nearest of all."""
        out, rounds, left, now, t = starts.copy(), np.zeros(len(starts), np.int32), np.arange(len(starts)), starts, target[:, 0]
        for n in range(1, most + 2):
            left = left[~self._found(now[:, 0], target[left])]
            if not len(left):
                return out, rounds
            if n > most:
                break
            now = out[left]
            bits = shared_bits(self.word[now[:, 0]] ^ t[left])
            last = bits >= full[left]
            end = left[last]
            best = ends[end, : self.k]
            new = ((best[:, :, None] != now[last][:, None, :]).all(axis=2) & (best >= 0)).any(axis=1)
            out[end], rounds[end] = best, np.where(new, n, n - 1)
            left, bits = left[~last], bits[~last]
            now = self._answers(t[left], bits + 1)
            out[left], rounds[left] = now, n
        raise RuntimeError(f"lookups are open after {most} rounds")

    def _mixed(self, target, starts, full, ends, most):
        """Some nodes are dead: what was asked stays known, and the dead that were asked are passed over."""
        k, t = self.k, np.ascontiguousarray(target[:, 0])
        out, rounds, left = np.full((len(t), k), -1, np.int64), np.zeros(len(t), np.int32), np.arange(len(t))
        now, since, asked = starts, np.zeros(starts.shape, np.int32), np.zeros(starts.shape, bool)
        for n in range(1, most + 2):
            some = now >= 0
            failed = asked & self.dead[now]
            front = some & ~asked
            done = (self._found(now, target[left]) & ~failed).any(axis=1) | ~front.any(axis=1)
            best = some & ~failed & done[:, None]
            rank = np.cumsum(best, axis=1)
            row, column = np.nonzero(best & (rank <= k))
            out[left[row], rank[row, column] - 1] = now[row, column]
            rounds[left[done]] = np.where(some, since, 0).max(axis=1)[done]
            left, now, since, asked, front = left[~done], now[~done], since[~done], asked[~done], front[~done]
            if not len(left):
                return out, rounds
            if n > most:
                break
            mine = t[left]
            owner = front & ~self.dead[now]
            bits = shared_bits(self.word[now] ^ mine[:, None])
            last = owner & (bits >= full[left][:, None])
            end = np.where(last.any(axis=1)[:, None], ends[left], -1)
            inside = (last[:, :, None] & (now[:, :, None] == end[:, None, :k])).any(axis=(1, 2))
            end[~inside, k] = -1
            # owners that share as many bits with the target give the same answer; by distance they stand together
            ask, before = owner & ~last, np.full(len(left), -1)
            for w in range(now.shape[1]):
                one = ask[:, w].copy()
                ask[:, w] &= bits[:, w] != before
                before[one] = bits[one, w]
            row, column = np.nonzero(ask)
            place = np.cumsum(ask, axis=1)
            answers = np.full((len(left), int(place[:, -1].max()), k), -1, np.int64)
            answers[row, place[row, column] - 1] = self._answers(mine[row], bits[row, column] + 1)
            cells = np.concatenate([now, end, answers.reshape(len(left), -1)], axis=1)
            new = cells.shape[1] - now.shape[1]
            since = np.pad(since, ((0, 0), (0, new)), constant_values=n)
            asked = np.pad(asked | front, ((0, 0), (0, new)))
            now, since, asked = self._kept(mine, cells, since, asked)
        raise RuntimeError(f"lookups are open after {most} rounds")

    def _kept(self, t, now, since, asked):
        """By distance, each node once, as first seen: the k nearest that have not failed, and all that were asked."""
        key, column = self._sorted(t, now, now >= 0)
        now, since, asked = (np.take_along_axis(x, column, 1) for x in (now, since, asked))
        once = key != _TOP
        once[:, 1:] &= key[:, 1:] != key[:, :-1]
        keep = once & (asked | (np.cumsum(once & ~(asked & self.dead[now]), axis=1) <= self.k))
        place = np.cumsum(keep, axis=1)
        row, column = np.nonzero(keep)
        out = [np.full((len(t), max(int(place[:, -1].max()), self.k)), fill, x.dtype) for x, fill in ((now, -1), (since, 0), (asked, False))]
        for x, y in zip(out, (now, since, asked)):
            x[row, place[row, column] - 1] = y[row, column]
        return out

    def _bucket(self, owner: int, j: int) -> list[int]:
        x = np.array([int(self.word[owner]) ^ (1 << (63 - j))], np.uint64)
        low, high = (int(v[0]) for v in self._under(x, np.array([j + 1])))
        return list(range(low, high)) if high - low <= self.size else self.lists[np.searchsorted(self.keys, ((j + 1) << 40) + low)].tolist()

    def _one(self, target: list[int], starts: list[int], most: int) -> tuple[list[int], int]:
        """One lookup bucket by bucket, where a bucket near the target is too small for those under its prefix."""
        k, t, word = self.k, target[0], self.word
        seen, asked = dict.fromkeys(starts, 0), set()

        def failed(x):
            return x in asked and self.dead is not None and bool(self.dead[x])

        def far(x):
            return int(word[x]) ^ t

        for n in range(1, most + 2):
            ranked = sorted(seen, key=lambda x: (failed(x), far(x)))
            kept = [x for r, x in enumerate(ranked) if r < k or self.dead is not None and x in asked]
            seen = {x: seen[x] for x in kept}
            front = [x for x in kept if x not in asked]
            hit = self._found(np.array([kept]), np.array([target], np.uint64))[0]
            if not front or any(h and not failed(x) for h, x in zip(hit, kept)):
                return [x for x in kept[:k] if not failed(x)], max(seen.values())
            if n > most:
                break
            asked.update(front)
            for owner in front:
                if self.dead is not None and self.dead[owner]:
                    continue
                b = min(64 - far(owner).bit_length(), self.most + 1)
                known = self._bucket(owner, b) if b <= self.most else []
                if len(known) < k:
                    known = known + [x for j in range(b + 1, self.most + 1) for x in self._bucket(owner, j)]
                while len(known) < k and b > 0:
                    b -= 1
                    known = known + self._bucket(owner, b)
                for x in sorted(known, key=far)[:k]:
                    seen.setdefault(x, n)
        raise RuntimeError(f"lookups are open after {most} rounds")


def starts_of(routes: Routes, first: np.ndarray, t: np.ndarray, known: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each lookup the rows of its k nearest starts, by distance, -1 for none.

    Rows of a lookup stand together, ``first`` marks where one begins; where no target is ``known`` nodes go by number.
    """
    group = np.cumsum(first) - 1
    out = np.full((int(group[-1]) + 1 if len(group) else 0, routes.k), -1, np.int64)
    if len(out) == len(group):
        out[:, 0] = np.where(place >= 0, np.arange(len(group)), -1)
        return out
    row = np.flatnonzero(place >= 0)
    far = np.where(known[row], (routes.word[place[row]] ^ t[row]) >> routes.shift, routes.node_rank[place[row]].astype(np.uint64))
    row = row[np.lexsort((far, group[row]))]
    row = row[np.r_[True, (group[row][1:] != group[row][:-1]) | (place[row][1:] != place[row][:-1])][: len(row)]]
    rank = np.arange(len(row)) - np.searchsorted(group[row], group[row])
    out[group[row[rank < routes.k]], rank[rank < routes.k]] = row[rank < routes.k]
    return out
