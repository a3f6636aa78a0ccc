"""Merges of byte-level BPE, learned from words that may lie in several tasks.

Each task holds the words of its share in one array of ids. What a step changes is summed over all
tasks, which then know the same totals and take the same next merge, so the merges are those of all
words whatever the shares. The driver gets only the names.
"""

from __future__ import annotations

import heapq
import secrets
import socket
from collections.abc import Callable

import numpy as np

from ..sources.workers import give_back

#: Between words, and a place that a merge took. Ids stay below.
SEP, HOLE = 0xFFFF, 0xFFFE
#: Places looked at together when all pairs are counted, and by how much the least total falls from one such count to the next.
CHUNK, FALL = 1 << 20, 8
WAIT = 600.0


class Alone:
    """One task has all words."""

    rank, size = 0, 1

    def gather(self, message: bytes) -> list[bytes]:
        return [message]


class Peers:
    """The tasks of a barrier stage: the first one takes a message of each, by a socket, and gives them to all. A lost one ends the stage, which Spark runs again."""

    def __init__(self):
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        self.rank, hosts = context.partitionId(), [t.address.rsplit(":", 1)[0] for t in context.getTaskInfos()]
        self.size, key = len(hosts), secrets.token_hex(16)
        listening = socket.create_server(("", 0), backlog=self.size) if self.rank == 0 else None
        said = context.allGather(f"{listening.getsockname()[1]} {key}" if listening else "")  # takes a second, so only this once
        port, key = said[0].split()
        self.links: list[socket.socket] = []
        if listening:
            listening.settimeout(WAIT)
            while len(self.links) < self.size - 1:
                link = self._ready(listening.accept()[0])
                if secrets.compare_digest(self._read(link, len(key)), key.encode()):
                    self.links.append(link)
                else:
                    link.close()
            listening.close()
        else:
            self.links.append(self._ready(socket.create_connection((hosts[0], int(port)), WAIT)))
            self.links[0].sendall(key.encode())

    @staticmethod
    def _ready(link: socket.socket) -> socket.socket:
        link.settimeout(WAIT)
        link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
        return link

    @staticmethod
    def _read(link: socket.socket, n: int) -> bytes:
        out = bytearray(n)
        view = memoryview(out)
        while n:
            if not (got := link.recv_into(view[-n:], n)):
                raise ConnectionError("a task that learns merges is gone")
            n -= got
        return bytes(out)

    def _take(self, link: socket.socket) -> bytes:
        return self._read(link, int.from_bytes(self._read(link, 8), "little"))

    def gather(self, message: bytes) -> list[bytes]:
        """All tasks' messages, in one order for all."""
        framed = lambda m: len(m).to_bytes(8, "little") + m
        if self.rank:
            self.links[0].sendall(framed(message))
            return [self._take(self.links[0]) for _ in range(self.size)]
        all_ = [message, *(self._take(link) for link in self.links)]
        for link in self.links:
            link.sendall(b"".join(map(framed, all_)))
        return all_

    def close(self) -> None:
        for link in self.links:
            link.close()


def _sums(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, ascending, and what they add up to."""
    order = np.argsort(pairs, kind="stable")
    pairs = pairs[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[first], np.add.reduceat(n[order], first) if len(first) else n


class Share:
    """The words of one task: ids[p] is the id that starts at place p, tail[p] the one that ends there, width the bytes of each id."""

    def __init__(self, text: bytes, length: np.ndarray, weight: np.ndarray, size: int):
        if size > HOLE:
            raise ValueError(f"{size} ids are more than {HOLE}")
        ends = np.cumsum(length + 1)
        n = int(ends[-1]) + 1 if len(ends) else 1
        body = np.ones(n, bool)
        body[0], body[ends] = False, False
        self.ids = np.full(n, SEP, np.uint16)
        self.ids[body] = np.frombuffer(text, np.uint8)
        self.tail = self.ids.copy()
        self.word = np.zeros(n, np.int32)
        self.word[1:] = np.repeat(np.arange(len(length), dtype=np.int32), length + 1)
        self.weight = weight.astype(np.int64)
        self.width = np.ones(size, np.int64)
        self.places: dict[int, np.ndarray] = {}

    def _pairs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of these that have an id behind them, and their pairs."""
        a = self.ids[at].astype(np.int64)
        b = self.ids[at + self.width[a]]
        ok = b != SEP
        return at[ok], a[ok] << 16 | b[ok].astype(np.int64)

    def _chunks(self):
        for i in range(0, len(self.ids), CHUNK):
            yield self._pairs(np.flatnonzero(self.ids[i : i + CHUNK] < HOLE) + i)

    def _before(self, at: np.ndarray) -> np.ndarray:
        """Where the ids before these places start, of those that have one in their word."""
        t = self.tail[at - 1]
        ok = t != SEP
        return at[ok] - self.width[t[ok]]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs and how often they stand in this share."""
        pairs, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for at, p in self._chunks():
            p, w = _sums(p, self.weight[self.word[at]])
            pairs, n = _sums(np.concatenate([pairs, p]), np.concatenate([n, w]))
        return pairs, n

    def list_places(self, pairs: np.ndarray) -> None:
        """Keeps the places of the given pairs, ascending, and of no others."""
        kind = np.int32 if len(self.ids) < 1 << 31 else np.int64
        found = [(np.empty(0, kind), np.empty(0, np.int32))]
        for at, p in self._chunks():
            row = np.minimum(np.searchsorted(pairs, p), len(pairs) - 1)
            ok = pairs[row] == p
            found.append((at[ok].astype(kind), row[ok].astype(np.int32)))
        at, row = (np.concatenate(x) for x in zip(*found, strict=True))
        found.clear()
        order = np.argsort(row, kind="stable")
        at, row = at[order], row[order]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        self.places = dict(zip(pairs[row[first]].tolist(), np.split(at, first[1:]), strict=True)) if len(first) else {}

    def merge(self, pair: int, new: int) -> tuple[np.ndarray, np.ndarray]:
        """Merges a pair from left to right; what that adds to pairs, places of new ones kept."""
        a, b = pair >> 16, pair & 0xFFFF
        self.width[new] = self.width[a] + self.width[b]
        at = self.places.pop(pair, np.empty(0, np.int32)).astype(np.int64)
        at = at[self.ids[at] == a]
        at = at[self.ids[at + self.width[a]] == b]
        if a == b:  # in a run of one id every second place starts a merge
            start = np.flatnonzero(np.r_[True, at[:-1] + self.width[a] != at[1:]])[: len(at)]
            run = np.repeat(start, np.diff(np.r_[start, len(at)]))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        if not len(at):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        second = at + self.width[a]
        gone, gone_pairs = self._pairs(np.unique(np.concatenate([self._before(at), at, second])))
        gone_n = self.weight[self.word[gone]]
        self.ids[at], self.ids[second], self.tail[at + self.width[new] - 1] = new, HOLE, new
        made, made_pairs = self._pairs(np.unique(np.concatenate([self._before(at), at])))
        order = np.argsort(made_pairs, kind="stable")
        made, made_pairs = made[order], made_pairs[order]
        first = np.flatnonzero(np.diff(made_pairs, prepend=-1))
        if len(first):
            self.places.update(zip(made_pairs[first].tolist(), np.split(made.astype(np.int32 if len(self.ids) < 1 << 31 else np.int64), first[1:]), strict=True))
        return _sums(np.concatenate([gone_pairs, made_pairs]), np.concatenate([-gone_n, self.weight[self.word[made]]]))


def learn(share: Share, size: int, peers: Alone | Peers) -> list[bytes]:
    """The names of 256 bytes and of the most frequent pairs, ties by the smaller ids.

    A pair's total never grows once the later of its ids is made, so pairs below `least` are left out
    until no other is left; then all pairs are counted again, from a smaller `least` on.
    """
    names = [bytes([i]) for i in range(256)]
    total: dict[int, int] = {}
    heap: list[tuple[int, int]] = []  # an entry whose count isn't the pair's any more is void

    def shared(*arrays: np.ndarray) -> list[np.ndarray]:
        """All tasks' arrays of one length, each kind one after the other."""
        got = [np.frombuffer(m, np.int64).reshape(len(arrays), -1) for m in peers.gather(np.stack(arrays).astype(np.int64).tobytes())]
        return list(np.concatenate(got, axis=1))

    def count(least: int, first: bool) -> int:
        pairs, n = share.pairs()
        every = np.unique(shared(pairs[n * peers.size >= least])[0])  # a pair of that total has as much in one task at least
        own = np.zeros(len(every), np.int64)
        if len(pairs) and len(every):
            i = np.minimum(np.searchsorted(pairs, every), len(pairs) - 1)
            own = np.where(pairs[i] == every, n[i], 0)
        every, sums = _sums(*shared(every, own))
        if first and len(sums):
            least = max(1, int(sums.max()) // FALL)
        every, sums = every[sums >= least], sums[sums >= least]
        total.clear()
        total.update(zip(every.tolist(), sums.tolist(), strict=True))
        heap[:] = [(-k, p) for p, k in total.items()]
        heapq.heapify(heap)
        share.places = {}
        if len(every):
            share.list_places(every)
        return least

    least = count(1, True)
    while len(names) < size:
        if not heap:
            if least == 1:
                break
            least = count(max(1, least // FALL), False)
            continue
        n, best = heapq.heappop(heap)
        if total.get(best) != -n:
            continue
        new = len(names)
        names.append(names[best >> 16] + names[best & 0xFFFF])
        pairs, n = share.merge(best, new)
        is_new = (pairs >> 16 == new) | (pairs & 0xFFFF == new)
        known = is_new | np.fromiter((p in total for p in pairs.tolist()), bool, len(pairs))
        pairs, n = _sums(*shared(pairs[known], n[known]))
        for pair, k in zip(pairs.tolist(), n.tolist(), strict=True):
            k += total.get(pair, 0)
            if k >= least:
                total[pair] = k
                heapq.heappush(heap, (-k, pair))
            else:
                total.pop(pair, None)
                share.places.pop(pair, None)
        total.pop(best, None)
    return names


def learner(size: int, peers: Callable[[], Alone | Peers]):
    """A mapInPandas function: (token, n) to (rank, token), the same for any number of tasks; the first one's rows are the result."""

    def run(frames):
        import pandas as pd

        text, length, weight = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for frame in frames:
            words = frame["token"].tolist()
            text.append(b"".join(words))
            length.append(np.fromiter(map(len, words), np.int64, len(words)))
            weight.append(frame["n"].to_numpy(np.int64))
        share = Share(b"".join(text), np.concatenate(length), np.concatenate(weight), size)
        del text, length, weight
        among = peers()
        names = learn(share, size, among)
        if among.size > 1:
            among.close()
        del share
        give_back()
        if among.rank == 0:
            yield pd.DataFrame({"rank": np.arange(len(names)), "token": names})

    return run
