"""Generalised suffix automaton over word sequences."""

from __future__ import annotations

from array import array


class SuffixAutomaton:
    """All word runs of a set of items, for streaming texts past it.

    A text word moves the automaton to the longest run of item words that ends there.  Runs of ``window`` words, and
    whole items that are shorter, count as occurrences.
    """

    def __init__(self, items: list[list[str | bytes]], window: int) -> None:
        self.window = window
        self.words: dict[str | bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])
        coded = [[self.words.setdefault(w, len(self.words)) for w in words] for words in items]
        for codes in coded:
            self._add(codes)
        self._name(coded)

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of state q for the runs that reach it from p, one word longer than p's."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _add(self, codes: list[int]) -> None:
        last = 0
        for c in codes:
            q = self.next[last].get(c)
            if q is not None:  # the run is known from an earlier item
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
            last = new

    def _name(self, coded: list[list[int]]) -> None:
        """Which items an occurrence stands for."""
        window, link, length = self.window, self.link, self.length
        #: Per state with long runs: the state of their last ``window`` words.
        self.tail = array("i", bytes(4 * len(length)))
        self.inside: dict[int, set[int]] = {}
        self.short: dict[int, tuple[int, set[int]]] = {}
        order = sorted(range(len(length)), key=length.__getitem__)
        for v in order:
            if length[v] >= window:
                self.tail[v] = v if length[link[v]] < window else self.tail[link[v]]
        for number, codes in enumerate(coded):
            v = 0
            for at, c in enumerate(codes):
                v = self.next[v][c]  # an item's own words never leave the automaton
                if at + 1 >= window:
                    u = v
                    if length[u] >= window:
                        self.inside.setdefault(self.tail[u], set()).add(number)
            if codes and len(codes) < window:
                while length[link[v]] >= len(codes):
                    v = link[v]
                self.short.setdefault(v, (len(codes), set()))[1].add(number)
        #: Per state: the longest suffix state, itself included, that ends a short item; -1 for none.
        self.ends = array("i", [-1]) * len(length)
        for v in order:
            self.ends[v] = v if v in self.short else (self.ends[link[v]] if v else -1)
        self.shortest = min([window, *(k for k, _ in self.short.values())])

    def spans(self, words: list[str | bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans (first and last word) of all occurrences in a text, and the numbers of their items."""
        next_, link, tail, ends, window, shortest = self.next, self.link, self.tail, self.ends, self.window, self.shortest
        length, found, hit = self.length, [], set()
        v = matched = 0
        last_tail = -1
        for at, c in enumerate(map(self.words.get, words)):
            if c is None:
                v = matched = 0
                continue
            while v and c not in next_[v]:
                v = link[v]
                matched = length[v]
            u = next_[v].get(c)
            if u is None:
                matched = 0
                continue
            v, matched = u, matched + 1
            if matched < shortest:
                continue
            size = 0
            if matched >= window:
                size = matched
                if tail[v] != last_tail:
                    last_tail = tail[v]
                    hit |= self.inside[last_tail]
            u = ends[v]
            while u >= 0:
                k, numbers = self.short[u]
                if k <= matched:
                    size = max(size, k)
                    hit |= numbers
                u = ends[link[u]]
            if size:
                first = at - size + 1
                while found and found[-1][1] >= first - 1:
                    first = min(first, found.pop()[0])
                found.append((first, at))
        return found, hit
