"""Suffix automata over words."""

from __future__ import annotations

from collections.abc import Iterable


class SuffixAutomaton:
    """Generalised suffix automaton over sequences of hashable symbols; no run crosses two sequences."""

    __slots__ = ("link", "longest", "step", "ends")

    def __init__(self):
        self.step: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.longest: list[int] = [0]
        #: how many (weighted) sequence positions end in the state itself, before passing them up the links
        self.ends: list[int] = [0]

    def split(self, at: int, symbol, into: int) -> int:
        """State of at's longest run followed by the symbol, made by cloning ``into`` if that holds longer runs too."""
        want = self.longest[at] + 1
        if self.longest[into] == want:
            return into
        clone = len(self.step)
        self.step.append(self.step[into].copy())
        self.link.append(self.link[into])
        self.longest.append(want)
        self.ends.append(0)
        self.link[into] = clone
        step, link = self.step, self.link
        while at >= 0 and step[at].get(symbol) == into:
            step[at][symbol] = clone
            at = link[at]
        return clone

    def add(self, sequence: Iterable, weight: int = 1) -> None:
        last, step, link, longest = 0, self.step, self.link, self.longest
        for symbol in sequence:
            nxt = step[last].get(symbol)
            if nxt is not None:
                last = self.split(last, symbol, nxt)
            else:
                new = len(step)
                step.append({})
                link.append(0)
                longest.append(longest[last] + 1)
                self.ends.append(0)
                at = last
                while at >= 0 and symbol not in step[at]:
                    step[at][symbol] = new
                    at = link[at]
                if at >= 0:
                    link[new] = self.split(at, symbol, step[at][symbol])
                last = new
            self.ends[last] += weight

    def occurrences(self) -> list[int]:
        """Weighted number of positions at which each state's runs end."""
        total = self.ends[:]
        for s in sorted(range(1, len(total)), key=self.longest.__getitem__, reverse=True):
            if self.link[s] > 0:
                total[self.link[s]] += total[s]
        return total

    def holding(self, length: int) -> list[int]:
        """For each state whose runs reach ``length``: the state of its runs' last ``length`` symbols; else -1."""
        link, longest, found = self.link, self.longest, [-1] * len(self.link)
        for s in sorted(range(len(found)), key=longest.__getitem__):
            if longest[s] >= length:
                found[s] = s if longest[link[s]] < length else found[link[s]]
        return found

    def walk(self, sequence: Iterable):
        """(state, length) of the longest run ending at each position: the matching statistics."""
        step, link, longest = self.step, self.link, self.longest
        state, length = 0, 0
        for symbol in sequence:
            nxt = step[state].get(symbol)
            while nxt is None and state:
                state = link[state]
                length = longest[state]
                nxt = step[state].get(symbol)
            if nxt is None:
                length = 0
            else:
                state, length = nxt, length + 1
            yield state, length
