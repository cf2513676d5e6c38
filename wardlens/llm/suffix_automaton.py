"""A suffix automaton over words, for the longest match that ends at each word of another text."""

from __future__ import annotations


class SuffixAutomaton:
    """Accepts all runs of words of the texts added to it; grows with each text."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _extend(self, last: int, word) -> int:
        nexts, link, length = self.next, self.link, self.length
        if word in nexts[last]:  # the run is known, perhaps as part of a longer state
            q = nexts[last][word]
            return q if length[q] == length[last] + 1 else self._split(last, q, word)
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and word not in nexts[p]:
            nexts[p][word] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, word)
        return new

    def _split(self, p: int, q: int, word) -> int:
        nexts, link, length = self.next, self.link, self.length
        copy = len(nexts)
        nexts.append(dict(nexts[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nexts[p].get(word) == q:
            nexts[p][word] = copy
            p = link[p]
        return copy

    def add(self, words: list) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def matches(self, words: list) -> list[int]:
        """For each word, the length of the longest run ending there that the automaton accepts."""
        nexts, link, length = self.next, self.link, self.length
        state, size, out = 0, 0, []
        for word in words:
            while state and word not in nexts[state]:
                state = link[state]
                size = length[state]
            if word in nexts[state]:
                state = nexts[state][word]
                size += 1
            out.append(size)
        return out
