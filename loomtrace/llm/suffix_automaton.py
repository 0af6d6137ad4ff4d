"""Suffix automata over words given as whole numbers: occurrences, factorisation, matching statistics.

A state stands for the substrings that end at the same places; it knows its longest substring's length, the first place where
they end, and how often they occur. Building takes time and memory in proportion to the words (some 400 bytes a word).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """The automaton of one or several texts. Each text ends in a separator of its own, so no match spans two of them."""

    def __init__(self, texts: Iterable[Sequence[int]]):
        follow: list[dict[int, int]] = [{}]
        link, length, ends = [-1], [0], [-1]
        own = [0]  # 1 for states of prefixes, 0 for split ones
        place, separator = -1, -1
        last = 0
        for text in texts:
            for word in (*text, separator):
                place += 1
                new = len(length)
                follow.append({})
                length.append(length[last] + 1)
                ends.append(place)
                own.append(1)
                link.append(0)
                at = last
                while at >= 0 and word not in (f := follow[at]):
                    f[word] = new
                    at = link[at]
                if at >= 0:
                    to = follow[at][word]
                    if length[to] == length[at] + 1:
                        link[new] = to
                    else:
                        split = len(length)
                        follow.append(dict(follow[to]))
                        length.append(length[at] + 1)
                        ends.append(ends[to])
                        own.append(0)
                        link.append(link[to])
                        link[to] = link[new] = split
                        while at >= 0 and follow[at].get(word) == to:
                            follow[at][word] = split
                            at = link[at]
                last = new
            separator -= 1
        self.follow, self.link, self.length, self.first_end, self._own = follow, link, length, ends, own
        self.words = place + 1

    def repeated_lengths(self) -> list[int]:
        """For every state, the length of the longest suffix of its substrings that occurs at least twice."""
        times, length, link = list(self._own), self.length, self.link
        order = sorted(range(1, len(length)), key=length.__getitem__)
        for s in reversed(order):
            if link[s] > 0:
                times[link[s]] += times[s]
        out = [0] * len(length)
        for s in order:
            out[s] = length[s] if times[s] > 1 else out[link[s]]
        return out

    def matching_statistics(self, text: Iterable[int]) -> Iterable[tuple[int, int]]:
        """(length, state) at every word: the longest suffix of what has been read that occurs in the automaton."""
        follow, link, length = self.follow, self.link, self.length
        state = matched = 0
        for word in text:
            while state and word not in follow[state]:
                state = link[state]
                matched = length[state]
            to = follow[state].get(word)
            if to is None:
                state = matched = 0
            else:
                state, matched = to, matched + 1
            yield matched, state


def factors(words: Sequence[int]) -> list[tuple[int, int, int]]:
    """Lempel-Ziv factors (begin, size, source): each is the longest prefix of the rest that begins earlier as well, at ``source``
    (it may overlap itself), or one word that is new (source -1)."""
    automaton = SuffixAutomaton([words])
    follow, first_end = automaton.follow, automaton.first_end
    out, begin, n = [], 0, len(words)
    while begin < n:
        state, at = 0, begin
        while at < n:
            to = follow[state][words[at]]
            if first_end[to] >= at:
                break
            state, at = to, at + 1
        if at == begin:
            out.append((begin, 1, -1))
            begin += 1
        else:
            out.append((begin, at - begin, first_end[state] - (at - begin) + 1))
            begin = at
    return out
