"""Suffix automata: every substring of a text in linear space, and longest matches against it."""

from __future__ import annotations

import numpy as np


class SuffixAutomaton:
    """States of the minimal automaton of all substrings; a separator in the text keeps matches from crossing it."""

    def __init__(self, text: str = "") -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        self.last = 0
        for ch in text:
            self.extend(ch)

    def extend(self, ch: str) -> None:
        new = self._state(self.length[self.last] + 1, {})
        p = self.last
        while p >= 0 and ch not in self.next[p]:
            self.next[p][ch] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][ch]
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                copy = self._state(self.length[p] + 1, dict(self.next[q]))
                self.link[copy] = self.link[q]
                while p >= 0 and self.next[p].get(ch) == q:
                    self.next[p][ch] = copy
                    p = self.link[p]
                self.link[q] = self.link[new] = copy
        self.last = new

    def _state(self, length: int, edges: dict[str, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def matches(self, text: str) -> list[int]:
        """For each position of `text` the length of the longest substring of the automaton's text that ends there."""
        out, state, size = [], 0, 0
        nexts, link, length = self.next, self.link, self.length
        for ch in text:
            while state and ch not in nexts[state]:
                state = link[state]
                size = length[state]
            to = nexts[state].get(ch)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            out.append(size)
        return out

    def phrases(self, text: str) -> int:
        """Number of phrases when `text` is parsed into longest matches; a character that never occurs is a phrase of its own."""
        count, i = 0, 0
        while i < len(text):
            state, j = 0, i
            while j < len(text) and text[j] in self.next[state]:
                state = self.next[state][text[j]]
                j += 1
            count, i = count + 1, max(j, i + 1)
        return count


def covered(matches: list[int], least: int) -> int:
    """How many positions lie in a match of at least `least` characters."""
    count, upto = 0, 0
    for end, size in enumerate(matches, 1):
        if size >= least:
            count += end - max(upto, end - size)
            upto = end
    return count


class Walkers:
    """Suffix automata of several texts as arrays, walked by many lanes at once, a character of each lane a step.

    Most states have one way on, kept as its character and target; those with more have a row of targets, as wide as their text's alphabet.
    """

    def __init__(self, texts: dict[str, str]) -> None:
        self.names = sorted(texts)
        self.sizes = np.array([max(2, len(texts[n])) for n in self.names])
        chars = sorted(set().union(*texts.values()))
        self.chars = np.array([ord(ch) for ch in chars], dtype=np.int64)  # number i + 1 stands for chars[i], 0 for any other character
        self.local = np.zeros((len(self.names), len(chars) + 1), dtype=np.int32)
        row, only, target, link, length, table, self.roots = [], [], [], [], [], [], []
        for i, name in enumerate(self.names):
            own = sorted(set(texts[name]))
            at = {ch: k for k, ch in enumerate(own, 1)}
            self.local[i, np.searchsorted(self.chars, [ord(ch) for ch in own]) + 1] = np.arange(1, len(own) + 1)
            a, base = SuffixAutomaton(texts[name]), len(row)
            self.roots.append(base)
            for edges in a.next:
                if len(edges) == 1:
                    ((ch, to),) = edges.items()
                    row.append(-1), only.append(at[ch]), target.append(base + to)
                else:
                    row.append(len(table)), only.append(-1), target.append(-1)
                    ways = [-1] * (len(own) + 1)
                    for ch, to in edges.items():
                        ways[at[ch]] = base + to
                    table += ways
            link += [base + x if x >= 0 else base for x in a.link]
            length += a.length
        self.row, self.only, self.target, self.link, self.length, self.table, self.roots = (np.array(x, dtype=np.int32) for x in (row, only, target, link, length, table or [-1], self.roots))

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """The characters' numbers."""
        if not len(self.chars):
            return np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)
        return np.where(self.chars[at] == codes, at + 1, 0)

    def step(self, state: np.ndarray, ch: np.ndarray) -> np.ndarray:
        """Next states; -1 where there is no way on."""
        row = self.row[state]
        return np.where(row < 0, np.where(self.only[state] == ch, self.target[state], -1), self.table[np.maximum(row, 0) + np.where(row < 0, 0, ch)])

    def _lanes(self, spans: np.ndarray, which: np.ndarray, number: np.ndarray):
        """Lanes in falling length; for each step the characters of those that still go on."""
        order = np.argsort(spans[:, 0] - spans[:, 1], kind="stable")
        starts, left, which = spans[order, 0], (spans[:, 1] - spans[:, 0])[order], which[order]
        going = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), side="left")  # lanes longer than t
        return order, which, ((n, starts[:n] + t, self.local[which[:n], number[starts[:n] + t]]) for t, n in enumerate(going))

    def matches(self, number: np.ndarray, spans: np.ndarray, which: np.ndarray, most: int, put) -> None:
        """`put(which, places, lengths)` for each step: the longest match that ends at each place within its span, `most` at most."""
        order, which, steps = self._lanes(spans, which, number)
        root = self.roots[which]
        state, size = root.copy(), np.zeros(len(root), np.int32)
        for n, places, ch in steps:
            s, z = state[:n], size[:n]
            to = self.step(s, ch)
            stuck = np.flatnonzero((to < 0) & (s != root[:n]))
            while len(stuck):
                s[stuck] = self.link[s[stuck]]
                z[stuck] = self.length[s[stuck]]
                to[stuck] = found = self.step(s[stuck], ch[stuck])
                stuck = stuck[(found < 0) & (s[stuck] != root[stuck])]
            state[:n] = np.where(to < 0, root[:n], to)
            size[:n] = np.where(to < 0, 0, z + 1)
            put(which[:n], places, np.minimum(size[:n], most))

    def phrases(self, number: np.ndarray, spans: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Number of phrases of each span, parsed into longest matches; a character that never occurs is a phrase of its own."""
        order, which, steps = self._lanes(spans, which, number)
        root = self.roots[which]
        state, count = root.copy(), np.zeros(len(root), np.int64)
        for n, _, ch in steps:
            to = self.step(state[:n], ch)
            ended = np.flatnonzero((to < 0) & (state[:n] != root[:n]))
            count[ended] += 1
            to[ended] = self.step(root[ended], ch[ended])
            alone = to < 0
            count[:n] += alone
            state[:n] = np.where(alone, root[:n], to)
        count += state != root
        out = np.empty_like(count)
        out[order] = count
        return out
