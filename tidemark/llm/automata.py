"""Automata over code points that are scanned in parallel: chunks as functions of states, composed in order.

What a chunk does to any text before it is one function: for each state in which the chunk may be entered, the
state in which it is left and how many units end inside it. Functions compose associatively, so chunks
can be scanned anywhere and in any order, and the state in which each is entered follows from their functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: For each entry state the state left in, and the units that end.
Function = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Automaton:
    """State 0 is the first. ``classes`` names the class of characters, 0 is that of all others.

    ``step[state][class]`` is the next state, ``ends[state][class]`` how many units end with such a character, and
    ``last[state]`` how many more the end of the text ends.
    """

    classes: dict[str, int]
    step: tuple[tuple[int, ...], ...]
    ends: tuple[tuple[int, ...], ...]
    last: tuple[int, ...]

    @cached_property
    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(class by code, next state by class, ends by class, classes of which one character is as good as a run)."""
        lookup = np.zeros(max(map(ord, self.classes), default=0) + 2, np.uint8)
        for character, of in self.classes.items():
            lookup[ord(character)] = of
        step, ends = np.array(self.step, np.int64).T, np.array(self.ends, np.int64).T
        again = np.take_along_axis(step, step, 1) == step
        return lookup, step, ends, again.all(1) & (ends == 0).all(1)

    def _events(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The classes of the text's characters without repetitions that change nothing, and where they stand."""
        lookup, _, _, idle = self._tables
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        found = lookup[np.minimum(codes, len(lookup) - 1)]
        fresh = np.ones(len(found), bool)
        fresh[1:] = (found[1:] != found[:-1]) | ~idle[found[1:]]
        at = np.flatnonzero(fresh)
        return found[at], at

    def function(self, text: str) -> Function:
        """What the text does from every state: neighbours are composed until one function is left."""
        _, step, ends, _ = self._tables
        found, _ = self._events(text)
        if not len(found):
            return self.identity
        to, counts = step[found], ends[found]
        while len(to) > 1:
            even = len(to) // 2 * 2
            first, then = to[0:even:2], to[1:even:2]
            met = np.take_along_axis(then, first, 1)
            sums = counts[0:even:2] + np.take_along_axis(counts[1:even:2], first, 1)
            to, counts = np.concatenate([met, to[even:]]), np.concatenate([sums, counts[even:]])
        return to[0], counts[0]

    @property
    def identity(self) -> Function:
        n = len(self.step)
        return np.arange(n), np.zeros(n, np.int64)

    def where(self, text: str, state: int, wanted: Sequence[int]) -> list[int]:
        """After how many characters of a text that is entered in ``state`` each of ``wanted`` units has ended.

        ``wanted`` is ascending; 0 stands before the text, and what does not end in it at its end.
        """
        found, at = self._events(text)
        places, seen = [0 if k == 0 else len(text) for k in wanted], 0
        open_ = [i for i, k in enumerate(wanted) if k > 0]
        for of, place in zip(found.tolist(), at.tolist(), strict=True):
            if not open_:
                break
            seen, state = seen + self.ends[state][of], self.step[state][of]
            while open_ and wanted[open_[0]] <= seen:
                places[open_.pop(0)] = place + 1
        return places


def composed(functions: Sequence[Function], states: int) -> Function:
    """One function that does what all do in order."""
    to, counts = np.arange(states), np.zeros(states, np.int64)
    for then, more in functions:
        to, counts = np.asarray(then)[to], counts + np.asarray(more)[to]
    return to, counts


def entered(functions: Sequence[Function], state: int) -> list[tuple[int, int]]:
    """(state, units ended before) in which each function is entered, and after them that in which the last is left."""
    seen, out = 0, [(state, 0)]
    for to, counts in functions:
        seen, state = seen + int(counts[state]), int(to[state])
        out.append((state, seen))
    return out


def holding(marks: Sequence[str]) -> Automaton:
    """Whether any of the marks has been met: the last state is never left. Other states are beginnings of marks."""
    starts = sorted({m[:i] for m in marks for i in range(len(m))}, key=lambda s: (len(s), s))
    letters = sorted({c for m in marks for c in m})
    done = len(starts)

    def after(held: str, character: str) -> int:
        text = held + character
        ends = [text[i:] for i in range(len(text) + 1)]
        return done if any(e in marks for e in ends) else next(starts.index(e) for e in ends if e in starts)

    step = [(0, *(after(s, c) for c in letters)) for s in starts] + [(done,) * (len(letters) + 1)]
    none = tuple((0,) * (len(letters) + 1) for _ in step)
    return Automaton({c: i for i, c in enumerate(letters, 1)}, tuple(step), none, (0,) * len(step))


def side_by_side(units: Automaton, other: Automaton) -> Automaton:
    """Both at one time: state ``i * n + j`` stands for ``i`` of ``units`` and ``j`` of the n states of ``other``."""
    letters = sorted({*units.classes, *other.classes})
    pairs = [(0, 0)] + [(units.classes.get(c, 0), other.classes.get(c, 0)) for c in letters]
    n = len(other.step)
    states = [(i, j) for i in range(len(units.step)) for j in range(n)]
    return Automaton(
        {c: k for k, c in enumerate(letters, 1)},
        tuple(tuple(units.step[i][a] * n + other.step[j][b] for a, b in pairs) for i, j in states),
        tuple(tuple(units.ends[i][a] for a, _ in pairs) for i, _ in states),
        tuple(units.last[i] for i, _ in states),
    )


def ended_by(characters: str) -> Automaton:
    """Units that each of the characters ends; what follows the last of them is a unit too."""
    return Automaton({c: 1 for c in characters}, ((1, 0), (1, 0)), ((0, 1), (0, 1)), (0, 1))


#: Lines with their line feeds, and words each with a blank after it.
LINES, WORDS = ended_by("\n"), ended_by(" \t\n\r")
