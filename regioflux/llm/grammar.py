"""Probabilistic automata inferred from sample strings by merging compatible states of their prefix tree."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

#: Classes of characters that formats tell apart; other characters stand for themselves.
CLASSES = {
    **dict.fromkeys("0123456789", "0"),
    **dict.fromkeys("abcdef", "a"),
    **dict.fromkeys("ghijklmnopqrstuvwxyz", "g"),
    **dict.fromkeys("ABCDEF", "A"),
    **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "G"),
}
_SIZE = {"0": 10, "a": 6, "g": 20, "A": 6, "G": 20}
#: Probability that an automaton gives to all symbols and ends it has not seen in a state.
UNSEEN = 0.01
#: Error that each of Hoeffding's tests is allowed.
ALPHA = 0.05


def shape(text: str) -> str:
    return "".join(CLASSES.get(c, c) for c in text)


class Automaton(NamedTuple):
    """Per state: log-probability of each next symbol and of the end. rare: of anything unseen."""

    moves: list[dict[str, tuple[int, float]]]
    ends: list[float]
    rare: float

    def score(self, text: str) -> float:
        """Log-likelihood of a text per character, the end counted as one."""
        state, total = 0, 0.0
        for symbol in shape(text):
            step = self.moves[state].get(symbol)
            if step is None:
                total += self.rare
                state = 0
            else:
                state, log = step
                total += log - math.log(_SIZE.get(symbol, 1))
        return (total + self.ends[state]) / (len(text) + 1)


class _State:
    __slots__ = ("arrived", "ended", "next", "taken")

    def __init__(self) -> None:
        self.arrived = self.ended = 0
        self.next: dict[str, _State] = {}
        self.taken: dict[str, int] = {}


def _prefix_tree(texts: list[str]) -> _State:
    root = _State()
    for text in texts:
        state = root
        state.arrived += 1
        for symbol in shape(text):
            state.taken[symbol] = state.taken.get(symbol, 0) + 1
            state = state.next.setdefault(symbol, _State())
            state.arrived += 1
        state.ended += 1
    return root


def _differ(f1: int, n1: int, f2: int, n2: int, bound: float) -> bool:
    """Hoeffding's test of two shares."""
    return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def _compatible(a: _State, b: _State, bound: float) -> bool:
    pairs = [(a, b)]
    while pairs:
        p, q = pairs.pop()
        if _differ(p.ended, p.arrived, q.ended, q.arrived, bound):
            return False
        for symbol in p.taken.keys() | q.taken.keys():
            if _differ(p.taken.get(symbol, 0), p.arrived, q.taken.get(symbol, 0), q.arrived, bound):
                return False
            if symbol in p.next and symbol in q.next and p.next[symbol] is not q.next[symbol]:
                pairs.append((p.next[symbol], q.next[symbol]))
    return True


def _fold(into: _State, tree: _State) -> None:
    """Adds the counts of a subtree to an automaton state and what follows it."""
    pairs = [(into, tree)]
    while pairs:
        p, q = pairs.pop()
        p.arrived += q.arrived
        p.ended += q.ended
        for symbol, n in q.taken.items():
            p.taken[symbol] = p.taken.get(symbol, 0) + n
            if symbol not in q.next:
                continue
            if symbol in p.next:
                pairs.append((p.next[symbol], q.next[symbol]))
            else:
                p.next[symbol] = q.next[symbol]


def _merged(root: _State, alpha: float) -> list[_State]:
    """Visits all states next to the accepted ones in rounds. In each, all are tested with the counts at its beginning, in order of accepted state and symbol; a state
    is merged into the first accepted one that it does not differ from, and the first that differs from all is accepted itself."""
    bound = hoeffding(alpha)
    accepted = [root]
    while True:
        known_ones = {id(x) for x in accepted}
        fringe = [(i, symbol) for i, x in enumerate(accepted) for symbol in sorted(x.next) if id(x.next[symbol]) not in known_ones]
        if not fringe:
            return accepted
        merges, new = decided(fringe, len(accepted), lambda at, k: not _compatible(accepted[k], accepted[at[0]].next[at[1]], bound))
        more = [accepted[i].next[symbol] for i, symbol in new]
        for (i, symbol), k in merges.items():
            state = accepted[i].next[symbol]
            accepted[i].next[symbol] = accepted[k]
            _fold(accepted[k], state)
        accepted += more


def hoeffding(alpha: float) -> float:
    return math.sqrt(0.5 * math.log(2 / alpha))


def decided(fringe: list[tuple[int, str]], known: int, differ: Callable[[tuple[int, str], int], bool]) -> tuple[dict[tuple[int, str], int], list[tuple[int, str]]]:
    """A round: the states to merge, with the accepted state that each goes into, and the one (if any) to accept."""
    merges: dict[tuple[int, str], int] = {}
    new: list[tuple[int, str]] = []
    for at in fringe:
        into = next((k for k in range(known) if not differ(at, k)), None)
        if into is not None:
            merges[at] = into
        elif not new:
            new = [at]
    return merges, new


def _moves(accepted: list[_State]) -> list[dict[str, int]]:
    number = {id(x): i for i, x in enumerate(accepted)}
    return [{s: number[id(x)] for s, x in state.next.items() if id(x) in number} for state in accepted]


def _weighted(moves: list[dict[str, int]], taken: list[dict[str, int]], ended: list[int]) -> Automaton:
    """An automaton of these moves with the shares of what was counted in each state. What has no move leads to the first state."""
    keep = 1 - UNSEEN
    logs, ends = [], []
    for to, counts, end in zip(moves, taken, ended, strict=True):
        n = max(sum(counts.values()) + end, 1)
        logs.append({s: (to.get(s, 0), math.log(keep * c / n)) for s, c in counts.items()})
        ends.append(math.log(keep * end / n) if end else math.log(UNSEEN / 64))
    return Automaton(logs, ends, math.log(UNSEEN / 64))


def infer(texts: list[str], alpha: float = ALPHA) -> Automaton:
    accepted = _merged(_prefix_tree(sorted(texts)), alpha)
    return _weighted(_moves(accepted), [x.taken for x in accepted], [x.ended for x in accepted])


def structure(nodes: dict[int, dict[str, int]], child: Callable[[int, str, int], int], alpha: float = ALPHA) -> list[dict[str, int]]:
    """The moves of the automaton of a prefix tree that was counted elsewhere: the symbols after each prefix, "" for the end.

    child: the number of the prefix that a symbol makes of one, which has this length; the empty prefix is 0. A prefix that is not among the nodes leads to the first state.
    """
    state: dict[int, _State] = {}
    for number, taken in nodes.items():
        made = state[number] = _State()
        made.arrived, made.ended = sum(taken.values()), taken.get("", 0)
        made.taken = {s: taken[s] for s in sorted(taken) if s}
    if 0 not in state:
        return [{}]
    level, length = [0], 0
    while level:
        below = []
        for number in level:
            for symbol in state[number].taken:
                to = child(number, symbol, length)
                if to in state:
                    state[number].next[symbol] = state[to]
                    below.append(to)
        level, length = below, length + 1
    return _moves(_merged(state[0], alpha))


def walk(moves: list[dict[str, int]], text: str, counts: dict[tuple[int, str], int]) -> None:
    """Adds what a text takes in each state, "" for its end."""
    state = 0
    for symbol in shape(text):
        counts[state, symbol] = counts.get((state, symbol), 0) + 1
        state = moves[state].get(symbol, 0)
    counts[state, ""] = counts.get((state, ""), 0) + 1


#: Numbers of the nodes below a fringe state are polynomials of the symbols.
_PRIME, _BASE = (1 << 61) - 1, 1_907_246_513_806_392_517


def visits(moves: list[dict[str, int]], text: str) -> Iterator[tuple[int, str, int, tuple[int, ...] | None]]:
    """The nodes that a text passes, each with the symbol taken there ("" for the end), the fringe state that it is below, and where each accepted state comes by the same symbols.

    Accepted state s is node -1 - s and below none (-1). Fringe state f, s * 256 + the symbol that s has no move for, is node f, and the nodes below have numbers made of f and the symbols.
    """
    symbols = shape(text)
    state, here = 0, 0
    while here < len(symbols) and symbols[here] in moves[state]:
        yield -1 - state, symbols[here], -1, None
        state = moves[state][symbols[here]]
        here += 1
    yield -1 - state, symbols[here : here + 1], -1, None
    if here == len(symbols):
        return

    def after(node: int, symbol: str) -> int:
        if node >= 0:
            return (node * _BASE + ord(symbol) + 1) % _PRIME
        to = moves[-1 - node].get(symbol)
        return -1 - to if to is not None else (-1 - node) * 256 + ord(symbol)

    fringe = node = state * 256 + ord(symbols[here])
    others = tuple(-1 - s for s in range(len(moves)))
    for symbol in symbols[here + 1 :]:
        yield node, symbol, fringe, others
        node = after(node, symbol)
        others = tuple(after(x, symbol) for x in others)
    yield node, "", fringe, others


def weighted(moves: list[dict[str, int]], counts: dict[tuple[int, str], int]) -> Automaton:
    """The automaton of these moves with the shares that walks have counted."""
    taken: list[dict[str, int]] = [{} for _ in moves]
    for (state, symbol), n in counts.items():
        if symbol:
            taken[state][symbol] = n
    return _weighted(moves, taken, [counts.get((i, ""), 0) for i in range(len(moves))])
