"""Weighted finite-state transducers over the word classes of a line, and their composition.

A transducer is data: states, and for each state and class an arc to a next state with a factor and, where a pattern ends, what it gives.
Running transducers in step is running their product, which ``composed`` builds once as a table. Those that must know
what stands before a word read forwards, those that must know what follows it read backwards; a word's factors from
both directions are multiplied. A line end brings every transducer back to its start, so lines are read one by one.
"""

from __future__ import annotations

from typing import NamedTuple

#: Word classes: other words, offences, threats, persons, negations, reporting verbs, quotation marks, commas and colons, ends of
#: sentences, ends of lines.
W, O, T, P, N, R, Q, C, S, L = range(10)
CLASSES = range(10)
#: What an arc gives: nothing, the offence's own weight, or the weight of a threat.
NOTHING, OFFENCE, THREAT = range(3)

State = tuple[str, int]
Arc = tuple[State, float, int]


class Transducer(NamedTuple):
    start: State
    arcs: dict[tuple[State, int], Arc]


class Factors(NamedTuple):
    """The weights of the patterns."""

    lone: float = 1.0  # an offence by itself
    run: float = 1.1  # an offence right after another
    threat: float = 1.0  # a threat with a person after it
    aimed: float = 1.25  # an offence near a person, on either side
    negated: float = 0.5
    reported: float = 0.5
    mentioned: float = 0.75  # within quotation marks that no reporting verb stands before


class Scopes(NamedTuple):
    """Words that a pattern spans."""

    threat: int = 4
    target: int = 4
    negation: int = 3
    report: int = 8
    speaker: int = 3  # between what is said and the verb after it


def _machine(start: State, states: list[State], arc) -> Transducer:
    return Transducer(start, {(s, c): arc(s, c) for s in states for c in CLASSES})


def insults(factors: Factors, scopes: Scopes) -> Transducer:
    """Offences, alone or one after the other, and threats that a person follows."""
    none, run = ("none", 0), ("run", 0)

    def arc(state: State, c: int) -> Arc:
        kind, left = state
        if c == O:
            return run, factors.run if kind == "run" else factors.lone, OFFENCE
        if c == T:
            return ("threat", scopes.threat), 1.0, NOTHING
        if c == P and kind == "threat":
            return none, factors.threat, THREAT
        if kind == "threat" and left > 1 and c not in (C, S, L):
            return ("threat", left - (c != Q)), 1.0, NOTHING
        return none, 1.0, NOTHING

    return _machine(none, [none, run, *[("threat", k) for k in range(1, scopes.threat + 1)]], arc)


def _after(mark: int, scope: int, ends: tuple[int, ...], weighted: tuple[int, ...], factor: float) -> Transducer:
    """A factor for the ``weighted`` classes up to ``scope`` words after a mark."""

    def arc(state: State, c: int) -> Arc:
        left = state[1]
        if c == mark:
            return ("in", scope), 1.0, NOTHING
        if c in ends:
            return ("out", 0), 1.0, NOTHING
        after = left if c == Q else max(left - 1, 0)
        return ("in" if after else "out", after), factor if left and c in weighted else 1.0, NOTHING

    return _machine(("out", 0), [("out", 0), *[("in", k) for k in range(1, scope + 1)]], arc)


def targets(factors: Factors, scopes: Scopes) -> Transducer:
    """Persons near an offence; it is run in both directions."""
    return _after(P, scopes.target, (C, S, L), (O,), factors.aimed)


def negations(factors: Factors, scopes: Scopes) -> Transducer:
    return _after(N, scopes.negation, (C, S, L), (O, P), factors.negated)


def reports(factors: Factors, scopes: Scopes) -> Transducer:
    """What follows a reporting verb, in quotation marks up to their end, else for some words; and other quotations."""
    plain, quoted, opened = ("plain", 0), ("quoted", 0), ("opened", 0)

    def arc(state: State, c: int) -> Arc:
        kind, left = state
        if c == L:
            return plain, 1.0, NOTHING
        if c == Q:
            return {"plain": opened, "verb": quoted}.get(kind, plain), 1.0, NOTHING
        factor = {"plain": 1.0, "opened": factors.mentioned}.get(kind, factors.reported) if c in (O, P) else 1.0
        if kind in ("quoted", "opened"):
            return state, factor, NOTHING
        if c == R:
            return ("verb", scopes.report), 1.0, NOTHING
        if kind == "plain" or c == S:
            return plain, factor, NOTHING
        after = left if c == C else left - 1
        return ("verb", after) if after else plain, factor, NOTHING

    return _machine(plain, [plain, quoted, opened, *[("verb", k) for k in range(1, scopes.report + 1)]], arc)


def sayings(factors: Factors, scopes: Scopes) -> Transducer:
    """Read backwards: what stands before a comma or quotation mark that a reporting verb follows."""
    plain, quoted, said = ("plain", 0), ("quoted", 0), ("said", 0)

    def arc(state: State, c: int) -> Arc:
        kind, left = state
        if c == L:
            return plain, 1.0, NOTHING
        if kind == "quoted":
            return plain if c == Q else quoted, factors.reported if c in (O, P) else 1.0, NOTHING
        if kind == "said":
            return (quoted if c == Q else plain if c in (C, S) else said), factors.reported if c in (O, P) else 1.0, NOTHING
        if c == R:
            return ("verb", scopes.speaker + 1), 1.0, NOTHING
        if kind == "verb" and c == Q:
            return quoted, 1.0, NOTHING
        if kind == "verb" and c == C:
            return said, 1.0, NOTHING
        return ("verb", left - 1) if kind == "verb" and left > 1 and c != S else plain, 1.0, NOTHING

    return _machine(plain, [plain, quoted, said, *[("verb", k) for k in range(1, scopes.speaker + 2)]], arc)


class Product(NamedTuple):
    """The composition as tables: by state, then class."""

    to: list[list[int]]
    factor: list[list[float]]
    gives: list[list[int]]


def composed(*machines: Transducer) -> Product:
    """The product of transducers: all states reached from the start, their arcs' factors multiplied."""
    start = tuple(m.start for m in machines)
    number, waiting = {start: 0}, [start]
    product = Product([], [], [])
    for states in waiting:  # grows as states are found
        to, factor, gives = [], [], []
        for c in CLASSES:
            arcs = [m.arcs[s, c] for m, s in zip(machines, states, strict=True)]
            after = tuple(a[0] for a in arcs)
            if after not in number:
                number[after] = len(number)
                waiting.append(after)
            weight = 1.0
            for a in arcs:
                weight *= a[1]
            to.append(number[after])
            factor.append(weight)
            gives.append(max(a[2] for a in arcs))
        product.to.append(to)
        product.factor.append(factor)
        product.gives.append(gives)
    return product


def machines(factors: Factors = Factors(), scopes: Scopes = Scopes()) -> tuple[list[Transducer], list[Transducer]]:
    """Those that read forwards, and those that read backwards."""
    return [insults(factors, scopes), targets(factors, scopes), negations(factors, scopes), reports(factors, scopes)], [targets(factors, scopes), sayings(factors, scopes)]


def _products() -> tuple[Product, Product]:
    forwards, backwards = machines()
    return composed(*forwards), composed(*backwards)


FORWARDS, BACKWARDS = _products()


def line_scores(classes: list[int], weights: list[float]) -> tuple[float, int]:
    """(sum of the scores of a line's clauses, clauses with a match)."""
    factors = [1.0] * len(classes)
    state = 0
    to, factor = BACKWARDS.to, BACKWARDS.factor
    for i in range(len(classes) - 1, -1, -1):
        c = classes[i]
        factors[i] = factor[state][c]
        state = to[state][c]
    state, total, clause, matched = 0, 0.0, 0.0, 0
    to, factor, gives = FORWARDS.to, FORWARDS.factor, FORWARDS.gives
    for i, c in enumerate(classes):
        given = gives[state][c]
        if given:
            clause += factor[state][c] * factors[i] * (weights[i] if given == OFFENCE else 1.0)
        elif c in (C, S) and clause:
            total, clause, matched = total + clause, 0.0, matched + 1
        state = to[state][c]
    return total + clause, matched + (clause > 0)
