"""Levenshtein automata over a lexicon trie."""

from __future__ import annotations


class Lexicon:
    """Finds the terms within a few edits of a word.

    An edit leaves out, adds or replaces a letter, or swaps two neighbours, no
    letter twice.  The automaton reads a word letter by letter.  A state is the
    set of trie nodes that the letters so far may stand for, each with its least
    number of edits, and of nodes that the next letter completes a swap to, with
    that letter; transitions are worked out when first taken and remembered, so a
    common word costs one lookup per letter and most words die after a few.
    """

    #: Transitions remembered at most; beyond that they are worked out anew.
    MEMORY = 100_000

    def __init__(self, terms: list[str], edits_for=lambda term: int(len(term) >= 5)):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        #: Edits that the terms below a node allow at most, and those of a term.
        self.budget: list[int] = [0]
        self.own: dict[int, int] = {}
        for term in terms:
            self.add(term, edits_for(term))
        start = self.closed({0: 0})
        self.states = [start]
        self.number = {self.frozen(start): 0}
        self.moves: dict[tuple[int, str], int] = {}

    def add(self, term: str, edits: int) -> None:
        at = 0
        self.budget[0] = max(self.budget[0], edits)
        for letter in term:
            if letter not in self.children[at]:
                self.children[at][letter] = len(self.children)
                self.children.append({})
                self.term.append(None)
                self.budget.append(0)
            at = self.children[at][letter]
            self.budget[at] = max(self.budget[at], edits)
        self.term[at] = term
        self.own[at] = edits

    @staticmethod
    def frozen(state: dict[int, int]) -> frozenset:
        return frozenset(state.items())

    def put(self, state: dict, node: int, edits: int, awaited: str = "") -> bool:
        """Note a node unless it is over its budget or known with fewer edits."""
        key = (node, awaited) if awaited else node
        if edits <= self.budget[node] and edits < state.get(key, edits + 1):
            state[key] = edits
            return True
        return False

    def closed(self, state: dict[int, int]) -> dict[int, int]:
        """The state with letters of terms that the word leaves out."""
        waiting = [node for node in state if isinstance(node, int)]
        while waiting:
            node = waiting.pop()
            for child in self.children[node].values():
                if self.put(state, child, state[node] + 1):
                    waiting.append(child)
        return state

    def after(self, state: dict[int, int], letter: str) -> dict[int, int]:
        reached: dict[int, int] = {}
        for node, edits in state.items():
            if isinstance(node, tuple):
                if node[1] == letter:
                    self.put(reached, node[0], edits)
                continue
            self.put(reached, node, edits + 1)
            for own, child in self.children[node].items():
                self.put(reached, child, edits + (own != letter))
                if own != letter and letter in self.children[child]:
                    self.put(reached, self.children[child][letter], edits + 1, own)
        return self.closed(reached)

    def step(self, number: int, letter: str) -> int:
        if len(self.moves) > self.MEMORY:
            del self.states[1:]
            self.number = {self.frozen(self.states[0]): 0}
            self.moves = {}
            raise KeyError(letter)
        state = self.after(self.states[number], letter)
        key = self.frozen(state)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(state)
        self.moves[number, letter] = self.number[key]
        return self.number[key]

    def find(self, word: str) -> tuple[str, int] | None:
        """The term with the fewest edits, then the first by name."""
        number, moves = 0, self.moves
        try:
            for letter in word:
                to = moves.get((number, letter))
                number = self.step(number, letter) if to is None else to
                if not self.states[number]:
                    return None
        except KeyError:
            return self.find(word)
        hits = [
            (edits, self.term[node])
            for node, edits in self.states[number].items()
            if isinstance(node, int) and edits <= self.own.get(node, -1)
        ]
        if not hits:
            return None
        edits, term = min(hits)
        return term, edits
