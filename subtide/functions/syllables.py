"""Pinyin syllables as an automaton that Spark runs: which words can be split into syllables.

The syllable list (each syllable also with the suffix r) and the toned nasals are compiled
once into one transition array over letters; a word is accepted by a fold over its letters
that looks up one number a letter, without trying splits.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from subtide import resources as R

#: Toned letters and the plain ones; v is written for ü, toned nasals have letters of their own.
TONED = "āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜvńňǹḿ"
PLAIN = "aaaaeeeeiiiioooouuuuüüüüüNNNM"
ALPHABET = "abcdefghijklmnopqrstuwxyzüNM"
DEAD, START = 0, 1


def spellings() -> set[str]:
    """What a syllable can look like in plain letters."""
    toned = {s.replace(x, x.upper()) for s in R.NASAL_SYLLABLES for x in "mn" if x in s}
    return set(R.SYLLABLES) | {s + "r" for s in R.SYLLABLES} | toned


def automaton(words: Iterable[str], alphabet: str = ALPHABET) -> tuple[list[int], list[bool]]:
    """Transitions (state * letters + letter) and accepting states for one or more of the words in a row.

    A state is the set of the beginnings of words that can be open; the empty one is open wherever a word has ended.
    """
    words = set(words)
    begun = {w[:i] for w in words for i in range(len(w) + 1)}
    number: dict[frozenset[str], int] = {frozenset(): DEAD, frozenset(("",)): START}
    queue, moves = [frozenset(), frozenset(("",))], []
    for state in queue:
        for c in alphabet:
            open_ = {b + c for b in state if b + c in begun}
            after = frozenset(open_ | ({""} if open_ & words else set()))
            if after not in number:
                number[after] = len(number)
                queue.append(after)
            moves.append(number[after])
    return moves, ["" in state and i != START for i, state in enumerate(queue)]


@cache
def _tables() -> tuple[str, str]:
    moves, accepts = automaton(spellings())
    return ",".join(map(str, moves)), ",".join("1" if yes else "0" for yes in accepts)


def plain(text: Column) -> Column:
    """Lower case without tones, ü kept."""
    return F.translate(F.lower(text), TONED, PLAIN)


def is_syllabic(word: Column) -> Column:
    """Whether a word of ``plain`` letters is one syllable after another."""
    moves, accepts = (F.split(F.lit(x), ",").cast("array<int>") for x in _tables())
    step = lambda state, c: F.when(F.instr(F.lit(ALPHABET), c) > 0, F.element_at(moves, state * len(ALPHABET) + F.instr(F.lit(ALPHABET), c))).otherwise(DEAD)
    state = F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), F.lit(START), step)
    return F.element_at(accepts, state + 1) == 1


def chunks(line: Column) -> Column:
    """Runs of letters of a line in ``plain`` letters; an apostrophe parts syllables, so it parts runs as well."""
    return F.regexp_extract_all(plain(line), F.lit(r"\p{L}+"), F.lit(0))


def looks_like_pinyin(line: Column) -> Column:
    """A line with letters, all of whose words split into syllables."""
    found = chunks(line)
    return (F.size(found) > 0) & F.forall(found, is_syllabic)
