"""A dictionary of basic factors: numbers for the repeated word sequences of a text, one power-of-two length at a time.

Two places of a text have the same number at a length if the words from there on, that many, are the same.
Numbers of one length come from pairs of numbers of half of it, and only places whose sequence stands in the
text more than once are carried on: one that stands there once does so at every greater length. Texts of a batch
share the arrays, and numbers of different texts differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass(frozen=True)
class Words:
    """The words of a batch of texts, in order; those of text ``i`` stand at ``starts[i]:starts[i + 1]``."""

    words: pa.Array
    starts: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


@dataclass(frozen=True)
class Level:
    """Repeated factors of one length: their places in rising order, numbers, and steps to the next occurrence (0: last)."""

    length: int
    places: np.ndarray
    names: np.ndarray
    steps: np.ndarray


def split_words(texts: pa.Array) -> Words:
    """What stands between ASCII white space, as it is; null texts have no words."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    rows, words = pc.list_parent_indices(parts), pc.list_flatten(parts)
    filled = pc.not_equal(words, "")
    rows = pc.filter(rows, filled).to_numpy(zero_copy_only=False)
    return Words(pc.filter(words, filled), np.searchsorted(rows, np.arange(len(texts) + 1)))


def numbers(values: pa.Array) -> np.ndarray:
    """A number for each distinct value."""
    coded = values.dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _repeated(length: int, places: np.ndarray, keys: np.ndarray) -> Level:
    order = np.argsort(keys, kind="stable")  # places stay in rising order below one key
    key, place = keys[order], places[order]
    same = key[1:] == key[:-1]
    before, after = np.append(False, same), np.append(same, False)
    steps = np.zeros(len(places), np.int64)
    steps[order[:-1]] = np.where(same, place[1:] - place[:-1], 0)
    names = np.empty(len(places), np.int64)
    names[order] = np.cumsum(~before) - 1
    again = np.empty(len(places), bool)
    again[order] = before | after
    return Level(length, places[again], names[again], steps[again])


def levels(words: Words) -> Iterator[Level]:
    """The factors of 1, 2, 4, ... words that stand more than once in their text, up to the longest."""
    count = len(words.words)
    if not count:
        return
    codes = numbers(words.words)
    level = _repeated(1, np.arange(count), words.rows * (codes.max() + 1) + codes)
    while len(level.places):
        yield level
        # A factor across the end of a text needs the two halves that meet there: it stands once, and goes.
        at = np.searchsorted(level.places, level.places + level.length)
        at[at == len(level.places)] = 0
        whole = level.places[at] == level.places + level.length
        keys = level.names[whole] * (level.names.max() + 1) + level.names[at[whole]]
        level = _repeated(2 * level.length, level.places[whole], keys)
