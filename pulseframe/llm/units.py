"""Splits texts into units that a byte-level BPE tokenizer encodes independently, so that each distinct one is done once.

The pre-token pattern attaches one space to the word after it. Hence a place between a non-space and a single space that
a non-space follows is always the border of two pre-tokens, and a text may be cut there. What lies between two such
places is a unit. A text in which spaces meet other white space is taken as one unit. Nothing is cut off or skipped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The white space that ``\s`` means in the tokenizer library, as a property of Unicode.
_SPACE, _NO_SPACE = r"\p{White_Space}", r"\P{White_Space}"
#: Texts are taken together up to this many bytes.
_CHUNK = 16 << 20
#: Keys beyond this length are not remembered.
_LONGEST = 64
#: Distinct units that are made together.
_AHEAD = 50_000


def pretokens(pattern: str) -> Callable[[str], list[str]]:
    """The function that splits a text by a pre-token pattern as the tokenizer library does."""
    return regex.compile(pattern.replace(r"\s", _SPACE).replace(r"\S", _NO_SPACE)).findall


class Bounded(dict):
    """Remembers what ``make`` returned for a key, in two generations of at most ``most`` entries each.

    When the younger one is full it becomes the older one, and what is asked for again moves back: frequent keys stay.
    ``make_many`` does the same for a list of keys.
    """

    def __init__(self, make: Callable[[str], object], most: int, make_many: Callable[[list[str]], list] | None = None):
        super().__init__()
        self._make, self._most, self._make_many, self._older = make, most, make_many, {}

    def __missing__(self, key: str) -> object:
        value = self._older.get(key)
        if value is None:
            value = self._make(key)
        self._remember(key, value)
        return value

    def _remember(self, key: str, value: object) -> None:
        if len(key) <= _LONGEST:
            if len(self) >= self._most:
                self._older = dict(self)
                self.clear()
            self[key] = value

    def ahead(self, keys: Iterable[str]) -> None:
        """Makes those of the keys that are not remembered, all together; they will be asked for next."""
        older = self._older
        new = list({k for k in keys if k not in self and k not in older and len(k) <= _LONGEST})
        for key, value in zip(new, self._make_many(new) if new else ()):
            self._remember(key, value)


def chunks(text: pa.Array, most: int = _CHUNK) -> Iterator[pa.Array]:
    """Slices of an array of strings, each of about ``most`` bytes; a longer text stands alone."""
    lengths = pc.fill_null(pc.binary_length(text), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield text.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield text.slice(start)


def encode_texts(text: pa.Array, encode: Callable[[str], object],
                 ahead: Callable[[Iterable[str]], object] | None = None) -> Iterator[list]:
    """For each text the list of what ``encode`` returns for its units; ``encode`` should remember frequent ones.

    ``ahead`` is told of units that are to be encoded next.
    """
    for part in chunks(pc.fill_null(text, "").cast(pa.large_string())):
        pieces = pc.split_pattern(part, " ")
        coded = pieces.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        loose = {i for i, w in enumerate(words) if not w or w[0].isspace() or w[-1].isspace()}
        values = []
        for a in range(0, len(words), _AHEAD):
            units = [None if i in loose else " " + w for i, w in enumerate(words[a:a + _AHEAD], a)]
            if ahead:
                ahead(u for u in units if u is not None)
            values += [None if u is None else encode(u) for u in units]
        index, ends = coded.indices.to_numpy(), pieces.offsets.to_numpy().tolist()
        first = ends[0]
        for k, whole in enumerate(part):
            own = index[ends[k] - first:ends[k + 1] - first].tolist()
            if loose and not loose.isdisjoint(own):
                yield [encode(whole.as_py())]
            else:
                yield [encode(words[own[0]]), *map(values.__getitem__, own[1:])]
