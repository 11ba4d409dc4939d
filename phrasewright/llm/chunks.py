"""Tables of distinct chunks of text: what is worked out once for a chunk is joined back wherever it stands."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

#: Entries beyond which a table starts anew; what was in use shortly before is taken over. This bounds its memory only.
TABLE_ENTRIES = 250_000


class ChunkTable(dict):
    """chunk -> value. The distinct chunks of many texts that are not yet known are worked out in one call."""

    def __init__(self, work: Callable[[list[str]], Iterable]):
        super().__init__()
        self.work, self.old = work, {}

    def learn(self, chunked: list[list[str]]) -> None:
        """Make the table hold every chunk of these texts."""
        if len(self) > TABLE_ENTRIES:
            self.old = dict(self)
            self.clear()
        missing = set().union(*chunked).difference(self.keys())
        if self.old and missing:
            known = missing & self.old.keys()
            self.update((c, self.old[c]) for c in known)
            missing -= known
        if missing:
            own = list(missing)
            self.update(zip(own, self.work(own), strict=True))


def text_slices(texts: list[str], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters; one longer text is taken alone."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


#: White space on which regex engines and Unicode versions differ; texts with it are given to the library whole.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


def odd_space(text: str) -> bool:
    return _ODD.search(text) is not None
