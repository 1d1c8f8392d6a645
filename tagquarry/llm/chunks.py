"""Distinct-chunk tables: each distinct chunk of text is segmented once.

A table maps a chunk to its ids as little-endian 32-bit bytes, so that a document's ids are the
table's entries joined by position. A shared, read-only part may come with the task; the task's own part is
emptied when it has MAX_ENTRIES, which bounds its memory; results do not depend on it.
"""

from __future__ import annotations

#: Entries after which a task's own part starts anew (about 200 bytes each).
MAX_ENTRIES = 150_000
#: Longer chunks are segmented anew each time, so that the bound on entries bounds bytes.
MAX_CHARS = 256


class ChunkTable:
    """chunk -> ids as bytes. `segment` maps a list of chunks to a list of their ids."""

    def __init__(self, segment, shared: dict | None = None, most: int | None = None):
        self.segment, self.shared, self.most = segment, shared or {}, most or MAX_ENTRIES
        self.table = dict(self.shared)

    def _own(self) -> dict:
        if len(self.table) - len(self.shared) >= self.most:
            self.table = dict(self.shared)
        return self.table

    def encode(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each text, given as its chunks in order."""
        table = self._own()
        new = list(set().union(*texts).difference(table))
        table.update(zip(new, self.segment(new)))
        out = [b"".join(map(table.__getitem__, chunks)) for chunks in texts]
        for chunk in new:
            if len(chunk) > MAX_CHARS:
                del table[chunk]
        return out

    def look_up(self, chunks: list[str]) -> list[bytes]:
        """The ids of each of these distinct chunks."""
        table = self._own()
        out = list(map(table.get, chunks))
        missing = [i for i, ids in enumerate(out) if ids is None]
        new = [chunks[i] for i in missing]
        for i, chunk, ids in zip(missing, new, self.segment(new)):
            out[i] = ids
            if len(chunk) <= MAX_CHARS:
                table[chunk] = ids
        return out
