"""Sums folded inside a task: rows of (keys, numbers) are combined by hash while whole documents stream by."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

ROWS_HELD = 600_000


class Fold:
    """Adds up ``sums`` per ``keys``.  When the combined rows still fill half of ``limit`` they are
    spilled: handed out, and the fold starts anew; whoever merges the spills by key gets the full sums.
    A fold that does not spill, for keys whose number is bounded, combines whenever its rows have doubled."""

    def __init__(self, keys: list[str], sums: list[str], limit: int = ROWS_HELD, spills: bool = True):
        self.keys, self.sums, self.limit, self.spills = keys, sums, limit, spills
        self.held: list[pa.Table] = []
        self.rows = 0

    def combined(self) -> pa.Table:
        rows = pa.concat_tables(self.held).combine_chunks()
        out = rows.group_by(self.keys, use_threads=False).aggregate([(s, "sum") for s in self.sums])
        return out.rename_columns([c.removesuffix("_sum") for c in out.column_names]).select(self.keys + self.sums)

    def add(self, rows: pa.Table) -> Iterator[pa.Table]:
        self.held.append(rows)
        self.rows += rows.num_rows
        if self.rows >= self.limit:
            whole = self.combined()
            if not self.spills:
                self.limit = max(self.limit, 2 * whole.num_rows)
            if self.spills and whole.num_rows >= self.limit // 2:
                self.held, self.rows = [], 0
                yield whole
            else:
                self.held, self.rows = [whole], whole.num_rows

    def rest(self) -> Iterator[pa.Table]:
        if self.held:
            yield self.combined()
        self.held, self.rows = [], 0
