"""Orphan references over a stream of load files: the stored state is advanced by each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from mnemospark.operators import orphans
from mnemospark.store import Scratch


class OrphanSink:
    """A ``foreachBatch`` sink over an ``OrphanStore``.

    ``split`` turns a micro-batch into references, parents and deletions.  With a
    ``root`` that lasts the state outlives the process: a stream that starts again from
    its checkpoint goes on with the stored state, and a batch number that was already
    applied is skipped, so a replay changes nothing.  Without one the state is that of
    ``scratch``; a given ``state`` is what an empty store starts from.
    """

    def __init__(
        self, state: orphans.OrphanState, scratch: Scratch, split: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame | None]], root: str | None = None
    ) -> None:
        self.split = split
        self.store = orphans.OrphanStore(scratch.spark, root or scratch.folder())
        if self.store.batch < 0 and not state.is_empty:
            self.store.start(state)

    @property
    def state(self) -> orphans.OrphanState:
        return self.store.state()

    def __call__(self, batch: DataFrame, number: int) -> None:
        # batch 0 is the state that the store started from
        self.store.apply(number + 1, *self.split(batch))
