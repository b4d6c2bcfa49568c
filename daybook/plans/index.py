"""Bringing the chunk index up to date: changed days are chunked anew, and the table and its markers change at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from daybook.operators.chunks import index_markers, sync_chunks
from daybook.sources.chunk_store import ChunkStore
from daybook.sources.shared import cut


def sync_index(store: ChunkStore, drafts: DataFrame, changed: DataFrame, live_days: DataFrame, now_ms: int) -> DataFrame:
    """Commits sync_chunks and index_markers for the changed days and those without sources, and gives the report (owner_id, day, added, removed).

    drafts are hash_chunks() rows of the changed days. Other days are neither read nor written. Without a change there is no commit.
    """
    live = live_days.select("owner_id", "day").distinct()
    dead = store.index_days().select("owner_id", "day").unionByName(store.chunks().select("owner_id", "day")).distinct().join(live, ["owner_id", "day"], "left_anti")
    days = sorted(r.day for r in changed.select("day").unionByName(dead.select("day")).distinct().collect())
    after, report = sync_chunks(store.chunks(days), drafts, changed, live)
    report = cut(report)
    if days:
        store.commit(after, index_markers(changed, drafts, store.index_days(days), live, now_ms), days)
    return report
