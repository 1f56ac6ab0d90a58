"""Key/value routing over a stream of batches: foreachBatch with the closed form over the key's earlier records."""

from __future__ import annotations

from pyspark.sql import DataFrame

from palimpsest.operators.route_kv import route_batches
from palimpsest.sources.store import Store


def route_into(store: Store):
    """A foreachBatch function: routes the batch's events after all earlier ones of their keys, and commits events and
    routes together.

    Earlier events of the batch's keys alone are read again; a retried batch replaces what it wrote."""

    def take(events: DataFrame, batch_id: int) -> None:
        keys = events.select("sample", "key").distinct()
        known = events
        if store.has("events"):
            earlier = store.log("events").filter(f"batch_id < {int(batch_id)}").join(keys, ["sample", "key"], "left_semi")
            known = earlier.drop("batch_id").unionByName(events)
        fresh = events.select("sample", "key", "batch", "item")
        routed = route_batches(known).join(fresh, ["sample", "key", "batch", "item"], "left_semi")
        store.append_batch(batch_id, events=events, routes=routed)

    return take
