"""The model's views, registered by name over frames in their declared schemas (SRC4)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import funnel as V
from ..operators import history as H
from . import tables as S

#: Each view with the tables and views that it needs, and how it is made of them.
VIEWS: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {
    "v_observation": (("observation", "override"), V.effective),
    "v_entity_resolved": (("entity",), lambda e: V.resolved(e).select("entity_id", F.col("resolved_id").alias("live_entity_id"))),
    "v_field_current": (("field_value",), H.current_values),
    "v_stage_transition": (("v_observation",), lambda o: V.transitions(o).select("entity_id", "from_date", F.col("meeting_date").alias("to_date"), F.col("from_stage").alias("from_stage_id"), F.col("stage_id").alias("to_stage_id"), "delta")),
    "v_entity_funnel": (("v_observation",), V.entity_funnel),
    "v_entity_latest_stage": (("v_observation",), lambda o: V.latest(o).select("entity_id", F.col("meeting_date").alias("last_seen"), F.col("stage_id").alias("latest_stage_id"))),
    "v_entity_discussion": (("v_observation",), V.entity_discussion),
    "v_dwell": (("v_observation",), V.dwell),
    "v_worklist": (("v_entity_funnel", "v_entity_discussion", "v_entity_resolved"), lambda f, d, e: e.select("entity_id").join(f.select("entity_id", "furthest", "last_seen"), "entity_id", "left").join(d.select("entity_id", "times"), "entity_id", "left")),
}


def order(views: dict | None = None) -> list[str]:
    """The views in an order in which each comes after those it needs; raises where they need each other."""
    views = VIEWS if views is None else views
    done: list[str] = []

    def visit(name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise ValueError(" needs ".join((*above, name)))
        for other in views[name][0]:
            if other in views:
                visit(other, (*above, name))
        if name not in done:
            done.append(name)

    for name in views:
        visit(name, ())
    return done


def register(tables: dict[str, DataFrame], views: dict | None = None) -> list[str]:
    """Registers the tables in their declared schemas and every view that can be made of them as temporary views; tables that aren't given are empty. Returns the names."""
    views = VIEWS if views is None else views
    spark = next(iter(tables.values())).sparkSession
    frames = {name: S.conform(tables[name], schema) if name in tables else spark.createDataFrame([], schema) for name, schema in S.SCHEMAS.items()}
    for name in order(views):
        needed, make = views[name]
        frames[name] = make(*(frames[n] for n in needed))
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    return list(frames)
