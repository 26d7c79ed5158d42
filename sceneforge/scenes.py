"""Scenes: what to predict, from which columns, under which display names."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession, functions as F

from sceneforge import scene_catalog
from sceneforge.functions import column, flag

Hook = Callable[[DataFrame], DataFrame]

SCENE_SCHEMA = "scene_id string, name string, category string, description string, target_col string"
COLUMN_SCHEMA = "scene_id string, ordinal int, column_name string"
LABEL_SCHEMA = "scene_id string, raw_value string, label_name string"

# A scene table longer than this is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 20_000


@dataclass(frozen=True)
class Scene:
    """One prediction task over one kind of table.

    ``labels`` maps the raw target value, as text, to its display name, so text
    targets work the same way as numeric ones.
    """

    scene_id: str
    target: str
    required: tuple[str, ...] = ()
    labels: dict[str, str] = field(default_factory=dict)
    name: str = ""
    category: str = "Unclassified"
    description: str = ""
    ignored: frozenset[str] = frozenset()
    helpers: frozenset[str] = frozenset()
    oversample_cap: float = 10.0
    hook: Hook | None = None

    def prepare(self, df: DataFrame) -> DataFrame:
        """Run the scene's own preprocessing, if it has any."""
        return df.transform(self.hook) if self.hook else df


# --- building blocks for hooks (B6, B7, B8, B9) --------------------------------------


def keep_values(name: str, values: Iterable[Any]) -> Hook:
    """Keep rows with these values; a table without the column, such as an unlabeled one, stays whole."""
    wanted = list(values)
    return lambda df: df.filter(column(name).isin(wanted)) if name in df.columns else df


def drop_listed(names: Iterable[str]) -> Hook:
    doomed = list(names)
    return lambda df: df.drop(*doomed)


def add_flag(name: str, condition: str, needs: str) -> Hook:
    """Add a 0/1 column from a SQL condition when the column it is derived from is there."""
    return lambda df: df.withColumn(name, flag(F.expr(condition))) if needs in df.columns else df


def chain(*steps: Hook) -> Hook:
    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run


def built_in_hooks() -> dict[str, Hook]:
    """Severities kept, flag limits, and the quality verdict that means 1."""
    return {
        "trans_accident": keep_values("Severity", [2, 3]),
        "shop_shipping": chain(
            add_flag("High_Discount", "Discount_offered > 10", needs="Discount_offered"),
            add_flag("Is_Heavy", "Weight_in_gms > 4000", needs="Weight_in_gms"),
        ),
        "ind_quality": chain(
            add_flag("Quality", "`Pass/Fail` = 1", needs="Pass/Fail"),
            drop_listed(["Pass/Fail", *_config()["ind_quality"]["ignored"]]),
        ),
    }


# --- loading and editing -------------------------------------------------------------


def _config(text: str = scene_catalog.BUILT_IN) -> dict[str, dict]:
    """Scene entries, every scalar as text: a label named ``No`` is no boolean."""
    return yaml.load(text, Loader=yaml.BaseLoader).get("scenes") or {}


def scene_from(scene_id: str, entry: dict, hook: Hook | None = None) -> Scene:
    """Build a scene from its configuration entry; label keys may be numbers or text."""
    return Scene(
        scene_id=scene_id,
        target=entry["target"],
        required=tuple(entry.get("columns") or ()),
        labels={str(raw): str(shown) for raw, shown in (entry.get("labels") or {}).items()},
        name=entry.get("name") or scene_id,
        category=entry.get("category") or "Unclassified",
        description=entry.get("description") or f"Predict {entry['target']}",
        ignored=frozenset(entry.get("ignored") or ()),
        helpers=frozenset(entry.get("helpers") or ()),
        oversample_cap=float(entry.get("oversample_cap", 10)),
        hook=hook,
    )


def load_scenes(text: str = scene_catalog.BUILT_IN, hooks: dict[str, Hook] | None = None) -> dict[str, Scene]:
    """Read a scene file afresh; call it per job so that edits take effect at once."""
    hooks = built_in_hooks() if hooks is None else hooks
    return {sid: scene_from(sid, entry, hooks.get(sid)) for sid, entry in _config(text).items()}


def dump_scenes(scenes: dict[str, Scene]) -> str:
    """The scenes as a scene file; hooks stay in code and are found again by scene id."""
    entries = {
        s.scene_id: {
            "name": s.name,
            "category": s.category,
            "description": s.description,
            "target": s.target,
            "labels": dict(s.labels),
            "columns": list(s.required),
            "ignored": sorted(s.ignored),
            "helpers": sorted(s.helpers),
            "oversample_cap": s.oversample_cap,
        }
        for s in scenes.values()
    }
    return yaml.safe_dump({"scenes": entries}, allow_unicode=True, sort_keys=False)


def with_scene(scenes: dict[str, Scene], scene: Scene) -> dict[str, Scene]:
    """Add a scene or replace the one of the same id."""
    return {**scenes, scene.scene_id: scene}


def without_scene(scenes: dict[str, Scene], scene_id: str) -> dict[str, Scene]:
    if scene_id not in scenes:
        raise KeyError(f"scene {scene_id} not found")
    return {sid: scene for sid, scene in scenes.items() if sid != scene_id}


# --- scene tables --------------------------------------------------------------------


def scene_table(spark: SparkSession, scenes: dict[str, Scene]) -> DataFrame:
    rows = [(s.scene_id, s.name, s.category, s.description, s.target) for s in scenes.values()]
    return spark.createDataFrame(rows, SCENE_SCHEMA)


def column_table(spark: SparkSession, scenes: dict[str, Scene]) -> DataFrame:
    rows = [(s.scene_id, i, c) for s in scenes.values() for i, c in enumerate(s.required)]
    return spark.createDataFrame(rows, COLUMN_SCHEMA)


def label_table(spark: SparkSession, scenes: dict[str, Scene]) -> DataFrame:
    rows = [(s.scene_id, raw, shown) for s in scenes.values() for raw, shown in s.labels.items()]
    return spark.createDataFrame(rows, LABEL_SCHEMA)


def upsert_scenes(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Scenes after the changes: a changed scene replaces the one of the same id.

    ``changes`` carries the table's columns and a sequence number ``seq``; the
    latest change of an id wins.
    """
    fields = [c for c in table.columns if c != "scene_id"]
    stamped = table.withColumn("seq", F.lit(-1).cast("long")).unionByName(
        changes.select("scene_id", *fields, F.col("seq").cast("long").alias("seq"))
    )
    newest = stamped.groupBy("scene_id").agg(F.max_by(F.struct(*fields), "seq").alias("kept"))
    return newest.select("scene_id", "kept.*")


def delete_scenes(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("scene_id"), "scene_id", "left_anti")


def attach_scene(df: DataFrame, dim: DataFrame, dim_rows: int, on: str = "scene_id") -> DataFrame:
    """Add each row's target column name, '' where its scene is not configured.

    ``dim_rows`` bounds the scene table; only a small one is broadcast.
    """
    wanted = dim.select(F.col("scene_id").alias(on), "target_col")
    side = F.broadcast(wanted) if dim_rows <= BROADCAST_ROWS else wanted
    return df.join(side, on, "left").withColumn("target_col", F.coalesce("target_col", F.lit("")))
