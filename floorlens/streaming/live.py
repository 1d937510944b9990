"""Live loops on Structured Streaming: fixes, handoffs, aim changes, edits.

Stateful loops carry an event-time watermark (ten minutes unless told
otherwise) and drop rows later than that. The loops that rank fixes and refresh
rings keep no state between batches: they handle every row, however late.
Sinks take a checkpoint location.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.edits import home_presets
from ..operators.probe import rank_cameras
from ..operators.visibility import CAMERA, visibility
from ..plans.patrol import keep_or_best

LATE = "10 minutes"


def fix_stream(spark, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def rank_fixes(fixes: DataFrame, cameras: DataFrame, rings: DataFrame, sink: Callable, checkpoint: str, top: int | None = None):
    """Each micro-batch of position fixes, ranked against the stored rings.
    `sink(df, batch_id)` receives (probe, camera, score, rank) rows."""

    def batch(df: DataFrame, batch_id: int) -> None:
        sink(rank_cameras(df, cameras, rings, top=top), batch_id)

    return (
        fixes.writeStream.foreachBatch(batch)
        .option("checkpointLocation", checkpoint).start()
    )


def follow_subjects(ranked: DataFrame, subject: str = "subject", late: str = LATE) -> DataFrame:
    """Sticky camera per subject over a stream of (subject, ts, probe_id, cams)
    with cams best first, in order of event time as in a batch.

    State is the camera id and the fixes the watermark has not passed yet:
    fixes wait until no earlier one can come, then move the state in order of
    (ts, probe_id). Rows later than the watermark are dropped."""
    kind = ranked.schema[subject].dataType.simpleString()
    out = f"{subject} {kind}, ts timestamp, probe_id bigint, camera_id string"
    kept = "camera string, ts array<bigint>, probe array<bigint>, cams array<array<string>>"

    def update(key, batches, state: GroupState):
        current, *waiting = state.get if state.exists else (None, [], [], [])
        rows = list(zip(*waiting))
        for pdf in batches:
            micros = pdf["ts"].to_numpy("datetime64[us]").astype("int64").tolist()
            rows += zip(micros, pdf["probe_id"].tolist(), [list(c) for c in pdf["cams"]])
        rows.sort(key=lambda r: r[:2])
        passed = state.getCurrentWatermarkMs() * 1000
        ready = [r for r in rows if r[0] <= passed]
        picked = []
        for _, _, cams in ready:
            now = keep_or_best(current, list(cams))
            current = now if now is not None else current
            picked.append(now)
        rest = rows[len(ready):]
        state.update((current, *(list(c) for c in zip(*rest))) if rest else (current, [], [], []))
        if rest:
            state.setTimeoutTimestamp(rest[0][0] // 1000 + 1)
        if ready:
            yield pd.DataFrame({
                subject: key[0], "ts": pd.to_datetime([r[0] for r in ready], unit="us"),
                "probe_id": [r[1] for r in ready], "camera_id": picked,
            })

    return (
        ranked.withWatermark("ts", late).groupBy(subject)
        .applyInPandasWithState(update, out, kept, "append", GroupStateTimeout.EventTimeTimeout)
    )


def latest_aims(aims: DataFrame) -> DataFrame:
    """Newest pose per camera out of a batch of aim changes, by `ts` and, where
    there is one, `seq`; what is still tied goes by the pose itself."""
    key = ["building_id", "camera_id"]
    rest = [c for c in aims.columns if c not in key]
    order = F.struct("ts", *(["seq"] if "seq" in rest else []), *[c for c in rest if c not in ("ts", "seq")])
    return aims.groupBy(*key).agg(F.max(order).alias("a")).select(*key, *[F.col(f"a.{c}").alias(c) for c in rest])


def changed_cameras(cameras: DataFrame, aims: DataFrame) -> DataFrame:
    """Cameras whose pose really differs after the batch, with the new pose."""
    aim = latest_aims(aims).select(
        "building_id", "camera_id",
        F.struct(F.pmod("heading", F.lit(360.0)).alias("heading"), "tilt_deg", "fov_deg", "range_m").alias("aim"),
    )
    fields = ("heading", "tilt_deg", "fov_deg", "range_m")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"aim.{f}"))
    return cameras.join(aim, ["building_id", "camera_id"]).where(~same).select(
        *[F.col(f"aim.{c}").alias(c) if c in fields else F.col(c) for c in cameras.columns]
    )


def refresh_rings(cameras: DataFrame, aims: DataFrame, walls: DataFrame, rings: DataFrame) -> dict[str, DataFrame]:
    """Recompute rings for changed cameras only and merge them in."""
    changed = changed_cameras(cameras, aims)
    fresh = visibility(changed, walls)
    return {
        "cameras": cameras.join(changed.select(*CAMERA), CAMERA, "left_anti").unionByName(changed),
        "rings": rings.join(changed.select(*CAMERA), CAMERA, "left_anti").unionByName(fresh),
    }


def aim_stream(aims: DataFrame, state: Callable[[], dict[str, DataFrame]], store: Callable, checkpoint: str):
    """Keep cameras, presets and rings current. `state()` gives the stored
    tables (cameras, presets, walls, rings); `store(tables, batch_id)` keeps
    the new ones. Home is captured before a camera's first move."""

    def batch(df: DataFrame, batch_id: int) -> None:
        now = state()
        out = refresh_rings(now["cameras"], df, now["walls"], now["rings"])
        out["presets"] = now["presets"].unionByName(home_presets(df, now["cameras"], now["presets"]))
        store(out, batch_id)

    return aims.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def edit_sessions(log: DataFrame, gap: str = "2500 milliseconds", late: str = LATE) -> DataFrame:
    """Bursts of edits per user and key by session window; an edit without a time
    is a burst of its own. Approximate against the exact rule, which also breaks a
    burst when another key intervenes."""
    bursts = (
        log.withWatermark("ts", late)
        .groupBy("user_id", "edit_key", F.session_window("ts", gap).alias("s"))
        .agg(F.count("*").alias("edits"))
        .select("user_id", "edit_key", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "edits")
    )
    never = F.lit(None).cast("timestamp")
    alone = log.where("ts is null").select("user_id", "edit_key", never.alias("started"), never.alias("ended"), F.lit(1).cast("long").alias("edits"))
    return bursts.unionByName(alone)
