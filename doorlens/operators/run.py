"""One publishing run: score every door, attach the frames, shape the tables, publish them together."""

from __future__ import annotations

from pyspark.sql import DataFrame

from doorlens.operators import imagery, publish
from doorlens.scoring import engine
from doorlens.session import land


def publish_scored(resolved: DataFrame, inputs: dict[str, DataFrame], signals: DataFrame | None, root: str, run_id: str) -> dict[str, DataFrame]:
    """Publishes doors, evidence and gaps of a run under `root`, all or nothing, and returns them as read back.

    `resolved` has every door with situs and exclusion_reason, `inputs` are the arguments of `engine.score`, `signals` the imagery
    signals whose frames the evidence re-opens. A door that cannot be scored is published with its reason and no evidence.
    """
    scored = engine.score(**inputs)
    doors = land(publish.doors_table(resolved, scored["doors"]), "published-doors")
    evidence = scored["evidence"] if signals is None else imagery.attach_frames(scored["evidence"], signals)
    shown = doors.filter("exclusion_reason is null").select("territory_id", "pams_pin")
    tables = {
        "doors": doors, "evidence": publish.evidence_table(evidence, doors),
        "gaps": scored["gaps"].join(shown, ["territory_id", "pams_pin"], "left_semi"),
    }
    publish.publish_run(tables, root, run_id)
    return publish.read_run(resolved.sparkSession, root, ("doors", "evidence", "gaps"))
