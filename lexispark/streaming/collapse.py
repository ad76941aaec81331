"""Collapse alarms of trainings: state of a run that survives restarts, over streams and stored logs alike.

A log has a row for each step and each validation of a run. Each sign of a collapse is judged row by row, and an alarm is
raised once a sign has held for as many rows in a row as its patience says. A run has one alarm, its first.

* loss: above ``factor`` times the least median of a full window of healthy losses so far; such losses never enter the window;
* gradient: a norm of about zero;
* validation: errors far above the best state or nothing but empty outputs; only once errors were low;
* not finite: any number, at once.

After a change of phase signs are not judged for ``grace`` steps, but for numbers that aren't finite. Nulls tell nothing:
they neither hold up a sign nor end it. Rows without a run are left out; rows of one step are taken in the order of ``kind``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import median
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .ledger import ROCKS

TRAIN, VALID = "train", "valid"
METRICS = ("loss", "gradient", "errors", "empty", "blank")


@dataclass(frozen=True)
class Limits:
    """What counts as a collapse."""

    window: int = 50
    ready: int = 100
    factor: float = 5.0
    least: float = 1e-3
    no_gradient: float = 1e-12
    grace: int = 20
    learned: tuple[float, float] = (0.8, 0.2)
    worse: tuple[float, float] = (2.0, 0.25)
    empty: float = 0.9
    blank: tuple[float, float] = (0.995, 0.5)
    patience: tuple[tuple[str, int], ...] = (("loss", 3), ("gradient", 50), ("validation", 3))


def fresh() -> dict:
    return {"healthy": [], "base": None, "streaks": {}, "phase": None, "quiet": -1, "best": None, "over": False}


def _train(state: dict, row: dict, limits: Limits) -> dict[str, bool]:
    """Signs of a step; its loss is remembered if it is healthy."""
    signs, ready = {}, row["step"] >= limits.ready
    if (loss := row["loss"]) is not None:
        signs["loss"] = ready and state["base"] is not None and loss > limits.factor * state["base"]
        if not signs["loss"]:
            state["healthy"] = [*state["healthy"], loss][-limits.window :]
            if len(state["healthy"]) == limits.window:
                base = max(limits.least, median(state["healthy"]))
                state["base"] = base if state["base"] is None else min(base, state["base"])
    if row["gradient"] is not None:
        signs["gradient"] = ready and row["gradient"] <= limits.no_gradient
    return signs


def _valid(state: dict, row: dict, limits: Limits) -> dict[str, bool]:
    """The sign of a validation, once one has shown that something was learned."""
    errors, empty, blank = (row[c] for c in ("errors", "empty", "blank"))
    if state["best"] is None:
        if errors is not None and errors < limits.learned[0] and (empty is None or empty <= limits.learned[1]):
            state["best"] = errors
        return {}
    if errors is None and empty is None and blank is None:
        return {}
    times, more = limits.worse
    worse = errors is not None and errors > max(times * state["best"], more + state["best"])
    bad = worse or (empty or 0) >= limits.empty or ((blank or 0) >= limits.blank[0] and (empty or 0) >= limits.blank[1])
    if not bad and errors is not None:
        state["best"] = min(errors, state["best"])
    return {"validation": bad}


def observe(state: dict, row: dict, limits: Limits) -> str | None:
    """Take a row in; the alarm that it raises, if any."""
    if state["over"]:
        return None
    alarm = next((f"{c} not finite" for c in METRICS if row[c] is not None and not math.isfinite(row[c])), None)
    if alarm is None:
        if row["phase"] is not None and row["phase"] != state["phase"]:
            if state["phase"] is not None:
                state["quiet"], state["streaks"] = row["step"] + limits.grace, {}
            state["phase"] = row["phase"]
        if row["step"] >= state["quiet"]:
            for sign, bad in (_train if row["kind"] == TRAIN else _valid)(state, row, limits).items():
                state["streaks"][sign] = state["streaks"].get(sign, 0) + 1 if bad else 0
            alarm = next((s for s, n in limits.patience if state["streaks"].get(s, 0) >= n), None)
    state["over"] = alarm is not None
    return alarm


def _rows(frame: pd.DataFrame) -> Iterator[dict]:
    """Rows as plain values. A null is None; what isn't finite comes as text, since pandas takes a null for it."""
    for row in frame.to_dict("records"):
        told = {c: None if row[c] is None or row[c] != row[c] else float(row[c]) for c in METRICS}
        yield {"step": int(row["step"]), "kind": row["kind"], "phase": row["phase"], **told}


def _log(df: DataFrame, run: str) -> DataFrame:
    """(run, step, kind, phase, metrics as text), so that NaN and null stay apart; absent columns are null."""
    have = {c: F.col(c) if c in df.columns else F.lit(None) for c in ("phase", *METRICS)}
    return df.where(F.col(run).isNotNull()).select(F.col(run).alias("run"), F.col("step").cast("long"), F.col("kind").cast("string"), have["phase"].cast("string").alias("phase"), *(have[c].cast("double").cast("string").alias(c) for c in METRICS))


def alarms(df: DataFrame, run: str = "run", limits: Limits = Limits()) -> DataFrame:
    """(run, step, alarm) of each run of a stored log that collapsed.

    A run's rows follow one another in one partition and are read as a stream; what is held is the window of losses.
    """
    log = _log(df, run)
    kind = log.schema["run"].dataType

    def read(frames):
        at, state = None, fresh()
        for frame in frames:
            out = []
            for key, row in zip(frame["run"].tolist(), _rows(frame), strict=True):
                if key != at:
                    at, state = key, fresh()
                if alarm := observe(state, row, limits):
                    out.append((key, row["step"], alarm))
            yield pd.DataFrame(out, columns=["run", "step", "alarm"]).astype({"step": "int64"})

    out = T.StructType([T.StructField("run", kind), T.StructField("step", T.LongType()), T.StructField("alarm", T.StringType())])
    return log.where("step is not null").repartition("run").sortWithinPartitions("run", "step", "kind").mapInPandas(read, out).withColumnRenamed("run", run)


class _Monitor(StatefulProcessor):
    """The state of a run as JSON; numbers in it are finite."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", T.StructType([T.StructField("state", T.StringType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = json.loads(self.state.get()[0]) if self.state.exists() else fresh()
        out = []
        for row in _rows(pd.concat(list(rows)).sort_values(["step", "kind"])):
            if alarm := observe(state, row, self.limits):
                out.append((key[0], row["step"], alarm))
        self.state.update((json.dumps(state),))
        yield pd.DataFrame(out, columns=["run", "step", "alarm"]).astype({"step": "int64"})

    def close(self) -> None:
        pass


def watched(stream: DataFrame, run: str = "run", limits: Limits = Limits()) -> DataFrame:
    """(run, step, alarm) as a stream whose micro-batches follow the steps; a run's rows of one micro-batch are held at once."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    log = _log(stream, run).where("step is not null")
    out = T.StructType([T.StructField("run", log.schema["run"].dataType), T.StructField("step", T.LongType()), T.StructField("alarm", T.StringType())])
    return log.groupBy("run").transformWithStateInPandas(_Monitor(limits), outputStructType=out, outputMode="Append", timeMode="None").withColumnRenamed("run", run)
