"""Records of a run beside those of its rows: settings, stages with their times, use of models."""

from __future__ import annotations

import dataclasses
import json
import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import InputError
from .config import Config, Input

#: Fields whose contents aren't recorded, only whether they are set.
PRIVATE = ("instructions", "data_summary", "privacy_goal", "format_template", "entity_labels")


def settings(config: Config, data: Input) -> dict:
    """What a configuration says, without texts that a user wrote and without the path of the input."""

    def plain(v: object) -> object:
        if dataclasses.is_dataclass(v):
            named = {f.name: getattr(v, f.name) for f in dataclasses.fields(v)}
            return {(f"has_{k}" if k in PRIVATE else k): (x is not None) if k in PRIVATE else plain(x) for k, x in named.items()}
        return v if v is None or isinstance(v, bool | int | float | str) else str(type(v).__name__)

    return {"mode": config.mode, "strategy": type(config.replace or config.rewrite).__name__.lower(), "input_kind": "frame" if isinstance(data.source, DataFrame) else data.source.rsplit(".", 1)[-1].lower(), "config": plain(config)}


class Recorder:
    """Collects records of the driver's own steps (a few a run) and writes them as JSON lines.

    ``tags`` stand in every record. From the environment: HUSHFRAME_RUN_ID, and
    HUSHFRAME_RECORDS, a file that records are appended to.
    """

    def __init__(self, path: str | None = None, run_id: str | None = None, **tags: object):
        self.path = path or os.environ.get("HUSHFRAME_RECORDS")
        self.run_id = run_id or os.environ.get("HUSHFRAME_RUN_ID") or uuid.uuid4().hex
        self.tags, self.records = tags, []

    def record(self, kind: str, **fields: object) -> dict:
        made = {"record_type": kind, "run_id": self.run_id, "run_tags": self.tags, **fields}
        self.records.append(made)
        return made

    def run(self, config: Config, data: Input) -> dict:
        return self.record("run", **settings(config, data))

    @contextmanager
    def stage(self, name: str, **fields: object) -> Iterator[dict]:
        """Times what is done inside; numbers put into the record it gives become rates (``rows``: rows_per_sec)."""
        began, made = time.monotonic(), self.record("stage", stage=name, status="completed", **fields)
        try:
            yield made
        except Exception as e:
            made |= {"status": "error", "error_type": type(e).__name__}
            raise
        finally:
            self._timed(made, time.monotonic() - began)

    @staticmethod
    def _timed(made: dict, spent: float) -> None:
        made["elapsed_sec"] = spent
        made |= {f"{k}_per_sec": v / spent for k, v in list(made.items()) if k in ("rows", "chars", "tokens") and v is not None and spent > 0}

    def close(self, made: dict, spent: float, **fields: object) -> dict:
        """Completes the record of a stage whose counts came later."""
        made |= {"status": "completed", **fields}
        self._timed(made, spent)
        return made

    def workflow(self, name: str, alias: str, asked: int, failed: int, elapsed: float, **fields: object) -> dict:
        """A step of a model: requests, failures, rates."""
        if failed > asked or asked < 0:
            raise InputError("a step fails at most as often as it asks")
        rate = failed / asked if asked else None
        return self.record("model_workflow", workflow_name=name, model_alias=alias, observed_total_requests=asked, observed_failed_requests=failed, observed_failed_request_rate=rate, elapsed_sec=elapsed, requests_per_sec=asked / elapsed if elapsed > 0 else None, status="error" if asked and failed == asked else "completed", **fields)

    def write(self) -> str | None:
        """Appends what was collected to the file, if there is one, and forgets it."""
        if self.path is None:
            return None
        with Path(self.path).open("a") as f:
            f.writelines(json.dumps(r, sort_keys=True, default=str) + "\n" for r in self.records)
        self.records = []
        return self.path

    def frame(self, spark: SparkSession) -> DataFrame:
        """The records so far as a table of type, run, and JSON."""
        return spark.createDataFrame([(r["record_type"], r["run_id"], json.dumps(r, sort_keys=True, default=str)) for r in self.records], "record_type string, run_id string, record string")
