"""Command line: run, preview, validate, export."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from pyspark.sql import SparkSession

from . import log_to
from .operators.judge import JUDGES
from .operators.replace import METHODS, method
from .operators.rewrite import TOLERANCES, PrivacyGoal, Rewrite
from .plans.config import Config, Detect, Evaluate, Input, config_of, spec_of
from .plans.engine import Engine, validate
from .plans.models import Models, plain_values
from .plans.recording import Recorder
from .sources.tables import InputError, TableError, write_table

#: Options by what they are for: those of the one have no use for the other.
REPLACE_ONLY, REWRITE_ONLY = ("template", "plain_labels", "algorithm", "digest_length"), ("protect", "preserve", "max_repair_iterations", "strict_protection")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="hushframe", description="Detect and replace sensitive entities in a text column.")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "preview", "validate", "export"):
        c = sub.add_parser(name)
        c.add_argument("source", help="CSV or Parquet table")
        c.add_argument("--text-column", default="text")
        c.add_argument("--id-column")
        c.add_argument("--config", help="YAML or JSON of a whole configuration, instead of the options below")
        c.add_argument("--labels", help="comma-separated; all if not given")
        c.add_argument("--threshold", type=float, help="score from which a detector's spans count")
        c.add_argument("--validation-entities", type=int, help="entities that a validator is asked about at once")
        c.add_argument("--validation-window", type=int, help="characters around them that it sees")
        c.add_argument("--replace", choices=sorted(METHODS), default=None)
        c.add_argument("--template", help="for redact, annotate and hash")
        c.add_argument("--plain-labels", action="store_true", help="redact: labels as they are")
        c.add_argument("--algorithm", choices=("sha256", "sha1", "md5"), help="hash")
        c.add_argument("--digest-length", type=int, help="hash: 6 to 64")
        c.add_argument("--risk-tolerance", choices=sorted(TOLERANCES), help="rewrite instead of replacing")
        c.add_argument("--protect", help="rewrite: what to protect")
        c.add_argument("--preserve", help="rewrite: what to preserve")
        c.add_argument("--max-repair-iterations", type=int, help="rewrite: rounds of repair")
        c.add_argument("--strict-protection", action="store_true", help="rewrite: no entity is left as it is")
        c.add_argument("--instructions", help="for substitutes and rewrites")
        c.add_argument("--summary", help="what the texts are, for prompts")
        c.add_argument("--models", help="YAML of models, their roles and providers; without it rules detect and nothing else is asked")
        c.add_argument("--providers", help="YAML of providers, if that of the models has none")
        c.add_argument("--evaluate", action="store_true", help="ask the judges too")
        c.add_argument("--judges", help=f"comma-separated, of {', '.join(JUDGES)}")
        c.add_argument("--records", help="file of JSON lines that records of the run are appended to")
        c.add_argument("--quiet", action="store_true")
        c.add_argument("--debug", action="store_true")
        c.add_argument("--master", default="local[*]")
        if name in ("run", "export"):
            c.add_argument("--output", required=True)
        if name == "run":
            c.add_argument("--overwrite", action="store_true")
        if name == "preview":
            c.add_argument("--rows", type=int, default=10)
    return p


def _given(**options: object) -> dict:
    return {k: v for k, v in options.items() if v not in (None, False)}


def configured(a: argparse.Namespace) -> Config:
    if a.config:
        return config_of(plain_values(a.config))
    detect = Detect(**_given(entity_labels=a.labels.split(",") if a.labels else None, threshold=a.threshold, validation_max_entities_per_call=a.validation_entities, validation_excerpt_window_chars=a.validation_window))
    if a.risk_tolerance and a.replace:
        raise InputError("--replace and --risk-tolerance exclude each other")
    stray = [n for n in (REPLACE_ONLY if a.risk_tolerance else REWRITE_ONLY) if getattr(a, n) not in (None, False)]
    if stray:
        logging.getLogger("hushframe").warning("of no use here: %s", ", ".join(f"--{n.replace('_', '-')}" for n in stray))
    if a.risk_tolerance:
        goal = PrivacyGoal(**_given(protect=a.protect, preserve=a.preserve)) if a.protect or a.preserve else None
        return Config(detect, rewrite=Rewrite(**_given(privacy_goal=goal, instructions=a.instructions, risk_tolerance=a.risk_tolerance, strict_entity_protection=a.strict_protection), **({} if a.max_repair_iterations is None else {"max_repair_iterations": a.max_repair_iterations})))
    kind = a.replace or "redact"
    own = _given(format_template=None if kind == "substitute" else a.template, normalize_label=None)
    if kind == "redact" and a.plain_labels:
        own["normalize_label"] = False
    if kind == "hash":
        own |= _given(algorithm=a.algorithm, digest_length=a.digest_length)
    if kind == "substitute":
        own |= _given(instructions=a.instructions)
    return Config(detect, replace=method(kind, **own))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        config = configured(a)
        models = Models.read(a.models, a.providers) if a.models else None
        if a.command == "validate":
            validate(config, models.roles if models else {}, {m.alias for m in models.models} if models else {"default"})
            print(json.dumps(spec_of(config)) if a.debug else "valid")
            return 0
        if not a.quiet:
            log_to(logging.DEBUG if a.debug else logging.INFO)
        spark = SparkSession.builder.master(a.master).getOrCreate()
        data = Input(a.source, a.text_column, a.id_column, a.summary)
        recorder = Recorder(a.records) if a.records else None
        engine = Engine(spark, models, recorder=recorder)
        if a.command == "export":
            engine.export_detection(config, data, a.output)
            return 0
        done = engine.preview(config, data, a.rows) if a.command == "preview" else engine.run(config, data)
        if a.evaluate or a.judges:
            done = engine.evaluate(done, Evaluate(tuple(a.judges.split(",")) if a.judges else None))
        if a.command == "preview":
            done.frame.show(a.rows, truncate=False)
        else:
            write_table(done.frame, a.output, a.overwrite)
        if recorder is not None:
            if a.command == "run" and not (a.evaluate or a.judges):
                done.finish()
            recorder.write()
        return 0
    except (InputError, TableError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
