"""Running a configuration over a table."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import spans, text
from ..operators import detect, judge, metrics, model, rewrite
from ..operators import replace as replacing
from ..sources import tables
from . import domains, prompts
from .config import LABEL_NAMES, Config, Detect, Evaluate, Input, config_of, spec_of
from .ledger import Ledger
from .models import Models, pool_of
from .recording import Recorder

log = logging.getLogger("hushframe")
#: Characters of a piece of text that a detector's server takes at once, and of two pieces' common part.
CHUNK_LENGTH, CHUNK_OVERLAP = 384, 128


@dataclass(frozen=True)
class Result:
    """The user's table, everything that was made on the way, failed records, and the configuration."""

    frame: DataFrame
    trace: DataFrame
    failed: DataFrame
    config: Config
    text_column: str
    ledger: Ledger | None = None
    open_stage: tuple[Recorder, dict, Observation, float] | None = None

    def finish(self) -> dict | None:
        """Completes the record of the whole run with what was observed when ``frame`` was written; call it after that."""
        if self.open_stage is None:
            return None
        recorder, made, seen, began = self.open_stage
        return recorder.close(made, time.monotonic() - began, **seen.get)

    def forget(self) -> None:
        """Drops the tables that the run was kept in; its frames can't be used after that."""
        if self.ledger is not None:
            self.ledger.forget()

    def in_order(self) -> DataFrame:
        """The user's table in the order of the input (a sort, so only on demand)."""
        return user_columns(self.trace.orderBy(schemas.ORDER), self.text_column)

    def metrics(self) -> DataFrame:
        how = type(self.config.replace).__name__ if self.config.replace else "rewrite"
        return metrics.record_metrics(self.trace, self.config.mode, how, most=self.config.detect.validation_max_entities_per_call)


def renamed(trace: DataFrame, column: str) -> DataFrame:
    """The stages' names as the user sees them."""
    output = f"{column}_rewritten" if "_hf_mode_rewrite" in trace.columns else f"{column}_replaced"
    return trace.withColumnsRenamed({schemas.TEXT: column, schemas.OUTPUT: output, schemas.TAGGED: f"{column}_with_spans"})


def unrenamed(frame: DataFrame, column: str) -> DataFrame:
    """The inverse; names that are the stages' already stay."""
    back = {column: schemas.TEXT, f"{column}_replaced": schemas.OUTPUT, f"{column}_rewritten": schemas.OUTPUT, f"{column}_with_spans": schemas.TAGGED}
    return frame.withColumnsRenamed({k: v for k, v in back.items() if k in frame.columns and v not in frame.columns})


def user_columns(trace: DataFrame, column: str) -> DataFrame:
    """What a user gets: their own columns, the outcome, and the scores of a rewrite."""
    named = renamed(trace, column)
    keep = [c for c in named.columns if not c.startswith("_hf_")]
    return named.select(*keep)


class Engine:
    """Detects, then replaces or rewrites, the entities of a text column.

    ``provider`` makes a function (prompt, alias) -> JSON text in each task. Without
    one, the rule detector stands in for the detector and no other model is asked, so
    Substitute and rewriting need one; nothing is then written before the user writes.

    With a provider, or a recorder, the rows are written once, bucketed by number. A
    model's answers, which mustn't be asked for twice, and what stages make of them are
    narrow tables (number, answer, error) in the same buckets: a text isn't written
    again, nor exchanged, however many steps there are. Only texts that a model wrote
    are kept besides, once each. ``recorder`` gets records of the run, its stages and
    its models' steps, counted while the tables are written.
    """

    def __init__(self, spark: SparkSession, provider: model.Provider | Models | None = None, roles: dict | None = None, folder: str | None = None, recorder: Recorder | None = None, lists: model.Lists = model.Lists()):
        if isinstance(provider, Models):
            roles, provider = {**provider.roles, **(roles or {})}, provider.provider()
        self.spark, self.provider, self.roles, self.lists = spark, provider, roles or {}, lists
        self.folder, self.recorder = tables.shared_folder(spark, folder), recorder
        self.ledger, self.base, self.texts = Ledger(spark, self.folder), None, []
        self.failed: list[DataFrame] = []
        self.summary = ""

    def pool(self, role: str) -> list[str]:
        return pool_of(self.roles, role)

    def detector(self, d: Detect) -> model.Provider | None:
        """The provider, with what a detector is to look for in requests to its aliases, if it takes parameters."""
        given = self.provider
        for alias in self.pool("entity_detector") if hasattr(given, "with_parameters") else ():
            given = given.with_parameters(alias, {"labels": d.entity_labels or LABEL_NAMES, "threshold": d.threshold, "chunk_length": CHUNK_LENGTH, "overlap": CHUNK_OVERLAP})
        return given

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        import uuid

        path = f"{self.folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def ask(self, frame: DataFrame, prompt: Column, output: str, kind: T.DataType, role: str, step: str, when: Column | None = None, drop: bool = True, provider: model.Provider | None = None) -> DataFrame:
        """``frame`` with a model's answer as a column; rows it fails on are noted and (unless ``drop`` is false) left out.

        Numbers and prompts go to the model; numbers, answers and errors are written.
        """
        pool = self.pool(role)
        # a filter of what is worked out here would go below it, and work it out twice; one of generated rows stays where it is
        wanted = prompt if when is None else F.when(when, prompt)
        asked = frame.select(schemas.ORDER, schemas.RECORD_ID, F.explode_outer(F.array(wanted)).alias("_hf_prompt")).filter(F.col("_hf_prompt").isNotNull())
        got = model.answers(asked, "_hf_prompt", provider or self.provider, pool, lists=self.lists)
        many = isinstance(got.schema["answer"].dataType, T.ArrayType)
        narrow = got.select(schemas.ORDER, schemas.RECORD_ID, model.parsed("answer", kind, many).alias(output), F.col("error").alias(f"{output}_error"), *model.USE)
        sums = {"rows": F.count(F.lit(1)), "failed_rows": F.count(f"{output}_error"), **{k: F.sum(k) for k in model.USE}}
        began = time.monotonic()
        kept, seen = self.ledger.put(narrow, step, sums)
        spent = time.monotonic() - began
        told = {k: v or 0 for k, v in seen.items()}
        log.info("%s: asked %s for %d rows in %d calls, of which %d failed, in %.1f s; %d rows have no answer", step, ", ".join(pool), told["rows"], told["calls"], told["failed_calls"], spent, told["failed_rows"])
        if self.recorder is not None:
            self.recorder.workflow(step, ",".join(pool), told["calls"], told["failed_calls"], spent, input_rows=told["rows"], failed_rows=told["failed_rows"], observed_input_tokens=told["input_tokens"], observed_output_tokens=told["output_tokens"], model_sec=told["seconds"])
        self.failed.append(model.failures(kept, output, step))
        beside = self.ledger.beside(frame, kept.select(schemas.ORDER, output, f"{output}_error"))
        return (beside.filter(F.col(f"{output}_error").isNull()) if drop else beside).drop(f"{output}_error")

    def start(self, loaded: DataFrame) -> DataFrame:
        """The input's rows, dealt into buckets by number, and written: the only time that their texts are."""
        self.base, seen = self.ledger.put(loaded, "rows", {"rows": F.count(F.lit(1))}, deal=True)
        self.texts = []
        log.info("%d rows", seen["rows"])
        return self.base

    def cut(self, frame: DataFrame, name: str, stage: dict | None = None) -> DataFrame:
        """The same rows and columns, from the input and one narrow table of what isn't text: lineage ends here.

        The tagged text is made anew from text and entities, texts that a model wrote
        come from its answers (``texts``).
        """
        heavy = {schemas.TAGGED, schemas.OUTPUT} & set(frame.columns)
        own = [c for c in frame.columns if c not in self.base.columns and c not in heavy]
        sums = {"rows": F.count(F.lit(1)), "entities": F.sum(F.size(schemas.ENTITIES))} if schemas.ENTITIES in own else {"rows": F.count(F.lit(1))}
        kept, seen = self.ledger.put(frame.select(schemas.ORDER, *own), name, sums)
        if stage is not None:
            stage |= {k: v or 0 for k, v in seen.items()}
        out = self.ledger.beside(self.base, kept, "inner")
        if schemas.TAGGED in heavy:
            out = out.withColumn(schemas.TAGGED, spans.tagged_text(F.col(schemas.TEXT), F.col(schemas.ENTITIES)))
        if schemas.OUTPUT in heavy:
            names = [f"_hf_text_{k}" for k in range(len(self.texts))]
            for k, t in zip(names, self.texts, strict=True):
                out = self.ledger.beside(out, t.withColumnRenamed("text", k))
            out = out.withColumn(schemas.OUTPUT, F.coalesce(*reversed(names))).drop(*names)
        return out

    def written_text(self, frame: DataFrame, prompt: Column, role: str, step: str, drop: bool = True) -> DataFrame:
        """``frame`` with a text that a model wrote as the output, or its output before if there is none."""
        got = self.ask(frame, prompt, "_hf_written", schemas._struct(rewritten_text=T.StringType()), role, step, drop=drop)
        text_of = rewrite.rewritten_text(F.col("_hf_written.rewritten_text"))
        self.texts.append(self.spark.table(self.ledger.tables[-1]).select(schemas.ORDER, text_of.alias("text")))
        before = [F.col(schemas.OUTPUT)] if schemas.OUTPUT in frame.columns else []
        return got.withColumn(schemas.OUTPUT, F.coalesce(text_of, *before)).drop("_hf_written")

    @contextmanager
    def stage(self, name: str) -> Iterator[dict]:
        if self.recorder is None:
            yield {}
        else:
            with self.recorder.stage(name) as made:
                yield made

    # ------------------------------------------------------------------ stages

    def load(self, data: Input, rows: int | None = None) -> tables.Resolved:
        frame = data.source if isinstance(data.source, DataFrame) else tables.read_table(self.spark, data.source)
        if rows is not None:
            frame = frame.limit(max(0, rows))
        found = tables.resolve(frame, data.text_column)
        named = [data.id_column] if data.id_column else [c for c in found.frame.columns if not c.startswith("_hf_") or c == schemas.TEXT]
        identified = found.frame.withColumn(schemas.RECORD_ID, text.record_id(*(F.col(f"`{c}`") for c in named)))
        return found.with_frame(identified.withColumn(schemas.ORDER, F.monotonically_increasing_id()))

    def detect(self, frame: DataFrame, config: Config) -> DataFrame:
        d = config.detect
        body = F.col(schemas.TEXT)
        if self.provider is None:
            return detect.finalize(detect.detect(frame, labels=d.entity_labels), labels=d.entity_labels)
        raw = self.ask(frame, body, "_hf_model_raw", T.StringType(), "entity_detector", "entity-detection", provider=self.detector(d))
        found = detect.detect(raw, raw="_hf_model_raw").withColumn("_hf_candidates", spans.order_candidates(spans.validation_candidates(body, F.col(schemas.ENTITIES)), F.col(schemas.ENTITIES)))
        chunks = spans.chunks(F.col("_hf_candidates"), d.validation_max_entities_per_call)
        labels = prompts.label_examples(d.entity_labels or LABEL_NAMES)

        def prompt(chunk: Column) -> Column:
            mine = F.filter(schemas.ENTITIES, lambda e: F.exists(chunk, lambda c: c["id"] == e["id"]))
            whole = spans.tagged_text(body, F.col(schemas.ENTITIES), F.col("_hf_notation"))
            near = spans.excerpt(body, mine, F.col(schemas.ENTITIES), d.validation_excerpt_window_chars, F.col("_hf_notation"))
            shown = F.when(F.size("_hf_candidates") <= d.validation_max_entities_per_call, whole).otherwise(near)
            return prompts.fill_columns(prompts.VALIDATE, {"SUMMARY": F.lit(self.summary), "LABELS": F.lit(labels), "PIECE": text.entity_tag(F.lit("total"), F.lit("amount"), F.col("_hf_notation")), "NOTATION": F.col("_hf_notation"), "EXCERPT": shown, "SKELETON": F.to_json(F.struct(spans.skeleton(chunk).alias("decisions")))})

        answers = self.ask(found, F.transform(chunks, prompt), "_hf_answers", schemas._struct(decisions=T.ArrayType(schemas.RAW_DECISION)), "entity_validator", "entity-validation", F.size("_hf_candidates") > 0)
        none = F.array().cast(T.ArrayType(T.ArrayType(schemas.RAW_DECISION)))
        lists = F.coalesce(F.transform("_hf_answers", lambda a: F.coalesce(a["decisions"], F.array().cast(T.ArrayType(schemas.RAW_DECISION)))), none)
        decided = answers.withColumn("_hf_decisions", spans.merge_decisions(lists, F.col("_hf_candidates")))
        seeds = detect.validate(decided, "_hf_decisions")
        shown = prompts.fill_columns(prompts.AUGMENT_STRICT if d.entity_labels else prompts.AUGMENT_OPEN, {"SUMMARY": F.lit(self.summary), "LABELS": F.lit(labels), "TEXT": spans.tagged_text(body, F.col(schemas.ENTITIES), F.col("_hf_notation"))})
        more = self.ask(seeds, shown, "_hf_more", schemas._struct(entities=T.ArrayType(schemas.AUGMENTED)), "entity_augmenter", "entity-augmentation")
        merged = detect.augment(more.withColumn("_hf_suggested", F.col("_hf_more.entities")), "_hf_suggested")
        # decisions count again, for spans that came back under an id they were dropped by
        final = detect.finalize(detect.validate(merged, "_hf_decisions"), labels=d.entity_labels)
        return final.drop("_hf_model_raw", "_hf_answers", "_hf_more", "_hf_suggested")

    def replace(self, frame: DataFrame, config: Config) -> DataFrame:
        how = config.replace
        if not isinstance(how, replacing.Substitute):
            return replacing.replace(frame, how)
        return replacing.replace(self.substitutes(frame, how.instructions), how, pairs="_hf_pairs")

    def substitutes(self, frame: DataFrame, instructions: str | None) -> DataFrame:
        if self.provider is None:
            raise tables.InputError("substitutes need a model: give the engine a provider")
        by = F.col(schemas.BY_VALUES)
        prompt = prompts.fill_columns(prompts.SUBSTITUTE, {"INSTRUCTIONS": F.lit(instructions or ""), "ENTITIES": prompts.entity_lines(by), "EXAMPLES": prompts.entity_examples(by), "TEXT": F.col(schemas.TAGGED)})
        got = self.ask(frame, prompt, "_hf_map_answer", schemas._struct(replacements=T.ArrayType(schemas.REPLACEMENT)), "replacement_generator", "replace-map", F.size(by) > 0)
        return got.withColumn("_hf_pairs", F.coalesce(F.col("_hf_map_answer.replacements"), replacing.no_pairs())).drop("_hf_map_answer")

    def rewrite(self, frame: DataFrame, config: Config) -> DataFrame:
        """Rows with entities are rewritten, evaluated and repaired; others pass through."""
        if self.provider is None:
            raise tables.InputError("rewriting needs a model: give the engine a provider")
        how = config.rewrite
        goal, body, some = F.lit(how.privacy_goal.prompt()), F.col(schemas.TAGGED), F.size(schemas.BY_VALUES) > 0
        mapped = self.substitutes(frame, how.instructions).withColumn(schemas.MAP, replacing.requested_pairs(F.col("_hf_pairs"), F.col(schemas.BY_VALUES)))
        todo, rest = mapped.filter(some), mapped.filter(~some)

        def step(now: DataFrame, template: str, values: dict[str, Column], output: str, kind: T.DataType, role: str, name: str = "rewrite-pipeline") -> DataFrame:
            return self.ask(now, prompts.fill_columns(template, values), output, kind, role, name)

        lists = lambda name, kind: schemas._struct(**{name: T.ArrayType(kind)})
        now = step(todo, prompts.LATENT, {"SUMMARY": F.lit(self.summary), "GOAL": goal, "TEXT": body}, "_hf_l", lists("latent_entities", schemas.LATENT), "latent_detector", "latent-entity-detection")
        now = now.withColumn("_hf_latent", F.coalesce("_hf_l.latent_entities", F.array().cast(T.ArrayType(schemas.LATENT)))).drop("_hf_l")
        now = step(now, prompts.DOMAIN, {"DOMAINS": F.lit(domains.listing()), "TEXT": body}, "_hf_domain", schemas.DOMAIN, "domain_classifier")
        kept, hidden = domains.quality_guidance(F.col("_hf_domain.domain")), domains.privacy_guidance(F.col("_hf_domain.domain"))
        now = step(now, prompts.DISPOSITION, {"GOAL": goal, "GUIDANCE": hidden, "ENTITIES": prompts.entity_lines(F.col(schemas.BY_VALUES)), "LATENT": F.to_json("_hf_latent"), "TEXT": body}, "_hf_d", lists("sensitivity_disposition", schemas.DISPOSITION), "disposition_analyzer")
        fine = F.filter(F.coalesce(F.col("_hf_d.sensitivity_disposition"), F.array().cast(T.ArrayType(schemas.DISPOSITION))), lambda d: F.coalesce(rewrite.consistent(d, how.strict_entity_protection), F.lit(False)))
        now = now.withColumn("_hf_disposition", rewrite.renumbered(fine)).withColumn("_hf_privacy_qa", rewrite.privacy_questions(F.col("_hf_disposition")))
        now = step(now, prompts.MEANING, {"GUIDANCE": kept, "TEXT": body}, "_hf_m", lists("units", schemas.MEANING_UNIT), "meaning_extractor")
        now = step(now, prompts.QUALITY_QA, {"UNITS": F.to_json("_hf_m.units"), "TEXT": body}, "_hf_q", lists("items", schemas.QUALITY_QA), "qa_generator")
        block = rewrite.prompt_block(F.col("_hf_disposition"))
        pairs = rewrite.pairs_for_prompt(F.col(schemas.MAP), block)
        now = self.written_text(now, prompts.fill_columns(prompts.REWRITE, {"GOAL": goal, "INSTRUCTIONS": F.lit(how.instructions or ""), "GUIDANCE": kept, "BLOCK": F.to_json(block), "PAIRS": F.to_json(pairs), "TEXT": body}), "rewriter", "rewrite-pipeline")
        now = now.withColumn("_hf_quality_qa", F.coalesce("_hf_q.items", F.array().cast(T.ArrayType(schemas.QUALITY_QA))))

        def evaluate(x: DataFrame) -> DataFrame:
            out = F.coalesce(F.col(schemas.OUTPUT), F.lit(""))
            ids = lambda c: F.transform(c, lambda q: q["id"])
            empty = lambda kind: F.array().cast(T.ArrayType(kind))
            x = step(x, prompts.ANSWER_PRIVACY, {"QUESTIONS": F.to_json("_hf_privacy_qa"), "TEXT": out}, "_hf_pa", lists("answers", schemas.PRIVACY_ANSWER), "evaluator", "rewrite-evaluate")
            x = step(x, prompts.ANSWER_QUALITY, {"QUESTIONS": F.to_json(F.transform("_hf_quality_qa", lambda q: F.struct(q["id"].alias("id"), q["question"].alias("question")))), "TEXT": out}, "_hf_qa", lists("answers", schemas.QUALITY_ANSWER), "evaluator", "rewrite-evaluate")
            x = x.withColumn("_hf_quality_answers", rewrite.sorted_answers(F.coalesce("_hf_qa.answers", empty(schemas.QUALITY_ANSWER)), ids("_hf_quality_qa"), rewrite.unknown_quality))
            x = step(x, prompts.COMPARE, {"QUESTIONS": F.to_json("_hf_quality_qa"), "ANSWERS": F.to_json("_hf_quality_answers")}, "_hf_cmp", lists("items", schemas.QA_COMPARE), "evaluator", "rewrite-evaluate")
            x = x.withColumns({"_hf_privacy_answers": rewrite.sorted_answers(F.coalesce("_hf_pa.answers", empty(schemas.PRIVACY_ANSWER)), ids("_hf_privacy_qa"), rewrite.assumed_leak), "_hf_compare": rewrite.sorted_answers(F.coalesce("_hf_cmp.items", empty(schemas.QA_COMPARE)), ids("_hf_quality_qa"), rewrite.no_agreement), "_hf_importance": F.transform("_hf_quality_qa", lambda q: q["importance"])})
            return rewrite.score_rows(x.drop("_hf_pa", "_hf_qa", "_hf_cmp", "_hf_quality_answers"), how.tolerance, "_hf_compare", "_hf_importance", "_hf_privacy_answers", "_hf_privacy_qa")

        def repair(x: DataFrame) -> DataFrame:
            block, score = rewrite.prompt_block(F.col("_hf_disposition")), lambda c: F.format_number(F.coalesce(F.col(c), F.lit(0.0)), 2)
            told = {
                "GOAL": goal, "MASS": score("leakage_mass"), "MOST": F.lit(str(how.tolerance.repair_above)), "UTILITY": score("utility_score"), "WARNING": F.when(F.col("any_high_leaked"), "Something of high sensitivity leaks: that has to go first."),
                "LEAKED": rewrite.leaked_items(F.col("_hf_privacy_answers"), F.col("_hf_privacy_qa")), "BLOCK": F.to_json(block), "PAIRS": F.to_json(rewrite.pairs_for_prompt(F.col(schemas.MAP), block)), "ORIGINAL": F.col(schemas.TEXT), "TEXT": F.coalesce(F.col(schemas.OUTPUT), F.lit("")),
            }
            again = prompts.fill_columns(prompts.REPAIR, told)
            x = self.written_text(x, again, "repairer", "rewrite-repair", drop=False)
            return x.drop("_hf_privacy_answers", "_hf_compare", "_hf_importance")

        done = rewrite.repair_loop(now, evaluate, repair, how.max_repair_iterations, self.cut)
        done = done.withColumn("needs_human_review", rewrite.needs_review(F.col(schemas.OUTPUT), F.col("any_high_leaked"), F.col("utility_score"), F.col("leakage_mass"), how.tolerance))
        both = done.unionByName(rest, allowMissingColumns=True)
        both = self.cut(both.withColumn("_hf_mode_rewrite", F.lit(True)), "rewritten")
        out = rewrite.pass_through(both, some, schemas.TEXT, schemas.OUTPUT)
        return out.withColumnRenamed("needs_repair", "_hf_needs_repair").withColumnRenamed("repair_iterations", "_hf_repair_iterations")

    # ------------------------------------------------------------------ entry points

    def run(self, config: Config, data: Input, rows: int | None = None) -> Result:
        """Runs a configuration. With a recorder, write the result's frame and call its ``finish``."""
        self.failed, self.summary, self.ledger = [], data.data_summary or "", Ledger(self.spark, self.folder)
        log.info("%s of column %s", config.mode, data.text_column)
        began = time.monotonic()
        if self.recorder is not None:
            self.recorder.run(config, data)
        loaded = self.load(data, rows)
        kept = self.provider is not None or self.recorder is not None
        frame = self.start(loaded.frame) if kept else loaded.frame
        with self.stage("detection") as made:
            found = self.detect(frame, config)
            found = self.cut(found, "detection", made) if kept else found
        with self.stage(config.mode):
            trace = self.replace(found, config) if config.mode == "replace" else self.rewrite(found, config)
        none = self.spark.createDataFrame([], schemas.FAILED)
        failed = none
        for f in self.failed:
            failed = failed.unionByName(f)
        if self.provider is not None:
            # rows that no step says it failed on, and that are gone all the same
            lost = model.missing_records(frame, trace, config.mode)
            failed = failed.unionByName(lost.join(failed.select("record_id").distinct(), "record_id", "left_anti"))
        user, open_stage = user_columns(trace, loaded.resolved), None
        if self.recorder is not None:
            seen, output = Observation(), f"{loaded.resolved}_{'rewritten' if config.mode == 'rewrite' else 'replaced'}"
            user = user.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length(output)), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.size(schemas.FINAL)), F.lit(0)).alias("entities"))
            open_stage = (self.recorder, self.recorder.record("stage", stage="run", status="started"), seen, began)
        return Result(user, trace, failed, config, loaded.resolved, self.ledger if kept else None, open_stage)

    def export_detection(self, config: Config, data: Input, folder: str) -> str:
        """A detection to be run elsewhere: the input's rows, numbered and with their ids, and the configuration beside them."""
        loaded = self.load(data)
        loaded.frame.write.mode("overwrite").parquet(f"{folder}/rows")
        told = {**spec_of(config), "text_column": loaded.resolved, "data_summary": data.data_summary, "roles": self.roles}
        self.spark.createDataFrame([(json.dumps(told, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/detection")
        return folder

    def run_exported(self, folder: str) -> DataFrame:
        """The rows of an exported detection with what was found in them; failed rows are in ``failed``."""
        told = json.loads("".join(r.value for r in self.spark.read.text(f"{folder}/detection").collect()))
        self.failed, self.summary, self.ledger = [], told["data_summary"] or "", Ledger(self.spark, self.folder)
        self.roles = {**told["roles"], **self.roles}
        rows = self.spark.read.parquet(f"{folder}/rows")
        if self.provider is None:
            return self.detect(rows, config_of(told))
        return self.cut(self.detect(self.start(rows), config_of(told)), "detection")

    def preview(self, config: Config, data: Input, rows: int = 10) -> Result:
        return self.run(config, data, rows)

    def evaluate(self, result: Result, how: Evaluate = Evaluate()) -> Result:
        """Judges' verdicts beside a finished result: all four for substitutes, else detection's (as a share for rewrites)."""
        if self.provider is None:
            raise tables.InputError("judges need a model: give the engine a provider")
        names = list(how.judges) if how.judges else list(judge.JUDGES) if isinstance(result.config.replace, replacing.Substitute) else ["detection"]
        if result.config.mode == "rewrite" and names != ["detection"]:
            raise tables.InputError("of a rewrite only the detection is judged by name; its final judge is always asked")
        now = result.trace
        if result.ledger is None:
            # a run without a model kept nothing
            self.ledger = Ledger(self.spark, self.folder)
            now, _ = self.ledger.put(now, "rows", deal=True)
        else:
            self.ledger = result.ledger
        for name in names:
            j = judge.JUDGES[name]
            items = F.to_json(judge.judged_entities(F.col(schemas.BY_VALUES))) if name == "detection" else F.to_json(schemas.MAP)
            prompt = prompts.fill_columns(prompts.JUDGE, {"WHAT": F.lit(prompts.JUDGED[name][0]), "FIELDS": F.lit(prompts.JUDGED[name][1]), "LABELS": F.lit(prompts.label_examples(result.config.detect.entity_labels or LABEL_NAMES)) if name == "detection" else F.lit(""), "ITEMS": items, "TEXT": F.col(schemas.TAGGED)})
            asked = self.ask(now, prompt, f"_hf_judge_{name}", T.StringType(), f"{name}_judge", f"judge-{name}", ~j.nothing_to_check(), drop=False)
            now = judge.settle(asked, j, f"_hf_judge_{name}")
        if result.config.mode == "rewrite":
            prompt = prompts.fill_columns(prompts.FINAL_JUDGE, {"GOAL": F.lit(result.config.rewrite.privacy_goal.prompt()), "TEXT": F.col(schemas.TEXT), "REWRITTEN": F.coalesce(F.col(schemas.OUTPUT), F.lit(""))})
            now = self.ask(now, prompt, "judge_evaluation", schemas._struct(privacy=schemas.S, quality=schemas.S, style=schemas.S), "rewrite_judge", "rewrite-final-judge", F.size(schemas.BY_VALUES) > 0, drop=False)
            total = F.size(judge.judged_entities(F.col(schemas.BY_VALUES)))
            now = now.withColumn("detection_valid", judge.valid_fraction(F.col("detection_valid"), F.size("detection_invalid"), total))
        return replace(result, frame=user_columns(now, result.text_column), trace=now, ledger=self.ledger)


def validate(config: Config, roles: dict, known: set[str]) -> None:
    """Checks a configuration without reading anything."""
    from .config import check_aliases

    sections = ["detection"] + (["rewrite", "replace"] if config.mode == "rewrite" else ["replace"] if isinstance(config.replace, replacing.Substitute) else [])
    check_aliases(roles, known, sections)


