"""Prompts as column expressions: what is inserted isn't looked at again."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import LABELS, NO_EXAMPLE

PLACE = re.compile(r"<<([A-Z_]+)>>")


def fill(template: str, values: dict[str, str], strict: bool = True) -> str:
    """A template's ``<<NAME>>`` places filled in one pass."""

    def one(m: re.Match) -> str:
        if m[1] not in values:
            if strict:
                raise KeyError(f"nothing for {m[0]}")
            return m[0]
        return values[m[1]]

    return PLACE.sub(one, template)


def fill_columns(template: str, values: dict[str, Column]) -> Column:
    """The same with columns: one concatenation; nulls are empty."""
    parts, at = [], 0
    for m in PLACE.finditer(template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(values[m[1]], F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def label_examples(labels: list[str]) -> str:
    return "\n".join(f"- {x}: e.g. {LABELS[x]}" if x in LABELS else f"- {x}" for x in labels)


def entity_examples(by_value: Column) -> Column:
    """JSON of an example for each label in use, in the order of labels; empty without any."""
    labels = F.sort_array(F.array_distinct(F.flatten(F.transform(by_value, lambda v: v["labels"]))))
    known = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    entries = F.map_from_entries(F.transform(labels, lambda x: F.struct(x, F.coalesce(F.try_element_at(known, x), F.lit(NO_EXAMPLE)))))
    return F.when(F.size(labels) > 0, F.to_json(entries)).otherwise("")


def entity_lines(by_value: Column) -> Column:
    return F.array_join(F.transform(by_value, lambda v: F.concat(F.lit("- "), v["value"], F.lit(" ("), F.array_join(v["labels"], ", "), F.lit(")"))), "\n")


VALIDATE = """Say for each entity of the text whether it is what its label says.
<<SUMMARY>>
Entities are marked in the "<<NOTATION>>" notation.
- keep: the label fits the words where they stand.
- reclass: the words are sensitive but another label of the list fits better; write it as proposed_label.
- drop: in this place the words tell nothing of a person, an organisation, a place, a time, an account or a device.
Labels to choose from, no others:
<<LABELS>>
Pieces of words: where a letter, a digit or an underscore stands right before or right after the marks, only part of a longer word is marked, as in "sub<<PIECE>>_sum". Drop these always, however sensitive they look.
Ages: a number is an age only where the words say that somebody is so old. How long something takes, amounts, sizes, codes, counts and dates are none; in doubt drop.
Public names: drop a person whom the whole world knows. Towns, firms and schools stay, for they narrow down who is meant.
Also drop names of fields and columns, words of a format or a program, words that only repeat their label, days told from today, and words for relatives or roles that aren't a profession. Kinds of numbers that look alike (accounts, identity cards, telephones, vehicles) go by what the text calls them.
Judge by the words around an entity, not by the value alone. Answer every id once and leave ids as they are; reason is one short sentence.
<<EXCERPT>>
Replace the nulls of this JSON and return nothing else: <<SKELETON>>"""
_AUGMENT = """List entities that the tags miss.
<<SUMMARY>>
Tagged words are known already: don't list them again. Copy values letter by letter from the text, each value once. Leave out pronouns, common nouns and placeholders.
{0}
<<LABELS>>
<<TEXT>>
Return JSON: {{"entities": [{{"value": "...", "label": "...", "reason": "..."}}]}}; an empty list if nothing is missing."""
#: Where the user names labels only these are allowed; else others may be made up.
AUGMENT_STRICT = _AUGMENT.format("Use these labels and no others:")
AUGMENT_OPEN = _AUGMENT.format("Prefer these labels; where none fits, make one up in lower case with underscores:")
LATENT = """List what can be inferred about a person from the text although it isn't said.
<<SUMMARY>>
<<GOAL>>
Only what two or more hints of the text support counts; what is tagged is said, not inferred. confidence is high, medium or low; evidence quotes the hints.
<<TEXT>>
Return JSON: {"latent_entities": [{"category": "...", "label": "...", "value": "...", "confidence": "...", "evidence": ["..."], "rationale": "..."}]}"""
SUBSTITUTE = """Make up a replacement for each entity.
<<INSTRUCTIONS>>
A replacement is of the same kind, length and style as the original and fits the sentence (case, gender, number, language). People, places and firms are invented. Entities that belong together (a name and its e-mail address, a city and its postcode) stay together; the same original gets the same replacement. No replacement equals an original of the list.
Entities:
<<ENTITIES>>
Examples of labels: <<EXAMPLES>>
<<TEXT>>
Return JSON: {"replacements": [{"original": "...", "label": "...", "synthetic": "..."}]}"""
DOMAIN = """Name the domain of the text.
<<DOMAINS>>
<<TEXT>>
Return JSON: {"domain": "one of the names above", "domain_confidence": 0.0 to 1.0}"""
DISPOSITION = """For each entity: sensitivity, how far it identifies someone together with the others, and how to protect it.
<<GOAL>>
<<GUIDANCE>>
category: direct_identifier, quasi_identifier, latent_identifier or sensitive_attribute. sensitivity and combined_risk_level: high, medium or low. protection_method_suggestion: replace, generalize, remove, suppress_inference or leave_as_is; of low risk leave_as_is, of high risk never.
Entities:
<<ENTITIES>>
Inferred:
<<LATENT>>
<<TEXT>>
Return JSON: {"sensitivity_disposition": [{"id": 1, "source": "tagged or latent", "category": "...", "sensitivity": "...", "entity_label": "...", "entity_value": "...", "protection_reason": "...", "protection_method_suggestion": "...", "combined_risk_level": "..."}]}"""
MEANING = """List what the text says that must survive a rewrite.
<<GUIDANCE>>
One statement a unit, in general words, without tagged values. importance is critical or important.
<<TEXT>>
Return JSON: {"units": [{"id": 1, "aspect": "...", "unit": "...", "importance": "..."}]}"""
QUALITY_QA = """Ask a question for each unit, with its answer from the text.
A question is answered by what the unit says, names no one, and keeps the unit's id, aspect and importance.
<<UNITS>>
<<TEXT>>
Return JSON: {"items": [{"id": 1, "aspect": "...", "importance": "...", "question": "...", "reference_answer": "..."}]}"""
REWRITE = """Rewrite the text.
<<GOAL>>
<<INSTRUCTIONS>>
<<GUIDANCE>>
Each entity to protect is treated by its method: replace (take the given replacement), generalize (say it less exactly), remove (leave it out), suppress_inference (change the hints). Tags don't appear in the answer. Everything else keeps its meaning, order and tone.
Protect: <<BLOCK>>
Replacements: <<PAIRS>>
<<TEXT>>
Return JSON: {"rewritten_text": "..."}"""
ANSWER_PRIVACY = """Answer each question with yes or no from the text alone.
yes: the text says it or a careful reader could work it out. confidence is from 0.0 to 1.0; evidence quotes what was used.
<<QUESTIONS>>
<<TEXT>>
Return JSON: {"answers": [{"id": 1, "answer": "yes or no", "confidence": 0.0, "reason": "...", "evidence": ["..."]}]}"""
ANSWER_QUALITY = """Answer each question from the text alone, in one sentence; unknown if it doesn't say.
<<QUESTIONS>>
<<TEXT>>
Return JSON: {"answers": [{"id": 1, "answer": "..."}]}"""
COMPARE = """Score from 0.0 to 1.0 how far each answer says the same as the reference answer.
Other names, numbers or dates don't count against it if they were to be protected; unknown is 0.0.
<<QUESTIONS>>
<<ANSWERS>>
Return JSON: {"items": [{"id": 1, "score": 0.0, "reason": "..."}]}"""
REPAIR = """Rewrite again so that what leaked can't be told any more.
<<GOAL>>
The last rewrite leaks <<MASS>>, which has to be below <<MOST>>; its use is <<UTILITY>> of 1. <<WARNING>>
Leaked (questions that can still be answered):
<<LEAKED>>
To protect: <<BLOCK>>
Replacements to use: <<PAIRS>>
Look for every hint that leads to an answer, also for hints that tell it only together, and take away or blur as many as are needed for another answer to be as likely. Other words for the same hint are no cure. What leads to no answer stays word by word, and the whole reads as one text.
The original:
<<ORIGINAL>>
---
The last rewrite:
<<TEXT>>
Return JSON: {"rewritten_text": "..."}"""
FINAL_JUDGE = """Judge privacy, quality and style of the second text as a rewrite of the first: high, medium or low each.
<<GOAL>>
<<TEXT>>
---
<<REWRITTEN>>
Return JSON: {"privacy": "...", "quality": "...", "style": "..."}"""
#: What each judge looks at, and the fields of its items.
JUDGED = {
    "detection": ("whether each value is sensitive here and its label right; list only those that aren't", "value, label, reason"),
    "type_fidelity": ("whether each replacement is of its label's kind; list only those that aren't", "original, label, synthetic, reason"),
    "relational": ("whether replacements that belong together still do; list every relation", "relation, passes, reason"),
    "attribute": ("whether replacements keep gender, language, region and age group; list every attribute", "original, synthetic, attribute, passes, reason"),
}
JUDGE = """Judge: <<WHAT>>.
<<LABELS>>
<<ITEMS>>
<<TEXT>>
Return JSON: {"all_valid": true or false, "items": [objects with <<FIELDS>>]}"""
