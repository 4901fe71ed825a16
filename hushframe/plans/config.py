"""What a run is told: input, detection, one mode, model roles."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.judge import JUDGES
from ..operators.replace import METHODS, Annotate, Hash, Redact, Substitute, method
from ..operators.rewrite import PrivacyGoal, Rewrite
from ..sources.tables import InputError, is_remote

#: The names of the labels that are looked for by default.
LABEL_NAMES = (
    "occupation certificate_license_number first_name date_of_birth ssn medical_record_number password unique_id phone_number national_id swift_bic company_name country license_plate tax_id "
    "employee_id pin state email date_time api_key biometric_identifier credit_debit_card coordinate device_identifier city postcode bank_routing_number vehicle_identifier health_plan_beneficiary_number "
    "url ipv4 last_name cvv customer_id date user_name street_address ipv6 account_number time age fax_number county gender sexuality political_view race_ethnicity religious_belief language "
    "blood_type mac_address http_cookie employment_status education_level university court_name prison_detention_facility nationality degree field_of_study place_name landmark organization_name monetary_amount"
).split()
#: Examples of the labels, for prompts.
EXAMPLES = {
    "occupation": ("beekeeper", "tram driver"), "certificate_license_number": ("PILOT-88-2041", "ELC 55109"), "first_name": ("Ottilie", "Bashir"), "date_of_birth": ("1971-02-17", "9 May 2003"),
    "ssn": ("900-11-2233", "987-65-4320"), "medical_record_number": ("PAT-0077113", "KH/20881"), "password": ("tea4Two&scones", "lantern-Orbit-19"), "unique_id": ("u-55b0-9d", "0000417733"),
    "phone_number": ("+49 30 5550 118", "(202) 555-0143"), "national_id": ("X1234567L", "850101-1239"), "swift_bic": ("ABNKNL2A", "TESTGB2LXXX"), "company_name": ("Fjordlight Ferries", "Quillon & Daughters"),
    "country": ("Uruguay", "Latvia"), "license_plate": ("B-XY 4711", "7QRT902"), "tax_id": ("DE000111222", "12-0009876"), "employee_id": ("staff 40977", "W-1187"), "pin": ("8052", "330917"),
    "state": ("Bavaria", "Oregon"), "email": ("o.lindqvist@example.org", "kitchen@cafe.example"), "date_time": ("2019-11-03 18:05", "3 June 2020, 07:40"), "api_key": ("key_live_0f3c77aa91", "tok-9QmZ11xx"),
    "biometric_identifier": ("iris scan 20-771", "voiceprint VP0093"), "credit_debit_card": ("4000 0000 0000 0002", "5555-4444-3333-1111"), "coordinate": ("59.3293 N, 18.0686 E", "-33.8688, 151.2093"),
    "device_identifier": ("SN C02-TEST-77", "356938035643809"), "city": ("Tartu", "Valparaiso"), "postcode": ("10115", "SW1A 0AA"), "bank_routing_number": ("011000015", "20-00-00"),
    "vehicle_identifier": ("1M8GDM9AXKP042788", "hull 88-B"), "health_plan_beneficiary_number": ("HP 44-0912", "A123456780"), "url": ("https://example.org/menu", "www.harbour.example"), "ipv4": ("203.0.113.9", "198.51.100.44"),
    "last_name": ("Okonkwo", "Lindqvist"), "cvv": ("907", "4412"), "customer_id": ("client 7781", "K-00912"), "date": ("14 August 2011", "2001/12/24"), "user_name": ("moss_and_fern", "ravi.k.84"),
    "street_address": ("12 Lantern Row", "Hauptgasse 7a"), "ipv6": ("2001:db8::8a2e:370", "2001:db8:0:1::5"), "account_number": ("NL00TEST0123456789", "88-1203-55"), "time": ("06:55", "half past nine"), "age": ("34 years old", "61"),
    "fax_number": ("+44 20 7946 0991", "(303) 555-0178"), "county": ("Cornwall", "Kerry"), "gender": ("woman", "non-binary"), "sexuality": ("bisexual", "gay"), "political_view": ("liberal", "green voter"),
    "race_ethnicity": ("Maori", "Sami"), "religious_belief": ("Quaker", "Hindu"), "language": ("Welsh", "Tagalog"), "blood_type": ("O negative", "AB+"), "mac_address": ("00:00:5E:00:53:AF", "02-00-5e-10-00-01"),
    "http_cookie": ("sid=77qz; Path=/", "cart_token=b41"), "employment_status": ("on parental leave", "self-employed"), "education_level": ("completed vocational training", "two years of college"),
    "university": ("University of Coimbra", "Uppsala University"), "court_name": ("Leeds Crown Court", "Landgericht Bonn"), "prison_detention_facility": ("Alcatraz", "Fleet Prison"), "nationality": ("Icelandic", "Peruvian"),
    "degree": ("Magister", "BSc"), "field_of_study": ("marine biology", "art history"), "place_name": ("Lake Baikal", "the Black Forest"), "landmark": ("the Atomium", "Charles Bridge"),
    "organization_name": ("the rowing club of Ghent", "Friends of the Canal"), "monetary_amount": ("EUR 1,250", "40 pounds"),
}
#: Label -> its examples as a prompt shows them.
LABELS = {name: ", ".join(EXAMPLES[name]) for name in LABEL_NAMES}
#: What a replacement prompt says of a label without an example.
NO_EXAMPLE = "(make up a realistic value)"


@dataclass(frozen=True)
class Input:
    source: str | DataFrame
    text_column: str = "text"
    id_column: str | None = None
    data_summary: str | None = None

    def __post_init__(self):
        if not self.text_column:
            raise InputError("text_column is empty")
        if isinstance(self.source, str) and "://" in self.source and not is_remote(self.source) and self.source.split("://")[0] not in ("file", "hdfs", "s3a", "viewfs", "abfss", "gs"):
            raise InputError(f"{self.source}: scheme isn't supported")


@dataclass(frozen=True)
class Detect:
    entity_labels: list[str] | None = None
    threshold: float = 0.3
    validation_max_entities_per_call: int = 100
    validation_excerpt_window_chars: int = 500

    def __post_init__(self):
        if not 0 <= self.threshold <= 1:
            raise InputError("threshold is between 0 and 1")
        if self.validation_max_entities_per_call < 1 or self.validation_excerpt_window_chars < 1:
            raise InputError("limits of validation are 1 or more")
        if self.entity_labels is not None:
            clean = sorted({x.strip().lower() for x in self.entity_labels if x.strip()})
            if not clean:
                raise InputError("entity_labels is empty; None stands for all")
            object.__setattr__(self, "entity_labels", clean)


@dataclass(frozen=True)
class Config:
    detect: Detect = field(default_factory=Detect)
    replace: Redact | Annotate | Hash | Substitute | None = None
    rewrite: Rewrite | None = None

    def __post_init__(self):
        if (self.replace is None) == (self.rewrite is None):
            raise InputError("exactly one of replace and rewrite is given")

    @property
    def mode(self) -> str:
        return "replace" if self.replace is not None else "rewrite"


@dataclass(frozen=True)
class Evaluate:
    """Which judges look at a finished result; without a choice, those that its mode calls for."""

    judges: tuple[str, ...] | None = None

    def __post_init__(self):
        unknown = sorted(set(self.judges or ()) - set(JUDGES))
        if unknown or self.judges == ():
            raise InputError(f"there is no judge named {', '.join(unknown)}" if unknown else "judges is empty; None stands for those of the mode")


def validator_pool(aliases: str | list[str] | tuple[str, ...]) -> list[str]:
    """Aliases in order, each once."""
    if not isinstance(aliases, str | list | tuple):
        raise TypeError("a validator pool is an alias or a list of aliases")
    clean = [str(a).strip() for a in ([aliases] if isinstance(aliases, str) else aliases)]
    found = list(dict.fromkeys(a for a in clean if a))
    if not found:
        raise InputError("the validator pool is empty")
    return found


#: Roles of models by what uses them.
ROLES = {
    "detection": ("entity_detector", "entity_validator", "entity_augmenter", "latent_detector"),
    "replace": ("replacement_generator",),
    "rewrite": ("domain_classifier", "disposition_analyzer", "meaning_extractor", "qa_generator", "rewriter", "evaluator", "repairer"),
    "evaluate": ("detection_judge", "type_fidelity_judge", "relational_judge", "attribute_judge", "rewrite_judge"),
}


def check_aliases(roles: dict[str, str | list[str]], known: set[str], sections: list[str]) -> None:
    """Every role that the sections use has aliases that exist."""
    for section in sections:
        for role in ROLES[section]:
            for alias in validator_pool(roles.get(role, "default")):
                if alias not in known:
                    raise InputError(f"role {role} names {alias!r}, which isn't a model")


def config_of(spec: dict) -> Config:
    """A configuration from plain values: detect, and replace (with its kind) or rewrite."""
    detect = Detect(**spec.get("detect", {}))
    how = method(**spec["replace"]) if "replace" in spec else None
    if "rewrite" not in spec:
        return Config(detect, replace=how or method("redact"))
    told = dict(spec["rewrite"])
    if isinstance(told.get("privacy_goal"), dict):
        told["privacy_goal"] = PrivacyGoal(**told["privacy_goal"])
    return Config(detect, rewrite=Rewrite(**told), replace=how)


def spec_of(config: Config) -> dict:
    """The inverse: plain values that ``config_of`` makes the same configuration of, and that JSON and YAML hold."""
    out: dict = {"detect": dataclasses.asdict(config.detect)}
    if config.replace is not None:
        kind = next(k for k, v in METHODS.items() if type(config.replace) is v)
        out["replace"] = {"kind": kind, **dataclasses.asdict(config.replace)}
    if config.rewrite is not None:
        out["rewrite"] = dataclasses.asdict(config.rewrite)
    return out
