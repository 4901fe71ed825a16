"""Models, where they are served, and which of them has which role."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from pathlib import Path

from ..operators.model import Answer
from ..sources.tables import InputError
from .config import ROLES, check_aliases, validator_pool

#: Names that roles have in files, where ours differ.
ROLE_NAMES = {"detection_validity_judge": "detection_judge", "replace_type_fidelity_judge": "type_fidelity_judge", "replace_relational_consistency_judge": "relational_judge", "replace_attribute_fidelity_judge": "attribute_judge"}
#: Parameters of a model that are for us, not for its server: seconds a call may take, and calls in flight over the cluster.
OURS = ("timeout", "max_parallel_requests")
#: Answers of these codes are asked for again.
AGAIN = (408, 425, 429, 500, 502, 503, 504)


@dataclass(frozen=True)
class Model:
    alias: str
    model: str
    provider: str
    parameters: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Server:
    """A server of chat completions; ``key`` is a key or the name of a variable that holds it.

    One with ``lists`` answers several prompts of one request, in its completions.
    """

    name: str
    endpoint: str
    key: str | None = None
    lists: bool = False


@dataclass(frozen=True)
class Models:
    models: tuple[Model, ...]
    servers: tuple[Server, ...] = ()
    roles: dict[str, str | list[str]] = field(default_factory=dict)

    def __post_init__(self):
        aliases = [m.alias for m in self.models]
        if not aliases or len(set(aliases)) < len(aliases):
            raise InputError("models have aliases of their own, and there is at least one")
        known = {s.name for s in self.servers}
        unknown = sorted(f"{m.alias} ({m.provider})" for m in self.models if known and m.provider not in known)
        if unknown:
            raise InputError(f"models with a provider that isn't known: {', '.join(unknown)}; known are {', '.join(sorted(known))}")

    @classmethod
    def read(cls, models: str | Path, servers: str | Path | None = None) -> Models:
        """From YAML (or JSON): a path, or the text itself.

        ``model_configs`` lists alias, model, provider and inference_parameters;
        ``selected_models`` has, by section, a role's alias or list of aliases, and may
        leave roles out: they take the first model. ``providers`` (in the same text or
        one of its own) lists name, endpoint and api_key.
        """
        told = plain_values(models)
        listed = told.get("model_configs") or []
        for m in listed:
            if not all(m.get(k) for k in ("alias", "model", "provider")):
                raise InputError(f"a model has alias, model and provider: {m}")
        served = (plain_values(servers) if servers is not None else told).get("providers") or []
        roles: dict[str, str | list[str]] = {}
        known = {r for names in ROLES.values() for r in names}
        for section, chosen in (told.get("selected_models") or {}).items():
            for role, alias in (chosen or {}).items():
                name = ROLE_NAMES.get(role, role)
                if name not in known:
                    raise InputError(f"{section}.{role} isn't a role")
                roles[name] = alias
        made = tuple(Model(m["alias"], m["model"], m["provider"], dict(m.get("inference_parameters") or {})) for m in listed)
        default = made[0].alias if made else "default"
        return cls(made, tuple(Server(p["name"], p["endpoint"], p.get("api_key"), bool(p.get("lists"))) for p in served), {r: roles.get(r, default) for r in sorted(known)})

    def check(self, sections: list[str]) -> None:
        """Every role that the sections use names models that exist."""
        check_aliases(self.roles, {m.alias for m in self.models}, sections)

    def provider(self, **options) -> HttpProvider:
        return HttpProvider(self, **options)


def plain_values(source: str | Path) -> dict:
    """A mapping from YAML or JSON: a path, or the text itself."""
    text = str(source)
    if isinstance(source, Path) or ("\n" not in text and text.rsplit(".", 1)[-1] in ("yaml", "yml", "json")):
        try:
            text = Path(source).expanduser().read_text()
        except OSError as e:
            raise InputError(f"can't read {source}") from e
    try:
        import yaml

        told = yaml.safe_load(text)
    except ImportError:
        told = json.loads(text)
    except Exception as e:
        raise InputError(f"neither YAML nor JSON: {e}") from e
    if not isinstance(told, dict):
        raise InputError("a mapping is expected")
    return told


@dataclass(frozen=True)
class HttpProvider:
    """Asks servers of chat completions, with a time-out and repeated calls after errors that may pass."""

    models: Models
    extra: dict[str, dict] = field(default_factory=dict)
    timeout: float = 120.0
    retries: int = 2
    wait: float = 1.0

    def with_parameters(self, alias: str, more: dict) -> HttpProvider:
        """The same with parameters that every request to an alias carries."""
        return replace(self, extra={**self.extra, alias: {**self.extra.get(alias, {}), **more}})

    @property
    def limits(self) -> dict[str, int]:
        """Calls that may be in flight at once, an alias, for those that say so."""
        return {m.alias: int(m.parameters["max_parallel_requests"]) for m in self.models.models if m.parameters.get("max_parallel_requests")}

    def served(self, alias: str) -> tuple[Model, Server]:
        found = next((m for m in self.models.models if m.alias == alias), None)
        if found is None:
            raise KeyError(f"no model {alias!r}")
        server = next((s for s in self.models.servers if s.name == found.provider), None)
        if server is None:
            raise KeyError(f"no server {found.provider!r}")
        return found, server

    def body(self, prompt: str | list[str], alias: str) -> tuple[str, dict, dict]:
        """URL, headers and JSON of a request."""
        found, server = self.served(alias)
        given = dict(found.parameters)
        extra = {**(given.pop("extra_body", None) or {}), **self.extra.get(alias, {})}
        for name in OURS:
            given.pop(name, None)
        headers = {"Content-Type": "application/json"}
        if server.key:
            headers["Authorization"] = f"Bearer {os.environ.get(server.key, server.key)}"
        url = server.endpoint.rstrip("/")
        what = {"prompt": prompt} if isinstance(prompt, list) else {"messages": [{"role": "user", "content": prompt}]}
        return f"{url}/completions" if isinstance(prompt, list) else f"{url}/chat/completions", headers, {"model": found.model, **what, **given, **extra}

    def send(self, prompt: str | list[str], alias: str) -> dict:
        url, headers, body = self.body(prompt, alias)
        limit = float(self.served(alias)[0].parameters.get("timeout") or self.timeout)
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=limit) as got:
                    return json.loads(got.read())
            except urllib.error.HTTPError as e:
                if e.code not in AGAIN or attempt == self.retries:
                    raise
            except (urllib.error.URLError, TimeoutError):
                if attempt == self.retries:
                    raise
            time.sleep(self.wait * 2**attempt)
        raise RuntimeError("not reached")

    def __call__(self) -> Callable[[str, str], str]:
        return _ListsCall(self) if any(s.lists for s in self.models.servers) else _Call(self)


@dataclass(frozen=True)
class _Call:
    provider: HttpProvider

    def __call__(self, prompt: str, alias: str) -> Answer:
        got = self.provider.send(prompt, alias)
        use = got.get("usage") or {}
        return Answer(got["choices"][0]["message"]["content"], use.get("prompt_tokens"), use.get("completion_tokens"))


@dataclass(frozen=True)
class _ListsCall(_Call):
    """Prompts of one request to servers that take lists; tokens are told with the first answer."""

    def takes_lists(self, alias: str) -> bool:
        return any(m.alias == alias for m in self.provider.models.models) and self.provider.served(alias)[1].lists

    def many(self, prompts: list[str], alias: str) -> list[str | None]:
        got = self.provider.send(prompts, alias)
        use, out = got.get("usage") or {}, [None] * len(prompts)
        for c in got["choices"]:
            first = not any(out)
            out[c["index"]] = Answer(c["text"], *((use.get("prompt_tokens"), use.get("completion_tokens")) if first else ()))
        return out


def pool_of(roles: dict, role: str) -> list[str]:
    return validator_pool(roles.get(role, "default"))
