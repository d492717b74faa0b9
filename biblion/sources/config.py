"""Driver-side settings: source registries, settings, a selection and its identity, queries of the works API."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any
from urllib.parse import urlparse

from ..schemas import DEFAULT_ENTITIES, ENTITY_TYPES, OAI_WORK_TYPES, WORK_TYPES

# Spellings of settings, domains that are no contact.
YES, NO, NOTHING = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}, {"", "none", "null"}
PLACEHOLDER_DOMAINS = {"example.com", "example.org", "example.net"}
# Shapes of identifiers.
INSTITUTION = re.compile(r"(?:https?://openalex\.org/)?I[A-Z0-9]+", re.I)
ROR = re.compile(r"https?://ror\.org/[0-9a-z]{9}", re.I)
SOURCE_ID = re.compile(r"[a-z0-9][a-z0-9_-]*")
# End of the fixed values.


@dataclass(frozen=True)
class Source:
    """One repository: ``kind`` is dspace or oai; ``types`` are entity types or publication types."""

    kind: str
    id: str
    label: str
    base_url: str
    types: tuple[str, ...]
    configuration: str = "default"
    scope: str | None = None
    prefix: str = "oai_dc"
    set_spec: str | None = None
    openalex_institution_id: str | None = None
    ror_id: str | None = None

    @property
    def home(self) -> str:
        """The address that people visit: a repository's API lies below it."""
        return re.sub(r"/server/api/*$", "", self.base_url.rstrip("/"))


def slug(value: object) -> str:
    return re.sub(r"[^a-z0-9]+", "-", str(value).lower()).strip("-")


def _clean(values: Mapping[str, Any], name: str, default: str = "") -> str:
    return str(values.get(name) or default).strip()


def _whole(pattern: re.Pattern, value: object) -> str | None:
    value = str(value or "").strip()
    return value if pattern.fullmatch(value) else None


def _source(kind: str, values: Mapping[str, Any]) -> Source | None:
    ident, url = _clean(values, "id").lower(), _clean(values, "base_url").rstrip("/")
    address, prefix = urlparse(url), _clean(values, "metadata_prefix", "oai_dc")
    usable = values.get("enabled", True) is not False and SOURCE_ID.fullmatch(ident) and address.scheme in ("http", "https") and address.netloc and not re.search(r"\s", prefix)
    if not usable:
        return None
    if kind == "dspace":
        types = tuple(str(t).strip() for t in values.get("entity_types") or DEFAULT_ENTITIES if str(t).strip()) or DEFAULT_ENTITIES
    else:
        types = tuple(dict.fromkeys(slug(t) for t in values.get("publication_types") or OAI_WORK_TYPES if str(t).strip())) or tuple(OAI_WORK_TYPES)
    return Source(kind, ident, _clean(values, "label", ident) or ident, url, types, _clean(values, "configuration", "default"), _clean(values, "scope") or None, prefix,
                  _clean(values, "set") or _clean(values, "set_spec") or None, _whole(INSTITUTION, values.get("openalex_institution_id")), _whole(ROR, values.get("ror_id")))


def parse_sources(kind: str, raw: object) -> list[Source]:
    """Usable sources of a registry: disabled, malformed and repeated ones go (the first of an id stays)."""
    entries = [raw] if isinstance(raw, Mapping) else raw if isinstance(raw, (list, tuple)) else []
    found = [s for e in entries if isinstance(e, Mapping) and (s := _source(kind, e))]
    return list({s.id: s for s in reversed(found)}.values())[::-1]


def registry(kind: str, path: str, key: str, overrides: object = None) -> list[Source]:
    """Sources of a TOML file under ``key``; overrides of the same id replace them, others follow."""
    own = tomllib.loads(Path(path).read_text(encoding="utf-8")).get(key) if Path(path).is_file() else None
    return list(({s.id: s for s in parse_sources(kind, own)} | {s.id: s for s in parse_sources(kind, overrides)}).values())


def setting(settings: Mapping[str, Any], name: str) -> str | None:
    """A text setting, dotted names descend one section; blank, none and null are no value."""
    section, _, key = name.rpartition(".")
    value = ((settings.get(section) or {}) if section else settings).get(key)
    text = "" if value is None else str(value).strip()
    return None if text.lower() in NOTHING else text


def flag(settings: Mapping[str, Any], name: str) -> bool | None:
    word = (setting(settings, name) or "").lower()
    return True if word in YES else False if word in NO else None


def has_contact(agent: str | None) -> bool:
    """A user agent names a mail address of a real domain."""
    m = re.search(r"mailto:([^\s)]+@[^\s)]+)", agent or "", re.I)
    domain = m[1].rsplit("@", 1)[-1].lower() if m else ""
    return bool(m) and domain not in PLACEHOLDER_DOMAINS and not domain.endswith(".invalid")


@dataclass(frozen=True)
class Selection:
    """What to fetch: the logical query."""

    institutions: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    from_date: str | None = None
    to_date: str | None = None
    model: str = "skip"
    limit: int | None = None
    works_api: bool = True
    sources: tuple[Source, ...] = ()
    user_agent: str = ""
    classifier_url: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)

    def identity(self) -> dict[str, Any]:
        """The stable key of a result; holds no secrets."""
        names = (["openalex"] if self.works_api else []) + [s.id for kind in ("dspace", "oai") for s in self.sources if s.kind == kind]
        return {"sources": names, "institutions": list(self.institutions), "types": list(self.types), "model": self.model, "from": self.from_date, "to": self.to_date, "limit": self.limit}

    def errors(self) -> list[str]:
        """What must be set right before a fetch."""
        wrong = []
        if self.works_api and not has_contact(self.user_agent):
            wrong.append("the works API needs a user agent with a contact address (mailto:)")
        if self.model != "skip" and not self.classifier_url:
            wrong.append("classification needs the classifier's address")
        return wrong


def works_filter(institutions: Iterable[str], types: Iterable[str] = (), begin: str | None = None, end: str | None = None) -> str:
    """Filter of the works API. ROR ids count only where no institution id is given."""
    given = [str(i).strip() for i in institutions]
    ids = list(dict.fromkeys(i.split("/")[-1] for i in given if INSTITUTION.fullmatch(i)))
    rors = list(dict.fromkeys(i for i in given if ROR.fullmatch(i)))
    if not ids and not rors:
        raise ValueError("no valid institution or ROR id")
    parts = [f"institutions.id:{'|'.join(ids)}" if ids else f"institutions.ror:{'|'.join(rors)}", "is_paratext:false"]
    parts += [f"{name}:{value}" for name, value in (("from_publication_date", begin), ("to_publication_date", end)) if value]
    kinds = list(dict.fromkeys(t for t in (str(t).strip() for t in types) if t))
    return ",".join(parts + ([f"type:{'|'.join(kinds)}"] if kinds else []))


def works_filters(chosen: Selection) -> list[str]:
    """One filter per group of identifiers (ids, RORs); none where no chosen type is on offer there."""
    kinds = [t for t in chosen.types if t in WORK_TYPES]
    if chosen.types and not kinds:
        return []
    groups = [[i for i in dict.fromkeys(chosen.institutions) if p.fullmatch(i.strip())] for p in (INSTITUTION, ROR)]
    return [works_filter(g, kinds, chosen.from_date, chosen.to_date) for g in groups if g]


def entity_types(source: Source, types: Iterable[str]) -> list[str]:
    """Entity types of a repository to ask for, each once."""
    chosen = set(types)
    wanted = {ENTITY_TYPES.get(t, t) for t in chosen}
    return [e for e in dict.fromkeys(source.types) if not chosen or e in wanted or slug(e) in chosen]
