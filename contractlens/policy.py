"""Organizational policy: rules that a platform lays on every contract, with conditions, exemptions, injected rules and control tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from datetime import date, timedelta

from . import plugins
from .contract import FORMATS, ROLES, Contract, ContractError, Dataset, Field, _load, _Node, _rule, absolute_location, normal_location

#: The policy types, and those of them that look at a contract as a whole.
TYPES = (
    "require_catalog require_field field_naming_convention require_extension require_format require_dataset_description "
    "require_extension_if require_dataset_type forbid_control_sensitivity_tags require_control_registration "
    "require_registered_control_type require_absolute_location"
).split()
CONTRACT_TYPES = "require_extension require_extension_if".split()
SCOPES, POLICY_MODES, GUARANTEES = "inputs outputs all".split(), "enforce warn".split(), "data_asset_schema_consistency data_asset_downstream_consumption".split()
CONTROL_TAGS = ["pii", "financial"]


class PolicyError(ContractError):
    """A document that is no policy; the message says where."""


@dataclass(frozen=True)
class Rule:
    id: str
    type: str
    properties: dict
    description: str | None = None
    scope: str = "all"
    tag: str | None = None  # only datasets that carry this sensitivity tag
    mode: str = "enforce"


@dataclass(frozen=True)
class Exemption:
    contract: str
    rules: tuple
    reason: str
    review_by: date | None = None


@dataclass(frozen=True)
class ControlTable:
    location: str
    owner: str
    purpose: str | None = None
    required_fields: tuple = ()
    review_by: date | None = None


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple = ()
    injected: tuple = ()
    least_options: dict = field(default_factory=dict)
    exemptions: tuple = ()
    custom: dict = field(default_factory=dict)
    guarantees: tuple = ()
    guarantee_mode: str = "enforce"
    custom_guarantees: dict = field(default_factory=dict)
    control_tables: tuple = ()


@dataclass(frozen=True)
class Finding:
    rule: str
    type: str
    mode: str
    dataset: str | None
    message: str


# --- reading


def _choice(n: _Node, key: str, known: list[str], default: str) -> str:
    got = (n.text(key) or default).strip().lower()
    if got not in known:
        raise PolicyError(f"{n.at}.{key}: {got!r} is none of {', '.join(known)}")
    return got


def _date(n: _Node) -> date | None:
    got = n.text("reviewBy")
    try:
        return got and date.fromisoformat(got)
    except ValueError:
        raise PolicyError(f"{n.at}.reviewBy: {got!r} is no date of the form 2030-12-31") from None


def _policy_rule(n: _Node) -> Rule:
    tag = n.get("when") and _Node(n.get("when"), f"{n.at}.when").text("sensitivityTag", True)
    rest = {k: v for k, v in n.value.items() if k not in ("id", "type", "description", "scope", "when", "mode")}
    return Rule(n.text("id", True), n.text("type", True), rest, n.text("description"), _choice(n, "scope", SCOPES, "all"), tag, _choice(n, "mode", POLICY_MODES, "enforce"))


def _names(n: _Node, key: str) -> dict:
    return {k: str(v) for k, v in _Node(n.get(key, {}), f"{n.at}.{key}").value.items()}


def parse_policy(text: str) -> Policy:
    """A policy from YAML; raises PolicyError, with the place, on what is none."""
    try:
        n = _Node(_load(text), "policy")
        version = n.text("version", True)
        inject = _Node(n.get("inject", {}), "inject")
        options = _Node(inject.get("minVerificationOptions", {}), "inject.minVerificationOptions")
        sure = _Node(n.get("typeGuarantees", {}), "typeGuarantees")
        exemptions = [Exemption(x.text("contractId", True), x.texts("policyIds"), x.text("reason", True), _date(x)) for x in n.nodes("exemptions")]
        tables = [ControlTable(x.text("location", True), x.text("owner", True), x.text("purpose"), x.texts("requiredFields"), _date(x)) for x in n.nodes("controlTables")]
        return Policy(
            version,
            tuple(_policy_rule(x) for x in n.nodes("policies")),
            tuple(_rule(x) for x in inject.nodes("rules")),
            {k: options.flag(k) for k in options.value},
            tuple(exemptions),
            _names(n, "customPolicyTypes"),
            tuple(dict.fromkeys(sure.texts("enabled"))),
            _choice(sure, "mode", POLICY_MODES, "enforce"),
            _names(sure, "customTypeGuaranteeTypes"),
            tuple(tables),
        )
    except PolicyError:
        raise
    except ContractError as x:
        raise PolicyError(str(x)) from x


def _list(value) -> list[str]:
    """A list of texts, or one text."""
    got = value if isinstance(value, list) else [] if value is None else [value]
    return [str(x) for x in got if str(x)]


def _flag(value) -> bool | None:
    return value if isinstance(value, bool) else {"true": True, "false": False}.get(str(value).strip().lower())


def sound(rule: Rule) -> bool:
    """Whether a rule of a known type has the properties that its type needs."""
    p = rule.properties
    if rule.type == "require_field":
        return p.get("name") is not None
    if rule.type == "require_extension":
        return p.get("key") is not None
    if rule.type == "require_extension_if":
        return p.get("ifKey") is not None and p.get("thenKey") is not None
    if rule.type == "require_format":
        return bool(_list(p.get("formats")))
    if rule.type == "field_naming_convention":
        try:
            return p.get("pattern") is not None and bool(re.compile(str(p["pattern"])))
        except re.error:
            return False
    if rule.type == "require_dataset_type":
        return "types" not in p or (bool(_list(p["types"])) and all(x.strip().upper() in ROLES for x in _list(p["types"])))
    if rule.type in ("forbid_control_sensitivity_tags", "require_absolute_location"):
        key = "tags" if rule.type.startswith("forbid") else "catalogs"
        return key not in p or bool(_list(p[key]))
    if rule.type == "require_control_registration":
        return "requireRegistration" not in p or _flag(p["requireRegistration"]) is not None
    return True


def validate_policy(p: Policy) -> list[tuple[str, str]]:
    """(ERROR or WARNING, message) findings on the policy document itself."""
    out, ids = [], [r.id for r in p.rules]
    out += [("ERROR", f"policy {x} is declared twice") for x in sorted({x for x in ids if ids.count(x) > 1})]
    for r in p.rules:
        if r.type in TYPES and not sound(r):
            out.append(("ERROR", f"policy {r.id}: {r.type} has missing or wrong properties"))
        elif r.type not in TYPES and r.type not in p.custom:
            out.append(("WARNING", f"policy {r.id}: nothing checks type {r.type}"))
        if r.type in CONTRACT_TYPES and (r.scope != "all" or r.tag):
            out.append(("WARNING", f"policy {r.id}: scope and when have no effect on {r.type}"))
        if r.type == "require_format":
            out += [("WARNING", f"policy {r.id}: {f} is no known format") for f in _list(r.properties.get("formats")) if f.lower() not in FORMATS]
    out += [("ERROR", f"exemption of {e.contract}: no policy {x}") for e in p.exemptions for x in e.rules if x not in ids]
    out += [("WARNING", f"customPolicyTypes: {k} is built in, which comes first") for k in p.custom if k in TYPES]
    out += [("WARNING", f"typeGuarantees: nothing checks {g}") for g in p.guarantees if g not in GUARANTEES and g not in p.custom_guarantees]
    at = [normal_location(t.location) for t in p.control_tables]
    return out + [("ERROR", f"controlTables: {x} is registered twice") for x in sorted({x for x in at if at.count(x) > 1})]


# --- evaluation


def _fields(schema) -> list[Field]:
    """All fields, nested ones after their own."""
    return [x for f in schema for x in (f, *_fields(f.properties))]


def _tags(d: Dataset) -> set[str]:
    return {t for f in _fields(d.schema) for t in f.tags}


def _active(review_by: date | None, today: date) -> bool:
    return review_by is None or review_by >= today


def _has(extensions: dict, key: str, value) -> bool:
    got = extensions.get(key)
    return got is not None and (value is None or str(got) == str(value))


def _catalog(d, p):
    want = p.get("technology")
    if not (d.catalog.get("required") and (want is None or d.catalog.get("technology") == str(want))):
        return "must declare catalog.required" + (f" with technology {want}" if want is not None else "")


def _field(d, p):
    f = next((f for f in d.schema if f.name == str(p["name"])), None)
    want = p.get("fieldType")
    if f is None or (want is not None and f.type.lower() != str(want).lower()):
        return f"must declare a field {p['name']}" + (f" of type {want}" if want is not None else "")


def _naming(d, p):
    if bad := [f.name for f in _fields(d.schema) if not re.fullmatch(str(p["pattern"]), f.name)]:
        return f"has fields that do not match {p['pattern']}: {', '.join(bad)}"


def _format(d, p):
    allowed = _list(p["formats"])
    if d.format is None or d.format.lower() not in [x.lower() for x in allowed]:
        return f"must declare a format of {', '.join(allowed)}, it is {d.format or 'not declared'}"


def _described(d, p):
    if not (d.description or "").strip():
        return "must have a description"


def _typed(d, p):
    allowed = [x.strip().upper() for x in _list(p.get("types"))] or ROLES
    if d.role not in allowed:
        return f"must declare a type of {', '.join(allowed)}, it is {d.role or 'not declared'}"


def _absolute(d, p):
    first, _, rest = normal_location(d.location).partition("/")
    in_catalog = rest and first.lower() in [x.lower() for x in _list(p.get("catalogs"))]
    if not (absolute_location(d.location) or d.location.startswith("ref://") or in_catalog):
        return f"must be at an absolute location; {d.location} matches any that ends in it"


def _untagged(d, p):
    found = {t.lower() for t in _tags(d)} & {t.lower() for t in _list(p.get("tags")) or CONTROL_TAGS}
    if d.role == "CONTROL" and found:
        return f"is CONTROL but carries {', '.join(sorted(found))}"


#: Type of policy -> what is wrong with a dataset, or None.
ON_DATASETS = {
    "require_catalog": _catalog,
    "require_field": _field,
    "field_naming_convention": _naming,
    "require_format": _format,
    "require_dataset_description": _described,
    "require_dataset_type": _typed,
    "require_absolute_location": _absolute,
    "forbid_control_sensitivity_tags": _untagged,
}


def _registered(d: Dataset, p: Policy, today: date) -> ControlTable | None:
    at = normal_location(d.location)
    return next((t for t in p.control_tables if _active(t.review_by, today) and normal_location(t.location) == at), None)


def _control(d: Dataset, r: Rule, p: Policy, today: date) -> str | None:
    entry = _registered(d, p, today)
    if r.type == "require_registered_control_type":
        if entry and d.role != "CONTROL":
            return f"is registered as a control table of {entry.owner}, so it must be CONTROL; it is {d.role or 'of no type'}"
    elif d.role == "CONTROL" and entry is None:
        if _flag(r.properties.get("requireRegistration", True)):
            return f"is CONTROL but {d.location} is no registered control table"
    elif d.role == "CONTROL":
        have = {f.name for f in d.schema}
        if missing := [x for x in entry.required_fields if x not in have]:
            return f"is a registered control table but lacks {', '.join(missing)}"
    return None


def _on_contract(c: Contract, r: Rule) -> str | None:
    p = r.properties
    if r.type == "require_extension":
        key, value = str(p["key"]), p.get("value")
    else:
        if not _has(c.extensions, str(p["ifKey"]), p.get("ifValue")):
            return None
        key, value = str(p["thenKey"]), p.get("thenValue")
    return None if _has(c.extensions, key, value) else f"contract {c.id} must declare extension {key}" + (f" as {value}" if value is not None else "")


def in_scope(c: Contract, r: Rule) -> list[Dataset]:
    sets = {"inputs": c.inputs, "outputs": c.outputs}.get(r.scope, (*c.inputs, *c.outputs))
    return [d for d in sets if r.tag is None or r.tag in _tags(d)]


def evaluate(c: Contract, layers, today: date | None = None) -> list[Finding]:
    """Findings of one policy or a list of them (layers add up). An exempt rule, or one without the properties it needs, has none."""
    today, out = today or date.today(), []
    for p in [layers] if isinstance(layers, Policy) else layers:
        for r in p.rules:
            if any(e.contract == c.id and r.id in e.rules and _active(e.review_by, today) for e in p.exemptions):
                continue
            if r.type in TYPES and not sound(r):
                continue
            if r.type in CONTRACT_TYPES:
                found = [(None, _on_contract(c, r))]
            elif r.type in ON_DATASETS:
                found = [(d.name, ON_DATASETS[r.type](d, r.properties)) for d in in_scope(c, r)]
            elif r.type in TYPES:
                found = [(d.name, _control(d, r, p, today)) for d in in_scope(c, r)]
            elif r.type in p.custom:
                out += [f if isinstance(f, Finding) else Finding(r.id, r.type, r.mode, *f) for f in plugins.resolve(p.custom[r.type], "evaluate").evaluate(c, r)]
                continue
            else:
                continue
            out += [Finding(r.id, r.type, r.mode, name, f"{name} {what}" if name else what) for name, what in found if what]
    return out


def injected(c: Contract, layers) -> Contract:
    """The contract with the rules that the policies add to every one."""
    for p in [layers] if isinstance(layers, Policy) else layers:
        c = replace(c, rules=(*c.rules, *(r for r in p.injected if r not in c.rules)))
    return c


def least_options(layers) -> dict:
    """Options that the policies switch on whatever a job asks for."""
    return {k: True for p in ([layers] if isinstance(layers, Policy) else layers) for k, v in p.least_options.items() if v}


def expiring(p: Policy, days: int, today: date | None = None) -> list[Exemption]:
    """Exemptions that lapse within so many days, the next first."""
    today = today or date.today()
    near = [e for e in p.exemptions if e.review_by and today <= e.review_by <= today + timedelta(days=days)]
    return sorted(near, key=lambda e: e.review_by)


# --- guarantees across contracts


def _schema_consistency(contracts: list[Contract]) -> list[tuple[str, str, str]]:
    at: dict[str, dict[str, Dataset]] = {}
    for c in contracts:
        for d in (*c.inputs, *c.outputs):
            if d.role == "DATA_ASSET":
                at.setdefault(normal_location(d.location), {}).setdefault(c.id, d)
    out = []
    for where, by in sorted(at.items()):
        # each declaration against the first that has the field: any disagreement shows without comparing all with all
        types: dict[str, tuple[str, str]] = {}
        for name, d in sorted(by.items()):
            for f in d.schema:
                first, kind = types.setdefault(f.name, (name, f.type.lower()))
                if kind != f.type.lower():
                    out.append((where, "Contradicts", f"{first} and {name} differ in the type of {f.name}"))
        for name, d in sorted(by.items()):
            for f in d.schema:
                lacking = sorted(n for n, o in by.items() if f.name not in {x.name for x in o.schema}) if f.required else []
                out += [(where, "Contradicts", f"{name} requires {f.name}, which {x} does not declare") for x in lacking]
    return out


def _consumption(contracts: list[Contract]) -> list[tuple[str, str, str]]:
    readers: dict[str, set[str]] = {}
    for c in contracts:
        for d in c.inputs:
            readers.setdefault(normal_location(d.location), set()).add(c.id)
    out = []
    for c in contracts:
        for d in c.outputs:
            if d.role == "DATA_ASSET":
                used = readers.get(normal_location(d.location), set()) - {c.id}
                out.append((normal_location(d.location), "Conforms" if used else "CannotDetermine", f"{d.name} of {c.id} is read by {', '.join(sorted(used)) or 'no contract here'}"))
    return out


def guarantees(contracts: list[Contract], p: Policy) -> list[tuple[str, str, str, str]]:
    """(check, location, Conforms, Contradicts or CannotDetermine, what) of the checks that the policy enables."""
    built_in = {"data_asset_schema_consistency": _schema_consistency, "data_asset_downstream_consumption": _consumption}
    out = []
    for name in p.guarantees:
        if name in built_in:
            out += [(name, *x) for x in built_in[name](contracts)]
        elif name in p.custom_guarantees:
            out += [(name, *x) for x in plugins.resolve(p.custom_guarantees[name], "check").check(contracts)]
    return out
