"""Contracts: YAML in, dataclasses out; validation, locations, types, compatibility, draft merging."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field, replace
from functools import cached_property, lru_cache

#: The closed vocabularies of contracts.
FORMATS = "parquet orc avro csv json text excel feather table delta iceberg hudi hive jdbc bigquery kafka".split()
SAVE_MODES = "append overwrite ignore error".split()
TECHNOLOGIES = "hive delta iceberg hudi jdbc glue bigquery in-memory".split()
ROLES = "DATA_ASSET SOURCE CONTROL".split()
CSV_OPTIONS = "delimiter header encoding quote escape nullValue dateFormat timestampFormat".split()
DML_RULES = "merge_condition forbid_unconditional_delete allowed_update_columns".split()
PLAN_RULES = "required_group_by forbid_cross_join required_join_columns required_filter_columns".split()
CONSTRAINTS = "equals oneOf range length fieldRange".split()
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "wasb"}
#: The keys that each part of a document may have, and keys of the open data contract standard that mean nothing here.
KEYS = {
    "contract": "id version status inputs outputs rules extensions customRuleTypes".split(),
    "dataset": "name location format saveMode catalog description type derivedFrom schema partitionOverwriteMode csv".split(),
    "catalog": "required technology catalogName location namespace table".split(),
    "schema": ["fields"],
    "field": "name type required nullable sensitivityTags properties constraints partitioned partitionKeyPosition".split(),
}
STANDARD_KEYS = (
    "apiVersion kind tenant domain dataProduct servers team roles support price slaProperties slaDefaultElement tags customProperties "
    "contractCreatedTs authoritativeDefinitions quality physicalName physicalType logicalType logicalTypeOptions businessName title unique "
    "primaryKey primaryKeyPosition classification examples criticalDataElement encryptedName transformSourceObjects transformLogic "
    "transformDescription dataGranularityDescription"
).split()
RULES = [*DML_RULES, *PLAN_RULES]
BOUNDS = ("gte", "gt", "lte", "lt")


class ContractError(ValueError):
    """A document that is no contract; the message says where."""


@dataclass(frozen=True)
class Constraint:
    """kind: equals, oneOf, range, length or fieldRange, with its bounds."""

    kind: str
    spec: dict


@dataclass(frozen=True)
class Field:
    name: str
    type: str = ""
    required: bool = True
    nullable: bool = True
    properties: tuple = ()
    tags: tuple = ()
    constraints: tuple = ()
    partitioned: bool = False
    position: int | None = None


@dataclass(frozen=True)
class Dataset:
    """role: DATA_ASSET, SOURCE, CONTROL or None where none is declared. derived_from: None means from every input."""

    name: str
    location: str = ""
    format: str | None = None
    schema: tuple = ()
    save_mode: str | None = None
    role: str | None = None
    derived_from: tuple | None = None
    overwrite: str | None = None
    csv: dict = field(default_factory=dict)
    catalog: dict = field(default_factory=dict)
    description: str | None = None

    @property
    def partition_keys(self) -> list[str]:
        """Names of the partition keys: by their position, those without one last."""
        keys = sorted((f for f in self.schema if f.partitioned), key=lambda f: (f.position is None, f.position or 0))
        return [f.name for f in keys]


@dataclass(frozen=True)
class Contract:
    id: str
    version: str = "1.0.0"
    status: str = "active"
    inputs: tuple = ()
    outputs: tuple = ()
    rules: tuple = ()
    extensions: dict = field(default_factory=dict)
    custom_rules: dict = field(default_factory=dict)

    @cached_property
    def errors(self) -> list[str]:
        """What makes it no valid contract."""
        return [m for level, m in validate(self) if level == "ERROR"]

    @cached_property
    def input_index(self) -> Locations:
        return Locations(self.inputs, lambda d: d.location)

    @cached_property
    def output_index(self) -> Locations:
        return Locations(self.outputs, lambda d: d.location)

    def inputs_of(self, output: Dataset | None) -> list[Dataset]:
        """The inputs that an output is made of."""
        if output is None or output.derived_from is None:
            return list(self.inputs)
        return [d for d in self.inputs if d.name in output.derived_from]


# --- reading


class _Node:
    """A part of a document that knows where it is, for messages."""

    def __init__(self, value, at: str):
        if not isinstance(value, dict):
            said = "it is empty" if value is None else f"it is {value!r}"
            raise ContractError(f"{at}: a mapping is expected, {said}")
        self.value, self.at = {str(k): v for k, v in value.items()}, at

    def get(self, key: str, default=None):
        got = self.value.get(key)
        return default if got is None else got

    def text(self, key: str, needed: bool = False) -> str | None:
        got = self.get(key)
        if got is None and needed:
            raise ContractError(f"{self.at}: {key} is missing")
        return None if got is None else str(got).lower() if isinstance(got, bool) else str(got)

    def flag(self, key: str, default: bool | None = None) -> bool | None:
        got = self.get(key)
        if got is None or isinstance(got, bool):
            return default if got is None else got
        if str(got).strip().lower() in ("true", "false"):
            return str(got).strip().lower() == "true"
        raise ContractError(f"{self.at}.{key}: true or false is expected, it is {got!r}")

    def list(self, key: str) -> list:
        got = self.get(key, [])
        if not isinstance(got, list):
            raise ContractError(f"{self.at}.{key}: a list is expected, it is {got!r}")
        return got

    def texts(self, key: str) -> tuple:
        got = self.list(key)
        if bad := [x for x in got if not isinstance(x, str)]:
            raise ContractError(f"{self.at}.{key}: a list of strings is expected, it has {bad[0]!r}")
        return tuple(got)

    def nodes(self, key: str) -> list[_Node]:
        return [_Node(x, f"{self.at}.{key}[{i}]".lstrip(".")) for i, x in enumerate(self.list(key))]


def _constraint(n: _Node) -> Constraint:
    spec = {k: v for k, v in n.value.items() if k != "type"}
    if "values" in spec:
        spec["value"] = spec.pop("values")
    return Constraint(n.text("type", True), spec)


def _constraints(n: _Node) -> tuple:
    """A list of {type, ...}; or, for short, a mapping of kind to bounds."""
    got = n.get("constraints", [])
    if isinstance(got, dict):
        return tuple(Constraint(str(k), dict(v) if isinstance(v, dict) else {"value": v}) for k, v in got.items())
    return tuple(_constraint(x) for x in n.nodes("constraints"))


def _field(n: _Node, short: bool) -> Field:
    position = n.get("partitionKeyPosition")
    if position is not None and (not isinstance(position, int) or isinstance(position, bool)):
        raise ContractError(f"{n.at}.partitionKeyPosition: a whole number is expected, it is {position!r}")
    required = n.flag("required", short)
    return Field(
        n.text("name", True),
        n.text("type", not short) or "",
        required,
        n.flag("nullable", True if short else not required),
        tuple(_field(x, short) for x in n.nodes("properties")),
        n.texts("sensitivityTags"),
        _constraints(n),
        n.flag("partitioned", False),
        None if position == -1 else position,
    )


def _schema(n: _Node) -> tuple:
    """schema: {fields: [...]}, where fields are optional unless they say required; or, for short, a list of fields that are required."""
    got = n.get("schema", [])
    if isinstance(got, list):
        return tuple(_field(x, True) for x in n.nodes("schema"))
    node = _Node(got, f"{n.at}.schema")
    if "fields" not in node.value:
        raise ContractError(f"{node.at}: fields is missing")
    return tuple(_field(x, False) for x in node.nodes("fields"))


def _csv(n: _Node) -> dict:
    got = n.get("csv")
    if got is None:
        return {}
    node = _Node(got, f"{n.at}.csv")
    if unknown := sorted(node.value.keys() - {*CSV_OPTIONS, "sep"}):
        raise ContractError(f"{node.at}: unknown option {', '.join(unknown)}")
    out = {("delimiter" if k == "sep" else k): v for k, v in node.value.items() if v is not None}
    if {"sep", "delimiter"} <= node.value.keys() and node.value["sep"] != node.value["delimiter"]:
        raise ContractError(f"{node.at}: delimiter and sep differ")
    if "header" in out:
        out["header"] = node.flag("header")
    return out


def _catalog(n: _Node) -> dict:
    got = n.get("catalog")
    if got is None:
        return {}
    node = _Node(got, f"{n.at}.catalog")
    if node.flag("required") is None:
        raise ContractError(f"{node.at}: required is missing")
    out = {k: node.text(k) for k in ("technology", "catalogName", "location", "table") if node.text(k) is not None}
    if names := node.texts("namespace"):
        out["namespace"] = list(names)
    return {"required": node.flag("required")} | out


def _dataset(n: _Node) -> Dataset:
    role = n.text("type")
    if role is not None and role.strip().upper() not in ROLES:
        raise ContractError(f"{n.at}.type: {role!r} is none of {', '.join(ROLES)}")
    return Dataset(
        n.text("name", True),
        n.text("location", True),
        n.text("format"),
        _schema(n),
        n.text("saveMode"),
        role and role.strip().upper(),
        n.texts("derivedFrom") if n.get("derivedFrom") is not None else None,
        n.text("partitionOverwriteMode"),
        _csv(n),
        _catalog(n),
        n.text("description"),
    )


def _rule(n: _Node) -> dict:
    """Rule types in words joined by underscores; the camel-case spelling is read as well."""
    kind = n.text("type", True)
    snake = re.sub(r"(?<=[a-z])([A-Z])", r"_\1", kind).lower()
    return {k: v for k, v in n.value.items() if k != "type"} | {"type": snake if snake in RULES else kind}


def _load(text: str):
    import yaml

    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as x:
        raise ContractError(f"not valid YAML: {' '.join(str(x).split())}") from x


def parse(text: str) -> Contract:
    """A contract from YAML; raises ContractError, with the place, on what is none."""
    n = _Node(_load(text), "contract")
    ident, n.at = n.text("id", True), ""
    custom = n.get("customRuleTypes", {})
    return Contract(
        ident,
        n.text("version") or "1.0.0",
        n.text("status") or "active",
        tuple(_dataset(x) for x in n.nodes("inputs")),
        tuple(_dataset(x) for x in n.nodes("outputs")),
        tuple(_rule(x) for x in n.nodes("rules")),
        dict(_Node(n.get("extensions", {}), "extensions").value),
        {k: str(v) for k, v in _Node(custom, "customRuleTypes").value.items()},
    )


def to_yaml(c: Contract) -> str:
    """A document that parse() reads back to the same contract."""
    import yaml

    def constraint(k: Constraint):
        return {"type": k.kind} | {("values" if k.kind == "oneOf" and b == "value" else b): v for b, v in k.spec.items()}

    def fld(f: Field):
        out = {"name": f.name, "type": f.type, "required": f.required, "nullable": f.nullable}
        more = {
            "sensitivityTags": list(f.tags),
            "properties": [fld(p) for p in f.properties],
            "constraints": [constraint(k) for k in f.constraints],
            "partitioned": f.partitioned or None,
            "partitionKeyPosition": f.position,
        }
        return out | {k: v for k, v in more.items() if v not in ([], None)}

    def ds(x: Dataset):
        out = {"name": x.name, "location": x.location, "format": x.format, "description": x.description, "saveMode": x.save_mode, "type": x.role}
        out |= {"partitionOverwriteMode": x.overwrite, "csv": dict(x.csv), "catalog": dict(x.catalog)}
        out["schema"] = {"fields": [fld(f) for f in x.schema]} if x.schema else None
        out = {k: v for k, v in out.items() if v not in ({}, None)}
        return out if x.derived_from is None else out | {"derivedFrom": list(x.derived_from)}

    out = {"id": c.id, "version": c.version, "status": c.status, "inputs": [ds(x) for x in c.inputs], "outputs": [ds(x) for x in c.outputs]}
    out |= {"rules": [dict(r) for r in c.rules], "extensions": dict(c.extensions), "customRuleTypes": dict(c.custom_rules)}
    return yaml.safe_dump({k: v for k, v in out.items() if v not in ([], {})}, sort_keys=False)


# --- validation


def edits(a: str, b: str) -> int:
    """Single-character insertions, deletions and changes between two words."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest(word: str, known) -> str | None:
    """The known word that this one may be a slip of: one edit away, or two for words of five letters and more."""
    word = word.strip()
    most = 2 if len(word) > 4 else 1
    near = sorted((edits(word.lower(), k.lower()), k) for k in known if k != word)
    return near[0][1] if near and near[0][0] <= most else None


def _hint(word: str, known) -> str:
    near = nearest(word, known)
    return f"; did you mean {near}?" if near else ""


def unknown_keys(text: str) -> list[tuple[str, str]]:
    """(WARNING, message) for keys that nothing reads but that look like one that is read; none for text that does not parse."""
    out = []

    def look(at: str, value, kind: str):
        if isinstance(value, dict):
            for k in sorted(map(str, value)):
                near = None if k in KEYS[kind] or k in STANDARD_KEYS else nearest(k, KEYS[kind])
                if near:
                    out.append(("WARNING", f"{at}.{k}: unknown key is ignored; did you mean {near}?".lstrip(".")))

    def fields(at: str, value):
        for i, f in enumerate(value if isinstance(value, list) else ()):
            look(f"{at}[{i}]", f, "field")
            if isinstance(f, dict):
                fields(f"{at}[{i}].properties", f.get("properties"))

    try:
        doc = _load(text)
    except ContractError:
        return []
    look("", doc, "contract")
    for side in ("inputs", "outputs"):
        sets = doc.get(side) if isinstance(doc, dict) else None
        for i, d in enumerate(sets if isinstance(sets, list) else ()):
            at = f"{side}[{i}]"
            look(at, d, "dataset")
            if isinstance(d, dict):
                look(f"{at}.catalog", d.get("catalog"), "catalog")
                look(f"{at}.schema", d.get("schema"), "schema")
                schema = d.get("schema")
                fields(f"{at}.schema.fields" if isinstance(schema, dict) else f"{at}.schema", schema.get("fields") if isinstance(schema, dict) else schema)
    return out


def _repeated(names) -> list[str]:
    names = list(names)
    return [] if len(set(names)) == len(names) else sorted(n for n, k in Counter(names).items() if k > 1)


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def well_formed(c: Constraint) -> bool:
    """Whether a known constraint has what its kind needs, and no more."""
    s = c.spec
    if c.kind == "equals":
        return set(s) == {"value"} and s["value"] is not None
    if c.kind == "oneOf":
        return set(s) == {"value"} and isinstance(s["value"], list) and bool(s["value"]) and None not in s["value"]
    if c.kind == "length":
        whole = all(isinstance(v, int) and not isinstance(v, bool) and v >= 0 for v in s.values())
        ordered = s.get("min") is None or s.get("max") is None or not whole or s["min"] <= s["max"]
        return bool(s) and set(s) <= {"exact", "min", "max"} and whole and ordered and not ("exact" in s and len(s) > 1)
    sound = _number if c.kind == "range" else lambda v: isinstance(v, str) and bool(v.strip())
    return bool(s) and set(s) <= set(BOUNDS) and not {"gte", "gt"} <= set(s) and not {"lte", "lt"} <= set(s) and all(map(sound, s.values()))


NUMERIC_TYPES = "integer long short byte double float decimal int bigint smallint tinyint".split()


def _numeric_type(f: Field) -> bool:
    return re.match(r"\w*", f.type.strip().lower())[0] in NUMERIC_TYPES


def _validate_field(at: str, f: Field, siblings: dict[str, Field] | None) -> list[tuple[str, str]]:
    out = []
    if not f.name.strip():
        out.append(("ERROR", f"{at}: a field needs a name"))
    known = parse_type(f.type)[0] != "other" if f.type.strip() else True
    if not known and not f.properties and f.type.strip().lower() not in ("struct", "array", "map"):
        out.append(("WARNING", f"{at}: unknown type {f.type}{_hint(f.type, SCALARS)}"))
    out += [("ERROR", f"{at}: nested field {n} is declared twice") for n in _repeated(p.name for p in f.properties)]
    for p in f.properties:
        if p.partitioned:
            out.append(("ERROR", f"{at}.{p.name}: only a top-level field can be a partition key"))
        out += _validate_field(f"{at}.{p.name}", p, None)
    for c in f.constraints:
        if c.kind in CONSTRAINTS and not well_formed(c):
            out.append(("ERROR", f"{at}: constraint {c.kind} has missing or wrong bounds"))
        elif c.kind in ("equals", "oneOf"):
            first = c.spec["value"] if c.kind == "equals" else c.spec["value"][0]
            if f.type and _number(first) != _numeric_type(f):
                out.append(("WARNING", f"{at}: constraint {c.kind} has a {type(first).__name__} where the field is {f.type}"))
        elif c.kind == "length" and f.type and f.type.strip().lower() != "string":
            out.append(("WARNING", f"{at}: a length is declared where the field is {f.type}"))
        elif c.kind == "fieldRange" and siblings is None:
            out.append(("WARNING", f"{at}: a nested field cannot be compared with another statically"))
        elif c.kind == "fieldRange":
            out += [("WARNING", f"{at}: fieldRange names {n}, which is {'the field itself' if n == f.name else 'no field beside it'}") for n in c.spec.values() if n == f.name or n not in siblings]
    return out


def _validate_partitioning(at: str, d: Dataset) -> list[tuple[str, str]]:
    keys, out = [f for f in d.schema if f.partitioned], []
    for f in d.schema:
        nested = f.properties or parse_type(f.type)[0] in ("array", "map", "struct") or f.type.strip().lower() in ("array", "map", "struct")
        if f.partitioned and nested:
            out.append(("ERROR", f"{at}.{f.name}: a partition key must be a plain value, not {f.type}"))
        if f.partitioned and f.position is not None and f.position < 1:
            out.append(("ERROR", f"{at}.{f.name}: positions of partition keys count from 1, not {f.position}"))
        if not f.partitioned and f.position is not None:
            out.append(("WARNING", f"{at}.{f.name}: has a partition key's position but is no partition key"))
    out += [("ERROR", f"{at}: more than one partition key has position {p}") for p in _repeated(f.position for f in keys if f.position is not None)]
    if keys and len(keys) == len(d.schema):
        out.append(("ERROR", f"{at}: every field is a partition key, which leaves no data in the files"))
    if d.overwrite is not None and d.overwrite.strip().lower() not in ("static", "dynamic"):
        out.append(("ERROR", f"{at}: unknown partitionOverwriteMode {d.overwrite}"))
    elif d.overwrite is not None and d.schema and not keys:
        out.append(("WARNING", f"{at}: a partitionOverwriteMode without partition keys has no effect"))
    return out


def _one_character(v) -> bool:
    return len({"\\t": "\t"}.get(str(v), str(v))) == 1


def _validate_csv(at: str, d: Dataset) -> list[tuple[str, str]]:
    import codecs

    out = []
    if d.csv and d.format and d.format.strip().lower() != "csv":
        out.append(("WARNING", f"{at}: csv options have no effect on format {d.format}"))
    if "delimiter" in d.csv and not str(d.csv["delimiter"]):
        out.append(("ERROR", f"{at}: a delimiter cannot be empty"))
    out += [("ERROR", f"{at}: {k} is one character, not {d.csv[k]!r}") for k in ("quote", "escape") if k in d.csv and not _one_character(d.csv[k])]
    try:
        codecs.lookup(str(d.csv.get("encoding", "UTF-8")))
    except LookupError:
        out.append(("ERROR", f"{at}: unknown encoding {d.csv['encoding']}"))
    return out


def _validate_dataset(side: str, d: Dataset) -> list[tuple[str, str]]:
    at, out = f"{side} {d.name or '?'}", []
    if not d.name.strip() or not d.location.strip():
        out.append(("ERROR", f"{at} needs a name and a location"))
    for value, known, what in ((d.format, FORMATS, "format"), (d.save_mode, SAVE_MODES, "saveMode"), (d.catalog.get("technology"), TECHNOLOGIES, "catalog technology")):
        if value is not None and value not in known:
            out.append(("WARNING", f"{at}: {what} {value} is none of {', '.join(known)}, so it may not match on another engine{_hint(value, known)}"))
    if d.catalog and not d.catalog["required"] and len(d.catalog) > 1:
        out.append(("WARNING", f"{at}: its catalog entry is not checked unless required is true"))
    if not d.schema:
        out.append(("WARNING", f"{at} declares no fields, so its columns are not checked"))
    if side == "output" and d.role == "SOURCE":
        out.append(("WARNING", f"{at} is a SOURCE, which no contract produces"))
    out += [("ERROR", f"{at}: field {n} is declared twice") for n in _repeated(f.name for f in d.schema)]
    by_name = {f.name: f for f in d.schema}
    for f in d.schema:
        out += _validate_field(f"{at}: {f.name}", f, by_name)
    return out + _validate_partitioning(at, d) + _validate_csv(at, d)


def validate(c: Contract) -> list[tuple[str, str]]:
    """(ERROR or WARNING, message) findings."""
    out = []
    if not c.id.strip():
        out.append(("ERROR", "the id is empty"))
    elif not re.fullmatch(r"[A-Za-z][A-Za-z0-9_.-]*", c.id):
        out.append(("WARNING", f"id {c.id} should start with a letter and hold letters, digits, '.', '_' and '-' alone"))
    if not re.fullmatch(r"\d+\.\d+\.\d+", c.version):
        out.append(("ERROR", f"version {c.version} is not of the form 1.2.3"))
    if not c.outputs:
        out.append(("ERROR", "a contract needs an output"))
    for side, sets in (("input", c.inputs), ("output", c.outputs)):
        out += [("ERROR", f"{side} {n} is declared twice") for n in _repeated(d.name for d in sets)]
        for d in sets:
            out += _validate_dataset(side, d)
    out += [("WARNING", f"several outputs are at {x}; the first is the one that counts") for x in _repeated(d.location for d in c.outputs)]
    names = {d.name for d in c.inputs}
    out += [("ERROR", f"output {d.name}: derivedFrom {x} is no input") for d in c.outputs for x in dict.fromkeys(d.derived_from or ()) if x not in names]
    for r in c.rules:
        columns = r.get("columns")
        if not r["type"].strip():
            out.append(("ERROR", "a rule's type is empty"))
        elif r["type"] in RULES and not r["type"].startswith("forbid_") and not (isinstance(columns, list) and columns and all(isinstance(x, str) for x in columns)):
            out.append(("ERROR", f"rule {r['type']} needs a list of columns"))
        elif r["type"] not in RULES and r["type"] not in c.custom_rules and (near := nearest(r["type"], RULES)):
            out.append(("WARNING", f"rule {r['type']} is recorded, never checked; did you mean {near}?"))
    for kind, name in sorted(c.custom_rules.items()):
        if not kind.strip() or not name.strip():
            out.append(("ERROR", f"customRuleTypes: {kind or '?'} needs a type and a class"))
        elif kind in RULES:
            out.append(("WARNING", f"customRuleTypes: {kind} is built in, which comes first"))
    return out


# --- locations


@lru_cache(maxsize=1 << 16)
def normal_location(path: str) -> str:
    """Backslashes turned, file: dropped, schemes lower-cased and merged, empty and . segments dropped."""
    path = path.strip().replace("\\", "/")
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(?!$)", path)
    head, root = "", path.startswith("/")
    if m and m[1].lower() != "jdbc":
        scheme = m[1].lower()
        path = path[m.end() :]
        head = "" if scheme == "file" else SCHEMES.get(scheme, scheme) + "://"
        root = scheme == "file"
    body = "/".join(p for p in path.split("/") if p not in ("", "."))
    return head + ("/" if root and not head else "") + body


def absolute_location(path: str) -> bool:
    """Whether a location names one place by itself: a URL, or a path from the root."""
    at = normal_location(path)
    return at.startswith("/") or "://" in at or at.startswith("jdbc:")


def _suffix(a: str, b: str) -> bool:
    if a == b:
        return True
    if a.startswith("/") or "://" in a:
        return False
    return b.endswith("/" + a) or ("/" not in a and "/" not in b and b.endswith("." + a))


def same_location(declared: str, actual: str) -> bool:
    """Equal, or the declared one is a suffix of the actual one at a slash (or a table name's last parts)."""
    return _suffix(normal_location(declared), normal_location(actual))


def _last(normal: str) -> str:
    """The part that two equal locations share whatever stands before: behind the last slash, or the last dot of a table's name."""
    tail = normal.rpartition("/")[2]
    return tail if "/" in normal else tail.rpartition(".")[2]


class Locations:
    """Items by location: which of them does a declared one match, without comparing all with all."""

    def __init__(self, items, location):
        self.items: dict[str, list] = {}
        for x in items:
            at = normal_location(location(x))
            for key in {_last(at), at.rpartition("/")[2]}:
                self.items.setdefault(key, []).append((at, x))

    def declared(self, location: str) -> list:
        """Items whose actual location the declared one names."""
        a = normal_location(location)
        return list({id(x): x for key in {_last(a), a.rpartition("/")[2]} for b, x in self.items.get(key, ()) if _suffix(a, b)}.values())

    def attributed(self, location: str) -> str:
        """The longest leading part of an actual location that a declared one names (a file or partition folder belongs to its dataset)."""
        at = normal_location(location)
        while at:
            if self.actual(at):
                return at
            head = at.rpartition("/")[0]
            at = "" if head.endswith(":/") or head == at else head
        return location

    def actual(self, location: str) -> list:
        """Items whose declared location names the actual one."""
        b = normal_location(location)
        return list({id(x): x for key in {_last(b), b.rpartition("/")[2]} for a, x in self.items.get(key, ()) if _suffix(a, b)}.values())


# --- types


ALIASES = {"tinyint": "byte", "smallint": "short", "int": "integer", "bigint": "long", "real": "float", "timestamp_ltz": "timestamp", "dec": "decimal", "numeric": "decimal"}
SCALARS = "string boolean byte short integer long float double date timestamp timestamp_ntz binary time json geography interval".split()


def parse_type(text: str):
    """('scalar', name) | ('decimal', p, s) | ('array', e) | ('map', k, v) | ('struct', ((name, t), ...)) | ('other', text)."""
    text = text.strip()
    low = text.lower()
    m = re.fullmatch(r"(decimal|dec|numeric)(?:\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", low)
    if m:
        return ("decimal", int(m[2] or 10), int(m[3] or 0))
    m = re.fullmatch(r"(array|map|struct)\s*<(.*)>", text, re.I | re.S)
    if m:
        parts, depth, cur = [], 0, ""
        for ch in m[2]:
            depth += (ch in "<(") - (ch in ">)")
            if ch == "," and depth == 0:
                parts.append(cur)
                cur = ""
            else:
                cur += ch
        parts = [p for p in [*parts, cur] if p.strip()]
        kind = m[1].lower()
        if kind == "array":
            return ("array", parse_type(parts[0]))
        if kind == "map":
            return ("map", *(parse_type(p) for p in parts))
        fields = []
        for p in parts:
            f = re.match(r"\s*(?:`([^`]+)`|([^:\s]+))\s*:?\s*(.*)", p, re.S)
            kind_text = re.sub(r"\s+NOT\s+NULL|\s+COMMENT\s+'[^']*'", "", f[3], flags=re.I)
            fields.append((f[1] or f[2], parse_type(kind_text)))
        return ("struct", tuple(fields))
    name = ALIASES.get(low, low)
    return ("scalar", name) if name in SCALARS else ("other", text)


def type_matches(declared: str, actual: str) -> bool:
    """declared against a simpleString such as bigint, decimal(10,2) or array<int>."""
    d, keyword = declared.strip().lower(), re.match(r"\w*", actual.lower())[0]
    if not d:
        return True
    if d == ALIASES.get(keyword, keyword) and keyword not in ("decimal",):
        return True
    if "<" in d or "(" in d:
        return parse_type(declared) == parse_type(actual)
    if d in ("decimal", "dec", "numeric"):
        return False
    return parse_type(d) == parse_type(actual) and parse_type(d)[0] == "scalar"


# --- compatibility, drafts


def _tightened(at: str, what: str, before, after) -> list[tuple[str, str]]:
    """What is newly asked for, or asked for differently, breaks; what is asked for no more does not."""
    return [("BREAKING", f"{at}: {what} changed")] if after not in (None, [], {}) and before != after else []


def _schema_changes(at: str, old: tuple, new: tuple, prefix: str = "") -> list[tuple[str, str]]:
    a, b, out = {f.name: f for f in old}, {f.name: f for f in new}, []
    out += [("BREAKING", f"{at}: field {prefix}{n} removed") for n in sorted(a.keys() - b.keys())]
    out += [("BREAKING" if b[n].required else "MINOR", f"{at}: field {prefix}{n} added") for n in sorted(b.keys() - a.keys())]
    for n in sorted(a.keys() & b.keys()):
        x, y = a[n], b[n]
        if parse_type(x.type) != parse_type(y.type):
            out.append(("BREAKING", f"{at}: type of {prefix}{n} changed"))
        if y.required and not x.required:
            out.append(("BREAKING", f"{at}: {prefix}{n} is now required"))
        if x.nullable and not y.nullable:
            out.append(("BREAKING", f"{at}: {prefix}{n} is now not nullable"))
        out += _schema_changes(at, x.properties, y.properties, f"{prefix}{n}.")
    return out


def changes(old: Contract, new: Contract) -> list[tuple[str, str]]:
    """(BREAKING or MINOR, what) of every change between two versions that a producer or reader can notice; others need a PATCH at most."""
    out = [("BREAKING", f"id changed from {old.id} to {new.id}")] if old.id != new.id else []
    for side in ("outputs", "inputs"):
        a, b = ({d.name: d for d in getattr(c, side)} for c in (old, new))
        kind = side[:-1]
        out += [("BREAKING", f"{kind} {n} removed") for n in sorted(a.keys() - b.keys())]
        out += [("MINOR", f"{kind} {n} added") for n in sorted(b.keys() - a.keys())]
        for n in sorted(a.keys() & b.keys()):
            x, y, at = a[n], b[n], f"{kind} {n}"
            out += [("BREAKING", f"{at}: location changed")] if x.location != y.location else []
            for what in ("format", "save_mode", "overwrite"):
                out += _tightened(at, what, getattr(x, what), getattr(y, what))
            asked = lambda d: d.catalog if d.catalog.get("required") else None
            out += _tightened(at, "catalog", asked(x), asked(y)) + _tightened(at, "partition keys", x.partition_keys, y.partition_keys)
            for option in CSV_OPTIONS:
                out += _tightened(at, f"csv {option}", x.csv.get(option), y.csv.get(option))
            out += _schema_changes(at, x.schema, y.schema)
    after = {d.name: d for d in new.outputs}
    for x in sorted(old.outputs, key=lambda d: d.name):
        y = after.get(x.name)
        if y and (x.derived_from, y.derived_from) != (None, None) and {d.name for d in old.inputs_of(x)} != {d.name for d in new.inputs_of(y)}:
            out.append(("BREAKING", f"output {x.name}: derivedFrom changed"))
    return out


def bump_ok(old: Contract, new: Contract) -> bool:
    """Whether the new version number is high enough for the changes."""
    a, b = (tuple(map(int, c.version.split("."))) for c in (old, new))
    kinds = {k for k, _ in changes(old, new)}
    if "BREAKING" in kinds:
        return b[0] > a[0]
    if "MINOR" in kinds:
        return b[:2] > a[:2]
    return b > a if kinds else b >= a


def merge_drafts(drafts: list[Contract]) -> Contract:
    """One contract of several drafts, by location; conflicting schemas raise ValueError."""
    sides: dict[str, dict[str, Dataset]] = {"inputs": {}, "outputs": {}}
    for c in drafts:
        for side, known in sides.items():
            for d in getattr(c, side):
                key = normal_location(d.location)
                if key in known and known[key].schema and d.schema and known[key].schema != d.schema:
                    raise ValueError(f"{side[:-1]} {d.location}: drafts differ in its schema")
                known.setdefault(key, d)
    out = {}
    for side, known in sides.items():
        used: set[str] = set()
        named = []
        for d in known.values():
            name, k = d.name, 2
            while name in used:
                name, k = f"{d.name}_{k}", k + 1
            used.add(name)
            named.append(replace(d, name=name))
        out[side] = tuple(named)
    return Contract(drafts[0].id, drafts[0].version, "draft", out["inputs"], out["outputs"])


#: House rules: short checks by name, for a list of {id, type, ...}; policy documents are in policy.py.
POLICIES = {
    "requireDescriptionOfStatus": lambda c, p: [] if c.status in p.get("allowed", [c.status]) else [f"status {c.status}"],
    "allowedFormats": lambda c, p: [f"{d.name}: format {d.format}" for d in (*c.inputs, *c.outputs) if d.format and d.format not in p["formats"]],
    "forbiddenFormats": lambda c, p: [f"{d.name}: format {d.format}" for d in (*c.inputs, *c.outputs) if d.format in p["formats"]],
    "allowedLocations": lambda c, p: [f"{d.name}: {d.location}" for d in (*c.inputs, *c.outputs) if not any(normal_location(d.location).startswith(x) for x in p["prefixes"])],
    "requiredFields": lambda c, p: [f"{d.name}: no field {f}" for d in c.outputs for f in p["fields"] if f not in {x.name for x in d.schema}],
    "requireNonNullable": lambda c, p: [f"{d.name}.{f.name} is nullable" for d in c.outputs for f in d.schema if f.name in p["fields"] and f.nullable],
    "requiredTags": lambda c, p: [f"{d.name}.{f.name} lacks a tag" for d in c.outputs for f in d.schema if re.search(p["pattern"], f.name) and not set(f.tags) & set(p["tags"])],
    "forbiddenTags": lambda c, p: [f"{d.name}.{f.name}: tag {t}" for d in c.outputs for f in d.schema for t in f.tags if t in p["tags"]],
    "requiredRules": lambda c, p: [f"no rule {r}" for r in p["rules"] if r not in {x.get("type") for x in c.rules}],
    "requireSaveMode": lambda c, p: [f"{d.name}: save mode {d.save_mode}" for d in c.outputs if d.save_mode not in p["modes"]],
    "requireCatalog": lambda c, p: [f"{d.name}: no catalog" for d in c.outputs if not d.catalog],
    "namePattern": lambda c, p: [] if re.fullmatch(p["pattern"], c.id) else [f"id {c.id}"],
}


def policy_findings(c: Contract, rules: list[dict], today: str = "9999-12-31") -> list[tuple[str, str, str]]:
    """(rule id, severity, what). A rule applies in its scope (contract id pattern) and unless exempt until a review date."""
    out = []
    for r in rules:
        if not re.fullmatch(r.get("scope", ".*"), c.id):
            continue
        if any(re.fullmatch(x["contract"], c.id) and x.get("reviewBy", "9999-12-31") >= today for x in r.get("exemptions", ())):
            continue
        out += [(r["id"], r.get("severity", "ERROR"), what) for what in POLICIES[r["type"]](c, r)]
    return out
