"""A check by messages, for jobs that are not Spark's: a JSON request says what a job reads and would write, a JSON reply what is found.

Request: contract (YAML text or a path), write {output, location, format, saveMode, partitionBy, partitionOverwriteMode, csv, catalog,
fields: [{name, type, nullable}], nulls: {column: count}}, reads: [{location, format, fields}], options {name: value}.
Reply: status (PASSED, FAILED or ERROR), findings [{type, message, column, location, expected, actual}].
"""

from __future__ import annotations

import json
from dataclasses import asdict

from .checks import OPTIONS, Violation, Write, verify
from .contract import ContractError, parse_type
from .plans.model import Plan
from .services import load

#: Logical types as the engine spells them.
SPELLED = {"integer": "int", "long": "bigint", "short": "smallint", "byte": "tinyint"}


def _spelled(kind) -> str:
    """A parsed type in the engine's spelling."""
    if kind[0] == "scalar":
        return SPELLED.get(kind[1], kind[1])
    if kind[0] == "decimal":
        return f"decimal({kind[1]},{kind[2]})"
    if kind[0] == "struct":
        return "struct<" + ",".join(f"{n}:{_spelled(t)}" for n, t in kind[1]) + ">"
    return f"{kind[0]}<{','.join(_spelled(t) for t in kind[1:])}>" if kind[0] in ("array", "map") else kind[1]


def _read(given: dict, at: int) -> Plan:
    fields = given.get("fields") or []
    schema = {"type": "struct", "fields": [{"name": f["name"], "type": _json_type(parse_type(f["type"])), "nullable": f.get("nullable", True), "metadata": {}} for f in fields]}
    output = tuple((f["name"], 1000 * at + i) for i, f in enumerate(fields))
    return Plan("read", output=output, info={"location": given["location"], "format": given.get("format"), "schema": json.dumps(schema) if fields else None, "options": given.get("csv", {})})


def _json_type(kind):
    if kind[0] == "scalar":
        return kind[1]
    if kind[0] == "array":
        return {"type": "array", "elementType": _json_type(kind[1]), "containsNull": True}
    if kind[0] == "map":
        return {"type": "map", "keyType": _json_type(kind[1]), "valueType": _json_type(kind[2]), "valueContainsNull": True}
    if kind[0] == "struct":
        return {"type": "struct", "fields": [{"name": n, "type": _json_type(t), "nullable": True, "metadata": {}} for n, t in kind[1]]}
    return f"decimal({kind[1]},{kind[2]})" if kind[0] == "decimal" else "string"


def answer(request: dict) -> dict:
    """The reply to a request; a request that cannot be read is an ERROR, never a pass."""
    try:
        contract = load(request["contract"])
        w = request["write"]
        nulls = w.get("nulls", {})
        schema = [(f["name"], _spelled(parse_type(f["type"])), bool(f.get("nullable", True)) if f["name"] not in nulls else nulls[f["name"]] > 0) for f in w["fields"]]
        target = next((d for d in contract.outputs if d.name == w.get("output")), None)
        where = w.get("location") or (target.location if target else "")
        reads = tuple(_read(r, i) for i, r in enumerate(request.get("reads", [])))
        plan = Plan("union", reads)
        keys = tuple(w.get("partitionBy", ()))
        write = Write(plan, schema, where, w.get("format"), w.get("saveMode"), keys, w.get("partitionOverwriteMode"), w.get("csv", {}), w.get("catalog", {}))
        options = {k: v for k, v in request.get("options", {}).items() if k in OPTIONS}
        found = verify(write, contract, **options)
    except ContractError as x:
        found = [Violation("INVALID_CONTRACT", str(x))]
    except (KeyError, TypeError, AttributeError, OSError, ValueError) as x:
        return {"status": "ERROR", "findings": [], "error": f"{type(x).__name__}: {x}"}
    return {"status": "FAILED" if found else "PASSED", "findings": [asdict(v) for v in found]}


def serve(lines, out) -> None:
    """One reply line for each request line."""
    for line in lines:
        if line.strip():
            try:
                reply = answer(json.loads(line))
            except json.JSONDecodeError as x:
                reply = {"status": "ERROR", "findings": [], "error": f"no JSON: {x}"}
            out.write(json.dumps(reply) + "\n")
            out.flush()
