"""What the engine can check, and which of it a contract relies on: a contract is never passed on a check that was not made."""

from __future__ import annotations

from .contract import DML_RULES, PLAN_RULES, Contract

#: The capability ids. What a contract relies on must be checked for those in ENFORCED.
IDS = (
    "read.batch read.streaming write.batch write.streaming write.rowLevelDml write.stateChange "
    "check.inputExistence check.location check.outputsWritten check.schema check.nestedTypes check.format check.inputFormat "
    "check.saveMode check.partitioning check.csvOptions check.catalogRegistration check.runtimeDataQuality "
    "rules.dml rules.planShape rules.custom "
    "analysis.staticDataQuality analysis.roleConsistency analysis.fingerprint analysis.functionCatalog analysis.sensitivityPropagation "
    "lineage.columnLevel lineage.boundaryResolution "
    "policy.organizational config.zeroCodeInstall config.locationRefs config.contractRegistry "
    "reporting.notifications reporting.dryRunInference failClosed.unverifiableWrites"
).split()
LEVELS = "supported partial unsupported not-applicable".split()
ENFORCED = {
    *"check.inputExistence check.location check.schema check.nestedTypes check.format check.inputFormat check.saveMode".split(),
    *"check.partitioning check.csvOptions check.catalogRegistration check.runtimeDataQuality".split(),
    *"rules.dml rules.planShape rules.custom analysis.staticDataQuality analysis.roleConsistency".split(),
}
#: Where this engine falls short of full support, and how.
NOTES = {
    "write.streaming": ("partial", "file sinks and foreachBatch; a console or memory sink is not a write"),
    "write.rowLevelDml": ("partial", "analyzed or parsed commands; no table-format connector is installed to run them"),
    "write.stateChange": ("partial", "table and partition statements; not the stored procedures of table formats"),
    "check.outputsWritten": ("partial", "when a run ends; a guarded session reports it on request"),
    "check.csvOptions": ("partial", "a streaming sink keeps its options to itself"),
    "check.catalogRegistration": ("partial", "session catalog tables; a metastore's address only where its setting is visible"),
    "lineage.boundaryResolution": ("partial", "cached frames always; checkpointed ones when made through boundaries.checkpoint"),
    "rules.dml": ("partial", "a mutation that the engine has rewritten for another catalog's table is refused, not judged"),
    "config.zeroCodeInstall": ("unsupported", "an analyzer rule written in Python cannot be named in the engine's configuration"),
}


def matrix(own: dict | None = None) -> dict[str, tuple[str, str]]:
    """Every capability's level and note. own: levels (or (level, note)) that differ, of another adapter."""
    out = {i: NOTES.get(i, ("supported", "")) for i in IDS}
    for k, v in (own or {}).items():
        level, note = v if isinstance(v, tuple) else (v, "")
        if k not in out or level not in LEVELS:
            raise ValueError(f"unknown capability or level: {k}={level}")
        out[k] = (level, note)
    return out


def _fields(schema):
    return [x for f in schema for x in (f, *_fields(f.properties))]


def required(c: Contract, options: dict | None = None) -> dict[str, str]:
    """Capability -> why a contract, run with these options, relies on it."""
    options, sets = options or {}, (*c.inputs, *c.outputs)
    fields, kinds = [f for d in sets for f in _fields(d.schema)], {r["type"] for r in c.rules}
    first = lambda items, ok: next((x.name for x in items if ok(x)), None)
    nested = first(fields, lambda f: f.properties or "<" in f.type)
    tagged = first(fields, lambda f: f.tags)
    keyed = first(c.outputs, lambda d: d.partition_keys)
    found = [
        ("check.inputExistence", c.inputs, f"it declares {len(c.inputs)} inputs"),
        ("check.location", sets, "it declares locations"),
        ("check.schema", fields, "it declares fields"),
        ("check.nestedTypes", nested, f"field {nested} is nested"),
        ("check.format", first(c.outputs, lambda d: d.format), "an output declares a format"),
        ("check.inputFormat", first(c.inputs, lambda d: d.format), "an input declares a format"),
        ("check.saveMode", first(c.outputs, lambda d: d.save_mode), "an output declares a save mode"),
        ("check.partitioning", keyed, f"output {keyed} declares partition keys"),
        ("check.csvOptions", first(sets, lambda d: d.csv), "a dataset declares csv options"),
        ("check.catalogRegistration", first(sets, lambda d: d.catalog), "a dataset declares a catalog entry"),
        ("check.runtimeDataQuality", options.get("runtimeDataQuality") and any(f.constraints for d in c.outputs for f in d.schema), "runtimeDataQuality is on and fields have constraints"),
        ("rules.dml", kinds & set(DML_RULES), f"it has the rules {', '.join(sorted(kinds & set(DML_RULES)))}"),
        ("rules.planShape", kinds & set(PLAN_RULES), f"it has the rules {', '.join(sorted(kinds & set(PLAN_RULES)))}"),
        ("rules.custom", c.custom_rules, f"it has the rules {', '.join(sorted(c.custom_rules))}"),
        ("analysis.staticDataQuality", options.get("staticDataQuality"), "staticDataQuality is on"),
        ("analysis.roleConsistency", options.get("roleConsistency"), "roleConsistency is on"),
        ("analysis.fingerprint", options.get("computeFingerprint"), "computeFingerprint is on"),
        ("analysis.sensitivityPropagation", tagged, f"field {tagged} has sensitivity tags"),
    ]
    return {k: why for k, needed, why in found if needed}


def shortfalls(c: Contract, options: dict | None = None, own: dict | None = None, least: str = "unsupported") -> list[tuple[str, str]]:
    """(capability, why and what is missing) of what a contract relies on and the engine does not check (or, for partial, only in part)."""
    have = matrix(own)
    bad = {"unsupported"} if least == "unsupported" else {"unsupported", "partial"}
    return [(k, f"{why}, but {k} is {have[k][0]}" + (f": {have[k][1]}" if have[k][1] else "")) for k, why in required(c, options).items() if have[k][0] in bad and (k in ENFORCED or least == "partial")]
