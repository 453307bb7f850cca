"""Row mutations and table changes as the checks see them, from an analyzed or parsed command."""

from __future__ import annotations

import json

from .catalyst import Translator, _tree
from .model import Expr

def _condition(value) -> Expr | None:
    got = Translator([]).exprs(value)
    return got[0] if got else None


def classify(jplan) -> dict | None:
    """{kind, condition, updated, understood} of a MERGE, UPDATE or DELETE; None for other plans."""
    cls = jplan.getClass().getSimpleName()
    kind = {"MergeIntoTable": "merge", "UpdateTable": "update", "DeleteFromTable": "delete"}.get(cls)
    if kind is None:
        return None
    try:
        root = json.loads(jplan.toJSON())[0]
        if kind == "delete":
            return {"kind": kind, "condition": _condition(root.get("condition")), "updated": (), "understood": True}
        if kind == "merge":
            return {"kind": kind, "condition": _condition(root.get("mergeCondition")), "updated": tuple(_assigned(jplan.matchedActions())), "understood": True}
        return {"kind": kind, "condition": _condition(root.get("condition")), "updated": tuple(_targets(jplan.assignments())), "understood": True}
    except Exception:
        return {"kind": kind, "condition": None, "updated": (), "understood": False}


def _targets(assignments):
    for i in range(assignments.size()):
        a = assignments.apply(i)
        if a.key().toString() != a.value().toString():
            yield a.key().sql().replace("`", "").rpartition(".")[2]


def _assigned(actions):
    for i in range(actions.size()):
        a = actions.apply(i)
        if a.getClass().getSimpleName() == "UpdateAction":
            yield from _targets(a.assignments())


def parse(spark, sql: str):
    """The unresolved plan of a statement: enough to classify it when its table is not there."""
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def scope(mutation: dict) -> str:
    """NotApplicable, Unconditional or Conditional."""
    if mutation["kind"] != "delete":
        return "NotApplicable"
    c = mutation["condition"]
    return "Unconditional" if c is None or (c.kind == "literal" and str(c.value).lower() == "true") else "Conditional"


def destructive_verdict(command: str, target: str, declared: dict[str, str | None], rules) -> tuple[str, str] | None:
    """(finding, why) that a dropping or emptying command is refused, or None. declared: location of each output -> its save mode.

    rules: the contract's rule types, or whether a delete rule stands.
    """
    from ..contract import same_location

    if command in ("DropNamespace", "DropDatabaseCommand"):
        return "UNVERIFIABLE_WRITE", "dropping a whole namespace is refused"
    mode = next((m or "overwrite" for loc, m in declared.items() if same_location(loc, target)), None)
    if mode is None:
        return "UNVERIFIABLE_WRITE", f"{target} is not a declared output"
    if mode != "overwrite":
        return "OUTPUT_SAVE_MODE_MISMATCH", f"{target} may only be replaced under save mode overwrite, it is declared {mode}"
    if (rules is True or (rules and "forbid_unconditional_delete" in rules)) and "Partition" not in command:
        return "RULE_UNCONDITIONAL_DELETE", "a delete rule forbids emptying the whole table"
    return None
