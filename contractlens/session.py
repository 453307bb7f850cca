"""A session that refuses violating writes by itself: a check rule in Spark's analyzer, called before any command runs.

Every command is judged: writes against the contract, statements that drop data or change a declared table too, and a command that is
neither known to be harmless nor understood is refused (fail closed). Streams are checked when they start. With dryRun nothing is
refused; each write is reported with the draft of a contract that it would meet.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .checks import OPTIONS, Violation, preflight
from .contract import Contract, ContractError, merge_drafts
from .enforce import ContractViolation, _contract, draft_of
from .plans import boundaries
from .plans.commands import is_command, judge_command, write_of
from .services import options_of, resolved_contract

KEEP: list = []  # objects that the JVM calls must not be collected


class Guard:
    """What the analyzer asks about every plan. written: places of the writes that passed; drafts: contracts inferred in a dry run."""

    def __init__(self, contract: Contract | None, options: dict, sinks=()):
        self.contract, self.sinks = contract, sinks
        self.options = {k: v for k, v in options.items() if k in OPTIONS}
        self.dry = bool(options.get("dryRun"))
        self.written: list[str] = []
        self.drafts: list[Contract] = []

    def _tell(self, kind: str, name: str, bad: list[Violation], **more):
        event = {"type": kind, "contract": self.contract.id if self.contract else None, "output": name, "status": "FAILED" if bad else "PASSED"}
        for s in self.sinks:
            s(event | {"violations": [vars(v) for v in bad]} | more)

    def see(self, plan) -> None:
        if not is_command(plan):
            boundaries.remember(plan)
            return
        w = None
        try:
            w = write_of(plan, self.contract)
        except Exception:
            if self.dry:
                return
        if self.dry:
            if w is not None and w.location:
                self.drafts.append(draft_of(w))
                bad = judge_command(plan, self.contract, self.options, w) if self.contract else []
                self._tell("DRY_RUN", w.location, bad)
            return
        bad = judge_command(plan, self.contract, self.options, w)
        if bad or w is not None:
            self._tell("CONTRACT_VALIDATION", w.location if w is not None else plan.getClass().getSimpleName(), bad)
        if bad:
            raise ContractViolation(bad)
        if w is not None and w.location:
            self.written.append(w.location)

    def draft(self) -> Contract:
        """One contract for all writes that a dry run saw."""
        return merge_drafts(self.drafts)

    def missing(self) -> list[Violation]:
        return missing_outputs(self.contract, self.written)


def guarded_session(contract=None, conf: dict | None = None, sinks=(), **options) -> SparkSession:
    """A new session (none may be active) whose analyzer runs the checks; its guard is at .guard.

    Without a contract, the session's settings name it (services.SETTINGS). What is wrong with the contract itself is raised here.
    """
    from pyspark import SparkConf, SparkContext
    from pyspark.java_gateway import ensure_callback_server_started

    sc = SparkContext.getOrCreate(SparkConf().setAll((conf or {}).items()))
    ensure_callback_server_started(sc._gateway)
    options = options_of(sc.getConf(), options)
    contract = _contract(contract) if contract is not None else resolved_contract(sc.getConf(), options)
    guard = Guard(contract, options, sinks)
    if contract is None and not guard.dry:
        raise ContractError("no contract is given, and no setting names one")
    if contract is not None and not guard.dry and (bad := preflight(contract, options)):
        raise ContractViolation(bad)

    class Rule:
        def apply(self, plan):
            guard.see(plan)

        class Java:
            implements = ["scala.Function1"]

    class Builder:
        def apply(self, session):
            KEEP.append(rule := Rule())
            return rule

        class Java:
            implements = ["scala.Function1"]

    class Extension:
        def apply(self, extensions):
            KEEP.append(builder := Builder())
            extensions.injectCheckRule(builder)

        class Java:
            implements = ["scala.Function1"]

    KEEP.append(ext := Extension())
    spark = SparkSession(sc, sc._jvm.org.apache.spark.sql.classic.SparkSession.builder().withExtensions(ext).getOrCreate())
    spark.guard = guard
    return spark


def missing_outputs(contract: Contract, written: list[str]) -> list[Violation]:
    """Declared outputs that none of the written locations matches."""
    hit = {id(d) for w in written for d in contract.output_index.actual(w)}
    return [Violation("MISSING_OUTPUT", f"{d.name} was never written", None, d.location) for d in contract.outputs if id(d) not in hit]


__all__ = ["Guard", "guarded_session", "judge_command", "missing_outputs", "write_of"]
