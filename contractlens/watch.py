"""Strict mode: while it lasts, data access by the job's own code that goes round its run is seen, as a finding or as a refusal.

The interpreter's audit events say what is opened, connected or started. What counts is who asked: the nearest caller outside the
standard library and installed packages, and outside this package.
"""

from __future__ import annotations

import os
import sys
import sysconfig

from .checks import Violation

#: Audit event -> what it is.
EVENTS = {
    "open": "file",
    "sqlite3.connect": "database",
    "subprocess.Popen": "process",
    "os.system": "process",
    "os.exec": "process",
    "os.posix_spawn": "process",
    "socket.connect": "network",
    "os.remove": "removal",
    "os.rename": "move",
    "shutil.rmtree": "removal",
}
_HERE = os.path.dirname(os.path.abspath(__file__))
_LIBRARIES = tuple({os.path.realpath(sysconfig.get_paths()[k]) for k in ("stdlib", "platstdlib", "purelib", "platlib")})
_active: list[Watch] = []
_installed = False


def _asker() -> tuple[str, int] | None:
    """File and line of the job's own code that led here; None where this package or nobody did."""
    f = sys._getframe(3)
    while f is not None:
        name = f.f_code.co_filename
        if name.startswith(_HERE):
            return None
        if not name.startswith("<") and not os.path.realpath(name).startswith(_LIBRARIES):
            return name, f.f_lineno
        f = f.f_back
    return None


def _hook(event: str, args) -> None:
    if _active and event in EVENTS:
        watch = _active[-1]
        if watch.busy:
            return
        watch.busy = True
        try:
            watch.saw(event, args)
        finally:
            watch.busy = False


class Refused(RuntimeError):
    """Data access that strict mode does not let through."""


class Watch:
    """with Watch() as w: ...; w.findings has what went round the run. refuse: raise at once. allow: beginnings of paths that are let be."""

    def __init__(self, refuse: bool = False, allow=()):
        self.refuse, self.allow, self.busy = refuse, tuple(map(str, allow)), False
        self.findings: list[Violation] = []

    def __enter__(self) -> Watch:
        global _installed
        if not _installed:
            sys.addaudithook(_hook)
            _installed = True
        _active.append(self)
        return self

    def __exit__(self, *_):
        _active.remove(self)

    def saw(self, event: str, args) -> None:
        what = args[0] if args else ""
        what = os.fsdecode(what) if isinstance(what, (bytes, os.PathLike)) else str(what)
        if event == "open" and (isinstance(args[0], int) or what.endswith((".py", ".pyc", ".so")) or what.startswith("/proc/")):
            return
        if self.allow and what.startswith(self.allow):
            return
        if (who := _asker()) is None:
            return
        kind = EVENTS[event]
        if kind == "file":
            kind = "write" if args[1] and set(str(args[1])) & set("wax+") else "read"
        finding = Violation("UNGOVERNED_DATA_ACCESS", f"{who[0]}:{who[1]}: {kind} of {what[:200]} goes round the contract", None, what[:200])
        self.findings.append(finding)
        if self.refuse:
            raise Refused(finding.message)
