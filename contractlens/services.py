"""Location references, contract registry, settings, cross-contract checks, code scan, command line."""

from __future__ import annotations

import argparse
import ast
import json
import os
import sys
import urllib.request
from dataclasses import replace

from .capabilities import shortfalls
from .checks import Violation
from .contract import Contract, merge_drafts, parse, parse_type, policy_findings, same_location, to_yaml, unknown_keys, validate
from .policy import evaluate, expiring, guarantees, parse_policy, validate_policy


class NotResolved(Exception):
    """A reference that no map or service knows; the run stops."""


def resolve_locations(c: Contract, known: dict[str, str] | str, token: str | None = None) -> Contract:
    """Replace ref://id locations from a map, or from a service that answers GET url/id with {"location": ...}."""

    def one(where: str) -> str:
        if not where.startswith("ref://"):
            return where
        key = where[6:]
        if isinstance(known, dict):
            if key not in known:
                raise NotResolved(where)
            return known[key]
        try:
            return json.loads(_get(f"{known.rstrip('/')}/{key}", token))["location"]
        except Exception as x:
            raise NotResolved(f"{where}: {x}") from x

    swap = lambda sets: tuple(replace(d, location=one(d.location)) for d in sets)
    return replace(c, inputs=swap(c.inputs), outputs=swap(c.outputs))


def _get(url: str, token: str | None = None) -> str:
    head = {"Authorization": f"Bearer {token}"} if token else {}
    with urllib.request.urlopen(urllib.request.Request(url, headers=head), timeout=10) as r:
        return r.read().decode()


def load(reference: str, registry: dict[str, str] | str | None = None) -> Contract:
    """A contract from YAML text, a file, or registry://id@version (a map id@version -> YAML, or a service's URL)."""
    if reference.startswith("registry://"):
        key = reference[11:]
        if isinstance(registry, dict) and key in registry:
            return parse(registry[key])
        if isinstance(registry, str):
            name, _, version = key.partition("@")
            try:
                return parse(_get(f"{registry.rstrip('/')}/contracts/{name}/versions/{version or 'latest'}"))
            except OSError as x:
                raise NotResolved(f"{reference}: {x}") from x
        raise NotResolved(reference)
    if "\n" in reference:
        return parse(reference)
    with open(reference) as f:
        return parse(f.read())


#: Settings of a run: name -> (Spark conf key, environment variable, default).
SETTINGS = {n: (f"spark.contractlens.{n}", "CONTRACTLENS_" + "".join("_" + ch if ch.isupper() else ch.upper() for ch in n), None) for n in "contract dryRun locationMap locationUrl locationTokenEnv orgPolicy failOnMissingOutput registryUrl rejectUndeclaredInputs rejectUndeclaredFields computeFingerprint staticDataQuality roleConsistency runtimeDataQuality".split()}


def setting(spark, name: str, env: dict[str, str]):
    """The session's value, else the environment's, else the default."""
    key, var, default = SETTINGS[name]
    return spark.conf.get(key, None) or env.get(var, default)


def options_of(conf, given: dict) -> dict:
    """Options of a run: what is given, then what the settings switch on. conf: anything with get(key, default)."""
    out = dict(given)
    for name, (key, var, default) in SETTINGS.items():
        value = conf.get(key, None) or os.environ.get(var, default)
        if value is None or name in out:
            continue
        out[name] = value.strip().lower() == "true" if value.strip().lower() in ("true", "false") else value
    if isinstance(out.get("orgPolicy"), str):
        out["policies"] = [parse_policy(open(p.strip()).read()) for p in out["orgPolicy"].split(",")]
    return out


def properties(path: str) -> dict[str, str]:
    """key=value lines; # and ! begin comments."""
    lines = [x.strip() for x in open(path) if x.strip() and x.strip()[0] not in "#!"]
    return {k.strip(): v.strip() for k, _, v in (x.partition("=") for x in lines)}


def resolved_contract(conf, options: dict) -> Contract | None:
    """The contract that the settings name, from a file or a registry, its locations resolved; None where they name none."""
    if not options.get("contract"):
        return None
    c = load(options["contract"], options.get("registryUrl"))
    known = properties(options["locationMap"]) if options.get("locationMap") else options.get("locationUrl")
    refers = any(d.location.startswith("ref://") for d in (*c.inputs, *c.outputs))
    if refers and not known:
        raise NotResolved("the contract has ref:// locations, but neither locationMap nor locationUrl is set")
    token = os.environ.get(options["locationTokenEnv"]) if options.get("locationTokenEnv") else None
    return resolve_locations(c, known, token) if refers else c


def cross_contract(contracts: list[Contract]) -> list[tuple[str, str, str]]:
    """(contract, dataset, finding): outputs that others read must not be declared as raw sources there, and must keep their types."""
    out = []
    made = [(c, d) for c in contracts for d in c.outputs]
    for c in contracts:
        for d in c.inputs:
            for maker, o in made:
                if maker.id == c.id or not same_location(o.location, d.location):
                    continue
                if o.role in (None, "DATA_ASSET") and d.role == "SOURCE":
                    out.append((c.id, d.name, f"is an output of {maker.id} but declared as a source"))
                have = {f.name: f for f in o.schema}
                for f in d.schema:
                    if o.schema and f.name not in have:
                        out.append((c.id, d.name, f"{maker.id} does not provide {f.name}"))
                    elif f.name in have and parse_type(f.type) != parse_type(have[f.name].type):
                        out.append((c.id, d.name, f"type of {f.name} differs from {maker.id}"))
                    elif f.name in have and not f.nullable and have[f.name].nullable:
                        out.append((c.id, d.name, f"{f.name} may be null in {maker.id}"))
    return out


#: Calls that reach data past the contract: code -> functions by their full names (a star ends a beginning), and methods of frames.
REACHES = {
    "CL001 read": "pandas.read_* polars.read_* polars.scan_* pyarrow.parquet.read_* pyarrow.csv.read_* pyarrow.feather.read_* pyarrow.dataset.dataset duckdb.read_* numpy.load* io.open codecs.open gzip.open bz2.open lzma.open fileinput.input urllib.request.urlopen requests.get httpx.get".split(),
    "CL002 write": "pyarrow.parquet.write_* pyarrow.csv.write_* pyarrow.feather.write_* pyarrow.dataset.write_* numpy.save* shutil.copy* shutil.move os.rename os.replace os.remove os.unlink shutil.rmtree requests.post requests.put httpx.post".split(),
    "CL003 connect": "sqlite3.connect psycopg2.connect psycopg.connect pymysql.connect duckdb.connect sqlalchemy.create_engine pyodbc.connect snowflake.connector.connect boto3.client boto3.resource".split(),
    "CL005 process": "os.system os.popen os.exec* os.spawn* subprocess.* multiprocessing.Process".split(),
    "CL006 dynamic": "eval exec __import__ importlib.import_module runpy.*".split(),
}
METHODS = {
    "CL001 read": "read_text read_bytes read_csv read_parquet read_json read_excel read_sql read_table read_feather read_orc scan_parquet scan_csv".split(),
    "CL002 write": "to_csv to_parquet to_json to_excel to_sql to_feather to_pickle write_parquet write_csv write_table write_text write_bytes saveAsTable insertInto".split(),
    "CL004 sql": "execute executemany executescript".split(),
}


class _Names(ast.NodeVisitor):
    """What names stand for: imports with their aliases, and plain assignments of what they name."""

    def __init__(self):
        self.known: dict[str, str] = {}

    def visit_Import(self, node):  # noqa: N802
        for a in node.names:
            self.known[a.asname or a.name.partition(".")[0]] = a.name if a.asname else a.name.partition(".")[0]

    def visit_ImportFrom(self, node):  # noqa: N802
        for a in node.names:
            self.known[a.asname or a.name] = f"{node.module or ''}.{a.name}".lstrip(".")

    def visit_Assign(self, node):  # noqa: N802
        if (full := self.full(node.value)) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            self.known[node.targets[0].id] = full
        self.generic_visit(node)

    def full(self, node) -> str | None:
        """The full dotted name of an expression, or None where it is none."""
        if isinstance(node, ast.Name):
            return self.known.get(node.id, node.id)
        if isinstance(node, ast.Attribute):
            head = self.full(node.value)
            return f"{head}.{node.attr}" if head else None
        return None


def _opened(node: ast.Call, at: int) -> str:
    given = [a for a in [*node.args[at : at + 1], *(k.value for k in node.keywords if k.arg == "mode")] if isinstance(a, ast.Constant)]
    return "CL002 write" if given and set(str(given[0].value)) & set("wax+") else "CL001 read"


def _matches(name: str, pattern: str) -> bool:
    return name.startswith(pattern[:-1]) if pattern.endswith("*") else name == pattern


def scan_code(source: str) -> list[tuple[int, str, str]]:
    """(line, code, call) of data access that goes round the contract; names are followed through imports and assignments."""
    tree, names, out = ast.parse(source), _Names(), []
    names.visit(tree)
    for node in ast.walk(tree):
        if not isinstance(node, ast.Call):
            continue
        f, full = node.func, names.full(node.func) or ""
        last = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else ""
        root = full.partition(".")[0]
        if full == "open" or full.removeprefix("builtins.") == "open":
            out.append((node.lineno, _opened(node, 1), last))
        elif codes := [c for c, patterns in REACHES.items() if any(_matches(full, p) for p in patterns)]:
            out.append((node.lineno, codes[0], last))
        elif isinstance(f, ast.Attribute) and f.attr == "open" and root == "pathlib":
            out.append((node.lineno, _opened(node, 0), last))
        elif isinstance(f, ast.Attribute) and root not in ("self", "run") and (codes := [c for c, methods in METHODS.items() if last in methods]):
            out.append((node.lineno, codes[0], last))
    return sorted(out)


def ungoverned(source: str, name: str = "") -> list[Violation]:
    """What a code scan finds, as findings; a line that says `contractlens: allow` is let be."""
    lines = source.splitlines()
    return [Violation("UNGOVERNED_DATA_ACCESS", f"{name}:{line}: {call} goes round the contract", None, name, None, code) for line, code, call in scan_code(source) if "contractlens: allow" not in lines[line - 1]]


def unsupported(c: Contract, options: dict | None = None) -> list[str]:
    """Features that a contract relies on and the engine has only in part or not at all."""
    return [f"{k}: {why}" for k, why in shortfalls(c, options, least="partial")]


def main(args: list[str] | None = None) -> int:
    """python -m contractlens.services lint|policy|org-policy|cross|merge|scan|check|report FILES

    check answers the requests of protocol.py, a line each; report makes a page of event files. org-policy checks the policy document --rules and lays it on the contracts; policy does so with a list of house rules.
    """
    p = argparse.ArgumentParser(prog="contractlens")
    p.add_argument("what", choices=["lint", "policy", "org-policy", "cross", "merge", "scan", "check", "report"])
    p.add_argument("files", nargs="+")
    p.add_argument("--rules", help="YAML list of organizational policies")
    a = p.parse_args(args)
    if a.what in ("check", "report"):
        from . import protocol, report

        lines = [line for f in a.files for line in (sys.stdin if f == "-" else open(f))]
        if a.what == "check":
            protocol.serve(lines, sys.stdout)
        else:
            print(report.page(report.events_of(lines)))
        return 0
    if a.what == "scan":
        found = [(f, *x) for f in a.files for x in scan_code(open(f).read())]
    else:
        contracts = [load(f) for f in a.files]
        if a.what == "merge":
            print(to_yaml(merge_drafts(contracts)), end="")
            return 0
        if a.what == "lint":
            found = [(c.id, *x) for c, f in zip(contracts, a.files, strict=True) for x in [*validate(c), *(unknown_keys(open(f).read()) if os.path.exists(f) else [])]]
        elif a.what == "org-policy":
            policy = parse_policy(open(a.rules).read())
            found = [("policy", *x) for x in validate_policy(policy)]
            found += [("policy", "WARNING", f"exemption of {e.contract} lapses on {e.review_by}") for e in expiring(policy, 30)]
            found += [(c.id, "ERROR" if x.mode == "enforce" else "WARNING", f"{x.rule}: {x.message}") for c in contracts for x in evaluate(c, policy)]
            blocking = "ERROR" if policy.guarantee_mode == "enforce" else "WARNING"
            found += [(where, blocking if verdict == "Contradicts" else "INFO", what) for _, where, verdict, what in guarantees(contracts, policy)]
        elif a.what == "cross":
            found = cross_contract(contracts)
        else:
            import yaml

            rules = yaml.safe_load(open(a.rules))
            found = [(c.id, *x) for c in contracts for x in policy_findings(c, rules)]
    for x in found:
        print(*x)
    return int(any(a.what not in ("lint", "org-policy") or x[1] == "ERROR" for x in found))


if __name__ == "__main__":
    sys.exit(main())
