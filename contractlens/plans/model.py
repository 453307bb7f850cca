"""The plan and expression model: what a job does, free of any engine's classes."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True, eq=False)
class Expr:
    """kind: column, literal, cast, alias, arithmetic, compare, bool, when, function, aggregate, udf, field, struct, unknown."""

    kind: str
    name: str = ""
    args: tuple = ()
    value: object = None
    type: str = ""
    id: int | None = None
    distinct: bool = False

    def columns(self) -> list[Expr]:
        """All column references below, each once."""
        out, seen, todo = [], set(), [self]
        while todo:
            e = todo.pop()
            if e.kind == "column" and (e.id, e.name) not in seen:
                seen.add((e.id, e.name))
                out.append(e)
            todo += reversed(e.args)
        return out


@dataclass(frozen=True, eq=False)
class Plan:
    """kind: read, write, project, filter, join, aggregate, union, sort, limit, distinct, window, set, generate, expand, unknown.

    A DAG compared by identity; walk it with nodes(), which visits a shared node once.
    """

    kind: str
    inputs: tuple = ()
    exprs: tuple = ()  # outputs of project, aggregate, window and generate; the condition of filter and join; orders of sort
    keys: tuple = ()  # groupBy of aggregate, partitionBy of window
    output: tuple = ()  # (name, id) of what comes out
    info: dict = field(default_factory=dict)


def nodes(plan: Plan) -> list[Plan]:
    out, seen, todo = [], set(), [plan]
    while todo:
        p = todo.pop()
        if id(p) not in seen:
            seen.add(id(p))
            out.append(p)
            todo += reversed(p.inputs)
    return out


def bottom_up(plan: Plan) -> list[Plan]:
    """Every node once, inputs first, without recursion."""
    out, done, todo = [], set(), [(plan, False)]
    while todo:
        p, ready = todo.pop()
        if id(p) in done:
            continue
        if ready:
            done.add(id(p))
            out.append(p)
        else:
            todo.append((p, True))
            todo += [(x, False) for x in p.inputs if id(x) not in done]
    return out


def text_of(e: Expr) -> str:
    inner = ", ".join(text_of(a) for a in e.args)
    if e.kind == "column":
        return e.name
    if e.kind == "literal":
        return repr(e.value) if e.value is not None else f"NULL:{e.type}"
    if e.kind == "alias":
        return f"{inner} AS {e.name}"
    if e.kind == "cast":
        return f"CAST({inner} AS {e.type})"
    return f"{e.name or e.kind}({'DISTINCT ' if e.distinct else ''}{inner})"


def render(plan: Plan) -> str:
    """An indented tree; a node met again is named as shown above."""
    lines, seen, todo = [], set(), [(plan, 0)]
    while todo:
        p, depth = todo.pop()
        head = p.kind.capitalize() + (f" {p.info['location']}" if p.info.get("location") else "")
        said = "; ".join(text_of(e) for e in p.exprs)
        again = id(p) in seen and bool(p.inputs)
        lines.append("  " * depth + head + (" (shown above)" if again else f" [{said}]" if said else ""))
        if not again:
            seen.add(id(p))
            todo += [(x, depth + 1) for x in reversed(p.inputs)]
    return "\n".join(lines)
