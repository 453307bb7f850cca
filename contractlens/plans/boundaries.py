"""Points that cut a frame's lineage: what stands behind a checkpoint is remembered, so that the checks still see it.

A cached frame keeps its plan, so nothing is lost there. A checkpoint leaves a source without a location whose columns keep their ids;
the plan with the same ids that was seen before is what made it.
"""

from __future__ import annotations

from collections import OrderedDict

#: How many plans are remembered; the oldest go first.
MOST = 512
_SEEN: OrderedDict[tuple, object] = OrderedDict()


def _ids(jplan) -> tuple:
    out = jplan.output()
    return tuple(out.apply(i).exprId().id() for i in range(out.size()))


def remember(jplan) -> None:
    """Keep an analyzed plan by the ids of its columns, unless it is itself only a source without a location."""
    if jplan.getClass().getSimpleName() in ("LogicalRDD", "ExternalRDD"):
        return
    key = _ids(jplan)
    if key:
        _SEEN.pop(key, None)
        _SEEN[key] = jplan
        while len(_SEEN) > MOST:
            _SEEN.popitem(last=False)


def behind(output) -> object | None:
    """The plan that made a source with these (name, id) columns, or None."""
    return _SEEN.get(tuple(i for _, i in output))


def checkpoint(df, eager: bool = True):
    """df.checkpoint() whose lineage the checks see through. Needs the session's checkpoint folder."""
    remember(df._jdf.queryExecution().analyzed())
    return df.checkpoint(eager)


def clear() -> None:
    _SEEN.clear()
