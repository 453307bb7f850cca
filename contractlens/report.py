"""Events as a page to read: verdicts by output, with what was found."""

from __future__ import annotations

import html
import json

PAGE = """<!doctype html>
<html lang="en"><head><meta charset="utf-8"><title>Contract report</title>
<style>body{{font-family:sans-serif;margin:2rem}}table{{border-collapse:collapse}}td,th{{border:1px solid #999;padding:.3rem .6rem;text-align:left}}
.FAILED{{background:#fdd}}.PASSED{{background:#dfd}}</style></head>
<body><h1>Contract report</h1><p>{summary}</p>
<table><tr><th>Event</th><th>Contract</th><th>Output</th><th>Status</th><th>Rows</th><th>Findings</th></tr>
{rows}
</table></body></html>
"""


def events_of(lines) -> list[dict]:
    return [json.loads(x) for x in lines if x.strip()]


def page(events: list[dict]) -> str:
    """An HTML page; every text of an event is escaped."""
    say = lambda x: html.escape("" if x is None else str(x))
    rows = []
    for e in events:
        found = "<br>".join(f"<b>{say(v.get('type'))}</b> {say(v.get('message'))}" for v in e.get("violations", ()))
        status = e.get("status") if e.get("status") in ("PASSED", "FAILED") else ""
        cells = [say(e.get("type")), say(f"{e.get('contract') or ''} {e.get('version') or ''}"), say(e.get("output")), say(e.get("status")), say(e.get("rows")), found]
        rows.append(f'<tr class="{status}">' + "".join(f"<td>{c}</td>" for c in cells) + "</tr>")
    failed = sum(e.get("status") == "FAILED" for e in events)
    return PAGE.format(summary=say(f"{len(events)} events, {failed} failed"), rows="\n".join(rows))
