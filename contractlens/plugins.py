"""Plug-ins by name: a contract or policy says where the code is, and it is loaded when it is needed."""

from __future__ import annotations

from importlib import import_module


class PluginError(Exception):
    """A named plug-in that cannot be loaded or lacks what its kind needs."""


def resolve(name: str, *needs: str):
    """The object at 'package.module.Name' or 'package.module:Name'; a class is made without arguments. needs: methods it must have."""
    module, _, attr = name.replace(":", ".").rpartition(".")
    try:
        got = getattr(import_module(module), attr)
        got = got() if isinstance(got, type) else got
    except Exception as x:
        raise PluginError(f"{name} cannot be loaded: {x}") from x
    if missing := [m for m in needs if not callable(getattr(got, m, None))]:
        raise PluginError(f"{name} has no {', '.join(missing)}")
    return got
