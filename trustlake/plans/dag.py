"""A DAG of functions: a function is a node, a parameter's name an edge."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from types import ModuleType
from typing import Any


class DagError(ValueError):
    pass


class Dag:
    def __init__(self, *modules: ModuleType, config: dict[str, Any] | None = None) -> None:
        self.config = config or {}
        self.nodes: dict[str, Callable[..., Any]] = {}
        for m in modules:
            for name, f in vars(m).items():
                if inspect.isfunction(f) and f.__module__ == m.__name__ and not name.startswith("_"):
                    if name in self.nodes:
                        raise DagError(f"two nodes are named {name}")
                    self.nodes[name] = f

    def run(self, final: Sequence[Callable[..., Any]], inputs: dict[str, Any] | None = None) -> dict[str, Any]:
        """Values of the functions asked for. A node shared by several is computed once (frames stay lazy)."""
        known = {**self.config, **(inputs or {})}

        def value(name: str, path: tuple[str, ...]) -> Any:
            if name in known:
                return known[name]
            if name in path:
                raise DagError("a cycle: " + " -> ".join((*path, name)))
            if name not in self.nodes:
                raise DagError(f"{path[-1] if path else 'the caller'} needs {name}, which is neither a node nor an input")
            args = {}
            for p in inspect.signature(self.nodes[name]).parameters.values():
                if p.default is inspect.Parameter.empty or p.name in known or p.name in self.nodes:
                    args[p.name] = value(p.name, (*path, name))
            known[name] = self.nodes[name](**args)
            return known[name]

        for f in final:
            if not inspect.isfunction(f):
                raise TypeError(f"outputs are function objects, not {f!r}")
        return {f.__name__: value(f.__name__, ()) for f in final}


def run_dag(*modules: ModuleType, final: Sequence[Callable[..., Any]], inputs: dict[str, Any] | None = None, config: dict[str, Any] | None = None) -> dict[str, Any]:
    return Dag(*modules, config=config).run(final, inputs)


def validated(contract: Any) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
    """Node decorator: the frame it returns keeps the contract."""

    def wrap(f: Callable[..., Any]) -> Callable[..., Any]:
        def inner(*a: Any, **k: Any) -> Any:
            return contract.validate(f(*a, **k))

        inner.__name__, inner.__doc__, inner.__module__, inner.__signature__ = f.__name__, f.__doc__, f.__module__, inspect.signature(f)
        return inner

    return wrap
