"""Contracts from a YAML schema, and Python constants from contracts."""

from __future__ import annotations

import json
import os
import re

from ..contracts import Column, ContractError, TableContract

# Schema ranges and their dtypes.
RANGES = {"string": "string", "integer": "int64", "float": "float64", "double": "float64", "boolean": "bool", "date": "date", "datetime": "datetime_utc", "uri": "string", "uriorcurie": "string", "curie": "string", "ncname": "string", "time": "string"}


def load_tables(path: str, *, forbidden_columns: tuple[str, ...] = ()) -> list[TableContract]:
    """Classes annotated with a table become contracts. Nothing is guessed: a decimal needs its precision."""
    import yaml

    with open(path) as f:
        doc = yaml.safe_load(f)
    slots, enums, default = doc.get("slots") or {}, doc.get("enums") or {}, doc.get("default_range", "string")
    forbidden = {c.lower() for c in forbidden_columns}
    out = []
    for name, cls in (doc.get("classes") or {}).items():
        notes = {k.split(".", 1)[1]: _value(v) for k, v in (cls.get("annotations") or {}).items() if "." in k}
        if "table" not in notes:
            continue
        columns = []
        for slot in [*(cls.get("slots") or []), *(cls.get("attributes") or {})]:
            spec = {**(slots.get(slot) or {}), **((cls.get("attributes") or {}).get(slot) or {}), **((cls.get("slot_usage") or {}).get(slot) or {})}
            if slot.lower() in forbidden:
                raise ContractError(f"{name}: column {slot!r} is forbidden")
            columns.append(_column(name, slot, spec, enums, default))
        grain = notes.get("grain") or ""
        out.append(TableContract(name, notes["table"], tuple(columns), notes.get("partition_by") or None, tuple(x.strip() for x in str(grain).split(",") if x.strip() and x.strip() != "none"), notes.get("cadence") or None, str(notes["expected_start"]) if notes.get("expected_start") else None))
    return out


def _value(v: object) -> object:
    return v.get("value") if isinstance(v, dict) else v


def _column(cls: str, slot: str, spec: dict, enums: dict, default: str) -> Column:
    rng = spec.get("range", default)
    dtype = next((str(_value(v)) for k, v in (spec.get("annotations") or {}).items() if k.endswith(".dtype")), None)
    allowed = None
    if rng in enums:
        allowed, dtype = tuple(enums[rng].get("permissible_values") or {}), dtype or "string"
    if rng == "decimal" and not dtype:
        raise ContractError(f"{cls}.{slot}: a decimal needs precision and scale")
    if not dtype and rng not in RANGES:
        raise ContractError(f"{cls}.{slot}: unknown range {rng!r}")
    return Column(slot, dtype or RANGES[rng], bool(spec.get("required")), spec.get("pattern"), allowed, spec.get("minimum_value"), spec.get("maximum_value"), spec.get("description") or "")


def const_name(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).upper()


def render_tables(contracts: list[TableContract], source: str) -> str:
    """The same text for the same contracts."""
    lines = [f'"""Generated from {source}. Do not edit."""', "", "from trustlake.contracts import Column, TableContract", ""]
    for c in sorted(contracts, key=lambda c: c.name):
        lines.append(f"{const_name(c.name)} = TableContract(")
        lines += [f"    {k}={getattr(c, k)!r}," for k in ("name", "table")]
        lines.append("    columns=(")
        lines += [f"        {x!r}," for x in c.columns]
        lines.append("    ),")
        lines += [f"    {k}={getattr(c, k)!r}," for k in ("partition_by", "grain", "cadence", "expected_start")]
        lines += [")", ""]
    return "\n".join(lines)


def render_jsonschema(contracts: list[TableContract]) -> str:
    kinds = {"string": "string", "bool": "boolean", "float64": "number", "date": "string", "datetime": "string", "datetime_utc": "string"}
    out = {}
    for c in contracts:
        props = {}
        for x in c.columns:
            p = {"type": kinds.get(x.dtype, "integer" if x.dtype.startswith("int") else "number")}
            p |= {k: v for k, v in (("pattern", x.pattern), ("enum", list(x.allowed) if x.allowed else None), ("minimum", x.minimum), ("maximum", x.maximum), ("description", x.description or None)) if v is not None}
            props[x.name] = p
        out[c.name] = {"type": "object", "properties": props, "required": [x.name for x in c.columns if x.required]}
    return json.dumps({"$defs": out}, indent=2, sort_keys=True)


def stale(path: str, text: str) -> bool:
    if not os.path.exists(path):
        return True
    with open(path) as f:
        return f.read() != text
