"""Declared parameters: type, default, range, choices and a text beside each field of a settings class.

A declaration checks one set of values in the driver (:func:`build`) and any number of them, stored as JSON, as a column (:func:`problems`).
"""

from __future__ import annotations

from dataclasses import MISSING, dataclass, field, fields, is_dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {bool: "boolean", int: "integer", float: "number", str: "string"}


@dataclass(frozen=True)
class Spec:
    name: str
    kind: str
    default: Any
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()
    text: str = ""


def param(default: Any, text: str, low: float | None = None, high: float | None = None, choices: tuple[str, ...] = ()) -> Any:
    """A field of a settings class with its declaration."""
    return field(default=default, metadata={"text": text, "low": low, "high": high, "choices": tuple(choices)})


def _nested(f) -> type | None:
    return f.default_factory if f.default_factory is not MISSING and is_dataclass(f.default_factory) else None


def specs(cls: type, prefix: str = "") -> list[Spec]:
    """The declared parameters of a class; those of a nested one are named ``outer.inner``."""
    out = []
    for f in fields(cls):
        if nested := _nested(f):
            out += specs(nested, f"{prefix}{f.name}.")
        elif type(f.default) in KINDS:
            out.append(Spec(prefix + f.name, KINDS[type(f.default)], f.default, **f.metadata))
    return out


def table(spark: SparkSession, cls: type) -> DataFrame:
    """``(name, kind, default, low, high, choices, text)``, one row per parameter."""
    rows = [(s.name, s.kind, str(s.default), s.low, s.high, list(s.choices), s.text) for s in specs(cls)]
    rows = [tuple(float(v) if i in (3, 4) and v is not None else v for i, v in enumerate(r)) for r in rows]
    return spark.createDataFrame(rows, "name string, kind string, default string, low double, high double, choices array<string>, text string")


def _fits(spec: Spec, value: Any) -> str | None:
    kinds = {"boolean": (bool,), "integer": (int,), "number": (int, float), "string": (str,)}[spec.kind]
    if not isinstance(value, kinds) or (isinstance(value, bool) and spec.kind != "boolean"):
        return f"{spec.name} is no {spec.kind}"
    if spec.choices and str(value).lower() not in spec.choices:
        return f"{spec.name} is none of its choices"
    if (spec.low is not None and not value >= spec.low) or (spec.high is not None and not value <= spec.high):
        return f"{spec.name} is out of range"
    return None


def _check(cls: type, values: Any, prefix: str = "") -> list[str]:
    if not isinstance(values, dict):
        return [f"{prefix.rstrip('.') or 'settings'} is no object"]
    known = {f.name: f for f in fields(cls)}
    own = {s.name: s for s in specs(cls, prefix)}
    found = [f"{prefix}{name} is unknown" for name in values if name not in known]
    for name, f in known.items():
        if name not in values:
            continue
        if nested := _nested(f):
            found += _check(nested, values[name], f"{prefix}{name}.")
        elif prefix + name in own and (wrong := _fits(own[prefix + name], values[name])):
            found.append(wrong)
    return sorted(found)


def build(cls: type, values: dict) -> Any:
    """An instance with the given values; all that is wrong with them is named in one error."""
    if found := _check(cls, values):
        raise ValueError("; ".join(found))
    return cls(**{f.name: build(n, values[f.name]) if (n := _nested(f)) else values[f.name] for f in fields(cls) if f.name in values})


def problems(settings: Column | str, cls: type) -> Column:
    """What is wrong with settings given as JSON text, sorted: the messages of :func:`build`, none for a null.

    Text that is no JSON object is one problem.
    """
    text = F.col(settings) if isinstance(settings, str) else settings
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_compact(F.flatten(F.array(*_rules(text, F.try_parse_json(text), cls, ""))))))


def _rules(text: Column, parsed: Column, cls: type, prefix: str) -> list[Column]:
    """Arrays of problems, with nulls where there is none."""
    at = "$" if not prefix else f"$.{prefix.rstrip('.')}"
    own = F.get_json_object(text, at) if prefix else text
    label = prefix.rstrip(".") or "settings"
    # null where the value is missing, 'OBJECT<…>' for an object
    kind_at = lambda path: F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
    kind = kind_at(at)
    is_object = F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False))
    missing = kind.isNull() if prefix else F.lit(False)
    known = F.array(*[F.lit(f.name) for f in fields(cls)])
    keys = F.when(is_object, F.json_object_keys(own)).otherwise(F.array().cast("array<string>"))
    unknown = F.transform(F.filter(keys, lambda k: ~F.array_contains(known, k)), lambda k: F.concat(F.lit(prefix), k, F.lit(" is unknown")))
    out = [F.array(F.when(~is_object & ~missing, F.lit(f"{label} is no object"))), F.coalesce(unknown, F.array().cast("array<string>"))]
    nested = {f.name: n for f in fields(cls) if (n := _nested(f))}
    checks = []
    for spec in specs(cls, prefix):
        if spec.name.removeprefix(prefix).partition(".")[0] in nested:
            continue
        path = f"$.{spec.name}"
        given = kind_at(path)
        fits = {
            "boolean": given == "BOOLEAN",
            "integer": given == "BIGINT",
            "number": given.isin("BIGINT", "DOUBLE") | F.startswith(given, F.lit("DECIMAL")),
            "string": given == "STRING",
        }[spec.kind]
        rule = F.when(given.isNull(), None).when(~fits, F.lit(f"{spec.name} is no {spec.kind}"))
        if spec.choices:
            rule = rule.when(~F.lower(F.try_variant_get(parsed, path, "string")).isin(*spec.choices), F.lit(f"{spec.name} is none of its choices"))
        value = F.try_variant_get(parsed, path, "double")
        beyond = [c for bound, c in ((spec.low, value < F.lit(spec.low)), (spec.high, value > F.lit(spec.high))) if bound is not None]
        for condition in beyond:
            rule = rule.when(condition, F.lit(f"{spec.name} is out of range"))
        checks.append(F.when(is_object, rule))
    out.append(F.array(*checks))
    for name, inner in nested.items():
        out += _rules(text, parsed, inner, f"{prefix}{name}.")
    return out
