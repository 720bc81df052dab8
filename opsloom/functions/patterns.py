"""Small text specifications turned into Column predicates.

Label selectors (B22), JSON filter policies and event patterns (B23), metric filter
patterns (B24), glob parsing (A5) and glob matching (I14).
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE: dict[str, Callable] = {"=": operator.eq, "==": operator.eq, "!=": operator.ne, "<>": operator.ne,
                                "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def every(conditions: list[Column]) -> Column:
    return reduce(operator.and_, conditions, F.lit(True))


def some(conditions: list[Column]) -> Column:
    return reduce(operator.or_, conditions, F.lit(False))


def label_selector(selector: str, labels: Column) -> Column:
    """``a=b,env in (x,y),tier!=z,owner`` over a label map.

    ``!=`` and ``notin`` also accept rows that lack the key.
    """
    conditions = []
    for term in re.split(r",(?![^(]*\))", selector):
        term = term.strip()
        in_list = re.fullmatch(r"(\S+)\s+(in|notin)\s+\(([^)]*)\)", term)
        if in_list:
            key, verb, raw = in_list.groups()
            inside = labels[key].isin([v.strip() for v in raw.split(",")])
            conditions.append(F.coalesce(inside if verb == "in" else ~inside, F.lit(verb == "notin")))
        elif "!=" in term:
            key, value = (s.strip() for s in term.split("!=", 1))
            conditions.append(F.coalesce(labels[key] != value, F.lit(True)))
        elif "=" in term:
            key, value = (s.strip() for s in re.split(r"={1,2}", term, maxsplit=1))
            conditions.append(F.coalesce(labels[key] == value, F.lit(False)))
        elif term.startswith("!"):
            conditions.append(~F.map_contains_key(labels, term[1:].strip()))
        else:
            conditions.append(F.map_contains_key(labels, term))
    return every(conditions)


def _rule(field: Column, rule: object) -> Column:
    if not isinstance(rule, Mapping):
        return field.isNull() if rule is None else field == F.lit(rule)
    (kind, arg), = rule.items()
    if kind == "exists":
        return field.isNotNull() if arg else field.isNull()
    if kind == "prefix":
        return field.startswith(arg)
    if kind == "numeric":
        number = field.try_cast("double")
        return every([COMPARE[op](number, bound) for op, bound in zip(arg[::2], arg[1::2])])
    if kind == "anything-but":
        if isinstance(arg, Mapping):
            return ~_rule(field, arg)
        return ~field.isin(arg if isinstance(arg, list) else [arg])
    raise ValueError(f"unknown rule {kind}")


def policy(spec: Mapping, field: Callable[[str], Column], path: str = "") -> Column:
    """All attributes must match; one attribute matches if any of its rules does.

    Nested objects address nested fields (``{"detail": {"state": [...]}}``). A missing
    attribute fails every rule except ``exists: false``.
    """
    conditions = []
    for name, rules in spec.items():
        full = f"{path}.{name}" if path else name
        if isinstance(rules, Mapping):
            conditions.append(policy(rules, field, full))
        else:
            conditions.append(some([F.coalesce(_rule(field(full), r), F.lit(False)) for r in rules]))
    return every(conditions)


def column_fields(df: DataFrame) -> Callable[[str], Column]:
    """Field lookup by column path; an unknown top-level column counts as missing."""
    known = set(df.columns)
    return lambda path: F.col(path) if path.split(".")[0] in known else F.lit(None).cast("string")


def json_fields(body: Column) -> Callable[[str], Column]:
    return lambda path: F.get_json_object(body, "$." + path)


def metric_pattern(pattern: str, message: Column) -> Column:
    """Term, several terms (all), ``{ $.a = 1 }`` or ``[ip, *, status = 500]``."""
    text = pattern.strip()
    if text.startswith("{"):
        conditions = []
        for clause in text.strip("{} ").split("&&"):
            path, op, raw = re.fullmatch(r"\s*(\$\S+)\s*(!=|<=|>=|=|<|>)\s*(.+?)\s*", clause).groups()
            value = F.try_variant_get(F.try_parse_json(message), path, "string")
            conditions.append(_compare(value, op, raw))
        return F.coalesce(every(conditions), F.lit(False))
    if text.startswith("["):
        fields = [f.strip() for f in text.strip("[] ").split(",")]
        words = F.split(message, " ")
        conditions = [F.size(words) == len(fields)]
        for index, spec in enumerate(fields):
            found = re.fullmatch(r"\S+\s*(!=|<=|>=|=|<|>)\s*(.+)", spec)
            if found:
                conditions.append(_compare(F.get(words, index), *found.groups()))
        return F.coalesce(every(conditions), F.lit(False))
    return every([message.contains(term) for term in text.split()])


def _compare(value: Column, op: str, raw: str) -> Column:
    raw = raw.strip().strip('"')
    if re.fullmatch(r"-?\d+(\.\d+)?", raw):
        return COMPARE[op](value.try_cast("double"), float(raw))
    return COMPARE[op](value, raw)


def glob_regex(glob: str) -> str:
    """Anchored regular expression for a ``*``/``?`` glob."""
    return "^" + "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in glob) + "$"


def glob_capture(pattern: str) -> str:
    """Regular expression that captures every ``*`` of a parse pattern."""
    parts = pattern.split("*")
    return "".join(re.escape(part) + ("(.*)" if i == len(parts) - 2 and not parts[-1] else "(.*?)" if i < len(parts) - 1
                   else "") for i, part in enumerate(parts))
