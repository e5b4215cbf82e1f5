"""Path templates: a template string becomes one Spark column.

A template mixes literal text, `$field`, `${a|b}` (first non-empty of several),
`$!{field}` (a value whose slashes stay directory separators) and `[...]`
sections that appear only when a field inside them has a value. `$[` and `$]`
are literal brackets. The string is read once on the driver; every row is then
computed by built-in expressions, so nothing leaves the JVM.
"""

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions.paths import blank_to_null, sanitize, sanitize_path
from shelfmark.schemas import SECTION_DEPTH

_TOKEN = re.compile(
    r"(?P<bracket>\$[\[\]])"
    r"|\$(?P<path>!?)\{(?P<names>[^}]*)(?P<end>\}?)"
    r"|\$(?P<bare>[A-Za-z0-9_]+)"
    r"|(?P<open>\[)|(?P<close>\])"
    r"|(?P<text>[^$\[\]]+|\$!?)",
    re.DOTALL,
)
_UPPER_TO_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


class TemplateError(ValueError):
    """The template cannot give valid path components."""


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Field:
    names: tuple
    keeps_slashes: bool = False


@dataclass(frozen=True)
class Section:
    parts: tuple


def _fold_names(names: str):
    return tuple(n.translate(_UPPER_TO_LOWER) for n in names.split("|"))


def read_template(template: str) -> tuple:
    levels = [[]]
    for m in _TOKEN.finditer(template):
        here = levels[-1]
        if m["bracket"]:
            here.append(Text(m["bracket"][1]))
        elif m["names"] is not None:
            if not m["end"]:
                raise TemplateError("a ${ field is never closed")
            here.append(Field(_fold_names(m["names"]), bool(m["path"])))
        elif m["bare"]:
            here.append(Field(_fold_names(m["bare"])))
        elif m["open"]:
            if len(levels) > SECTION_DEPTH:
                raise TemplateError(f"sections nest deeper than {SECTION_DEPTH}")
            levels.append([])
        elif m["close"] and len(levels) > 1:
            levels.pop()
            levels[-1].append(Section(tuple(here)))
        else:
            text = m["close"] or m["text"]
            if any(c < " " for c in text):
                raise TemplateError("a control character stands in the literal text")
            here.append(Text(text))
    if len(levels) > 1:
        raise TemplateError("a [ section is never closed")
    return tuple(levels[0])


def _names_in(parts):
    for part in parts:
        if isinstance(part, Field):
            yield from part.names
        elif isinstance(part, Section):
            yield from _names_in(part.parts)


def referenced_fields(template: str) -> list:
    """Lowercase field names the template can read; only these need loading."""
    return sorted(set(_names_in(read_template(template))))


def _field_value(field: Field, lookup, fallbacks) -> Column:
    options = []
    for name in field.names:
        value, spare = lookup(name), fallbacks.get(name)
        if field.keeps_slashes:
            # An empty value hides the fallback of its own name here.
            source = value if spare is None else F.coalesce(value, F.lit(spare))
            options.append(blank_to_null(sanitize_path(source)))
        else:
            options.append(sanitize(blank_to_null(value)))
            if spare:
                options.append(sanitize(F.lit(spare)))
    return F.coalesce(*options)


def _render(parts, lookup, fallbacks, default):
    """(text column, list of presence columns, list of top-level field columns)."""
    texts, present, top = [], [], []
    for part in parts:
        if isinstance(part, Text):
            texts.append(F.lit(part.text))
        elif isinstance(part, Field):
            value = _field_value(part, lookup, fallbacks)
            present.append(value.isNotNull())
            top.append(value.isNotNull())
            texts.append(F.coalesce(value, sanitize(F.lit(default))))
        else:
            inner, inside, _ = _render(part.parts, lookup, fallbacks, "")
            if inside:
                shown = F.greatest(*inside) if len(inside) > 1 else inside[0]
                present.append(shown)
                texts.append(F.when(shown, inner).otherwise(F.lit("")))
    return (F.concat(*texts) if texts else F.lit("")), present, top


def template_column(template: str, lookup, fallbacks=None, default="", extension=None, skip_missing=False) -> Column:
    """Path column of a template.

    lookup: field name -> Column (null when the track has no such field).
    fallbacks: field name -> text used when the field is missing.
    default: text for a top-level field that stays missing.
    skip_missing: give null instead when a top-level field stays missing.
    """
    spare = {k.translate(_UPPER_TO_LOWER): v for k, v in (fallbacks or {}).items()}
    text, _, top = _render(read_template(template), lookup, spare, "" if skip_missing else default)
    path = text if extension is None else F.concat(text, F.lit("."), extension)
    if skip_missing and top:
        complete = F.least(*top) if len(top) > 1 else top[0]
        path = F.when(complete, path)
    return path
