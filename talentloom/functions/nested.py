"""Rows of any nested schema: one expression that rewrites every string in them, and one that renders them by a table of sections."""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, MapType, StringType, StructType

BLANK = r"^\s*$"
STYLES = ("comprehensive", "compact", "minimal")
#: How many sections a minimal text has. Fixed value.
MINIMAL_SECTIONS = 4


def stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def rewritten(value: Column, kind: DataType, leaf: Callable[[Column, str], Column], path: str = "") -> Column:
    """The value with ``leaf(string, path)`` in place of each string, at any depth of structs, arrays and map values; paths name struct fields only (``jobs.title``).

    Null structs, arrays and maps stay null; entries of a list of strings that ``leaf`` makes null go. Values of other kinds, and keys of maps, stay.
    """
    under = lambda name: f"{path}.{name}" if path else name
    if isinstance(kind, StructType):
        fields = [rewritten(value.getField(f.name), f.dataType, leaf, under(f.name)).alias(f.name) for f in kind]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, ArrayType):
        out = F.transform(value, lambda x: rewritten(x, kind.elementType, leaf, path))
        return F.filter(out, lambda x: x.isNotNull()) if isinstance(kind.elementType, StringType) else out
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: rewritten(x, kind.valueType, leaf, path))
    return leaf(value, path) if isinstance(kind, StringType) else value


def cleaned_rows(df: DataFrame, required: Collection[str] = (), lower: Collection[str] | None = (), empty_lists: bool = True) -> DataFrame:
    """All strings of all columns without outer white space, blank ones as null; blank entries of lists go, and null lists of strings are empty (unless ``empty_lists`` is false).

    Paths in ``required`` keep a blank value as it is; those in ``lower`` (all if it is None) become lower case. Column names may hold dots.
    """

    def leaf(value: Column, path: str) -> Column:
        out = F.nullif(stripped(value), F.lit(""))
        out = F.lower(out) if lower is None or path in lower else out
        return F.coalesce(out, value) if path in required else out

    def of(name: str, kind: DataType) -> Column:
        out = rewritten(F.col("`" + name.replace("`", "``") + "`"), kind, leaf, name)
        is_list = isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType)
        return (F.coalesce(out, F.array().cast("array<string>")) if is_list and empty_lists else out).alias(name)

    return df.select(*(of(f.name, f.dataType) for f in df.schema))


@dataclass(frozen=True)
class Joined:
    """Parts that are there, with a separator; ``split`` puts each on a line of its own in the comprehensive style, ``only`` limits it to that style, ``needs`` to rows with one of these fields."""

    parts: tuple
    separator: str = " | "
    suffix: str = ""
    split: bool = False
    only: bool = False
    needs: tuple[str, ...] = ()


@dataclass(frozen=True)
class First:
    """The first of several parts that is there."""

    parts: tuple


@dataclass(frozen=True)
class Unless:
    """A part for rows that lack a field."""

    field: str
    part: object


@dataclass(frozen=True)
class Section:
    """A title, and its lines: templates like ``"Name: {contact.name}"`` (``{until:Present}`` with what stands for an absent value), or the classes above. With ``each`` they are lines of every struct of an array."""

    title: str
    lines: tuple
    each: str = ""
    rule: int = 0


def _at(value: Column | None, kind: DataType, path: str) -> tuple[Column, DataType] | None:
    """The column at a path of struct fields, and its type; None where the schema has none."""
    for name in path.split("."):
        if not isinstance(kind, StructType) or name not in kind.names:
            return None
        value, kind = (F.col("`" + name.replace("`", "``") + "`") if value is None else value.getField(name)), kind[name].dataType
    return value, kind


def _shown(value: Column, kind: DataType) -> Column:
    """A value as text, null for blank ones and empty lists; a struct by its field ``formatted``, or as JSON."""
    if isinstance(kind, ArrayType):
        if not isinstance(kind.elementType, StringType):
            value = F.transform(value, lambda x: _shown(x, kind.elementType))
        out = F.array_join(F.filter(value, lambda x: ~x.rlike(BLANK)), ", ")
    elif isinstance(kind, StructType) and "formatted" in kind.names:
        out = value.getField("formatted")
    elif isinstance(kind, (StructType, MapType)):
        out = F.to_json(value)
    elif isinstance(kind, BooleanType):
        out = F.when(value, "Yes").when(~value, "No")
    else:
        out = stripped(value.cast("string"))
    return F.nullif(out, F.lit(""))


def title_case(value: Column) -> Column:
    """A capital at the start of each run of letters."""
    return F.array_join(F.transform(F.regexp_extract_all(value, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1)), lambda w: F.initcap(F.lower(w))), "")


class _Renderer:
    def __init__(self, value: Column | None, kind: DataType, style: str, absent: str | None, forms: dict[str, Callable[[Column], Column]]):
        self.value, self.kind, self.style, self.absent, self.forms = value, kind, style, absent, forms

    def field(self, path: str) -> Column:
        found = _at(self.value, self.kind, path)
        if found is None:
            return F.lit(None).cast("string")
        text = _shown(*found)
        return self.forms[path](text) if path in self.forms else text

    def part(self, part: object) -> Column:
        """Null where a field is absent and nothing stands for it."""
        if isinstance(part, Joined):
            there = [self.part(p) for p in part.parts]
            joined = F.nullif(F.concat_ws("\n" if part.split and self.style == "comprehensive" else part.separator, *there), F.lit(""))
            joined = F.concat(joined, F.lit(part.suffix)) if part.suffix else joined
            if part.needs:
                joined = F.when(F.coalesce(*(self.field(p) for p in part.needs)).isNotNull(), joined)
            return F.when(F.lit(not part.only or self.style == "comprehensive"), joined)
        if isinstance(part, First):
            return F.coalesce(*(self.part(p) for p in part.parts), F.lit(None).cast("string"))
        if isinstance(part, Unless):
            return F.when(self.field(part.field).isNull(), self.part(part.part))
        pieces = []
        for literal, name, default, _ in Formatter().parse(part):
            pieces += [F.lit(literal)] if literal else []
            if name is not None:
                instead = default or self.absent
                pieces.append(self.field(name) if instead is None else F.coalesce(self.field(name), F.lit(instead)))
        return F.concat(*pieces)

    def content(self, section: Section) -> Column:
        if not section.each:
            return F.nullif(F.concat_ws("\n", *(self.part(x) for x in section.lines)), F.lit(""))
        found = _at(self.value, self.kind, section.each)
        none = F.lit(self.absent).cast("string")
        if found is None or not isinstance(found[1], ArrayType):
            return none
        entries = F.transform(found[0], lambda x: F.concat_ws("\n", *(_Renderer(x, found[1].elementType, self.style, self.absent, {}).part(line) for line in section.lines)))
        return F.when(F.size(entries) > 0, F.concat(F.lit("\n"), F.array_join(entries, "\n\n\n"), F.lit("\n"))).otherwise(none)


def rendered(schema: StructType, sections: tuple[Section, ...], style: str = "comprehensive", absent: str | None = None, forms: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """A row's text by a table of sections.

    Without ``absent`` lines whose fields are all absent go, and so do empty sections: in the comprehensive style a section is its title, a colon and its lines, and a blank line follows;
    the compact one has title and content on one line, the minimal one the contents of the first four sections there are. With ``absent`` all lines stay, and it stands for what a row
    lacks; titles are underlined by ``rule`` hyphens. ``forms`` rewrites the text of fields. Null for a row without any content.
    """
    if style not in STYLES:
        raise ValueError(f"style must be one of {STYLES}")
    r = _Renderer(None, schema, style, absent, forms or {})
    if absent is not None:
        return F.concat_ws("\n\n", *(F.concat(F.lit(s.title), F.lit("\n" + "-" * s.rule + "\n" if s.rule else ""), F.coalesce(r.content(s), F.lit("")) if s.lines else F.lit("")) for s in sections))
    head = {"comprehensive": lambda s: s.title + ":\n", "compact": lambda s: s.title + ": ", "minimal": lambda s: ""}[style]
    there = F.array_compact(F.array(*(F.concat(F.lit(head(s)), r.content(s)) if head(s) else r.content(s) for s in sections)))
    there = F.slice(there, F.lit(1), F.lit(MINIMAL_SECTIONS)) if style == "minimal" else there
    return F.nullif(F.array_join(there, "\n\n" if style == "comprehensive" else "\n"), F.lit(""))


def sectioned(schema: StructType, sections: dict[str, dict[str, str]]) -> Column:
    """A row as JSON by section: section -> name -> path. Null and unknown fields are left out, empty sections too."""
    parts = {}
    for title, names in sections.items():
        there = {name: found for name, path in names.items() if (found := _at(None, schema, path))}
        if there:
            some = F.coalesce(*(v.isNotNull() for v, _ in there.values())) if len(there) == 1 else sum((v.isNotNull().cast("int") for v, _ in there.values()), F.lit(0)) > 0
            parts[title] = F.when(some, F.struct(*(v.alias(name) for name, (v, _) in there.items())))
    return F.to_json(F.struct(*(v.alias(k) for k, v in parts.items()))) if parts else F.lit("{}")
