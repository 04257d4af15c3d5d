"""Several columns that claim one field: which value stays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, NumericType, StringType, StructType

# Tenths for a value that is there, that is not empty, that is longer, and that looks like its field; how sure a mapping must be to win a tie.
THERE, SOME, LONGER, FITS = 2, 2, 2, 4
LONG_TEXT, LONG_LIST, PHONE_DIGITS, SURE = 5, 1, 10, 0.8
NAMES = ("name", "first_name", "last_name")


@dataclass(frozen=True)
class Claim:
    """A column that is mapped to a field, and how sure the mapping is."""

    column: str
    field: str
    confidence: float = 1.0


def datum_quality(value: Column, kind: DataType, field: str) -> Column:
    """Quality of one value of a field in tenths, by its kind: null 0; there, filled, longer than five letters or one entry, and of the look of an e-mail address, phone number or name."""
    points = F.lit(THERE)
    given = lambda condition, n: F.when(condition, n).otherwise(0)
    if isinstance(kind, StringType):
        bare = F.regexp_replace(value, r"^\s+|\s+$", "")
        points = points + given(F.length(bare) > 0, SOME) + given(F.length(bare) > LONG_TEXT, LONGER)
        if field == "email":
            points = points + given(F.contains(value, F.lit("@")) & F.contains(value, F.lit(".")), FITS)
        elif field == "phone":
            points = points + given(F.regexp_count(value, F.lit(r"\d")) >= PHONE_DIGITS, FITS)
        elif field in NAMES:
            points = points + given((F.length(bare) > 0) & ~value.rlike(r"\d"), FITS)
    elif isinstance(kind, NumericType):
        points = points + given(value > 0, SOME + LONGER)
    elif isinstance(kind, ArrayType):
        points = points + given(F.size(value) > 0, SOME) + given(F.size(value) > LONG_LIST, LONGER)
    elif isinstance(kind, (StructType, MapType)):
        points = points + (given(F.size(value) > 0, SOME + LONGER) if isinstance(kind, MapType) else SOME + LONGER)
    return F.when(value.isNull(), 0).otherwise(F.least(points, F.lit(10)))


def _text(value: Column, kind: DataType) -> Column:
    """A value as text: lists joined, structs and maps as JSON."""
    if isinstance(kind, ArrayType):
        return F.when(value.isNotNull(), F.array_join(value.cast("array<string>"), ", "))
    return F.to_json(value) if isinstance(kind, (StructType, MapType)) else value.cast("string")


def resolved(df: DataFrame, claims: list[Claim], keep: list[str]) -> DataFrame:
    """``keep`` and, for each field in the order of its first claim, a struct ``value, source, quality, reason, n_claims`` out of all columns that claim it.

    Claims are met in their order, null and blank ones are passed over. A later value takes the place of an earlier one if its quality is higher (``higher_quality``), or equal with
    a mapping that is more than 0.8 sure (``higher_confidence``); else the earlier stays (``existing_higher_quality``, ``kept_existing``). The first has ``only``, a field without
    values nulls, quality 0 and ``absent``. Values of a field whose columns differ in type, and lists, become text. All is worked out within the row, without a shuffle.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    fields = list(dict.fromkeys(c.field for c in claims))
    out = []
    for field in fields:
        mine = [c for c in claims if c.field == field]
        same = len({kinds[c.column] for c in mine}) == 1 and not isinstance(kinds[mine[0].column], (ArrayType, StructType, MapType))
        as_value = (lambda v, k: v) if same else _text
        kind = kinds[mine[0].column].simpleString() if same else "string"
        given = F.array(*(
            F.struct(as_value(name(c.column), kinds[c.column]).alias("value"), F.lit(c.column).alias("source"), datum_quality(name(c.column), kinds[c.column], field).alias("quality"), F.lit(c.confidence > SURE).alias("sure"))
            for c in mine
        ))
        there = F.filter(given, lambda x: x["value"].isNotNull() & ~F.coalesce(x["value"].cast("string").rlike(r"^\s*$"), F.lit(False)))

        def meet(held: Column, new: Column) -> Column:
            better, equal = new["quality"] > held["quality"], new["quality"] == held["quality"]
            first, wins = held["n_claims"] == 0, better | (equal & new["sure"])
            reason = F.when(first, "only").when(better, "higher_quality").when(equal & new["sure"], "higher_confidence").when(equal, "kept_existing").otherwise("existing_higher_quality")
            pick = lambda k: F.when(first | wins, new[k]).otherwise(held[k]).alias(k)
            return F.struct(pick("value"), pick("source"), pick("quality"), reason.alias("reason"), (held["n_claims"] + 1).alias("n_claims"))

        none = F.struct(F.lit(None).cast(kind).alias("value"), F.lit(None).cast("string").alias("source"), F.lit(0).alias("quality"), F.lit("absent").alias("reason"), F.lit(0).alias("n_claims"))
        out.append(F.aggregate(there, none, meet).alias(field))
    return df.select(*(name(k) for k in keep), *out)


def unpivoted(df: DataFrame, claims: list[Claim], keys: list[str]) -> DataFrame:
    """One row for each value: the keys, ``field, source, place`` (of the claim), ``value`` as text, ``quality`` and ``sure``; null and blank values have none. For tables whose claims come as rows of several sources."""
    kinds = {f.name: f.dataType for f in df.schema}
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = F.array(*(
        F.struct(F.lit(c.field).alias("field"), F.lit(c.column).alias("source"), F.lit(k).alias("place"), _text(name(c.column), kinds[c.column]).alias("value"), datum_quality(name(c.column), kinds[c.column], c.field).alias("quality"), F.lit(c.confidence > SURE).alias("sure"))
        for k, c in enumerate(claims)
    ))
    return df.select(*(name(k) for k in keys), F.inline(rows)).filter(F.col("value").isNotNull() & ~F.col("value").rlike(r"^\s*$"))


def resolved_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The winner of each key and field in a table like ``unpivoted``'s, whatever number of rows claim it: ``keys, field, value, source, quality, n_claims``.

    The same rule as ``resolved`` as one aggregate, combined before the second of two shuffles: of the highest quality the last sure claim wins, or the first if none but it is sure. Claims of one place are told apart by source and value.
    The first shuffle deals claims out by all that they hold: the combining sorts a task's rows, and a small file may hold very many; a key with many claims is spread too.
    """
    rows = rows.repartition(*keys, "field", "place", "source", "value")
    order = F.struct("place", "source", "value")
    # of equally good claims a sure one displaces what came before; where none follows the first, the first stays
    rank = F.struct(F.col("quality"), F.when(F.col("sure"), 1).otherwise(0).alias("is_sure"))
    last = F.max_by(F.struct("value", "source", "quality"), F.struct(rank.alias("rank"), order.alias("order")))
    first = F.min_by(F.struct("value", "source", "quality"), F.struct((-F.col("quality")).alias("worse"), order.alias("order")))
    any_sure = F.max(rank)
    return rows.groupBy(*keys, "field").agg(F.when(any_sure["is_sure"] == 1, last).otherwise(first).alias("w"), F.count(F.lit(1)).alias("n_claims")).select(*keys, "field", "w.value", "w.source", "w.quality", "n_claims")
