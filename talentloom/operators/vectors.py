"""Exact vector retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talentloom.functions.similarity import cosine
from talentloom.functions.text import preview

#: Rows to retrieve and rows to read closely, by preset. Fixed values.
PRESETS = {"fast": (20, 3), "balanced": (50, 10), "comprehensive": (100, 20), "exhaustive": (200, 30)}
#: Weight and reach of each vector field in a search over several. Fixed values.
FIELD_BOOSTS = {"combined": (1.0, 2), "skills": (0.8, 1), "experience": (0.9, 1)}
#: How many times as far a search reaches whose hits are filtered afterwards. Fixed value.
OVERFETCH = 5


#: The vector column that each field of a search looks in. Fixed values.
VECTOR_OF_FIELD = {"skills": "skills_vector", "experience": "experience_text_vector", "education": "education_text_vector", "projects": "projects_text_vector", "full_text": "combined_resume_vector"}


def vector_of(field: str) -> str:
    """The vector column of a field; an error that names the choices for any other."""
    if field not in VECTOR_OF_FIELD:
        raise ValueError(f"Invalid field name. Choose from: {', '.join(VECTOR_OF_FIELD)}")
    return VECTOR_OF_FIELD[field]


def retrieved(df: DataFrame, query: Column, preset: str, key: str, text: str, vector: str = "embedding") -> DataFrame:
    """``key, score, preview, read``: as many nearest rows as a preset retrieves, with the start of their texts; the first few of them are to be read closely."""
    found, read = PRESETS[preset]
    rows = nearest(df, query, found, key, vector)
    place = F.row_number().over(Window.orderBy(F.desc("cosine"), key))  # of at most 200 rows
    return rows.select(key, "score", preview(F.col(text)).alias("preview"), (place <= read).alias("read"))


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector)).cast("array<float>")


def nearest(df: DataFrame, query: Column, k: int, key: str, vector: str = "embedding", keep: Column | None = None, after: bool = False, overfetch: int = OVERFETCH) -> DataFrame:
    """The ``k`` rows nearest to one query vector, with ``cosine`` and ``score`` (from 0 to 1): a scan that keeps k rows from each task.

    ``keep`` filters rows before the search. With ``after`` the search takes ``overfetch`` times k rows of all and
    filters then, so that a small tenant may get fewer than k.
    """
    scored = df.withColumn("cosine", cosine(F.col(vector), query)).filter("cosine IS NOT NULL").withColumn("score", (1 + F.col("cosine")) / 2)
    order = [F.desc("cosine"), key]
    if keep is None:
        return scored.orderBy(*order).limit(k)
    if after:
        return scored.orderBy(*order).limit(k * overfetch).filter(keep).orderBy(*order).limit(k)
    return scored.filter(keep).orderBy(*order).limit(k)


def nearest_by_fields(df: DataFrame, searches: list[tuple[str, Column, float, int]], key: str, n: int) -> DataFrame:
    """``key, boosted``: searches over several fields (vector column, query, boost, reach) in one scan; each row keeps its highest boosted score.

    Every task keeps what each field's reach allows before anything is shuffled. Ties go to the smaller key.
    """
    each = F.array(*(F.struct(F.lit(at).alias("__at"), cosine(F.col(vector), query).alias("__cosine")) for at, (vector, query, _, _) in enumerate(searches)))
    scored = df.select(key, F.inline(each)).filter("__cosine IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("__at").orderBy(F.desc("__cosine"), key))
    far = scored.withColumn("__place", place).filter(F.col("__place") <= max(reach for *_, reach in searches))
    pick = lambda values: F.array(*map(F.lit, values))[F.col("__at")]
    near = far.filter(F.col("__place") <= pick([reach for *_, reach in searches]))
    boosted = (1 + F.col("__cosine")) / 2 * pick([float(boost) for _, _, boost, _ in searches])
    return near.groupBy(key).agg(F.max(boosted).alias("boosted")).orderBy(F.desc("boosted"), key).limit(n)
