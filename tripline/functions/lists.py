"""Lists, maps, JSON and tolerant parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pairs of categories, and the categories of main meals and desserts.
COMPLEMENTARY = (
    ("pizza", "ice_cream"), ("pizza", "dessert"), ("burger", "ice_cream"), ("burger", "dessert"), ("sushi", "dessert"),
    ("sushi", "cafe"), ("mexican", "dessert"), ("mexican", "cafe"), ("korean", "cafe"), ("korean", "dessert"),
    ("bbq", "dessert"), ("steakhouse", "dessert"), ("breakfast", "cafe"), ("brunch", "cafe"), ("chinese", "dessert"),
    ("italian", "dessert"), ("american", "ice_cream"), ("fast_food", "dessert"),
)
PROGRESSION = (
    ("breakfast", "american"), ("breakfast", "burger"), ("breakfast", "mexican"), ("american", "dessert"),
    ("burger", "cafe"), ("mexican", "ice_cream"),
)
DESSERTS = ("dessert", "ice_cream", "cafe", "bakery")
MAIN_MEALS = ("pizza", "burger", "sushi", "mexican", "korean", "bbq", "steakhouse", "chinese", "italian", "american")


def joined(values: Column, separator: str = "|") -> Column:
    return F.array_join(values, separator)


def member(values: Column, x: Column) -> Column:
    """Whether the list holds x; false for a null list."""
    return F.coalesce(F.array_contains(values, x), F.lit(False))


def place_in(values: Column, x: Column) -> Column:
    """The 1-based place of x in the list; null if it is absent."""
    return F.nullif(F.array_position(values, x), F.lit(0))


def any_mentions(values: Column, *words: str) -> Column:
    """Whether an element of the list contains one of the words, in any case."""
    found = F.coalesce(values, F.array().cast("array<string>"))
    return F.exists(found, lambda x: F.coalesce(F.lower(x).rlike("|".join(r"\Q" + w + r"\E" for w in words)), F.lit(False)))


def service_flags(misc: Column) -> Column:
    """delivery, takeout, dinein, reservations, quick_visit, requires_mask of a map of lists."""

    def group(name: str) -> Column:
        return F.try_element_at(misc, F.lit(name))

    return F.struct(
        any_mentions(group("Service options"), "delivery").alias("delivery"),
        any_mentions(group("Service options"), "take").alias("takeout"),
        any_mentions(group("Service options"), "dine").alias("dinein"),
        any_mentions(group("Planning"), "reservation").alias("reservations"),
        any_mentions(group("Planning"), "quick").alias("quick_visit"),
        any_mentions(group("Health & safety"), "mask").alias("requires_mask"),
    )


def pair_in(a: Column, b: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Whether (a, b) is one of the pairs; false if either is null."""
    return F.coalesce(F.concat_ws("\x1f", a, b).isin([f"{x}\x1f{y}" for x, y in pairs]) & a.isNotNull() & b.isNotNull(), F.lit(False))


def pair_type(a: Column, b: Column) -> Column:
    return F.when(pair_in(a, b, COMPLEMENTARY), "complementary").when(a == b, "similar").otherwise("diverse")


def dessert_follows(a: Column, b: Column) -> Column:
    return F.coalesce(a.isin(*MAIN_MEALS) & b.isin(*DESSERTS), F.lit(False))


def meal_progresses(a: Column, b: Column) -> Column:
    return pair_in(a, b, PROGRESSION)


def loose_bool(c: Column) -> Column:
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin("true", "t", "1", "yes", "y"), True).when(low.isin("false", "f", "0", "no", "n"), False)


def loose_double(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def loose_long(c: Column) -> Column:
    """Through a double, cut towards zero."""
    x = loose_double(c)
    return F.when(~F.isnan(x), x).try_cast("bigint")


def bucket_of(c: Column, size: int = 2**31 - 1) -> Column:
    """A stable bucket of an id."""
    return F.pmod(F.xxhash64(c), F.lit(size)).cast("int")


def hours_map(c: Column) -> Column:
    """A JSON object day -> [open, close] or null; null for bad input."""
    return F.from_json(c, "map<string,array<double>>")


def named(*parts: Column, missing: str = "unknown", separator: str = "→") -> Column:
    """The parts joined, null ones by a word for it."""
    out = [F.coalesce(p.cast("string"), F.lit(missing)) for p in parts]
    return F.concat(*[x for p in out for x in (F.lit(separator), p)][1:])


def flat_text(c: Column, kind: str) -> Column:
    """A nested column as text: lists joined by ', ', structs and maps as JSON, anything else as it is."""
    if kind.startswith("array<") and "<" not in kind[6:]:
        return F.array_join(F.transform(c, lambda x: x.cast("string")), ", ")
    if kind.startswith(("array<", "struct<", "map<")):
        return F.to_json(c)
    return c
