"""People of an authority database: items of nested JSON to flat persons, with Spark's variant type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, tokens

# Words that show that a label is no person's name, a place or an occupation.
NOT_NAMES = ("vocabulary", "service", "labor", "trade", "person", "community", "document", "occupation", "type")
PLACE_HINTS = ("county", "parish", "plantation", "estate", "town", "city", "village", "island", "river", "port", "district", "province")
JOBS = ("work", "labor", "servant", "field", "house", "cook", "driver", "carpenter", "blacksmith", "weaver", "seamstress", "nurse")
NAME = r"^[A-Z][a-zA-Z\s'-]+[a-zA-Z]$"
PERSON = "id string, name string, description string, aliases array<string>, dates array<string>, locations array<string>, occupations array<string>"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def is_person_name(name: Column) -> Column:
    """At least two words, letters only, and none of the words that show another kind of item."""
    return (F.size(tokens(name)) >= 2) & name.rlike(NAME) & ~_any(F.lower(name), NOT_NAMES)


def looks_like_date(value: Column) -> Column:
    """Four digits in a row."""
    return value.rlike(r"(?U)\d{4}")


def looks_like_place(value: Column) -> Column:
    """At most four words, with a capital first or a place word; null for an empty text."""
    hit = (F.size(tokens(value)) <= 4) & (value.rlike(r"^\p{Lu}") | _any(F.lower(value), PLACE_HINTS))
    return F.when(F.length(value) > 0, hit)


def looks_like_job(value: Column) -> Column:
    """Contains an occupation word."""
    return _any(F.lower(value), JOBS)


def kind(value: Column) -> Column:
    """date, place or job of a claim's text; null for none and for an empty text."""
    return F.when(F.length(value) == 0, None).when(looks_like_date(value), "date").when(looks_like_place(value), "place").when(looks_like_job(value), "job")


def _get(v: Column, path: str, to: str = "string") -> Column:
    return F.try_variant_get(v, path, to)


def _text(v: Column, path: str) -> Column:
    """A string at a path; null if it is of another type."""
    found = _get(v, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", _get(v, path))


def persons(items: DataFrame, strict: bool = False) -> DataFrame:
    """db_idx and PERSON columns of items (db_idx, item variant) that are people with an English label.

    Texts of claims are dates, else places, else jobs; time values are dates; qualifiers give places. Empty maps
    written as [] count as empty; with strict, such items go.
    """
    # As a generator's output: the filter would else go down to the items' source and parse each of them once more, and
    # below a repartition by which they were dealt out.
    name = F.inline(F.array(F.struct(_text(F.col("item"), "$.labels.en.value").alias("name"))))
    base = items.select(*items.columns, name).filter(is_person_name(F.col("name")))
    if strict:
        maps = [F.schema_of_variant(_get(F.col("item"), f"$.{k}", "variant")) for k in ("descriptions", "aliases", "claims")]
        bad = [F.coalesce(m.startswith("ARRAY"), F.lit(False)) for m in maps]
        base = base.filter(~(bad[0] | bad[1] | bad[2]))
    aliases = F.filter(F.transform(_get(F.col("item"), "$.aliases.en", "array<variant>"), lambda a: _text(a, "$.value")), lambda a: a.isNotNull())
    claims = F.map_entries(_get(F.col("item"), "$.claims", "map<string,variant>"))
    flat = F.flatten(F.transform(claims, lambda e: F.coalesce(_get(e["value"], "$", "array<variant>"), F.array().cast("array<variant>"))))

    def fields(c: Column) -> Column:
        """What a claim says, read out of the variant once: its type, text and time, and its qualifiers' texts."""
        value = "$.mainsnak.datavalue.value"
        said = F.flatten(F.transform(F.map_entries(_get(c, "$.qualifiers", "map<string,variant>")), lambda q: F.coalesce(_get(q["value"], "$", "array<variant>"), F.array().cast("array<variant>"))))
        texts = F.transform(said, lambda q: F.when(_get(q, "$.datavalue.type") == "string", _text(q, "$.datavalue.value")))
        return F.struct(_get(c, "$.mainsnak.datavalue.type").alias("type"), _text(c, value).alias("text"), _text(c, f"{value}.time").alias("time"), F.coalesce(texts, F.array().cast("array<string>")).alias("qualifiers"))

    def values(c: Column) -> Column:
        """The claim's texts with their kinds, in order: its own, then its qualifiers' places. An empty text drops the claim."""
        own, time = F.when(c["type"] == "string", c["text"]), F.when(c["type"] == "time", c["time"])
        first = F.array(F.struct(F.when(time.isNotNull(), "date").otherwise(kind(own)).alias("kind"), F.coalesce(time, own).alias("value")))
        more = F.transform(c["qualifiers"], lambda q: F.struct(F.when(looks_like_place(q), "place").alias("kind"), q.alias("value")))
        return F.when(F.length(own) == 0, F.array().cast("array<struct<kind:string,value:string>>")).otherwise(F.concat(first, more))

    found = F.coalesce(F.flatten(F.transform(F.transform(flat, fields), values)), F.array().cast("array<struct<kind:string,value:string>>"))
    base = base.select("*", F.inline(F.array(F.struct(found.alias("_found")))))  # read three times, made once
    of = lambda k: F.transform(F.filter("_found", lambda x: (x["kind"] == k) & x["value"].isNotNull()), lambda x: x["value"])
    empty = F.array().cast("array<string>")
    return base.select(
        "db_idx", F.coalesce(_text(F.col("item"), "$.id"), F.lit("")).alias("id"), "name", F.coalesce(_text(F.col("item"), "$.descriptions.en.value"), F.lit("")).alias("description"),
        F.coalesce(aliases, empty).alias("aliases"), of("date").alias("dates"), of("place").alias("locations"), of("job").alias("occupations"),
    )


def spreadsheet_persons(sheet: DataFrame) -> DataFrame:
    """person_idx and PERSON columns plus document, of rows with a non-blank PERSON; dates and places of the same row."""
    cell = lambda c: F.when(F.length(collapse(F.col(c))) > 0, F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))
    here = lambda c: F.array_compact(F.array(cell(c))) if c in sheet.columns else F.array().cast("array<string>")
    name = F.regexp_replace("PERSON", r"(?U)^\s+|\s+$", "")
    return sheet.filter(F.length(name) > 0).select(
        F.col("row_idx").alias("person_idx"), name.alias("name"), F.coalesce("Document", F.lit("")).alias("document"), F.concat(F.lit("Found in document: "), F.coalesce("Document", F.lit(""))).alias("description"),
        here("DATE").alias("dates"), here("PLACE").alias("locations"), F.array().cast("array<string>").alias("occupations"),
    )
