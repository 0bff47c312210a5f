r"""Parsing of model responses: strict, repaired, salvaged, failed.

Native by default, with the variant type. ``exact=True`` judges strictness as Python's json module does, in an Arrow
function. The native parser stops after the first value, so a text is read as the first item of a list whose second is
the text's own hash: what stands after a value is an error there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_at_hand

PLAIN = "entities array<struct<text:string,label:string>>"
ENTITIES = "array<struct<entity_idx:int,text:string,label:string>>"
# The shapes that repair and salvage look for.
OBJECT = r'(\{[\s\S]*"entities"[\s\S]*\})'
PAIR = r'"text"\s*:\s*"([^"]+)"\s*,\s*"label"\s*:\s*"([^"]+)"'


def repaired(content: Column) -> Column:
    """The greedy object around "entities", on one line and without trailing commas; empty if there is none."""
    c = F.regexp_extract(content, OBJECT, 1)
    for pattern, new in ((r"[\n\r\t]", " "), (r",\s*\}", "}"), (r",\s*\]", "]")):
        c = F.regexp_replace(c, pattern, new)
    return c


def salvaged(content: Column) -> Column:
    """All text and label pairs in that order; escapes stay as they are."""
    both = F.arrays_zip(F.regexp_extract_all(content, F.lit(PAIR), 1).alias("text"), F.regexp_extract_all(content, F.lit(PAIR), 2).alias("label"))
    return F.transform(both, lambda p, i: F.struct(i.cast("int").alias("entity_idx"), p["text"].alias("text"), p["label"].alias("label"))).cast(ENTITIES)


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _native(df: DataFrame, content: Column, i: str) -> DataFrame:
    """Adds whether it parses, its entities, and how many items are malformed. In steps, so that each is evaluated once.

    A text that a typed reading and writing gives back as it was is what to_json makes of whole entities: it parses, and
    nothing in it is malformed. Only others are taken apart as variants, item by item.
    """
    v, items, good = f"_v{i}", f"_i{i}", f"_g{i}"
    df = df.withColumn(f"_s{i}", strip_at_hand(content))
    s, typed, plain = F.col(f"_s{i}"), F.col(f"_t{i}"), F.col(f"_p{i}")
    # The mode is the default; without an option Spark takes writing after reading for nothing to do.
    df = df.withColumn(f"_t{i}", F.from_json(s, PLAIN, {"mode": "PERMISSIVE"}))
    whole = ~F.exists(typed["entities"], lambda x: x["text"].isNull() | x["label"].isNull())
    df = df.withColumn(f"_p{i}", F.coalesce((F.to_json(typed) == s) & whole, F.lit(False)))
    ok = lambda x: (_kind(x, "$.text") == "STRING") & (_kind(x, "$.label") == "STRING")
    listing = F.concat(F.lit("["), s, F.lit(","), F.xxhash64(s).cast("string"), F.lit("]"))
    df = df.withColumn(v, F.try_parse_json(F.when(~plain & s.rlike(r'^(?:[0-9]|[\{\["0-9tfn-][\s\S]*[\}\]"0-9el])$'), listing)))
    df = df.withColumn(v, F.when(F.try_variant_get(v, "$[1]", "long") == F.xxhash64(s), F.col(v)))
    df = df.withColumn(items, F.try_variant_get(v, "$[0].entities", "array<variant>"))
    made = F.transform(items, lambda x, k: F.when(ok(x), F.struct(k.cast("int").alias("entity_idx"), F.try_variant_get(x, "$.text", "string").alias("text"), F.try_variant_get(x, "$.label", "string").alias("label"))))
    df = df.withColumn(good, F.array_compact(made).cast(ENTITIES))
    listed = F.transform(typed["entities"], lambda x, k: F.struct(k.cast("int").alias("entity_idx"), x["text"].alias("text"), x["label"].alias("label"))).cast(ENTITIES)
    found = F.when(plain, listed).otherwise(F.coalesce(good, F.expr(f"CAST(array() AS {ENTITIES})")))
    return df.withColumns({f"_o{i}": plain | F.col(v).isNotNull(), f"_e{i}": found, f"_m{i}": F.when(plain, 0).otherwise(F.coalesce(F.size(items) - F.size(good), F.lit(0)))})


def _one(text: str | None) -> tuple:
    try:
        value = json.loads((text or "").strip())
    except ValueError:
        return False, [], 0
    items = value.get("entities") if isinstance(value, dict) else None
    items = items if isinstance(items, list) else []
    good = [{"entity_idx": i, "text": e["text"], "label": e["label"]} for i, e in enumerate(items) if isinstance(e, dict) and isinstance(e.get("text"), str) and isinstance(e.get("label"), str)]
    return True, good, len(items) - len(good)


def _loads(column: Column) -> Column:
    """ok, entities, n_malformed as Python's json module sees them."""

    @F.pandas_udf(f"struct<ok:boolean,entities:{ENTITIES},n_malformed:int>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield pd.DataFrame([_one(t) for t in part], columns=["ok", "entities", "n_malformed"])

    return run(column)


def parse(responses: DataFrame, exact: bool = False, strict: bool = False) -> DataFrame:
    """Adds parse_status (strict, repaired, salvaged, failed), entities and n_malformed to rows with raw_response.

    Malformed items go and are counted; with strict, one of them empties the row's entities.
    """
    df = responses.withColumn("_c", F.coalesce("raw_response", F.lit("")))
    tried = {}
    for i, content in (("1", F.col("_c")), ("2", F.when(~F.col("_o1"), repaired(F.col("_c"))))):  # repaired only where strict parsing fails
        if i == "2":
            df = df.withColumn("_r", content)
            content = F.col("_r")
        if exact:
            df = df.withColumn("_x" + i, _loads(content))
            df = df.withColumns({f"_{k}{i}": F.col(f"_x{i}.{f}") for k, f in zip("oem", ("ok", "entities", "n_malformed"), strict=True)})
        else:
            df = _native(df, content, i)
        tried[i] = [F.col(f"_{k}{i}") for k in "oem"]
    one, two = tried["1"], tried["2"]
    df = df.withColumn("_w", F.when(~one[0] & ~two[0] & (F.col("_r") != ""), salvaged(F.col("_c"))))
    status = F.when(one[0], "strict").when(two[0], "repaired").when(F.size("_w") > 0, "salvaged").otherwise("failed")
    df = df.withColumn("parse_status", status)
    pick = lambda i, other: F.when(F.col("parse_status") == "strict", one[i]).when(F.col("parse_status") == "repaired", two[i]).otherwise(other)
    df = df.withColumn("entities", pick(1, F.when(F.col("parse_status") == "salvaged", F.col("_w")).otherwise(F.expr(f"CAST(array() AS {ENTITIES})")))).withColumn("n_malformed", pick(2, F.lit(0)))
    if strict:
        df = df.withColumn("entities", F.when(F.col("n_malformed") == 0, F.col("entities")).otherwise(F.expr(f"CAST(array() AS {ENTITIES})")))
    # As a generator's output: a filter on one of them would else go down to the text and parse it once more.
    return df.select(*responses.columns, F.inline(F.array(F.struct("parse_status", "entities", "n_malformed"))))


def dead_letters(parsed: DataFrame) -> DataFrame:
    """Responses of which nothing could be read."""
    return parsed.filter("parse_status = 'failed'")


def long(parsed: DataFrame) -> DataFrame:
    """One row for each entity: the columns but raw_response and the parser's, and entity_idx, text, label."""
    rest = [c for c in parsed.columns if c not in ("raw_response", "parse_status", "entities", "n_malformed")]
    # Outer, as Spark adds a filter on the array's size below a plain one, which would parse twice.
    return parsed.select(*rest, F.inline_outer("entities")).filter("entity_idx IS NOT NULL")
