"""Annotators: prompts in, raw responses out.

A model server's answers are dear and not repeatable, so its result is to be written once before anything branches
off it. The rule annotator is the offline stand-in; it is made of native expressions and answers in JSON text.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETRY_CHARS = 2000
# Labels of the extraction task.
LABELS = ("DATE", "PERSON", "ORG", "PLACE", "SHIP", "GROUP", "INDICATION_OF_SLAVERY", "RELATIONSHIPS")
RULES = {
    "alpha": (("PERSON", "[A-Z][a-z]+ [A-Z][a-z]+"), ("DATE", "[0-9]{4}"), ("PLACE", "[A-Z][a-z]{3,}")),
    "beta": (("PERSON", "[A-Z][a-z]{2,} [A-Z][a-z]{2,}"), ("DATE", "[0-9]{4}"), ("PLACE", "[A-Z][a-z]{4,}")),
    "gold": (("PERSON", "[A-Z][a-z]+ [A-Z][a-z]+"), ("DATE", "[0-9]{4}"), ("PLACE", "[A-Z][a-z]{3,5}")),
}


@dataclass(frozen=True)
class RuleAnnotator:
    """Finds entities by patterns; rules come in order, matches of a rule in text order."""

    model: str = "alpha"
    rules: dict = field(default_factory=lambda: RULES)

    def annotate(self, chunks: DataFrame) -> DataFrame:
        """Adds model, raw_response, status, attempts."""

        def one(label: str, pattern: str):
            return F.transform(F.regexp_extract_all("chunk", F.lit(f"({pattern})"), 1), lambda m: F.struct(m.alias("text"), F.lit(label).alias("label")))

        found = F.concat(*[one(*rule) for rule in self.rules[self.model]])
        df = chunks.withColumn("_e", found)
        body = F.to_json(F.struct(F.col("_e").alias("entities")))
        return df.select(*chunks.columns, F.lit(self.model).alias("model"), body.alias("raw_response"), F.lit("ok").alias("status"), F.lit(1).alias("attempts"))


@dataclass(frozen=True)
class HttpAnnotator:
    """Sends prompts to a chat-completions server, one after the other in each partition.

    A failure that says "prediction-error" on a prompt of more than 2000 characters is tried once more with its
    first 2000; any other failure gives an empty response. Cap the load with repartition() before annotate().
    """

    model: str
    url: str = "http://127.0.0.1:1234/v1/chat/completions"
    timeout: float = 600.0
    temperature: float = 0.1

    def ask(self, prompt: str) -> str | None:
        """One request."""
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": self.temperature}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:  # noqa: S310
                return json.load(reply)["choices"][0]["message"]["content"]
        except urllib.error.HTTPError as e:
            raise RuntimeError(e.read().decode(errors="replace")) from e

    def answer(self, prompt: str) -> tuple[str | None, str, int]:
        """Response, status and number of attempts."""
        try:
            return self.ask(prompt), "ok", 1
        except Exception as e:  # noqa: BLE001  one bad document must not end the job
            if "prediction-error" not in str(e) or len(prompt) <= RETRY_CHARS:
                return None, "error", 1
        try:
            return self.ask(prompt[:RETRY_CHARS]), "ok", 2
        except Exception:  # noqa: BLE001
            return None, "error", 2

    def annotate(self, chunks: DataFrame) -> DataFrame:
        """Adds model, raw_response, status, attempts to rows with a prompt."""
        names = chunks.columns
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in chunks.schema)}, model string, raw_response string, status string, attempts int"
        at = names.index("prompt")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                got = [self.answer(p or "") for p in batch.column(at).to_pylist()]
                text, status, n = zip(*got, strict=True)
                new = [pa.array([self.model] * len(got)), pa.array(text, pa.string()), pa.array(status), pa.array(n, pa.int32())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*names, "model", "raw_response", "status", "attempts"])

        return chunks.mapInArrow(run, schema)


def fan_out(chunks: DataFrame, annotators: list) -> DataFrame:
    """The same prompts to several models. Each reads the chunks anew, so that a slow server holds up its own branch only."""
    return reduce(DataFrame.unionByName, [a.annotate(chunks) for a in annotators])


def flag_labels(entities: DataFrame, known: tuple[str, ...] = LABELS) -> DataFrame:
    """Adds label_known; labels are open, as models return what they like."""
    return entities.withColumn("label_known", F.col("label").isin(*known))
