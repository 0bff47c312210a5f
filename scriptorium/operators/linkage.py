"""Record linkage: persons against an authority database.

Per-side features are computed once before the join. Every pair counts, as scores do not need a shared key, so the
join is a theta join on a threshold: the persons are queries against the whole database. It streams the larger side
past the broadcast smaller one or, beyond a bound, joins blocks of both sides. The costly sequence ratio runs in Python, after pairs have been pruned without loss: pairs whose
score does not depend on it skip it, and of the others those whose best possible score misses the threshold go.

Where the database is small and names, dates, places and descriptions recur (their distinct pairs fit TABLE each), each
factor is scored once for each pair of distinct values, and a person's pairs are sums of table entries: made and ranked in
numpy while the persons pass, so that neither texts are compared nor pairs shuffled (tabled).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions.text import clean_name
from ..session import cut

THRESHOLD, K = 0.3, 5
#: Bytes of all fields of the smaller side in a block, and of a database that is broadcast whole.
BLOCK = 32 << 20
#: Pairs of distinct values of a factor that are scored as a table, and pairs that a task holds at a time.
TABLE, CELLS = 1 << 19, 1 << 20
#: What each factor is read from, and the features and scores that come of it.
FACTORS = {
    "name": (("name",), ("cleaned", "low", "tokens"), ("name_exact", "name_partial", "name_levenshtein", "name_sequence")),
    "date": (("dates",), ("years",), ("date_score",)),
    "place": (("locations",), ("places",), ("location_score",)),
    "context": (("description", "occupations"), ("words", "jobs"), ("context_score",)),
}


def features(persons: DataFrame) -> DataFrame:
    """Cleaned name, its tokens, years, place set and description words of each person."""
    cleaned = clean_name(F.coalesce("name", F.lit("")))
    return persons.withColumns({"cleaned": cleaned}).withColumns(
        {"low": F.lower("cleaned"), "tokens": sim.name_tokens(F.col("cleaned")), "years": sim.years(F.col("dates")), "places": sim.place_set(F.col("locations")), "words": sim.word_set(F.col("description")), "jobs": F.array_distinct(F.transform("occupations", F.lower))}
    )


def _cols(p: DataFrame, tag: str) -> DataFrame:
    return p.select(*[F.col(c).alias(f"{tag}_{c}") for c in p.columns])


def computed(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns as a generator's output: filters on them then use the values instead of a copy of the expressions."""
    return df.select(*df.columns, F.inline(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))


def native_features(pairs: DataFrame) -> DataFrame:
    """All scores but the sequence ratio, for rows with left (a_) and right (b_) features."""
    c = F.col
    return computed(
        pairs,
        name_exact=sim.exact(c("a_low"), c("b_low")),
        name_partial=sim.partial(c("a_tokens"), c("b_tokens")),
        name_levenshtein=sim.edit(c("a_cleaned"), c("b_cleaned")),
        date_score=sim.date_similarity(c("a_years"), c("b_years")),
        location_score=sim.jaccard(c("a_places"), c("b_places")),
        context_score=sim.context(c("a_jobs"), c("b_jobs"), c("a_words"), c("b_words")),
    )


def score(best: Column) -> Column:
    """Match score, given the best name similarity."""
    c = F.col
    return sim.match_score(c("name_exact"), c("name_partial"), best, c("date_score"), c("location_score"), c("context_score"))


def _known() -> Column:
    return F.greatest("name_exact", "name_partial", "name_levenshtein")


def _settled() -> Column:
    return (F.col("name_exact") > 0) | (F.col("name_partial") > 0.5)


def close(pairs: DataFrame, bar: Column, use_sequence: bool = True) -> DataFrame:
    """Pairs of full features whose native scores let them reach the bar."""
    if not use_sequence:
        return computed(native_features(pairs), match_probability=score(_known())).filter(F.col("match_probability") >= bar)
    bound = F.greatest(_known(), sim.sequence_bound(F.col("a_low"), F.col("b_low")))
    # The score grows with the name's while there is one, and without a name it is the mean of the rest.
    most = F.when(_settled(), score(_known())).otherwise(F.greatest(score(bound), score(F.lit(0.0))))
    return computed(native_features(pairs), _most=most).filter(F.col("_most") >= bar - 1e-12)


def with_sequence(pairs: DataFrame, bar: Column) -> DataFrame:
    """Pairs of close() with their scores, those that reach the bar."""
    # One pass over the pairs; for settled ones the function gets nulls, which cost nothing.
    ratio = sim.sequence(F.when(~_settled(), F.col("a_low")), F.when(~_settled(), F.col("b_low")))
    found = pairs.withColumn("_ratio", ratio).withColumn("_seq", F.when(_settled(), 0.0).otherwise(F.col("_ratio"))).withColumn("match_probability", score(F.greatest(_known(), F.col("_seq"))))
    return found.filter(F.col("match_probability") >= bar).drop("_most", "_seq", "_ratio")


def scored(pairs: DataFrame, bar: Column, use_sequence: bool = True) -> DataFrame:
    """Pairs of full features with their scores, those that reach the bar."""
    found = close(pairs, bar, use_sequence)
    return with_sequence(found, bar) if use_sequence else found


def pairs(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD, use_sequence: bool = True) -> DataFrame:
    """Scored pairs of person_idx and db_idx that reach the threshold."""
    found = tabled(left, right, threshold, None, use_sequence) if _bytes(features(right)) <= BLOCK else None
    return compared(left, right, threshold, use_sequence) if found is None else found.drop("rank")


def compared(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD, use_sequence: bool = True) -> DataFrame:
    """pairs() with each pair's features compared."""
    bar = F.lit(threshold)
    found = blocks(_cols(features(left), "a"), _cols(features(right), "b"), lambda x: close(x, bar, use_sequence))
    return with_sequence(found, bar) if use_sequence else found


def _values(side: DataFrame) -> DataFrame:
    """factor, and its distinct values in the columns that a person has them in; the others are null."""
    fields = [c for of, _, _ in FACTORS.values() for c in of]
    rows = [F.struct(F.lit(f).alias("factor"), *[F.when(F.lit(c in of), F.col(c)).alias(c) for c in fields]) for f, (of, _, _) in FACTORS.items()]
    return side.select(F.inline(F.array(*rows))).distinct()


def _numbered(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The distinct values of both sides with their features, at: number in the factor; none if they are too many for tables, or a side is empty."""
    found = cut(_values(left).withColumn("side", F.lit("a")).unionByName(_values(right).withColumn("side", F.lit("b"))))
    size = F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("size")
    n = {(r.side, r.factor): r for r in found.groupBy("side", "factor").agg(F.count("*").alias("n"), size).collect()}
    if len(n) < 2 * len(FACTORS) or any(n["a", f].n * n["b", f].n > TABLE for f in FACTORS) or sum(r["size"] for r in n.values()) > BLOCK:
        return None
    # TABLE bounds what a task sorts.
    order = Window.partitionBy("side", "factor").orderBy(*[c for of, _, _ in FACTORS.values() for c in of])
    known = cut(features(found.withColumn("at", F.row_number().over(order) - 1)))
    return known.filter("side = 'a'").drop("side"), known.filter("side = 'b'").drop("side")


def _coded(side: DataFrame, values: DataFrame) -> DataFrame:
    """The rows with their features, and the numbers of their values as _name and so on."""
    for f, (of, made, _) in FACTORS.items():
        found = values.filter(F.col("factor") == f).select(*[F.col(c).alias(f"_{c}") for c in of], F.col("at").alias(f"_at_{f}"), *made)
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in of]
        side = side.join(F.broadcast(found), same).drop(*[f"_{c}" for c in of])
    return side.withColumnsRenamed({f"_at_{f}": f"_{f}" for f in FACTORS})


def _tables(a: DataFrame, b: DataFrame, use_sequence: bool) -> tuple[list[tuple[np.ndarray, np.ndarray]], dict[str, tuple[int, np.ndarray]]]:
    """Weighted score and weight of each factor by number of left and right value; and for each score its factor and table."""
    cores = a.sparkSession.sparkContext.defaultParallelism
    both = native_features(_cols(a, "a").repartition(cores).join(F.broadcast(_cols(b, "b")), F.col("a_factor") == F.col("b_factor")))
    if use_sequence:
        both = both.withColumn("name_sequence", sim.sequence(F.when(F.col("a_factor") == "name", F.col("a_low")), F.when(F.col("a_factor") == "name", F.col("b_low"))))
    best = F.greatest(_known(), "name_sequence") if use_sequence else _known()
    weighed = sim.factors(F.col("name_exact"), F.col("name_partial"), best, F.col("date_score"), F.col("location_score"), F.col("context_score"))
    pick = lambda k: F.coalesce(*[F.when(F.col("a_factor") == f, x[k]) for f, x in weighed.items()])
    scores = [c for _, _, made in FACTORS.values() for c in made if c in both.columns]
    both = both.withColumns({"_score": pick(0).cast("double"), "_weight": pick(1).cast("double")})
    t = both.select("a_factor", "a_at", "b_at", (F.col("_score") * F.col("_weight")).alias("part"), F.col("_weight").alias("weight"), *[F.col(c).cast("double").alias(c) for c in scores]).toArrow()
    factor, parts, shown = t["a_factor"].to_numpy(), [], {}
    for number, (f, (_, _, made)) in enumerate(FACTORS.items()):
        of = t.filter(pa.array(factor == f))
        i, j = of["a_at"].to_numpy(), of["b_at"].to_numpy()

        def table(c: str, of=of, i=i, j=j) -> np.ndarray:
            out = np.empty((i.max() + 1, j.max() + 1))
            out[i, j] = of[c].to_numpy()  # null: nan
            return out

        parts.append((table("part"), table("weight")))
        shown |= {c: (number, table(c)) for c in made if c in scores}
    return parts, shown


def best_pairs(ids: np.ndarray, records: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]], bar: float, k: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Person, record, rank and score of the pairs that reach the bar, each person's best first, ties in order of records, k at most.

    ids, records: numbers of the values of each factor, a row for each person and each record.
    """
    parts, step = [], max(1, CELLS // len(records))
    for at in range(0, len(ids), step):
        total, weights = np.zeros(()), np.zeros(())
        for (part, weight), i, j in zip(tables, ids[at : at + step].T, records.T, strict=True):
            total, weights = total + part[i][:, j], weights + weight[i][:, j]
        score = np.divide(total, weights, out=np.zeros_like(total), where=weights > 0)
        score[np.isnan(score)] = -np.inf  # a factor that is null leaves no score
        least = np.full(len(score), bar)
        if k is not None and 0 < k < len(records):
            least = np.maximum(least, -np.partition(-score, k - 1, axis=1)[:, k - 1])
        who, record = np.nonzero(score >= least[:, None])
        found = score[who, record]
        order = np.lexsort((record, -found, who))
        who, record, found = who[order], record[order], found[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who) + 1
        keep = slice(None) if k is None else rank <= k
        parts.append((who[keep] + at, record[keep], rank[keep], found[keep]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)


def tabled(left: DataFrame, right: DataFrame, threshold: float, k: int | None, use_sequence: bool = True) -> DataFrame | None:
    """Scored pairs that reach the threshold, and rank: of each person the k best, or all; ties in database order. None if tables do not do.

    For a database that can be broadcast whole. Its records go to all tasks as numbers of values.
    """
    numbered = _numbered(left, right)
    if numbered is None:
        return None
    a, b = numbered
    numbers = [f"_{f}" for f in FACTORS]
    records = cut(_coded(right, b).withColumn("_record", F.row_number().over(Window.orderBy("db_idx")) - 1))
    t = records.select("_record", *numbers).orderBy("_record").toArrow()
    most = t.num_rows if k is None else min(k, t.num_rows)
    if most * int(left.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > CELLS:
        return None  # a batch of persons would have too many matches for one array
    tables, scores = _tables(a, b, use_sequence)
    shared = left.sparkSession.sparkContext.broadcast((np.stack([t[c].to_numpy() for c in numbers], axis=1), tables, scores))

    def judge(name: pa.Array, date: pa.Array, place: pa.Array, context: pa.Array) -> pa.Array:
        of, parts, shown = shared.value
        ids = np.stack([x.to_numpy() for x in (name, date, place, context)], axis=1)
        who, record, rank, score = best_pairs(ids, of, parts, threshold, k)
        columns = {"_record": record.astype(np.int32), "rank": rank.astype(np.int32), "match_probability": score} | {c: x[ids[who, f], of[record, f]] for c, (f, x) in shown.items()}
        ends = np.searchsorted(who, np.arange(len(ids) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x, from_pandas=True) for x in columns.values()], list(columns)))

    kind = ", ".join(["_record: int, rank: int, match_probability: double", *[f"{c}: double" for c in scores]])
    people = _coded(left, a).withColumn("_found", F.arrow_udf(judge, f"array<struct<{kind}>>")(*numbers)).drop(*numbers)
    kept = [F.col(c).alias(f"a_{c}") for c in people.columns if c != "_found"]
    return people.select(*kept, F.inline("_found")).join(F.broadcast(_cols(records.drop(*numbers), "b")), F.col("_record") == F.col("b__record")).drop("_record", "b__record")


def _bytes(side: DataFrame) -> int:
    """Bytes of all fields, as text."""
    return side.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0


def blocks(a: DataFrame, b: DataFrame, then) -> DataFrame:
    """All pairs of a and b that `then` keeps, as every person of a is a query against all of b.

    The smaller side is broadcast up to BLOCK bytes. Beyond that both sides are dealt into blocks of that size, and
    each block meets each block of the other side in an equi-join on the two numbers; one plan, whatever their number.
    """
    size_a, size_b = _bytes(a), _bytes(b)
    n, m = (max(1, -(-size // BLOCK)) for size in (size_a, size_b))
    if min(n, m) == 1:
        return then(F.broadcast(a).join(b, F.lit(True)) if size_a < size_b else a.join(F.broadcast(b), F.lit(True)))
    one = lambda key, k: F.pmod(F.xxhash64(key), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    # Cut first, so that features are computed once and not for each block.
    left = cut(a).withColumn("_row", one("a_person_idx", n)).withColumn("_column", each(m))
    right = cut(b).withColumn("_column", one("b_db_idx", m)).withColumn("_row", each(n))
    return then(left.join(right, ["_row", "_column"])).drop("_row", "_column")


def top(scored: DataFrame, k: int = K) -> DataFrame:
    """The k best matches of each person, ties in database order."""
    w = Window.partitionBy("a_person_idx").orderBy(F.desc("match_probability"), "b_db_idx")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def projected(matches: DataFrame) -> DataFrame:
    """The columns of the match table; where the sequence ratio is not there, it is computed here, for matches only."""
    joined = lambda c: F.concat_ws(", ", c)
    ratio = F.col("name_sequence") if "name_sequence" in matches.columns else sim.sequence(F.col("a_low"), F.col("b_low"))
    return matches.select(
        "match_probability", F.col("b_id").alias("authority_person_id"), F.col("b_name").alias("authority_person_name"), "name_exact", "name_partial", "name_levenshtein",
        ratio.alias("name_sequence"), "date_score", "location_score", "context_score", F.col("b_description").alias("authority_description"),
        joined("b_dates").alias("authority_dates"), joined("b_locations").alias("authority_locations"), joined("b_aliases").alias("authority_aliases"),
        F.col("a_name").alias("spreadsheet_name"), F.col("a_document").alias("spreadsheet_document"), joined("a_dates").alias("spreadsheet_dates"), joined("a_locations").alias("spreadsheet_locations"),
    )


def find_matches(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD, k: int = K) -> DataFrame:
    """The match table of persons against the authority database.

    A database of up to BLOCK bytes is broadcast and every pair scored in one pass, from tables of distinct values where
    they fit; past that, bounds and inverted lists (topk) leave most pairs alone. All give the same rows.
    """
    from . import topk

    if _bytes(features(right)) > BLOCK:
        return projected(topk.matches(left, right, threshold, k))
    found = tabled(left, right, threshold, k)
    return projected(top(compared(left, right, threshold), k) if found is None else found)


def bands(matches: DataFrame) -> DataFrame:
    """How many matches are of high, medium and low confidence."""
    p = F.col("match_probability")
    return matches.agg(F.count_if(p >= 0.7).alias("high"), F.count_if((p >= 0.5) & (p < 0.7)).alias("medium"), F.count_if(p < 0.5).alias("low"))
