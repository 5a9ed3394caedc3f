"""Case assembly: four raw tables to one row per case.

Each raw table carries ``primaryid``, ``quarter`` and (but for outcomes)
``row_order``, the position of a row in its source (of any type that sorts). Cases repeated in
several quarters do not mix: every roll-up is by quarter and case.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.config import QUARTERS, SERIOUS_OUTCOMES, VALUE_SEPARATOR
from caseloom.functions.numbers import to_number
from caseloom.operators.ranking import sample_exact

CASE = ["quarter", "primaryid"]
DRUG_TEXT = ["drugname", "route", "prod_ai"]
FIRST_DRUG = ["dose_amt", "dose_freq", "dur", "dechal", "rechal"]
# Groups that cases are hashed into to count their rows; the most rows of a group whose cases are listed without a fold; the most groups
# beyond that which a plan names.
CROWD_GROUPS, CROWD_ROWS, MOST_CROWDS = 1 << 18, 10_000, 1_000


@dataclass(frozen=True)
class CaseTables:
    """Raw tables; one that no quarter delivers is None.

    ``labelled`` names the quarters that came with outcomes (None: all of them).
    """

    demo: DataFrame
    drug: DataFrame | None = None
    reac: DataFrame | None = None
    outc: DataFrame | None = None
    labelled: Sequence[str] | None = None


def usable(table: DataFrame | None) -> bool:
    """A table takes part when it is there and has the case key; schema only, no job."""
    return table is not None and "primaryid" in table.columns


def serious_outcome(code: Column) -> Column:
    return F.coalesce(code.isin(SERIOUS_OUTCOMES), F.lit(False)).cast("int")


def _sorted_by(keys: Sequence[str]) -> list[str]:
    """The keys, the last one first: a sort tells rows apart by eight bytes of its first column, and cases differ sooner than quarters."""
    return list(reversed(keys))


def _keyed(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    return table.where(" and ".join(f"{k} is not null" for k in keys))


def _crowd(keys: Sequence[str]) -> Column:
    """The group of a case, the same in all quarters."""
    return F.pmod(F.xxhash64(keys[-1]), F.lit(CROWD_GROUPS))


def crowds(tables: CaseTables, keys: Sequence[str] = CASE) -> list[int] | None:
    """Groups of cases with many drugs and reactions, for ``assemble``; None if they are too many to name.

    One job that reads the keys and moves a count per group; a case of many rows
    makes its group a large one, so none is missed.
    """
    found = [_keyed(table, keys).select(_crowd(keys).alias("crowd")) for table in (tables.drug, tables.reac) if usable(table)]
    if not found:
        return []
    large = union_quarters(found).groupBy("crowd").count().where(F.col("count") > CROWD_ROWS)
    named = [row["crowd"] for row in large.limit(MOST_CROWDS + 1).collect()]
    return named if len(named) <= MOST_CROWDS else None


def _folded(table: DataFrame, columns: Sequence[str], keys: Sequence[str], carried: dict[str, Column] | None = None,
            folds: dict[str, Column] | None = None, crowded: Sequence[int] | None = None) -> tuple[DataFrame, list[str]]:
    """One row per key with ``seen``, its distinct combinations of the columns by their ``first`` position, and
    ``plain``: whether none lacks a position or shares it.

    Repeats are folded to (combination, first position) before and in the first
    shuffle, which spreads by combination too, so a key that holds a large share
    of the rows is split and only its distinct combinations meet in one row.
    ``folds`` aggregate the ``carried`` columns, twice, so each must fold its own
    results. If ``crowded`` names the groups of ``crowds``, only they are folded
    so; other keys have few rows, which move once and are listed as they are.
    """
    present = [c for c in columns if c in table.columns]
    folds = folds or {}
    texts = [F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(present)]
    names = [f"_{i}" for i in range(len(present))]
    rows = _keyed(table, keys).select(*keys, "row_order", *texts, *[column.alias(name) for name, column in (carried or {}).items()])

    def combined(rows: DataFrame) -> DataFrame:
        return (rows.groupBy(*_sorted_by(keys), *names)
                .agg(F.min("row_order").alias("first"), *[fold.alias(name) for name, fold in folds.items()]))

    if crowded is None:
        firsts = combined(rows)
    else:
        firsts = rows.where(~_crowd(keys).isin(list(crowded))) if crowded else rows
        firsts = firsts.select(*_sorted_by(keys), *names, F.col("row_order").alias("first"), *folds)
        if crowded:
            firsts = firsts.unionByName(combined(rows.where(_crowd(keys).isin(list(crowded)))))
    # A window sorts a key's combinations together; collecting them by an aggregation would move its lists about.
    each = Window.partitionBy(*_sorted_by(keys)).orderBy("first")
    whole = each.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = firsts.select(*keys, F.collect_list(F.struct("first", *names)).over(whole).alias("seen"),
                           *[fold.over(whole).alias(name) for name, fold in folds.items()],
                           F.row_number().over(each).alias("_rank"), F.dense_rank().over(each).alias("_places"))
    # The last row tells whether every combination has a position of its own.
    plain = (F.col("_places") == F.col("_rank")) & F.col("seen")[0]["first"].isNotNull()
    return listed.where(F.col("_rank") == F.size("seen")).withColumn("plain", plain).drop("_rank", "_places"), present


def _values(i: int) -> Column:
    """Distinct values of a column by first position, then value; those without any position come first. Null may be among them."""
    def ordered(seen: Column) -> Column:
        own = F.arrays_zip(seen["first"].alias("first"), seen[f"_{i}"].alias("value"))
        return F.array_distinct(F.sort_array(own)["value"])

    placed = ordered(F.filter("seen", lambda x: x["first"].isNotNull()))
    nowhere = ordered(F.filter("seen", lambda x: x["first"].isNull()))
    # Combinations without a position are rare.
    whole = F.size(F.array_compact("seen.first")) == F.size("seen")
    mixed = F.when(whole, ordered(F.col("seen"))).otherwise(F.concat(F.array_except(nowhere, placed), placed))
    return F.when(F.col("plain"), F.array_distinct(F.col(f"seen._{i}"))).otherwise(mixed)


def _joined(i: int) -> Column:
    """``_values`` as text, without nulls, which a join of texts skips."""
    return F.array_join(_values(i), VALUE_SEPARATOR)


def distinct_values(table: DataFrame, columns: Sequence[str], keys: Sequence[str] = CASE) -> DataFrame:
    """Per key and column, the distinct non-null values in order of first appearance."""
    seen, present = _folded(table, columns, keys)
    return seen.select(*keys, *[F.array_compact(_values(i)).alias(c) for i, c in enumerate(present)])


def drug_summary(drug: DataFrame, keys: Sequence[str] = CASE, texts: Sequence[str] = DRUG_TEXT,
                 crowded: Sequence[int] | None = None) -> DataFrame:
    """``joined_values`` of the drug texts and ``first_drug`` in one pass over the table."""
    text = [c for c in texts if c in drug.columns]
    if not text:
        return first_drug(drug, keys)
    taken = [c for c in FIRST_DRUG if c in drug.columns]
    carried, folds = {"dosing": F.struct("row_order", *taken)}, {"dosing": F.min("dosing")}
    if "drug_seq" in drug.columns:
        carried["drug_seq"] = to_number(drug, "drug_seq")
        folds["drug_seq"] = F.max("drug_seq")
    seen, present = _folded(drug, text, keys, carried, folds, crowded)
    return seen.select(*keys, *[_joined(i).alias(c) for i, c in enumerate(present)],
                       *(["drug_seq"] if "drug_seq" in carried else []), *[f"dosing.{c}" for c in taken])


def joined_values(table: DataFrame, columns: Sequence[str], keys: Sequence[str] = CASE, crowded: Sequence[int] | None = None) -> DataFrame:
    """``distinct_values`` as text; a key whose values are all null gives ''."""
    seen, present = _folded(table, columns, keys, crowded=crowded)
    return seen.select(*keys, *[_joined(i).alias(c) for i, c in enumerate(present)])


def first_drug(drug: DataFrame, keys: Sequence[str] = CASE) -> DataFrame:
    """Number of drugs and the dosing of the first one.

    Rows that tie on the position are ordered by their values, so the result
    does not depend on how rows are spread.
    """
    taken = [c for c in FIRST_DRUG if c in drug.columns]
    sizes = [F.max(to_number(drug, "drug_seq")).alias("drug_seq")] if "drug_seq" in drug.columns else []
    first = F.min(F.struct("row_order", *taken)).alias("first")
    return (_keyed(drug, keys)
            .groupBy(*_sorted_by(keys)).agg(*sizes, first)
            .select(*keys, *(["drug_seq"] if sizes else []), *[f"first.{c}" for c in taken]))


def serious_flag(outc: DataFrame, keys: Sequence[str] = CASE) -> DataFrame:
    return (_keyed(outc, keys)
            .groupBy(*_sorted_by(keys)).agg(F.max(serious_outcome(F.col("outc_cod"))).alias("serious"))
            .select(*keys, "serious"))


def keep_first(rows: DataFrame, quarters: Sequence[str] = QUARTERS, key: str = "primaryid") -> DataFrame:
    """The first row per key by quarter, then position; null keys count as one key.

    Catalyst limits each group to one row before the shuffle too, so a hot key
    costs one row per input partition.
    """
    rank = F.array_position(F.array(*[F.lit(q) for q in quarters]), F.col("quarter"))
    # Quarters outside the list come last, in their own order.
    order = [F.when(rank > 0, rank).otherwise(F.lit(len(quarters) + 1)), F.col("quarter"), F.col("row_order")]
    window = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def assemble(tables: CaseTables, quarters: Sequence[str] = QUARTERS, one_per_case: bool = True,
             sample_size: int | None = None, columns: Sequence[str] | None = None, crowded: Sequence[int] | None = None) -> DataFrame:
    """Demographics with drugs, reactions and the serious flag, one row per case.

    Roll-ups have one row per quarter and case, so dropping repeated
    demographics before the joins gives what dropping them after would, and the
    joins see no hot key. For the same reason a sample is taken before them.
    ``columns`` are those of the case table that a job reads (None: all); what
    only the others need is not rolled up.
    """
    def wanted(*names: str) -> bool:
        return columns is None or not set(names).isdisjoint(columns)

    def with_part(cases: DataFrame, part: DataFrame) -> DataFrame:
        joined = cases.join(part, _sorted_by(CASE), "left")
        return joined.select(*CASE, *[c for c in joined.columns if c not in CASE])

    cases = keep_first(tables.demo, quarters) if one_per_case else tables.demo
    cases = cases.drop("row_order")
    if sample_size:
        cases = sample_exact(cases, sample_size)
    if usable(tables.drug) and wanted(*DRUG_TEXT, *FIRST_DRUG, "drug_seq"):
        cases = with_part(cases, drug_summary(tables.drug, texts=[c for c in DRUG_TEXT if wanted(c)], crowded=crowded))
    if usable(tables.reac) and wanted("reactions"):
        reactions = tables.reac.withColumnRenamed("pt", "reactions")
        cases = with_part(cases, joined_values(reactions, ["reactions"], crowded=crowded))
    if usable(tables.outc) and wanted("serious"):
        cases = with_part(cases, serious_flag(tables.outc))
        known = F.coalesce("serious", F.lit(0))
        if tables.labelled is not None:
            known = F.when(F.col("quarter").isin(list(tables.labelled)), known)
        cases = cases.withColumn("serious", known.cast("int"))
    return cases if columns is None else cases.select(*[c for c in cases.columns if c in columns])


def preview_cases(tables: CaseTables, n: int = 5, quarters: Sequence[str] = QUARTERS) -> DataFrame:
    """The first n cases by key, assembled. Keys are taken first, so the tables are cut to n cases before the roll-ups."""
    demo = keep_first(tables.demo, quarters).orderBy("primaryid").limit(n)
    # n rows.
    keys = F.broadcast(demo.select(*CASE))

    def cut(table: DataFrame | None) -> DataFrame | None:
        return table.join(keys, CASE, "left_semi") if usable(table) else table

    return assemble(CaseTables(demo, cut(tables.drug), cut(tables.reac), cut(tables.outc), tables.labelled), quarters)


def union_quarters(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all quarters by column name; columns a quarter lacks are null."""
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part, allowMissingColumns=True)
    return combined
