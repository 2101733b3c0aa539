"""Callers: merging call sources, resolving identities, one summary row per client."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import recode
from ..functions.dates import completed_years
from ..functions.missing import any_flag, down, largest, smallest, up
from ..functions.rules import client_household, first_match
from .keyed import attach, first_and_measures, first_per_key, join_on, merge_unmatched

FLAGS = ("veteran", "bipoc", "asked_shelter")
STATUSES = (L.LITERALLY, L.NOT_LITERALLY, L.UNKNOWN)


def classified_calls(
    calls: DataFrame, situations: DataFrame, demographics: DataFrame, variant: str = "v3"
) -> DataFrame:
    """Calls with living situation of the same day and caller attributes, classified.

    Only what can change the outcome is joined: a client-day keeps each kind of
    situation once, and the attributes are reduced to birth date and flag, so the
    joins cannot multiply rows by repeated records.
    """
    vocabulary = "old" if variant == "v2" else "current"
    base = calls.select(
        "household_id", "client_id", "need_date", "need_code", "veteran_status", "name_string"
    )
    kinds = situations.select(
        "client_id",
        "event_date",
        recode.situation_kind("prior_situation").alias("situation"),
        (F.col("fleeing_dv") if variant == "v2" else F.lit(None).cast("string")).alias("fleeing"),
    ).distinct()
    people = demographics.select(
        "client_id",
        "birth_date",
        recode.bipoc(["primary_race", "secondary_race"], "ethnicity", vocabulary).alias("bipoc"),
    ).distinct()
    enriched = join_on(base, kinds, ["client_id", ("need_date", "event_date")])
    enriched = join_on(enriched, people, ["client_id"])
    status = recode.housing_status("need_code", "situation", "fleeing", variant=variant)
    return enriched.select(
        "household_id",
        "client_id",
        F.col("need_date").alias("call_date"),
        "veteran_status",
        "name_string",
        "birth_date",
        status.alias("housed_status"),
        F.coalesce("bipoc", F.lit(0)).alias("bipoc"),
        recode.asks_shelter("need_code").alias("asked_shelter"),
    ).distinct()


def classified_callpoint(callpoint: DataFrame, variant: str = "v3") -> DataFrame:
    """Calls of the second source, which carry their own attributes."""
    vocabulary = "old" if variant == "v2" else "current"
    status = recode.housing_status(
        "call_type", "prior_situation", "fleeing_dv", variant=variant, source="callpoint"
    )
    return callpoint.select(
        "client_id",
        "call_date",
        "veteran_status",
        "name_string",
        "birth_date",
        status.alias("housed_status"),
        recode.bipoc(["primary_race", "secondary_race"], "ethnicity", vocabulary).alias("bipoc"),
    )


def unified_calls(calls: DataFrame, callpoint: DataFrame) -> DataFrame:
    """Both call sources as one set; a call known to both is kept once. ``calls`` are distinct."""
    return merge_unmatched(calls, callpoint, callpoint.columns, distinct=True)


def named_people(calls: DataFrame) -> DataFrame:
    """One row per (name, recorded birth date): filled birth date, client id and own flags.

    A missing birth date takes the latest one known under the same name; the client
    id is the smallest positive id of the name and birth date, else the largest id.
    Calls are aggregated to (name, birth date) first, so the windows run over distinct
    birth dates of a name, whose number is bounded, and never over calls.
    """
    client = F.col("client_id")
    pairs = calls.groupBy("name_string", "birth_date").agg(
        F.min(F.when(client > 0, client)).alias("known_id"),
        F.max(client).alias("last_id"),
        any_flag(recode.is_veteran("veteran_status")).alias("veteran"),
        F.max("bipoc").alias("bipoc"),
        F.max(F.coalesce("asked_shelter", F.lit(0))).alias("asked_shelter"),
    )
    name = Window.partitionBy("name_string")
    person = Window.partitionBy("name_string", "born")
    return (
        pairs.withColumn("born", F.coalesce("birth_date", F.max("birth_date").over(name)))
        .withColumn(
            "client_id",
            F.coalesce(F.min("known_id").over(person), F.max("last_id").over(person)),
        )
        .drop("known_id", "last_id")
    )


def client_flags() -> dict[str, Column]:
    """Flags of a client from those of its (name, birth date) pairs, as aggregates over any rows that hold them all."""
    return {
        "veteran": recode.yes_no(largest("veteran", "propagate")),
        "bipoc": F.max("bipoc"),
        "asked_shelter": F.max("asked_shelter"),
    }


def resolved_people(calls: DataFrame) -> DataFrame:
    """:func:`named_people` with the flags of the whole client in place of the pair's own."""
    people = named_people(calls)
    flags = client_flags()
    known = attach(people, ["client_id"], shared=True, **{f"client_{c}": f for c, f in flags.items()})
    return known.drop(*flags).withColumnsRenamed({f"client_{c}": c for c in flags})


def _called(calls: DataFrame, people: DataFrame) -> DataFrame:
    """Calls under the client and household of their caller, with the caller's flags and age at call."""
    facts = calls.select(
        "household_id", "call_date", "name_string", "birth_date", "housed_status"
    )
    joined = join_on(facts, people, ["name_string", "birth_date"], "inner")
    return joined.select(
        F.coalesce("household_id", client_household("client_id")).alias("household_id"),
        "client_id",
        "call_date",
        "name_string",
        F.col("born").alias("birth_date"),
        "housed_status",
        "bipoc",
        "asked_shelter",
        "veteran",
        completed_years("born", "call_date").alias("age"),
    )


def resolved_calls(calls: DataFrame) -> DataFrame:
    """Calls under their resolved client and household, with client flags and age at call."""
    return _called(calls, resolved_people(calls))


def household_day_status(calls: DataFrame) -> DataFrame:
    """Adds the strongest status any call of the household had on the same day."""
    ranked = attach(
        calls,
        ["household_id", "call_date"],
        day_rank=F.max(recode.status_rank("housed_status")),
    )
    return ranked.withColumn("day_status", recode.status_of_rank("day_rank")).drop("day_rank")


def summary_base(calls: DataFrame, variant: str = "v3") -> DataFrame:
    """One row per client of :func:`resolved_calls`: the call state in its largest household.

    Size counts distinct states per household and status, the ages cover the whole
    household. Ties go to the status (v3 only), then the household, then the rest.
    """
    flags = [F.max(c).alias(c) for c in FLAGS]
    return _base(calls, variant, flags, {c: F.max(c) for c in FLAGS})


def summary_base_of_calls(calls: DataFrame, variant: str = "v3") -> DataFrame:
    """``summary_base(resolved_calls(calls))`` without a pass of its own for the flags of clients.

    A client's flags tell no states apart and decide no ties, so calls carry those of the caller's
    name and birth date, and the client's are aggregated along with the choice of its state.
    """
    flags = [largest("veteran", "propagate").alias("veteran"), *[F.max(c).alias(c) for c in FLAGS[1:]]]
    return _base(_called(calls, named_people(calls)), variant, flags, client_flags())


def _base(calls: DataFrame, variant: str, flags: list[Column], of_client: dict[str, Column]) -> DataFrame:
    state = ["household_id", "client_id", "housed_status", "age"]
    if variant == "v2":
        calls = household_day_status(calls)
        state.append("day_status")
    states = calls.groupBy(*state).agg(*flags)
    status = F.col("housed_status")
    sizes = {f"__{i}": F.count_if(status == label) for i, label in enumerate(STATUSES)}
    sized = attach(
        states, ["household_id"], shared=True, max_age=largest("age"), min_age=smallest("age"), **sizes
    )
    size = first_match([(status == label, F.col(f"__{i}")) for i, label in enumerate(STATUSES)])
    sized = sized.withColumn("household_size", size).drop(*sizes)
    leading = ["household_id", "housed_status"]
    if variant == "v3":
        leading.reverse()
    order = [-F.col("household_size"), *map(F.col, [*leading, *state[3:]])]
    base = first_and_measures(sized, ["client_id"], order, **of_client)
    shelter = F.when(F.col("asked_shelter") == 1, "Yes").otherwise("No")
    return base.withColumn("asked_shelter", shelter)


def single_sheet_base(calls: DataFrame) -> DataFrame:
    """Summary base of the one-sheet report, where the age is supplied.

    Household ages are missing as soon as one member's age is.
    """
    flags = calls.groupBy("client_id").agg(
        recode.yes_no(F.max(recode.asks_shelter("need_code"))).alias("asked_shelter"),
        recode.yes_no(any_flag(recode.is_veteran("veteran_status"))).alias("veteran"),
    )
    states = calls.select("household_id", "client_id", F.col("supplied_age").alias("age")).distinct()
    sized = attach(
        states,
        ["household_id"],
        household_size=F.count(F.lit(1)),
        max_age=largest("age", "propagate"),
        min_age=smallest("age", "propagate"),
    )
    order = [down("household_size"), up("household_id"), up("age")]
    return join_on(first_per_key(sized, ["client_id"], order), flags, ["client_id"])
