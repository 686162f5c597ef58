"""The study tables, derived from the driver's star-schema tables by integer arithmetic."""

import math

from pyspark.sql import functions as F

from .. import constants as C
from .. import schema
from ..functions.model import add, num, observed, with_parameters, with_rate_constants
from ..operators.events import schedule
from .storage import read_table

# Multiplier and offset of each noise column; the modulus is shared.
ETA_KEYS = ((7919, 13), (104729, 17), (1299709, 29))
EPS_KEYS = ((15485863, 31), (32452843, 37))

SORTED_PATIENTS = 1024  # patients of a task that sorts their grid rows
SALTS = 16  # parts of one user's rows in a join by user
ORDERS_START = "timestamp_ntz '1995-01-01'"


def _unit(key, factor, offset):
    """Reproducible noise in [-2, 2]."""
    return f"((({key}) * {factor}L + {offset}) % 2001 - 1000) / 500.0D"


def cohort(spark, folder, apart=False, most=None):
    """One patient per customer: four renal groups, fixed weight, reproducible random effects.

    With ``apart`` patients are spread over all tasks (see ``spread``) while they are a number each.
    """
    etas = [
        f"{num(math.sqrt(omega))} * ({_unit('(ID - 1)', *pq)}) as ETA{i}"
        for i, (omega, pq) in enumerate(zip(C.OMEGA, ETA_KEYS), start=1)
    ]
    patients = read_table(spark, f"{folder}/customer.parquet", schema.CUSTOMER).selectExpr("c_custkey + 1 as ID")
    return (spread(patients, most=most) if apart else patients).selectExpr(
        "ID", "75.0D as WT",
        "get(array(100.0D, 75.0D, 50.0D, 25.0D), cast((ID - 1) % 4 as int)) as CRCL",
        "0 as DIAL", *etas)


def spread(patients, key="ID", most=None):
    """Spread the narrow patient rows over all tasks before they are expanded to profiles.

    With ``most``, a task gets no more than about as many patients, so that what it sorts stays in its memory.
    """
    slots = int(patients.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if most is not None:
        slots = max(slots, -(-patients.count() // most))
    return patients.repartition(slots, key)


def noise(patient, time):
    """SQL text for the two residual draws of a patient at a grid time."""
    key = f"{patient} * 1009 + cast({time} * 4 as bigint)"
    return tuple(f"({_unit(key, *pq)})" for pq in EPS_KEYS)


def measured(ipre, time, patient="ID"):
    """SQL text for the concentration that a sample at ``time`` would show."""
    return observed(ipre, *noise(patient, time))


def courses(spark, folder, loading="standard", apart=False, most=None):
    """One row per patient with parameters and the induction regimen; ``apart`` as in ``cohort``."""
    patients = with_rate_constants(with_parameters(cohort(spark, folder, apart, most)))
    return add(patients, doses=schedule(loading))


def _hours(later, earlier):
    """SQL text for the hours between two timestamps, whatever the session's time zone."""
    return f"cast(cast({later} - {earlier} as interval second) as decimal(20, 6)) / 3600.0D"


def user_samples(spark, folder):
    """Observation series per user: hours since the user's first event and the value.

    The first event is found by partial minima and handed back to a user's rows in ``SALTS`` parts,
    so that a user with many events is not one task's work.
    """
    table = read_table(spark, f"{folder}/events.parquet").selectExpr(
        "user_id as ID", "event_id", "ts", "event_type", "value", f"pmod(event_id, {SALTS}) as _part")
    start = table.groupBy("ID").agg(F.min("ts").alias("_first"))
    start = add(start, _part=f"explode(sequence(0L, {SALTS - 1}L))")
    return table.join(start, ["ID", "_part"]).selectExpr(
        "ID", "event_id", "event_type", f"{_hours('ts', '_first')} as time", "value as DV")


def order_doses(spark, folder):
    """Dose-like events per customer: hours since 1995 and an amount in steps of 250 mg."""
    return read_table(spark, f"{folder}/orders.parquet").selectExpr(
        "o_custkey as ID", "o_orderkey as dose_id",
        f"{_hours('o_orderdate', ORDERS_START)} as time",
        "(o_orderkey % 8 + 1) * 250.0D as amt")


def histories(spark, folder):
    """Long tables of one time axis: doses (ID, time, amt) of orders and samples (ID, time, key, DV) of events.

    A user's month of samples is stretched over the years of the orders.
    """
    given = order_doses(spark, folder).selectExpr("ID + 1 as ID", "time", "amt")
    seen = user_samples(spark, folder).selectExpr("ID + 1 as ID", "time * 80 as time", "event_id as key", "DV")
    return given, seen
