"""Dose that brings the exposure before the next sample to target, as Spark SQL text."""

from pyspark.sql import functions as F

from .. import constants as C
from ..functions.model import add, infusion_hours, let, num, settled
from .exposure import dose_segments, predict_at
from .policies import outside_target
from .regimen import new_doses


def _dose_auc(hours, since, prefix):
    """AUC of 1 mg, infused over ``hours``, up to ``since`` hours after its start; 0 before it."""
    def part(weight, exponent):
        return (f"{prefix}{weight} / {hours} * (1 - exp(-{prefix}{exponent} * w.up)) "
                f"* exp(-{prefix}{exponent} * w.down) / {prefix}{exponent}")

    spans = (f"named_struct('up', greatest(least({since}, {hours}), 0.0D), "
             f"'down', greatest({since} - {hours}, 0.0D))")
    return let("w", spans, f"w.up / {hours} / {prefix}CL "
                           f"- {part('wa', 'ka')} - {part('wb', 'kb')}")


def dose_for(need, times, end, prefix="", rounded=True):
    """Dose at each of ``times`` (structs with ``time``) that adds ``need`` to the AUC of the 24 h to ``end``.

    Candidates are the multiples of 250 mg to 5000 mg, each with its own infusion time; exposure rises with dose, so
    the first candidate that reaches the need is the rounded-up solution. The model is linear: doses of one infusion
    time share the AUC of a milligram, and no candidate is tried after the first that reaches the need.
    ``rounded=False`` solves inside the bracket below that candidate: proportionally where the infusion time is fixed
    (to 2000 mg), above by false position (with the Illinois weights) until the AUC is the need as far as doubles
    tell, after ``TRIALS`` points at most.
    """
    step, most, day = num(C.DOSE_STEP), num(C.MAX_DOSE), num(C.SHORT_WAIT)
    count = int(C.MAX_DOSE / C.DOSE_STEP)

    def unit(hours):
        gain = (f"total + {_dose_auc(hours, f'({end} - f.time)', prefix)} "
                f"- {_dose_auc(hours, f'({end} - {day} - f.time)', prefix)}")
        return f"aggregate(times, 0.0D, (total, f) -> {gain})"

    tried = let("amt", f"k * {step}", let("hours", infusion_hours("amt"), let(
        "unit", f"if(hours = o.hours, o.unit, {unit('hours')})",
        "named_struct('hours', hours, 'unit', unit, 'auc', amt * unit, 'amt', if(amt * unit >= need, amt, null))")))
    none = "named_struct('hours', 0.0D, 'unit', 0.0D, 'auc', 0.0D, 'amt', cast(null as double))"
    hit = f"aggregate(sequence(1, {count}), {none}, (o, k) -> if(o.amt is not null, o, {tried}))"
    if rounded:
        pick = f"coalesce({hit}.amt, {most})"
    else:
        pick = let("best", hit, f"if(best.amt is null, {most}, {let('exact', _exact(unit), 'if(exact < 1, 0.0D, exact)')})")
    return let("need", need, let("times", times, f"if(need <= 0, 0.0D, {pick})"))


TRIALS = 30


def _exact(unit):
    """Dose whose AUC is ``need``, in the step below ``best``; ``unit`` gives the AUC of a milligram by infusion time."""
    step = num(C.DOSE_STEP)

    def excess(amt):
        return let("amt", amt, let("hours", infusion_hours("amt"), f"amt * {unit('hours')} - need"))

    low = f"(best.amt - {step})"
    start = (f"named_struct('low', {low}, 'below', {excess(low)}, 'high', best.amt, 'above', best.auc - need, "
             "'side', 0, 'at', best.amt, 'done', best.auc = need)")
    point = "(x.low * x.above - x.high * x.below) / (x.above - x.below)"
    done = f"abs(miss) <= {num(1e-15)} * need or at = x.at"
    moved = f"""if(miss >= 0,
        named_struct('low', x.low, 'below', if(x.side = 1, x.below / 2, x.below), 'high', at, 'above', miss, 'side', 1,
                     'at', at, 'done', {done}),
        named_struct('low', at, 'below', miss, 'high', x.high, 'above', if(x.side = -1, x.above / 2, x.above), 'side', -1,
                     'at', at, 'done', {done}))"""
    trial = let("at", point, let("miss", excess("at"), moved))
    above = f"aggregate(sequence(1, {TRIALS}), {start}, (x, i) -> if(x.done, x, {trial}), x -> x.at)"
    return f"if(best.amt <= 2000, greatest(best.amt - {step}, best.amt * need / best.auc), {above})"


def target_dose(doses, start, end, interval, prefix="", rounded=True, target=C.AUC_TARGET, past=None):
    """Dose from ``start`` on, every ``interval``, whose AUC over the 24 h to ``end`` is ``target``.

    What earlier doses contribute is fixed; ``dose_for`` finds the rest. When the 24 h start before ``start`` there
    is no difference to aim at and the search returns its start value. ``past`` names the ``dose_segments`` of the
    doses before ``start`` where a row has them already.
    """
    day = num(C.SHORT_WAIT)
    past = past or dose_segments(f"filter({doses}, d -> d.time < {start})", prefix)
    history = let("states", past, (
        f"{predict_at('states', end, prefix)}.AUC "
        f"- {predict_at('states', f'({end} - {day})', prefix)}.AUC"))
    times = f"filter({new_doses(start, '0.0D', interval)}, d -> d.time < {end})"
    found = dose_for(f"{num(target)} - ({history})", times, end, prefix, rounded)
    return f"if({end} - {day} < {start}, {num(C.START_DOSE)}, {found})"


def history_doses(states, interval, target=C.AUC_TARGET):
    """Dose for every sample of any history: (ID, key, auc24, wait, dose_amt).

    ``states`` has two rows a sample, as ``estimation.states_under`` gives them: at its time (``what`` 0) and a day before
    (1), with the sample's ``time``, ``last_amt`` and the rate constants under its estimate. The AUC that earlier
    doses still bring follows from the state in which each has run to its end: at least a day passes before the
    window ends, longer than any infusion lasts. ``interval`` is SQL text for the hours between new doses.
    """
    day, far = num(C.SHORT_WAIT), num(C.LONG_WAIT)
    auc = "given / CL - a / ka - b / kb"
    now = F.expr("what = 0")
    fields = ("CL", "ka", "kb", "wa", "wb", "va", "vb", "due", "time", "last_amt", "CRCL")
    rows = add(states, auc=auc).groupBy("ID", "key").agg(
        F.max(F.when(now, F.col("auc"))).alias("auc"), F.max(F.when(~now, F.col("auc"))).alias("auc_before"),
        *[F.max(F.when(now, F.col(name))).alias(name) for name in fields])
    rows = settled(rows, auc24=f"if(time < {day}, 2 * auc, auc - auc_before)")
    rows = settled(rows, wait=f"if(auc24 >= {num(C.AUC_RESAMPLE)}, {day}, {far})")

    def later(hours):
        return f"(due / CL - va * exp(-ka * ({hours})) / ka - vb * exp(-kb * ({hours})) / kb)"

    brought = f"{later('wait')} - if(wait = {day}, auc, {later(f'wait - {day}')})"
    times = f"transform(sequence(0, cast(ceil(wait / {interval}) as int) - 1), j -> named_struct('time', j * {interval}))"
    dose = dose_for(f"{num(target)} - ({brought})", times, "wait")
    search = outside_target("auc24", "last_amt")
    return add(rows, dose_amt=f"if({search}, {dose}, last_amt)").select("ID", "key", "time", "auc24", "wait", "dose_amt")
