"""Round-by-round replay of a dosing policy for all patients at once.

A patient is one row: parameters, regimen array, samples so far and the number of the dose
before which the next sample is taken. A round measures, decides, rewrites the regimen and sets
the next sample, all as expressions on that row, so the guideline and proportional policies need
no shuffle at all: their rounds form one narrow plan. The model-based policy estimates parameters
in every round; its state is written once per round and finished patients are left behind.
"""

import math

from pyspark.sql import functions as F

from .. import constants as C
from ..functions.model import KINETICS, add, let, num, settled, with_parameters, with_rate_constants
from ..operators import dosing, estimation, exposure, policies, regimen, sampling
from ..sources.storage import stage
from ..sources.study import measured, spread

COVARIATES = ("ID", "WT", "CRCL", "DIAL")
STATE = COVARIATES + ("CL",) + KINETICS + ("doses", "dose_num", "active", "samples", "rounds")
ROUNDS = math.ceil(C.HORIZON / C.SHORT_WAIT)  # samples are at least a day apart


def start(courses, early=False):
    """Initial state; patients below the supported renal function stay inactive."""
    number = sampling.first_dose_number("CRCL", early)
    return add(
        spread(courses).select(*COVARIATES, "CL", *KINETICS, "doses"),
        dose_num=f"coalesce({number}, 1)", active=f"({number}) is not null",
        samples="cast(array() as array<struct<time:double,DV:double>>)", rounds="0",
    )


#: Doses that tell on anything up to the sample: states of later ones are not worked out.
BEFORE = "filter(doses, d -> d.time < sample_time)"


def situation(state):
    """Sample time, last dose and interval, and the true exposure states that the regimen has reached by then."""
    now = settled(
        state,
        sample_time=sampling.dose_time("doses", "dose_num"),
        last_amt=sampling.dose_amount("doses", "dose_num"),
        last_frq=sampling.dose_gap("doses", "dose_num"),
    )
    return settled(now, segs=f"if(active, {exposure.dose_segments(BEFORE)}, null)")


def _predicted(time, segs="segs"):
    return exposure.concentration_at(segs, time)


def guideline_step(state, measure=measured):
    """Decide from the trough concentration."""
    now = settled(situation(state), conc=measure(_predicted("sample_time"), "sample_time"))
    decision = policies.guideline_decision("CRCL", "conc", "last_amt", "last_frq")
    return settled(settled(now, d=f"if(active, {decision}, null)"),
                   wait=sampling.next_wait("d.dose_amt = 0"))


def sampled_auc24(measure=measured, step=C.GRID_STEP):
    """Trapezoid AUC of the measured concentrations in the 24 h before the sample.

    Only the few exposure states that reach into the window are searched for each point.
    """
    count = int(C.SHORT_WAIT / step)
    begin = f"(sample_time - {num(C.SHORT_WAIT)})"
    near = (f"filter(segs, (x, i) -> x.s < sample_time "
            f"and coalesce(get(segs, i + 1).s >= {begin}, true))")
    point = let("t", f"{begin} + k * {num(step)}", measure(_predicted("t", "near"), "t"))
    inner = "aggregate(dv, 0.0D, (total, v) -> total + v)"
    points = let("near", near, f"transform(sequence(0, {count}), k -> {point})")
    return let("dv", points, f"({inner} - (dv[0] + dv[{count}]) / 2) * {num(step)}")


def proportional_step(state, measure=measured, target=C.PROPORTIONAL_TARGET):
    """Decide from the trapezoid AUC of the last day."""
    now = settled(situation(state), auc24=f"if(active, {sampled_auc24(measure)}, null)")
    decision = policies.proportional_decision("auc24", "last_amt", "last_frq", target)
    return settled(now, d=f"if(active, {decision}, null)",
                   wait=sampling.next_wait(f"auc24 >= {num(C.AUC_RESAMPLE)}"))


def with_samples(now, measure=measured, peak_trough=False):
    """Append this round's samples; times before the start or already sampled are left out."""
    times = sampling.peak_and_trough("sample_time", "last_frq") if peak_trough else "array(sample_time)"
    fresh = f"filter({times}, t -> t >= 0 and not exists(samples, x -> x.time = t))"
    value = measure(_predicted("t"), "t")
    taken = f"transform({fresh}, t -> named_struct('time', t, 'DV', {value}))"
    return settled(now, samples=f"if(active, concat(samples, {taken}), samples)")


def under_estimate(df, etas=("est.eta1", "est.eta2", "est.eta3")):
    """Add the parameters implied by estimated effects as columns prefixed ``e_``."""
    names = ("CL",) + KINETICS
    aside = df.withColumnsRenamed({n: f"true_{n}" for n in names})
    fitted = with_rate_constants(with_parameters(aside, etas)).drop("COVCL", "COVVC", "VC", "VP", "Q")
    return fitted.withColumnsRenamed({n: f"e_{n}" for n in names}).withColumnsRenamed(
        {f"true_{n}": n for n in names})


def estimated_auc24(now):
    """AUC of the last day under the estimate; half a day is doubled at an early sample. ``e_segs`` are its states."""
    def auc(time):
        return exposure.predict_at("e_segs", time, "e_") + ".AUC"

    last_day = f"{auc('sample_time')} - {auc('(sample_time - 24)')}"
    states = settled(now, e_segs=exposure.dose_segments(BEFORE, "e_"))
    return settled(states, auc24=f"if(sample_time < 24, 2 * {auc('sample_time')}, {last_day})")


ESTIMATES = {"map": estimation.with_map_estimate, "grid": estimation.with_grid_estimate}


def bayes_step(state, measure=measured, early=False, peak_trough=False, gate=True, rounded=True,
               estimate="map"):
    """Estimate, predict the last day, and aim the day before the next sample at target."""
    now = with_samples(situation(state), measure, peak_trough)
    now = estimated_auc24(settled(under_estimate(ESTIMATES[estimate](now))))
    first = "rounds = 0" if early else "false"
    now = add(now, wait=sampling.next_wait(f"{first} or auc24 >= {num(C.AUC_RESAMPLE)}"))
    now = settled(
        now,
        next_time=f"least(sample_time + wait, {num(C.HORIZON)})",
        frq=f"case when {first} then if(CRCL <= {num(C.EARLY_CRCL)}, 24.0D, 12.0D) "
            "when last_amt = 0 then 12.0D else last_frq end",
    )
    search = policies.outside_target("auc24", "last_amt") if gate else "true"
    dose = dosing.target_dose("doses", "sample_time", "next_time", "frq", "e_", rounded, past="e_segs")
    return settled(now, d=f"""case when not active then null
        when {search} then named_struct('dose_amt', {dose}, 'dose_frq', frq)
        else named_struct('dose_amt', last_amt, 'dose_frq', last_frq) end""")


def conclude(now, early=False):
    """Rewrite the regimen, move to the next sample and stop at the last dose."""
    changed = "active and (d.dose_amt != last_amt or d.dose_frq != last_frq)"
    rewrite = regimen.rewritten("doses", "sample_time", "d.dose_amt", "d.dose_frq")
    number = "dose_num + cast(wait / d.dose_frq as int)"
    if early:
        number = f"if(rounds = 0, {sampling.first_dose_number()}, {number})"
    moved = settled(now, doses=f"if({changed}, {rewrite}, doses)",
                    dose_num=f"if(active, {number}, dose_num)")
    return add(moved, rounds="rounds + cast(active as int)",
               active="coalesce(active and dose_num < size(doses), false)").select(*STATE)


def finished(state, rounds):
    """The state, or an error at reading a regimen that the rounds did not finish."""
    left = f"raise_error('a patient is still sampled after {rounds} rounds')"
    return state.withColumn("doses", F.expr(f"if(active, {left}, doses)"))


def replay_simple(courses, step, rounds=ROUNDS):
    """All rounds of a policy without estimation as one narrow plan; unfinished regimens are an error."""
    state = start(courses)
    for _ in range(rounds):
        state = conclude(step(state))
    return finished(state, rounds)


def replay_bayes(courses, rounds=ROUNDS, early=False, **options):
    """Model-based replay; each round works on the patients that are still being sampled.

    Unfinished regimens are an error.
    """
    early = early or options.get("peak_trough", False)
    state = start(courses, early)
    done = state.where("not active")  # never sampled: they keep their regimen
    rounds = rounds + (1 if early else 0)
    for _ in range(rounds):
        after = stage(conclude(bayes_step(state.where("active"), early=early, **options), early), "replay")
        done = done.unionByName(after.where("not active"))
        state = after
        if after.where("active").isEmpty():
            break
    else:
        if not state.where("active").isEmpty():
            raise ValueError(f"patients are still sampled after {rounds} rounds")
    return done
