"""The registered queries: every operator run over the whole driver tables.

Each function takes ``(spark, folder)`` and returns a DataFrame. Computed numbers are rounded so
that they can be compared between engines.
"""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import constants as C
from .. import schema
from ..functions import body, model
from ..functions.model import add, num, settled
from ..operators import (
    asof,
    dosing,
    draws,
    estimation,
    evaluation,
    events,
    exposure,
    histories,
    policies,
    quantiles,
    regimen,
    sampling,
)
from ..sources import storage, study
from . import replay, report

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df, **digits):
    kinds = dict(df.dtypes)
    return add(df, **{name: model.rounded(name, n) if kinds[name] == "double" else f"round({name}, {n})"
                      for name, n in digits.items()})


# ---- shared inputs ----


def doses(spark, folder, loading="standard"):
    return events.dose_rows(study.courses(spark, folder, loading), "ID", "CRCL")


def induction_grid(spark, folder, most=None):
    """Full event table of the induction: 673 grid rows per patient with the doses upserted."""
    courses = study.courses(spark, folder)
    grid = events.event_grid(study.spread(courses.select("ID", "CRCL"), most=most))
    return events.upsert_doses(grid, events.dose_rows(courses, "ID"))


def induction_profile(spark, folder, *keep, step=C.GRID_STEP):
    courses = study.spread(study.courses(spark, folder))
    return exposure.regimen_profile(courses, ["ID", "CRCL", *keep], step=step)


def measured_profile(spark, folder):
    """Every grid time of the induction with dose, prediction and measured concentration."""
    rows = induction_profile(spark, folder, "doses")
    given = "coalesce(try_element_at(filter(doses, d -> d.time = time), 1).amt, 0.0D)"
    return add(rows, amt=given, DV=study.measured("IPRE", "time")).drop("doses")


def loading_courses(spark, folder):
    """Induction regimens of both loading rules, as two methods."""
    return events.stack_methods(
        standard=study.courses(spark, folder, apart=True), by_group=study.courses(spark, folder, "by_group", apart=True))


def measured_doses(spark, folder):
    """Dose rows with predicted and measured trough."""
    courses = study.spread(study.courses(spark, folder))
    courses = settled(courses, segs=exposure.dose_segments("doses"))
    rows = courses.selectExpr("ID", "CRCL", "segs", *exposure.PARAMETERS, "inline(doses)")
    rows = settled(rows, IPRE=exposure.predict_at("segs", "time") + ".IPRE")
    return add(rows, DV=study.measured("IPRE", "time")).select("ID", "CRCL", "time", "amt", "IPRE", "DV")


def first_round(spark, folder, early=False):
    """Every patient at the first sample, with the measured trough."""
    now = replay.situation(replay.start(study.courses(spark, folder), early))
    ipre = exposure.predict_at("segs", "sample_time") + ".IPRE"
    return settled(now, conc=study.measured(ipre, "sample_time"))


def first_samples(spark, folder):
    return first_round(spark, folder).select("ID", F.col("sample_time").alias("time"))


def with_one_sample(spark, folder):
    return replay.with_samples(replay.situation(replay.start(study.courses(spark, folder))))


def grid_estimated(spark, folder):
    """Patients at the first sample with the parameters of the grid estimate."""
    return settled(replay.under_estimate(estimation.with_grid_estimate(with_one_sample(spark, folder))))


def policy_finals(spark, folder, *names):
    """Final regimens of the replayed policies with their method code."""
    runs = {
        "sagov": lambda: replay.replay_simple(study.courses(spark, folder), replay.guideline_step),
        "auc24": lambda: replay.replay_simple(study.courses(spark, folder), replay.proportional_step),
        "bayes": lambda: replay.replay_bayes(study.courses(spark, folder)),
        "baynl": lambda: replay.replay_bayes(study.courses(spark, folder, "by_group")),
    }
    return events.stack_methods(**{
        n: storage.stage(runs[n]().select("ID", "CRCL", *exposure.PARAMETERS, "rounds", "doses"), n)
        for n in names})


def regimen_rows(final):
    return final.select("ID", "rounds", F.inline("doses"))


# ---- scans and sinks ----


@query
def scan_cohort(spark, folder):
    table = storage.read_table(spark, f"{folder}/customer.parquet", schema.CUSTOMER)
    return table.selectExpr("c_custkey + 1 as ID", "c_nationkey as nation", "c_acctbal as balance")


@query
def profile_roundtrip(spark, folder):
    """Profiles written and read back with as many digits as the query returns, packed by what they change by."""
    path = storage.staged_path(spark, "profiles")
    digits = {"IPRE": 6, "AUC": 3, "PERI": 4}
    made = rounded(report.profiles(loading_courses(spark, folder)), **digits)
    storage.write_profiles(made, path, digits)
    return storage.read_profiles(spark, path, schema.PROFILE, digits, ["ID", "method", "time", *digits])


# ---- table construction ----


@query
def cohort_build(spark, folder):
    return rounded(study.cohort(spark, folder), ETA1=9, ETA2=9, ETA3=9)


@query
def time_grid(spark, folder):
    span = study.user_samples(spark, folder).groupBy("ID").agg(F.max("time").alias("span"))
    return span.selectExpr("ID", f"explode({events.time_grid('0.0D', 'span', '24.0D')}) as time")


@query
def event_grid(spark, folder):
    return events.event_grid(study.spread(study.cohort(spark, folder).select("ID")))


@query
def dose_schedule(spark, folder):
    return induction_grid(spark, folder).drop("CRCL")


@query
def loading_dose(spark, folder):
    return doses(spark, folder).select("ID", "time", "amt")


@query
def loading_dose_by_group(spark, folder):
    return doses(spark, folder, "by_group").select("ID", "time", "amt")


@query
def bind_by_key(spark, folder):
    most = study.SORTED_PATIENTS
    grid = events.event_grid(study.spread(study.cohort(spark, folder).select("ID"), most=most))
    eps1, eps2 = study.noise("ID", "time")
    noise = add(grid, EPS1=eps1, EPS2=eps2).select("ID", "time", "EPS1", "EPS2")
    return events.bind_by_key(induction_grid(spark, folder, most).select("ID", "time", "amt"), noise)


@query
def draw_etas(spark, folder):
    patients = study.cohort(spark, folder).select("ID", "CRCL")
    return rounded(draws.with_etas(patients, 123456), ETA1=9, ETA2=9, ETA3=9)


@query
def draw_eps(spark, folder):
    rows = induction_grid(spark, folder).select("ID", "time", "amt")
    return rounded(draws.with_eps(rows, 123456), EPS1=9, EPS2=9)


@query
def trunc_normal_draw(spark, folder):
    patients = study.cohort(spark, folder).select("ID")
    plain = draws.truncated_normal(patients, 79.0, 20.0, (33.0, 255.0), 1, name="wt")
    return rounded(draws.truncated_normal(plain, 62.0, 40.0, (4.0, 150.0), 2, True, "crcl"),
                   wt=9, crcl=9)


@query
def trunc_mvn_draw(spark, folder):
    patients = study.cohort(spark, folder).select("ID")
    drawn = draws.truncated_mvn(
        patients, (79.0, 170.0), (20.0, 10.0), ((1.0, 0.5), (0.5, 1.0)), (33.0, 140.0),
        (255.0, 210.0), 3, log=True)
    return rounded(drawn, x1=9, x2=9)


# ---- projections, filters, joins ----


@query
def filter_dose_events(spark, folder):
    table = induction_grid(spark, folder)
    kept = table.where("evid != 0 and time >= 24 and (amt < 1000 or CRCL = 100)")
    return kept.select("ID", "time", "amt")


@query
def filter_day_boundaries(spark, folder):
    return evaluation.day_boundaries(induction_grid(spark, folder)).select("ID", "time", "evid")


@query
def mask_unsampled(spark, folder):
    rows = measured_doses(spark, folder).select("ID", "time", "DV")
    return rounded(sampling.mask_unsampled(rows, first_samples(spark, folder)), DV=6)


@query
def cohort_subset(spark, folder):
    ranges = " or ".join(f"ID between {low} and {low + 99}" for low in (1, 1001, 2001, 3001))
    return study.cohort(spark, folder).where(ranges).select("ID", "CRCL")


@query
def dose_interval(spark, folder):
    return sampling.dose_intervals(study.order_doses(spark, folder), tie="dose_id", block_hours=2160.0)


@query
def attach_covariates(spark, folder):
    rows = doses(spark, folder).select("ID", "time", "amt")
    joined = events.attach_covariates(rows, study.cohort(spark, folder))
    return rounded(joined, ETA1=9, ETA2=9, ETA3=9)


@query
def exposure_profile(spark, folder):
    courses = study.courses(spark, folder, apart=True, most=study.SORTED_PATIENTS)
    obs = events.event_grid(courses.select("ID")).select("ID", "time")
    given = events.dose_rows(courses, "ID")
    swept = exposure.exposure_sweep(obs, given, courses, by_patient=True)
    return rounded(swept, IPRE=6, AUC=3, PERI=4)


@query
def exposure_long_history(spark, folder):
    """Years of irregular doses (orders) and irregular observations (events)."""
    given, obs = study.histories(spark, folder)
    rows = histories.exposure(obs, given, study.courses(spark, folder))
    return rounded(rows.selectExpr("ID", "key as event_id", "IPRE", "AUC"), IPRE=6, AUC=3)


@query
def sampled_observations(spark, folder):
    rows = measured_doses(spark, folder).select("ID", "time", "DV")
    return rounded(sampling.sampled(rows, first_samples(spark, folder)), DV=6)


@query
def last_dose_lookup(spark, folder):
    return first_round(spark, folder).select("ID", "sample_time", "last_amt", "last_frq")


@query
def guideline_dose(spark, folder):
    """Decision at the first sample of every patient, looked up in the guideline as a table."""
    rules = policies.RuleTable(policies.guideline_rules(spark))
    now = add(rules.decide(first_round(spark, folder)), wait=sampling.next_wait("dose_amt = 0"))
    return rounded(now.select("ID", "sample_time", "conc", "dose_amt", "dose_frq", "wait"), conc=6)


@query
def guideline_all_doses(spark, folder):
    """Decision at every dose of the induction, from its measured trough and the guideline as a table."""
    gap = F.lead("time").over(Window.partitionBy("ID").orderBy("time")) - F.col("time")
    rows = measured_doses(spark, folder).withColumn("last_frq", gap)
    rules = policies.RuleTable(policies.guideline_rules(spark))
    found = rules.decide(rows, conc="DV", last_amt="amt")
    return rounded(found.select("ID", "time", "DV", "dose_amt", "dose_frq"), DV=6)


# ---- aggregates and windows ----


@query
def median_profile(spark, folder):
    return rounded(quantiles.exact_quantiles(
        induction_profile(spark, folder), ["time", "CRCL"], "IPRE", [("median", 0.5)]), median=6)


@query
def ci90_band(spark, folder):
    return rounded(quantiles.exact_quantiles(
        induction_profile(spark, folder), ["time", "CRCL"], "IPRE", quantiles.interval_bounds([0.9])),
        ci90lo=6, ci90hi=6)


@query
def ci_family(spark, folder):
    table = storage.read_table(spark, f"{folder}/events.parquet").select("event_type", "value")
    bounds = quantiles.interval_bounds(C.INTERVAL_LEVELS)
    return rounded(quantiles.exact_quantiles(table, ["event_type"], "value", bounds),
                   **{name: 6 for name, _ in bounds})


def _daily(spark, folder):
    return report.daily_exposure(report.profiles(loading_courses(spark, folder), step=24.0))


@query
def pta_by_method(spark, folder):
    return rounded(report.attainment(_daily(spark, folder)), gt400=6, gt700=6, gt400lt700=6)


@query
def pta_by_method_crcl(spark, folder):
    return rounded(report.attainment(_daily(spark, folder), True), gt400=6, gt700=6, gt400lt700=6)


@query
def pta_by_crcl(spark, folder):
    """Share of patients over the exposure limits on each day, by renal group."""
    daily = evaluation.daily_auc(
        induction_profile(spark, folder, step=24.0).select("ID", "CRCL", "time", "AUC"))
    table = evaluation.target_attainment(daily, ["day", "CRCL"])
    return rounded(table, gt400=6, gt700=6, gt400lt700=6)


@query
def trapezoid_auc24(spark, folder):
    now = settled(first_round(spark, folder), auc24=replay.sampled_auc24())
    return rounded(now.select("ID", "auc24"), auc24=6)


@query
def trapezoid_series(spark, folder):
    series = study.user_samples(spark, folder)
    return rounded(evaluation.trapezoid_auc(series, 24.0, 600.0, "event_id"), auc24=4)


@query
def window_auc24(spark, folder):
    """Trapezoid AUC of the day up to every sample of every patient."""
    series = study.user_samples(spark, folder)
    windows = series.selectExpr("ID", "event_id as window_id", "time - 24 as begin", "time as end")
    return rounded(evaluation.window_auc(series, windows, "event_id"), begin=6, end=6, auc=3)


@query
def dose_count(spark, folder):
    return induction_grid(spark, folder).groupBy("ID").agg(
        F.expr("count_if(evid != 0) as n_doses"), F.count("*").alias("n_rows"))


@query
def map_objective(spark, folder):
    """Objective at the population values and one standard deviation away on each axis."""
    sds = [math.sqrt(omega) for omega in C.OMEGA]
    points = [(0.0, 0.0, 0.0)] + [
        tuple(sign * sd if i == axis else 0.0 for i, sd in enumerate(sds))
        for axis in range(3) for sign in (-1.0, 1.0)]
    rows = ", ".join(
        f"named_struct('cand', {i}, 'eta1', {num(a)}, 'eta2', {num(b)}, 'eta3', {num(c)})"
        for i, (a, b, c) in enumerate(points))
    now = with_one_sample(spark, folder).selectExpr(
        "ID", "WT", "CRCL", "DIAL", "doses", "samples", f"inline(array({rows}))")
    scored = add(estimation.with_fit_terms(now), ofv=estimation.objective("eta1", "eta2", "eta3"))
    return rounded(scored.select("ID", "cand", "ofv"), ofv=6)


@query
def nest_unnest(spark, folder):
    nested = events.nest_events(doses(spark, folder), "amt", "evid", "rate")
    return events.unnest_events(add(nested, n="size(data)"))


@query
def daily_auc(spark, folder):
    profile = induction_profile(spark, folder, step=24.0).select("ID", "CRCL", "time", "AUC")
    return rounded(evaluation.daily_auc(profile), dAUC=4)


@query
def auc_last24(spark, folder):
    def auc(time):
        return exposure.predict_at("segs", time) + ".AUC"
    now = add(first_round(spark, folder), auc24=f"{auc('sample_time')} - {auc('(sample_time - 24)')}")
    return rounded(now.select("ID", "sample_time", "auc24"), auc24=4)


@query
def nth_dose_time(spark, folder):
    table = study.order_doses(spark, folder)
    return sampling.nth_event(table, 4, ("time", "dose_id")).select("ID", "time", "dose_id")


@query
def final_time(spark, folder):
    return sampling.last_event(study.order_doses(spark, folder), "dose_id", "amt")


@query
def first_events(spark, folder):
    rows = measured_profile(spark, folder).select("ID", "time", "amt", "DV")
    return rounded(rows.orderBy("ID", "time").limit(6), DV=6)


# ---- labels and stacking ----


def _tagged(spark, folder):
    patients = study.cohort(spark, folder).select("ID", "CRCL")
    return events.label_methods(events.stack_methods(
        **{code: patients for code, _, _ in C.METHOD_LABELS}))


@query
def label_methods(spark, folder):
    return _tagged(spark, folder)


@query
def ordered_labels(spark, folder):
    counts = _tagged(spark, folder).groupBy("sort_order", "method", "methodf", "CRCL", "crclf").agg(
        F.count("*").alias("n"))
    return counts.orderBy("sort_order", "CRCL")


@query
def stack_methods(spark, folder):
    standard = doses(spark, folder).select("ID", "time", "amt", "CRCL")
    by_group = doses(spark, folder, "by_group").select("ID", "time", "amt")
    return events.stack_methods(standard=standard, by_group=by_group)


# ---- scalar functions ----


def _events(spark, folder):
    return storage.read_table(spark, f"{folder}/events.parquet").select("event_id", "value")


def _orders(spark, folder):
    return storage.read_table(spark, f"{folder}/orders.parquet").selectExpr(
        "o_orderkey as ID", "o_totalprice / 100 as amt")


@query
def round_up_dose(spark, folder):
    return add(_orders(spark, folder), dose=model.round_up("amt")).select("ID", "dose")


@query
def clamp_prediction(spark, folder):
    table = _events(spark, folder).selectExpr(
        "event_id", "case event_id % 7 when 0 then double('nan') when 1 then double('inf') "
                    "when 2 then null else value - 10 end as raw")
    return add(table, kept=model.clamp_prediction("raw")).selectExpr(
        "event_id", f"kept = {num(C.PREDICTION_FLOOR)} as floored", "round(kept, 6) as kept")


@query
def normal_logpdf(spark, folder):
    density = model.normal_logpdf("value", "(20 + event_id % 10)", "(5.0D + event_id % 3)")
    return rounded(add(_events(spark, folder), logpdf=density).select("event_id", "logpdf"), logpdf=6)


@query
def error_sd(spark, folder):
    kinds = {kind: model.error_sd("value", kind) for kind in ("combined", "additive", "proportional")}
    table = add(_events(spark, folder), **kinds).drop("value")
    return rounded(table, combined=6, additive=6, proportional=6)


@query
def individual_parameters(spark, folder):
    names = ("COVCL", "COVVC", "CL", "VC", "VP", "Q")
    return rounded(model.with_parameters(study.cohort(spark, folder)).select("ID", *names),
                   **{n: 9 for n in names})


@query
def infusion_duration(spark, folder):
    table = add(_orders(spark, folder), effective=model.infusion_hours("amt"),
                intended=model.infusion_hours("amt", intended=True))
    return rounded(table.drop("amt"), effective=9, intended=9)


@query
def observed_concentration(spark, folder):
    return rounded(measured_profile(spark, folder).select("ID", "time", "IPRE", "DV"), IPRE=6, DV=6)


@query
def full_profile(spark, folder):
    """Every output of the model at every grid time, with the patient's columns carried along."""
    kept = ("WT", "DIAL", "COVCL", "COVVC", "CL", "VC", "VP", "Q", "ETA1", "ETA2", "ETA3")
    courses = study.courses(spark, folder, apart=True)
    shown = {c: f"shown_{c}" for c in kept[2:] if c != "Q"}  # a patient's columns are rounded once, not at every time
    courses = add(courses, **{name: model.rounded(c, 9) for c, name in shown.items()})
    rows = exposure.regimen_profile(courses, ["ID", "CRCL", "WT", "DIAL", "Q", "VC", "VP", *shown.values()])
    eps1, eps2 = study.noise("ID", "time")
    rows = add(rows, EPS1=eps1, EPS2=eps2, C2="PERI / VP", CENT="IPRE * VC")
    rows = add(rows, DV=model.observed("IPRE", "EPS1", "EPS2"))
    rows = rounded(rows, IPRE=6, AUC=3, PERI=4, C2=6, CENT=4, DV=6)
    return rows.selectExpr("ID", "CRCL", *[f"{shown.get(c, c)} as {c}" for c in kept], "time", "IPRE", "AUC", "PERI",
                           "EPS1", "EPS2", "C2", "CENT", "DV")


def _bodies(spark, folder):
    return storage.read_table(spark, f"{folder}/customer.parquet").selectExpr(
        "c_custkey + 1 as ID",
        "40.0D + c_custkey % 160 as secr", "18.0D + c_custkey % 70 as age",
        "cast(c_custkey % 2 as int) as sex", "cast(c_custkey % 3 = 0 as int) as black",
        "c_custkey % 5 = 0 as mgdl", "45.0D + c_custkey % 60 as wt", "145.0D + c_custkey % 55 as ht")


@query
def ckd_epi(spark, folder):
    table = add(_bodies(spark, folder), secr="if(mgdl, secr / 88.4D, secr)")
    egfr = body.ckd_epi("secr", "age", "sex", "black", "mgdl")
    return rounded(add(table, egfr=egfr).select("ID", "egfr"), egfr=6)


@query
def bmi(spark, folder):
    table = add(_bodies(spark, folder), bmi_cm=body.bmi("wt", "ht"),
                bmi_m=body.bmi("wt", "(ht / 100)", cm=False))
    return rounded(table.select("ID", "bmi_cm", "bmi_m"), bmi_cm=6, bmi_m=6)


@query
def bsa(spark, folder):
    return rounded(add(_bodies(spark, folder), bsa=body.bsa("wt", "ht")).select("ID", "bsa"), bsa=6)


# ---- estimation, dosing and replay ----


@query
def map_grid_estimate(spark, folder):
    found = estimation.regimen_estimate(with_one_sample(spark, folder))
    return rounded(found, eta1=9, eta2=9, eta3=9, ofv=6)


@query
def map_estimate(spark, folder):
    now = estimation.with_map_estimate(with_one_sample(spark, folder))
    return rounded(now.select("ID", "est.*"), eta1=6, eta2=6, eta3=6, ofv=6)


@query
def map_refinement(spark, folder):
    """Whether the refined estimate is at least as good as the best grid point, by the native objective."""
    now = estimation.with_map_estimate(estimation.with_grid_estimate(
        with_one_sample(spark, folder)).withColumnRenamed("est", "grid"))
    scored = add(
        estimation.with_fit_terms(now),
        refined=estimation.objective("est.eta1", "est.eta2", "est.eta3"),
        coarse=estimation.objective("grid.eta1", "grid.eta2", "grid.eta3"))
    return scored.selectExpr(
        "ID", "refined <= coarse + 1e-9D as better", "abs(refined - est.ofv) < 1e-6D as agrees")


@query
def map_grid_history(spark, folder):
    """Best grid point per patient from all samples (events) and all doses (orders) of the tables.

    Histories are cut into units of bounded size, and each scores all grid points as one array.
    """
    found = estimation.history_estimate(study.cohort(spark, folder), *study.histories(spark, folder))
    return rounded(found, eta1=9, eta2=9, eta3=9, ofv=4)


@query
def map_history(spark, folder):
    """Refined estimate per patient from all samples and all doses of the tables."""
    found = estimation.history_map(study.cohort(spark, folder), *study.histories(spark, folder))
    return rounded(found, eta1=12, eta2=12, eta3=12, ofv=4)


@query
def ebe_profile(spark, folder):
    """Prediction under the estimate at every grid time up to the sample."""
    now = settled(grid_estimated(spark, folder), e_segs=exposure.dose_segments("doses", "e_"))
    parameters = [f"e_{name}" for name in exposure.PARAMETERS]
    times = events.time_grid("0.0D", "sample_time", num(C.GRID_STEP))
    rows = now.selectExpr("ID", "e_segs", *parameters, f"explode({times}) as time")
    rows = add(rows, p=exposure.predict_at("e_segs", "time", "e_"))
    return rounded(rows.select("ID", "time", "p.IPRE", "p.AUC"), IPRE=6, AUC=3)


@query
def ebe_history(spark, folder):
    """Every sample of the tables, predicted under the estimate from the samples before it."""
    given, seen = study.histories(spark, folder)
    rows = estimation.running_estimates(study.cohort(spark, folder), given, seen)
    return rounded(rows.select("ID", "key", "n_before", "cand_before", "IPRE"), IPRE=6)


@query
def target_history(spark, folder):
    """Dose after every sample of the tables, from the estimate that all samples up to it give."""
    given, seen = study.histories(spark, folder)
    cohort = study.cohort(spark, folder)
    found = storage.stage(estimation.running_estimates(cohort, given, seen), "estimates")
    probes = found.selectExpr("ID", "key", "cand", "inline(array(named_struct('time', time, 'what', 0), "
                              "named_struct('time', time - 24, 'what', 1)))")
    states = estimation.states_under(cohort, given, probes)
    samples = asof.as_of(found.select("ID", "time", "key"), given.selectExpr("ID", "time", "amt as last_amt"),
                         ("last_amt",), block_hours=2016.0)
    rows = states.join(samples.withColumn("last_amt", F.coalesce("last_amt", F.lit(0.0))), ["ID", "key"])
    rows = rows.join(cohort.select("ID", "CRCL"), "ID")
    doses = dosing.history_doses(rows, f"if(CRCL <= {num(C.EARLY_CRCL)}, 24.0D, 12.0D)")
    return rounded(doses.drop("time"), auc24=3)


@query
def proportional_dose(spark, folder):
    now = replay.proportional_step(replay.start(study.courses(spark, folder)))
    return rounded(now.select("ID", "auc24", "d.dose_amt", "d.dose_frq", "wait"), auc24=6)


def _target(spark, folder, exact):
    now = replay.estimated_auc24(grid_estimated(spark, folder))
    now = add(now, wait=sampling.next_wait(f"auc24 >= {num(C.AUC_RESAMPLE)}"))
    now = settled(now, next_time=f"least(sample_time + wait, {num(C.HORIZON)})")
    dose = dosing.target_dose(
        "doses", "sample_time", "next_time", "last_frq", "e_", rounded=not exact, past="e_segs")
    search = policies.outside_target("auc24", "last_amt")
    now = add(now, dose_amt=f"if({search}, {dose}, last_amt)")
    return now.select("ID", "auc24", "wait", "next_time", "dose_amt")


@query
def target_auc_dose(spark, folder):
    return rounded(_target(spark, folder, exact=False), auc24=4)


@query
def target_auc_dose_exact(spark, folder):
    return rounded(_target(spark, folder, exact=True), auc24=4, dose_amt=4)


@query
def regimen_rewrite(spark, folder):
    now = replay.guideline_step(replay.start(study.courses(spark, folder)))
    decisions = now.selectExpr(
        "ID", "sample_time", "d.dose_amt as dose_amt", "d.dose_frq as dose_frq",
        "d.dose_amt != last_amt or d.dose_frq != last_frq as changed")
    table = regimen.rewrite_events(induction_grid(spark, folder), decisions)
    return table.select("ID", "time", "amt", "evid", "rate")


def dose_decisions(spark, folder, numbers):
    """Guideline decisions of every patient at the doses of these numbers, from the measured troughs."""
    order = Window.partitionBy("ID").orderBy("time")
    rows = measured_doses(spark, folder).withColumns({
        "n": F.row_number().over(order), "last_frq": F.lead("time").over(order) - F.col("time")})
    rows = rows.where(F.col("n").isin(list(numbers)) & F.col("last_frq").isNotNull())
    decision = policies.guideline_decision("CRCL", "DV", "amt", "last_frq")
    return add(rows, d=decision).selectExpr(
        "ID", "time as sample_time", "d.dose_amt as dose_amt", "d.dose_frq as dose_frq",
        "d.dose_amt != amt or d.dose_frq != last_frq as changed")


@query
def regimen_versions(spark, folder):
    """Every event of the induction under the latest of up to three decisions of its patient."""
    decisions = dose_decisions(spark, folder, (4, 6, 10))
    table = regimen.rewrite_versions(induction_grid(spark, folder), decisions)
    return table.select("ID", "time", "amt", "evid", "rate")


@query
def as_of_dose(spark, folder):
    """Last dose before every sample of the tables, and the interval that follows that dose."""
    _, seen = study.histories(spark, folder)
    given = sampling.with_next_time(add(study.order_doses(spark, folder), ID="ID + 1"), tie="dose_id", block_hours=2016.0)
    facts = given.selectExpr("ID", "time", "dose_id", "amt as last_amt", "time as dose_time", "next_time - time as last_frq")
    found = asof.as_of(seen, facts, ("dose_id", "last_amt", "dose_time", "last_frq"), block_hours=2016.0)
    return rounded(found.drop("DV"), time=6, dose_time=6, last_frq=6)


@query
def dose_update(spark, folder):
    table = regimen.update_amounts(doses(spark, folder), 72.0, 1250.0)
    return table.select("ID", "time", "amt", "evid")


@query
def first_sample(spark, folder):
    patients = storage.read_table(spark, f"{folder}/customer.parquet").selectExpr(
        "c_custkey + 1 as ID", "10 + (c_custkey * 37 % 1200) / 10.0D as CRCL")
    numbered = add(patients, dose_num=f"cast({sampling.first_dose_number()} as double)",
                   early_num=f"cast({sampling.first_dose_number(early=True)} as double)")
    return add(numbered, rejected="cast(dose_num is null as int)")


@query
def sampling_rejects(spark, folder):
    """Patients who cannot be sampled and why, with the counts of the pass that set them apart."""
    patients = storage.read_table(spark, f"{folder}/customer.parquet").selectExpr(
        "c_custkey + 1 as ID", "if(c_custkey % 50 = 7, null, 10 + (c_custkey * 37 % 1200) / 10.0D) as CRCL",
        "cast(c_custkey % 33 = 5 as int) as DIAL")
    passed, rejected, counts = sampling.split_rejects(patients, {
        "no creatinine clearance": "CRCL is null", "dialysis": "DIAL = 1",
        f"clearance below {C.MIN_CRCL:g} mL/min": f"CRCL < {num(C.MIN_CRCL)}"})
    return add(rejected, of=f"{counts['n_rows']}L", rejected=f"{counts['n_rejected']}L")


@query
def next_sample(spark, folder):
    now = replay.guideline_step(replay.start(study.courses(spark, folder)))
    waits = now.select("ID", "wait")
    after = replay.conclude(now)
    return after.join(waits, "ID").selectExpr(
        "ID", "wait", "dose_num", "size(doses) as n_doses", "cast(active as int) as again")


@query
def replay_guideline(spark, folder):
    return regimen_rows(replay.replay_simple(study.courses(spark, folder), replay.guideline_step))


@query
def replay_proportional(spark, folder):
    return regimen_rows(replay.replay_simple(study.courses(spark, folder), replay.proportional_step))


@query
def replay_bayes(spark, folder):
    return regimen_rows(replay.replay_bayes(study.courses(spark, folder)))


@query
def replay_bayes_grid(spark, folder):
    """The model-based loop with the coarse grid estimate in every round."""
    return regimen_rows(replay.replay_bayes(study.courses(spark, folder), estimate="grid"))


@query
def replay_bayes_grid_early(spark, folder):
    return regimen_rows(replay.replay_bayes(study.courses(spark, folder), early=True, estimate="grid"))


@query
def replay_bayes_grid_noround(spark, folder):
    return _exact_rows(replay.replay_bayes(
        study.courses(spark, folder), early=True, rounded=False, estimate="grid"))


@query
def replay_bayes_grid_alwaysopt(spark, folder):
    return _exact_rows(replay.replay_bayes(
        study.courses(spark, folder), early=True, gate=False, rounded=False, estimate="grid"))


@query
def replay_bayes_grid_peak_trough(spark, folder):
    return _exact_rows(replay.replay_bayes(
        study.courses(spark, folder), peak_trough=True, gate=False, rounded=False, estimate="grid"))


@query
def replay_bayes_grid_newload(spark, folder):
    return regimen_rows(replay.replay_bayes(
        study.courses(spark, folder, "by_group"), estimate="grid"))


@query
def replay_bayes_newload(spark, folder):
    return regimen_rows(replay.replay_bayes(study.courses(spark, folder, "by_group")))


@query
def replay_bayes_early(spark, folder):
    return regimen_rows(replay.replay_bayes(study.courses(spark, folder), early=True))


def _exact_rows(final):
    return rounded(regimen_rows(final), amt=3)


@query
def replay_bayes_noround(spark, folder):
    return _exact_rows(replay.replay_bayes(study.courses(spark, folder), early=True, rounded=False))


@query
def replay_bayes_alwaysopt(spark, folder):
    return _exact_rows(replay.replay_bayes(
        study.courses(spark, folder), early=True, gate=False, rounded=False))


@query
def replay_bayes_peak_trough(spark, folder):
    return _exact_rows(replay.replay_bayes(
        study.courses(spark, folder), peak_trough=True, gate=False, rounded=False))


@query
def peak_trough_samples(spark, folder):
    now = replay.situation(replay.start(study.courses(spark, folder)))
    taken = replay.with_samples(now, peak_trough=True)
    return rounded(taken.selectExpr("ID", "inline(samples)"), DV=6)


@query
def patient_slice(spark, folder):
    rows = measured_profile(spark, folder)
    return rounded(rows.where("ID = 1 and time <= 72").select("ID", "time", "amt", "DV"), DV=6)


@query
def policy_report(spark, folder):
    regimens = loading_courses(spark, folder)
    daily = report.daily_exposure(report.profiles(regimens, step=24.0))
    return rounded(report.policy_report(daily, report.profiles(regimens)), value=6, percent=4)


@query
def policy_report_bayes(spark, folder):
    """The report on the final regimens of all four replayed policies."""
    finals = policy_finals(spark, folder, "sagov", "auc24", "bayes", "baynl")
    daily = report.daily_exposure(report.profiles(finals, step=24.0))
    return rounded(report.policy_report(daily, report.profiles(finals)), value=6, percent=4)
