"""Expressions of the pharmacokinetic model, as Spark SQL text.

Arguments are SQL text as well: a column name, a literal or any expression. Text nests freely
inside array lambdas and is handed to Spark in one piece (``selectExpr`` or ``F.expr``).
"""

import math

from pyspark.sql import functions as F

from .. import constants as C


def num(value):
    """A Python number as a DOUBLE literal."""
    return f"{float(value)!r}D"


def let(name, value, body):
    """Evaluate ``value`` once and use it as ``name`` inside ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def settled(df, **columns):
    """Add columns given as SQL text and evaluate every column here, once per row.

    The optimizer merges neighbouring projections and would otherwise repeat a column's
    expression for every element of a later array function that refers to it.
    """
    fields = {name: name for name in df.columns} | columns
    pairs = ", ".join(f"'{name}', {text}" for name, text in fields.items())
    return df.selectExpr(f"inline(array(named_struct({pairs})))")


def add(df, **columns):
    """Add columns given as SQL text."""
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})


def shuffled_join(rows, few, *keys, how="inner"):
    """Join many ``rows`` with the side that has few rows per key, without a broadcast.

    Spark's size estimate does not see how far an ``explode`` multiplies rows, so an expanded
    table can look small enough to broadcast. A merge join spills, adaptive execution can split a
    key that many rows have, and a following window by the same keys needs no second shuffle.
    """
    return rows.join(few.hint("merge"), list(keys), how)


def infusion_hours(amt, intended=False):
    """Infusion duration of a dose: 1 h to 1500 mg, 2 h to 2000 mg, then 1 g/h.

    ``intended=True`` gives doses over 1000 and up to 1500 mg 1.5 h.
    """
    middle = 1.5 if intended else 1.0
    return (f"(case when {amt} <= 1000 then 1.0D when {amt} <= 1500 then {num(middle)} "
            f"when {amt} <= 2000 then 2.0D else {amt} / 1000.0D end)")


def with_parameters(df, etas=("ETA1", "ETA2", "ETA3")):
    """Add covariate-adjusted (COVCL, COVVC) and individual (CL, VC, VP, Q) parameters."""
    eta1, eta2, eta3 = etas
    covariate = add(
        df,
        COVCL=f"{num(C.TVCL)} * pow(CRCL / {num(C.REF_CRCL)}, {num(C.CL_CRCL)}) "
              f"* pow({num(C.CL_DIAL)}, DIAL)",
        COVVC=f"{num(C.TVVC)} * (WT / {num(C.REF_WT)}) * pow({num(C.VC_DIAL)}, DIAL)",
    )
    return add(covariate, CL=f"COVCL * exp({eta1})", VC=f"COVVC * exp({eta2})",
               VP=f"{num(C.TVVP)} * exp({eta3})", Q=num(C.TVQ))


KINETICS = ("ka", "kb", "wa", "wb", "wp")


def with_rate_constants(df):
    """Add the two exponents (ka > kb) of the model and the weights derived from them.

    ``wa`` and ``wb`` turn an infusion rate into the steady concentration of each exponent;
    ``wp`` scales the peripheral amount.
    """
    rates = add(df, k10="CL / VC", k12="Q / VC", k21="Q / VP")
    rates = add(rates, ksum="k10 + k12 + k21")
    rates = add(rates, ka="(ksum + sqrt(ksum * ksum - 4 * k10 * k21)) / 2")
    rates = add(rates, kb="k10 * k21 / ka")
    return add(
        rates,
        wa="(ka - k21) / ((ka - kb) * ka * VC)",
        wb="(k21 - kb) / ((ka - kb) * kb * VC)",
        wp="k12 / (ka - kb)",
    ).drop("k10", "k12", "k21", "ksum")


def observed(ipre, eps1, eps2):
    """Concentration with residual error; it may be negative."""
    return f"({ipre} * (1 + {eps1} * {num(C.ERR_PRO)}) + {eps2} * {num(C.ERR_ADD)})"


def error_sd(prediction, kind="combined"):
    """Standard deviation of an observation around its prediction."""
    if kind == "additive":
        return num(C.ERR_ADD)
    if kind == "proportional":
        return f"({prediction} * {num(C.ERR_PRO)})"
    if kind == "combined":
        return f"sqrt(pow({prediction} * {num(C.ERR_PRO)}, 2.0D) + {num(C.ERR_ADD ** 2)})"
    raise ValueError(f"unknown error model: {kind}")


def normal_logpdf(x, mean, sd):
    constant = num(-0.5 * math.log(2 * math.pi))
    return f"({constant} - ln({sd}) - pow({x} - {mean}, 2.0D) / (2 * {sd} * {sd}))"


def clamp_prediction(value):
    """Replace a missing, non-finite or tiny prediction by the smallest usable one."""
    return (f"(case when {value} is null or isnan({value}) or abs({value}) = double('inf') "
            f"or {value} < {num(C.PREDICTION_FLOOR)} then {num(C.PREDICTION_FLOOR)} "
            f"else {value} end)")


def round_up(value, step=C.DOSE_STEP):
    """Next multiple of ``step``, as a double."""
    return f"(cast(ceil({value} / {num(step)}) as double) * {num(step)})"


def rounded(value, digits):
    """``round(value, digits)`` of a double column: by arithmetic, and by Spark's decimals only near a tie.

    Spark rounds by way of a decimal's text, which takes longer than the model itself. Below 1e11 the product is off by less
    than 1e-4, so away from ties the integer next to it is the same, and its quotient is the double next to the decimal.
    """
    scaled = f"({value} * {num(10.0 ** digits)})"
    clear = f"abs({scaled}) < 1e11D and abs({scaled} - floor({scaled}) - 0.5D) > 1e-3D"
    return f"if({clear}, floor({scaled} + 0.5D) / {num(10.0 ** digits)}, round({value}, {digits}))"
