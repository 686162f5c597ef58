"""Renal function and body-size formulas, as Spark SQL text."""


def ckd_epi(secr, age, sex, black, mgdl="false"):
    """CKD-EPI eGFR; serum creatinine in umol/L unless ``mgdl``. Sex 1 is male, black is 0/1."""
    kappa = f"(case when {sex} = 1 then 0.9D else 0.7D end)"
    alpha = f"(case when {sex} = 1 then -0.411D else -0.329D end)"
    ratio = f"(case when {mgdl} then {secr} else {secr} / 88.4D end / {kappa})"
    return (f"(141.0D * pow(least({ratio}, 1.0D), {alpha}) * pow(greatest({ratio}, 1.0D), -1.209D) "
            f"* pow(0.993D, {age}) * pow(1.018D, 1 - {sex}) * pow(1.159D, {black}))")


def bmi(wt, ht, cm=True):
    """Weight in kg over squared height; height in cm, or in m with ``cm=False``."""
    unit = "100.0D" if cm else "1.0D"
    return f"({wt} / pow({ht} / {unit}, 2.0D))"


def bsa(wt, ht):
    """Body surface area from kg and cm."""
    return f"(0.007184D * pow({ht}, 0.725D) * pow({wt}, 0.425D))"
