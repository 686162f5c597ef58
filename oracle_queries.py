"""SQL oracles: the same results from direct formulas, in one statement per query.

Exposure here is the plain sum over all earlier doses, and replays are unrolled round by round,
so the statements share no method with the library.
"""

# Fixed values of the study, plainly stated: they must stay as they are for results to agree. So must RULES
# and the labels below.
OMEGA = (0.158404, 0.665856, 0.326041)
ETA_KEYS = ((7919, 13), (104729, 17), (1299709, 29))
EPS_KEYS = ((15485863, 31), (32452843, 37))


def d(value):
    return f"CAST({value} AS DOUBLE)"


def sd(k):
    return f"sqrt({d(OMEGA[k])})"


def unit(key, pq):
    return f"(((({key}) * {pq[0]} + {pq[1]}) % 2001 - 1000) / {d(500)})"


def eps(k, patient="ID", time="time"):
    return unit(f"{patient} * 1009 + CAST({time} * 4 AS BIGINT)", EPS_KEYS[k])


def dv(ipre="IPRE", patient="ID", time="time"):
    return (f"({ipre} * (1 + {eps(0, patient, time)} * {d(0.227)}) "
            f"+ {eps(1, patient, time)} * {d(3.4)})")


COHORT = f"""cohort AS MATERIALIZED (
  SELECT c_custkey + 1 AS ID, {d(75)} AS WT,
    {d('CASE c_custkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 75 WHEN 2 THEN 50 ELSE 25 END')} AS CRCL,
    0 AS DIAL,
    {", ".join(f"{sd(k)} * {unit('c_custkey', ETA_KEYS[k])} AS ETA{k + 1}" for k in range(3))}
  FROM customer)"""


def params(name, source, etas=("ETA1", "ETA2", "ETA3"), keep="ID"):
    """CTE with individual parameters and exponents."""
    return f"""{name} AS MATERIALIZED (
  SELECT *, k10 * k21 / a AS b FROM (
    SELECT *, (s + sqrt(s * s - 4 * k10 * k21)) / 2 AS a FROM (
      SELECT *, k10 + k12 + k21 AS s FROM (
        SELECT *, CL / VC AS k10, Q / VC AS k12, Q / VP AS k21 FROM (
          SELECT {keep}, COVCL, COVVC, COVCL * exp({etas[0]}) AS CL, COVVC * exp({etas[1]}) AS VC,
            {d(38.4)} * exp({etas[2]}) AS VP, {d(6.5)} AS Q FROM (
            SELECT *, {d(4.5)} * pow(CRCL / 120, {d(0.8)}) * pow({d(0.7)}, DIAL) AS COVCL,
              {d(58.4)} * (WT / 70) * pow({d(0.5)}, DIAL) AS COVVC FROM {source}))))))"""


def hours(amt):
    return (f"CASE WHEN {amt} <= 1500 THEN {d(1)} WHEN {amt} <= 2000 THEN {d(2)} "
            f"ELSE {amt} / {d(1000)} END")


def dose_table(name="doses", loading="standard", source="cohort"):
    load = "2000" if loading == "standard" else (
        "CASE CRCL WHEN 100 THEN 3000 WHEN 75 THEN 2750 WHEN 50 THEN 2500 ELSE 2000 END")
    return f"""{name} AS MATERIALIZED (
  SELECT ID, CRCL, {d('12 * k')} AS time, {d(f'''CASE WHEN k = 0 THEN {load}
    ELSE CASE CRCL WHEN 100 THEN 1500 WHEN 75 THEN 1000 WHEN 50 THEN 750 ELSE 1000 END END''')} AS amt
  FROM {source}, range(0, 15) r(k) WHERE CRCL <> 25 OR k = 0 OR k % 2 = 1)"""


def exposure(obs, doses, par, keys=("ID",), extra=""):
    """Sum of closed-form terms over earlier doses; obs and par share ``keys``."""
    on = ", ".join(keys)
    cols = ", ".join(f"o.{k}" for k in keys)
    dose_on = " AND ".join(f"e.{k} = o.{k}" for k in keys if k in ("ID", "method"))
    return f"""(
  SELECT {on}, time{extra},
    coalesce(sum(xa * ga + xb * gb), 0) AS IPRE,
    coalesce(sum(xa * (u - ga / a) + xb * (u - gb / b)), 0) AS AUC,
    coalesce(sum(r * k12 / (a - b) * (gb / b - ga / a)), 0) AS PERI
  FROM (
    SELECT *, r / VC * (a - k21) / (a - b) / a AS xa, r / VC * (k21 - b) / (a - b) / b AS xb,
      (1 - exp(-a * u)) * exp(-a * v) AS ga, (1 - exp(-b * u)) * exp(-b * v) AS gb
    FROM (
      SELECT *, e_amt / T AS r, least(tau, T) AS u, greatest(tau - T, 0) AS v FROM (
        SELECT {cols}, o.time{extra.replace(", ", ", o.")}, p.VC, p.a, p.b, p.k12, p.k21, e.amt AS e_amt,
          o.time - e.time AS tau, {hours('e.amt')} AS T
        FROM {obs} o JOIN {par} p USING ({on})
        LEFT JOIN {doses} e ON {dose_on} AND e.time < o.time AND e.amt > 0)))
  GROUP BY {on}, time{extra})"""


def grid(name="grid", points=673, step=0.25, source="cohort", cols="ID, CRCL"):
    return f"""{name} AS (
  SELECT {cols}, {d(f'k * {step}')} AS time FROM {source}, range(0, {points}) r(k))"""


DAYS = grid("days", 8, 24)
FIRST = """first AS (
  SELECT ID, CRCL, CAST(36 AS DOUBLE) AS time FROM cohort)"""


def with_(*ctes):
    return "WITH " + ",\n".join(ctes) + "\n"


PAR = params("par", "cohort")
DOSES = dose_table()
BASE = (COHORT, PAR, DOSES)
NUMBERED = """numbered AS MATERIALIZED (
  SELECT *, row_number() OVER w AS n, lead(time) OVER w - time AS gap
  FROM doses WINDOW w AS (PARTITION BY ID ORDER BY time))"""
SITUATION = """situation AS MATERIALIZED (
  SELECT n.ID, n.CRCL, n.time AS sample_time, n.amt AS last_amt, n.gap AS last_frq, n.n AS dose_num
  FROM numbered n WHERE n.n = CASE WHEN n.CRCL <= 39 THEN 3 ELSE 4 END)"""
FIRST_OBS = "first_obs AS (SELECT ID, sample_time AS time FROM situation)"
MEASURED = f"""measured AS MATERIALIZED (
  SELECT ID, time, IPRE, {dv()} AS DV FROM {exposure('doses', 'doses', 'par')})"""
FIRST_CONC = f"""first_conc AS MATERIALIZED (
  SELECT s.*, {dv('x.IPRE', 'x.ID', 'x.time')} AS conc FROM situation s
  JOIN {exposure('first_obs', 'doses', 'par')} x ON x.ID = s.ID)"""
AT_FIRST = (*BASE, NUMBERED, SITUATION, FIRST_OBS, FIRST_CONC)

RULES = (
    ("TRUE", "conc > 30", "0", "24", None, None),
    ("CRCL > 90", "conc < 10", "1000", "6", None, None),
    ("CRCL > 90", "conc < 15", "1250", "8", None, None),
    ("CRCL > 90", "conc <= 20", None, None, "1000", "12"),
    ("CRCL > 90", "conc <= 25", "1250", "12", None, None),
    ("CRCL > 90", "conc <= 30", "1000", "12", None, None),
    ("CRCL >= 60", "conc < 10", "1500", "12", None, None),
    ("CRCL >= 60", "conc < 15", "1250", "12", None, None),
    ("CRCL >= 60", "conc <= 20", None, None, "750", "12"),
    ("CRCL >= 60", "conc <= 30", "750", "12", None, None),
    ("CRCL >= 40", "conc < 15", "1000", "12", None, None),
    ("CRCL >= 40", "conc <= 20", None, None, "500", "12"),
    ("CRCL >= 40", "conc <= 30", "500", "12", None, None),
    ("CRCL >= 20", "conc < 15", "750", "12", None, None),
    ("CRCL >= 20", "conc <= 20", None, None, "750", "24"),
    ("CRCL >= 20", "conc <= 30", "750", "24", None, None),
)


def rule_case(keep, fixed_at, fallback_at):
    lines = []
    for rule in RULES:
        fixed, fallback = rule[fixed_at], rule[fallback_at]
        value = fixed if fixed is not None else (
            f"CASE WHEN last_amt <> 0 THEN {keep} ELSE {fallback} END")
        lines.append(f"WHEN {rule[0]} AND {rule[1]} THEN {value}")
    return d("CASE " + " ".join(lines) + " END")


def guideline(name, source):
    return f"""{name} AS MATERIALIZED (
  SELECT *, CASE WHEN dose_amt = 0 THEN {d(24)} ELSE {d(72)} END AS wait,
    dose_amt <> last_amt OR dose_frq <> last_frq AS changed
  FROM (SELECT *, {rule_case('last_amt', 2, 4)} AS dose_amt,
    {rule_case('last_frq', 3, 5)} AS dose_frq FROM {source}))"""


def proportional(name, source):
    """Three unrolled interval steps."""
    text = f"""SELECT *, CASE WHEN auc24 BETWEEN 400 AND 550 THEN last_amt
      ELSE ceil(last_amt * 400 / auc24 / 250) * 250 END AS da0, last_frq AS df0 FROM {source}"""
    for i in range(3):
        skip = f"auc24 BETWEEN 400 AND 550 OR da{i} BETWEEN 500 AND 2000"
        text = f"""SELECT *, CASE WHEN df{i + 1} <> df{i} THEN ceil(da{i} * df{i + 1} / df{i} / 250) * 250
      ELSE da{i} END AS da{i + 1} FROM (
      SELECT *, CASE WHEN {skip} THEN df{i}
        WHEN da{i} < 500 THEN CASE df{i} WHEN 6 THEN 8 WHEN 8 THEN 12 WHEN 12 THEN 24 ELSE df{i} END
        ELSE CASE df{i} WHEN 24 THEN 12 WHEN 12 THEN 8 WHEN 8 THEN 6 ELSE df{i} END
        END AS df{i + 1} FROM ({text}))"""
    return f"""{name} AS MATERIALIZED (
  SELECT *, {d('da3')} AS dose_amt, {d('df3')} AS dose_frq,
    CASE WHEN auc24 >= 800 THEN {d(72 - 48)} ELSE {d(72)} END AS wait,
    da3 <> last_amt OR df3 <> last_frq AS changed FROM ({text}))"""


def day_before(name, source):
    return f"""{name} AS (
  SELECT ID, sample_time - 24 + k * {d(0.25)} AS time FROM {source}, range(0, 97) r(k))"""


def trapezoid(name, obs, doses, par="par"):
    return f"""{name} AS MATERIALIZED (
  SELECT ID, sum((DV + before) * {d(0.25)} / 2) AS auc24 FROM (
    SELECT ID, DV, lag(DV) OVER (PARTITION BY ID ORDER BY time) AS before FROM (
      SELECT ID, time, {dv()} AS DV FROM {exposure(obs, doses, par)}))
  GROUP BY ID)"""


SINGLE = {  # AUC of one dose of amt, duration T, at tau after its start
    "u": "greatest(least({tau}, T), 0)", "v": "greatest({tau} - T, 0)"}


def single_auc(tau):
    u, v = SINGLE["u"].format(tau=tau), SINGLE["v"].format(tau=tau)

    def part(exponent, share_):
        return (f"amt / T / VC * ({share_}) / (a - b) / {exponent} * ({u} - "
                f"(1 - exp(-{exponent} * {u})) * exp(-{exponent} * {v}) / {exponent})")
    return f"({part('a', 'a - k21')} + {part('b', 'k21 - b')})"


ALL_CANDIDATES = f"""all_candidates AS MATERIALIZED (
  SELECT ID, CRCL, WT, DIAL, c AS cand,
    {", ".join(f"({d(digit)} - 3) * {sd(k)} AS eta{k + 1}" for k, digit in enumerate(
        ("c // 49", "(c // 7) % 7", "c % 7")))}
  FROM cohort, range(0, 343) r(c))"""


def halving(name, bracket, est):
    """Recursive CTE (ID, low, high, k): the bracket of each dose over 2000 mg, halved 60 times around the need."""
    gain = f"({single_auc('(next_time - begun)')} - {single_auc('(next_time - 24 - begun)')})"
    return f"""{name} AS (
  SELECT ID, amt - 250 AS low, amt AS high, 0 AS k FROM {bracket} WHERE amt > 2000
  UNION ALL
  SELECT ID, CASE WHEN auc >= need THEN low ELSE amt END, CASE WHEN auc >= need THEN amt ELSE high END, k + 1 FROM (
    SELECT ID, low, high, k, need, amt, sum({gain}) AS auc FROM (
      SELECT x.ID, x.low, x.high, x.k, b.need, b.next_time, (x.low + x.high) / 2 AS amt, (x.low + x.high) / 2000 AS T,
        b.sample_time + j * b.last_frq AS begun, e.VC, e.a, e.b, e.k21
      FROM {name} x JOIN {bracket} b ON b.ID = x.ID JOIN {est} e ON e.ID = x.ID, range(0, 29) f(j)
      WHERE x.k < 60 AND b.sample_time + j * b.last_frq < b.next_time)
    GROUP BY ID, low, high, k, need, amt))"""


def bayes_round(prefix, k, D, Q, X, first_early=False, gate=True, exact=False, pairs=False):
    """One round of the model-based policy with the grid estimate: decisions for active patients."""
    take, samp, obs, score, best, est, auc, need, added = (
        f"{prefix}{name}{k}" for name in
        ("take", "samp", "obs", "score", "best", "est", "auc", "need", "added"))
    before = f"UNION ALL SELECT ID, time, DV FROM {prefix}samp{k - 1}" if k else ""
    prior = " + ".join(
        f"(0.5 * ln(2 * pi()) + ln({sd(i)}) + eta{i + 1} * eta{i + 1} / (2 * {d(OMEGA[i])}))"
        for i in range(3))
    wait = "24" if first_early else "CASE WHEN auc24 >= 800 THEN 24 ELSE 72 END"
    half_day = "2 * " if first_early else ""
    frq = "CASE WHEN q.CRCL <= 39 THEN 24 ELSE 12 END" if first_early else (
        "CASE WHEN q.last_amt = 0 THEN 12 ELSE q.last_frq END")
    keep = "n.auc24 >= 400 AND n.auc24 < 550 AND n.last_amt <> 0" if gate else "FALSE"
    solved = "CASE WHEN h.amt <= 2000 THEN greatest(h.amt - 250, h.amt * n.need / a.auc) ELSE v.high END"
    found = f"CASE WHEN h.amt IS NULL THEN 5000 WHEN {solved} < 1 THEN 0 ELSE {solved} END" if exact else (
        "coalesce(h.amt, 5000)")
    dose = (f"CASE WHEN {keep} THEN n.last_amt WHEN n.next_time - 24 < n.sample_time THEN 1000 "
            f"WHEN n.need <= 0 THEN 0 ELSE {found} END")
    times = f"SELECT ID, sample_time AS time FROM {Q}"
    if pairs:
        times = f"""SELECT ID, time FROM ({times} UNION
    SELECT ID, sample_time - ceil(3 * last_frq / 4) FROM {Q}) WHERE time >= 0"""
        if k:
            times += f" AND (ID, time) NOT IN (SELECT ID, time FROM {prefix}samp{k - 1})"
    return [
        f"{take} AS ({times})",
        f"""{samp} AS MATERIALIZED (
  SELECT ID, time, {dv()} AS DV FROM {exposure(take, D, 'par')} {before})""",
        f"""{obs} AS (
  SELECT c.ID, c.cand, m.time FROM all_candidates c JOIN {samp} m ON m.ID = c.ID
  WHERE c.ID IN (SELECT ID FROM {Q}))""",
        f"""{score} AS MATERIALIZED (
  SELECT c.ID, c.cand, {prior} + f.misfit AS ofv FROM all_candidates c JOIN (
    SELECT ID, cand, sum(0.5 * ln(2 * pi()) + ln(w) + pow(DV - yhat, 2) / (2 * w * w)) AS misfit FROM (
      SELECT z.ID, z.cand, m.DV, z.yhat, sqrt(pow(z.yhat * {d(0.227)}, 2) + {d(3.4)} * {d(3.4)}) AS w
      FROM (SELECT ID, cand, time, greatest(IPRE, {d('2.220446049250313e-16')}) AS yhat
        FROM {exposure(obs, D, 'all_par', ('ID', 'cand'))}) z
      JOIN {samp} m ON m.ID = z.ID AND m.time = z.time)
    GROUP BY ID, cand) f ON f.ID = c.ID AND f.cand = c.cand)""",
        f"""{best} AS (SELECT ID, cand FROM (
  SELECT ID, cand, row_number() OVER (PARTITION BY ID ORDER BY ofv, cand) AS place FROM {score}) WHERE place = 1)""",
        f"""{est} AS MATERIALIZED (
  SELECT p.* EXCLUDE (cand) FROM all_par p JOIN {best} b ON b.ID = p.ID AND b.cand = p.cand)""",
        f"""{auc}o AS (SELECT ID, sample_time AS time FROM {Q} UNION ALL SELECT ID, sample_time - 24 FROM {Q})""",
        f"""{auc} AS MATERIALIZED (
  SELECT q.*, x.auc24, {d(frq)} AS frq,
    {d(wait)} AS wait, least(q.sample_time + {wait}, {d(168)}) AS next_time
  FROM {Q} q JOIN (SELECT ID, {half_day}(max(AUC) - min(AUC)) AS auc24
    FROM {exposure(auc + 'o', D, est)} GROUP BY ID) x ON x.ID = q.ID)""",
        f"{need}d AS (SELECT e.* FROM {D} e JOIN {Q} q ON q.ID = e.ID WHERE e.time < q.sample_time)",
        f"""{need}o AS (SELECT ID, next_time AS time FROM {auc}
  UNION ALL SELECT ID, next_time - 24 FROM {auc})""",
        f"""{need} AS MATERIALIZED (
  SELECT l.*, 500 - x.history AS need FROM {auc} l JOIN (SELECT ID, max(AUC) - min(AUC) AS history
    FROM {exposure(need + 'o', need + 'd', est)} GROUP BY ID) x ON x.ID = l.ID)""",
        f"""{added} AS MATERIALIZED (
  SELECT ID, amt, sum({single_auc('(next_time - begun)')} - {single_auc('(next_time - 24 - begun)')}) AS auc FROM (
    SELECT n.ID, n.next_time, {d('c * 250')} AS amt, {hours(d('c * 250'))} AS T,
      n.sample_time + j * n.frq AS begun, e.VC, e.a, e.b, e.k21
    FROM {need} n JOIN {est} e ON e.ID = n.ID, range(1, 21) r(c), range(0, 29) f(j)
    WHERE n.sample_time + j * n.frq < n.next_time)
  GROUP BY ID, amt)""",
        f"""{X}h AS MATERIALIZED (
  SELECT n.ID, n.next_time, n.need, n.sample_time, n.frq AS last_frq, h.amt, a.auc FROM {need} n
  JOIN (SELECT n2.ID, min(a.amt) AS amt FROM {need} n2
    JOIN {added} a ON a.ID = n2.ID AND a.auc >= n2.need GROUP BY n2.ID) h ON h.ID = n.ID
  JOIN {added} a ON a.ID = n.ID AND a.amt = h.amt)""",
        *([halving(X + "v", X + "h", est)] if exact else []),
        f"""{X} AS MATERIALIZED (
  SELECT *, dose_amt <> last_amt OR dose_frq <> last_frq AS changed FROM (
    SELECT n.*, CASE WHEN {keep} THEN n.last_frq ELSE n.frq END AS dose_frq, {d(dose)} AS dose_amt
    FROM {need} n LEFT JOIN {X}h h ON h.ID = n.ID
    LEFT JOIN {added} a ON a.ID = n.ID AND a.amt = h.amt
    {f"LEFT JOIN {X}v v ON v.ID = n.ID AND v.k = 60" if exact else ""}))"""]


USUAL = "CASE WHEN CRCL <= 39 THEN 3 ELSE 4 END"


def replay(policy, prefix, doses="doses", rounds=7, early=False, **variant):
    """CTEs for all rounds; the result is {prefix}d{rounds} and {prefix}s{rounds}."""
    out = [f"{prefix}d0 AS MATERIALIZED (SELECT ID, CRCL, time, amt FROM {doses})",
           f"""{prefix}s0 AS MATERIALIZED (
  SELECT ID, {"2" if early else USUAL} AS dose_num, TRUE AS active, 0 AS rounds FROM cohort)"""]
    for k in range(rounds):
        p, q = f"{prefix}{{}}{k}", f"{prefix}{{}}{k + 1}"
        D, S, N, Q, O, E, X = (p.format(x) for x in "dsnqoex")
        out += [
            f"""{N} AS MATERIALIZED (
  SELECT *, row_number() OVER w AS n, lead(time) OVER w - time AS gap
  FROM {D} WINDOW w AS (PARTITION BY ID ORDER BY time))""",
            f"""{Q} AS MATERIALIZED (
  SELECT n.ID, n.CRCL, n.time AS sample_time, n.amt AS last_amt, n.gap AS last_frq, s.dose_num
  FROM {S} s JOIN {N} n ON n.ID = s.ID AND n.n = s.dose_num WHERE s.active)"""]
        if policy == "bayes":
            out += bayes_round(prefix, k, D, Q, X, early and k == 0, **variant)
        elif policy == "guideline":
            out += [
                f"{O} AS (SELECT ID, sample_time AS time FROM {Q})",
                f"""{E} AS MATERIALIZED (
  SELECT q.*, {dv('x.IPRE', 'x.ID', 'x.time')} AS conc FROM {Q} q
  JOIN {exposure(O, D, 'par')} x ON x.ID = q.ID)""",
                guideline(X, E)]
        else:
            out += [day_before(O, Q), trapezoid(E + "t", O, D),
                    f"{E} AS MATERIALIZED (SELECT q.*, t.auc24 FROM {Q} q JOIN {E}t t ON t.ID = q.ID)",
                    proportional(X, E)]
        number = "(CASE WHEN x.CRCL <= 39 THEN 3 ELSE 4 END)" if early and k == 0 else (
            "(s.dose_num + coalesce(CAST(x.wait / x.dose_frq AS INTEGER), 0))")
        out += [
            f"""{q.format('d')} AS MATERIALIZED (
  SELECT e.* FROM {D} e LEFT JOIN {X} x ON x.ID = e.ID
  WHERE x.ID IS NULL OR NOT x.changed OR e.time < x.sample_time
  UNION ALL
  SELECT ID, CRCL, sample_time + j * dose_frq, dose_amt FROM {X}, range(0, 29) r(j)
  WHERE changed AND sample_time + j * dose_frq <= 168)""",
            f"""{q.format('s')} AS MATERIALIZED (
  SELECT s.ID, {number} AS dose_num, s.active AND {number} < c.n AS active,
    s.rounds + CASE WHEN s.active THEN 1 ELSE 0 END AS rounds
  FROM {S} s LEFT JOIN {X} x ON x.ID = s.ID
  JOIN (SELECT ID, count(*) AS n FROM {q.format('d')} GROUP BY ID) c ON c.ID = s.ID)"""]
    return out


def share(column="dAUC"):
    return (f"round(avg({d(f'CASE WHEN {column} > 400 THEN 1 ELSE 0 END')}), 6) AS gt400, "
            f"round(avg({d(f'CASE WHEN {column} > 700 THEN 1 ELSE 0 END')}), 6) AS gt700, "
            f"round(avg({d(f'CASE WHEN {column} BETWEEN 400 AND 700 THEN 1 ELSE 0 END')}), 6) AS gt400lt700")


LABEL = """CASE method WHEN 'auc24' THEN 'Proportional TDM' WHEN 'bayes' THEN 'Model-Based TDM'
  WHEN 'baynl' THEN 'Model-Based w/ Loading Dose' ELSE 'SA Health Guidelines' END"""
ORDER = "CASE method WHEN 'sagov' THEN 1 WHEN 'auc24' THEN 2 WHEN 'bayes' THEN 3 ELSE 4 END"
GROUP = "'GFR - ' || CAST(CAST(CRCL AS INTEGER) AS VARCHAR) || ' mL/min'"
METHODS = "(VALUES ('sagov'), ('auc24'), ('bayes'), ('baynl')) m(method)"

LOADINGS = "(VALUES ('standard'), ('by_group')) m(method)"
POLICIES = (*BASE, dose_table("doses2", "by_group"), """finals AS MATERIALIZED (
  SELECT 'standard' AS method, * FROM doses UNION ALL SELECT 'by_group' AS method, * FROM doses2)""",
            f"par_m AS MATERIALIZED (SELECT m.method, p.* FROM par p, {LOADINGS})")


def policy_profile(points, step):
    return f"""stacked AS MATERIALIZED (
  SELECT * FROM {exposure(f'''(SELECT ID, CRCL, method, {d(f'k * {step}')} AS time
    FROM cohort, {LOADINGS}, range(0, {points}) r(k))''',
    'finals', 'par_m', ('ID', 'method'), ', CRCL')})"""


POLICY_DAILY = f"""daily AS MATERIALIZED (
  SELECT ID, CRCL, method, time / 24 AS day, method AS methodf, {GROUP} AS crclf, dAUC FROM (
    SELECT *, AUC - lag(AUC) OVER (PARTITION BY ID, method ORDER BY time) AS dAUC
    FROM stacked WHERE time IN (0, 24, 48, 72, 96, 120, 144, 168)) WHERE time <> 0)"""

# Numbered candidates of the estimation grid.
CANDIDATES = f"""candidates AS (
  SELECT s.ID, s.CRCL, {d(75)} AS WT, 0 AS DIAL, c AS cand,
    {", ".join(f"({d(digit)} - 3) * {sd(k)} AS eta{k + 1}" for k, digit in enumerate(
        ("c // 49", "(c // 7) % 7", "c % 7")))}
  FROM situation s, range(0, 343) r(c))"""


def objective(keys="ID, cand"):
    """CTEs scoring candidates on the first sample."""
    prior = " + ".join(
        f"(0.5 * ln(2 * pi()) + ln({sd(k)}) + eta{k + 1} * eta{k + 1} / (2 * {d(OMEGA[k])}))"
        for k in range(3))
    return (
        params("cand_par", "candidates", ("eta1", "eta2", "eta3"), "ID, cand, eta1, eta2, eta3"),
        "cand_obs AS (SELECT ID, cand, 36.0::DOUBLE AS time FROM candidates)",
        f"""scored AS MATERIALIZED (
  SELECT c.ID, c.cand, c.eta1, c.eta2, c.eta3,
    0.5 * ln(2 * pi()) + ln(w) + pow(conc - yhat, 2) / (2 * w * w) + {prior} AS ofv
  FROM (SELECT ID, cand, yhat, sqrt(pow(yhat * {d(0.227)}, 2) + {d(3.4)} * {d(3.4)}) AS w FROM (
      SELECT ID, cand, greatest(IPRE, {d('2.220446049250313e-16')}) AS yhat
      FROM {exposure('cand_obs', 'doses', 'cand_par', ('ID', 'cand'))})) y
  JOIN candidates c ON c.ID = y.ID AND c.cand = y.cand JOIN first_conc f ON f.ID = c.ID)""")


BEST = (*AT_FIRST, CANDIDATES, *objective(), """best AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY ofv, cand) AS place FROM scored)
  WHERE place = 1)""",
        """fitted AS (SELECT b.ID, s.CRCL, CAST(75 AS DOUBLE) AS WT, 0 AS DIAL, b.eta1, b.eta2, b.eta3
  FROM best b JOIN situation s ON s.ID = b.ID)""",
        params("est", "fitted", ("eta1", "eta2", "eta3")))

TARGET = (
    *BEST,
    "est_obs AS (SELECT ID, 36.0::DOUBLE AS time FROM situation UNION ALL SELECT ID, 12.0::DOUBLE FROM situation)",
    f"""last_day AS MATERIALIZED (
  SELECT s.*, x.auc24, CASE WHEN x.auc24 >= 800 THEN {d(24)} ELSE {d(72)} END AS wait,
    least(s.sample_time + CASE WHEN x.auc24 >= 800 THEN 24 ELSE 72 END, {d(168)}) AS next_time
  FROM situation s JOIN (
    SELECT ID, max(AUC) - min(AUC) AS auc24 FROM {exposure('est_obs', 'doses', 'est')} GROUP BY ID) x
  ON x.ID = s.ID)""",
    "past AS (SELECT * FROM doses WHERE time < 36)",
    """window_obs AS (SELECT ID, next_time AS time FROM last_day
  UNION ALL SELECT ID, next_time - 24 FROM last_day)""",
    f"""need AS MATERIALIZED (
  SELECT l.*, 500 - x.history AS need FROM last_day l JOIN (
    SELECT ID, max(AUC) - min(AUC) AS history FROM {exposure('window_obs', 'past', 'est')} GROUP BY ID) x
  ON x.ID = l.ID)""",
    f"""added AS MATERIALIZED (
  SELECT ID, amt, sum({single_auc('(next_time - begun)')} - {single_auc('(next_time - 24 - begun)')}) AS auc FROM (
    SELECT n.ID, n.next_time, {d('c * 250')} AS amt, {hours(d('c * 250'))} AS T,
      n.sample_time + j * n.last_frq AS begun, e.VC, e.a, e.b, e.k21
    FROM need n JOIN est e ON e.ID = n.ID, range(1, 21) r(c), range(0, 29) f(j)
    WHERE n.sample_time + j * n.last_frq < n.next_time)
  GROUP BY ID, amt)""",
    """hit AS MATERIALIZED (
  SELECT n.ID, min(a.amt) AS amt FROM need n JOIN added a ON a.ID = n.ID AND a.auc >= n.need GROUP BY n.ID)""")
GATE = "(n.auc24 < 400 OR n.auc24 >= 550 OR n.last_amt = 0)"


def quantiles(levels):
    out = []
    for level in levels:
        for side, p in (("lo", (1 - level) / 2), ("hi", (1 + level) / 2)):
            out.append((f"ci{round(level * 100)}{side}", round(p, 6)))
    return out


def hours_since(ts, first):
    return f"((epoch_us({ts}) - epoch_us({first})) / {d(1000000)} / {d(3600)})"


USER_SAMPLES = f"""samples AS MATERIALIZED (
  SELECT user_id AS ID, event_id, value AS DV,
    {hours_since('ts', 'min(ts) OVER (PARTITION BY user_id)')} AS time FROM events)"""
ORDER_DOSES = f"""order_doses AS MATERIALIZED (
  SELECT o_custkey AS ID, o_orderkey AS dose_id, {hours_since('o_orderdate', "TIMESTAMP '1995-01-01'")} AS time,
    {d('(o_orderkey % 8 + 1) * 250')} AS amt FROM orders)"""
DAILY_INDUCTION = f"""daily AS (
  SELECT ID, CRCL, time / 24 AS day, dAUC FROM (
    SELECT *, AUC - lag(AUC) OVER (PARTITION BY ID ORDER BY time) AS dAUC
    FROM {exposure('days', 'doses', 'par', extra=', CRCL')}) WHERE time <> 0)"""
BODIES = f"""bodies AS (
  SELECT c_custkey + 1 AS ID, {d('40 + c_custkey % 160')} AS umol, {d('18 + c_custkey % 70')} AS age,
    c_custkey % 2 AS sex, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS black,
    {d('45 + c_custkey % 60')} AS wt, {d('145 + c_custkey % 55')} AS ht FROM customer)"""

ORACLES = {}
ORACLES["scan_cohort"] = "SELECT c_custkey + 1 AS ID, c_nationkey AS nation, c_acctbal AS balance FROM customer"
ORACLES["profile_roundtrip"] = with_(COHORT, PAR, DOSES, dose_table("doses2", "by_group"), grid()) + f"""
SELECT ID, 'standard' AS method, time, round(IPRE, 6) AS IPRE, round(AUC, 3) AS AUC, round(PERI, 4) AS PERI
FROM {exposure('grid', 'doses', 'par')}
UNION ALL SELECT ID, 'by_group', time, round(IPRE, 6), round(AUC, 3), round(PERI, 4)
FROM {exposure('grid', 'doses2', 'par')}"""
ORACLES["cohort_build"] = with_(COHORT) + """
SELECT ID, WT, CRCL, DIAL, round(ETA1, 9) AS ETA1, round(ETA2, 9) AS ETA2, round(ETA3, 9) AS ETA3 FROM cohort"""
ORACLES["time_grid"] = with_(USER_SAMPLES) + f"""
SELECT ID, {d('k * 24')} AS time FROM (SELECT ID, max(time) AS span FROM samples GROUP BY ID), range(0, 40) r(k)
WHERE k * 24 <= span"""
ORACLES["event_grid"] = with_(COHORT, grid()) + f"""
SELECT ID, time, {d(0)} AS amt, 1 AS cmt, 0 AS evid, 0 AS rate FROM grid"""
ORACLES["dose_schedule"] = with_(COHORT, DOSES, grid()) + """
SELECT g.ID, g.time, coalesce(d.amt, 0) AS amt, 1 AS cmt, CASE WHEN d.ID IS NULL THEN 0 ELSE 1 END AS evid,
  CASE WHEN d.ID IS NULL THEN 0 ELSE -2 END AS rate
FROM grid g LEFT JOIN doses d ON d.ID = g.ID AND d.time = g.time"""
ORACLES["loading_dose"] = with_(COHORT, DOSES) + "SELECT ID, time, amt FROM doses"
ORACLES["loading_dose_by_group"] = with_(COHORT, dose_table(loading="by_group")) + "SELECT ID, time, amt FROM doses"
ORACLES["bind_by_key"] = with_(COHORT, DOSES, grid()) + f"""
SELECT ID, time, amt, {eps(0)} AS EPS1, {eps(1)} AS EPS2 FROM (
  SELECT g.ID, g.time, coalesce(d.amt, 0) AS amt FROM grid g LEFT JOIN doses d ON d.ID = g.ID AND d.time = g.time)"""
ORACLES["filter_dose_events"] = with_(COHORT, DOSES) + """
SELECT ID, time, amt FROM doses WHERE time >= 24 AND (amt < 1000 OR CRCL = 100)"""
ORACLES["filter_day_boundaries"] = with_(COHORT, DOSES, DAYS) + """
SELECT g.ID, g.time, CASE WHEN d.ID IS NULL THEN 0 ELSE 1 END AS evid
FROM days g LEFT JOIN doses d ON d.ID = g.ID AND d.time = g.time"""
ORACLES["mask_unsampled"] = with_(*BASE, NUMBERED, SITUATION, MEASURED) + """
SELECT m.ID, m.time, CASE WHEN m.time = s.sample_time THEN round(m.DV, 6) END AS DV
FROM measured m JOIN situation s ON s.ID = m.ID"""
ORACLES["cohort_subset"] = with_(COHORT) + """
SELECT ID, CRCL FROM cohort WHERE ID BETWEEN 1 AND 100 OR ID BETWEEN 1001 AND 1100
  OR ID BETWEEN 2001 AND 2100 OR ID BETWEEN 3001 AND 3100"""
ORACLES["dose_interval"] = with_(ORDER_DOSES) + """
SELECT ID, count(DISTINCT gap) AS n_gaps, min(gap) AS min_gap, max(gap) AS max_gap, count(*) AS n_pairs FROM (
  SELECT ID, lead(time) OVER (PARTITION BY ID ORDER BY time, dose_id) - time AS gap FROM order_doses)
WHERE gap IS NOT NULL GROUP BY ID"""
ORACLES["attach_covariates"] = with_(COHORT, DOSES) + """
SELECT d.ID, d.time, d.amt, c.WT, c.CRCL, c.DIAL, round(c.ETA1, 9) AS ETA1, round(c.ETA2, 9) AS ETA2,
  round(c.ETA3, 9) AS ETA3 FROM doses d JOIN cohort c ON c.ID = d.ID"""
ORACLES["exposure_profile"] = with_(*BASE, grid()) + f"""
SELECT ID, time, round(IPRE, 6) AS IPRE, round(AUC, 3) AS AUC, round(PERI, 4) AS PERI
FROM {exposure('grid', 'doses', 'par')}"""
ORACLES["exposure_long_history"] = with_(
    COHORT, PAR, USER_SAMPLES, ORDER_DOSES,
    "given AS (SELECT ID + 1 AS ID, time, amt FROM order_doses)",
    "obs AS (SELECT ID + 1 AS ID, time * 80 AS time, event_id FROM samples)") + f"""
SELECT ID, event_id, round(IPRE, 6) AS IPRE, round(AUC, 3) AS AUC
FROM {exposure('obs', 'given', 'par', extra=', event_id')}"""
ORACLES["sampled_observations"] = with_(*BASE, NUMBERED, SITUATION, MEASURED) + """
SELECT m.ID, m.time, round(m.DV, 6) AS DV FROM measured m SEMI JOIN situation s
ON s.ID = m.ID AND s.sample_time = m.time"""
ORACLES["last_dose_lookup"] = with_(COHORT, DOSES, NUMBERED, SITUATION) + """
SELECT ID, sample_time, last_amt, last_frq FROM situation"""
ORACLES["guideline_dose"] = with_(*AT_FIRST, guideline("decided", "first_conc")) + """
SELECT ID, sample_time, round(conc, 6) AS conc, dose_amt, dose_frq, wait FROM decided"""
ORACLES["median_profile"] = with_(*BASE, grid()) + f"""
SELECT time, CRCL, round(quantile_cont(IPRE, 0.5), 6) AS median
FROM {exposure('grid', 'doses', 'par', extra=', CRCL')} GROUP BY time, CRCL"""
ORACLES["ci90_band"] = with_(*BASE, grid()) + f"""
SELECT time, CRCL, round(quantile_cont(IPRE, 0.05), 6) AS ci90lo, round(quantile_cont(IPRE, 0.95), 6) AS ci90hi
FROM {exposure('grid', 'doses', 'par', extra=', CRCL')} GROUP BY time, CRCL"""
ORACLES["ci_family"] = "SELECT event_type, " + ", ".join(
    f"round(quantile_cont(value, {p}), 6) AS {name}"
    for name, p in quantiles((0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95))
) + " FROM events GROUP BY event_type"
ORACLES["pta_by_method"] = with_(*POLICIES, policy_profile(8, 24), POLICY_DAILY) + f"""
SELECT day, method, methodf, {share()} FROM daily GROUP BY day, method, methodf"""
ORACLES["pta_by_method_crcl"] = with_(*POLICIES, policy_profile(8, 24), POLICY_DAILY) + f"""
SELECT day, method, methodf, crclf, {share()} FROM daily GROUP BY day, method, methodf, crclf"""
ORACLES["pta_by_crcl"] = with_(*BASE, DAYS, DAILY_INDUCTION) + f"""
SELECT day, CRCL, {share()} FROM daily GROUP BY day, CRCL"""
ORACLES["trapezoid_auc24"] = with_(
    *BASE, NUMBERED, SITUATION, day_before("near", "situation"), trapezoid("t", "near", "doses")
) + "SELECT ID, round(auc24, 6) AS auc24 FROM t"
ORACLES["trapezoid_series"] = with_(USER_SAMPLES) + """
SELECT ID, round(sum(coalesce((DV + v0) * (time - t0) / 2, 0)), 4) AS auc24 FROM (
  SELECT ID, DV, time, lag(DV) OVER w AS v0, lag(time) OVER w AS t0 FROM samples
  WHERE time BETWEEN 24 AND 600 WINDOW w AS (PARTITION BY ID ORDER BY time, event_id)) GROUP BY ID"""
ORACLES["dose_count"] = with_(COHORT, DOSES) + """
SELECT ID, count(*) AS n_doses, CAST(673 AS BIGINT) AS n_rows FROM doses GROUP BY ID"""
ORACLES["map_objective"] = with_(*AT_FIRST, f"""candidates AS (
  SELECT s.ID, s.CRCL, {d(75)} AS WT, 0 AS DIAL, CAST(c AS INTEGER) AS cand,
    {", ".join(f"CASE c WHEN {2 * k + 1} THEN -{sd(k)} WHEN {2 * k + 2} THEN {sd(k)} ELSE 0 END AS eta{k + 1}"
               for k in range(3))}
  FROM situation s, range(0, 7) r(c))""", *objective()) + "SELECT ID, cand, round(ofv, 6) AS ofv FROM scored"
ORACLES["nest_unnest"] = with_(COHORT, DOSES) + """
SELECT ID, CAST(floor(time / 24) AS BIGINT) AS block,
  CAST(count(*) OVER (PARTITION BY ID, floor(time / 24)) AS INTEGER) AS n,
  time, amt, 1 AS evid, -2 AS rate FROM doses"""
ORACLES["daily_auc"] = with_(*BASE, DAYS, DAILY_INDUCTION) + "SELECT ID, CRCL, day, round(dAUC, 4) AS dAUC FROM daily"
ORACLES["auc_last24"] = with_(
    *BASE, NUMBERED, SITUATION,
    "ends AS (SELECT ID, sample_time AS time FROM situation UNION ALL SELECT ID, sample_time - 24 FROM situation)"
) + f"""
SELECT s.ID, s.sample_time, round(x.auc24, 4) AS auc24 FROM situation s JOIN (
  SELECT ID, max(AUC) - min(AUC) AS auc24 FROM {exposure('ends', 'doses', 'par')} GROUP BY ID) x ON x.ID = s.ID"""
ORACLES["nth_dose_time"] = with_(ORDER_DOSES) + """
SELECT ID, time, dose_id FROM (
  SELECT *, row_number() OVER (PARTITION BY ID ORDER BY time, dose_id) AS n FROM order_doses) WHERE n = 4"""
ORACLES["final_time"] = with_(ORDER_DOSES) + """
SELECT ID, time, dose_id, amt FROM (
  SELECT *, row_number() OVER (PARTITION BY ID ORDER BY time DESC, dose_id DESC) AS n FROM order_doses) WHERE n = 1"""
ORACLES["first_events"] = with_(*BASE, grid()) + f"""
SELECT x.ID, x.time, coalesce(d.amt, 0) AS amt, round({dv('x.IPRE', 'x.ID', 'x.time')}, 6) AS DV
FROM {exposure('grid', 'doses', 'par')} x LEFT JOIN doses d ON d.ID = x.ID AND d.time = x.time
ORDER BY x.ID, x.time LIMIT 6"""
ORACLES["label_methods"] = with_(COHORT) + f"""
SELECT ID, CRCL, method, {LABEL} AS methodf, {ORDER} AS sort_order, {GROUP} AS crclf FROM cohort, {METHODS}"""
ORACLES["ordered_labels"] = with_(COHORT) + f"""
SELECT {ORDER} AS sort_order, method, {LABEL} AS methodf, CRCL, {GROUP} AS crclf, count(*) AS n
FROM cohort, {METHODS} GROUP BY ALL ORDER BY sort_order, CRCL"""
ORACLES["stack_methods"] = with_(COHORT, DOSES, dose_table("doses2", "by_group")) + """
SELECT ID, time, amt, CRCL, 'standard' AS method FROM doses
UNION ALL SELECT ID, time, amt, NULL, 'by_group' FROM doses2"""
ORACLES["round_up_dose"] = f"""
SELECT o_orderkey AS ID, {d('ceil(o_totalprice / 100 / 250) * 250')} AS dose FROM orders"""
ORACLES["clamp_prediction"] = f"""
SELECT event_id, kept = {d('2.220446049250313e-16')} AS floored, round(kept, 6) AS kept FROM (
  SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 2) OR value - 10 < {d('2.220446049250313e-16')}
    THEN {d('2.220446049250313e-16')} ELSE value - 10 END AS kept FROM events)"""
ORACLES["normal_logpdf"] = """
SELECT event_id, round(-0.5 * ln(2 * pi()) - ln(s) - pow(value - m, 2) / (2 * s * s), 6) AS logpdf FROM (
  SELECT event_id, value, 20 + event_id % 10 AS m, CAST(5 + event_id % 3 AS DOUBLE) AS s FROM events)"""
ORACLES["error_sd"] = f"""
SELECT event_id, round(sqrt(pow(value * {d(0.227)}, 2) + {d(3.4)} * {d(3.4)}), 6) AS combined,
  {d(3.4)} AS additive, round(value * {d(0.227)}, 6) AS proportional FROM events"""
ORACLES["individual_parameters"] = with_(COHORT, PAR) + """
SELECT ID, round(COVCL, 9) AS COVCL, round(COVVC, 9) AS COVVC, round(CL, 9) AS CL, round(VC, 9) AS VC,
  round(VP, 9) AS VP, Q FROM par"""
ORACLES["infusion_duration"] = f"""
SELECT ID, round({hours('amt')}, 9) AS effective,
  round(CASE WHEN amt > 1000 AND amt <= 1500 THEN {d(1.5)} ELSE {hours('amt')} END, 9) AS intended
FROM (SELECT o_orderkey AS ID, o_totalprice / 100 AS amt FROM orders)"""
ORACLES["observed_concentration"] = with_(*BASE, grid()) + f"""
SELECT ID, time, round(IPRE, 6) AS IPRE, round({dv()}, 6) AS DV FROM {exposure('grid', 'doses', 'par')}"""
ORACLES["full_profile"] = with_(*BASE, grid()) + f"""
SELECT x.ID, x.time, c.CRCL, c.WT, c.DIAL, round(p.COVCL, 9) AS COVCL, round(p.COVVC, 9) AS COVVC,
  round(p.CL, 9) AS CL, round(p.VC, 9) AS VC, round(p.VP, 9) AS VP, p.Q, round(c.ETA1, 9) AS ETA1,
  round(c.ETA2, 9) AS ETA2, round(c.ETA3, 9) AS ETA3, round(IPRE, 6) AS IPRE, round(AUC, 3) AS AUC,
  round(PERI, 4) AS PERI, round(PERI / p.VP, 6) AS C2, round(IPRE * p.VC, 4) AS CENT,
  {eps(0, 'x.ID', 'x.time')} AS EPS1, {eps(1, 'x.ID', 'x.time')} AS EPS2,
  round({dv('x.IPRE', 'x.ID', 'x.time')}, 6) AS DV
FROM {exposure('grid', 'doses', 'par')} x JOIN par p ON p.ID = x.ID JOIN cohort c ON c.ID = x.ID"""
ORACLES["ckd_epi"] = with_(BODIES) + f"""
SELECT ID, round(141 * pow(least(scr / k, 1), CASE WHEN sex = 1 THEN {d(-0.411)} ELSE {d(-0.329)} END)
  * pow(greatest(scr / k, 1), {d(-1.209)}) * pow({d(0.993)}, age) * pow({d(1.018)}, 1 - sex)
  * pow({d(1.159)}, black), 6) AS egfr
FROM (SELECT *, umol / {d(88.4)} AS scr, CASE WHEN sex = 1 THEN {d(0.9)} ELSE {d(0.7)} END AS k FROM bodies)"""
ORACLES["bmi"] = with_(BODIES) + """
SELECT ID, round(wt / pow(ht / 100, 2), 6) AS bmi_cm, round(wt / pow(ht / 100, 2), 6) AS bmi_m FROM bodies"""
ORACLES["bsa"] = with_(BODIES) + f"""
SELECT ID, round({d(0.007184)} * pow(ht, {d(0.725)}) * pow(wt, {d(0.425)}), 6) AS bsa FROM bodies"""
ORACLES["map_grid_estimate"] = with_(*BEST) + """
SELECT ID, round(eta1, 9) AS eta1, round(eta2, 9) AS eta2, round(eta3, 9) AS eta3, round(ofv, 6) AS ofv FROM best"""
ORACLES["map_refinement"] = with_(COHORT, DOSES, NUMBERED, SITUATION) + """
SELECT ID, TRUE AS better, TRUE AS agrees FROM situation"""
PRIOR = " + ".join(
    f"(0.5 * ln(2 * pi() * {d(OMEGA[i])}) + eta{i + 1} * eta{i + 1} / (2 * {d(OMEGA[i])}))" for i in range(3))
HISTORY = (
    COHORT, USER_SAMPLES, ORDER_DOSES, ALL_CANDIDATES,
    params("all_par", "all_candidates", ("eta1", "eta2", "eta3"), "ID, cand"),
    "given AS (SELECT ID + 1 AS ID, time, amt FROM order_doses)",
    "seen AS MATERIALIZED (SELECT ID + 1 AS ID, time * 80 AS time, event_id, DV FROM samples)")
LIKELIHOOD = "0.5 * ln(2 * pi()) + ln(w) + pow(DV - yhat, 2) / (2 * w * w)"
ERROR_SD = f"sqrt(pow(yhat * {d(0.227)}, 2) + {d(3.4)} * {d(3.4)}) AS w"
FLOOR = d("2.220446049250313e-16")
SEEN_UNDER_ALL = (
    """obs AS (SELECT c.ID, c.cand, s.time, s.event_id FROM seen s JOIN all_candidates c ON c.ID = s.ID)""",
    f"""each_misfit AS MATERIALIZED (
  SELECT ID, cand, event_id, time, IPRE, {LIKELIHOOD} AS misfit FROM (SELECT *, {ERROR_SD} FROM (
    SELECT x.ID, x.cand, x.event_id, x.time, s.DV, x.IPRE, greatest(x.IPRE, {FLOOR}) AS yhat
    FROM {exposure('obs', 'given', 'all_par', ('ID', 'cand'), ', event_id')} x
    JOIN seen s ON s.ID = x.ID AND s.event_id = x.event_id)))""",
    """fits AS MATERIALIZED (
  SELECT ID, cand, sum(misfit) AS misfit, count(*) AS n_samples FROM each_misfit GROUP BY ID, cand)""",
    f"""rated AS MATERIALIZED (SELECT c.ID, c.cand, c.eta1, c.eta2, c.eta3, f.n_samples, f.misfit + {PRIOR} AS ofv
  FROM all_candidates c JOIN fits f ON f.ID = c.ID AND f.cand = c.cand)""")
ORACLES["map_grid_history"] = with_(*HISTORY, *SEEN_UNDER_ALL) + """
SELECT ID, n_samples, round(eta1, 9) AS eta1, round(eta2, 9) AS eta2, round(eta3, 9) AS eta3, round(ofv, 4) AS ofv
FROM (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY ofv, cand) AS place FROM rated) WHERE place = 1"""


def lattice_search(pairs):
    """Recursive CTE ``lattice``: 27 points around the best grid point, again and again, to single steps.

    ``pairs`` is (ID, sample, DV, tau, T, r): every sample with every earlier dose, once with nulls without one.
    """
    at = ", ".join(f"(n{k + 1} + {digit} * step) * {sd(k)} / 256 AS eta{k + 1}"
                   for k, digit in enumerate(("(c // 9 - 1)", "(c // 3 % 3 - 1)", "(c % 3 - 1)")))
    points = f"""SELECT l.ID, l.n1, l.n2, l.n3, l.step, c AS cand, {at}, h.CRCL, h.WT, h.DIAL
      FROM lattice l JOIN cohort h ON h.ID = l.ID, range(0, 27) r(c) WHERE l.step > 0"""
    source = params("x", f"({points})", ("eta1", "eta2", "eta3"), "ID, cand, n1, n2, n3, step, eta1, eta2, eta3")
    source = source[len("x AS MATERIALIZED "):]
    part = ("r / VC * ({share}) / (a - b) / {e} * (1 - exp(-{e} * least(tau, T))) * exp(-{e} * greatest(tau - T, 0))")
    both = f"{part.format(e='a', share='a - k21')} + {part.format(e='b', share='k21 - b')}"
    keys = "ID, cand, n1, n2, n3, step, eta1, eta2, eta3"
    return f"""lattice AS (
  SELECT ID, ((cand // 49) - 3) * 256 AS n1, ((cand // 7) % 7 - 3) * 256 AS n2, (cand % 7 - 3) * 256 AS n3,
    CAST(128 AS BIGINT) AS step, ofv
  FROM (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY ofv, cand) AS place FROM rated) WHERE place = 1
  UNION ALL
  SELECT ID, n1 + (cand // 9 - 1) * step, n2 + (cand // 3 % 3 - 1) * step, n3 + (cand % 3 - 1) * step,
    CASE WHEN cand = 13 THEN step // 2 ELSE step END, ofv
  FROM (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY ofv, cand <> 13, cand) AS place FROM (
    SELECT {keys}, sum({LIKELIHOOD}) + {PRIOR} AS ofv FROM (SELECT *, {ERROR_SD} FROM (
      SELECT {keys}, sample, DV, greatest(coalesce(sum({both}), 0), {FLOOR}) AS yhat
      FROM {source} JOIN ({pairs}) USING (ID) GROUP BY {keys}, sample, DV))
    GROUP BY {keys})) WHERE place = 1)"""


ORACLES["map_history"] = with_(
    *HISTORY, *SEEN_UNDER_ALL,
    f"""pairs AS MATERIALIZED (
  SELECT ID, sample, DV, tau, T, amt / T AS r FROM (
    SELECT s.ID, s.event_id AS sample, s.DV, s.time - e.time AS tau, e.amt, {hours('e.amt')} AS T
    FROM seen s LEFT JOIN given e ON e.ID = s.ID AND e.time < s.time))""",
    lattice_search("SELECT * FROM pairs")).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
SELECT l.ID, n_samples, round(n1 * {sd(0)} / 256, 12) AS eta1, round(n2 * {sd(1)} / 256, 12) AS eta2,
  round(n3 * {sd(2)} / 256, 12) AS eta3, round(ofv, 4) AS ofv
FROM lattice l JOIN (SELECT ID, min(n_samples) AS n_samples FROM fits GROUP BY ID) f ON f.ID = l.ID WHERE l.step = 0"""


RUNNING = f"""running AS MATERIALIZED (
  SELECT m.ID, m.event_id, m.cand, m.time, m.IPRE, row_number() OVER w - 1 AS n_before,
    coalesce(sum(m.misfit) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {PRIOR} AS ofv_before,
    sum(m.misfit) OVER (w ROWS UNBOUNDED PRECEDING) + {PRIOR} AS ofv
  FROM each_misfit m JOIN all_candidates c ON c.ID = m.ID AND c.cand = m.cand
  WINDOW w AS (PARTITION BY m.ID, m.cand ORDER BY m.time, m.event_id))"""
ORACLES["ebe_history"] = with_(*HISTORY, *SEEN_UNDER_ALL[:2], RUNNING) + """
SELECT ID, event_id AS key, n_before, CAST(cand AS INTEGER) AS cand_before, round(IPRE, 6) AS IPRE FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ofv_before, cand) AS place FROM running) WHERE place = 1"""
HISTORY_AUC = single_auc("({at} - begun)")
ORACLES["target_history"] = with_(
    *HISTORY, *SEEN_UNDER_ALL[:2], RUNNING,
    """est AS MATERIALIZED (
  SELECT r.event_id, r.time, p.* FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ofv, cand) AS place FROM running) r
  JOIN all_par p ON p.ID = r.ID AND p.cand = r.cand WHERE r.place = 1)""",
    f"""past AS MATERIALIZED (
  SELECT e.*, g.time AS begun, g.amt, {hours('g.amt')} AS T FROM est e LEFT JOIN given g ON g.ID = e.ID AND g.time < e.time)""",
    f"""day AS MATERIALIZED (
  SELECT event_id, arg_max(amt, (begun, amt)) AS last_amt, CASE WHEN min(time) < 24
    THEN 2 * coalesce(sum({HISTORY_AUC.format(at='time')}), 0)
    ELSE coalesce(sum({HISTORY_AUC.format(at='time')} - {HISTORY_AUC.format(at='(time - 24)')}), 0) END AS auc24
  FROM past GROUP BY event_id)""",
    f"""need AS MATERIALIZED (
  SELECT event_id, auc24, last_amt, wait, 500 - coalesce(sum(
    {HISTORY_AUC.format(at='(time + wait)')} - {HISTORY_AUC.format(at='(time + wait - 24)')}), 0) AS need
  FROM (SELECT p.*, d.auc24, coalesce(d.last_amt, 0) AS last_amt, {d('CASE WHEN d.auc24 >= 800 THEN 24 ELSE 72 END')} AS wait
    FROM past p JOIN day d ON d.event_id = p.event_id)
  GROUP BY event_id, auc24, last_amt, wait)""",
    f"""added AS MATERIALIZED (
  SELECT event_id, amt, sum({single_auc('(wait - begun)')} - {single_auc('(wait - 24 - begun)')}) AS auc FROM (
    SELECT e.event_id, n.wait, {d('c * 250')} AS amt, {hours(d('c * 250'))} AS T,
      {d('j * CASE WHEN h.CRCL <= 39 THEN 24 ELSE 12 END')} AS begun, e.VC, e.a, e.b, e.k21
    FROM need n JOIN est e ON e.event_id = n.event_id JOIN cohort h ON h.ID = e.ID, range(1, 21) r(c), range(0, 6) f(j))
  WHERE begun < wait GROUP BY event_id, amt)""",
    """hit AS (SELECT n.event_id, min(a.amt) AS amt FROM need n
  JOIN added a ON a.event_id = n.event_id AND a.auc >= n.need GROUP BY n.event_id)""") + """
SELECT e.ID, n.event_id AS key, round(n.auc24, 3) AS auc24, n.wait,
  CASE WHEN n.auc24 >= 400 AND n.auc24 < 550 AND n.last_amt <> 0 THEN n.last_amt
    WHEN n.need <= 0 THEN 0 ELSE coalesce(h.amt, 5000) END AS dose_amt
FROM need n JOIN est e ON e.event_id = n.event_id LEFT JOIN hit h ON h.event_id = n.event_id"""


def uniform_draw(key):
    return f"((CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT) + {d(0.5)}) / {d(2 ** 52)})"


def normal_draw(*parts):
    key = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    radius, angle = (uniform_draw(f"{key} || ':{part}'") for part in ("radius", "angle"))
    return f"(sqrt(-2 * ln({radius})) * cos(2 * pi() * {angle}))"


def first_inside(value, inside, names, source):
    """Of numbered attempts the first inside the bounds, per patient."""
    picked = ", ".join(f"round(arg_min({n}, attempt), 9) AS {n}" for n in names)
    return f"""(SELECT ID, {picked} FROM (
    SELECT ID, attempt, {value} FROM {source}, range(1, 101) r(attempt)) WHERE {inside} GROUP BY ID)"""


def log_sd(mean, deviation):
    return f"sqrt(ln({d(deviation)} * {d(deviation)} / ({d(mean)} * {d(mean)}) + 1))"


ORACLES["draw_etas"] = with_(COHORT) + "SELECT ID, CRCL, " + ", ".join(
    f"round({normal_draw('ID', 123456, k + 1)} * {sd(k)}, 9) AS ETA{k + 1}" for k in range(3)) + " FROM cohort"
ORACLES["draw_eps"] = with_(COHORT, DOSES, grid()) + f"""
SELECT ID, time, amt, {", ".join(
    f"round({normal_draw('ID', 'CAST(round(time * 1000000) AS BIGINT)', 123456, k)}, 9) AS EPS{k}" for k in (1, 2))}
FROM (SELECT g.ID, g.time, coalesce(d.amt, 0) AS amt FROM grid g LEFT JOIN doses d ON d.ID = g.ID AND d.time = g.time)"""
ORACLES["trunc_normal_draw"] = with_(COHORT) + f"""
SELECT a.ID, a.wt, b.crcl
FROM {first_inside(f"{normal_draw('ID', 1, 'attempt')} * 20 + {d(79)} AS wt", "wt BETWEEN 33 AND 255", ["wt"], "cohort")} a
JOIN {first_inside(f"exp({normal_draw('ID', 2, 'attempt')} * {log_sd(62, 40)} + ln({d(62 * 62)} / sqrt({d(40 * 40 + 62 * 62)}))) AS crcl",
                   "crcl BETWEEN 4 AND 150", ["crcl"], "cohort")} b ON b.ID = a.ID"""
ORACLES["trunc_mvn_draw"] = with_(COHORT) + f"""
SELECT ID, x1, x2 FROM {first_inside(
    f"exp({normal_draw('ID', 3, 'attempt', 0)} * {log_sd(79, 20)}) * 79 AS x1, "
    f"exp(({normal_draw('ID', 3, 'attempt', 0)} * {d(0.5)} + {normal_draw('ID', 3, 'attempt', 1)} * sqrt({d(0.75)})) "
    f"* {log_sd(170, 10)}) * 170 AS x2",
    "x1 BETWEEN 33 AND 255 AND x2 BETWEEN 140 AND 210", ["x1", "x2"], "cohort")}"""
ORACLES["ebe_profile"] = with_(*BEST, grid(), "upto AS (SELECT ID, time FROM grid WHERE time <= 36)") + f"""
SELECT ID, time, round(IPRE, 6) AS IPRE, round(AUC, 3) AS AUC FROM {exposure('upto', 'doses', 'est')}"""
ORACLES["proportional_dose"] = with_(
    *BASE, NUMBERED, SITUATION, day_before("near", "situation"), trapezoid("t", "near", "doses"),
    "seen AS (SELECT s.*, t.auc24 FROM situation s JOIN t ON t.ID = s.ID)", proportional("decided", "seen")
) + "SELECT ID, round(auc24, 6) AS auc24, dose_amt, dose_frq, wait FROM decided"
ORACLES["target_auc_dose"] = with_(*TARGET) + f"""
SELECT n.ID, round(n.auc24, 4) AS auc24, n.wait, n.next_time,
  CASE WHEN NOT {GATE} THEN n.last_amt WHEN n.need <= 0 THEN 0 ELSE coalesce(h.amt, 5000) END AS dose_amt
FROM need n LEFT JOIN hit h ON h.ID = n.ID"""
ORACLES["target_auc_dose_exact"] = with_(
    *TARGET,
    """bracket AS MATERIALIZED (
  SELECT n.ID, n.next_time, n.need, n.sample_time, n.last_frq, h.amt, a.auc FROM need n JOIN hit h ON h.ID = n.ID
  JOIN added a ON a.ID = n.ID AND a.amt = h.amt)""",
    halving("halved", "bracket", "est")).replace("WITH ", "WITH RECURSIVE ", 1) + f"""
SELECT ID, auc24, wait, next_time, round(CASE WHEN kept THEN last_amt WHEN need <= 0 THEN 0
    WHEN amt IS NULL THEN 5000 WHEN exact < 1 THEN 0 ELSE exact END, 4) AS dose_amt
FROM (
  SELECT n.ID, round(n.auc24, 4) AS auc24, n.wait, n.next_time, NOT {GATE} AS kept, n.last_amt, n.need, b.amt,
    CASE WHEN b.amt <= 2000 THEN greatest(b.amt - 250, b.amt * n.need / b.auc) ELSE x.high END AS exact
  FROM need n LEFT JOIN bracket b ON b.ID = n.ID LEFT JOIN halved x ON x.ID = n.ID AND x.k = 60)"""
ORACLES["regimen_rewrite"] = with_(*AT_FIRST, guideline("decided", "first_conc"), grid()) + """
SELECT g.ID, g.time, coalesce(n.amt, 0) AS amt, CASE WHEN n.ID IS NULL THEN 0 ELSE 1 END AS evid,
  CASE WHEN n.amt <> 0 THEN -2 ELSE 0 END AS rate
FROM grid g LEFT JOIN (
  SELECT d.ID, d.time, d.amt FROM doses d JOIN decided x ON x.ID = d.ID WHERE NOT x.changed OR d.time < x.sample_time
  UNION ALL SELECT ID, sample_time + j * dose_frq, dose_amt FROM decided, range(0, 29) r(j)
  WHERE changed AND sample_time + j * dose_frq <= 168) n ON n.ID = g.ID AND n.time = g.time"""
ORACLES["dose_update"] = with_(COHORT, DOSES) + """
SELECT ID, time, CASE WHEN time >= 72 THEN 1250 ELSE amt END AS amt, 1 AS evid FROM doses"""
ORACLES["first_sample"] = f"""
SELECT ID, CRCL, {d('CASE WHEN CRCL < 20 THEN NULL WHEN CRCL <= 39 THEN 3 ELSE 4 END')} AS dose_num,
  {d('CASE WHEN CRCL < 20 THEN NULL ELSE 2 END')} AS early_num, CASE WHEN CRCL < 20 THEN 1 ELSE 0 END AS rejected
FROM (SELECT c_custkey + 1 AS ID, 10 + (c_custkey * 37 % 1200) / {d(10)} AS CRCL FROM customer)"""
ORACLES["next_sample"] = with_(*BASE, *replay("guideline", "g_", rounds=1)) + """
SELECT x.ID, x.wait, CAST(s.dose_num AS INTEGER) AS dose_num, CAST(c.n AS INTEGER) AS n_doses,
  CASE WHEN s.active THEN 1 ELSE 0 END AS again
FROM g_x0 x JOIN g_s1 s ON s.ID = x.ID
JOIN (SELECT ID, count(*) AS n FROM g_d1 GROUP BY ID) c ON c.ID = x.ID"""
ORACLES["replay_guideline"] = with_(*BASE, *replay("guideline", "g_")) + """
SELECT d.ID, s.rounds, d.time, d.amt FROM g_d7 d JOIN g_s7 s ON s.ID = d.ID"""
ORACLES["replay_proportional"] = with_(*BASE, *replay("proportional", "p_")) + """
SELECT d.ID, s.rounds, d.time, d.amt FROM p_d7 d JOIN p_s7 s ON s.ID = d.ID"""
ORACLES["replay_bayes_grid"] = with_(
    *BASE, ALL_CANDIDATES, params("all_par", "all_candidates", ("eta1", "eta2", "eta3"), "ID, cand"),
    *replay("bayes", "b_")) + """
SELECT d.ID, s.rounds, d.time, d.amt FROM b_d7 d JOIN b_s7 s ON s.ID = d.ID"""
ORACLES["replay_bayes_grid_early"] = with_(
    *BASE, ALL_CANDIDATES, params("all_par", "all_candidates", ("eta1", "eta2", "eta3"), "ID, cand"),
    *replay("bayes", "b_", rounds=8, early=True)) + """
SELECT d.ID, s.rounds, d.time, d.amt FROM b_d8 d JOIN b_s8 s ON s.ID = d.ID"""
for _name, _variant in (
        ("noround", {"exact": True}), ("alwaysopt", {"exact": True, "gate": False}),
        ("peak_trough", {"exact": True, "gate": False, "pairs": True})):
    ORACLES[f"replay_bayes_grid_{_name}"] = with_(
        *BASE, ALL_CANDIDATES, params("all_par", "all_candidates", ("eta1", "eta2", "eta3"), "ID, cand"),
        *replay("bayes", "b_", rounds=8, early=True, **_variant)).replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT d.ID, s.rounds, d.time, round(d.amt, 3) AS amt FROM b_d8 d JOIN b_s8 s ON s.ID = d.ID"""
ORACLES["replay_bayes_grid_newload"] = with_(
    *BASE, dose_table("doses2", "by_group"), ALL_CANDIDATES,
    params("all_par", "all_candidates", ("eta1", "eta2", "eta3"), "ID, cand"),
    *replay("bayes", "b_", "doses2")) + """
SELECT d.ID, s.rounds, d.time, d.amt FROM b_d7 d JOIN b_s7 s ON s.ID = d.ID"""
ORACLES["peak_trough_samples"] = with_(
    *BASE, NUMBERED, SITUATION,
    """both_times AS (SELECT ID, sample_time AS time FROM situation
  UNION SELECT ID, sample_time - ceil(3 * last_frq / 4) FROM situation)"""
) + f"SELECT ID, time, round({dv()}, 6) AS DV FROM {exposure('both_times', 'doses', 'par')} WHERE time >= 0"
ORACLES["patient_slice"] = with_(*BASE, grid()) + f"""
SELECT x.ID, x.time, coalesce(d.amt, 0) AS amt, round({dv('x.IPRE', 'x.ID', 'x.time')}, 6) AS DV
FROM {exposure('grid', 'doses', 'par')} x LEFT JOIN doses d ON d.ID = x.ID AND d.time = x.time
WHERE x.ID = 1 AND x.time <= 72"""
MEASURES = "(VALUES ('gt400'), ('gt700'), ('gt400lt700')) v(measure)"
PICK = "CASE measure WHEN 'gt400' THEN gt400 WHEN 'gt700' THEN gt700 ELSE gt400lt700 END"
ORACLES["policy_report"] = with_(*POLICIES, policy_profile(673, 0.25), POLICY_DAILY) + f"""
SELECT *, round(value * 100, 4) AS percent FROM (
  SELECT 'pta_method' AS part, method, methodf, 'all' AS crclf, day AS at, measure, {PICK} AS value
  FROM (SELECT day, method, methodf, {share()} FROM daily GROUP BY day, method, methodf), {MEASURES}
  UNION ALL
  SELECT 'pta_method_group', method, methodf, crclf, day, measure, {PICK}
  FROM (SELECT day, method, methodf, crclf, {share()} FROM daily GROUP BY day, method, methodf, crclf), {MEASURES})
UNION ALL
SELECT 'percentile_profile', method, method, {GROUP}, time, measure, round(CASE measure
  WHEN 'q05' THEN q[1] WHEN 'q50' THEN q[2] ELSE q[3] END, 6), NULL
FROM (SELECT method, CRCL, time, quantile_cont(IPRE, [0.05, 0.5, 0.95]) AS q FROM stacked GROUP BY method, CRCL, time),
  (VALUES ('q05'), ('q50'), ('q95')) v(measure)"""
ORACLES["window_auc24"] = with_(USER_SAMPLES) + """
SELECT ID, window_id, round("end" - 24, 6) AS "begin", round("end", 6) AS "end", round(sum(area), 3) AS auc FROM (
  SELECT w.ID, w.event_id AS window_id, w.time AS "end", coalesce((s.DV + lag(s.DV) OVER o) * (s.time - lag(s.time) OVER o) / 2, 0) AS area
  FROM samples w JOIN samples s ON s.ID = w.ID AND s.time BETWEEN w.time - 24 AND w.time
  WINDOW o AS (PARTITION BY w.event_id ORDER BY s.time, s.event_id))
GROUP BY ID, window_id, "end\""""
ORACLES["as_of_dose"] = with_(USER_SAMPLES, ORDER_DOSES) + """
SELECT s.ID + 1 AS ID, s.event_id AS key, round(s.time * 80, 6) AS time, d.dose_id, d.amt AS last_amt,
  round(d.time, 6) AS dose_time, round(d.after - d.time, 6) AS last_frq
FROM samples s LEFT JOIN LATERAL (
  SELECT * FROM (SELECT *, lead(time) OVER (PARTITION BY ID ORDER BY time, dose_id) AS after FROM order_doses) x
  WHERE x.ID = s.ID AND x.time < s.time * 80 ORDER BY x.time DESC, x.dose_id DESC LIMIT 1) d ON TRUE"""
ORACLES["regimen_versions"] = with_(
    *BASE, NUMBERED, MEASURED, grid(),
    """dated AS (SELECT n.ID, n.CRCL, n.time AS sample_time, n.amt AS last_amt, n.gap AS last_frq, m.DV AS conc
  FROM numbered n JOIN measured m ON m.ID = n.ID AND m.time = n.time WHERE n.n IN (4, 6, 10) AND n.gap IS NOT NULL)""",
    guideline("decided", "dated")) + """
SELECT g.ID, g.time,
  CASE WHEN x.ID IS NULL THEN coalesce(d.amt, 0) WHEN (g.time - x.sample_time) % x.dose_frq = 0 THEN x.dose_amt ELSE 0 END AS amt,
  CASE WHEN x.ID IS NULL THEN CASE WHEN d.ID IS NULL THEN 0 ELSE 1 END
    WHEN (g.time - x.sample_time) % x.dose_frq = 0 THEN 1 ELSE 0 END AS evid,
  CASE WHEN x.ID IS NULL THEN CASE WHEN d.amt <> 0 THEN -2 ELSE 0 END
    WHEN (g.time - x.sample_time) % x.dose_frq = 0 AND x.dose_amt <> 0 THEN -2 ELSE 0 END AS rate
FROM grid g LEFT JOIN doses d ON d.ID = g.ID AND d.time = g.time
ASOF LEFT JOIN (SELECT * FROM decided WHERE changed) x ON x.ID = g.ID AND g.time >= x.sample_time"""
ORACLES["guideline_all_doses"] = with_(
    *BASE, NUMBERED, MEASURED,
    """dated AS (SELECT n.ID, n.CRCL, n.time, n.amt AS last_amt, n.gap AS last_frq, m.DV AS conc
  FROM numbered n JOIN measured m ON m.ID = n.ID AND m.time = n.time)""",
    guideline("decided", "dated")) + "SELECT ID, time, round(conc, 6) AS DV, dose_amt, dose_frq FROM decided"
ORACLES["sampling_rejects"] = f"""
SELECT *, CAST((SELECT count(*) FROM customer) AS BIGINT) AS "of", count(*) OVER () AS rejected FROM (
  SELECT ID, CRCL, DIAL, CASE WHEN CRCL IS NULL THEN 'no creatinine clearance' WHEN DIAL = 1 THEN 'dialysis'
    WHEN CRCL < 20 THEN 'clearance below 20 mL/min' END AS reason
  FROM (SELECT c_custkey + 1 AS ID, CASE WHEN c_custkey % 50 <> 7 THEN 10 + (c_custkey * 37 % 1200) / {d(10)} END AS CRCL,
    CASE WHEN c_custkey % 33 = 5 THEN 1 ELSE 0 END AS DIAL FROM customer))
WHERE reason IS NOT NULL"""
