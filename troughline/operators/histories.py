"""Long histories under many parameter vectors at once.

Doses and samples of a patient are sorted over all tasks and cut into units of at most ``UNIT_ROWS`` rows, so
that a patient of any length is many small rows. A unit is walked under all parameter vectors; what
changes from vector to vector stays an array in the unit's row and is never multiplied into rows.

The model is linear: the state at the end of a unit is what the unit adds from rest plus what its first
state decays to. First states follow from a scan over the units of a patient, in groups of ``GROUP`` units:
groups are folded to one unit each until a patient has one group, and the states are handed back down. The
number of passes is the logarithm of the longest history; most patients have one unit and need none.

A state holds the decaying concentrations ``a`` and ``b``, and where the future is wanted also the amount ``given``;
``va`` and ``vb``, which are ``a`` and ``b`` as if every dose begun so far had run to its end, and ``due``, the amount of
those doses. From these follows what comes without new doses, once the last infusion has ended.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .. import constants as C
from ..functions import history_kernel
from ..functions.map_kernel import grid_points
from ..functions.model import add, infusion_hours, let, num, settled, shuffled_join
from ..sources.shipping import ship_package
from ..sources.storage import stage

UNIT_ROWS = 128
GROUP = 32
RATES = ("CL", "ka", "kb", "wa", "wb")
NOW = ("a", "b")
FUTURE = ("a", "b", "va", "vb", "given", "due")

# kind: 0 a sample, 1 a probe, 2 a change of the infusion rate by dr; the begin of a dose has amt and hours h
_ROW = {"time": "double", "kind": "int", "key": "bigint", "value": "double", "what": "int", "dr": "double",
        "amt": "double", "h": "double"}
_PLACE = (1 << 33) - 1  # low bits of Spark's increasing id: the row in its partition


def _row(**given):
    """Fields of a row, null where not given."""
    return {name: given.get(name, f"cast(null as {kind})") for name, kind in _ROW.items()}


def units(doses, samples=None, probes=None):
    """Units of the patients of ``samples (ID, time, key, DV)`` or ``probes`` with their ``doses (ID, time, amt)``.

    ``probes (ID, time, key, cand, what)`` are times whose states are wanted under vector ``cand`` of the patient. A
    row (ID, seq, n_units, begins, span, rows): ``rows`` in time order, samples and probes before doses of the same
    time, and ``span`` the hours to the next unit. The table is stored.
    """
    def rows_of(df, **given):
        return df.selectExpr("ID", *[f"{text} as {name}" for name, text in _row(dr="0.0D", **given).items()])

    if samples is not None:
        seen = rows_of(samples, time="time", kind="0", key="cast(key as bigint)", value="DV")
    else:
        seen = rows_of(probes, time="time", kind="1", key="cast(key as bigint)", value="cast(cand as double)", what="what")
    given = doses.where("amt > 0").join(seen.select("ID").distinct(), "ID", "left_semi")
    given = add(given, h=infusion_hours("amt"))
    on = _struct(_row(time="time", kind="2", dr="amt / h", amt="amt", h="h"))
    off = _struct(_row(time="time + h", kind="2", dr="-amt / h"))
    rows = seen.union(given.selectExpr("ID", f"inline(array({on}, {off}))"))

    order = ["ID", "time", "kind"]
    mid = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", mid)
    placed = stage(placed.selectExpr("*", "shiftright(_mid, 33) as _part", f"_mid & {_PLACE}L as _at").drop("_mid"), "rows")
    pieces = placed.groupBy("ID", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    pieces = add(pieces, _units=f"(_n + {UNIT_ROWS - 1}) div {UNIT_ROWS}")
    patient = Window.partitionBy("ID")
    pieces = pieces.withColumns({
        "_before": F.sum("_units").over(patient.orderBy("_part")) - F.col("_units"),
        "n_units": F.sum("_units").over(patient)}).drop("_n", "_units")
    cut = add(shuffled_join(placed, pieces, "ID", "_part"), _unit=f"(_at - _first) div {UNIT_ROWS}")
    made = cut.groupBy("ID", "_part", "_unit").agg(
        F.first("n_units").alias("n_units"), F.first(F.expr("_before + _unit")).alias("seq"),
        F.min("time").alias("begins"), F.sort_array(F.collect_list(F.struct(*_ROW))).alias("rows"))
    following = F.lead("begins").over(patient.orderBy("seq"))
    made = made.withColumn("span", F.coalesce(following - F.col("begins"), F.lit(0.0)))
    return stage(made.select("ID", "seq", "n_units", "begins", "span", "rows"), "units")


# ---- one parameter vector, as SQL text; ``k`` is its struct of rate constants ----


def kinetics(vector):
    """Struct (CL, ka, kb, wa, wb) of a struct of random effects, on a row with COVCL and COVVC."""
    own = (f"named_struct('CL', COVCL * exp({vector}.eta1), 'VC', COVVC * exp({vector}.eta2), "
           f"'k21', {num(C.TVQ / C.TVVP)} * exp(-({vector}.eta3)))")
    total = f"(p.CL / p.VC + {num(C.TVQ)} / p.VC + p.k21)"
    fast = f"({total} + sqrt({total} * {total} - 4 * p.CL / p.VC * p.k21)) / 2"
    made = """named_struct('CL', p.CL, 'ka', x, 'kb', y, 'wa', (x - p.k21) / ((x - y) * x * p.VC),
        'wb', (p.k21 - y) / ((x - y) * y * p.VC))"""
    return let("p", own, let("x", fast, let("y", "p.CL / p.VC * p.k21 / x", made)))


def models(vectors):
    """SQL text for the constants of an array of vectors, on a row with COVCL and COVVC."""
    return f"transform({vectors}, v -> {kinetics('v')})"


OWN = "array(named_struct('CL', CL, 'ka', ka, 'kb', kb, 'wa', wa, 'wb', wb))"  # of a patient's own columns


def _struct(fields):
    return "named_struct(" + ", ".join(f"'{name}', {text}" for name, text in fields.items()) + ")"


def _rest(future):
    return _struct({name: "0.0D" for name in (FUTURE if future else NOW)})


def _moved(state, rate, hours, future, added=None):
    """A state ``hours`` later at a constant rate, plus the state ``added``."""
    fields = {
        "a": f"k.wa * {rate} + ({state}.a - k.wa * {rate}) * d.a",
        "b": f"k.wb * {rate} + ({state}.b - k.wb * {rate}) * d.b",
    }
    if future:
        fields |= {"va": f"{state}.va * d.a", "vb": f"{state}.vb * d.b",
                   "given": f"{state}.given + {rate} * {hours}", "due": f"{state}.due"}
    if added:
        fields = {name: f"{text} + {added}.{name}" for name, text in fields.items()}
    return let("d", f"named_struct('a', exp(-k.ka * {hours}), 'b', exp(-k.kb * {hours}))", _struct(fields))


def _walk(rows, first, rate, future, step="0.0D", out="0.0D"):
    """Walk rows from a state at ``begins``: a struct (t, rate, x: state, m).

    ``step`` is SQL text for the new ``m`` from ``s.m``, the row ``e`` and the state ``n`` just before the row's dose.
    """
    after = "n"
    if future:
        # seen from its begin, a whole infusion decays like this much at once
        after = f"if(e.amt is null, n, {_struct({
            'a': 'n.a', 'b': 'n.b', 'va': 'n.va + k.wa * e.dr * (exp(k.ka * e.h) - 1)',
            'vb': 'n.vb + k.wb * e.dr * (exp(k.kb * e.h) - 1)', 'given': 'n.given', 'due': 'n.due + e.amt'})})"
    next_ = _struct({"t": "e.time", "rate": "s.rate + e.dr", "x": after, "m": step})
    start = _struct({"t": "begins", "rate": rate, "x": first, "m": out})
    return f"aggregate({rows}, {start}, (s, e) -> {let('n', _moved('s.x', 's.rate', '(e.time - s.t)', future), next_)})"


# ---- states at the begins of units ----


def _unit_ends(table, constants, future):
    """What each unit adds from rest until the next one begins: ``ends`` for each vector, and its change of rate."""
    walked = _walk("filter(rows, r -> r.kind = 2)", _rest(future), "0.0D", future)
    end = let("s", walked, _moved("s.x", "s.rate", "(begins + span - s.t)", future))
    return table.selectExpr(
        "ID", "seq", "span", "aggregate(rows, 0.0D, (total, r) -> total + r.dr) as dr",
        f"{let('models', constants, f'transform(models, k -> {end})')} as ends", *_carried(table))


def _carried(table):
    return [c for c in table.columns if c not in ("ID", "seq", "n_units", "begins", "span", "rows", "dr", "ends")]


def _scan(pieces, constants, future, longest):
    """State at the begin of each piece ``(ID, seq, span, dr, ends)``: (ID, seq, rate, states)."""
    kept = _carried(pieces)
    groups = add(pieces, _group=f"seq div {GROUP}").groupBy("ID", "_group").agg(
        F.sort_array(F.collect_list(F.struct("seq", "span", "dr", "ends"))).alias("_in"),
        *[F.first(c).alias(c) for c in kept])
    moved = _moved("last.states[i]", "last.rate", "u.span", future, "u.ends[i]")
    following = _struct({"seq": "u.seq + 1", "at": "last.at + u.span", "rate": "last.rate + u.dr",
                         "states": f"transform(models, (k, i) -> {moved})"})
    first = _struct({"seq": "_in[0].seq", "at": "0.0D", "rate": "0.0D",
                     "states": f"transform(models, k -> {_rest(future)})"})
    chain = (f"aggregate(_in, array({first}), (chain, u) -> "
             f"concat(chain, array({let('last', 'element_at(chain, -1)', following)})))")
    groups = settled(groups, _chain=let("models", constants, chain)).drop("_in")
    inside = "inline(slice(_chain, 1, size(_chain) - 1))"
    if longest <= GROUP:
        return groups.selectExpr("ID", inside).drop("at")
    groups = stage(groups, "scan")
    whole = groups.selectExpr("ID", "_group as seq", "element_at(_chain, -1).at as span",
                              "element_at(_chain, -1).rate as dr", "element_at(_chain, -1).states as ends", *kept)
    above = _scan(whole, constants, future, -(-longest // GROUP)).selectExpr(
        "ID", "seq as _group", "rate as _rate", "states as _states")
    local = shuffled_join(groups, above, "ID", "_group").selectExpr("ID", *kept, "_rate", "_states", inside)
    handed = f"transform(models, (k, i) -> {_moved('_states[i]', '_rate', 'at', future, 'states[i]')})"
    return local.selectExpr("ID", "seq", "_rate + rate as rate", f"{let('models', constants, handed)} as states")


def begun(table, constants, future=False, longest=None):
    """Add to units the first ``rate`` and the first ``states``, one for each parameter vector.

    ``constants`` is SQL text for the array of the vectors' constants, the same for all units of a patient. Both are null
    for a patient of one unit, which begins at rest. ``longest`` is the largest number of units of a patient,
    counted here unless it is given.
    """
    if longest is None:
        longest = table.agg(F.max("n_units")).first()[0] or 0
    if longest <= 1:
        state = ",".join(f"{name}:double" for name in (FUTURE if future else NOW))
        return add(table, rate="cast(null as double)", states=f"cast(null as array<struct<{state}>>)")
    ends = _unit_ends(table.where("n_units > 1"), constants, future)
    return shuffled_join(table, _scan(ends, constants, future, longest), "ID", "seq", how="left")


def spread(table):
    """Units over all tasks: their bytes do not tell their work, so adaptive execution may not merge these partitions."""
    return table.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ID", "seq")


def _listed(*columns):
    return [list(c) for c in columns]


def _numbers(*columns):
    return [c.to_numpy(dtype=float) for c in columns]


def _fields(**kinds):
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


@F.pandas_udf(ArrayType(DoubleType()))
def _scores(covcl: pd.Series, covvc: pd.Series, begins: pd.Series, rate: pd.Series, time: pd.Series, dr: pd.Series,
            value: pd.Series, a: pd.Series, b: pd.Series, eta1: pd.Series, eta2: pd.Series, eta3: pd.Series) -> pd.Series:
    """The misfit of each unit under each of its vectors."""
    return pd.Series(history_kernel.misfits(*_numbers(covcl, covvc, begins, rate), *_listed(time, dr, value, a, b),
                                            tuple(_listed(eta1, eta2, eta3))), dtype=object)


@F.pandas_udf(ArrayType(DoubleType()))
def _grid_scores(covcl: pd.Series, covvc: pd.Series, begins: pd.Series, rate: pd.Series, time: pd.Series, dr: pd.Series,
                 value: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """The same under all points of the coarse grid."""
    return pd.Series(history_kernel.misfits(*_numbers(covcl, covvc, begins, rate), *_listed(time, dr, value, a, b),
                                            grid_points()), dtype=object)


@F.pandas_udf(_fields(best=ArrayType(IntegerType()), y=ArrayType(DoubleType())))
def _running(covcl: pd.Series, covvc: pd.Series, begins: pd.Series, rate: pd.Series, time: pd.Series, dr: pd.Series,
             value: pd.Series, a: pd.Series, b: pd.Series, before: pd.Series) -> pd.DataFrame:
    best, y = history_kernel.running(*_numbers(covcl, covvc, begins, rate),
                                     *_listed(time, dr, value, a, b, before), grid_points())
    return pd.DataFrame({"best": best, "y": y})


@F.pandas_udf(_fields(n1=LongType(), n2=LongType(), n3=LongType(), ofv=DoubleType()))
def _searched(covcl: pd.Series, covvc: pd.Series, begins: pd.Series, time: pd.Series, dr: pd.Series, value: pd.Series,
              n1: pd.Series, n2: pd.Series, n3: pd.Series, step: pd.Series, scale: pd.Series) -> pd.DataFrame:
    if not len(n1):
        return pd.DataFrame({"n1": [], "n2": [], "n3": [], "ofv": []})
    start = np.stack([n.to_numpy(dtype=np.int64) for n in (n1, n2, n3)], -1)
    found, ofv = history_kernel.search(*_numbers(covcl, covvc, begins), *_listed(time, dr, value), start,
                                       int(step.iloc[0]), np.array(scale.iloc[0]))
    return pd.DataFrame({"n1": found[:, 0], "n2": found[:, 1], "n3": found[:, 2], "ofv": ofv})


@F.pandas_udf(_fields(**{name: ArrayType(DoubleType()) for name in FUTURE}))
def _probed(ka: pd.Series, kb: pd.Series, wa: pd.Series, wb: pd.Series, begins: pd.Series, rate: pd.Series, time: pd.Series,
            dr: pd.Series, amt: pd.Series, h: pd.Series, cand: pd.Series, probed: pd.Series, a: pd.Series, b: pd.Series,
            va: pd.Series, vb: pd.Series, given: pd.Series, due: pd.Series) -> pd.DataFrame:
    states = dict(zip(FUTURE, _listed(a, b, va, vb, given, due)))
    start = [None if x is None else r for r, x in zip(rate, states["a"])]
    return pd.DataFrame(history_kernel.probed_states(
        _listed(ka, kb, wa, wb), *_numbers(begins), start, *_listed(time, dr, amt, h, cand, probed), states))


def _each(array, field):
    return F.expr(f"transform({array}, x -> x.{field})")


def _rows(kind, value="value"):
    """A field of a unit's rows of one kind, NaN in the others."""
    return F.expr(f"transform(rows, x -> if(x.kind = {kind} and x.{value} is not null, x.{value}, double('nan')))")


def _unit():
    """What a walk from the unit's first state needs."""
    return ("COVCL", "COVVC", "begins", "rate", _each("rows", "time"), _each("rows", "dr"), _rows(0), _each("states", "a"),
            _each("states", "b"))


def unit_misfits(vectors=None):
    """Column of the misfits of a unit, one for each vector, on a row of ``begun``; without ``vectors`` of the coarse grid.

    The walks of this module that meet many vectors are steps in Python (``functions/history_kernel.py``): as an array function
    a row and vector takes 7 microseconds of CPU, and there, where a step is one operation on many units, a hundredth of it.
    """
    if vectors is None:
        return _grid_scores(*_unit())
    return _scores(*_unit(), *[_each(vectors, f"eta{k}") for k in (1, 2, 3)])


def unit_search(step, scale):
    """Column (n1, n2, n3, ofv): where the lattice search from ``n1, n2, n3`` of a patient of one unit ends."""
    steps = F.array(*[F.lit(float(x)) for x in scale])
    return _searched("COVCL", "COVVC", "begins", _each("rows", "time"), _each("rows", "dr"), _rows(0), "n1", "n2", "n3",
                     F.lit(step), steps)


def misfits(table, vectors, longest=None, keep=(), points=True):
    """Negative log-likelihood of all samples of a patient under each vector: (ID, *keep, cand, misfit, n_samples).

    ``table`` is the units with COVCL and COVVC, and with columns ``keep`` that are the same for all units of a
    patient; ``vectors`` is SQL text for an array of structs (eta1, eta2, eta3). With ``points=False`` they are the coarse
    grid's, which the walk makes itself instead of a unit carrying them. A unit's array of sums is taken apart last.
    """
    ship_package(table.sparkSession)
    scored = unit_misfits(None if points is False else vectors)
    each = spread(begun(table, models(vectors), longest=longest)).select(
        "ID", *keep, F.expr("size(filter(rows, r -> r.kind = 0))").alias("n"), scored.alias("m"))
    each = each.selectExpr("ID", *keep, "n", "posexplode(m) as (cand, m)")
    return each.groupBy("ID", *keep, "cand").agg(F.sum("m").alias("misfit"), F.sum("n").alias("n_samples"))


def running_grid(table, vectors, longest):
    """Units with samples, with the best points of the coarse grid as their samples come in.

    Adds ``n_before``, the samples of the units before it (null for a patient of one unit); ``best``, the point that all samples
    before each of the unit's and, last, its own single out; and ``y``, each sample's prediction under the point before it.
    ``vectors`` is SQL text for the points. Units of patients with several are walked twice: their sums come first.
    """
    ship_package(table.sparkSession)
    rows = add(begun(table, models(vectors), longest=longest), n="cast(size(filter(rows, r -> r.kind = 0)) as bigint)")
    if longest <= 1:
        rows = add(rows, before="cast(null as array<double>)", n_before="cast(null as bigint)")
    else:
        rows = stage(rows, "begun")
        each = spread(rows.where("n_units > 1")).select("ID", "seq", "n", unit_misfits().alias("m"))
        earlier = Window.partitionBy("ID", "cand").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        each = each.selectExpr("ID", "seq", "n", "posexplode(m) as (cand, sum)").withColumns({
            "sum": F.coalesce(F.sum("sum").over(earlier), F.lit(0.0)),
            "n_before": F.coalesce(F.sum("n").over(earlier), F.lit(0))})
        sums = each.groupBy("ID", "seq").agg(
            F.sort_array(F.collect_list(F.struct("cand", "sum"))).alias("sums"), F.first("n_before").alias("n_before"))
        sums = sums.selectExpr("ID", "seq", "transform(sums, x -> x.sum) as before", "n_before")
        rows = shuffled_join(rows, sums, "ID", "seq", how="left")
    return spread(rows.where("n > 0")).withColumn("_found", _running(*_unit(), "before")).selectExpr(
        "ID", "rows", "n_before", "_found.best as best", "_found.y as y")


def states_at(table, constants, longest=None):
    """State at every probe under the vector that it names: (ID, key, cand, what, time, ``RATES`` and ``FUTURE``).

    ``table`` is the units with ``probed``, the sorted numbers of the vectors that the patient's probes name, and
    what ``constants``, SQL text for the array of those vectors' constants, refers to.
    """
    ship_package(table.sparkSession)
    table = add(spread(begun(table, constants, future=True, longest=longest)), _k=constants)
    found = _probed(*[_each("_k", name) for name in RATES[1:]], "begins", "rate", _each("rows", "time"), _each("rows", "dr"),
                    _rows(2, "amt"), _rows(2, "h"), _rows(1), F.expr("transform(probed, c -> cast(c as double))"),
                    *[_each("states", name) for name in FUTURE])
    fields = {"key": "r.key", "cand": "cast(r.value as int)", "what": "r.what", "time": "r.time",
              **{name: f"_k[array_position(probed, cast(r.value as int)) - 1].{name}" for name in RATES},
              **{name: f"_found.{name}[i]" for name in FUTURE}}
    rows = table.withColumn("_found", found).selectExpr("ID", "_k", "_found", "probed", "filter(rows, r -> r.kind = 1) as _probes")
    return rows.selectExpr("ID", f"inline(transform(_probes, (r, i) -> {_struct(fields)}))")


def exposure(obs, doses, patients):
    """IPRE and AUC at every row of ``obs (ID, time, key)`` under a patient's own rate constants: (ID, key, time, IPRE, AUC).

    ``patients`` has one row per ID with ``RATES``. Observations and doses are read once and sorted once.
    """
    probes = obs.selectExpr("ID", "time", "key", "0 as cand", "0 as what")
    table = units(doses, probes=probes).join(patients.selectExpr("ID", *RATES, "array(0) as probed"), "ID")
    return states_at(table, OWN).selectExpr("ID", "key", "time", "a + b as IPRE", "given / CL - a / ka - b / kb as AUC")
