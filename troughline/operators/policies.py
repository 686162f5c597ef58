"""Dosing decisions: SQL text for a struct (dose_amt, dose_frq) on a patient's row, and rules given as a table."""

from pyspark.sql import functions as F

from .. import constants as C
from ..functions.model import add, let, num, round_up


def _within(value, bounds):
    low, low_included, high, high_included = bounds
    tests = []
    if low is not None:
        tests.append(f"{value} {'>=' if low_included else '>'} {num(low)}")
    if high is not None:
        tests.append(f"{value} {'<=' if high_included else '<'} {num(high)}")
    return tests


def guideline_decision(crcl, conc, last_amt, last_frq):
    """Dose and interval of the guideline table; null without a concentration or rule."""
    cases = []
    for crcl_bounds, conc_bounds, amt, frq, keep_amt, keep_frq in C.GUIDELINE_RULES:
        test = " and ".join(_within(crcl, crcl_bounds) + _within(conc, conc_bounds))
        if amt is None:
            dose = f"if({last_amt} != 0, {last_amt}, {num(keep_amt)})"
            interval = f"if({last_amt} != 0, {last_frq}, {num(keep_frq)})"
        else:
            dose, interval = num(amt), num(frq)
        cases.append(f"when {test} then named_struct('dose_amt', {dose}, 'dose_frq', {interval})")
    return "case " + " ".join(cases) + " end"


def proportional_decision(auc24, last_amt, last_frq, target=C.PROPORTIONAL_TARGET):
    """Scale the dose to the target exposure, then step the interval while the dose is extreme."""
    low, high = (num(x) for x in C.DOSE_RANGE)
    choices = f"array({', '.join(num(i) for i in C.INTERVALS)})"
    position = f"cast(array_position({choices}, st.dose_frq) as int)"
    scaled = round_up("st.dose_amt * frq / st.dose_frq")
    moved = let("place", f"{position} + if(st.dose_amt < {low}, 1, -1)", (
        f"if(place between 1 and {len(C.INTERVALS)}, "
        + let("frq", f"get({choices}, place - 1)",
              f"named_struct('dose_amt', {scaled}, 'dose_frq', frq)") + ", st)"))
    step = f"if(st.dose_amt between {low} and {high} or {position} = 0, st, {moved})"
    start = (f"named_struct('dose_amt', "
             f"{round_up(f'try_divide({last_amt} * {num(target)}, {auc24})')}, 'dose_frq', {last_frq})")
    adjusted = f"aggregate(sequence(1, {len(C.INTERVALS) - 1}), {start}, (st, i) -> {step})"
    return (f"if({auc24} between {num(C.AUC_LOWER)} and {num(C.AUC_UPPER)}, "
            f"named_struct('dose_amt', {last_amt}, 'dose_frq', {last_frq}), {adjusted})")


def outside_target(auc24, last_amt):
    """Whether the exposure policy looks for a new dose."""
    return (f"({auc24} < {num(C.AUC_LOWER)} or {auc24} >= {num(C.AUC_UPPER)} or {last_amt} = 0)")


# ---- rules as a table ----

RULE_SCHEMA = ("crcl_lo double, crcl_lo_incl boolean, crcl_hi double, crcl_hi_incl boolean, "
               "conc_lo double, conc_lo_incl boolean, conc_hi double, conc_hi_incl boolean, "
               "dose_amt double, dose_frq double, keep_amt double, keep_frq double")
#: A table of more rules is refused: its bounds are gathered in one place, and its cells are joined.
MAX_RULES = 1000
AXES = ("crcl", "conc")


def guideline_rules(spark):
    """The guideline as a table; null bounds are open, a null dose keeps the last one (``keep_...`` after a held one)."""
    rows = [(*crcl, *conc, *outcome) for crcl, conc, *outcome in C.GUIDELINE_RULES]
    names = [c.split()[0] for c in RULE_SCHEMA.split(", ")]
    order = [f"{axis}_{part}" for axis in AXES for part in ("lo", "lo_incl", "hi", "hi_incl")] + names[8:]
    return spark.createDataFrame([dict(zip(order, row)) for row in rows], RULE_SCHEMA)


class RuleTable:
    """Rules over rectangles of two values, as a lookup of cells between sorted bounds.

    The bounds of all rules cut each axis into cells; a rule covers the cells between its bounds. Two rules on one
    cell are an error when the table is made; cells that no rule covers are its ``gaps``. A bound is the pair of its
    value and the side of the value that it lies on (0 before, 1 after), which tells open from closed ends.
    """

    def __init__(self, rules):
        self.spark = rules.sparkSession
        found = rules.limit(MAX_RULES + 1).collect()
        if len(found) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules")
        spans, self.bounds = [], {}
        for axis in AXES:
            ends = [self._ends(rule, axis) for rule in found]
            self.bounds[axis] = sorted({end for span in ends for end in span if end is not None})
            spans.append(ends)
        cells = {}
        for number, rule in enumerate(found):
            covered = [self._cells(spans[k][number], self.bounds[axis]) for k, axis in enumerate(AXES)]
            for crcl in covered[0]:
                for conc in covered[1]:
                    other = cells.setdefault((crcl, conc), number)
                    if other != number:
                        raise ValueError(f"rules {other + 1} and {number + 1} overlap: {self._where((crcl, conc))}")
        outcome = ("dose_amt", "dose_frq", "keep_amt", "keep_frq")
        self.cells = [(*cell, *(found[number][name] for name in outcome)) for cell, number in sorted(cells.items())]
        every = ((a, b) for a in range(len(self.bounds["crcl"]) + 1) for b in range(len(self.bounds["conc"]) + 1))
        self.gaps = [self._where(cell) for cell in every if cell not in cells]

    @staticmethod
    def _ends(rule, axis):
        low, high = rule[f"{axis}_lo"], rule[f"{axis}_hi"]
        return (None if low is None else (low, 0 if rule[f"{axis}_lo_incl"] else 1),
                None if high is None else (high, 1 if rule[f"{axis}_hi_incl"] else 0))

    @staticmethod
    def _cells(span, bounds):
        low, high = span
        return range(0 if low is None else bounds.index(low) + 1, len(bounds) + 1 if high is None else bounds.index(high) + 1)

    def _where(self, cell):
        parts = []
        for axis, number in zip(AXES, cell):
            bounds = self.bounds[axis]
            low, high = bounds[number - 1] if number else None, bounds[number] if number < len(bounds) else None
            left = "" if low is None else f"{low[0]} {'<' if low[1] else '<='} "
            right = "" if high is None else f" {'<=' if high[1] else '<'} {high[0]}"
            parts.append(left + axis + right)
        return ", ".join(parts)

    def _cell(self, axis, value):
        """SQL text for the cell of a value: how many bounds lie before it."""
        bounds = ", ".join(f"named_struct('v', {num(v)}, 'after', {side})" for v, side in self.bounds[axis])
        if not bounds:
            return f"if({value} is null, null, 0)"
        before = f"size(filter(array({bounds}), b -> b.v < {value} or (b.v = {value} and b.after = 0)))"
        return f"if({value} is null, null, {before})"

    def decide(self, rows, crcl="CRCL", conc="conc", last_amt="last_amt", last_frq="last_frq"):
        """Add dose_amt and dose_frq; null where a value is missing or no rule covers it."""
        names = "_crcl_cell int, _conc_cell int, _amt double, _frq double, _keep_amt double, _keep_frq double"
        cells = self.spark.createDataFrame(self.cells, names)
        placed = add(rows, _crcl_cell=self._cell("crcl", crcl), _conc_cell=self._cell("conc", conc))
        # at most (2 x MAX_RULES + 1) ** 2 cells; rules without overlap cover far fewer, and Spark sees their number
        found = placed.join(cells, ["_crcl_cell", "_conc_cell"], "left")
        keeps = f"_amt is null and {last_amt} != 0"
        covered = "_amt is not null or _keep_amt is not null"
        return add(
            found, dose_amt=f"if({covered}, if({keeps}, {last_amt}, coalesce(_amt, _keep_amt)), null)",
            dose_frq=f"if({covered}, if({keeps}, {last_frq}, coalesce(_frq, _keep_frq)), null)",
        ).drop("_crcl_cell", "_conc_cell", "_amt", "_frq", "_keep_amt", "_keep_frq")
