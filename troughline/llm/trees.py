"""Printed tree ensembles of Spark ML as SQL expressions."""

import re

_SPLIT = re.compile(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-+.\dE]+)\)")
_LEAF = re.compile(r"( *)Predict: ([-+.\dE]+)")
_TREE = re.compile(r" *Tree \d+ \(weight ([-+.\dE]+)\):")


def _number(text):
    return f"{float(text)!r}D"


def paths(description, names):
    """Conditions along the path to every node but the roots, as SQL conjunctions without repeats."""
    rules, path = {}, []
    for line in description.splitlines():
        found = _SPLIT.match(line)
        if found:
            depth = len(found[1])
            path = [step for step in path if step[0] < depth]
            path.append((depth, f"{names[int(found[3])]} {found[4]} {_number(found[5])}"))
            rules[" AND ".join(sorted({condition for _, condition in path}))] = None
    return list(rules)


def _branch(lines):
    """SQL of the subtree that begins with the next line."""
    line = next(lines)
    leaf = _LEAF.match(line)
    if leaf:
        return _number(leaf[2])
    split = _SPLIT.match(line)
    condition = f"{{{split[3]}}} {split[4]} {_number(split[5])}"
    yes = _branch(lines)
    next(lines)  # the line with Else
    return f"IF({condition}, {yes}, {_branch(lines)})"


def margin(description, names):
    """Weighted sum of all trees' predictions as an SQL expression over ``names``."""
    lines, terms = iter(description.splitlines()), ["0D"]
    for line in lines:
        tree = _TREE.match(line)
        if tree:
            terms.append(f"{_number(tree[1])} * {_branch(lines).format(*names)}")
    return " + ".join(terms)
