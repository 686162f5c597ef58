"""Brute-force versions of the text operators, in plain Python."""

import re
from collections import defaultdict
from itertools import combinations

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text, size=5):
    words = SPACED.findall(lower(text))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def components(docs):
    """Per id its set size and the smallest id that links reach."""
    sets = {i: shingles(text) for i, text in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {i: (len(sets[i]), root(i)) for i in sets}


def passages(docs, length):
    """Maximal spans (id, begin, end, later) covered by windows that occur in two documents."""
    words = {i: SPACED.findall(text or "") for i, text in docs}
    owners = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - length + 1):
            owners[tuple(w[k : k + length])].add(i)
    found = set()
    for i, w in words.items():
        for later in (False, True):
            spans = []
            for k in range(len(w) - length + 1):
                own = owners[tuple(w[k : k + length])]
                if len(own) > 1 and (min(own) != i) == later:
                    if spans and k <= spans[-1][1]:
                        spans[-1][1] = k + length
                    else:
                        spans.append([k, k + length])
            found.update((i, b, e, later) for b, e in spans)
    return found


def contamination(docs, items, length=10):
    windows = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall(lower(text))
        n = min(length, len(words))
        for k in range(len(words) - n + 1):
            if n:
                windows[tuple(words[k : k + n])].add(str(item))
    sizes = {len(w) for w in windows}
    result = {}
    for i, text in docs:
        words, hit, found = ALNUM.findall(lower(text)), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                window = tuple(words[k : k + n])
                if window in windows:
                    hit.update(range(k, k + n))
                    found |= windows[window]
        result[i] = (len(words), len(hit), sorted(found))
    return result


def luhn(digits):
    doubled = [int(d) * (2 if k % 2 else 1) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", m))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(part) <= 255 for part in m.group().split(".")):
            found.append(("ip", m))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append(("phone", m))
    return [f"{kind}:{m.start()}:{m.end()}" for kind, m in found]
