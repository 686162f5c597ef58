"""Personal data: fixed formats, and candidates chosen by boosted trees, in column expressions only.

Four fixed formats (e-mail, IP address, payment card, telephone) give the base spans. Beside them, high-recall
generators propose spans that may overlap each other: numbers with separators, addresses with
written-out signs, and long runs of letters and digits (secrets), in the text outside the base spans. Gradient-boosted trees score every candidate by
its shape and by the text around it. They learn from a bounded sample of documents: its candidates, labelled by their
normalised content (signs rewritten, separators stripped, then the checks; the entropy of a run) and context, and base
hits written in other ways where they stand, which are positives. Tests that define the base formats are kept out of the
features. A threshold for each generator is calibrated on those labels of candidates outside base spans;
candidates above it are added. The trees are compiled into an SQL expression: scoring
is part of the scan's projection, without a join, a shuffle or Python.

Offsets count code points, ends are exclusive. All patterns have a fixed cost a character: runs are
taken whole (possessive) and begin where no longer run could.

Defined cases: null text is empty and has no spans; a sample without candidates of both kinds adds
nothing; rows that repeat are searched again; extra columns are left out unless named in ``keep``.
"""

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from troughline.llm import trees
from troughline.llm.base import bind, stage

#: Documents that the trees learn from, at most, and the share of them kept from the trees; thresholds count all documents.
SAMPLE_DOCUMENTS = 10_000
CALIBRATION_SHARE = 0.4
#: Share of true candidates that those above a threshold must reach.
PRECISION = 0.98

KINDS = ("email", "ip", "card", "phone")

# Fixed formats, written so that a run that cannot match is left at once.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators of candidates.
#: Parts of numbers, and what may stand between two of one number, whose whole has so many characters at most.
PART = r"\+?\(?[0-9]++(?:[.-][0-9]++)*+"
_BETWEEN = r"^[\x20().+/-]+$"
NUMBER_LENGTH = 40
#: Digits of the longest number that the checks accept: no number has more parts.
_MOST_DIGITS = 19
_AT = r"[(\[{]\x20?(?:@|at|AT)\x20?[)\]}]"
_POINT = r"[(\[{]\x20?(?:\.|dot|DOT)\x20?[)\]}]"
_SIGN = rf"\x20?(?:@|{_AT})\x20?"
_DOT = rf"\x20?(?:\.|{_POINT})\x20?"
#: A plain dot with a blank on one side only ends a sentence.
_LOOSE = r"(?<!\x20)\.\x20|\x20\.(?!\x20)"
_TIGHT = rf"(?:\.(?!\x20)|\x20\.\x20|\x20?{_POINT}\x20?)"


def _address(dot):
    return rf"[A-Za-z0-9._%+-]{{1,64}}{_SIGN}[A-Za-z0-9-]{{1,63}}(?:{dot}[A-Za-z0-9-]{{1,63}}){{1,8}}"


ADDRESS = _address(_DOT)
#: The same up to the end of its sentence.
TIGHT_ADDRESS = _address(_TIGHT)
#: Runs that keys and tokens are written in.
SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
GENERATORS = ("number", "address", "secret")
#: Characters of context on either side, and words there that speak of personal data.
CONTEXT = 24
PHONE_CUE = r"\b(call|phone|telephone|tel|fax|mobile|cell|contact)\b[^0-9A-Za-z]*(?:(?:me|us|at|on|is|no|number)\b[^0-9A-Za-z]*){0,2}$"
CUES = r"\b(call|phone|tel|fax|mobile|card|visa|mail|contact|address|ip|host)\b"
SECRET_CUE = r"(?:token|secret|passw(?:or)?d|passphrase|pwd|key|credentials?|auth)[a-z0-9_]*[\"']?\s*(?:=>|[:=])\s*[\"']?$|\bbearer\s+$"
#: Switches between letters and digits, and runs that name a thing without being secret.
_SWITCH = "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"
_UUID = "[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
#: Least length and bits a character of a secret after a cue, and of one that stands by itself.
CUED_LENGTH, CUED_BITS = 16, 2.5
BARE_LENGTH, BARE_BITS = 32, 3.0

_YEAR = "(?:19|20)[0-9]{2}"
_DATE = rf"{_YEAR}[./-][0-9]{{1,2}}[./-][0-9]{{1,2}}.*|[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-]{_YEAR}.*|{_YEAR}[\x20/-]+{_YEAR}"
#: Layouts of numbers whose content is checked: telephones that speak for themselves, and cards.
PHONE_LAYOUT = (
    r"(?:(?:\+|00)?[0-9]{1,3}[\x20./-]*)?"
    r"(?:\([0-9]{2,5}\)[\x20./-]*[0-9]{2,}(?:[\x20./-]+[0-9]{2,})*|[0-9]{3}[\x20./-]+[0-9]{3}[\x20./-]+[0-9]{4})"
    r"|\+[0-9]{1,3}[\x20()./-]*[0-9]{2,}(?:[\x20()./-]+[0-9]{2,})*"
)
CARD_LAYOUT = r"[0-9]{16,19}|[0-9]{4}(?:[\x20./-]{1,3}[0-9]{4}){3}(?:[\x20./-]{0,3}[0-9]{1,3})?"

_SPAN = "array<struct<s:int,e:int,v:string,before:string,after:string>>"
_BLOCK = 256
#: Stands for the characters of base spans; no generator takes it.
_OVER = "\ue000"


def _total(array):
    return F.aggregate(array, F.lit(0), lambda a, x: a + x)


def spans(text, pattern):
    """Leftmost non-overlapping matches: start, end, the match and the text next to it.

    Starts are running totals of the lengths between and of the matches, taken in blocks, so that a
    text with very many matches does not cost their square.
    """

    def located(x):
        matches, gaps = x["m"], x["g"]
        steps = F.transform(matches, lambda v, i: F.length(v) + F.length(gaps[i]))

        def placed(y):
            lengths, blocks = y["lengths"], y["blocks"]

            def place(v, i):
                block = F.floor(i / F.lit(_BLOCK)).cast("int")
                before = _total(F.slice(blocks, F.lit(1), block)) + _total(
                    F.slice(lengths, block * _BLOCK + 1, i - block * _BLOCK)
                )
                start = before + F.length(gaps[i])
                return F.struct(
                    start.alias("s"), (start + F.length(v)).alias("e"), v.alias("v"),
                    F.right(gaps[i], F.lit(CONTEXT)).alias("before"),
                    F.left(gaps[i + 1], F.lit(CONTEXT)).alias("after"),
                )

            return F.transform(matches, place)

        def with_blocks(lengths):
            count = F.floor(F.size(lengths) / F.lit(_BLOCK)).cast("int")
            blocks = F.transform(
                F.sequence(F.lit(0), count), lambda b: _total(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))
            )
            return bind(F.struct(lengths.alias("lengths"), blocks.alias("blocks")), placed)

        return bind(steps, with_blocks)

    pieces = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")
    )
    return bind(pieces, located).cast(_SPAN)


def _digits(v):
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits):
    backwards = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda a, i: a + bind(
            F.substring(backwards, i, F.lit(1)).cast("int"),
            lambda d: F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d),
        ),
    )
    return total % 10 == 0


def _valid_ip(v):
    return F.forall(F.split(v, r"\."), _small)


def _small(part):
    """A run of digits that is at most 255, whatever its leading zeros."""
    digits = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(digits) <= 3) & (F.left(digits, F.lit(3)).cast("int") <= 255)


def _valid_card(v):
    return bind(_digits(v), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False))


def _valid_phone(v):
    return F.length(_digits(v)).between(8, 15)


def base_spans(text):
    """Struct of the spans of each base kind."""
    none = F.array().cast(_SPAN)
    found = {
        "email": F.when(F.contains(text, F.lit("@")), spans(text, EMAIL)).otherwise(none),
        "ip": F.filter(spans(text, IP), lambda x: _valid_ip(x["v"])),
        "card": F.filter(spans(text, CARD), lambda x: _valid_card(x["v"])),
        "phone": F.when(
            F.contains(text, F.lit("+")), F.filter(spans(text, PHONE), lambda x: _valid_phone(x["v"]))
        ).otherwise(none),
    }
    return F.struct(*[found[kind].alias(kind) for kind in KINDS])


def _count(text, chars):
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")


def features(x):
    """Shape of a candidate and of the text next to it; nothing that defines a base format by itself."""
    v, before, after = x["v"], x["before"], x["after"]
    length = F.length(v).cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        "length": length,
        "digit_share": _count(v, "0123456789") / length,
        "blanks": _count(v, " "),
        "dots": _count(v, "."),
        "dashes": _count(v, "-/"),
        "brackets": _count(v, "()[]"),
        "digits": _count(v, "0123456789"),
        "loose_dots": (F.size(F.split(v, _LOOSE)) - 1).cast("double"),
        "groups": F.size(F.split(v, "[^0-9A-Za-z]+")).cast("double"),
        "first_group": F.length(F.regexp_extract(v, "^[^0-9]*([0-9]*)", 1)).cast("double"),
        "last_group": F.length(F.regexp_extract(v, "([0-9]*)$", 1)).cast("double"),
        "year": flag(F.rlike(v, F.lit(rf"^{_YEAR}[^0-9]|[^0-9]{_YEAR}$"))),
        "longest_group": F.array_max(F.transform(F.split(v, "[^0-9]+"), F.length)).cast("double"),
        "leading_zero": flag(F.startswith(v, F.lit("0"))),
        "after_blank": flag(F.rlike(before, F.lit(r"(^|\s)$"))),
        "after_letter": flag(F.rlike(before, F.lit(r"[A-Za-z]$"))),
        "after_sign": flag(F.rlike(before, F.lit("[=:#\"'$/]\\s?$"))),
        "after_digit": flag(F.rlike(before, F.lit(r"[0-9][\x20().+/-]*$"))),
        "before_digit": flag(F.rlike(after, F.lit(r"^[\x20().+/-]*[0-9]"))),
        "before_letter": flag(F.rlike(after, F.lit(r"^[A-Za-z]"))),
        "before_sign": flag(F.rlike(after, F.lit("^[=:#\"'%/]"))),
        "cue": flag(F.rlike(F.lower(before), F.lit(CUES))),
        "phone_cue": flag(F.rlike(F.lower(before), F.lit(PHONE_CUE))),
        "secret_cue": flag(F.rlike(F.lower(before), F.lit(SECRET_CUE))),
        "switches": _switches(v).cast("double"),
        "distinct": F.size(_characters(v)).cast("double"),
    }


def _switches(v):
    return F.size(F.split(v, _SWITCH)) - 1


def _characters(v):
    return F.array_distinct(F.filter(F.split(v, ""), lambda c: c != ""))


def _bits(v):
    """Entropy of the characters of ``v``, in bits a character."""
    length = F.length(v)
    share = lambda c: (length - F.length(F.replace(v, c, F.lit("")))) / length
    return F.aggregate(_characters(v), F.lit(0.0), lambda a, c: a - bind(share(c), lambda p: p * F.log2(p)))


FEATURES = (
    "length", "digit_share", "blanks", "dots", "dashes", "brackets", "digits", "loose_dots", "groups",
    "first_group", "last_group", "year", "longest_group",
    "leading_zero", "after_blank", "after_letter", "after_sign", "before_letter", "before_sign", "cue",
    "phone_cue", "after_digit", "before_digit", "secret_cue", "switches", "distinct",
)


def proposals(text):
    """All generators' spans, by generator."""
    none = F.array().cast(_SPAN)
    signed = F.rlike(text, F.lit(f"@|{_AT}"))
    addresses = F.array_distinct(F.concat(spans(text, ADDRESS), spans(text, TIGHT_ADDRESS)))
    return {
        "number": F.filter(numbers(text), lambda x: _possible(x["v"])),
        "address": F.when(signed, addresses).otherwise(none),
        "secret": F.when(F.rlike(text, F.lit(SECRET)), F.filter(spans(text, SECRET), lambda x: _switches(x["v"]) > 0)).otherwise(none),
    }


def numbers(text):
    """Every run of consecutive parts within the length bound, so that numbers side by side are proposed one by one."""
    nothing = F.struct(F.lit(0).alias("e"), F.lit("").alias("v"), F.lit(True).alias("open"), F.array().cast(_SPAN).alias("out"))

    def joined(parts):
        def begun(p, i):
            def step(a, q):
                first = a["v"] == ""
                beside = (a["e"] + F.length(q["gap"]) == q["s"]) & F.rlike(q["gap"], F.lit(_BETWEEN))
                v = F.when(first, q["v"]).otherwise(F.concat(a["v"], q["gap"], q["v"]))
                goes_on = a["open"] & (first | beside) & (F.length(v) <= NUMBER_LENGTH)
                span = F.struct(
                    p["s"].alias("s"), q["e"].alias("e"), v.alias("v"), p["before"].alias("before"), q["after"].alias("after")
                )
                return F.struct(
                    q["e"].alias("e"), v.alias("v"), goes_on.alias("open"),
                    F.when(goes_on, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"),
                )

            def closed(a, q):
                return F.when(a["open"], step(a, q)).otherwise(a)

            return F.aggregate(F.slice(parts, i + 1, F.lit(_MOST_DIGITS)), nothing, closed, lambda a: a["out"])

        return F.flatten(F.transform(parts, begun))

    def placed(parts):
        """Parts with their neighbours in the text next to them, and the gap before each by itself."""
        def seen(p, i):
            last, following = F.get(parts, i - 1), F.get(parts, i + 1)
            near = last["e"] + F.length(p["before"]) == p["s"]
            ahead = p["e"] + F.length(p["after"]) == following["s"]
            before = F.when(near, F.right(F.concat(last["v"], p["before"]), F.lit(CONTEXT))).otherwise(p["before"])
            after = F.when(ahead, F.left(F.concat(p["after"], following["v"]), F.lit(CONTEXT))).otherwise(p["after"])
            return F.struct(
                p["s"].alias("s"), p["e"].alias("e"), p["v"].alias("v"), p["before"].alias("gap"),
                before.alias("before"), after.alias("after"),
            )

        return bind(F.transform(parts, seen), joined)

    return bind(spans(text, PART), placed)


def _possible(v):
    """Whether a number's digits pass the checks of a telephone or a card."""
    return _valid_phone(v) | _valid_card(v)


def candidates(text, labelled=False):
    """All generators' candidates, each with its generator, its features and, if asked for, its label."""
    found = proposals(text)
    return F.concat(*[bind(found[kind], _shaped(kind, labelled)) for kind in GENERATORS])


def _shaped(kind, labelled):
    return lambda found: _candidates(kind, found, labelled)


def _candidates(kind, found, labelled):
    whole = F.filter(found, lambda x: F.coalesce(LABELS[kind](x), F.lit(False)))

    def shaped(x):
        shape = F.struct(*[value.alias(name) for name, value in features(x).items()])
        if not labelled:
            return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), shape.alias("f"))
        wider = lambda y: (y["s"] <= x["s"]) & (x["e"] <= y["e"]) & (y["e"] - y["s"] > x["e"] - x["s"])
        label = F.exists(whole, lambda y: (y["s"] == x["s"]) & (y["e"] == x["e"])) & ~F.exists(whole, wider)
        return F.struct(
            F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), shape.alias("f"), label.alias("label")
        )

    return F.transform(found, shaped)


def _is_number(x):
    """Label of a number: a card's or a telephone's layout and checks, or a telephone's digits after a cue."""
    v, before, after = x["v"], x["before"], x["after"]
    alone = ~F.rlike(before, F.lit("[A-Za-z0-9_=#$%/.-]$")) & ~F.rlike(after, F.lit("^(?:[A-Za-z0-9_%=/-]|[.,][0-9])"))
    card = F.rlike(v, F.lit(f"^(?:{CARD_LAYOUT})$")) & _valid_card(v)
    called = F.rlike(F.lower(before), F.lit(PHONE_CUE))
    phone = _valid_phone(v) & ~F.rlike(v, F.lit(f"^(?:{_DATE})$")) & (
        F.rlike(v, F.lit(f"^(?:{PHONE_LAYOUT})$")) | called
    )
    return alone & (card | phone)


def _is_address(x):
    """Label of an address: an e-mail address once its signs are rewritten."""
    plain = F.regexp_replace(F.regexp_replace(x["v"], rf"\x20?{_POINT}\x20?|\x20\.\x20", "."), _SIGN, "@")
    alone = ~F.rlike(x["before"], F.lit(rf"{_LOCAL}$")) & ~F.rlike(x["after"], F.lit("^[A-Za-z0-9_@-]"))
    return alone & F.rlike(plain, F.lit(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}$"))


def _is_secret(x):
    """Label of a secret: a run of high entropy after a cue, or a long one whose letters and digits are mixed throughout."""
    v = x["v"]
    length = F.length(v)
    cued = F.rlike(F.lower(x["before"]), F.lit(SECRET_CUE)) & (length >= CUED_LENGTH) & (_bits(v) >= CUED_BITS)
    bare = (length >= BARE_LENGTH) & (_switches(v) * 8 >= length) & (_bits(v) >= BARE_BITS)
    alone = ~F.rlike(x["before"], F.lit("[A-Za-z0-9/@.%]$")) & ~F.rlike(x["after"], F.lit("^[A-Za-z0-9@%]"))
    return cued | (bare & alone & ~F.rlike(v, F.lit(f"^{_UUID}$")))


LABELS = {"number": _is_number, "address": _is_address, "secret": _is_secret}


def _masked(base):
    """Base hits written in other ways: text before, variant, text after, and whether the variant is a positive.

    The others, numbers of the same digits and two numbers side by side, get the label of any candidate.
    """
    def written(x, positive, decoys=()):
        every = [(v, True) for v in positive] + [(v, False) for v in decoys]
        return F.array(*[
            F.struct(x["before"].alias("before"), v.alias("v"), x["after"].alias("after"), F.lit(p).alias("positive"))
            for v, p in every
        ])

    def email(x):
        at, dot = (lambda v, sign: F.replace(v, F.lit("@"), F.lit(sign))), (
            lambda v, sign: F.concat(
                F.substring_index(v, "@", 1), F.lit("@"), F.replace(F.substring_index(v, "@", -1), F.lit("."), F.lit(sign))
            )
        )
        v = x["v"]
        return written(x, [
            v, at(v, " @ "), at(v, "(at)"), at(v, " (at) "), at(v, "[@]"),
            at(dot(v, " (dot) "), " (at) "), at(dot(v, "[dot]"), "[at]"), at(dot(v, " . "), " @ "),
        ])

    def phone(x):
        bare = F.substring(x["v"], 2, 10_000)
        local = F.regexp_replace(bare, r"^[0-9]{1,3}[\x20.-]+(?=[(0-9])", "")
        joined = lambda v, sign: F.regexp_replace(F.ltrim(F.regexp_replace(v, r"[\x20().-]+", " ")), " ", sign)
        forms = [x["v"], bare, local, *[joined(v, sign) for v in (bare, local) for sign in ("-", ".", " ")]]
        return F.filter(written(x, forms, [_digits(bare), _twice(local), *_decoys(_digits(bare))]), lambda y: F.length(y["v"]) > 0)

    def card(x):
        grouped = lambda sign: F.regexp_replace(_digits(x["v"]), "(?<=[0-9])(?=(?:[0-9]{4})+$)", sign)
        digits = _digits(x["v"])
        return written(
            x, [digits, *[F.when(F.length(digits) == 16, grouped(sign)).otherwise(digits) for sign in (".", "/", "  ")]],
            [_twice(digits), *_decoys(digits)],
        )

    kinds = {"email": email, "phone": phone, "card": card}
    return F.concat(*[F.flatten(F.transform(base[kind], form)) for kind, form in kinds.items()])


def _twice(v):
    return F.concat_ws(" ", v, v)


def _decoys(digits):
    part = lambda at, n: F.substring(digits, at, n)
    return [
        part(1, 8), part(1, 12), F.concat(part(1, 6), F.lit("."), part(5, 4)),
        F.concat(F.lit("20"), part(1, 2), F.lit("-0"), part(3, 1), F.lit("-1"), part(4, 1)),
        F.concat(part(1, 4), F.lit("-"), part(5, 4)), F.concat(part(1, 3), F.lit("."), part(2, 3), F.lit("."), part(4, 3)),
    ]


def _learned(row):
    """Candidates of the base hits' other forms in the text beside them, labelled."""
    at = F.length(row["before"])

    def labelled(x):
        same = row["positive"] & (x["s"] == at) & (x["e"] == at + F.length(row["v"]))
        return F.struct(x["kind"], x["f"], F.when(row["positive"], same).otherwise(x["label"]).alias("label"))

    # what stands further off in the text beside it is not of this hit
    near = F.filter(
        candidates(F.concat(row["before"], row["v"], row["after"]), labelled=True),
        lambda x: (x["s"] < at + F.length(row["v"])) & (at < x["e"]),
    )
    return F.transform(near, labelled)


def without_base(text, base):
    """The text with every base span overwritten, at the same offsets."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a, x):
        kept = F.substring(text, a["at"] + 1, F.greatest(x["s"] - a["at"], F.lit(0)))
        over = F.repeat(F.lit(_OVER), F.greatest(x["e"] - F.greatest(x["s"], a["at"]), F.lit(0)))
        return F.struct(
            F.greatest(a["at"], x["e"]).alias("at"), F.concat(a["out"], F.array(kept, over)).alias("out")
        )

    def finish(a):
        return F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text)))

    every = F.array_sort(_all_base(base))
    return F.when(F.size(every) == 0, text).otherwise(F.aggregate(every, start, step, finish))


def _all_base(base):
    return F.concat(*[F.transform(base[kind], lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for kind in KINDS])


class CandidateModel:
    """Trees as SQL over a candidate's features, and a threshold for each generator."""

    def __init__(self, margin, thresholds):
        self.margin, self.thresholds = margin, thresholds


def fit(docs, id_col="doc_id", text_col="text", sample=SAMPLE_DOCUMENTS, rounds=8, depth=3):
    """Trees from at most ``sample`` documents, thresholds from the candidates of all."""
    every = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = every
    chosen = rows.select(F.col("doc_id").alias("chosen")).where(F.col("chosen").isNotNull())
    chosen = chosen.orderBy(F.xxhash64("chosen"), "chosen").limit(sample)
    # at most ``sample`` ids: small enough to be sent to every task
    rows = rows.join(F.broadcast(chosen.distinct()), F.col("doc_id") == F.col("chosen")).drop("chosen")
    rows = rows.withColumn("base", base_spans(F.col("text"))).withColumn("open", without_base(F.col("text"), F.col("base")))
    rows = rows.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1000)) < 1000 * CALIBRATION_SHARE)
    own = F.transform(candidates(F.col("open"), labelled=True), lambda x: F.struct(x["kind"], x["f"], x["label"]))
    forms = F.when(~F.col("held"), F.flatten(F.transform(_masked(F.col("base")), _learned)))
    rows = rows.select("held", own.alias("own"), forms.alias("forms"))
    rows = rows.select("held", F.explode(F.concat("own", F.coalesce("forms", F.slice("own", 1, 0)))).alias("c"))
    rows = rows.select("held", "c.kind", F.col("c.label").cast("double").alias("label"), "c.f.*")
    seen = stage(rows, "pii-candidates").coalesce(4)
    if {r.label for r in seen.where(~F.col("held")).select("label").distinct().collect()} != {0.0, 1.0}:
        return CandidateModel("0D", {})
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(seen)
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=1).fit(vectors.where(~F.col("held")))
    margin = trees.margin(model.toDebugString, [f"f.{name}" for name in FEATURES])
    # what would stay of the candidates of every document
    every = every.withColumn("base", base_spans(F.col("text")))
    every = every.select(candidates(without_base(F.col("text"), F.col("base")), labelled=True).alias("candidates"))
    every = every.select(F.expr(_scored(margin, "x.label as label")).alias("scored"))
    every = every.select(F.explode(apart(F.col("scored"))).alias("x"))
    steps = (
        every.select("x.kind", F.col("x.label").cast("int").alias("label"), F.floor(F.col("x.score") * 100).alias("step"))
        .groupBy("kind", "step")
        .agg(F.sum("label").alias("true"), F.count(F.lit(1)).alias("all"))
        .collect()  # at most 101 rows for each generator
    )
    thresholds = {}
    for kind in GENERATORS:
        true = total = 0
        for row in sorted((r for r in steps if r.kind == kind), key=lambda r: -r.step):
            true, total = true + row.true, total + row["all"]
            if true >= PRECISION * total:
                thresholds[kind] = row.step / 100
    return CandidateModel(margin, thresholds)


def _scored(margin, *others):
    """SQL of the candidates with their scores."""
    fields = ", ".join(["x.kind as kind", "x.s as s", "x.e as e", *others])
    score = margin.replace("f.", "x.f.")
    return f"transform(candidates, x -> struct({fields}, 1D / (1D + exp(-2D * ({score}))) as score))"


def apart(scored):
    """Of candidates that overlap, the higher score stays, then the earlier and the longer one."""
    ordered = F.array_sort(F.transform(scored, lambda x: F.struct(
        (-x["score"]).alias("r"), x["s"].alias("s"), (-x["e"]).alias("r_e"), x["kind"].alias("kind"), x.alias("x"))))
    kept = F.aggregate(
        ordered,
        F.slice(ordered, 1, 0),
        lambda a, y: F.when(
            F.exists(a, lambda z: (z["s"] < -y["r_e"]) & (y["s"] < -z["r_e"])), a
        ).otherwise(F.concat(a, F.array(y))),
    )
    return F.transform(kept, lambda y: y["x"])


def find(docs, model, id_col="doc_id", text_col="text", keep=()):
    """Per row doc_id, the spans of each base kind and ``added`` spans (kind, s, e, score), by column."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *keep)
    rows = rows.withColumn("base", base_spans(F.col("text")))
    if not model.thresholds:
        added = F.array().cast("array<struct<kind:string,s:int,e:int,score:double>>")
        return rows.withColumn("added", added)
    rows = rows.withColumn("open", without_base(F.col("text"), F.col("base")))
    scored = rows.withColumn("candidates", candidates(F.col("open")))
    scored = scored.withColumn("scored", F.expr(_scored(model.margin)))
    limits = " OR ".join(f"(x.kind = '{kind}' AND x.score >= {limit!r}D)" for kind, limit in model.thresholds.items())
    chosen = F.expr(f"filter(scored, x -> {limits})")
    scored = scored.withColumn("free", chosen)
    return scored.withColumn("added", apart(F.col("free"))).drop("open", "candidates", "scored", "free")


def _written(kind, array):
    return F.transform(array, lambda x: F.concat_ws(":", kind, x["s"].cast("string"), x["e"].cast("string")))


def span_strings(found):
    """``base`` and ``added`` of ``find`` as lists of kind:start:end."""
    base = F.concat(*[_written(F.lit(kind), F.col("base")[kind]) for kind in KINDS])
    ordered = F.array_sort(F.transform(F.col("added"), lambda x: F.struct(x["kind"], x["s"], x["e"])))
    added = F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string")))
    return found.withColumn("base_list", base).withColumn("added_list", added)


def redact(found):
    """``find``'s rows with ``redacted``: the text with every span replaced by its kind in brackets."""
    def marked(kind):
        return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind"))

    every = [F.transform(F.col("base")[kind], marked(kind)) for kind in KINDS]
    every.append(F.transform("added", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a, x):
        written = F.array(F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.concat(F.lit("["), x["kind"], F.lit("]")))
        inside = x["s"] < a["at"]  # overlaps the span before: that one covers it, up to the further end
        return F.struct(
            F.greatest(a["at"], x["e"]).alias("at"),
            F.when(inside, a["out"]).otherwise(F.concat(a["out"], written)).alias("out"),
        )

    def finish(a):
        return F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text)))

    return found.withColumn("redacted", F.aggregate(F.array_sort(F.concat(*every)), start, step, finish))
