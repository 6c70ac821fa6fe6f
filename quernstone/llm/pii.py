"""Personal data: regular expressions propose spans, validators confirm them, context words adjust the score.

Everything is DataFrame functions. Each kind's pattern wraps its matches in two marker characters by
one ``regexp_replace``; splitting at the markers gives alternating gaps and matches, and running
lengths give every span's place in code points. Patterns are made so that Java's matcher neither
recurses nor backtracks over long runs: separators inside digit groups and domain names are turned
into a third marker first, so every loop runs over one character class.

Kinds, in output order: email, ip, card (Luhn), phone, then those the method adds: iban (mod 97) and
ssn (only with a context word nearby). ``score`` starts from the kind's own trust and rises with a
context word in the ``CONTEXT`` code points before the span; base kinds are kept whatever their score.

Nulls and edges: null text has no spans; a failing match is dropped without another try; repeated
rows get the same spans; other columns pass through, and an existing ``pii`` column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, JOIN = "\x01", "\x02", "\x03"
#: Code points before a span that are searched for context words.
CONTEXT = 40
#: Kind: own trust, context words that raise it, least score.
KINDS = {
    "email": (0.9, "mail|contact|write", 0.0),
    "ip": (0.6, "ip|host|server|address", 0.0),
    "card": (0.8, "card|visa|credit|pay", 0.0),
    "phone": (0.7, "phone|tel|call|fax|mobile", 0.0),
    "iban": (0.9, "iban|bank|account|konto|compte|cuenta", 0.5),
    "ssn": (0.2, "ssn|social|security|tax", 0.5),
}
BOOST = 0.4


def _wrapped(text: Column, pattern: str) -> Column:
    return F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), f"[{OPEN}{CLOSE}]", -1)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of decimal digits passes Luhn's test."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(values, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(text: Column) -> Column:
    """The remainder that IBANs are checked by: letters count as 10 to 35, the first four characters come last."""
    turned = F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4)))

    def step(a: Column, c: Column) -> Column:
        letter = F.ascii(c) >= 65
        value = F.when(letter, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return F.when(F.length(c) == 0, a).otherwise((a * F.when(letter, 100).otherwise(10) + value) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _prepared(text: Column) -> Column:
    return F.translate(text, OPEN + CLOSE + JOIN, "\x04\x04\x04")


LOCAL = r"A-Za-z0-9._%+\x03-"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _proposals(text: Column) -> dict[str, tuple[Column, Column, object]]:
    """Kind: whether the text can hold any, its gaps and matches, and the test of a match."""
    dots = F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", JOIN)
    groups = F.regexp_replace(text, r"(?<=[0-9])[\x20-](?=[0-9])", JOIN)
    email = _wrapped(dots, rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++\x03[A-Za-z0-9\x03-]++")
    ip = _wrapped(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
    card = _wrapped(groups, r"[0-9][0-9\x03]++")
    phone = _wrapped(text, r"\+[0-9][\x20().0-9-]+[0-9]")
    iban = _wrapped(text, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,4})?)(?![A-Za-z0-9])")
    ssn = _wrapped(text, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
    long_digits = text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")
    return {
        "email": (F.contains(text, F.lit("@")), email, None),
        "ip": (text.rlike(r"[0-9]\.[0-9]"), ip, lambda m: m.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")),
        "card": (long_digits, card, lambda m: F.length(_digits(m)).between(16, 19) & luhn(F.substr(_digits(m), F.lit(1), F.lit(20)))),
        "phone": (F.contains(text, F.lit("+")), phone, lambda m: F.length(_digits(m)).between(8, 15)),
        "iban": (text.rlike(r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]"), iban, lambda m: F.length(F.replace(m, F.lit(" "), F.lit(""))).between(15, 34) & (mod97(F.replace(m, F.lit(" "), F.lit(""))) == 1)),
        "ssn": (text.rlike(r"[0-9]-[0-9]{2}-[0-9]"), ssn, None),
    }


SPAN = "struct<kind:string,start:int,end:int,score:double>"
#: Entries of a group of a fold, and characters of a piece of a text that is cut by places.
GROUP, PIECE = 64, 4096


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _level(items: Column, carry: Column, step, kind: str, depth: int) -> Column:
    empty = F.array().cast("array<" * (depth + 1) + kind + ">" * (depth + 1))
    start = F.struct(carry.alias("c"), empty.alias("out"))
    if depth == 0:
        def one(state: Column, item: Column) -> Column:
            after, out = step(state["c"], item)
            return F.struct(after.alias("c"), F.concat(state["out"], out).alias("out"))

        return F.aggregate(items, start, one)
    size = GROUP**depth
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / size), F.lit(0)).cast("int")), lambda g: F.slice(items, g * size + 1, F.lit(size)))
    return F.aggregate(groups, start, lambda state, group: _let(_level(group, state["c"], step, kind, depth - 1), lambda r: F.struct(r["c"].alias("c"), F.concat(state["out"], F.array(r["out"])).alias("out"))))


def _folded(items: Column, carry: Column, step, kind: str) -> Column:
    """All outputs of a fold, and its last carry: ``step(carry, item)`` gives the next carry and an array of outputs.

    Outputs are gathered in groups of groups, since an array that grows by one entry at a time is copied every time.
    """
    done = _let(items, lambda all_: _level(all_, carry, step, kind, 2))
    return _let(done, lambda r: F.struct(r["c"].alias("c"), F.flatten(F.flatten(r["out"])).alias("out")))


def _spans(kind: str, can: Column, pieces: Column, test) -> Column:
    trust, words, least = KINDS[kind]
    none = F.array().cast(f"array<{SPAN}>")

    def step(carry: Column, piece: Column) -> tuple[Column, Column]:
        at, end = carry["at"], carry["at"] + F.length(piece["p"])
        score = F.lit(trust) + F.when(F.lower(carry["near"]).rlike(rf"\b(?:{words})"), BOOST).otherwise(0.0)
        ok = piece["i"] % 2 == 1 if test is None else (piece["i"] % 2 == 1) & test(piece["p"])
        if least > 0:
            ok = ok & (score >= least)
        one = F.array(F.struct(F.lit(kind).alias("kind"), at.alias("start"), end.alias("end"), F.least(score, F.lit(1.0)).alias("score"))).cast(f"array<{SPAN}>")
        # the last characters so far; marks that stand for dots and joints are no word characters either
        near = F.right(F.concat(carry["near"], F.right(piece["p"], F.lit(CONTEXT))), F.lit(CONTEXT))
        return F.struct(end.alias("at"), near.alias("near")), F.when(ok, one).otherwise(none)

    numbered = F.transform(pieces, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("near"))
    return F.when(can, _folded(numbered, start, step, SPAN)["out"]).otherwise(none)


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``pii``: an array of (kind, start, end, score), by kind in the order of ``KINDS``, then start."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ready = _prepared(text)
    parts = [_spans(kind, *found) for kind, found in _proposals(ready).items()]
    return docs.withColumn("pii", F.concat(*parts))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with each span replaced by its kind in brackets; of overlapping spans the earlier, then longer one counts."""
    text = F.col(text_col)
    ordered = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus"), s["kind"].alias("kind"))))
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def between(pieces: Column, low: Column, high: Column) -> Column:
        first, last = F.floor(low / PIECE).cast("int"), F.floor(high / PIECE).cast("int")
        head, tail = F.substr(F.get(pieces, first), low % PIECE + 1), F.coalesce(F.substr(F.get(pieces, last), F.lit(1), high % PIECE), F.lit(""))
        inside = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        return F.when(first == last, F.coalesce(F.substr(F.get(pieces, first), low % PIECE + 1, high - low), F.lit(""))).otherwise(F.concat(head, inside, tail))

    def replaced(pieces: Column) -> Column:
        def step(at: Column, s: Column) -> tuple[Column, Column]:
            taken = s["start"] >= at
            new = F.array(between(pieces, at, s["start"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
            return F.when(taken, -s["minus"]).otherwise(at), F.when(taken, new).otherwise(F.array().cast("array<string>"))

        return _let(_folded(ordered, F.lit(0), step, "string"), lambda r: F.concat(F.array_join(r["out"], ""), between(pieces, r["c"], F.length(text))))

    done = _let(cut, replaced)
    found = find_pii(docs, text_col)
    return found.withColumn(text_col, F.when(F.size("pii") > 0, done).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])
