"""Column expressions over labelled sequences: validation, label parsing, bins, eligibility, digests."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The residue alphabet and the bins' edges.
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
IDENTITY_EDGES = (0.0, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0)
SIZE_BINS = ((1, 1, "1"), (2, 4, "2-4"), (5, 9, "5-9"), (10, 19, "10-19"), (20, None, "20+"))
LENGTH_BINS = ((50, 199), (200, 399), (400, 599), (600, 799), (800, 1000))


def normalized(value: Column) -> Column:
    """Without white space at either end, in upper case."""
    return F.upper(F.regexp_replace(value, r"^\s+|\s+$", ""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for a row, however often and in whichever branches it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def sequence_reason(value: Column, least: int = 50, most: int = 1000, alphabet: str = ALPHABET) -> Column:
    """Null for a valid sequence, else the first reason against it."""

    def reason(seq: Column) -> Column:
        return (
            F.when(seq.isNull() | (seq == ""), "missing")
            .when(seq.rlike(f"[^{alphabet}]"), "invalid_characters")
            .when(F.length(seq) < least, "too_short")
            .when(F.length(seq) > most, "too_long")
        )

    return once(normalized(value), reason)


def sequence_hash(value: Column) -> Column:
    return F.sha2(normalized(value).cast("binary"), 256)


def label_parts(value: Column) -> tuple[Column, Column]:
    """(reason, level-2 label) of a dotted annotation; exactly one of the two is null."""
    text = F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(text, ";"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    one = F.get(parts, 0)
    full = one.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    partial = one.rlike(r"^[0-9]+(\.([0-9]+|-)){0,3}$")
    reason = F.when(F.size(parts) == 0, "missing_label").when(F.size(parts) > 1, "multiple_labels").when(full, F.lit(None)).when(partial, "incomplete_label").otherwise("malformed_label")
    return reason, F.when((F.size(parts) == 1) & full, F.substring_index(one, ".", 2))


def label_order(label: Column) -> list[Column]:
    """Numeric order of dotted labels: 1.2 before 1.10."""
    return [F.split_part(label, F.lit("."), F.lit(1)).cast("int"), F.split_part(label, F.lit("."), F.lit(2)).cast("int"), label]


def seeded_digest(seed: int, *parts: Column) -> Column:
    """SHA-256 of the seed and the parts, one a line; hexadecimal order is byte order."""
    return F.sha2(F.concat_ws("\n", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"), 256)


def group_digest(prefix: str, hashes: Column) -> Column:
    """Name of a group: a digest over its members' hashes, sorted, each with a line feed."""
    return F.concat(F.lit(prefix), F.sha2(F.concat(F.array_join(F.array_sort(hashes), "\n"), F.lit("\n")).cast("binary"), 256))


def identity_bin(identity: Column, no_hit: Column) -> Column:
    """Half-open bins, the last one closed; a row without a hit has its own."""
    out = F.when(no_hit, "no_hit")
    for low, high in zip(IDENTITY_EDGES, IDENTITY_EDGES[1:]):
        inside = (identity >= low) & ((identity < high) if high < 1 else (identity <= high))
        out = out.when(inside, f"{low:.2f}-{high:.2f}")
    return out


def size_bin(size: Column) -> Column:
    out = None
    for low, high, name in SIZE_BINS:
        inside = (size >= low) & (F.lit(True) if high is None else size <= high)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def length_bin(length: Column) -> Column:
    """Bins over 50 to 1000; any other length is an error."""
    out = None
    for low, high in LENGTH_BINS:
        inside = length.between(low, high)
        out = F.when(inside, f"{low}-{high}") if out is None else out.when(inside, f"{low}-{high}")
    return out.otherwise(F.raise_error(F.concat(F.lit("length out of range: "), length.cast("string"))))


def eligibility(rows: Column, groups: Column) -> Column:
    """What may be reported of a stratum with so many rows and groups; the first rule that fits counts."""
    return (
        F.when((rows < 5) | (groups < 3), "privacy_suppressed")
        .when(rows < 20, "insufficient_sequences")
        .when(groups < 10, "insufficient_components_for_ci")
        .otherwise("reportable")
    )


def public_count(count: Column, least: int, private: Column) -> Column:
    """A count as it may be shown: ``<least`` for small ones, hidden where the stratum is private."""
    return F.when(count < least, f"<{least}").when(private, F.lit(None)).otherwise(count.cast("string"))


def reportable(status: Column, value: Column) -> Column:
    return F.when(status.isin("reportable", "insufficient_components_for_ci"), value)


def concordance(*differences: Column) -> Column:
    """positive, negative or zero where all signs agree, else mixed."""
    signs = F.array_distinct(F.array(*[F.signum(d) for d in differences]))
    return F.when(F.size(signs) > 1, "mixed").when(F.get(signs, 0) > 0, "positive").when(F.get(signs, 0) < 0, "negative").otherwise("zero")


def qualifies(coverage: float = 0.8, evalue: float = 1e-3) -> Column:
    """Whether a hit (fident, qcov, tcov, evalue, bits) counts; bounds are inclusive."""
    return (F.col("qcov") >= coverage) & (F.col("tcov") >= coverage) & (F.col("evalue") <= evalue) & F.col("fident").between(0, 1) & (F.col("bits") >= 0)


def hard_scores(label: Column, labels: Sequence[str]) -> Column:
    return F.transform(F.array(*[F.lit(x) for x in labels]), lambda x: F.when(x == label, 1.0).otherwise(0.0))


def fasta_record(header: Column, sequence: Column, width: int = 60) -> Column:
    """A FASTA record with lines of ``width``."""
    return F.concat(F.lit(">"), header, F.lit("\n"), F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n"))
