"""Column expressions over links, walks and sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def overlap_length(cigar: Column | str) -> Column:
    """Bases that a CIGAR overlap spans: M, =, X, I and D count; null, ``*`` and anything without lengths give 0, and so does a length of more than 18 digits."""
    lengths = F.regexp_extract_all(F.coalesce(_col(cigar), F.lit("")), F.lit("([0-9]+)[M=XID]"), F.lit(1))
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda total, x: total + F.coalesce(F.try_to_number(x, F.lit("9" * 18)).cast("long"), F.lit(0)))


def entry_side(orient: Column | str) -> Column:
    """The side by which a step enters: 1 (right) for ``-``, else 0; anything but ``-`` counts as ``+``."""
    return F.when(_col(orient) == "-", 1).otherwise(0)


def exit_side(orient: Column | str) -> Column:
    """The side by which a step leaves, opposite the entry."""
    return F.when(_col(orient) == "-", 0).otherwise(1)


def orient_of_exit(side: Column | str) -> Column:
    return F.when(_col(side) == 1, "+").otherwise("-")


def flip(orient: Column | str) -> Column:
    return F.translate(_col(orient), "+-", "-+")


def reverse_complement(seq: Column | str, mask_others: bool = False) -> Column:
    """Reverse complement in the same case; other letters stay, or become ``N`` with ``mask_others``."""
    seq = _col(seq)
    if mask_others:
        seq = F.regexp_replace(seq, "[^ACGTNacgtn]", "N")
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def oriented(seq: Column | str, orient: Column | str) -> Column:
    return F.when(_col(orient) == "-", reverse_complement(seq)).otherwise(_col(seq))


def canonical_kmer(kmer: Column | str) -> Column:
    """The smaller of an upper-case k-mer and its reverse complement."""
    upper = F.upper(_col(kmer))
    return F.least(upper, reverse_complement(upper))


def kmers(seq: Column | str, k: int) -> Column:
    """All k-mers of a sequence in order; none of a null or shorter one."""
    seq = _col(seq)
    places = F.when(F.length(seq) >= k, F.sequence(F.lit(1), F.length(seq) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(seq, i, F.lit(k)))


def canonical_link(a: Column | str, oa: Column | str, b: Column | str, ob: Column | str) -> Column:
    """A link and the same link seen from its other side have one key: the smaller of both readings."""
    a, oa, b, ob = map(_col, (a, oa, b, ob))
    reading = lambda *c: F.struct(*(x.alias(n) for x, n in zip(c, ("a", "oa", "b", "ob"), strict=True)))
    return F.least(reading(a, oa, b, ob), reading(b, flip(ob), a, flip(oa)))


def walk_string(steps: Column | str) -> Column:
    """``>a<b`` of an array of (name, orient)."""
    return F.array_join(F.transform(_col(steps), lambda s: F.concat(F.when(s.getField("orient") == "-", "<").otherwise(">"), s.getField("name"))), "")


def path_string(steps: Column | str) -> Column:
    """``a+,b-`` of an array of (name, orient)."""
    return F.array_join(F.transform(_col(steps), lambda s: F.concat(s.getField("name"), s.getField("orient"))), ",")


def names_of_walk(walk: Column | str) -> Column:
    """Segment names of ``>a<b``."""
    return F.filter(F.split(_col(walk), "[<>]"), lambda x: x != "")


def percent_identity(nmatch: Column | str, alnlen: Column | str) -> Column:
    """100 nmatch / alnlen; 0 where alnlen is 0 or less or either is null."""
    return F.when(_col(alnlen) > 0, F.coalesce(100.0 * _col(nmatch) / _col(alnlen), F.lit(0.0))).otherwise(0.0)


# Names of organelle sequences, and beginnings of such names.
ORGANELLES = ("MT", "PT", "M", "C", "CP", "CHRMT", "CHRPT", "CHRM", "CHRC", "CHRCP", "MITOCHONDRION", "MITOCHONDRIA", "PLASTID", "CHLOROPLAST")
ORGANELLE_PREFIXES = ("MT_", "PT_", "CHRMT_", "CHRPT_", "CHRM_", "CHRC_", "MITO_", "PLASTID_", "CHLORO_")


def organelle_name(name: Column | str) -> Column:
    """Whether a name is one of an organelle, in any case; null is not."""
    upper = F.upper(_col(name))
    found = upper.isin(*ORGANELLES)
    for prefix in ORGANELLE_PREFIXES:
        found = found | upper.startswith(prefix)
    return F.coalesce(found, F.lit(False))


#: Tags that depth annotation replaces.
DEPTH_TAGS = ("KC", "DP", "dp", "ad", "kn")


def without_depth_tags(tags: Column | str) -> Column:
    """Tab-separated tags without those of an earlier depth annotation; null has none."""
    kept = F.filter(F.split(F.coalesce(_col(tags), F.lit("")), "\t"), lambda t: (t != "") & ~F.split(t, ":")[0].isin(*DEPTH_TAGS))
    return F.array_join(kept, "\t")
