"""Functions of sequences and identifiers, as columns of built-in expressions."""

from __future__ import annotations

from functools import cache
from itertools import product

from pyspark.sql import Column, functions as F

# The standard genetic code with bases in the order T, C, A, G; codons in which the other
# public translation tables differ from it; nucleotide ambiguity codes; their complements.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
DIFFERENCES = {
    1: {},
    2: {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"},
    3: {"ATA": "M", "CTT": "T", "CTC": "T", "CTA": "T", "CTG": "T", "TGA": "W"},
    4: {"TGA": "W"},
    5: {"AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"},
    6: {"TAA": "Q", "TAG": "Q"},
    9: {"AAA": "N", "AGA": "S", "AGG": "S", "TGA": "W"},
    10: {"TGA": "C"},
    11: {},
    12: {"CTG": "S"},
    13: {"AGA": "G", "AGG": "G", "ATA": "M", "TGA": "W"},
    14: {"AAA": "N", "AGA": "S", "AGG": "S", "TAA": "Y", "TGA": "W"},
    16: {"TAG": "L"},
    21: {"TGA": "W", "ATA": "M", "AGA": "S", "AGG": "S", "AAA": "N"},
    22: {"TCA": "*", "TAG": "L"},
    23: {"TTA": "*"},
    24: {"AGA": "S", "AGG": "K", "TGA": "W"},
    25: {"TGA": "G"},
    26: {"CTG": "A"},
    27: {"TAA": "Q", "TAG": "Q", "TGA": "W"},
    28: {"TAA": "Q", "TAG": "Q", "TGA": "W"},
    29: {"TAA": "Y", "TAG": "Y"},
    30: {"TAA": "E", "TAG": "E"},
    31: {"TAA": "E", "TAG": "E", "TGA": "W"},
    32: {"TAG": "W"},
    33: {"TAA": "Y", "TGA": "W", "AGA": "S", "AGG": "K"},
}
AMBIGUOUS = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
COMPLEMENT = ("ACGTUMRWSYKVHDBNacgtumrwsykvhdbn", "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn")


@cache
def code(table: int = 11) -> str:
    """The 64 residues of a translation table, ``*`` for stops."""
    own = dict(zip(map("".join, product("TCAG", repeat=3)), STANDARD, strict=True)) | DIFFERENCES[table]
    return "".join(own[c] for c in map("".join, product("TCAG", repeat=3)))


@cache
def ambiguous_codons(table: int = 11) -> dict[str, str]:
    """Codons with ambiguity codes that mean one residue, or one of the pairs B, Z and J; others are X."""
    own = dict(zip(map("".join, product("TCAG", repeat=3)), code(table), strict=True))
    pairs = {frozenset("ND"): "B", frozenset("QE"): "Z", frozenset("IL"): "J"}
    out = {}
    for c in map("".join, product("ACGT" + "".join(AMBIGUOUS), repeat=3)):
        if c not in own:
            means = frozenset(own["".join(x)] for x in product(*(AMBIGUOUS.get(b, b) for b in c)))
            if len(means) == 1 or means in pairs:
                out[c] = pairs.get(means) or next(iter(means))
    return out


def slice_bases(seq: Column, start0: Column, end: Column) -> Column:
    """Bases ``start0`` (from 0) up to ``end``, which is left out."""
    return F.substring(seq, start0 + 1, end - start0)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, *COMPLEMENT))


def stranded(seq: Column, strand: Column) -> Column:
    """The reverse complement where the strand is ``-``; anything else reads forward."""
    return F.when(strand == "-", reverse_complement(seq)).otherwise(seq)


def translate_cds(seq: Column, table: int = 11) -> Column:
    """Residues of whole codons, stops left out wherever they are; an empty sequence gives ''.

    A codon's three bases are digits of its residue's place in the table. A text with ambiguity codes is put together from its
    codons by patterns, one for each residue that such codons can mean.
    """
    residues = F.array(*[F.lit("" if r == "*" else r) for r in code(table)])
    kinds: dict[str, list[str]] = {}
    for c, r in [*zip(map("".join, product("TCAG", repeat=3)), code(table), strict=True), *ambiguous_codons(table).items()]:
        kinds.setdefault("" if r == "*" else r, []).append(c)
    digit = lambda c, i: F.ascii(F.substring(c, i, 1)) - 48

    def whole(text):
        codons = F.slice(F.split(F.translate(text, "TCAG", "0123"), r"(?<=\G.{3})"), 1, F.floor(F.length(text) / 3).cast("int"))
        plain = F.array_join(F.transform(codons, lambda c: F.get(residues, digit(c, 1) * 16 + digit(c, 2) * 4 + digit(c, 3))), "")
        rare = F.regexp_replace(F.regexp_replace(text, "(?s)(.{3})", "$1,"), "[^,]{1,2}$", "")
        for r, cs in kinds.items():
            rare = F.regexp_replace(rare, f"(?:{'|'.join(cs)}),", r)
        return F.when(text.rlike("[^TCAG]"), F.regexp_replace(rare, "(?s)[^,]{3},", "X")).otherwise(plain)

    # bound as a variable, so that the sequence's own expression runs once and not once a codon
    return F.transform(F.array(F.translate(F.upper(seq), "U", "T")), whole)[0]


def back_translate(aligned: Column, nt: Column) -> Column:
    """Codons of ``nt`` laid on an aligned protein: a gap is three gaps, each residue takes the next codon.

    The protein is cut into runs of residues and of gaps; the residues before a run give the place of its codons, which are taken as one piece.
    """
    def laid(pair):
        runs = F.filter(F.split(F.regexp_replace(pair["a"], "(-+)", ",$1,"), ","), lambda r: r != "")
        sizes = F.transform(runs, lambda r: F.when(F.startswith(r, F.lit("-")), F.lit(0)).otherwise(F.length(r)))
        starts = lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda x, y: x + y)
        return F.array_join(F.transform(runs, lambda r, i: F.when(F.startswith(r, F.lit("-")), F.repeat(r, F.lit(3))).otherwise(F.substring(pair["n"], starts(i) * 3 + 1, F.length(r) * 3))), "")

    # bound as a variable, so that the sequences' own expressions run once and not once a run
    return F.coalesce(F.transform(F.array(F.struct(aligned.alias("a"), nt.alias("n"))), laid)[0], F.lit(""))


def seq_ids(gene_id: Column) -> Column:
    """(sample_id, seq_id) of ``sample-contig-tag``; the tag may have dashes."""
    parts = F.split(gene_id, "-", 3)
    return F.struct(parts[0].alias("sample_id"), F.try_element_at(parts, F.lit(2)).alias("seq_id"))


def no_dash(x: Column) -> Column:
    return F.translate(x, "-", "_")


def attribute(attrs: Column, key: str) -> Column:
    """The last value of a key in ``k=v;k=v``, or null."""
    found = F.filter(F.split(attrs, ";"), lambda a: F.startswith(a, F.lit(f"{key}=")))
    return F.substring(F.try_element_at(found, F.lit(-1)), F.lit(len(key) + 2), F.lit(1 << 30))


def clean_name(x: Column) -> Column:
    """Everything but letters, digits and underscores, of any script, becomes an underscore."""
    return F.regexp_replace(x, r"(?U)\W", "_")


def canonical_gene_id(raw: Column, sample_id: Column, seq_id: Column) -> Column:
    """``sample-contig-tag``, whatever of it the raw id already has."""
    contig = F.concat(sample_id, F.lit("-"), seq_id, F.lit("-"))
    rest = F.when(F.startswith(raw, F.concat(sample_id, F.lit("-"))), F.substr(raw, F.length(sample_id) + 2)).otherwise(raw)
    return F.when(F.startswith(raw, contig), raw).when(F.startswith(rest, F.concat(seq_id, F.lit("-"))), F.concat(sample_id, F.lit("-"), rest)).otherwise(F.concat(contig, rest))


def suffixed(base: Column, n: Column) -> Column:
    return F.concat(base, F.format_string("_%05d", n))


def rounded(x: Column, places: int = 2) -> Column:
    """Rounds as Python does, from the double's exact value, half to even; for exports.

    A decimal of a double in Spark is that of its shortest text, so the exact value is taken in Python.
    """
    import pandas as pd

    def run(s):
        return s.map(lambda v: round(v, places), na_action="ignore")

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(x)
