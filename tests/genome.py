"""Small genomes with known genes."""

import random
from itertools import product

from genoloom.functions.sequences import code

CODONS: dict = {}
for c, a in zip(map("".join, product("TCAG", repeat=3)), code(11), strict=True):
    CODONS.setdefault(a, []).append(c)
RESIDUES = "ARNDCQEGHILKMFPSTWYV"


def protein(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(RESIDUES) for _ in range(n))


def mutated(rng: random.Random, p: str, share: float) -> str:
    return "".join(rng.choice(RESIDUES) if rng.random() < share else x for x in p)


def dna(rng: random.Random, p: str) -> str:
    return "".join(rng.choice(CODONS[a]) for a in p) + "TAA"


def revcomp(s: str) -> str:
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def write(path, rng: random.Random, genes: list[tuple[str, str]], share: float = 0.0, contig: str = "c1") -> None:
    """A GFF file with its FASTA tail; every third gene is on the other strand."""
    seq, lines = "", []
    for k, (tag, p) in enumerate(genes):
        nt = dna(rng, mutated(rng, p, share))
        at = len(seq) + 10
        seq += "ACGTACGTAC" + (revcomp(nt) if k % 3 == 2 else nt)
        lines.append(f"{contig}\tx\tCDS\t{at + 1}\t{at + len(nt)}\t.\t{'-' if k % 3 == 2 else '+'}\t0\tID={tag};gene={tag};product=product of {tag}")
    body = "\n".join(seq[i : i + 60] for i in range(0, len(seq), 60))
    path.write_text("##gff-version 3\n" + "\n".join(lines) + f"\n##FASTA\n>{contig} a contig\n{body}\n")
