"""Column functions over nucleotide sequences, windows and percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters in the order of their 2-bit codes (fixed values: A 0, C 1, T 2, G 3), so that a complement is the code XOR 2.
ALPHABET = "ACTG"
#: A counter's abundances stop here.
SATURATED = 255
#: Letters of a text as nucleotides, from a to z (fixed values: bits 1 and 2 of the letter).
LETTERS = "".join(ALPHABET[(ord(c) >> 1) & 3] for c in "abcdefghijklmnopqrstuvwxyz")


def nucleotide_code(c: Column) -> Column:
    """The 2-bit code of the first letter, whatever its case: N has the code of G."""
    return F.expr("0") + F.shiftright(F.ascii(c), 1).bitwiseAND(3)


def reverse_complement(seq: Column) -> Column:
    """Of upper-case A, C, G and T; other characters stay as they are."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(seq: Column) -> Column:
    """The lesser of a sequence and its reverse complement, as strings."""
    return F.least(seq, reverse_complement(seq))


def canonical_code(kmer: Column) -> Column:
    """The lesser of the base-4 numbers of a k-mer and its reverse complement (k up to 31)."""
    number = lambda s: F.conv(F.translate(F.upper(s), ALPHABET, "0123"), 4, 10).cast("long")
    return F.least(number(kmer), number(reverse_complement(F.upper(kmer))))


def saturated(count: Column) -> Column:
    return F.least(count, F.lit(SATURATED)).cast("int")


def effective_window(n: Column, window: int) -> Column:
    """The window that a read of n bases has: all of it if the window is 0, negative or larger."""
    return F.when((F.lit(window) <= 0) | (F.lit(window) > n), n).otherwise(F.lit(window))


def percentage(span: Column, window: Column) -> Column:
    """100 * span / window in single precision."""
    return (100 * span / window).cast("float")


def aligned_ratio(pident: Column, length: Column, qlen: Column) -> Column:
    return pident * length / qlen


def header_token(header: Column) -> Column:
    """The first word of a header, without > or @."""
    return F.regexp_replace(F.substring_index(F.trim(header), " ", 1), "^[>@]", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def prefix(seq: Column, size: int) -> Column:
    return F.substring(seq, 1, size)


def suffix(seq: Column, size: int) -> Column:
    return F.right(seq, F.lit(size))


def as_nucleotides(text: Column) -> Column:
    """Any text as a sequence: its letters a to z, lower-cased, by LETTERS; other characters are left out."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", LETTERS)
