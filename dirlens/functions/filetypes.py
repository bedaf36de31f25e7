"""File types by name, temporary files, and type masks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type bits and their names, in bit order.
NAMES = {1: "temp", 2: "vcf", 4: "vcf.gz", 8: "bcf", 16: "sam", 32: "bam", 64: "cram", 128: "fasta", 256: "fastq", 512: "fastq.gz", 1024: "ped/bed", 2048: "compressed", 4096: "text", 8192: "log", 16384: "dir", 32768: "other"}
# Patterns of lower-case base names; the first that matches decides. The SQL twins read them, Spark's columns
# look the same endings up below.
PATTERNS = [
    (16384, "/$"),
    (4, "[.]vcf[.]gz$"),
    (512, "[.](fastq|fq)[.]gz$"),
    (2048, "[.](gz|bgz|tgz|xz|zip|bzip2)$"),
    (2, "[.]vcf$"),
    (8, "[.]bcf$"),
    (16, "[.]sam$"),
    (32, "[.]bam$"),
    (64, "[.]cram$"),
    (128, "[.](fa|fasta)$"),
    (256, "[.](fq|fastq)$"),
    (1024, "[.](ped|map|bed|bim|fam)$"),
    (4096, "[.](csv|tsv|txt|text|md|dat)$|readme$"),
    (8192, "[.](log|out|o|err|e|oe)$"),
]
# Lower-case endings after the last dot; those of two dots come first.
ENDINGS = [
    (2048, ["gz", "bgz", "tgz", "xz", "zip", "bzip2"]),
    (2, ["vcf"]),
    (8, ["bcf"]),
    (16, ["sam"]),
    (32, ["bam"]),
    (64, ["cram"]),
    (128, ["fa", "fasta"]),
    (256, ["fq", "fastq"]),
    (1024, ["ped", "map", "bed", "bim", "fam"]),
    (4096, ["csv", "tsv", "txt", "text", "md", "dat"]),
    (8192, ["log", "out", "o", "err", "e", "oe"]),
]
TEMP, DIR, OTHER, ALL = 1, 16384, 32768, 0xFFFF
TEMP_PATTERN = "^[.]?te?mp[.]|^te?mp/|[.]te?mp/?$"
#: The same of any component that ends in a slash.
TEMP_DIR_PATTERN = "(?:^|/)(?:[.]?te?mp[.][^/]*|te?mp)/|[.]te?mp/"


def file_type(name: Column, compat: bool = False) -> Column:
    """The type bit of a base name. compat: fa or fasta without a dot gives 0."""
    low = F.lower(name)
    ends = lambda *some: reduce(lambda a, b: a | b, [F.endswith(low, F.lit(s)) for s in some])
    ending = F.when(F.contains(low, F.lit(".")), F.substring_index(low, ".", -1))  # looked up, where a search for each rule took most of a listing's time
    out = F.when(ends("/"), DIR).when(ends(".vcf.gz"), 4).when(ends(".fastq.gz", ".fq.gz"), 512)
    out = reduce(lambda c, r: c.when(ending.isin(r[1]), r[0]), ENDINGS, out).when(ends("readme"), 4096)
    return (out.when(ends("fa", "fasta"), 0) if compat else out).otherwise(OTHER)


def _tempish(text: Column) -> Column:
    """What any temporary name has in it, so that others are not searched."""
    return F.contains(F.lower(text), F.lit("mp"))


def is_temp(name: Column) -> Column:
    return _tempish(name) & F.lower(name).rlike(TEMP_PATTERN)


def in_temp_dir(directory: Column) -> Column:
    """Whether any directory on the way is temporary by its name."""
    return _tempish(directory) & F.lower(directory).rlike(TEMP_DIR_PATTERN)


def typed(name: Column, directory: Column) -> Column:
    """The type with the temp bit added."""
    return file_type(name).bitwiseOR(F.when(is_temp(name) | in_temp_dir(directory), TEMP).otherwise(0))


def mask_names(mask: Column) -> Column:
    """The names of a mask's bits, joined by | in bit order."""
    every = F.array(*[F.when(mask.bitwiseAND(bit) > 0, name) for bit, name in NAMES.items()])
    return F.array_join(F.filter(every, lambda x: x.isNotNull()), "|")


def names_mask(names: Column) -> Column:
    """The mask of an array of names; an unknown name is an error."""
    table = F.create_map(*[F.lit(x) for bit, name in NAMES.items() for x in (name, bit)])
    bit = lambda x: F.coalesce(table[x], F.raise_error(F.concat(F.lit("unknown file type: "), x)).cast("int"))
    return F.aggregate(names, F.lit(0), lambda acc, x: acc.bitwiseOR(bit(x)))
