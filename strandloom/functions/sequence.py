"""Column functions on nucleotide and plain text: composition, k-mers, runs, codons, spans. All run inside the JVM.

Unless stated, a null input gives null, an empty text gives 0 where a count or share is asked for, and case is ignored
for bases. Higher-order functions keep one row per record; nothing is exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")
#: The standard genetic code, codons in the order T, C, A, G by position; ``*`` ends translation.
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def codon_table() -> dict[str, str]:
    order = "TCAG"
    return {a + b + c: AMINO[16 * i + 4 * j + k] for i, a in enumerate(order) for j, b in enumerate(order) for k, c in enumerate(order)}


def _literal_map(values: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for k in values for x in (k, values[k])])


def occurrences(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def n_acgt(seq: Column) -> Column:
    return occurrences(seq, "ACGTacgt")


def gc_of_acgt(seq: Column) -> Column:
    """(G + C) / (A + C + G + T); 0.0 if there is no base."""
    n = n_acgt(seq)
    return F.when(n > 0, occurrences(seq, "GCgc") / n).when(seq.isNotNull(), F.lit(0.0))


def gc_of_length(seq: Column) -> Column:
    """(G + C) / length; 0.0 for the empty text. Differs from ``gc_of_acgt`` where other letters occur."""
    return F.when(F.length(seq) > 0, occurrences(seq, "GCgc") / F.length(seq)).when(seq.isNotNull(), F.lit(0.0))


def other_share(seq: Column) -> Column:
    """Share of characters that are not A, C, G, T; 0.0 for the empty text."""
    return F.when(F.length(seq) > 0, 1 - n_acgt(seq) / F.length(seq)).when(seq.isNotNull(), F.lit(0.0))


def longest_run(text: Column) -> Column:
    """Length of the longest run of one character; 0 for the empty text."""
    runs = F.regexp_extract_all(text, F.lit(r"(?s)((.)\2*)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.when(text.isNotNull(), F.lit(0)))


def reverse_complement(seq: Column) -> Column:
    """Complement of the reversed text; case stays, other letters stay as they are."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def kmers(text: Column, k: int) -> Column:
    """All k-mers in order, an empty array where the text is shorter.

    One pass with an overlapping match: ``substring`` in a lambda would walk the text from its start for every k-mer.
    """
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def blocks(text: Column, width: int) -> Column:
    """The text in consecutive pieces of ``width``; a shorter rest at the end is left out."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{width}}}"), F.lit(0))


def kmer_set(text: Column, k: int) -> Column:
    return F.array_distinct(kmers(text, k))


def lesser_strand(kmer: Column) -> Column:
    """The lesser of an upper-case k-mer and its reverse complement."""
    return F.least(kmer, F.reverse(F.translate(kmer, "ACGTN", "TGCAN")))


def canonical(kmer: Column) -> Column:
    """The lesser of a k-mer and its reverse complement, in upper case."""
    return lesser_strand(F.upper(kmer))


def canonical_kmer_set(seq: Column, k: int) -> Column:
    """Distinct canonical k-mers of the upper-cased text; empty where it is shorter than k."""
    return F.array_distinct(F.transform(kmers(F.upper(seq), k), lesser_strand))


def hash32(kmer: Column) -> Column:
    """32 bits of MD5, the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.encode(kmer, "utf-8")), 1, 8), 16, 10).cast("bigint")


def crc_set(kmers_: Column) -> Column:
    """CRC-32 of each k-mer, distinct."""
    return F.array_distinct(F.transform(kmers_, lambda k: F.crc32(F.encode(k, "utf-8"))))


def bottom_sketch(hashes: Column, n: int) -> Column:
    """The ``n`` smallest distinct hashes, ascending."""
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, n)


def sketch_jaccard(a: Column, b: Column, n: int) -> Column:
    """Bottom-n estimate of the Jaccard index: shared members among the n smallest of the union; 0.0 for empty ones."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, n)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) > 0, both / F.size(union)).otherwise(0.0)


def containment(query: Column, reference: Column) -> Column:
    """Share of ``query``'s members that are in ``reference``; 0.0 for an empty query."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, reference)) / F.size(query)).otherwise(0.0)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` uses it, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def counts(items: Column) -> Column:
    """Array of (item, n) for the distinct members."""
    return let(items, lambda all_: F.transform(F.array_distinct(all_), lambda x: F.struct(x.alias("item"), F.size(F.filter(all_, lambda y: y == x)).alias("n"))))


def pair_entropy(text: Column) -> Column:
    """Shannon entropy in bits of neighbouring character pairs of the upper-cased text; 0.0 below two characters."""
    n = (F.length(text) - 1).cast("double")
    bits = F.aggregate(counts(kmers(F.upper(text), 2)), F.lit(0.0), lambda s, p: s - (p["n"] / n) * F.log2(p["n"] / n))
    return F.when(F.length(text) < 2, F.lit(0.0)).otherwise(bits)


def pair_ratios(text: Column) -> Column:
    """Map of each neighbouring pair to observed / expected frequency under independence."""
    n, m = F.length(text).cast("double"), (F.length(text) - 1).cast("double")

    def share(c: Column) -> Column:
        return (n - F.length(F.replace(text, c, F.lit("")))) / n

    def ratio(p: Column) -> Column:
        expected = share(F.substring(p["item"], 1, 1)) * share(F.substring(p["item"], 2, 1)) * m
        return F.struct(p["item"].alias("item"), (p["n"] / expected).alias("ratio"))

    return F.map_from_entries(F.transform(counts(kmers(text, 2)), ratio))


def rmsd(observed: Column, reference: dict[str, float]) -> Column:
    """Root mean squared difference over the keys that both have; infinity if none."""
    ref = _literal_map({k: float(v) for k, v in reference.items()})

    def distance(own: Column) -> Column:
        keys = F.array_intersect(F.map_keys(own), F.map_keys(ref))
        total = F.aggregate(keys, F.lit(0.0), lambda s, k: s + F.pow(own[k] - ref[k], 2))
        return F.when(F.size(keys) > 0, F.sqrt(total / F.size(keys))).otherwise(F.lit(float("inf")))

    return let(observed, distance)


def relative_adaptiveness(frequency: dict[str, float]) -> dict[str, float]:
    """Each codon's frequency over that of the commonest codon of its amino acid; stops and unused amino acids left out."""
    table = codon_table()
    best: dict[str, float] = {}
    for codon, aa in table.items():
        best[aa] = max(best.get(aa, 0.0), frequency.get(codon, 0.0))
    return {c: frequency.get(c, 0.0) / best[aa] for c, aa in table.items() if aa != "*" and best[aa] > 0}


def codons(seq: Column) -> Column:
    """In-frame codons of the upper-cased sequence; a rest of one or two bases is left out."""
    return blocks(F.upper(seq), 3)


def adaptation_index(seq: Column, weights: dict[str, float]) -> Column:
    """Geometric mean of the weights of the in-frame codons that have one above 0; null if there is none."""
    w = _literal_map({k: float(v) for k, v in weights.items() if v > 0})
    logs = F.filter(F.transform(codons(seq), lambda c: F.log(F.try_element_at(w, c))), lambda x: x.isNotNull())
    return let(logs, lambda own: F.when(F.size(own) > 0, F.exp(F.aggregate(own, F.lit(0.0), lambda s, x: s + x) / F.size(own))))


def translated(seq: Column) -> Column:
    """Amino acids of the in-frame codons; codons with other letters give X."""
    table = _literal_map(codon_table())
    return F.array_join(F.transform(codons(seq), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), "")


def last_stop_trim(seq: Column) -> Column:
    """The text up to and including the last stop codon of any of the three frames; unchanged if there is none."""
    triples = kmers(F.upper(seq), 3)
    ends = F.filter(F.transform(triples, lambda t, i: F.when(t.isin("TAA", "TAG", "TGA"), i + 3)), lambda e: e.isNotNull())
    return F.when(F.size(ends) > 0, F.substring(seq, F.lit(1), F.array_max(ends))).otherwise(seq)


def residue_span(start: Column, end: Column, strand: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """Nucleotide span [s, e) of residues first..last (1-based) of a gene [start, end); counted from the high end on the
    reverse strand and clamped to the gene."""
    low = F.when(strand >= 0, start + 3 * (first - 1)).otherwise(end - 3 * last)
    high = F.when(strand >= 0, start + 3 * last).otherwise(end - 3 * (first - 1))
    return F.greatest(start, low), F.least(end, high)


def centre(text: Column, limit: int) -> Column:
    """Texts over ``limit`` characters cut to the ``limit`` around their midpoint."""
    n = F.length(text)
    first = F.floor(n / 2).cast("int") - limit // 2
    return F.when(n > limit, F.substring(text, first + 1, F.lit(limit))).otherwise(text)


def fraction(text: Column, share: float, start: float = 0.0) -> Column:
    """The part of a text from ``start`` on that is ``share`` of its own length, both rounded down."""
    n = F.length(text)
    return F.substring(text, F.floor(n * start).cast("int") + 1, F.floor(n * share).cast("int"))


def cleaned(text: Column) -> tuple[Column, Column, Column]:
    """(leading A, C, G, T, N run before the first ``|END|``, whether the mark was there, whether letters were cut off)."""
    head = F.substring_index(text, "|END|", 1)
    kept = F.regexp_extract(F.upper(head), "^[ACGTN]*", 0)
    return kept, text.contains("|END|"), F.length(kept) < F.length(head)


def within_range(seq: Column, width: int, low: float, high: float) -> Column:
    """Whether the GC share of the first ``width`` bases lies in [low, high]; null where they hold other letters or none."""
    head = F.substring(F.upper(seq), 1, width)
    gc = gc_of_length(head)
    return F.when(head.rlike("^[ACGT]+$"), (gc >= low) & (gc <= high))
