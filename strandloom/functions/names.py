"""Column functions on labels, ids and lineage tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ranks of a lineage tag and their prefixes, from the root down.
RANKS = {"domain": "d", "phylum": "p", "class": "c", "order": "o", "family": "f", "genus": "g", "species": "s"}


def bucket_label(n: Column, bounds: list[int]) -> Column:
    """``<=b`` for the first bound that holds n, else ``>last``; null for null."""
    out = F.when(n > bounds[-1], f">{bounds[-1]}")
    for b in reversed(bounds):
        out = F.when(n <= b, f"<={b}").otherwise(out)
    return F.when(n.isNotNull(), out)


def bucket_label_k(n: Column, bounds: list[int]) -> Column:
    """As ``bucket_label`` with bounds in thousands (1,024), rounded down: ``<=16k``, ``>131k``."""
    out = F.when(n > bounds[-1], f">{bounds[-1] // 1000}k")
    for b in reversed(bounds):
        out = F.when(n <= b, f"<={b // 1000}k").otherwise(out)
    return F.when(n.isNotNull(), out)


def half_open_label(n: Column, edges: list[int]) -> Column:
    """``[a, b)`` for the pair of edges around n; null outside the edges."""
    out = F.lit(None).cast("string")
    for a, b in zip(edges, edges[1:], strict=False):
        out = F.when((n >= a) & (n < b), f"[{a}, {b})").otherwise(out)
    return out


def safe_name(name: Column, upper: bool = True) -> Column:
    """Letters, digits and single underscores; everything else becomes an underscore, none at the ends."""
    text = F.upper(name) if upper else name
    kept = F.regexp_replace(text, "[^A-Z0-9_]" if upper else r"[^A-Za-z0-9_ .\-]", "_")
    return F.regexp_replace(F.regexp_replace(kept, "_+", "_"), "^_+|_+$", "")


def lineage_tag(names: dict[str, Column], upper: bool = True) -> Column:
    """``|D__A;P__B;...|`` from the ranks that are there; ``|TAX:UNKNOWN|`` if none is. Two dialects: upper case with
    sanitised names, or lower-case prefixes with the names as they are."""
    parts = []
    for rank, prefix in RANKS.items():
        if rank in names:
            value = safe_name(names[rank]) if upper else F.trim(names[rank])
            parts.append(F.when(F.length(value) > 0, F.concat(F.lit(f"{prefix.upper() if upper else prefix}__"), value)))
    inner = F.array_join(F.array_compact(F.array(*parts)), ";")
    return F.when(inner != "", F.concat(F.lit("|"), inner, F.lit("|"))).otherwise("|TAX:UNKNOWN|")


def tag_rank(tag: Column, prefix: str) -> Column:
    """The name behind ``prefix__`` in a lineage tag, in any case and with stray blanks; null if missing or empty."""
    name = F.trim(F.regexp_extract(tag, f"(?i)(?:^|[;|])\\s*{prefix}__([^;|]*)", 1))
    return F.when(name != "", name)


def tag_columns(tag: Column) -> dict[str, Column]:
    """The seven ranks of a lineage tag as columns."""
    return {rank: tag_rank(tag, prefix) for rank, prefix in RANKS.items()}


def compound_token(name: Column) -> Column:
    """Lower case, blanks as underscores, only a-z, 0-9, underscore, plus and minus; ``unknown`` if nothing is left."""
    text = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"\s+", "_"), "[^a-z0-9_+-]", "")
    return F.when(text != "", text).otherwise("unknown")


def genome_of(accession: Column) -> Column:
    """The part before ``.region``, or all of it."""
    return F.substring_index(accession, ".region", 1)


def group_key(field: Column, accession: Column, content: Column, name: str = "g") -> Column:
    """``name::field``, else ``a::accession``, else ``h::md5`` of the content; blank counts as missing."""
    def given(c: Column) -> Column:
        return F.when(F.length(c) > 0, c)

    return F.coalesce(F.concat(F.lit(f"{name}::"), given(field)), F.concat(F.lit("a::"), given(accession)), F.concat(F.lit("h::"), F.md5(F.encode(F.coalesce(content, F.lit("")), "utf-8"))))


def source_of(accession: Column, source: Column, prefixes: dict[str, str], default: str) -> Column:
    """The source named by the id's prefix, else the given one, else ``default``."""
    out = F.lit(None).cast("string")
    for prefix, name in prefixes.items():
        out = F.when(F.upper(F.trim(accession)).startswith(prefix.upper()), name).otherwise(out)
    return F.coalesce(out, source, F.lit(default))


def taxon_id(record: Column) -> Column:
    """The number of the first ``/db_xref="taxon:N"``; null if there is none."""
    return F.nullif(F.regexp_extract(record, '/db_xref="taxon:([0-9]+)"', 1), F.lit("")).cast("int")


def organism(record: Column) -> Column:
    """What follows ORGANISM on its line; null if there is none or only a dot."""
    name = F.trim(F.regexp_extract(record, r"(?m)^\s*ORGANISM[ \t]+(.*)$", 1))
    return F.when((name != "") & (name != "."), name)


def organism_lineage(record: Column) -> Column:
    """The ranks listed under ORGANISM, in order, without dots and blanks."""
    block = F.regexp_extract(record, r"(?m)^\s*ORGANISM[ \t]+[^\n]*\n((?:[ \t]+[^\n]*\n?)*)", 1)
    tokens = F.transform(F.split(F.regexp_replace(block, r"\s+", " "), ";"), lambda t: F.rtrim(F.regexp_replace(F.trim(t), r"\.$", "")))
    return F.filter(tokens, lambda t: t != "")


def positional_tag(record: Column) -> Column:
    """A lineage tag by position: the first six listed ranks as domain to genus, the ORGANISM line as species."""
    lineage = organism_lineage(record)
    names = {rank: F.get(lineage, F.lit(i)) for i, rank in enumerate(list(RANKS)[:6])}
    return F.when(organism(record).isNotNull(), lineage_tag(names | {"species": organism(record)})).otherwise("|TAX:UNKNOWN|")


def path_step(path: Column) -> Column:
    """The number after the last ``step`` in a path."""
    return F.nullif(F.regexp_extract(path, r".*step[_-]?([0-9]+)", 1), F.lit("")).cast("bigint")


def floored(step: Column, k: int) -> Column:
    """The last multiple of ``k`` not above ``step``."""
    return step - F.pmod(step, F.lit(k))


def map_entropy(probabilities: Column) -> Column:
    """Entropy of a map of probabilities over that of the uniform one, in [0, 1]; 0.0 below two entries."""
    p = F.map_values(probabilities)
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    bits = F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x / total * F.log(x / total)).otherwise(0.0))
    return F.when(F.size(p) >= 2, bits / F.log(F.size(p).cast("double"))).otherwise(0.0)


def map_margin(probabilities: Column) -> Column:
    """The greatest value less the second; null below two entries."""
    top = F.sort_array(F.map_values(probabilities), asc=False)
    return F.when(F.size(top) >= 2, F.get(top, F.lit(0)) - F.get(top, F.lit(1)))


def map_best(probabilities: Column) -> Column:
    """The key of the greatest value; ties: the first in key order."""
    entries = F.array_sort(F.transform(F.map_entries(probabilities), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return F.get(entries, F.lit(0))["k"]
