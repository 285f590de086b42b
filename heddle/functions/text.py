"""Scalar text functions, Column to Column, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Clause patterns, tried in this order at the start of a trimmed heading.
CLAUSE_PATTERNS = (
    r"(?i)^(Article\s+\d+[a-z]?)\b",
    r"(?i)^(Annex\s+[A-Z](?:\.\d+)*)\b",
    r"^([A-Z]\.\d+(?:\.\d+)*)\b",
    r"^(\d+(?:\.\d+)+)\b",
)
#: Words that lexical search leaves out.
STOP_WORDS = ("the", "of", "and", "a", "in", "to", "is", "was", "it", "for", "with", "on", "as", "at", "by", "an", "be", "or", "from", "this", "that")


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def sha256_hex(column: Column) -> Column:
    return F.sha2(column, 256)


def clause_number(heading: Column) -> Column:
    """Clause label at the start of a heading, or null."""
    return first_filled(*(F.regexp_extract(F.trim(heading), p, 1) for p in CLAUSE_PATTERNS))


def path_label(text: Column) -> Column:
    """A label of a path: other characters than letters, digits and ``_`` run together to one ``_``."""
    squeezed = F.regexp_replace(F.trim(text), "[^a-zA-Z0-9_]+", "_")
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(squeezed, "^_+|_+$", "")), F.lit("")), F.lit("section"))


def path_join(*labels: Column) -> Column:
    return F.concat_ws(".", *labels)


def in_subtree(path: Column, root: str) -> Column:
    """Descendant or self; the range is what reaches the Parquet statistics."""
    return (path == root) | path.startswith(root + ".")


def document_slug(filename: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(filename, r"\.[^.]*$", "")


def object_key(digest: Column, filename: Column) -> Column:
    return F.concat_ws("/", digest, filename)


def normalize_name(name: Column) -> Column:
    """Lower case, other characters than a-z, 0-9 and white space deleted, white space run together."""
    kept = F.regexp_replace(F.lower(F.trim(name)), r"(?U)[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def lexemes(text: Column) -> Column:
    """Lower-case words of a text in order, stop words included so that positions count them."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def letter_counts(text: Column) -> Column:
    """How often each of the letters a-z stands in a text, in either case: a vector that needs no model."""
    low = F.lower(text)
    return F.array(*((F.length(low) - F.length(F.replace(low, F.lit(chr(c)), F.lit("")))).cast("double") for c in range(97, 123)))


def token_count(text: Column) -> Column:
    """Default for the tokenizer seam: words between spaces."""
    return F.size(F.regexp_extract_all(text, F.lit("[^ ]+"), F.lit(0)))


def quoted(name: Column) -> Column:
    """In single quotes, or in double ones if the name has a single and no double quote."""
    double = name.contains("'") & ~name.contains('"')
    return F.when(double, F.concat(F.lit('"'), name, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("\\'")), F.lit("'")))


def fact(label: Column, source_type: Column, source: Column, relation: Column, target_type: Column, target: Column) -> Column:
    """One graph fact as a line of a prompt."""
    return F.concat(
        F.lit("["), label, F.lit("] "), source_type, F.lit(":"), quoted(source), F.lit(" --"), relation, F.lit("--> "), target_type, F.lit(":"), quoted(target)
    )


def back_off(base: Column, attempt: Column) -> Column:
    return base * F.pow(F.lit(2.0), attempt)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if their lengths differ or a norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / F.nullif(norm, F.lit(0.0)))
