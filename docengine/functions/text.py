"""Text functions as column expressions: tokens, words, ids, command detection."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words that search ignores.
STOPWORDS = (
    "a", "an", "the", "is", "it", "of", "in", "to", "and", "or", "for", "on", "with", "as", "at", "by", "from", "that", "this", "be", "are", "was",
    "were", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "shall", "should", "may", "might", "can", "could", "not",
    "no", "but", "if", "so", "than", "too", "very", "just", "about", "above", "after", "below", "between", "into", "through", "during", "before",
    "each", "all", "any", "both", "other", "some", "such", "only", "own", "same", "also", "how", "what", "which", "who", "whom", "when", "where",
    "why",
)
# The command vocabulary.
COMMANDS = (
    "ceph-bluestore-tool", "ceph-authtool", "ceph-volume", "ceph-fuse", "ceph-mds", "ceph-mgr", "ceph-mon", "ceph-osd", "ceph-rbdnamer", "cephadm",
    "ceph", "crushtool", "mount.ceph", "radosgw-admin", "rados", "rbd-mirror", "rbd-nbd", "rgw-orphan-list", "rbd",
)
TOKEN = r"[a-z0-9_\-/]+"
DOC_BASE_URL = "https://docs.example.org/en/latest"


def tokens(text: Column) -> Column:
    """Lower-case tokens without stop words, which isin looks up by hash."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin(*STOPWORDS))


def query_tokens(query: str | None) -> list[str]:
    return [t for t in re.findall(TOKEN, (query or "").lower(), re.ASCII) if t not in set(STOPWORDS)]


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def entity_id(source_file: Column, section_path: Column) -> Column:
    return F.substring(F.sha2(F.concat(source_file, F.lit("::"), section_path).cast("binary"), 256), 1, 16)


def component(source_file: Column) -> Column:
    parts = F.split(source_file, "/")
    return F.when(F.size(parts) >= 2, parts[0]).otherwise("unknown")


def topic(source_file: Column) -> Column:
    parts = F.split(source_file, "/")
    return F.when(F.size(parts) >= 3, parts[1]).otherwise("general")


def doc_url(source_file: Column, base: str = DOC_BASE_URL) -> Column:
    return F.concat(F.lit(base + "/"), F.regexp_replace(source_file, r"\.[^./]+$", ""), F.lit("/"))


def _alternatives(vocabulary) -> str:
    return "|".join(re.escape(p) for p in sorted(vocabulary, key=lambda p: (-len(p), p)))


def has_command(text: Column, vocabulary=COMMANDS) -> Column:
    """A command of the vocabulary stands between white space (or a line's beginning) and a boundary."""
    return text.rlike(rf"(?dmU)(?:^|(?<=\s))(?:{_alternatives(vocabulary)})(?=\s|$|[;|&)\"'])")


def command_pattern(vocabulary=COMMANDS) -> str:
    return rf"(?dmU)(?:^|\s|\$\s+)({_alternatives(vocabulary)})(\s+[\w\-]+(?:\s+[\w\-]+){{0,3}})"


def command_matches(text: Column, vocabulary=COMMANDS) -> Column:
    """Each command with its one to four following words, normalised: single spaces, lower case."""
    p = F.lit(command_pattern(vocabulary))
    both = F.zip_with(F.regexp_extract_all(text, p, F.lit(1)), F.regexp_extract_all(text, p, F.lit(2)), lambda a, b: F.concat(a, b))
    return F.transform(both, normal_command)


def normal_command(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def commands_of(title: Column, content: Column, vocabulary=COMMANDS) -> Column:
    """Sorted distinct commands of a chunk, with every prefix of two to five words."""
    whole = command_matches(F.concat(title, F.lit("\n"), content), vocabulary)
    prefixes = F.flatten(F.transform(whole, lambda c: F.transform(F.sequence(F.lit(2), F.size(F.split(c, " "))), lambda n: F.array_join(F.slice(F.split(c, " "), 1, n), " "))))
    return F.array_sort(F.array_distinct(prefixes))
