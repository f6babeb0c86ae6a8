"""The stemming rules as DuckDB SQL over a table of terms.

M. F. Porter's algorithm with the measure of a word written as regular expressions: a
run of consonants, a run of vowels, where ``y`` is a vowel after a consonant.  Every step
is a table of ``term``, the word as given, and ``w``, the word so far.
"""

from __future__ import annotations

from postarchive.functions.stem import (
    LONGEST_FIRST_2, LONGEST_FIRST_3, LONGEST_FIRST_4, MAX_BYTES, MIN_BYTES, STEP_2, STEP_3,
)

# A word that begins with y is looked at with a Y, which is a consonant.
CONSONANTS, VOWELS = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"


def has_vowel(word: str) -> str:
    return f"regexp_matches({word}, '^({CONSONANTS})?[aeiouy]')"


def measure_above(word: str, n: int) -> str:
    return f"regexp_matches({word}, '^({CONSONANTS})?({VOWELS}{CONSONANTS}){{{n + 1}}}')"


def measure_one(word: str) -> str:
    return f"regexp_matches({word}, '^({CONSONANTS})?{VOWELS}{CONSONANTS}({VOWELS})?$')"


def short_end(word: str) -> str:
    """The last three letters are consonant, vowel, consonant, the last none of w, x, y."""
    return f"regexp_matches({word}, '([^aeiouy]|[aeiou]y|^Y)[aeiou][^aeiouwxyY]$|[^aeiouy]y[^aeiouwxyY]$')"


def cut(word: str, n: int) -> str:
    return f"left({word}, length({word}) - {n})"


def doubled(word: str) -> str:
    return f"(length({word}) > 1 AND right({word}, 1) = left(right({word}, 2), 1) AND regexp_matches({word}, '[^aeiou]$'))"


def swapped(suffixes: list[str], table: dict[str, str]) -> str:
    """The first suffix that fits is exchanged where what is before it has a measure."""
    cases = []
    for suffix in suffixes:
        root = cut("w", len(suffix))
        cases.append(
            f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {measure_above(root, 0)} "
            f"THEN {root} || '{table[suffix]}' ELSE w END"
        )
    return "CASE " + " ".join(cases) + " ELSE w END"


def dropped() -> str:
    cases = []
    for suffix in LONGEST_FIRST_4:
        root = cut("w", len(suffix))
        also = f" AND regexp_matches({root}, '[st]$')" if suffix == "ion" else ""
        cases.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {measure_above(root, 1)}{also} THEN {root} ELSE w END")
    return "CASE " + " ".join(cases) + " ELSE w END"


def stem_tables(source: str) -> str:
    """CTEs up to ``stems`` (term, stem) of the table ``source`` (term)."""
    ed, ing = cut("w", 2), cut("w", 3)
    steps = [
        # 1a
        f"""CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {cut('w', 2)}
             WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {cut('w', 1)} ELSE w END""",
        # 1b: a mark tells that a suffix went, for the next step
        f"""CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {measure_above(cut('w', 3), 0)} THEN {cut('w', 1)} ELSE w END
             WHEN ends_with(w, 'ed') AND {has_vowel(ed)} THEN {ed} || '-'
             WHEN ends_with(w, 'ing') AND {has_vowel(ing)} THEN {ing} || '-' ELSE w END""",
    ]
    bare = cut("w", 1)
    steps += [
        f"""CASE WHEN NOT ends_with(w, '-') THEN w
             WHEN regexp_matches({bare}, '(at|bl|iz)$') THEN {bare} || 'e'
             WHEN {doubled(bare)} THEN CASE WHEN regexp_matches({bare}, '[lsz]$') THEN {bare} ELSE {cut('w', 2)} END
             WHEN {measure_one(bare)} AND {short_end(bare)} THEN {bare} || 'e' ELSE {bare} END""",
        f"CASE WHEN ends_with(w, 'y') AND {has_vowel(cut('w', 1))} THEN {cut('w', 1)} || 'i' ELSE w END",
        swapped(LONGEST_FIRST_2, STEP_2),
        swapped(LONGEST_FIRST_3, STEP_3),
        dropped(),
        f"""CASE WHEN ends_with(w, 'e') AND ({measure_above(cut('w', 1), 1)}
                  OR ({measure_one(cut('w', 1))} AND NOT {short_end(cut('w', 1))})) THEN {cut('w', 1)} ELSE w END""",
        f"CASE WHEN ends_with(w, 'll') AND {measure_above('w', 1)} THEN {cut('w', 1)} ELSE w END",
    ]
    within = f"octet_length(encode(term)) BETWEEN {MIN_BYTES} AND {MAX_BYTES}"
    tables = [f"stem_0 AS (SELECT term, regexp_replace(term, '^y', 'Y') AS w FROM (SELECT DISTINCT term FROM {source}) s WHERE {within})"]
    tables += [f"stem_{i} AS (SELECT term, {step} AS w FROM stem_{i - 1})" for i, step in enumerate(steps, 1)]
    tables.append(
        f"stems AS (SELECT term, regexp_replace(w, '^Y', 'y') AS stem FROM stem_{len(steps)} "
        f"UNION ALL SELECT DISTINCT term, term FROM {source} WHERE NOT ({within}))"
    )
    return ",\n".join(tables)
