"""Validators of canonical strings, as SQL expressions. The texts of the errors that they give."""

from __future__ import annotations

OPEN, CLOSE = "([{<", ")]}>"


def brackets(s: str) -> str:
    """The brackets of a text, in order."""
    return f"regexp_replace({s}, '[^()\\\\[\\\\]{{}}<>]++', '')"


def faulty(s: str) -> str:
    """Whether a text's brackets don't match: bracket_error() without saying where, so characters other than brackets aren't looked at one by one."""
    inner = "'\\\\(\\\\)|\\\\[\\\\]|\\\\{\\\\}|<>', ''"
    # what stands next to its partner goes first, three levels deep; little is left for the fold, over which ! stands after a mismatch
    reduced = f"regexp_replace(regexp_replace(regexp_replace({brackets(s)}, {inner}), {inner}), {inner})"
    fold = f"aggregate(split(b, ''), '', (a, c) -> CASE WHEN a = '!' THEN a WHEN instr('{OPEN}', c) > 0 THEN concat(c, a) WHEN a <> '' AND translate(left(a, 1), '{OPEN}', '{CLOSE}') = c THEN substr(a, 2) ELSE '!' END) <> ''"
    return f"transform(array({reduced}), b -> CASE WHEN b = '' THEN false ELSE {fold} END)[0]"


def bracket_error(s: str) -> str:
    """Null where brackets match, else the first error; what stays open is reported from the bottom."""
    # a mark and the number of characters since the last one; p counts those up to the mark before
    gaps = f"split({s}, '[()\\\\[\\\\]{{}}<>]', -1)"
    marks = f"zip_with(split({brackets(s)}, ''), transform(array({gaps}), g -> slice(g, 1, size(g) - 1))[0], (c, g) -> named_struct('c', c, 'g', length(g)))"
    at = "(st.p + m.g)"
    top = "right(st.stack, 1)"
    partner = f"translate({top}, '{OPEN}', '{CLOSE}')"
    state = lambda stack, at_, err: f"named_struct('stack', {stack}, 'at', {at_}, 'err', {err}, 'p', {at} + 1)"
    unmatched = f"concat('Unmatched closing bracket \\'', m.c, '\\' at position ', {at})"
    mismatched = f"concat('Mismatched brackets: expected \\'', {partner}, '\\', got \\'', m.c, '\\' at position ', {at})"
    shut = f"""CASE WHEN st.stack = '' THEN {state('st.stack', 'st.at', unmatched)}
        WHEN {partner} <> m.c THEN {state('st.stack', 'st.at', mismatched)}
        ELSE {state('left(st.stack, length(st.stack) - 1)', 'slice(st.at, 1, greatest(size(st.at) - 1, 0))', 'st.err')} END"""
    step = f"CASE WHEN st.err IS NOT NULL THEN st WHEN instr('{OPEN}', m.c) > 0 THEN {state('concat(st.stack, m.c)', f'concat(st.at, array({at}))', 'st.err')} ELSE {shut} END"
    end = "CASE WHEN st.err IS NOT NULL THEN st.err WHEN st.stack <> '' THEN concat('Unmatched opening bracket \\'', left(st.stack, 1), '\\' at position ', st.at[0]) END"
    return f"CASE WHEN {faulty(s)} THEN aggregate({marks}, named_struct('stack', '', 'at', cast(array() AS array<int>), 'err', cast(NULL AS string), 'p', 0), (st, m) -> {step}, st -> {end}) END"


def ligand_error(s: str) -> str:
    """Null where the ligands' numbers follow each other without a gap or repeat."""
    n = f"array_sort(transform(regexp_extract_all({s}, '\\\\|L([0-9]+)=', 1), x -> int(x)))"
    return f"CASE WHEN size({n}) > 0 AND {n} <> sequence({n}[0], {n}[size({n}) - 1]) THEN concat('Non-consecutive ligand indices: [', array_join({n}, ', '), ']') END"


def charge_error(s: str) -> str:
    """Null unless a sign stands before three or more digits."""
    return f"CASE WHEN {s} RLIKE '[+-][0-9]{{3,}}' THEN concat('Invalid charge format: [', array_join(transform(regexp_extract_all({s}, '[+-][0-9]{{3,}}', 0), x -> concat('\\'', x, '\\'')), ', '), ']') END"


def token_checks(s: str) -> dict[str, str]:
    """The checks of metal, shape and stereo tokens: none rejects anything, whatever the text."""
    return dict.fromkeys(("metal", "shape", "stereo"), "true")


def errors(s: str) -> str:
    """All structural errors; of no text, one."""
    return f"CASE WHEN coalesce({s}, '') = '' THEN array('Empty or invalid input') ELSE filter(array({bracket_error(s)}, {ligand_error(s)}, {charge_error(s)}), e -> e IS NOT NULL) END"


#: What \s stands for, trimmed without a pattern that tries each place of a text.
TRIMMED = "trim(BOTH ' \\t\\n\\u000B\\u000C\\r' FROM {})"
NAMED = "length(t) >= 10 AND (t LIKE '%[Metal:%' OR t RLIKE '\\\\[[A-Z][a-z]?\\\\]' OR t LIKE '%|L%')"


def is_valid(s: str, strict: bool = False) -> str:
    # brackets are among the errors
    faultless = f"size({errors('t')}) = 0" if strict else f"NOT {faulty('t')}"
    # the trimmed text is bound once, as the one element of an array
    return f"transform(array({TRIMMED.format(s)}), t -> coalesce({NAMED} AND {faultless}, false))[0]"


def error_class(s: str) -> str:
    """Null of a valid string, else bracket, truncation, delimiter, charge or other, the first that holds."""
    # the text and its brackets are looked at once: trimming takes none away
    known = f"transform(array(coalesce({s}, '')), c -> named_struct('c', c, 'bad', {faulty('c')}))[0]"
    named = f"transform(array({TRIMMED.format('x.c')}), t -> {NAMED})[0]"
    kind = f"CASE WHEN x.bad THEN 'bracket' WHEN {named} THEN NULL WHEN x.c RLIKE '[|:=]$' THEN 'truncation' WHEN x.c LIKE '%||%' OR x.c LIKE '%;;%' OR x.c LIKE '%,,%' THEN 'delimiter' WHEN x.c RLIKE '[+-][0-9]{{3,}}' THEN 'charge' ELSE 'other' END"
    return f"transform(array({known}), x -> {kind})[0]"


def refs_defined(s: str) -> str:
    """Whether every ligand that is referred to before the first bar is defined; false of blank text."""
    refs = f"regexp_extract_all(split({s}, '\\\\|')[0], 'L([0-9]+)(?=[:@)])', 1)"
    return f"coalesce(trim({s}) <> '' AND size(array_except({refs}, regexp_extract_all({s}, '\\\\|L([0-9]+)=', 1))) = 0, false)"


def constraint_recall(predicted: str, target: str) -> str:
    """Share of the target's trans constraints that are predicted; without any, 1 if none is predicted, else 0."""
    of = lambda s: f"array_distinct(regexp_extract_all({s}, '\\\\{{trans:([^}}]+)\\\\}}', 1))"
    return f"CASE WHEN size({of(target)}) = 0 THEN IF(size({of(predicted)}) = 0, 1D, 0D) ELSE size(array_intersect({of(predicted)}, {of(target)})) / size({of(target)}) END"
