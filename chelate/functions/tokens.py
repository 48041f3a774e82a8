"""Tokens of canonical strings, as SQL expressions."""

from __future__ import annotations

from chelate.constants import METALS

#: The tokens that every vocabulary starts with, in order of their ids.
SPECIAL = [
    "[SEP]", "[CLS]", "[PAD]", "[MASK]", "[UNK]",
    *[f"[{m}]" for m in "Fe Co Ni Cu Zn Ru Rh Pd Pt Ir Sc Ti V Cr Mn Y Zr Nb Mo Tc Ag Cd La Hf Ta W Re Os Au Hg".split()],
    *[f";ox={x}" for x in ("+1", "+2", "+3", "+4", "+5", "+6", "0", "-1", "-2")],
    *[f";row={x}" for x in (3, 4, 5)],
    *[f";d={x}" for x in range(11)],
    *[f";CN={x}" for x in range(2, 9)],
    "<Shape:", ">", "Td", "SP", "Oh", "TP", "TBP", "SPY", "TPr", "L",
    *[f"V_{x:03d}" for x in range(100)],
    "{trans:", "{cis:", "}", "--",
    *[f"L{x}" for x in range(1, 21)],
    *[f":{e}:{x}" for e in ("N", "O", "S", "P", "Cl") for x in range(1, 10)],
    "|", "=",
]
assert len(METALS) == 30
VOCABULARY, BINS, MOST = 10_000, 100, 20.0
#: A block in brackets of each kind, else one character.
BLOCK = r"\\[[^\\]]*\\]|<[^>]*>|\\{[^}]*\\}|\\|[^|]*\\||(?s:.)"


def quantized(x: str) -> str:
    """The bin of a measure as a token: V_000 to V_099 over 0 to 20."""
    return f"concat('V_', lpad(string(least(int({x} / {MOST}D * {BINS}), {BINS - 1})), 3, '0'))"


def dequantized(token: str) -> str:
    """The lower edge of a bin's token."""
    return f"int(substr({token}, 3)) * {MOST / BINS}D"


def numbers_binned(s: str) -> str:
    """Every decimal number of the string as its bin's token."""
    hits, gaps = f"regexp_extract_all({s}, '[0-9]+\\\\.[0-9]+', 0)", f"split({s}, '[0-9]+\\\\.[0-9]+', -1)"
    return f"concat({gaps}[0], array_join(transform({hits}, (h, i) -> concat({quantized('double(h)')}, {gaps}[i + 1])), ''))"


def blocks(s: str) -> str:
    return f"regexp_extract_all({s}, '{BLOCK}', 0)"


def of_block(b: str) -> str:
    """The tokens of one block; a shape block without = keeps only its ends, other braces become characters."""
    inner = f"substr({b}, 2, length({b}) - 2)"
    part = "CASE WHEN p LIKE 'ox:%' THEN concat(';ox=', substr(p, 4)) WHEN p LIKE 'd:d%' THEN concat(';d=', substr(p, 4)) WHEN p LIKE 'd:%' THEN concat(';d=', substr(p, 3)) WHEN p LIKE 'CN:%' THEN concat(';CN=', substr(p, 4)) WHEN p LIKE 'row:%' THEN concat(';row=', substr(p, 5)) END"
    composite = f"concat(array(concat('[', replace(split({inner}, '\\\\|')[0], 'Metal:', ''), ']')), filter(transform(slice(split({inner}, '\\\\|'), 2, length({inner}) + 1), p -> {part}), t -> t IS NOT NULL))"
    factored = f"concat(array(concat('[', split({inner}, ';')[0], ']')), transform(filter(slice(split({inner}, ';'), 2, length({inner}) + 1), p -> p <> ''), p -> concat(';', p)))"
    metal = f"CASE WHEN {inner} LIKE 'Metal:%' AND {inner} LIKE '%|%' THEN {composite} ELSE {factored} END"
    items = f"filter(split(substr({b}, 8, greatest(length({b}) - 8, 0)), ','), x -> x LIKE '%=%')"
    shape = f"concat(array('<Shape:'), flatten(transform({items}, (x, i) -> concat(IF(i > 0, array(','), cast(array() AS array<string>)), array(split(x, '=')[0], '=', split(x, '=')[1])))), array('>'))"
    rest = f"IF({b} LIKE '{{trans:%', substr({inner}, 7), substr({inner}, 5))"
    ends = f"IF(size(split({rest}, '--')) = 2, array(split({rest}, '--')[0], '--', split({rest}, '--')[1]), cast(array() AS array<string>))"
    pair = f"CASE WHEN {b} LIKE '{{trans:%' OR {b} LIKE '{{cis:%' THEN concat(array(IF({b} LIKE '{{trans:%', '{{trans:', '{{cis:')), {ends}, array('}}')) ELSE split({b}, '') END"
    named = f"IF({inner} LIKE '%=%', concat(array(split({inner}, '=', 2)[0], '='), filter(split(split({inner}, '=', 2)[1], ''), x -> x <> '')), cast(array() AS array<string>))"
    lig = f"concat(array('|'), {named}, array('|'))"
    return f"CASE WHEN length({b}) < 2 THEN array({b}) WHEN {b} LIKE '[%' THEN {metal} WHEN {b} LIKE '<%' THEN {shape} WHEN {b} LIKE '{{%' THEN {pair} ELSE {lig} END"


def tokens(s: str) -> str:
    return f"flatten(transform({blocks(numbers_binned(s))}, b -> {of_block('b')}))"
